"""Mixing sources to target weights by a hypergeometric splitting tree.

All of it is column expressions. Every source is a sequence of documents in md5
order of their ids, repeated ``max_repeat`` times and cut into blocks of
``block_words`` words. A source's target is a quota of its blocks. The quotas of
all sources are split among the output shards by a binary tree: at every node the
left half gets a multivariate hypergeometric draw of the node's quotas, and half of
the blocks that no quota needs. A shard so holds a range of every source's blocks in
permuted order and draws its quota from that range: shards are disjoint, quotas are
exact, and which words are taken follows from the tree. The last block drawn of a
source is cut where its target ends, so targets are met to the word. Rows of a
shard are ordered by hash.

The words after a source's last whole block are taken only if all blocks are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterpanel.functions.session import written_table

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024  # parts of a source's order that are sorted on their own
PRIME = (1 << 61) - 1  # larger than any number of blocks, so coprime to it
SLICE = 4096  # slots per join key between blocks and shard quotas
GROUP = 256  # sources that share a splitting tree


def word_count(text: str = "text"):
    """Words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, max_repeat: int = 2
) -> DataFrame:
    """(src, source_size, target, quota words) from (src, source_size) rows.

    Sources in code-point order of ``src`` take ``weights`` in turn and share
    ``budget`` times all words; a target stops at ``max_repeat`` times its
    source, and the excess is shared again by weight until none is above. That
    is a water level: sources are capped in order of cap / weight, up to the
    first whose cap is not reached. One row per source, so the windows are small.
    """
    by_rank = Window.orderBy("src")
    listed = sizes.withColumn("rank", F.row_number().over(by_rank) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    listed = listed.withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    listed = (
        listed.withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all_words") * float(budget) - F.col("capped")) / F.sum("weight").over(after))
        .withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    )
    # the level at the first source that stays below its cap holds for all after it
    first = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank", "level"))).over(everything)
    listed = listed.withColumn("at", first)
    below = F.col("at").isNotNull() & (
        F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("rank")) >= F.struct(F.col("at.r").alias("r"), F.col("at.rank").alias("rank"))
    )
    target = F.when(below, F.least(F.col("at.level") * F.col("weight"), F.col("cap"))).otherwise(F.col("cap"))
    return listed.select("src", "rank", "source_size", target.alias("target"), F.floor(target).cast("bigint").alias("words"))


def _draw(total: str, good: str, n: str, u: str) -> str:
    """SQL of one hypergeometric draw: of ``n`` out of ``total`` with ``good``.

    Inversion over the support cut to 12 standard deviations around the mean
    (mass beyond: below 1e-30), with weights built up by their ratios.
    """
    return f"""
    CASE WHEN {n} <= 0 OR {good} <= 0 THEN 0L WHEN {n} >= {total} THEN {good} WHEN {good} >= {total} THEN {n} ELSE
    element_at(transform(array(named_struct(
        'mean', {n} * ({good} / {total}),
        'sd', sqrt({n} * ({good} / {total}) * (1 - {good} / {total}) * (({total} - {n}) / greatest({total} - 1, 1))))),
      g -> element_at(transform(array(named_struct(
          'lo', greatest(0L, {n} + {good} - {total}, CAST(floor(g.mean - 12 * g.sd) AS BIGINT) - 2),
          'hi', least({n}, {good}, CAST(ceil(g.mean + 12 * g.sd) AS BIGINT) + 2))),
        r -> element_at(transform(array(aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 's', 0D),
              (a, k) -> named_struct('w', a.w * (({good} - k) / (k + 1D)) * (({n} - k) / ({total} - {good} - {n} + k + 1D)),
                                     's', a.s + a.w), a -> a.s)),
          mass -> aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 's', 0D, 'x', r.lo),
              (a, k) -> named_struct('w', a.w * (({good} - k) / (k + 1D)) * (({n} - k) / ({total} - {good} - {n} + k + 1D)),
                                     's', a.s + a.w,
                                     'x', CASE WHEN a.s <= {u} * mass THEN k ELSE a.x END), a -> a.x)), 1)), 1)), 1) END"""


def block_quotas(targets: DataFrame, max_repeat: int, block_words: int) -> DataFrame:
    """(src, rank, whole, quota, spare): whole blocks of a source, drawn, not drawn.

    A target beyond the whole blocks has one block more, the words that follow them.
    """
    whole = F.expr(f"source_size * {max_repeat} div {block_words}")
    over = (F.col("words") > F.col("whole") * block_words).cast("bigint")
    full = F.expr(f"(least(words, whole * {block_words}) + {block_words - 1}) div {block_words}")
    listed = targets.withColumn("whole", whole).withColumn("quota", full + over)
    return listed.select("src", "rank", "whole", "quota", (F.col("whole") + over - F.col("quota")).alias("spare"))


def shard_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(src, shard, quota, first, start): blocks that each shard draws of each source.

    ``quotas`` has (src, rank, quota, spare). Each level splits every node in two,
    quotas by the draw and spare blocks by half. A shard's blocks of a source are
    numbered from ``start``, its drawn ones counted from ``first``. Quotas of a source
    over all shards sum to its quota. GROUP sources at a time share a tree, so no row
    grows with the number of sources; shards differ by a block for each such group.
    """
    node = quotas.groupBy(F.floor(F.col("rank") / GROUP).alias("grp")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "src", "quota", "spare"))).alias("s")
    )
    node = node.select("grp", F.lit(1).cast("bigint").alias("node"), F.col("s.src").alias("src"), F.col("s.quota").alias("q"), F.col("s.spare").alias("sp"))
    u = f"((conv(substr(md5(concat('{seed}:', grp, ':', node, ':', i)), 1, 12), 16, 10) + 0.5D) / 281474976710656D)"
    draw = _draw("st.total", "q[i]", "st.need", u)
    for _ in range(depth):
        left = F.expr(
            f"""aggregate(sequence(0, size(q) - 1),
                named_struct('total', aggregate(q, 0L, (a, b) -> a + b),
                             'need', (aggregate(q, 0L, (a, b) -> a + b) + node % 2) div 2,
                             'got', CAST(array() AS ARRAY<BIGINT>)),
                (st, i) -> element_at(transform(array({draw}), x -> named_struct(
                    'total', st.total - q[i], 'need', st.need - x, 'got', concat(st.got, array(x)))), 1),
                st -> st.got)"""
        )
        node = node.withColumn("l", left).withColumn("ls", F.expr("transform(sp, v -> (v + node % 2) div 2)"))
        rest = [F.zip_with(a, b, lambda x, y: x - y).alias(a) for a, b in (("q", "l"), ("sp", "ls"))]
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q"), F.col("ls").alias("sp")),
            F.struct((F.col("node") * 2 + 1).alias("node"), *rest),
        )
        node = node.select("grp", "src", F.explode(halves).alias("c")).select("grp", "src", "c.node", "c.q", "c.sp")
    leaves = node.select((F.col("node") - (1 << depth)).alias("shard"), F.explode(F.arrays_zip("src", "q", "sp")).alias("z"))
    leaves = leaves.select("z.src", "shard", F.col("z.q").alias("quota"), F.col("z.sp").alias("spare"))
    order = Window.partitionBy("src").orderBy("shard")
    first, start = F.sum("quota").over(order), F.sum(F.col("quota") + F.col("spare")).over(order)
    return leaves.select(
        "src", "shard", "quota", (first - F.col("quota")).alias("first"), (start - F.col("quota") - F.col("spare")).alias("start")
    )


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    budget: float = 1.5,
    max_repeat: int = 2,
    block_words: int = 1024,
    shard_depth: int = 6,
    seed: int = 20,
    row: str | None = None,
) -> DataFrame:
    """One row per taken piece of a document copy, and one with 0 words for the rest.

    Columns: row (of the input: the column that ``row`` names, or a number given
    here), doc_id, source, size, source_size, target, copy (0-based), begin (words of
    the document before the piece), words (taken), shard, slot (of its block),
    order_key (sort key within the shard). A piece is what one block holds of a copy.
    Texts are read once, for their sizes, and do not travel.

    A null source is a source of its own, after all others. Null and empty texts
    have size 0 and are taken with 0 words (shard null). Repeated rows are rows of
    their own, taken in any order. An empty table gives no rows.
    """
    key = F.when(F.col(f"`{source}`").isNull(), F.lit("n")).otherwise(F.concat(F.lit("i"), F.col(f"`{source}`")))
    rows = docs.select(
        (F.col(f"`{row}`") if row else F.monotonically_increasing_id()).alias("row"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        key.alias("src"),
        word_count(text).alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{doc_id}`").cast("string")).cast("binary")).alias("pick"),
    ).withColumn("bucket", F.conv(F.substring("pick", 1, 3), 16, 10).cast("int") % 4096 * BUCKETS / 4096)
    rows = written_table(rows.withColumn("bucket", F.floor("bucket").cast("int")), "mix-sizes")

    # totals by part of a source: the pre-aggregate behind targets and offsets
    parts = rows.groupBy("src", "bucket").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.groupBy("src").agg(F.sum("part_size").alias("source_size")), weights, budget, max_repeat)
    offsets = parts.select(
        "src", "bucket", (F.sum("part_size").over(Window.partitionBy("src").orderBy("bucket")) - F.col("part_size")).alias("before")
    )
    within = Window.partitionBy("src", "bucket").orderBy("pick", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("run", F.sum("size").over(within) - F.col("size"))
        .join(offsets, ["src", "bucket"])
        .join(targets, "src")
        .withColumn("place", F.col("before") + F.col("run"))
    )
    quotas = written_table(block_quotas(targets, max_repeat, block_words), "mix-quotas")
    copy = F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1)))
    copies = placed.join(quotas.select("src", "whole"), "src").withColumn("copy", copy)
    copies = copies.withColumn("at", F.col("copy") * F.col("source_size") + F.col("place"))
    held = F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + greatest(size, 1) - 1) div {block_words}"))
    pieces = copies.withColumn("block", F.explode(held))

    # a bijection of a source's whole blocks onto slots; what follows them stays last
    wide = "decimal(38,0)"
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "src").cast("binary")), 1, 12), 16, 10)
    slot = F.pmod(
        F.col("block").cast(wide) * F.lit(PRIME).cast(wide) + offset.cast(wide), F.greatest("whole", F.lit(1)).cast(wide)
    ).cast("bigint")
    pieces = pieces.withColumn("slot", F.when(F.col("block") < F.col("whole"), slot).otherwise(F.col("block")))
    drawn = shard_quotas(quotas, shard_depth, seed).filter("quota > 0")
    reach = F.sequence(F.expr(f"start div {SLICE}"), F.expr(f"(start + quota - 1) div {SLICE}"))
    drawn = drawn.select(F.col("src").alias("q_src"), "shard", "quota", "first", "start", F.explode(reach).alias("slice"))
    hit = (
        (F.col("src") == F.col("q_src"))
        & (F.expr(f"slot div {SLICE}") == F.col("slice"))
        & (F.col("slot") >= F.col("start"))
        & (F.col("slot") < F.col("start") + F.col("quota"))
    )
    met = pieces.join(drawn, hit, "left")
    # words of the block that are taken: all, but for the last one drawn of its source
    used = F.least(F.lit(block_words), F.col("words") - (F.col("first") + F.col("slot") - F.col("start")) * block_words)
    low = F.greatest(F.col("at"), F.col("block") * block_words)
    high = F.least(F.col("at") + F.col("size"), F.col("block") * block_words + used)
    taken = F.when(F.col("shard").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), high - low)).cast("bigint")
    met = met.withColumn("begin", low - F.col("at")).withColumn("taken", taken)
    met = met.filter("taken > 0 OR (copy = 0 AND begin = 0)")
    return met.select(
        "row",
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "copy",
        "begin",
        F.col("taken").alias("words"),
        F.when(F.col("taken") > 0, F.col("shard")).alias("shard"),
        F.when(F.col("taken") > 0, F.col("slot")).alias("slot"),
        F.xxhash64(F.lit(seed), "pick", "copy", "begin").alias("order_key"),
    )


def taken_words(mixed: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per input row of a mix."""
    keys = ["row", "doc_id", "size", "source_size", "target"]
    return mixed.groupBy(*keys).agg(F.sum("words").alias("taken")).drop("row")


def _runs(docs: DataFrame, shards: bool, **options) -> DataFrame:
    """The mix as documents, with shard and order_key of each row if asked for."""
    text = options.get("text", "text")
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    given = written_table(given, "mix-rows")
    used = {options.get(k, k) for k in ("doc_id", "text", "source")}
    key = next(k for k in ("row", "row_", "row__", "row___") if k not in used)
    sized = given.select(F.col("row").alias(key), *[F.col(f"doc.`{c}`") for c in sorted(used)])
    piece = F.struct("copy", "begin", "words", "shard", "order_key")
    taken = mix(sized, row=key, **options).filter("words > 0").groupBy(F.col("row").alias("of_row"), "size")
    # pieces of a copy that follow one another are one run, in the shard of the first
    runs = F.expr(
        """aggregate(pieces, slice(pieces, 1, 0), (a, p) -> CASE
             WHEN size(a) > 0 AND element_at(a, -1).copy = p.copy AND element_at(a, -1).begin + element_at(a, -1).words = p.begin
             THEN concat(slice(a, 1, size(a) - 1), array(named_struct('copy', p.copy, 'begin', element_at(a, -1).begin,
                  'words', element_at(a, -1).words + p.words, 'shard', element_at(a, -1).shard, 'order_key', element_at(a, -1).order_key)))
             ELSE concat(a, array(p)) END)"""
    )
    taken = taken.agg(F.sort_array(F.collect_list(piece)).alias("pieces")).select("of_row", "size", runs.alias("runs"))
    # the narrow side is held in memory a partition at a time, so texts are not sorted
    met = given.join(taken.hint("shuffle_hash"), F.col("row") == F.col("of_row"))
    body = F.col(f"doc.`{text}`")
    words = F.when(F.exists("runs", lambda r: r["words"] < F.col("size")), F.regexp_extract_all(body, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)))
    cut = lambda w, r: F.array_join(F.slice(w, (r["begin"] + 1).cast("int"), r["words"].cast("int")), "")
    one = lambda w, r: F.struct(r["shard"].alias("shard"), r["order_key"].alias("order_key"), F.when(r["words"] < F.col("size"), cut(w, r)).alias("cut"))
    each = F.element_at(F.transform(F.array(words), lambda w: F.transform("runs", lambda r: one(w, r))), 1)
    met = met.select("doc", F.explode(each).alias("run"))
    columns = [F.coalesce("run.cut", body).alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return met.select(*columns, *([F.col("run.shard"), F.col("run.order_key")] if shards else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row per run of taken words, in the columns of ``docs``.

    A document is cut where a drawn block begins or ends; blocks of one copy that
    follow one another give one row. The mix is made on narrow rows; texts meet it
    once, at the end, by the number of their row in a table that is written first.
    """
    return _runs(docs, False, **options)


def write_mix(docs: DataFrame, path: str, **options) -> None:
    """Write the mixed documents by shard, each shard in shuffled order.

    Parquet with a folder per ``shard``; ``order_key`` is kept and rises within the
    files of a shard. ``docs`` must not have columns of these two names. A shard may
    be written by several tasks, so none has to hold a whole one.
    """
    if {"shard", "order_key"} & set(docs.columns):
        raise ValueError("columns shard and order_key are taken; rename them")
    rows = _runs(docs, True, **options)
    ordered = rows.repartitionByRange("shard", "order_key").sortWithinPartitions("shard", "order_key")
    ordered.write.partitionBy("shard").parquet(path)
