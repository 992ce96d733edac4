"""Exact n-gram Jaccard join by vertical partitioning of the n-gram order.

N-grams have one global order: rare before frequent (by a fixed-size table of
counts over all documents), then by hash. Documents with equal sets are one node.

1. Two sets with Jaccard >= 0.8 share an n-gram among the first 20 % of each in
   that order, so only those prefixes are indexed.
2. A candidate pair is checked by sizes and by the parity bits of its sets, which
   bound the symmetric difference from below.
3. The order is cut into fragments. Every candidate has its set stored fragment
   by fragment, the partial overlaps of a pair are counted separately for each
   fragment, and summed per pair.

What is asked for is reachability, so pairs are tried in turns: each node with the
first node of an n-gram's list; then, between different components only, with
pivots of long lists; with all others of the list. Of the pairs between two
components the few with the most similar parities are verified first, the others
only if the two are still apart. No link between different components is left
untested, and of a large group of near copies few pairs are verified for each node
that joins it. Lists meet as narrow rows; parities are joined to distinct pairs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpanel.functions.session import written_table
from counterpanel.llm.components import stars
from counterpanel.llm.memory import handing_back
from counterpanel.llm.shingles import WIDTH, shingle_sets

PERCENT = 80  # Jaccard threshold
COUNTERS = 1 << 20  # of the n-gram count table, whatever the input's size
SLOTS = 64  # parts that the table is summed in
FRAGMENTS = 8
PARITY_LONGS = 4  # at least; a set has as many parity bits as n-grams, rounded up to a power of two
PIVOTS = 8
PIVOT_LISTS = 64  # longer lists meet pivots before all pairs are tried
FEW = 4  # pairs of two components that are verified before their others
FILTER_BITS = 1 << 22  # of the set of documents that a verification reads


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(44)).astype(np.int64)


def _parity(grams: np.ndarray) -> np.ndarray:
    """Parity of the number of n-grams in each class of their low bits."""
    bits = max(64 * PARITY_LONGS, 1 << (len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _nonnull(column: pa.Array) -> pa.Array:
    return column.fill_null("")


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """Rows of documents (doc_id, fp, n) and of count tables (slot, counts)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        names = ["doc_id", "fp", "n", "slot", "counts"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            fps, ns = [], []
            for own in shingle_sets(_nonnull(batch.column(1)), width):
                np.add.at(counts, _counter(own), 1)
                fps.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                ns.append(len(own))
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.binary()), pa.array(ns, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names=names,
            )
        if id_type is not None and counts.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, SLOTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLOTS, id_type), pa.nulls(SLOTS, pa.binary()), pa.nulls(SLOTS, pa.int64()), pa.array(range(SLOTS), pa.int32()), pa.array(parts, pa.binary())],
                names=names,
            )

    return docs.mapInArrow(handing_back(run), f"doc_id {kind}, fp binary, n bigint, slot int, counts binary")


def _count_table(scanned: DataFrame) -> np.ndarray:
    """The summed table: COUNTERS values, so its size does not grow."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(zlib.decompress(part.as_py()), np.uint32)
                sums[slot] = sums[slot] + got if slot in sums else got.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums, pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slot", "counts"]
        )

    parts = scanned.filter("slot IS NOT NULL").select("slot", "counts").repartition("slot").mapInArrow(handing_back(add), "slot int, counts binary")
    table = np.zeros((SLOTS, COUNTERS // SLOTS), np.int64)
    for r in parts.collect():
        table[r["slot"]] = np.frombuffer(r["counts"], np.int64)
    return table.ravel()


def _prefixes(docs: DataFrame, shared, width: int) -> DataFrame:
    """(doc_id, fp, n, prefix, parity) of documents with a set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows = []
            for at, own in enumerate(shingle_sets(_nonnull(batch.column(1)), width)):
                n = len(own)
                if n:
                    first = np.lexsort((own, table[_counter(own)]))[: n - -(-n * PERCENT // 100) + 1]
                    fp = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    rows.append((at, fp, n, own[first].view(np.int64), _parity(own)))
            at, fps, ns, prefixes, parities = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array(fps, pa.binary()), pa.array(ns, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64())),
                ],
                names=["doc_id", "fp", "n", "prefix", "parity"],
            )

    return docs.mapInArrow(handing_back(run), f"doc_id {kind}, fp binary, n bigint, prefix array<bigint>, parity array<bigint>")


def _postings(nodes: DataFrame) -> DataFrame:
    """(gram, node, n, rep, kind) of n-grams in two prefixes or more.

    ``rep`` is the first node of the n-gram's list whose size is compatible, null
    for such nodes themselves. ``kind`` is 0 in lists of two nodes, 2 in lists of
    more than PIVOT_LISTS, else 1. Lists are streamed in order; at most PIVOT_LISTS
    rows of one are held, until its kind is known.
    """
    longest = PIVOT_LISTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = head = size = None
        held: list[tuple] = []  # of the current list, as long as its kind is open
        length = 0
        out: list[tuple] = []

        def end() -> None:
            if length > 1:
                out.extend((*row, int(length > 2)) for row in held)
            held.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["gram", "node", "n", "rep", "kind"])

        for batch in batches:
            gram, n, node = (batch.column(i).to_numpy() for i in range(3))
            if not len(gram):
                continue
            same = gram[1:] == gram[:-1]
            busy = np.concatenate(([True], same)) | np.concatenate((same, [True]))
            for g, k, v in zip(gram[busy].tolist(), n[busy].tolist(), node[busy].tolist(), strict=True):
                rep = head
                if g != current:
                    end()
                    current, length = g, 0
                    rep = None
                elif 100 * size < PERCENT * k:
                    rep = None
                if rep is None:
                    head, size = v, k
                length += 1
                if length <= longest:
                    held.append((g, v, k, rep))
                    continue
                out.extend((*row, 2) for row in held)
                held.clear()
                out.append((g, v, k, rep, 2))
            yield made()
        if length <= longest:
            end()
        yield made()

    index = nodes.select(F.explode("prefix").alias("gram"), "n", "node")
    kinds = "gram bigint, node bigint, n bigint, rep bigint, kind bigint"
    return index.repartition("gram").sortWithinPartitions("gram", "n", "node").mapInArrow(handing_back(run), kinds)


def _differ(pa_, pb):
    """Number of differing parity bits."""

    def folded(longer, half):  # with half as many classes, two of them are one
        return F.zip_with(F.slice(longer, F.lit(1), half), F.slice(longer, half + 1, half), lambda x, y: x.bitwiseXOR(y))

    la, lb = F.size(pa_), F.size(pb)
    pa_, pb = F.when(la > lb, folded(pa_, lb)).otherwise(pa_), F.when(lb > la, folded(pb, la)).otherwise(pb)
    return F.aggregate(F.zip_with(pa_, pb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, b: a + b)


def _sizes_allow(na, nb):
    return (na * 100 >= nb * PERCENT) & (nb * 100 >= na * PERCENT)


def _parities_allow(na, nb, differ):
    """With s = |A| + |B|, the symmetric difference is at most
    s * (100 - PERCENT) / (100 + PERCENT), and at least the differing parities."""
    return differ * (100 + PERCENT) <= (na + nb) * (100 - PERCENT)


def _passing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, ...), with sizes and the number of differing parities,
    that sizes and parities allow."""
    info = nodes.select("node", "n", "parity")
    a = info.toDF("a", "na", "parity_a")
    b = info.toDF("b", "nb", "parity_b")
    joined = pairs.distinct().join(a, "a").join(b, "b").filter(_sizes_allow(F.col("na"), F.col("nb")))
    joined = joined.withColumn("differ", _differ(F.col("parity_a"), F.col("parity_b")))
    allowed = _parities_allow(F.col("na"), F.col("nb"), F.col("differ"))
    return joined.filter(allowed).select(*pairs.columns, "na", "nb", "differ")


def _fragments(docs: DataFrame, wanted: DataFrame, shared, cuts: np.ndarray, width: int) -> DataFrame:
    """(node, fragment, grams) of the wanted nodes (node, fp, first_id).

    The documents are filtered on the way by a bit table of fixed size before
    their sets are made; the join that follows is exact.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    bit = F.pmod(F.xxhash64(F.col("first_id").cast("string")), F.lit(FILTER_BITS))
    words = wanted.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits")
    )
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():  # at most FILTER_BITS / 64 rows
        bits[r["word"]] = r["bits"]
    table = docs.sparkSession.sparkContext.broadcast(np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = table.value, shared.value
        for batch in batches:
            keep = np.flatnonzero(known[batch.column(2).to_numpy(zero_copy_only=False)])
            picked = batch.take(pa.array(keep))
            at, fps, parts, grams = [], [], [], []
            for row, own in enumerate(shingle_sets(_nonnull(picked.column(1)), width)):
                part = np.searchsorted(cuts, counts[_counter(own)], "right")
                fp = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                for f in np.unique(part).tolist():
                    at.append(row)
                    fps.append(fp)
                    parts.append(f)
                    grams.append(own[part == f].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    picked.column(0).take(pa.array(at, pa.int64())), pa.array(fps, pa.binary()),
                    pa.array(parts, pa.int32()), pa.array(grams, pa.list_(pa.int64())),
                ],
                names=["doc_id", "fp", "fragment", "grams"],
            )

    marked = docs.withColumn("bit", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FILTER_BITS)).cast("int"))
    made = marked.mapInArrow(handing_back(run), f"doc_id {kind}, fp binary, fragment int, grams array<bigint>")
    mine = wanted.withColumnRenamed("fp", "of")
    exact = made.join(mine, (F.col("fp") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    # equal rows have equal sets; the join's partitioning by fp serves this grouping too
    one = exact.groupBy("fp", "fragment").agg(F.first("node").alias("node"), F.first("grams").alias("grams"))
    return one.select("node", "fragment", "grams")


def _ends(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, fp, first_id) of the nodes in pairs."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return nodes.select("node", "fp", "first_id").join(ends, "node", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: partial overlaps by fragment, summed."""
    left = sets.toDF("a", "fragment", "grams_a")
    right = sets.toDF("b", "of_fragment", "grams_b")
    met = pairs.join(left, "a").join(right, (pairs["b"] == right["b"]) & (F.col("fragment") == F.col("of_fragment")))
    partial = met.select(pairs["a"], pairs["b"], "na", "nb", F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return total.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * PERCENT).select("a", "b")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """At most FEW pairs of each two components, that with the most similar parities
    among them: the best of each of FEW random parts."""
    names = ["a", "b", "na", "nb"]
    best = F.struct((F.col("differ") / (F.col("na") + F.col("nb"))).alias("apart"), *names)
    part = F.pmod(F.xxhash64("a", "b"), F.lit(FEW))
    low, high = F.least("root_a", "root_b"), F.greatest("root_a", "root_b")
    return pairs.groupBy(low.alias("low"), high.alias("high"), part.alias("part")).agg(F.min(best).alias("p")).select("p.*").select(*names)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    root_a, root_b = roots.toDF("a", "at_a"), roots.toDF("b", "at_b")
    met = pairs.join(root_a, "a", "left").join(root_b, "b", "left")
    return met.filter(F.coalesce("at_a", "a") != F.coalesce("at_b", "b")).select(*pairs.columns)


def _components(postings: DataFrame, nodes: DataFrame, fragments: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the nodes that are not their component's smallest.

    ``fragments`` gives the sets of nodes (node, fp, first_id).
    """
    roots = nodes.sparkSession.createDataFrame([], "node bigint, root bigint")

    def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        found = written_table(_verified(pairs, sets), "links")
        # stars stand for the links before them
        return roots if found.isEmpty() else stars(found.unionByName(roots.toDF("a", "b")))

    def sets_of(pairs: DataFrame) -> DataFrame:
        return written_table(fragments(_ends(pairs, nodes)), "fragments")

    first = postings.filter("rep IS NOT NULL").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    pairs = written_table(_passing(first, nodes), "pairs")
    if not pairs.isEmpty():
        roots = linked(pairs, sets_of(pairs))
    pairs = written_table(_likeliest(_pivoted(postings, nodes, roots)), "pairs")
    if not pairs.isEmpty():
        roots = linked(pairs, sets_of(pairs))
    pairs = written_table(_between(postings, nodes, roots), "pairs")
    if not pairs.isEmpty():
        sets = sets_of(pairs)
        few = written_table(_likeliest(pairs), "pairs-few")
        roots = linked(few, sets)
        rest = written_table(_apart(pairs.join(few.select("a", "b"), ["a", "b"], "left_anti"), roots), "pairs-rest")
        if not rest.isEmpty():
            roots = linked(rest, sets)
    return roots


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_rows, component_id.

    Links are pairs with 100 * intersection >= 80 * union of their sets of
    distinct ``width``-word shingles (compared as 64-bit hashes; a shorter text
    has its whole sequence as one). Texts without words, empty and null ones have
    empty sets and are linked with nothing. ``class_rows`` are the rows with an
    equal set, ``component_id`` the smallest id reachable by links. Repeated rows
    and repeated ids stay as rows; an id names all its rows. Other columns are
    not read.
    """
    spark: SparkSession = docs.sparkSession
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scanned = written_table(_scan(given, width), "sets")
    table = _count_table(scanned)
    shared = spark.sparkContext.broadcast(table)
    order = np.sort(table)
    mass = np.cumsum(order)
    cuts = order[np.searchsorted(mass, mass[-1] * np.arange(1, FRAGMENTS) // FRAGMENTS)] if mass[-1] else order[:0]
    rows = scanned.filter("slot IS NULL").select("doc_id", "fp", "n")

    nodes = _prefixes(given, shared, width).groupBy("fp").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("class_rows"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix"), F.first("parity").alias("parity"),
    )
    nodes = written_table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    postings = written_table(_postings(nodes), "postings")

    roots = _components(postings, nodes, lambda wanted: _fragments(given, wanted, shared, cuts, width))

    named = nodes.select("fp", "node", "first_id", "class_rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component"))
    classes = named.join(smallest, "root").select(F.col("fp").alias("of"), "class_rows", "component")
    return rows.join(classes, F.col("fp") == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_rows", F.lit(1)).alias("class_rows"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One document of each group of linked ones, in the columns of ``docs``.

    The row with the smallest id stays; documents without words are in no group
    and all stay. If ids repeat, rows with equal id and text are one document,
    and other rows with a representative's id stay with it.
    """
    rows = written_table(jaccard_components(docs, doc_id=doc_id, text=text, width=width), "components")
    chosen = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__chosen"))
    repeated = chosen.groupBy("__chosen").agg(F.count("*").alias("n")).filter("n > 1")
    kept = docs.join(chosen, F.col(f"`{doc_id}`").eqNullSafe(F.col("__chosen")), "left_semi")
    if repeated.isEmpty():
        return kept
    alone = kept.join(repeated, F.col(f"`{doc_id}`").eqNullSafe(F.col("__chosen")), "left_anti")
    again = kept.join(repeated, F.col(f"`{doc_id}`").eqNullSafe(F.col("__chosen")), "left_semi")
    return alone.unionByName(again.dropDuplicates([doc_id, text]))


def _open_lists(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(gram, node, n, root, main) of the lists in more than one component; ``main``
    is the component that holds most of the list."""
    labelled = rows.select("gram", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = labelled.groupBy("gram", "root").agg(F.count("*").alias("nodes"))
    lists = by_root.groupBy("gram").agg(F.count("*").alias("roots"), F.max(F.struct("nodes", "root")).alias("most"))
    return labelled.join(lists.filter("roots > 1").select("gram", F.col("most.root").alias("main")), "gram")


def _other(rows: DataFrame) -> DataFrame:
    """Rows renamed for the second node of a pair."""
    return rows.toDF(*[f"{c}_b" for c in rows.columns])


def _met(mine: DataFrame, other: DataFrame, condition) -> DataFrame:
    """Pairs of one list, of different components, that ``condition`` and sizes allow."""
    apart = (F.col("gram") == F.col("gram_b")) & (F.col("root") != F.col("root_b"))
    return mine.join(other, apart & _sizes_allow(F.col("n"), F.col("n_b")) & condition)


def _in_order(met: DataFrame, *more) -> DataFrame:
    """(a, b, root_a, root_b, ...) of the pairs, the smaller node first."""
    swap = F.col("node") < F.col("node_b")
    return met.select(
        F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"),
        F.when(swap, F.col("root")).otherwise(F.col("root_b")).alias("root_a"),
        F.when(swap, F.col("root_b")).otherwise(F.col("root")).alias("root_b"), *more,
    )


def _sized(met: DataFrame) -> DataFrame:
    """The pairs that parities allow, with sizes and differing parities as ``_passing`` has them."""
    differ = _differ(F.col("parity"), F.col("parity_b"))
    swap = F.col("node") < F.col("node_b")
    na, nb = F.when(swap, F.col("n")).otherwise(F.col("n_b")), F.when(swap, F.col("n_b")).otherwise(F.col("n"))
    return _in_order(met, na.alias("na"), nb.alias("nb"), differ.alias("differ")).distinct()


def _pivoted(postings: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Passing pairs of long lists whose components differ: with up to PIVOTS nodes of the list."""
    mine = _open_lists(postings.filter("kind = 2"), roots).drop("main").join(nodes.select("node", "parity"), "node")
    slot = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    pivot = F.struct(F.xxhash64("node", F.lit(1)).alias("h"), "node", "n", "root", "parity")
    other = mine.groupBy("gram", slot.alias("slot")).agg(F.min(pivot).alias("p")).select("gram", "p.node", "p.n", "p.root", "p.parity")
    allowed = _parities_allow(F.col("n"), F.col("n_b"), _differ(F.col("parity"), F.col("parity_b")))
    return _sized(_met(mine, _other(other), allowed))


def _between(postings: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """All passing pairs of one n-gram's list whose components differ."""
    # a pair has an end outside the component that holds most of its list: only
    # such nodes look for partners, and two of them meet once
    outside = F.col("root") != F.col("main")
    once = (F.col("root_b") == F.col("main")) | (F.col("node") < F.col("node_b"))
    # lists of two nodes were settled by the first turn, lists in one component need nothing
    mine = _open_lists(postings.filter("kind = 1").repartition("gram"), roots).select("gram", "node", "n", "root", "main")
    short = _passing(_in_order(_met(mine.filter(outside), _other(mine.drop("main")), once)), nodes)
    # in long lists a pair is made at its least common n-gram of such lists, once
    mine = _open_lists(postings.filter("kind = 2"), roots)
    info = mine.groupBy("node").agg(F.collect_set("gram").alias("grams")).join(nodes.select("node", "parity"), "node")
    mine = mine.join(info, "node").select("gram", "node", "n", "root", "parity", "grams", "main")
    allowed = _parities_allow(F.col("n"), F.col("n_b"), _differ(F.col("parity"), F.col("parity_b")))
    least = F.array_min(F.array_intersect("grams", "grams_b")) == F.col("gram")
    long = _sized(_met(mine.filter(outside), _other(mine.drop("main")), once & allowed & least))
    return short.unionByName(long.select(*short.columns)).distinct()
