"""Near-duplicate lines by an exact set-similarity join, in column expressions.

A line is the set of its lower-case words, its tokens; a line with fewer than five
words has one token, the whole sequence, and so meets equal lines only. Tokens are
ordered by rarity, from a table of counts of fixed size over all lines, then by
hash: the upper bits of a token's hash are exchanged for the rank of its count, so a
sorted array is a line in rarity order. Lines with equal sets are one class. Two sets
with Jaccard >= 0.8 share a token in their prefixes, and the first they share leaves
enough tokens behind it in both. They meet there, among sets of their band of sizes;
a set near the top of its band meets the next one too. Of the pairs that meet most
are dropped by these positions and by the parities of the sets' tokens in 64 or 128
classes, which bound how many tokens are in one set only; the rest are verified on
the whole sets. A line is removed if an earlier line (by document id, then line
number) has an equal or similar set.

Words are cut twice, once for the counts and once for one narrow row a line, which
all later steps read; whole sets are made again for lines in candidate pairs only.

What is asked for is whether an earlier match exists. Classes of a word with a short
list all meet. In a long list, each class first meets the earliest class alone; only
classes that are still without a match then meet all earlier ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpanel.functions.session import written_table

PERCENT = 80  # Jaccard threshold
COUNTER_BITS = 16  # of a hash; the word count table has 2^16 counters, whatever the input's size
FILTER_WORDS = 1 << 17  # 64-bit words of the set of lines cut again for verification
SHORT = 5  # lines with fewer words are compared as sequences
SPACES = "\t\x0b\x0c\r"  # read as blanks; lines end at \n
LONG = 256  # classes of a word in a band; longer lists meet their earliest class first
PARITY = 64  # token classes of a parity number; sets with more tokens have two of them
BAND = 1.5  # ratio of the sizes in a band, more than 100 / PERCENT


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, body) of all lines, with blanks for other white space."""
    blank = F.col("text")
    for c in SPACES:
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    text = F.when(F.col("text").rlike(f"[{SPACES}]"), blank).otherwise(F.col("text"))
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line", "body"))


def _words(lines: DataFrame) -> DataFrame:
    """``lines`` with ``words`` in place of ``body``: all words of a line, or its whole
    sequence behind a blank if it is short, or none."""
    cut = lines.withColumn("words", F.array_remove(F.split(F.lower("body"), " "), "")).drop("body")
    whole = F.array(F.concat(F.lit(" "), F.array_join("words", " ")))
    return cut.withColumn("words", F.when(F.size("words").between(1, SHORT - 1), whole).otherwise(F.col("words")))


def _slot(token: Column) -> Column:
    return F.shiftrightunsigned(token, 64 - COUNTER_BITS)


def _literal(values: list[int]) -> Column:
    """An array constant; the expression is folded once by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _rarity(docs: DataFrame) -> Column:
    """For each slot of a hash, what turns the slot into the rank of its count (by
    exclusive or; ranks ascend as signed numbers), as an array constant. Any order
    of tokens is right, so words are cut at blanks and line ends alone here."""
    words = docs.select(F.explode(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter("w <> ''")
    counted = words.select(_slot(F.xxhash64("w")).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    rows = counted.toArrow()  # at most a row a counter
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    ranks = np.empty_like(counts)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    turned = ranks ^ np.arange(len(counts)) ^ (len(counts) >> 1)
    return _literal((turned << (64 - COUNTER_BITS)).tolist())


def _keyed(lines: DataFrame, rarity: Column) -> DataFrame:
    """Lines with ``keys``, their distinct tokens as rank and rest of the hash, sorted."""
    tokens = F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))
    keyed = _words(lines).withColumn("keys", F.sort_array(F.transform(tokens, lambda t: t.bitwiseXOR(rarity[_slot(t)]))))
    return keyed.select("doc_id", "line", "keys", F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(1), "keys").alias("h2"))


def _first() -> Column:
    """Order of lines: by document, ids that are null last, then by number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("line").alias("line"))


def _parities(keys: Column) -> list[Column]:
    """Parities of the number of keys in each class of their low bits: 64 classes in
    ``odd``, or for more than 64 keys 128 in ``odd`` and ``odd2``."""
    bits = [1 << i if i < PARITY - 1 else -(1 << i) for i in range(PARITY)]
    none = [0] * PARITY

    def parity(table: list[int]) -> Column:
        bit = _literal(table)
        return F.aggregate(keys, F.lit(0).cast("bigint"), lambda found, k: found.bitwiseXOR(bit[k.bitwiseAND(F.lit(2 * PARITY - 1))]))

    large = F.size(keys) > PARITY
    return [
        F.when(large, parity(bits + none)).otherwise(parity(bits + bits)).alias("odd"),
        F.when(large, parity(none + bits)).otherwise(F.lit(0).cast("bigint")).alias("odd2"),
    ]


def _other(rows: DataFrame) -> DataFrame:
    """Columns of an index row, renamed for the second class of a pair."""
    return rows.toDF(*[f"{c}_a" for c in rows.columns])


def _passing(met: DataFrame) -> DataFrame:
    """(b, nb, a, na): classes that meet in a prefix word and pass the filters."""
    n, na = F.col("n"), F.col("n_a")
    # before the first token that two sets share lies none that both have
    shared = F.least(n - F.col("pos"), na - F.col("pos_a"))
    odd, odd2 = F.col("odd").bitwiseXOR(F.col("odd_a")), F.col("odd2").bitwiseXOR(F.col("odd2_a"))
    both = F.bit_count(odd) + F.bit_count(odd2)
    apart = F.when((n > PARITY) & (na > PARITY), both).otherwise(F.bit_count(odd.bitwiseXOR(odd2)))
    passes = (shared * (100 + PERCENT) >= (n + na) * PERCENT) & (apart * (100 + PERCENT) <= (n + na) * (100 - PERCENT))
    return met.filter(passes).select(F.col("node").alias("b"), n.alias("nb"), F.col("node_a").alias("a"), na.alias("na")).distinct()


def _index(classes: DataFrame) -> DataFrame:
    """A row per prefix token and band of sizes; ``key`` is both."""
    sized = classes.withColumn("band", F.floor(F.ln("n") / F.ln(F.lit(BAND))))
    sized = sized.withColumn("above", F.ceil(F.pow(F.lit(BAND), F.col("band") + 1)))  # the least size of the next band
    rows = sized.select(F.posexplode("prefix").alias("pos", "token"), "n", "node", "odd", "odd2", "first", "band", "above")
    n = F.col("n")
    reaches = (n - F.col("pos")) * (100 + PERCENT) >= (n + F.col("above")) * PERCENT
    bands = F.when(reaches, F.array("band", F.col("band") + 1)).otherwise(F.array("band"))
    rows = rows.withColumn("in_band", F.explode(bands))
    return rows.select("token", F.xxhash64("token", "in_band").alias("key"), "pos", "n", "node", "odd", "odd2", "first")


def _met(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs that pass, and the index rows of long lists that have yet to meet:
    there, only the earliest class has met the others."""
    sized = classes.filter(F.col("n") * (100 - PERCENT) >= PERCENT)  # smaller sets have no similar ones
    index = _index(sized)
    # only a word with that many classes in all bands may have them in one
    words = sized.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("len"))
    words = written_table(words.filter(F.col("len") > LONG).select("token"), "line-words")
    counted = index.join(words, "token", "left_semi").groupBy("key").agg(F.count("*").alias("len"))
    long = written_table(counted.filter(F.col("len") > LONG).select("key"), "line-long")
    # the same columns on both sides, so that one shuffle serves both
    short = index.drop("token", "first").join(long, "key", "left_anti").repartition("key")
    pairs = _passing(short.join(_other(short), (F.col("key") == F.col("key_a")) & (F.col("node_a") < F.col("node"))))
    rows = written_table(index.drop("token").join(long, "key", "left_semi"), "line-index")
    heads = rows.groupBy("key").agg(F.min(F.struct("first", "node", "n", "pos", "odd", "odd2")).alias("head"))
    heads = _other(heads.select("key", "head.*"))
    headed = _passing(rows.join(heads, (F.col("key") == F.col("key_a")) & (F.col("node_a") != F.col("node"))))
    return pairs.unionByName(headed), rows


def _ends(pairs: DataFrame) -> DataFrame:
    """(node) of the classes in pairs."""
    return pairs.select(F.col("b").alias("node")).unionByName(pairs.select(F.col("a").alias("node"))).distinct()


def _sets(ends: DataFrame, classes: DataFrame, docs: DataFrame, rarity: Column) -> DataFrame:
    """(node, keys, first) of the classes ``ends``.

    The sets are made again from the first lines of these classes; a bit table of
    fixed size picks documents, and lines in them, before words are cut.
    """
    wanted = classes.join(ends, "node", "left_semi").select("node", F.col("h1").alias("w1"), F.col("h2").alias("w2"), "first")

    def place(doc: Column, line: Column) -> Column:
        return F.pmod(F.xxhash64(doc.cast("string"), line), F.lit(64 * FILTER_WORDS))

    whole = F.lit(-1)  # in place of a line: the document has wanted ones
    at = wanted.select(F.explode(F.array(*[place(F.col("first.doc"), line) for line in (F.col("first.line"), whole)])).alias("at"))
    words = at.select(F.shiftrightunsigned("at", 6).alias("word"), (F.col("at") % 64).cast("int").alias("bit")).groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    )
    rows = words.toArrow()  # at most FILTER_WORDS
    table = np.zeros(FILTER_WORDS, np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    bits = _literal(table.tolist())

    def known(given: DataFrame, line: Column) -> DataFrame:
        p = place(F.col("doc_id"), line)
        marked = given.withColumn("bit", (p % 64).cast("int")).withColumn("known", bits[F.shiftrightunsigned(p, 6)])
        return marked.filter("shiftrightunsigned(known, bit) & 1L = 1L").select(*given.columns)

    picked = known(_lines(known(docs, whole)), F.col("line"))
    made = _keyed(picked, rarity).select("h1", "h2", "keys", _first().alias("at"))
    # equal rows have equal sets; the grouping's partitioning serves the join too
    one = made.groupBy("h1", "h2", "at").agg(F.first("keys").alias("keys"))
    sets = one.join(wanted, (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")) & (F.col("at") == F.col("first")))
    return written_table(sets.select("node", "keys", "first"), "line-sets")


def _matched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Numbers ``b`` of the later class of each verified pair among ``pairs``."""
    common = F.size(F.array_intersect("keys_a", "keys_b"))
    verified = pairs.join(sets.toDF("b", "keys_b", "first_b"), "b").join(sets.toDF("a", "keys_a", "first_a"), "a").withColumn("common", common)
    verified = verified.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * PERCENT)
    later = verified.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
    return written_table(later, "line-matched")


def repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line) of the lines to remove, lines numbered from 0.

    The first line of all that are alike stays, and so do lines without words.
    Rows that repeat a document id and line number with equal words are one line
    and share its decision. Null and empty texts have no lines to remove. Other
    columns are not read.
    """
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rarity = _rarity(given)
    n = F.size("keys")
    prefix = F.slice("keys", F.lit(1), (n - F.ceil(n * PERCENT / 100) + 1).cast("int"))
    keyed = _keyed(_lines(given), rarity).select("doc_id", "line", "h1", "h2", n.alias("n"), prefix.alias("prefix"), *_parities(F.col("keys")))
    lines = written_table(keyed, "line-keys").filter("n > 0")
    alike = [F.first(c).alias(c) for c in ("n", "prefix", "odd", "odd2")]
    classes = lines.groupBy("h1", "h2").agg(F.min(_first()).alias("first"), F.count("*").alias("rows"), *alike)
    classes = written_table(classes.withColumn("node", F.monotonically_increasing_id()), "line-classes")
    pairs, rows = _met(classes)
    pairs = written_table(pairs, "line-pairs")
    ends, more = _ends(pairs), rows.select("node").distinct()
    # sets of long lists are made in the same scan unless they are the larger part
    together = more.count() <= ends.count()
    sets = _sets(ends.unionByName(more).distinct() if together else ends, classes, given, rarity)
    gone = _matched(pairs, sets)
    still = rows.join(gone.select(F.col("b").alias("node")), "node", "left_anti").select(*rows.columns)
    rest = _passing(still.join(_other(rows), (F.col("key") == F.col("key_a")) & (F.col("first_a") < F.col("first"))))
    rest = written_table(rest.join(pairs, ["b", "nb", "a", "na"], "left_anti"), "line-pairs-rest")
    if not rest.isEmpty():  # its later classes are others than before
        gone = gone.unionByName(_matched(rest, sets if together else _sets(_ends(rest), classes, given, rarity)))
    # of a class without a match the first line stays, of one with a match none
    fate = classes.join(gone.select(F.col("b").alias("node"), F.lit(True).alias("matched")), "node", "left")
    fate = fate.filter((F.col("rows") > 1) | F.col("matched").isNotNull()).select("h1", "h2", "first", "matched")
    fate = written_table(fate, "line-fate")
    decided = lines.select("doc_id", "line", "h1", "h2", _first().alias("at")).join(fate, ["h1", "h2"])
    return decided.filter(F.col("matched").isNotNull() | (F.col("at") != F.col("first"))).select("doc_id", "line").distinct()


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without repeated lines, with n_lines and n_removed (names taken
    by columns of ``docs`` are an error). A document whose lines all go keeps an
    empty text; a null text stays null with 0 lines."""
    if {"n_lines", "n_removed"} & set(docs.columns):
        raise ValueError("docs has a column named n_lines or n_removed")
    lists = repeated_lines(docs, doc_id=doc_id, text=text).groupBy(F.col("doc_id").alias("of_doc")).agg(F.collect_list("line").alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    joined = rows.join(lists, F.col(f"doc.`{doc_id}`").eqNullSafe(F.col("of_doc")), "left")
    body = F.col(f"doc.`{text}`")
    lines = F.split(body, "\n")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("body"))), lambda s: ~F.array_contains(gone, s.i))
    left = F.when(F.size(gone) > 0, F.array_join(F.transform(kept, lambda s: s.body), "\n")).otherwise(body)
    return joined.select(
        *[left.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns],
        F.when(body.isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.size(gone).cast("bigint").alias("n_removed"),
    )
