"""Benchmark decontamination by pigeonhole pieces and bit-parallel distance.

An item of m normalised characters may occur with up to k = floor(m * share)
edits. Cut into k + 1 pieces, at least one piece of such an occurrence is
unchanged, so exact piece hits find every candidate. The same argument holds for
every node of a binary tree over the pieces (j pieces, at most j - 1 edits), so
a hit is verified upwards, from a pair of pieces to the whole item, by Myers'
bit-parallel distance; chance hits end at the first step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from counterpanel.llm.memory import handing_back

BLOCK_CHARS = 4 << 20  # benchmark characters matched in one pass over the documents


def normalised(text: Column) -> Column:
    """Lower case, letters and digits only, one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bit_rows(item: str) -> dict[str, int]:
    """For each character, the set of its places in ``item`` as bits."""
    rows: dict[str, int] = {}
    for i, ch in enumerate(item):
        rows[ch] = rows.get(ch, 0) | (1 << i)
    return rows


def occurrence(item: str, text: str, most: int, peq: dict[str, int] | None = None) -> tuple[int, int]:
    """(distance, end) of the best occurrence of ``item`` in ``text``.

    The first end among equals; distance most + 1 and end -1 if none is within
    ``most`` edits. Myers (1999) in Hyyro's form, on integers of any width.
    """
    m = len(item)
    peq = bit_rows(item) if peq is None else peq
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, dist = full, 0, m
    best, end = most + 1, -1
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            dist += 1
        elif mh & top:
            dist -= 1
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | ~(xv | ph) & full
        mv = ph & xv
        if dist < best:
            best, end = dist, j + 1
    return best, end


class ItemIndex:
    """Pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], share: float) -> None:
        import ahocorasick

        self.items = [(item_id, text, int(len(text) * share)) for item_id, text in items if text]
        self.rows: dict[tuple[int, int, int], dict[str, int]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k) in enumerate(self.items):
            for p in range(k + 1):
                pieces.setdefault(text[self._cut(i, p) : self._cut(i, p + 1)], []).append((i, p))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def _cut(self, i: int, piece: int) -> int:
        _, text, k = self.items[i]
        return piece * len(text) // (k + 1)

    def _climb(self, i: int, piece: int, start: int, text: str) -> tuple[int, int] | None:
        """(distance, end) of item ``i`` around a hit of one of its pieces that
        puts the item's start at ``start``; None if some node has too many edits."""
        _, item, k = self.items[i]
        lo, hi, nodes = 0, k + 1, []
        while hi - lo > 1:
            nodes.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
        found = (0, start + len(item))
        for lo, hi in reversed(nodes):
            a, b, most = self._cut(i, lo), self._cut(i, hi), hi - lo - 1
            if (i, a, b) not in self.rows:
                self.rows[i, a, b] = bit_rows(item[a:b])
            left = max(0, start + a - most)
            distance, end = occurrence(item[a:b], text[left : start + b + most], most, self.rows[i, a, b])
            if distance > most:
                return None
            found = (distance, left + end)
        return found

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(place in the list of items, distance, end in the normalised text) of items found."""
        if not self.items:
            return []
        best: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for end, (size, places) in self.automaton.iter(text):
            for i, piece in places:
                start = end + 1 - size - self._cut(i, piece)
                if best.get(i, (1, 0))[0] == 0 or (i, piece, start) in tried:
                    continue
                tried.add((i, piece, start))
                found = self._climb(i, piece, start, text)
                if found is not None and (i not in best or found < best[i]):
                    best[i] = found
        return [(i, *found) for i, found in best.items()]


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    share: float = 0.08,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, distance, item_chars): items found in whole texts.

    Both sides are compared in lower case, letters and digits only, white space
    and punctuation as one space. An item is found if some stretch of the
    document is within floor(share * length) edits; short items (below 1/share
    characters) are found exactly only, empty or null ones never. Null and empty
    texts hold nothing. Items are matched in blocks of bounded size, each block
    against all rows; documents are not shuffled. Repeated rows give repeated
    results, an empty side gives none. Items that share an id, or have none, are
    found on their own, each with its own length; ids are of any atomic type.
    """
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), normalised(F.col(f"`{text}`")).alias("body"))
    given = given.filter("body <> ''")
    kind = given.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, item_chars int"
    names = ["doc_id", "item_id", "distance", "item_chars"]
    found = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, item_id, item_text, block_chars):

        def match(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(block, share)
            for batch in batches:
                rows = [(at, *hit) for at, body in enumerate(batch.column(1)) for hit in index.hits(body.as_py())]
                if rows:
                    at, items, distances, _ = zip(*rows, strict=True)
                    ids = pa.array([block[i][0] for i in items], item_type)
                    chars = [len(block[i][1]) for i in items]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), ids, pa.array(distances, pa.int32()), pa.array(chars, pa.int32())],
                        names=names,
                    )

        found = found.unionByName(given.mapInArrow(handing_back(match), schema))
    return found


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator[list[tuple]]:
    """(id, normalised text) of the items that have any, in blocks of bounded size."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("i"), normalised(F.col(f"`{item_text}`")).alias("t")).filter("t <> ''")
    block, held = [], 0
    for row in items.toLocalIterator():
        block.append((row["i"], row["t"]))
        held += len(row["t"])
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    share: float = 0.08,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents that hold no item, in the columns of ``docs``.

    The same search as ``find_items``, as a filter: nothing is shuffled, and
    each block of items is one pass over what the blocks before have left.
    """
    width = len(docs.columns)
    kept = docs
    for block in item_blocks(benchmark, item_id, item_text, block_chars):
        body = F.coalesce(normalised(F.col(f"`{text}`")), F.lit("")).alias("__body")

        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(block, share)
            for batch in batches:
                clean = pa.array([not index.hits(t.as_py()) for t in batch.column(width)], pa.bool_())
                yield batch.select(range(width)).filter(clean)

        kept = kept.select(*[F.col(f"`{c}`") for c in docs.columns], body).mapInArrow(handing_back(keep), docs.schema)
    return kept


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that hold an item: doc_id, items, min_distance."""
    return find_items(docs, benchmark, **options).groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("items"), F.min("distance").alias("min_distance")
    )
