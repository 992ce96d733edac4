"""Near-duplicate vectors by an inverted multi-index.

Normalised vectors are cut in two halves, each half has its own codebook, and
pairs of codewords form a grid of cells. A vector lives in its nearest cell and,
as a query, visits cells in order of the sum of the two half distances (the
multi-sequence order); the number of visits is the smallest that reaches the
target recall for query vectors that are compared with all vectors. Queries are
added until enough of them have a link. If MAX_VISITS do not reach the target, or
links are too few to tell, all vectors become queries and the search is exact.
Candidates are verified by cosine in double precision. Equal vectors are one node
with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpanel.functions.session import written_table
from counterpanel.llm.components import connected_components

SAMPLE = 16384  # vectors that the codebooks are fitted on, at most
CELL_ROWS = 16  # vectors per cell that the grid is sized for
MAX_WORDS = 1024  # codewords per half
MAX_VISITS = 64
TARGET_RECALL = 0.99
BLOCK_ROWS = 2048  # side of a block of comparisons; larger cells are split into several
QUERY_VALUES = 1 << 18  # vector components of the first block of queries
MAX_QUERY_VALUES = 1 << 22  # of the later ones, which double
LINKED = 200  # queries with a link that the number of visits is fitted on, at least
HASHES = 1 << 40  # places of nodes in the order of queries


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _half_distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None, :]


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means by Lloyd's rounds; empty codewords restart at random points."""
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(10):
        near = _half_distances(x, words).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.choice(len(x), k)])
    return words


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of the halves and the number of cells a query visits."""

    left: np.ndarray
    right: np.ndarray
    visits: int

    def cells(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The nearest cells of each row, nearest first.

        Multi-sequence order: the i-th and j-th nearest codewords can be among
        the first T cells only if (i + 1)(j + 1) <= T, so those sums are ranked.
        """
        n_words = len(self.left)
        take = min(visits or self.visits, n_words * n_words)
        reach = min(take, n_words)
        ranks = [(i, j) for i in range(reach) for j in range(reach) if (i + 1) * (j + 1) <= take]
        i, j = np.array(ranks).T
        half = x.shape[1] // 2
        order, dist = [], []
        for part, words in ((x[:, :half], self.left), (x[:, half:], self.right)):
            d = _half_distances(part, words)
            near = np.argsort(d, axis=1, kind="stable")[:, :reach]
            order.append(near)
            dist.append(np.take_along_axis(d, near, 1))
        total = dist[0][:, i] + dist[1][:, j]
        best = np.argsort(total, axis=1, kind="stable")[:, :take]
        return np.take_along_axis(order[0][:, i] * n_words + order[1][:, j], best, 1).astype(np.int64)


def fit_codebooks(sample: np.ndarray, n_vectors: int, seed: int = 7) -> MultiIndex:
    """Codebooks from a sample; ``n_vectors`` sizes the grid. One visit only."""
    rng = np.random.default_rng(seed)
    k = int(np.clip(round((n_vectors / CELL_ROWS) ** 0.5), 1, min(MAX_WORDS, max(1, len(sample)))))
    half = sample.shape[1] // 2
    return MultiIndex(_codebook(sample[:, :half], k, rng), _codebook(sample[:, half:], k, rng), 1)


def visits_needed(tally: np.ndarray) -> int | None:
    """The fewest visits that reach the target recall; None if none of them do.

    ``tally`` has a row per query with a link, and as columns its links by the
    visit that meets them first, those that no visit meets last. The target
    holds for all links together and for the mean of the queries' own recalls,
    so that neither large nor small groups decide alone.
    """
    met = np.cumsum(tally[:, :-1], axis=1)
    total = tally.sum(1)
    reached = (met.sum(0) >= TARGET_RECALL * total.sum()) & ((met / total[:, None]).mean(0) >= TARGET_RECALL)
    return max(4, int(np.flatnonzero(reached)[0]) + 1) if reached.any() else None


def _links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    i, j = [], []
    for lo in range(0, len(a), 512):
        x, y = np.nonzero(a[lo : lo + 512] @ b.T >= threshold)
        i.append(x + lo)
        j.append(y)
    return np.concatenate(i), np.concatenate(j)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: (node, root) of a small block."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    nodes = [x for x in parent if root(x) != x]
    return np.array(nodes, np.int64), np.array([root(x) for x in nodes], np.int64)


def near_duplicates(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different lengths are not compared. Rows with
    equal vectors are linked to each other. An id that occurs in several rows
    names them all; n_links counts rows. Other columns are not read. Cells and
    copies are never capped: large cells are compared block by block. Links are
    found with a recall of TARGET_RECALL, measured on queries against all vectors,
    or all of them, by comparing all pairs, where that cannot be shown.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{embedding}`").cast("array<double>")
    usable = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    given = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("v"), F.coalesce(usable, F.lit(False)).alias("usable"))
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))  # -0.0 is 0.0
    given = given.withColumn("key", F.when(F.col("usable"), F.md5(F.array_join(F.transform(plain, lambda x: x.cast("string")), ",").cast("binary"))))
    # one node per distinct vector
    nodes = given.filter("usable").groupBy("key").agg(
        F.count("*").alias("rows"), F.min("vec_id").alias("first_id"), F.min("v").alias("v")
    )
    nodes = written_table(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = [(r["d"], r["n"]) for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()]
    counts, edges = [], []
    for dim, n in sizes:
        found = _linked(nodes.filter(F.size("v") == dim), n, threshold)
        counts.append(found.filter("kind = 0").select("node", "value"))
        edges.append(found.filter("kind = 1").select(F.col("node").alias("a"), F.col("value").alias("b")))
    none = spark.createDataFrame([], "node bigint, value bigint")
    count, edge = none, none.select(F.col("node").alias("a"), F.col("value").alias("b"))
    for c, e in zip(counts, edges, strict=True):
        count, edge = count.unionByName(c), edge.unionByName(e)
    links = count.groupBy("node").agg(F.sum("value").alias("others"))
    roots = connected_components(edge)
    described = nodes.select("key", "node", "rows", "first_id").join(links, "node", "left").join(roots, "node", "left")
    described = described.withColumn("root", F.coalesce("root", "node"))
    smallest = described.groupBy("root").agg(F.min("first_id").alias("component"))
    described = described.join(smallest, "root").select(
        "key", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component"
    )
    out = given.select("vec_id", "key").join(described, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _linked(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(kind, node, value): kind 0, rows linked to a node; kind 1, links that
    span the components of one block."""
    picked = nodes.select("v", "key").orderBy("key").limit(SAMPLE).select("v").collect()
    sample = unit(np.array([r["v"] for r in picked]))
    index = fit_codebooks(sample, n)
    dim = sample.shape[1]
    place = F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(HASHES))
    searched, tallies, lo, rows, fitting = [], [], 0, max(1, QUERY_VALUES // dim), True
    while lo < HASHES:
        hi = min(HASHES, lo + -(-HASHES * rows // n))
        queries = nodes.filter((place >= lo) & (place < hi)).select("node", "rows", "v").toArrow().combine_chunks()
        lo, rows = hi, min(2 * rows, max(1, MAX_QUERY_VALUES // dim))
        if not len(queries):
            continue
        searched.append(written_table(_searched(nodes, queries, index, threshold, fitting), "vector-search"))
        if fitting:
            tallies.append(_tally(searched[-1].filter("kind > 1")))
            tally = np.concatenate(tallies)
            if len(tally) >= LINKED:
                visits = visits_needed(tally)
                if visits is not None:
                    return _indexed(nodes, MultiIndex(index.left, index.right, visits), threshold)
                fitting = False
    # every vector was a query
    found = searched[0]
    for more in searched[1:]:
        found = found.unionByName(more)
    return found.filter("kind < 2")


def _tally(found: DataFrame) -> np.ndarray:
    """A row per query with links (a block's number at most), see ``visits_needed``."""
    counts = found.groupBy("node", "kind").agg(F.sum("value").alias("n")).toArrow()
    query, at = np.unique(counts["node"].to_numpy(), return_inverse=True)
    tally = np.zeros((len(query), MAX_VISITS + 1), np.int64)
    tally[at, counts["kind"].to_numpy() - 2] = counts["n"].to_numpy()
    return tally


def _searched(nodes: DataFrame, queries: pa.Table, index: MultiIndex, threshold: float, fitting: bool) -> DataFrame:
    """The queries compared with all nodes: (kind, node, value).

    Kinds 0 and 1 as in ``_linked``, for pairs whose smaller node is the query.
    If ``fitting``, kind 2 + r has a query's links that r visits do not meet and
    r + 1 do; r is MAX_VISITS for those that none do.
    """
    qn, qr = queries["node"].to_numpy(), queries["rows"].to_numpy()
    qx = unit(_matrix(queries["v"].combine_chunks()))
    home = np.concatenate([index.cells(qx[k : k + 512], 1)[:, 0] for k in range(0, len(qx), 512)])

    def met_at(i: np.ndarray, x: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Visit that meets query ``i`` and a vector first, from either end."""
        own = index.cells(qx[np.unique(i)], MAX_VISITS)[np.unique(i, return_inverse=True)[1]]
        out = np.full(len(i), MAX_VISITS, np.int64)
        for hit in (own == order[x, 0][:, None], order[x] == home[i][:, None]):
            out = np.minimum(out, np.where(hit.any(1), hit.argmax(1), MAX_VISITS))
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                mn, mr, mx = part.column(0).to_numpy(), part.column(1).to_numpy(), unit(_matrix(part.column(2)))
                kind, node, value = [], [], []
                for at in range(0, len(qx), BLOCK_ROWS):
                    i, j = _links(qx[at : at + BLOCK_ROWS], mx, threshold)
                    i += at
                    i, j = i[qn[i] != mn[j]], j[qn[i] != mn[j]]
                    if fitting and len(i):
                        linked, x = np.unique(j, return_inverse=True)
                        order = index.cells(mx[linked], MAX_VISITS)
                        for lo in range(0, len(i), 65536):
                            own = i[lo : lo + 65536]
                            rank = met_at(own, x[lo : lo + 65536], order)
                            code, n = np.unique(own * (MAX_VISITS + 1) + rank, return_counts=True)
                            kind.append(code % (MAX_VISITS + 1) + 2)
                            node.append(qn[code // (MAX_VISITS + 1)])
                            value.append(n)
                    once = qn[i] < mn[j]
                    i, j = i[once], j[once]
                    for ids, add in ((qn[i], mr[j]), (mn[j], qr[i])):
                        got, where = np.unique(ids, return_inverse=True)
                        kind.append(np.zeros(len(got), np.int64))
                        node.append(got)
                        value.append(np.bincount(where, weights=add, minlength=len(got)).astype(np.int64))
                    a, b = _forest(qn[i], mn[j])
                    kind.append(np.ones(len(a), np.int64))
                    node.append(a)
                    value.append(b)
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (kind, node, value)]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "node", "value"])

    return nodes.select("node", "rows", "v").mapInArrow(search, "kind bigint, node bigint, value bigint")


def _indexed(nodes: DataFrame, index: MultiIndex, threshold: float) -> DataFrame:
    """As ``_linked``, from the cells that each node visits."""
    n_words = len(index.left)

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(n_words * n_words, np.int64)
        met = np.zeros_like(own)
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(unit(_matrix(batch.column(0))))
                own += np.bincount(cells[:, 0], minlength=len(own))
                met += np.bincount(cells.ravel(), minlength=len(own))
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at]), pa.array(met[at])], names=["cell", "own", "met"])

    # at most n_words ** 2 rows come back, however many vectors there are
    tally = nodes.select("v").mapInArrow(count_cells, "cell bigint, own bigint, met bigint")
    tally = tally.groupBy("cell").agg(F.sum("own").alias("own"), F.sum("met").alias("met")).collect()
    splits = np.ones((2, n_words * n_words), np.int64)
    for r in tally:
        splits[:, r["cell"]] = -(-max(1, r["own"]) // BLOCK_ROWS), -(-max(1, r["met"]) // BLOCK_ROWS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members and visitors of every block (cell, member part, visitor part)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            cells = index.cells(unit(_matrix(batch.column(2))))
            rows, block, member = [], [], []
            for cell_rank in range(cells.shape[1]):
                cell = cells[:, cell_rank]
                parts, calls = splits[0, cell], splits[1, cell]
                roles = ((True, calls, node % parts), (False, parts, node % calls)) if cell_rank == 0 else ((False, parts, node % calls),)
                for is_member, copies, mine in roles:
                    at = np.repeat(np.arange(len(node)), copies)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                    part, call = (mine[at], other) if is_member else (other, mine[at])
                    rows.append(at)
                    block.append(np.column_stack([cell[at], part, call]))
                    member.append(np.full(len(at), is_member))
            at, block = np.concatenate(rows), np.concatenate(block)
            picks = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[:, 0]), pa.array(block[:, 1]), pa.array(block[:, 2]),
                    pa.array(np.concatenate(member)), batch.column(0).take(picks), batch.column(1).take(picks),
                    batch.column(2).take(picks),
                    pa.array(list(cells[at]), pa.list_(pa.int64())),
                ],
                names=["cell", "part", "call", "member", "node", "rows", "v", "cells"],
            )

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        inside = table.filter(table["member"])
        calling = table.filter(pa.compute.invert(table["member"]))
        kind, node, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(inside) and len(calling):
            side = []
            for t in (calling, inside):
                side.append((
                    t["node"].to_numpy(), t["rows"].to_numpy(),
                    unit(_matrix(t["v"].combine_chunks())), _matrix(t["cells"].combine_chunks()),
                ))
            (qn, qr, qx, qc), (mn, mr, mx, mc) = side
            i, j = _links(qx, mx, threshold)
            # a pair met from both ends is counted where the smaller node calls
            mutual = (mc[j] == qc[i, 0][:, None]).any(1)
            once = (qn[i] < mn[j]) | (~mutual & (qn[i] != mn[j]))
            i, j = i[once], j[once]
            for ids, add in ((qn[i], mr[j]), (mn[j], qr[i])):
                got, at = np.unique(ids, return_inverse=True)
                kind.append(np.zeros(len(got), np.int64))
                node.append(got)
                value.append(np.bincount(at, weights=add, minlength=len(got)).astype(np.int64))
            a, b = _forest(qn[i], mn[j])
            kind.append(np.ones(len(a), np.int64))
            node.append(a)
            value.append(b)
        return pa.table([np.concatenate(x) for x in (kind, node, value)], names=["kind", "node", "value"])

    dealt = nodes.select("node", "rows", "v").mapInArrow(
        deal, "cell bigint, part bigint, call bigint, member boolean, node bigint, rows bigint, v array<double>, cells array<bigint>"
    )
    found = dealt.groupBy("cell", "part", "call").applyInArrow(compare, "kind bigint, node bigint, value bigint")
    return written_table(found, "vector-links")
