"""Merkle manifest of a dataset, stored as subtrees in van Emde Boas order.

Leaves are hashes of whole rows, ordered inside their source. A tree of fan-out 16
is built one aligned subtree at a time: a block of 16^3 leaves and all nodes above
them is one row, its digests laid out by splitting the subtree at half its height,
the top part first and then every bottom part, each laid out alike. A node's place
follows from its depth and index alone (``address``), in construction and when the
siblings of a leaf are read. The roots of blocks are the leaves of the next round,
until a source is one block; the sources' roots form a tree of the same kind.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpanel.functions.session import written_table

FAN_OUT = 16
LEVELS = 3  # levels of hashing in one block
BLOCK = FAN_OUT**LEVELS
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_SCHEMA = "tree string, total bigint, block bigint, n bigint, root binary, layout binary"
ABOVE = "array<struct<pos: int, siblings: binary>>"


def nodes_in(height: int) -> int:
    """Nodes of a whole subtree of ``height`` rows of nodes."""
    return (FAN_OUT**height - 1) // (FAN_OUT - 1)


def address(depth: int, index: np.ndarray, height: int) -> np.ndarray:
    """Places of nodes in a subtree of ``height`` rows: depth 0 is its root."""
    if height == 1:
        return np.zeros_like(index)
    top = height // 2
    if depth < top:
        return address(depth, index, top)
    width = FAN_OUT ** (depth - top)
    inside = address(depth - top, index % width, height - top)
    return nodes_in(top) + index // width * nodes_in(height - top) + inside


def levels_of(total: int) -> int:
    """Levels of hashing in a block of a tree with ``total`` leaves: all of them if
    there are more blocks, else as many as leave one node."""
    levels = 0
    while levels < LEVELS and FAN_OUT**levels < total:
        levels += 1
    return levels


def layout(digests: np.ndarray, levels: int) -> np.ndarray:
    """All nodes over ``digests`` (n x 32 bytes), up to the last place in use."""
    height = levels + 1
    rows = [digests]
    for _ in range(levels):
        below = rows[-1]
        packed = [hashlib.sha256(below[i : i + FAN_OUT].tobytes().hex().encode()).digest() for i in range(0, len(below), FAN_OUT)]
        rows.append(np.frombuffer(b"".join(packed), np.uint8).reshape(-1, DIGEST))
    places = [address(levels - k, np.arange(len(row)), height) for k, row in enumerate(rows)]
    out = np.zeros((max(int(p.max()) for p in places) + 1, DIGEST), np.uint8)
    for place, row in zip(places, rows, strict=True):
        out[place] = row
    return out


def runs(stored: np.ndarray, n: int, levels: int) -> list[list[bytes]]:
    """Hex text of every run of siblings, by level from the leaves up."""
    out, count = [], n
    for k in range(levels):
        own = stored[address(levels - k, np.arange(count), levels + 1)].tobytes().hex().encode()
        step = 2 * DIGEST * FAN_OUT
        out.append([own[i : i + step] for i in range(0, len(own), step)])
        count = -(-count // FAN_OUT)
    return out


def siblings(levels: list[list[bytes]], slot: int) -> list[tuple[int, bytes]]:
    """(place in the run, hex text of the others) of a leaf, from its level up."""
    out = []
    for level in levels:
        run, pos = level[slot // FAN_OUT], slot % FAN_OUT
        out.append((pos, run[: 64 * pos] + run[64 * (pos + 1) :]))
        slot //= FAN_OUT
    return out


def fold(leaf: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """Root (hex text) that a leaf (hex text) and its siblings give."""
    for pos, others in path:
        leaf = hashlib.sha256(others[: 64 * pos] + leaf + others[64 * pos :]).hexdigest().encode()
    return leaf


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def row_hash(docs: DataFrame, fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None) -> Column:
    """SHA-256 (binary) of the fields, each with its length; ``changed`` replaces some."""
    changed = changed or {}
    parts = [_field(changed.get(c, F.col(f"`{c}`"))) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rank`` inside each ``tree`` by ``order``, and ``total`` rows of the tree.

    A range sort deals rows of one tree to many tasks; ranks are the place inside a
    task's run plus the runs before it, so no task sees a whole tree.
    """
    place = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    stored = written_table(place.withColumns({"place": F.monotonically_increasing_id()}), "merkle-leaves")
    stored = stored.withColumn("part", F.shiftright("place", 33))
    per_run = stored.groupBy(tree, "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(tree)
    per_run = per_run.select(
        F.col(tree).alias("of_tree"),
        F.col("part").alias("of_part"),
        "first",
        (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(whole).alias("total"),
    )
    per_run = written_table(per_run, "merkle-runs")
    met = (F.col(tree) == F.col("of_tree")) & (F.col("part") == F.col("of_part"))
    return (
        stored.join(per_run, met)
        .withColumn("rank", F.col("place") - F.col("first") + F.col("before"))
        .drop("of_tree", "of_part", "first", "before", "place", "part")
    )


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    tree, block = key[0].as_py(), key[1].as_py()
    table = table.sort_by("rank")
    total = table.column("total")[0].as_py()
    digests = np.frombuffer(b"".join(x.as_py() for x in table.column("digest")), np.uint8).reshape(-1, DIGEST)
    stored = layout(digests, levels_of(total))
    # the root of a subtree lies at its first place
    row = [tree, total, block, len(digests), stored[0].tobytes(), stored.tobytes()]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["tree", "total", "block", "n", "root", "layout"])


def build_rounds(nodes: DataFrame) -> list[DataFrame]:
    """Block tables of all trees in ``nodes`` (tree, total, rank, digest), by round.

    A task works on one block. The driver reads one number per round.
    """
    rounds = []
    while True:
        blocks = nodes.select("tree", "total", "rank", "digest", F.floor(F.col("rank") / BLOCK).alias("block"))
        rounds.append(written_table(blocks.groupBy("tree", "block").applyInArrow(_build, BLOCK_SCHEMA), "merkle-blocks"))
        split = rounds[-1].filter(F.col("total") > BLOCK)
        if split.limit(1).count() == 0:
            return rounds
        nodes = split.select("tree", F.ceil(F.col("total") / BLOCK).alias("total"), F.col("block").alias("rank"), F.col("root").alias("digest"))


@dataclass
class Manifest:
    """A dataset's Merkle tree: leaves in order and block tables by round."""

    leaves: DataFrame  # tree, total, rank, digest and the columns kept
    rounds: list[DataFrame]
    subroots: DataFrame  # tree, total (number of sources), rank (of the source), digest
    top: list[DataFrame]

    def paths(self) -> DataFrame:
        """(tree, block, n, total, layout, subroot, root, above) per block of leaves:
        ``above`` are the siblings of the block's root, up to the root of all."""
        whole = self.top[-1].select("tree", "block", F.expr(f"CAST(array() AS {ABOVE})").alias("above"), F.col("root").alias("top_root"))
        for blocks in reversed(self.top):
            whole = _paths_below(blocks, whole, ["top_root"])
        sources = self.subroots.select(F.col("tree").alias("t"), F.col("rank").alias("r"), F.col("source_tree"), F.col("digest").alias("subroot"))
        met = (F.col("tree") == F.col("t")) & (F.col("block") == F.col("r"))
        heads = whole.join(sources, met).select(F.col("source_tree").alias("tree"), "above", "subroot", "top_root")
        below = None
        for blocks in reversed(self.rounds):
            # a source's single block takes the path of its source, others that of the round above
            own = blocks.filter(F.col("total") <= BLOCK).join(heads, "tree").select("tree", "block", "above", "subroot", "top_root")
            own = own if below is None else own.unionByName(below)
            if blocks is self.rounds[0]:
                return blocks.join(own, ["tree", "block"]).select("tree", "block", "n", "total", "layout", "subroot", "top_root", "above")
            below = _paths_below(blocks, own, ["subroot", "top_root"])
        raise AssertionError("a manifest has a round")


def _paths_below(blocks: DataFrame, paths: DataFrame, kept: list[str]) -> DataFrame:
    """Paths of the children of ``blocks``: (tree, block of the round below, above, kept)."""
    rows = blocks.select("tree", "block", "n", "total", "layout").join(paths, ["tree", "block"])
    fields = ["tree", "block", "above", *kept]

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                levels = levels_of(row["total"])
                hexed = runs(np.frombuffer(row["layout"], np.uint8).reshape(-1, DIGEST), row["n"], levels)
                above = [(x["pos"], x["siblings"]) for x in row["above"]]
                out = [
                    {"tree": row["tree"], "block": row["block"] * BLOCK + slot, "above": [{"pos": p, "siblings": s} for p, s in siblings(hexed, slot) + above]}
                    | {k: row[k] for k in kept}
                    for slot in range(row["n"])
                ]
                for i in range(0, len(out), 256):
                    yield pa.RecordBatch.from_pylist(out[i : i + 256], schema=schema)

    schema = pa.schema(
        [("tree", pa.string()), ("block", pa.int64()), ("above", pa.list_(pa.struct([("pos", pa.int32()), ("siblings", pa.binary())])))]
        + [(k, pa.binary()) for k in kept]
    )
    spec = ", ".join([f"tree string, block bigint, above {ABOVE}"] + [f"{k} binary" for k in kept])
    return rows.mapInArrow(spread, spec).select(*fields)


def build_manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source", kept: dict[str, Column] | None = None) -> Manifest:
    """Hash every row, and build the trees of all sources and the tree over them.

    Leaves of a source ascend by ``doc_id`` (nulls first, equal ids by hash, equal
    rows in any order, which gives equal results); sources ascend bytewise, a null
    source first. Null fields are hashed as such, empty ones as empty. An empty table
    has no leaves and no root. Columns besides ``fields`` are not read; ``kept`` adds
    columns computed from the input. No text is shuffled.
    """
    tree = F.when(F.col(f"`{source}`").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(f"`{source}`")))
    rows = docs.select(tree.alias("tree"), F.col(f"`{doc_id}`").alias("id"), row_hash(docs, fields).alias("digest"), *[c.alias(k) for k, c in (kept or {}).items()])
    leaves = numbered(rows, "tree", "id", "digest")
    rounds = build_rounds(leaves)
    roots = None
    for blocks in rounds:
        ended = blocks.filter(F.col("total") <= BLOCK).select(F.col("tree").alias("source_tree"), F.col("root").alias("digest"))
        roots = ended if roots is None else roots.unionByName(ended)
    subroots = numbered(roots.select(F.lit("").alias("tree"), "source_tree", "digest"), "tree", "source_tree")
    return Manifest(leaves, rounds, subroots, build_rounds(subroots))


def verify(manifest: Manifest, claimed: str = "claimed") -> DataFrame:
    """Per leaf: id, leaf, subroot, root, proof_sha256, folded_root, verified (hex).

    ``claimed`` names a kept column with the leaf hash to be proved (null: the leaf as
    built). Each is folded with the siblings of its place up to the root of all. A
    group is one block of at most 4,096 leaves with the path above it.
    """
    id_type = manifest.leaves.schema["id"].dataType.simpleString()
    rows = manifest.leaves.select("tree", F.floor(F.col("rank") / BLOCK).alias("block"), "rank", "id", "digest", F.col(claimed).alias("claimed"))
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([left.column("id"), *[pa.array([], pa.string())] * 5, pa.array([], pa.bool_())], names=names)
        path = {k: right.column(k)[0].as_py() for k in ("n", "total", "layout", "subroot", "top_root", "above")}
        hexed = runs(np.frombuffer(path["layout"], np.uint8).reshape(-1, DIGEST), path["n"], levels_of(path["total"]))
        above = [(x["pos"], x["siblings"]) for x in path["above"]]
        after = b"".join(s for _, s in above)
        root = path["top_root"].hex()
        out = []
        for rank, digest, given in zip(*(left.column(c).to_pylist() for c in ("rank", "digest", "claimed")), strict=True):
            own = siblings(hexed, rank % BLOCK)
            proof = hashlib.sha256(b"".join(s for _, s in own) + after).hexdigest()
            folded = fold((digest if given is None else given).hex().encode(), own + above).decode()
            out.append((digest.hex(), path["subroot"].hex(), root, proof, folded, folded == root))
        columns = [pa.array(list(x)) for x in zip(*out, strict=True)]
        return pa.Table.from_arrays([left.column("id"), *columns], names=names)

    spec = f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.groupBy("tree", "block").cogroup(manifest.paths().groupBy("tree", "block")).applyInArrow(prove, spec)


def tampered(docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", text: str = "text") -> Column:
    """Leaf hash after A-Z of the text are lower-cased where 5 divides the CRC-32 of
    the decimal id (null elsewhere, and for a null id)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.col(f"`{text}`"), upper, upper.lower())
    chosen = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, row_hash(docs, fields, {text: lowered}))
