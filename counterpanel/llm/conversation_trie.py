"""Prefix trie of conversations: union-find over the LCPs of sorted neighbours.

A conversation is a sequence of turn digests. Distinct sequences are sorted, and each
shares with its neighbour a prefix whose length is an edge of a forest. Blocks of the
order build their forest alone: edges are taken in descending depth, and every merge
of two components makes a branching node (or adds a child to one of the same depth).
Nodes that no neighbouring block shares are final. What is left of a block's forest is
its contracted rim, the nodes on its first or last path that reach beyond it; equal rim
nodes of several blocks are merged by their prefix. All figures of a node are sums (or
the least id) over the members, each distinct node being counted by its first member,
so a rim node's figures are the sums of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterpanel.functions.session import written_table

WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 16
BLOCK_ROWS = 256  # sequences whose forest is built at once
CHUNK_CHARS = 1 << 14  # decimal ids of one row, where a list of ids spans tasks
NODE_FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
PART_SCHEMA = "rim binary, parent_rim binary, " + ", ".join(f"{f} bigint" for f in NODE_FIELDS) + ", ends_sha256 string"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def sequences(
    conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, t): per conversation its turns as (turn, digest, words), in order.

    Turns ascend by ``turn``, null first, equal ones by digest. A null role or text is
    empty. Rows without a conversation id belong to none and are left out. Digests and
    word counts travel, texts do not: 60 bytes a turn, and one row holds a conversation.
    """
    who, said = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary"))
    rows = conversations.filter(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.regexp_count(said, F.lit(WORD)).alias("words")).alias("x"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("t"))


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that share beginnings: each takes its first h turns from the one
    whose id is the next lower multiple of ``every`` (all if that has fewer, none if
    it is absent), then its own after its first h; h is the CRC-32 of its id mod
    ``heads``."""
    base = turns.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, heads - 1).alias("head"))
    own = turns.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    joined = own.join(base, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    first = F.when(F.col("head").isNull(), F.slice("t", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("t", F.col("h") + 1, F.size("t") + 1)
    return joined.select("conv_id", F.concat(first, rest).alias("t"))


def _classes(members: DataFrame) -> DataFrame:
    """(class, n, least, ends_sha256) from (class, conv_id), an id once: equal sequences.

    Ids are range-sorted by class, so a class of any size is dealt to many tasks; one
    that reaches the edge of a task comes as chunks of its id list, hashed one after
    the other in a second step. Neither step holds more than a chunk of a class.
    """
    ordered = members.repartitionByRange("class", "conv_id").sortWithinPartitions("class", "conv_id")
    names = ["class", "n", "least", "ends_sha256", "ids"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = "class binary, n bigint, least bigint, ends_sha256 string, ids string"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, ids, chars, edge = None, [], 0, True

        def close(final: bool) -> None:
            text = ",".join(map(str, ids))
            out.append((now, len(ids), ids[0], hashlib.sha256(text.encode()).hexdigest() if final else None, None if final else text))

        for batch in batches:
            for cls, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if cls != now:
                    if ids:
                        close(not edge)
                    edge, now, ids, chars = now is None, cls, [], 0
                elif chars > CHUNK_CHARS:
                    close(False)
                    edge, ids, chars = True, [], 0
                ids.append(conv)
                chars += len(str(conv)) + 1
            if len(out) > 1000:
                yield batch_of(out)
                out.clear()
        if ids:
            close(False)  # the next task may go on with it
        if out:
            yield batch_of(out)

    found = written_table(ordered.mapInArrow(runs, schema), "trie-classes")
    chunks = found.filter("ids IS NOT NULL").repartition("class").sortWithinPartitions("class", "least")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, least, sha = None, 0, None, None
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["class"] != now:
                    if now is not None:
                        out.append((now, total, least, sha.hexdigest(), None))
                    now, total, least, sha = row["class"], 0, row["least"], hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(row["ids"].encode())
                total += row["n"]
        if now is not None:
            out.append((now, total, least, sha.hexdigest(), None))
            yield batch_of(out)

    return found.filter("ids IS NULL").unionByName(chunks.mapInArrow(joined, schema)).drop("ids")


def _shared(a: bytes, b: bytes) -> int:
    """Turns at the beginning that two sequences share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // DIGEST


class _Forest:
    """Components of a block's sequences, merged by edges in descending depth."""

    def __init__(self, lengths: list[int]) -> None:
        m = len(lengths)
        self.depth, self.lo, self.hi = list(lengths), list(range(m)), list(range(1, m + 1))
        self.children: list[list[int]] = [[] for _ in range(m)]
        self.parent = list(range(m))  # union-find over sequences
        self.top = list(range(m))  # the top node of a component, at its representative

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def merge(self, left: int, right: int, depth: int) -> None:
        a, b = self.find(left), self.find(right)
        x, y = self.top[a], self.top[b]
        if self.depth[x] == depth:  # a node of this depth gains a child
            self.children[x].append(y)
            self.hi[x] = self.hi[y]
            node = x
        else:
            node = len(self.depth)
            self.depth.append(depth)
            self.lo.append(self.lo[x])
            self.hi.append(self.hi[y])
            self.children.append([x, y])
        # the longer side keeps its representative
        if self.hi[x] - self.lo[x] < self.hi[y] - self.lo[y]:
            a, b = b, a
        self.parent[b], self.top[a] = a, node


def _grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Nodes of one block: final ones, and parts of those that reach beyond it."""
    block = key[0].as_py()
    table = table.sort_by("rn")
    home = (table.column("rn").to_numpy() // BLOCK_ROWS) == block
    keys = table.column("key").to_pylist()
    own = np.flatnonzero(home)
    out: dict[str, list] = {k: [] for k in ["rim", "parent_rim", *NODE_FIELDS, "ends_sha256"]}
    if len(own):
        first, m = int(own[0]), len(own)
        before = keys[first - 1] if first > 0 else None
        after = keys[first + m] if first + m < len(keys) else None
        rows = table.slice(first, m)
        _nodes(keys[first : first + m], before, after, rows, out)
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * len(NODE_FIELDS), pa.string()]
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _nodes(keys: list[bytes], before: bytes | None, after: bytes | None, rows: pa.Table, out: dict[str, list]) -> None:
    m = len(keys)
    lengths = [len(k) // DIGEST for k in keys]
    lcp = [-1 if before is None else _shared(before, keys[0])]
    lcp += [_shared(keys[i - 1], keys[i]) for i in range(1, m)]
    lcp.append(-1 if after is None else _shared(keys[-1], after))

    forest = _Forest(lengths)
    for i in sorted(range(1, m), key=lambda i: -lcp[i]):
        forest.merge(i - 1, i, lcp[i])
    root = forest.top[forest.find(0)]

    counts, least, ends = (rows.column(c).to_pylist() for c in ("n", "least", "ends_sha256"))
    # words up to each depth, at depth + 1; depth -1 and the root have none
    words = [np.concatenate(([0, 0], np.cumsum(w.values.to_numpy()))).astype(np.int64) if len(w.values) else np.zeros(2, np.int64) for w in rows.column("words")]
    members = np.concatenate(([0], np.cumsum(counts)))
    leaf = np.concatenate(([0], np.cumsum([lcp[i + 1] < lengths[i] for i in range(m)])))
    spoken = np.concatenate(([0], np.cumsum([c * int(w[-1]) for c, w in zip(counts, words, strict=True)])))
    # words of the nodes that a sequence is the first to have
    fresh = np.concatenate(([0], np.cumsum([int(w[-1] - w[k + 1]) for w, k in zip(words, lcp, strict=False)])))

    lowest: dict[int, int] = {}
    order, stack = [], [(root, -1)]
    while stack:
        node, parent = stack.pop()
        order.append((node, parent))
        stack.extend((c, node) for c in forest.children[node])
    for node, _ in reversed(order):
        own = least[node] if node < m else None
        lowest[node] = min([x for x in [own, *(lowest[c] for c in forest.children[node])] if x is not None])

    for node, parent in order:
        lo, hi, deep = forest.lo[node], forest.hi[node], forest.depth[node]
        top = forest.depth[parent] + 1 if parent >= 0 else 0
        # depths up to here are shared with a neighbouring block
        rim = max(lcp[0] if lo == 0 else -1, lcp[m] if hi == m else -1)
        n = int(members[hi] - members[lo])
        w = words[lo]
        md5 = hashlib.md5(keys[lo][: DIGEST * max(0, top - 1)], usedforsecurity=False)
        above = md5.digest() if top else None  # the parent's prefix
        for d in range(top, deep + 1):
            if d and d <= rim:
                md5.update(keys[lo][DIGEST * (d - 1) : DIGEST * d])
            is_rim = d <= rim
            distinct = fresh[hi] - fresh[lo + 1] + w[-1] - w[max(lcp[lo], d - 1) + 1]
            if d < deep:
                children = int(lo > 0 or lcp[0] <= d)
            else:
                children = sum(1 for c in forest.children[node] if forest.lo[c] > 0 or lcp[0] <= d)
            here = md5.digest() if is_rim else None
            parent_on_rim = d > 0 and d - 1 <= rim
            if d == top and d > 0:  # the parent branches, and may reach further than this node
                wide = max(lcp[0] if forest.lo[parent] == 0 else -1, lcp[m] if forest.hi[parent] == m else -1)
                parent_on_rim = d - 1 <= wide
            out["rim"].append(here)
            out["parent_rim"].append(above if parent_on_rim else None)
            out["conv_id"].append(lowest[node])
            out["depth"].append(d)
            out["parent_conv_id"].append(None if d == 0 or parent_on_rim else lowest[node] if d > top else lowest[parent])
            out["n_convs"].append(n)
            out["n_children"].append(children)
            out["n_leaves"].append(int(leaf[hi] - leaf[lo]))
            out["saved_tokens"].append(int(spoken[hi] - spoken[lo] - n * w[max(d, 0)] - distinct))
            out["ends_sha256"].append(ends[lo] if d == deep and lengths[lo] == deep else None)
            above = here


def build_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie over (conv_id, t) sequences, as ``sequences`` gives them.

    Columns: conv_id (least member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves (childless nodes of the subtree), saved_tokens (words that the
    subtree's nodes hold once instead of once a member), ends_sha256 (of the decimal ids
    of members that end there, ascending, comma-joined). A conversation without turns
    ends at the root. Equal sequences are worked on once. No conversations, no nodes.
    """
    digests = F.transform("t", lambda x: x["digest"])
    told = conversations.select("conv_id", F.unhex(F.array_join(digests, "")).alias("key"), F.transform("t", lambda x: x["words"].cast("bigint")).alias("words"))
    told = written_table(told.withColumn("class", F.unhex(F.md5("key"))), "trie-sequences")
    classes = _classes(told.select("class", "conv_id"))
    whole = classes.join(told.select(F.col("conv_id").alias("least"), "key", "words"), "least")
    ordered = whole.select("key", "words", "n", "least", "ends_sha256").repartitionByRange("key").sortWithinPartitions("key")
    ordered = written_table(ordered.withColumn("place", F.monotonically_increasing_id()), "trie-order")

    # dense numbers: the place inside a task plus the rows of the tasks before it
    ordered = ordered.withColumn("part", F.shiftright("place", 33))
    parts = ordered.groupBy("part").agg(F.count("*").alias("rows"))
    parts = parts.select(F.col("part").alias("of_part"), (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    numbered = ordered.join(written_table(parts, "trie-parts"), F.col("part") == F.col("of_part"))
    numbered = numbered.withColumn("rn", F.col("place") - F.shiftleft("part", 33) + F.col("before"))
    home = F.floor(F.col("rn") / BLOCK_ROWS)
    at = F.col("rn") % BLOCK_ROWS
    # the rows at a block's edges are neighbours of the next and the previous block
    groups = F.array_compact(F.array(home, F.when(at == BLOCK_ROWS - 1, home + 1), F.when((at == 0) & (home > 0), home - 1)))
    blocks = numbered.select("rn", "key", "words", "n", "least", "ends_sha256", F.explode(groups).alias("block"))
    found = written_table(blocks.groupBy("block").applyInArrow(_grow, PART_SCHEMA), "trie-nodes")

    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    rim = found.filter("rim IS NOT NULL").groupBy("rim").agg(
        F.min("parent_rim").alias("parent_rim"),
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in sums],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    rim = written_table(rim, "trie-rim")
    open_parent = found.filter("rim IS NULL AND parent_rim IS NOT NULL").drop("parent_conv_id").unionByName(rim)
    parents = rim.select(F.col("rim").alias("p"), F.col("conv_id").alias("parent_conv_id"))
    placed = open_parent.join(parents, F.col("parent_rim") == F.col("p"), "left")
    nodes = found.filter("rim IS NULL AND parent_rim IS NULL").select(*NODE_FIELDS, "ends_sha256")
    nodes = nodes.unionByName(placed.select(*NODE_FIELDS, "ends_sha256"))
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))
