"""Prefix trie, Merkle manifest and packing against plain versions and their stated cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from counterpanel.llm import conversation_trie, merkle, packing
from counterpanel.llm.encode import PieceEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def plain_trie(rows):
    told = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            told[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in told.items()}
    whole = {c: own.get(c - int(math.fmod(c, 20)), [])[: crc(c) % 4] + v[crc(c) % 4 :] for c, v in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, v in whole.items():
        ends[tuple(v)].append(c)
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                children[tuple(v[: d - 1])].add(tuple(v[:d]))
    leaves, saved = Counter(), Counter()
    for k in members:
        words = (len(members[k]) - 1) * (len(WORD.findall(k[-1][1])) if k else 0)
        for d in range(len(k) + 1):
            saved[k[:d]] += words
            leaves[k[:d]] += not children[k]
    return sorted(
        (
            (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k])))))
            for k, m in members.items()
        ),
        key=str,
    )


def trie_rows(df):
    nodes = conversation_trie.build_trie(conversation_trie.rebuilt(conversation_trie.sequences(df)))
    return sorted((tuple(r[c] for c in [*conversation_trie.NODE_FIELDS, "ends_sha256"]) for r in nodes.collect()), key=str)


@pytest.mark.parametrize("block_rows", [256, 7])
def test_trie_equals_plain(spark, monkeypatch, block_rows):
    """Nulls, empty texts, hot beginnings, a long conversation, copies, negative ids."""
    monkeypatch.setattr(conversation_trie, "BLOCK_ROWS", block_rows)
    rnd = random.Random(block_rows)
    rows = {}
    for _ in range(1200):
        c, t = rnd.choice([None, *range(-25, 300)]), rnd.choice([None, *range(6)])
        rows[c, t] = (c, t, rnd.choice(["u", "a", None]), rnd.choice(["x y", "z", "", None, "w  w\tw"]))
    rows |= {(500 + i, t): (500 + i, t, "u", "the same") for i in range(60) for t in range(3)}
    rows |= {(700, t): (700, t, "u", f"turn {t}") for t in range(300)}
    df = spark.createDataFrame(list(rows.values()), TURNS)
    extra = df.withColumns({c: F.lit(1) for c in ("key", "t", "x", "class", "n", "block", "rim", "part", "h", "digest")})
    assert trie_rows(extra.repartition(5)) == plain_trie(list(rows.values()))


def test_trie_small_tables(spark):
    assert trie_rows(spark.createDataFrame([], TURNS)) == []
    assert trie_rows(spark.createDataFrame([(None, 1, "u", "x")], TURNS)) == []
    # repeated rows are turns; a conversation that takes all turns of a shorter one may have none
    rows = [(20, 1, "u", "x"), (20, 1, "u", "x"), (21, 1, "a", "b"), (25, None, None, None)]
    assert trie_rows(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)
    lost = next(c for c in range(41, 60) if crc(c) % 4 >= 1)
    rows = [(lost, 1, "u", "x")]  # its base is absent and its own turn is replaced: no turns
    assert trie_rows(spark.createDataFrame(rows, TURNS)) == [(lost, 0, None, 1, 0, 1, 0, sha(str(lost)))]


def test_trie_ids_across_tasks(spark, monkeypatch):
    """A class whose ids span tasks and chunks is hashed in order."""
    monkeypatch.setattr(conversation_trie, "CHUNK_CHARS", 40)
    rows = [(1000 + 20 * i, 0, "u", "all the same") for i in range(3000)]
    assert trie_rows(spark.createDataFrame(rows, TURNS).repartition(6)) == plain_trie(rows)


def plain_merkle(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def tree(level):
        path, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i in range(len(path)):
                k = at[i]
                run = level[k // 16 * 16 : k // 16 * 16 + 16]
                path[i].append((k % 16, run[: k % 16] + run[k % 16 + 1 :]))
                at[i] = k // 16
            level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        return level[0], path

    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in order}
    root, above = tree([trees[s][0] for s in order]) if order else (None, [])
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    out = []
    for s, over in zip(order, above, strict=True):
        for (_, own, r), path in zip(sorted(by[s], key=lambda x: x[:2]), trees[s][1], strict=True):
            claim = own
            if r[0] is not None and crc(r[0]) % 5 == 0:
                claim = leaf(r, r[1] and r[1].translate(lower))
            for pos, others in path + over:
                claim = sha("".join(others[:pos] + [claim] + others[pos:]))
            proof = sha("".join(x for _, others in path + over for x in others))
            out.append((r[0], own, trees[s][0], root, proof, claim, claim == root))
    return sorted(out, key=str)


def merkle_rows(df):
    done = merkle.verify(merkle.build_manifest(df, kept={"claimed": merkle.tampered(df)}))
    return sorted((tuple(r) for r in done.collect()), key=str)


def documents(n, seed=1):
    rnd = random.Random(seed)
    sources = ["hot"] * 12 + [None, "", "é"] + [f"s{i}" for i in range(20)]
    texts = ["A b", None, "", "é Q" * 50, "plain"]
    return [(rnd.choice([None, *range(n)]), rnd.choice(texts), rnd.choice(["en", None]), rnd.choice(sources), rnd.choice([None, 3])) for _ in range(n)]


@pytest.mark.parametrize(("n", "levels"), [(6000, 3), (700, 1), (0, 3), (1, 3)])
def test_manifest_equals_plain(spark, monkeypatch, n, levels):
    """Several blocks and rounds, null and equal ids, null sources and fields, no rows."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16**levels)
    rows = documents(n)
    df = spark.createDataFrame(rows, DOCS)
    extra = df.withColumns({c: F.lit(1) for c in ("tree", "id", "rank", "digest", "total", "block", "part", "root")})
    assert merkle_rows(extra) == plain_merkle(rows)


def test_layout_addresses():
    for height in range(1, 5):
        places = np.concatenate([merkle.address(d, np.arange(16**d), height) for d in range(height)])
        assert sorted(places.tolist()) == list(range(merkle.nodes_in(height)))
    # half of the height is the top part; each bottom part lies together
    assert merkle.address(1, np.arange(16), 4).tolist() == list(range(1, 17))
    assert merkle.address(2, np.array([0, 1]), 4).tolist() == [17, 34]
    assert merkle.address(3, np.arange(16), 4).tolist() == list(range(18, 34))


def test_packing_round_trip(spark, tmp_path, monkeypatch):
    """Each id once, gapless sequences, padding, null and empty texts, a long text."""
    monkeypatch.setattr(packing, "CHUNK_TOKENS", 5000)
    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["alpha", "Beta,", "gam9ma", "ééé.\n\nNew"]) for _ in range(rnd.randint(0, 300))) for _ in range(120)]
    rows = [(i, t, "en", "hot", 1) for i, t in enumerate(texts)] + [(200, None, None, None, None), (201, "", "", "", 0), (202, "long word " * 20000, "en", "s", 1)]
    rows += [(300, "twice", "en", "s", 1)] * 2 + [(None, "no id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    extra = docs.withColumns({c: F.lit(1) for c in ("part", "at", "start", "n", "ids", "body", "place")})
    where = f"file://{tmp_path}/stream"
    packing.write_stream(extra, where, path)
    tok = Tokenizer.from_file(path)
    ids = {r[0]: tok.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pieces(spark, where, window=256).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]
        of_doc[r["doc_id"]].append((r["start"], r["length"]))
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    total = sum(len(ids[r[0]]) for r in rows)
    assert sum(n for v in of_doc.values() for _, n in v) == total and set(of_doc) == set(ids)
    assert sorted(of_doc[300]) == [(0, len(ids[300]))] * 2
    for v in of_sequence.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256
    assert len(of_sequence) == -(-total // 256)  # only the last may be short
    packed = packing.sequences(spark, where, window=256, pad_id=0).collect()
    assert sum(r["n_tokens"] for r in packed) == total
    for r in packed:
        assert len(r["ids"]) == (256 if r["n_tokens"] & (r["n_tokens"] - 1) else r["n_tokens"])
        for b in r["boundaries"]:
            want = ids[b["doc_id"]][b["start"] : b["start"] + b["length"]]
            assert r["ids"][b["offset"] : b["offset"] + b["length"]] == want


def test_packing_no_rows(spark, tmp_path):
    where = f"file://{tmp_path}/empty"
    packing.write_stream(spark.createDataFrame([], DOCS), where, public_tokenizers.path("word_bpe_49k.json"))
    assert packing.pieces(spark, where).collect() == [] and packing.sequences(spark, where).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library_in_bounded_memory(name):
    """Odd white space, marks, special strings and letters outside Latin, with sweeps."""
    import pyarrow as pa

    rnd = random.Random(1)
    letters = "abC dÉß\n.,;!?'s İ²½ ́ȩ́<|endoftext|>\t \x1c 12ñ«µªº中文"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "don't. I'll\n\nGo", "x\r\ny", "..., hi!", "ÀÉ.\nß,", "中" * 5000, ""]
    texts += [" ".join(f"w{rnd.choice('abcdef')}{rnd.randint(0, 99999)} Wordy{rnd.choice('qrst')}," for _ in range(400)) for _ in range(20)]
    encoder = PieceEncoder(public_tokenizers.path(name), cache_bytes=1 << 20)
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        for lo in range(0, len(texts), 500):
            ids, lengths = encoder.ids_of(pa.array(texts[lo : lo + 500]))
            assert lengths.tolist() == [len(w) for w in want[lo : lo + 500]]
            assert ids.tolist() == [i for w in want[lo : lo + 500] for i in w]
            encoder._sweep()
            assert encoder.cost.sum() <= 1 << 20
