"""The pipeline against plain versions of its stages, and its defined cases."""

from __future__ import annotations

import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from counterpanel.llm import mixing, toxicity
from counterpanel.llm.oracles import ORACLES
from tests.llm.test_operators import WORD, plain_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, words string, score double"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()),
    ("size", pa.int32()), ("row", pa.string()), ("words", pa.string()), ("score", pa.float64()),
])
ITEM = "which of these rivers crosses the old town before it meets the sea at the western harbour"


def corpus():
    """Toxic, near-equal, contaminated and plain documents; nulls, empty and long texts."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(3, 8))) for _ in range(900)]
    texts = []
    for i in range(120):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 70))]
        if i % 4 == 1:
            for _ in range(9):
                words.insert(rnd.randrange(len(words)), rnd.choice(["worthless", "idiot", "scum,", "pathetic"]))
        if i % 10 == 3:
            words[5:5] = ITEM.replace("town", "towns" if i % 20 == 3 else "town").upper().split()
        if i % 10 == 6:
            words = texts[i - 2].split()
            words[-1] = "changed"
        texts.append(" ".join(words))
    rows = [(i, t, "en", ("web", "books", None)[i % 3 if i % 9 else 0], len(t)) for i, t in enumerate(texts)]
    rows += [(200, None, None, "web", None), (201, "", "en", None, 0), (202, " ".join(vocabulary * 6), "en", "web", 1), (None, "one row without an id", "en", "web", 3)]
    return [(*r, 1, "mine", "more", 0.5) for r in rows]


def written(folder, rows, labels, items):
    folder.mkdir()
    pq.write_table(pa.Table.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in rows], ARROW), folder / "documents.parquet")
    kinds = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
    pq.write_table(pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in labels], kinds), folder / "labels.parquet")
    kinds = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
    pq.write_table(pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in items], kinds), folder / "benchmark.parquet")
    return str(folder)


def normal(text):
    return " ".join(re.findall(r"[a-z0-9]+", (text or "").lower()))


def least_edits(item, text):
    """Edits between an item and the stretch of a text nearest to it, by the full table."""
    above = np.zeros(len(text) + 1, int)
    chars = np.array(list(text))
    for i, c in enumerate(item, 1):
        free = np.concatenate(([i], np.minimum(above[1:] + 1, above[:-1] + (chars != c))))
        at = np.arange(len(free))
        above = np.minimum.accumulate(free - at) + at  # insertions from the left
    return int(above.min())


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows = corpus()
    labels = [(i, 1, int(i % 4 == 1)) for i in range(0, 120)]
    sf_dir = written(tmp_path / "tables", rows, labels, [(1, ITEM), (2, None), (3, "")])
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"], r["start"]) for r in corpus_pipeline.run(spark, sf_dir).collect())

    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic)

    def ordinary(text):
        z = model.weights[0] + ((toxicity.features(text or "", *held) - model.mean) / model.scale) @ model.weights[1:]
        return 1 / (1 + np.exp(-z)) < 0.3

    kept = [r for r in rows if ordinary(r[1])]
    marked = {i for i in range(120) if any(w in rows[i][1] for w in ("worthless", "idiot", "scum", "pathetic"))}
    assert len({r[0] for r in kept} & marked) <= len(marked) // 10 and len(kept) >= 80
    listed = [(r[0] if r[0] is not None else -1, r[1]) for r in kept]
    least = {doc: root for doc, _, root in plain_components(listed)}
    kept = [r for r, (doc, _) in zip(kept, listed, strict=True) if least[str(doc)] == str(doc)]
    assert len(kept) < len(listed)
    item = normal(ITEM)
    clean = [r for r in kept if least_edits(item, normal(r[1])) > int(0.08 * len(item))]
    assert len(clean) < len(kept)

    # the mix: words of each document by the SQL, texts as cut by the operator
    survivors = spark.createDataFrame(clean, SCHEMA)
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in clean], ARROW))
    taken = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, taken FROM ({ORACLES['op1_mix_sources']})").fetchall()}
    mixed = mixing.mixed_documents(survivors).collect()
    words = {}
    for r in mixed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert words == {doc: n for doc, n in taken.items() if n}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in mixed:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    assert [r[:3] for r in got] == sorted(want)
    at = 0
    for _, n, _, start in sorted(got, key=lambda r: r[3]):
        assert start == at
        at += n


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(tmp_path / "none", [], [], [])).count() == 0
    rows = [r for r in corpus() if r[1] in (None, "")]
    assert corpus_pipeline.run(spark, written(tmp_path / "bare", rows, [], [(1, ITEM)])).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    sf_dir = written(tmp_path / "columns", corpus()[:30], [], [(1, ITEM)])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, docs, sf_dir).columns == docs.columns
