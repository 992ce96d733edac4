"""Packing documents into windows of tokens: concatenate and cut.

The first pass tokenises every whole text where it lies and writes the ids with
their place among the tokens of their task. Prefix sums over the tasks' totals give
each place in the whole stream, and the second pass cuts the stream into fixed
windows: every piece is a boundary record (document, place in it, window, place in
that). Texts are not shuffled, and only the last window can be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterpanel.functions.session import written_table
from counterpanel.llm.encode import byte_groups, encoder
from counterpanel.llm.memory import handing_back

WINDOW = 4096
CHUNK_TOKENS = 1 << 20  # a longer document is stored as several rows
BATCH_TOKENS = 1 << 23
TOKENS_SCHEMA = "part int, at bigint, doc_id {id}, start bigint, n bigint, doc_tokens bigint, ids binary"


def _id_type(docs: DataFrame, doc_id: str) -> str:
    return docs.schema[doc_id].dataType.simpleString()


def write_stream(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int | None = 2,
) -> None:
    """First pass: ids of every whole text at ``path``, which must not exist.

    Rows are neither sorted nor shuffled: documents follow each other as the input's
    partitions hold them, and a task that runs twice leaves one copy. A null text is
    empty; an empty text holds ``end_id`` only (no row at all without an
    ``end_id``). Repeated rows and ids and null ids are documents of their own. Other
    columns are not read, whatever their names. Memory of a task: the Arrow batch at
    hand and the ids of 8 MB of text, or of one longer text.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"), F.spark_partition_id().alias("part")
    )
    end = np.array([] if end_id is None else [end_id], np.uint32)
    names = ["part", "at", "doc_id", "start", "n", "doc_tokens", "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0  # tokens of this partition so far
        for batch in batches:
            for lo, hi in byte_groups(batch.column(1)):
                ids, lengths = encoder(tokenizer_path).ids_of(batch.column(1).slice(lo, hi - lo))
                if len(end):
                    ids, lengths = np.insert(ids, np.cumsum(lengths), end[0]), lengths + 1
                before = np.cumsum(lengths) - lengths
                chunks = -(-lengths // CHUNK_TOKENS)
                doc = np.repeat(np.arange(len(lengths)), chunks)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK_TOKENS
                n = np.minimum(CHUNK_TOKENS, lengths[doc] - start)
                at = before[doc] + start
                group = at // BATCH_TOKENS
                for k in np.unique(group):
                    own = np.flatnonzero(group == k)
                    first, last = int(at[own[0]]), int(at[own[-1]] + n[own[-1]])
                    offsets = np.append(at[own], last) - first
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(own), batch.column(2)[0].as_py()), pa.int32()),
                            pa.array(done + at[own], pa.int64()),
                            batch.column(0).take(pa.array(lo + doc[own])),
                            pa.array(start[own], pa.int64()),
                            pa.array(n[own], pa.int64()),
                            pa.array(lengths[doc[own]], pa.int64()),
                            pa.Array.from_buffers(
                                pa.binary(),
                                len(own),
                                [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids[first:last].astype("<u4").tobytes())],
                            ),
                        ],
                        names=names,
                    )
                done += int(lengths.sum())

    stream = rows.mapInArrow(handing_back(encode), TOKENS_SCHEMA.format(id=_id_type(docs, doc_id)))
    stream.write.option("compression", "zstd").parquet(path)


def pieces(spark: SparkSession, path: str, *, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Second pass: one row per piece of a document in a window.

    Columns: doc_id, start (ids of its document before it), length, ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset,
    and with ``with_ids`` the ids as binary. Each id lies in one piece; offsets of a
    sequence are gapless from 0. No documents, no rows. The totals are one number per
    task of the first pass, written as a table, so their join is by their size.
    """
    stored = spark.read.parquet(path)
    kind = stored.schema["doc_id"].dataType.simpleString()
    totals = stored.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    bases = written_table(totals.select(F.col("part").alias("of_part"), before.alias("base")), "pack-bases")
    placed = stored.join(bases, F.col("part") == F.col("of_part")).select(
        "doc_id", "start", "doc_tokens", (F.col("base") + F.col("at")).alias("place"), "ids"
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, total, place = (batch.column(i).to_numpy() for i in (1, 2, 3))
            size = np.array([x.as_buffer().size for x in batch.column(4)], np.int64) // 4
            count = (place + size - 1) // window - place // window + 1
            row = np.repeat(np.arange(len(size)), count)
            sequence = place[row] // window + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            lo = np.maximum(sequence * window, place[row])
            hi = np.minimum((sequence + 1) * window, (place + size)[row])
            crc, held = np.zeros(len(row), np.int64), []
            at = 0
            for i, ids in enumerate(batch.column(4)):
                view = memoryview(ids.as_buffer())
                for _ in range(count[i]):
                    part = view[4 * int(lo[at] - place[i]) : 4 * int(hi[at] - place[i])]
                    crc[at] = zlib.crc32(part)
                    if with_ids:
                        held.append(bytes(part))
                    at += 1
            columns = [
                batch.column(0).take(pa.array(row)),
                *(pa.array(x, pa.int64()) for x in (start[row] + lo - place[row], hi - lo, crc, total[row], sequence, lo - sequence * window)),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(held, pa.binary())] * with_ids, names=names)

    fields = ", ".join(f"{x} bigint" for x in names[1:7])
    return placed.mapInArrow(handing_back(cut), f"doc_id {kind}, {fields}" + ", ids binary" * with_ids)


def sequences(spark: SparkSession, path: str, *, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The packed windows: sequence_id, n_tokens, boundaries, ids (array of int).

    ``boundaries`` lists (offset, length, doc_id, start) by offset. A short window is
    padded with ``pad_id``, unless its length is a power of two. A group is one
    window, so at most ``window`` ids meet in a task.
    """
    record = F.struct("offset", "length", "doc_id", "start", "ids")
    rows = (
        pieces(spark, path, window=window, with_ids=True)
        .groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(record)).alias("records"))
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = []
            for n, parts in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                ids = np.frombuffer(b"".join(p.as_py() for p in parts.values), "<u4").astype(np.int32)
                short = n < window and n & (n - 1) != 0
                whole.append(np.append(ids, np.full(window - n, pad_id, np.int32)) if short else ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(whole, pa.list_(pa.int32()))], names=["sequence_id", "n_tokens", "boundaries", "ids"])

    slim = F.transform("records", lambda r: F.struct(r["offset"].alias("offset"), r["length"].alias("length"), r["doc_id"].alias("doc_id"), r["start"].alias("start")))
    shaped = rows.select("sequence_id", "n_tokens", slim.alias("boundaries"), F.col("records.ids").alias("parts"))
    kind = shaped.schema["boundaries"].dataType.simpleString()
    return shaped.mapInArrow(handing_back(fill), f"sequence_id bigint, n_tokens bigint, boundaries {kind}, ids array<int>")
