"""Token-id output: documents in id order as range-coded binary segments.

Documents are dealt to shards by ranges of ``doc_id`` and tokenised, and each
task packs its shard into self-contained segments (see ``rans``). Segments are
stored as binary values of Parquet files, so that a task that fails or runs
twice leaves one copy of its output, and beside each are its shard, number and
token count, which is what the global offsets need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterpanel.llm.encode import encoder
from counterpanel.llm.memory import handing_back
from counterpanel.llm.rans import Segment, pack_segment

SEGMENT_TOKENS = 1 << 22
SEGMENT_SCHEMA = "shard int, segment int, n_docs bigint, n_tokens bigint, payload binary"


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int | None = 2,
    segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Write every whole text to ``path``, which must not exist.

    Rows are ordered by ``doc_id`` (nulls first), equal ids by text hash, so
    many rows of one id are still dealt to several shards. A null text is empty;
    an empty text holds ``end_id`` only. Other columns are not read. Memory of a
    task: one segment and the Arrow batch at hand.
    """
    rows = (
        docs.select(
            F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body")
        )
        .withColumn("tie", F.xxhash64("body"))
        .repartitionByRange("id", "tie")
        .sortWithinPartitions("id", "tie", "body")
        .select("id", "body", F.spark_partition_id().alias("shard"))
    )
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "segment", "n_docs", "n_tokens", "payload"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        held: list[tuple] = []
        size = done = shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, done
            doc_ids, nulls, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [shard, done, len(doc_ids), len(ids), pack_segment(doc_ids, nulls, lengths, ids)]
            held, size, done = [], 0, done + 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(2)[0].as_py()
            doc_ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids, lengths = encoder(tokenizer_path).ids_of(batch.column(1))
            stops = np.cumsum(lengths)
            ids = np.insert(ids, stops, end[0]) if len(end) else ids
            lengths = lengths + len(end)
            stops = np.cumsum(lengths)
            lo = 0
            while lo < len(doc_ids):  # whole documents until the segment is full
                before = int(stops[lo - 1]) if lo else 0
                hi = min(len(doc_ids), int(np.searchsorted(stops, before + segment_tokens - size)) + 1)
                held.append((doc_ids[lo:hi], nulls[lo:hi], lengths[lo:hi], ids[before : int(stops[hi - 1])]))
                size += int(stops[hi - 1]) - before
                if size >= segment_tokens:
                    yield flush()
                lo = hi
        if held:
            yield flush()

    rows.mapInArrow(handing_back(pack), SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """Documents decoded from the files at ``path``, one row per document.

    Columns: doc_id, start (tokens of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and with
    ``with_ids`` the ids. Damaged blocks are errors.
    """
    stored = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sizes = stored.select("shard", "segment", "n_tokens")
    # one row per shard, then one per segment of a shard; the payload is not read here
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select(
        F.col("shard").alias("of_shard"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start")
    )
    within = Window.partitionBy("shard").orderBy("segment")
    bases = (
        sizes.withColumn("before", F.sum("n_tokens").over(within) - F.col("n_tokens"))
        .join(shards, F.col("shard") == F.col("of_shard"))
        .select("shard", "segment", (F.col("shard_start") + F.col("before")).alias("base"))
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                seg = Segment(payload.as_py())
                n = len(seg.doc_ids)
                kept, crcs = [], np.zeros(n, np.int64)
                for i, ids in enumerate(seg.documents()):
                    crcs[i] = zlib.crc32(ids.astype("<u4").tobytes())
                    if with_ids:
                        kept.append(ids.astype(np.int64))
                columns = [
                    pa.array([shard.as_py()] * n, pa.int32()),
                    pa.array([segment.as_py()] * n, pa.int32()),
                    pa.array(seg.doc_ids, pa.int64(), mask=seg.nulls),
                    pa.array(np.cumsum(seg.lengths) - seg.lengths, pa.int64()),
                    pa.array(seg.lengths, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    fields = ["shard", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])
    kinds = ["int", "int", "bigint", "bigint", "bigint", "bigint"] + (["array<bigint>"] if with_ids else [])
    schema = ", ".join(f"{f} {k}" for f, k in zip(fields, kinds, strict=True))
    decoded = stored.select("shard", "segment", "payload").mapInArrow(handing_back(decode), schema)
    return decoded.join(bases, ["shard", "segment"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )
