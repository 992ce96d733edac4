"""Token counts: Arrow batches balanced by bytes, lengths only come back.

Whole texts are counted under a public vocabulary file without begin, end or
added special tokens; strings of special tokens inside a text are treated as the
library does by default. Nulls count as empty texts (0 bytes, 0 tokens).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpanel.llm.encode import token_lengths
from counterpanel.llm.memory import handing_back


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    limit: int = 2048,
) -> DataFrame:
    """One row per input row: ``keep`` columns, n_bytes, n_tokens, over_limit.

    Rows are neither shuffled nor grouped, so repeated rows and ties stay as
    they are and a hot source has no effect. Inside a task the texts are worked
    on in groups of about 8 MB whatever the batch holds; a longer text is a
    group of its own and is cut at white space like any other. Other columns of
    the input are not read, whatever their names.
    """
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    names = list(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names))
            n_tokens = token_lengths(texts, tokenizer_path)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names)],
                    pc.cast(pc.binary_length(texts), pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(n_tokens > limit, pa.bool_()),
                ],
                names=[*names, "n_bytes", "n_tokens", "over_limit"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(names)])
    head = f"{fields}, " if fields else ""
    return given.mapInArrow(handing_back(count), f"{head}n_bytes bigint, n_tokens bigint, over_limit boolean")
