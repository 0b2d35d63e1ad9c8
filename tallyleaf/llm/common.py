"""Helpers shared by the training-data operators.

Every operator of this subpackage treats a null text as an empty text, keeps
one result row per input row (repeated rows included) and selects the columns
it needs by name, so further columns in the input never clash.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
JAVA_WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut to so many rows, to hold few texts as Python objects at a time."""
    for batch in batches:
        for lo in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(lo, rows)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving free memory back to the system at its end: workers wait for further tasks, beside those of other queries, and would hold it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def map_texts(
    docs: DataFrame,
    rows: Callable[[], Callable[[list[str]], Iterable[tuple]]],
    schema: str,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Runs a text function over Arrow batches; ``keep`` columns pass through.

    ``rows()`` is called once in each Python worker and returns a function
    from a list of texts to one tuple per text (in the order of ``schema``).
    """
    from pyspark.sql.types import StructType

    out = StructType(list(docs.select(*keep).schema.fields) + list(StructType.fromDDL(schema).fields))
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [f.type for f in to_arrow_schema(out)]
        fn = rows()
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            made = list(zip(*fn(texts), strict=True)) if texts else [()] * (len(names) - len(keep))
            kept = [batch.column(i).cast(types[i]) for i in range(len(keep))]
            new = [pa.array(list(c), type=t) for c, t in zip(made, types[len(keep) :], strict=True)]
            yield pa.RecordBatch.from_arrays(kept + new, names=names)

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), out)


def fold_of(doc_id: str, parts: int):
    """crc32 of doc_id as text, modulo ``parts``; null ids fall in no fold (null)."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(parts)


STEP = 0x9E3779B97F4A7C15
STEP_INVERSE = pow(STEP, -1, 1 << 64)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, for hashes of substrings by prefix sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 17)
            up, down = np.full(size, STEP, dtype=np.uint64), np.full(size, STEP_INVERSE, dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]
