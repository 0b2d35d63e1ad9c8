"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates."""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyleaf.llm.common import fold_of, map_texts, sliced, tidied
from tallyleaf.llm.ftrl import Ftrl

BITS = 18
TOKEN = re.compile(r"\w+|[^\w\s]")


class Ids(dict):
    """Token to a 32-bit hash, remembered; forgotten when large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = h = crc32(token.encode())
        return h


def ngrams(h: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and bigrams of a sequence of token hashes."""
    h = h.astype(np.uint64)
    one = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    two = ((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return one.astype(np.int64), two.astype(np.int64)


def shape(h: np.ndarray, two: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Buckets that say how often n-grams repeat and how many there are."""
    n = len(h)
    repeats = 10 * (n - len(np.unique(two)) - 1) // max(n, 1) if n > 1 else 0
    names = (f"~repeats{repeats}", f"~length{int(math.log2(n + 1))}")
    return np.array([crc32(x.encode()) >> (32 - bits) for x in names], dtype=np.int64)


def features_of(text: str, ids: Ids) -> np.ndarray:
    tokens = TOKEN.findall(text.lower())
    h = np.fromiter(map(ids.__getitem__, tokens), dtype=np.uint32, count=len(tokens))
    one, two = ngrams(h)
    return np.unique(np.concatenate([one, two, shape(h, two)]))


def featurise():
    ids = Ids()
    return lambda texts: ((features_of(t, ids).astype(np.int32).tobytes(),) for t in texts)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, epochs: int = 3, fold: tuple[int, int] = (4, 2)) -> dict:
    """Fits on at most about ``max_rows`` labelled documents outside the held-out fold.

    Rows are picked by a hash of doc_id below a share set from their count.
    Null labels are left out; of several labels for a document the largest
    counts.  Without a labelled row every score is one half.
    """
    train = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .where(F.coalesce(fold_of("doc_id", fold[0]) != fold[1], F.lit(True)))
        .groupBy("doc_id")
        .agg(F.max(F.col("quality").cast("int")).alias("label"))
    )
    n = train.count()
    share = min(1.0, max_rows / max(n, 1))
    picked = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(picked), "doc_id")
    local = sorted(map_texts(rows, featurise, "features binary", keep=("doc_id", "label")).collect(), key=lambda r: (crc32(str(r.doc_id).encode()), r.doc_id))
    feats = [np.frombuffer(r.features, dtype=np.int32).astype(np.int64) for r in local]
    model = Ftrl(1 << BITS, alpha=0.5, l1=0.05, l2=0.1)
    w = model.fit(feats, [scale_of(len(f)) for f in feats], [r.label for r in local], epochs)
    at = np.flatnonzero(w[:-1])
    return {"at": at.astype(np.int32), "w": w[at], "bias": float(w[-1]), "rows": len(local), "labelled": n}


def scale_of(n: int) -> float:
    return 4.0 / math.sqrt(max(n, 1))


def scorer(model: dict, threshold: float):
    def start():
        dense = np.zeros(1 << BITS)
        dense[model["at"]] = model["w"]
        bias, ids = model["bias"], Ids()

        def rows(texts):
            for text in texts:
                f = features_of(text, ids)
                z = bias + scale_of(len(f)) * float(dense[f].sum())
                p = 1.0 / (1.0 + math.exp(-min(35.0, max(-35.0, z))))
                yield p, int(p >= threshold)

        return rows

    return start


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """A score in [0, 1] for every row; an empty or null text has its shape features only."""
    return map_texts(docs, scorer(model, threshold), "score double, predicted int")


def keep_good(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold; texts do not move."""
    import pyarrow as pa

    start = scorer(model, threshold)
    at = docs.columns.index("text")

    def run(batches):
        rows = start()
        for batch in sliced(batches):
            keep = [bool(p) for _, p in rows([t or "" for t in batch.column(at).to_pylist()])]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
