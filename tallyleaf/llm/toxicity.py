"""Counterfactual-regularised toxicity classifier.

Features are the distinct words of a text and their word beginnings, hashed.
Each labelled sentence that holds an identity term is also read with that
term swapped for others of its group; the fit penalises the change of score
between the two, so a neutral mention of a group gains no weight.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyleaf.llm.common import fold_of, map_texts
from tallyleaf.llm.ftrl import Ftrl

BITS = 20
STEMS = (3, 4, 5, 6, 7)
TOKEN = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")

# Identity terms; a term is swapped only within its own group.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("american", "german", "french", "spanish", "african", "chinese", "arab", "indian"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos"),
)
SWAPS = {t: tuple(x for x in g if x != t) for g in IDENTITY_GROUPS for t in g}


def features_of(word: str) -> list[int]:
    mask = (1 << BITS) - 1
    out = [crc32(word.encode()) & mask]
    out += [crc32(f"{word[:n]}~{n}".encode()) & mask for n in STEMS if len(word) > n]
    return out


def distinct_features(words: set[str]) -> list[int]:
    return sorted({f for w in words for f in features_of(w)})


def swapped(text: str) -> list[tuple[list[int], list[int]]]:
    """For each sentence with an identity term: features lost and gained by each swap."""
    pairs = []
    for sentence in SENTENCE.split(text):
        words = set(TOKEN.findall(sentence))
        for term in sorted(words & SWAPS.keys()):
            own = set(distinct_features(words))
            for other in SWAPS[term]:
                new = set(distinct_features((words - {term}) | {other}))
                pairs.append((sorted(own - new), sorted(new - own)))
    return pairs


def packed(features: list[int]) -> bytes:
    return np.array(features, dtype=np.int32).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int32).astype(np.int64)


def featurise():
    def rows(texts):
        for text in texts:
            low = text.lower()
            pairs = swapped(low) if any(t in low for t in SWAPS) else []
            yield packed(distinct_features(set(TOKEN.findall(low)))), [packed(a) for a, _ in pairs], [packed(b) for _, b in pairs]

    return rows


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, epochs: int = 6, pull: float = 4.0, fold: tuple[int, int] = (5, 0)) -> dict:
    """Fits on at most about ``max_rows`` labelled documents outside the held-out fold.

    The bound is met by keeping the rows whose hash lies below a share set
    from their count; which rows those are depends on doc_id alone.  Labels
    that are null, and documents with several labels, count once by the
    largest label.  Without a labelled row every score is one half.
    """
    train = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(F.coalesce(fold_of("doc_id", fold[0]) != fold[1], F.lit(True)))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("label"))
    )
    n = train.count()
    share = min(1.0, max_rows / max(n, 1))
    picked = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(picked), "doc_id")
    found = map_texts(rows, featurise, "features binary, lost array<binary>, gained array<binary>", keep=("doc_id", "label"))
    local = sorted(found.collect(), key=lambda r: (crc32(str(r.doc_id).encode()), r.doc_id))
    model = Ftrl(1 << BITS, alpha=1.0, l1=4.0, l2=0.1)
    pairs = []
    for r in local:
        own = []
        for a, b in zip(r.lost, r.gained, strict=True):
            a, b = unpacked(a), unpacked(b)
            if len(a) + len(b):
                own.append((np.concatenate([a, b]), np.repeat([1.0, -1.0], [len(a), len(b)])))
        pairs.append(own)
    feats = [unpacked(r.features) for r in local]
    w = model.fit(feats, [1.0] * len(feats), [r.label for r in local], epochs, pairs, pull, (1.0, 2.0))
    at = np.flatnonzero(w[:-1])
    return {"at": at.astype(np.int32), "w": w[at], "bias": float(w[-1]), "rows": len(local), "labelled": n}


def scorer(model: dict):
    def start():
        dense = np.zeros(1 << BITS)
        dense[model["at"]] = model["w"]
        bias = model["bias"]

        class Memo(dict):
            def __missing__(self, word):
                if len(self) > 200_000:
                    self.clear()
                self[word] = out = tuple(f for f in features_of(word) if dense[f])
                return out

        memo = Memo()

        def rows(texts):
            for text in texts:
                on = set()
                for found in map(memo.__getitem__, set(TOKEN.findall(text.lower()))):
                    if found:
                        on.update(found)
                z = bias + float(sum(dense[f] for f in sorted(on)))
                p = 1.0 / (1.0 + math.exp(-min(35.0, max(-35.0, z))))
                yield p, int(p >= 0.5)

        return rows

    return start


def score(docs: DataFrame, model: dict) -> DataFrame:
    """A score in [0, 1] for every row; empty and null texts score by the bias alone."""
    return map_texts(docs, scorer(model), "score double, predicted int")
