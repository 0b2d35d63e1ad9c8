"""Quality rules: hashed n-gram log-likelihood ratio, target against raw corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyleaf.llm.common import WORD, map_texts, sliced
from tallyleaf.llm.quality_model import TOKEN, Ids, ngrams

BITS = 16
#: Good doc_ids that a task holds at a time: 32 MB.
BLOCK_IDS = 1 << 22
SYMBOLS = re.compile(r"[#*$%&|<>]")


def counts(docs: DataFrame, good: np.ndarray, raw: bool = True) -> DataFrame:
    """Counts of hashed n-grams: (target, gram, n); the target's are of rows whose doc_id is in ``good``, sorted.

    ``docs`` has doc_id and text.  The raw corpus is every row, and left out
    without ``raw``.  Each task adds up a dense table of fixed size and sends
    its non-zero cells only.
    """

    def run(batches):
        ids = Ids()
        cells = np.zeros((2, 2 << BITS), dtype=np.int64)
        held: tuple[list, list] = ([], [])
        size = 0

        def add():
            for own, parts in zip(cells, held, strict=True):
                if parts:
                    own += np.bincount(np.concatenate(parts), minlength=2 << BITS)
                    parts.clear()

        for batch in sliced(batches):
            trusted = member(batch.column(0), good)
            for text, t in zip(batch.column(1).to_pylist(), trusted.tolist(), strict=True):
                if not (raw or t):
                    continue
                one, two = grams(text or "", ids)
                held[t].extend([one, two + (1 << BITS)])
                size += len(one) + len(two)
                if size > 1 << 20:
                    add()
                    size = 0
        add()
        if raw:
            cells[0] += cells[1]
        for target in (0, 1):
            at = np.flatnonzero(cells[target])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), target, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(cells[target, at])], names=["target", "gram", "n"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "target int, gram int, n long")


def member(doc_ids: pa.Array, good: np.ndarray) -> np.ndarray:
    """Which ids are among the sorted ones; null is not."""
    if not len(good):
        return np.zeros(len(doc_ids), dtype=bool)
    found = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(good, found), len(good) - 1)
    return (good[at] == found) & doc_ids.is_valid().to_numpy(zero_copy_only=False)


def blocks(ids: DataFrame) -> Iterator[np.ndarray]:
    """The distinct doc_ids of a table in sorted blocks of at most BLOCK_IDS, each id in one."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().astype("<i8").tobytes()], type=pa.binary())], names=["ids"])

    held, size = [], 0
    for r in ids.select(F.col("doc_id").cast("long")).distinct().mapInArrow(run, "ids binary").toLocalIterator():
        part = np.frombuffer(r.ids, dtype="<i8")
        while len(part):
            take = part[: BLOCK_IDS - size]
            held.append(take)
            size, part = size + len(take), part[len(take) :]
            if size == BLOCK_IDS:
                yield np.sort(np.concatenate(held))
                held, size = [], 0
    if held:
        yield np.sort(np.concatenate(held))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Ratios of the target, all documents labelled good, to the raw corpus, all documents.

    No text moves: the good doc_ids go out in blocks of BLOCK_IDS, and each
    block is a pass over the texts, the first of which counts the raw corpus too.
    """
    made = None
    for good in blocks(labels.where("quality = 1 and doc_id is not null")):
        part = counts(docs, good, raw=made is None)
        made = part if made is None else made.unionByName(part)
    if made is None:
        return np.zeros(2 << BITS)
    return ratios(made.groupBy("target", "gram").agg(F.sum("n").alias("n")))


def grams(text: str, ids: Ids) -> tuple[np.ndarray, np.ndarray]:
    tokens = TOKEN.findall(text.lower())
    return ngrams(np.fromiter(map(ids.__getitem__, tokens), dtype=np.uint32, count=len(tokens)), BITS)


def ratios(counted: DataFrame, smooth: float = 20.0) -> np.ndarray:
    """log p(target) - log p(raw) for each cell; the table has 2**(BITS + 1) cells whatever the input."""
    cells = np.zeros((2, 2 << BITS))
    for r in counted.toLocalIterator():
        cells[r.target, r.gram] = r.n
    if not cells[1].any():
        return np.zeros(2 << BITS)
    out = []
    for lo in (0, 1 << BITS):
        raw, target = (c[lo : lo + (1 << BITS)] for c in cells)
        part = target.sum() / max(raw.sum(), 1.0)
        # smoothing leans on the raw multinomial, so rare cells stay near 0
        out.append(np.log((target + smooth * part) / (raw + smooth)) - np.log(part) if part else np.zeros(len(raw)))
    return np.concatenate(out)


class Serial(dict):
    """Exact small numbers for words, so that three fit in one 64-bit key."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


def measure(ratio: np.ndarray, threshold: float):
    packed = ratio.astype(np.float32)

    def start():
        ids, serial = Ids(), Serial()

        def rows(texts):
            for text in texts:
                if len(serial) > 1_000_000:
                    serial.clear()
                words = WORD.findall(text)
                n = len(words)
                s = np.fromiter(map(serial.__getitem__, words), dtype=np.int64, count=n)
                if len(serial) > 1 << 21:  # one text with more words than a key holds
                    _, s = np.unique(s, return_inverse=True)
                repeat = 0
                if n >= 4:
                    key = triples(s)
                    _, inverse, c = np.unique(key, return_inverse=True, return_counts=True)
                    twice = c[inverse] > 1
                    if twice.any():
                        covered = np.zeros(n, dtype=bool)
                        for k in range(3):
                            covered[k : n - 2 + k] |= twice
                        repeat = int(covered.sum())
                one, two = grams(text, ids)
                llr = float((packed[one].sum(dtype=np.float64) + packed[two + (1 << BITS)].sum(dtype=np.float64)) / max(len(one) + len(two), 1))
                failed = n < 50 or 100 * repeat > 50 * n
                yield n, sum(map(len, words)), len(SYMBOLS.findall(text)), repeated_lines(text), repeat, failed, not failed and llr >= threshold, llr

        return rows

    return start


def triples(s: np.ndarray) -> np.ndarray:
    if len(s) and s.max() >= 1 << 21:  # beyond exact packing: number the pairs, then the triples
        _, a = np.unique(s[:-1] * (int(s.max()) + 1) + s[1:], return_inverse=True)
        return a[:-1].astype(np.int64) * (int(s.max()) + 1) + s[2:]
    return (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in seen:
            repeats += 1
        elif WORD.search(line):
            seen.add(line)
    return repeats


def apply(docs: DataFrame, ratio: np.ndarray, threshold: float) -> DataFrame:
    """Counts and verdict for every row; null and empty texts have no words and fail.

    A text passes if it has 50 words, at most half of them in repeated
    3-word windows, and a length-normalised log-likelihood ratio of at least
    ``threshold``.
    """
    return map_texts(
        docs,
        measure(ratio, threshold),
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double",
    )
