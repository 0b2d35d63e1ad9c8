"""Substring dedup: words in a run of ``width`` words that occurs before are removed; found by recompression.

A text starts as its words, each named by a hash of 128 bits.  Rounds then
name pairs of neighbours (one of the left half of all names, the next of the
right half, a split anew in each round) and, from the second stage, runs of
equal symbols, so symbols come to stand for longer phrases.  Names depend on
nothing but what they stand for, and equal words get equal names in all texts,
but for those at the edges of what is equal.  Stages of rounds end at phrases
of up to 8, 32, 128 and more words.

Spark counts the names of the first stage over all texts and finds the first
place (by doc_id, then place) of every longer name.  Then

* a phrase of the first stage that occurs once rules out all windows that
  hold it and what its cutting depends on, since an equal window would hold
  the same phrase;
* a longer phrase of at least a window's length that stands elsewhere before
  is removed whole, and windows inside it are not looked at: their first
  occurrence is not there.

What is left are the first places of repeated passages and their edges.  Each
such window is named, Spark finds the first place of each name, and the
other places are removed.  Neither step drops a repeated window, so the
result is that of comparing all windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.llm.common import Powers, sliced
from tallyleaf.llm.ngram_join import P1, P2
from tallyleaf.llm.state import Scratch

WIDTH = 20
#: Longest phrase of the first stage, in words, rounds of it, and the shortest one that is counted; later stages allow
#: four times the length each.  More rounds make longer phrases, but they depend on more words around them.
FIRST, FIRST_ROUNDS, LEAST = 8, 4, 3
GROWTH, LATER_ROUNDS, MOST_STAGES = 4, 6, 20
#: Bytes of text that are parsed at a time (a longer text is a group of its own).
GROUP = 1 << 20
LAST_DOC = (1 << 63) - 1
P3, P4 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: A number of 64 bits for each byte, for the second half of a word's name.
BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)


def stirred(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * P2
    x = x ^ (x >> np.uint64(29))
    x = x * P1
    return x ^ (x >> np.uint64(32))


def joined(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The name of what (a, b) and (c, d) make together."""
    k = np.uint64(kind)
    return stirred(a * P1 + stirred(c + k)), stirred(b * P3 + stirred(d * P4 + k))


class Words:
    """Where the words of bytes start and end, and their names."""

    def __init__(self):
        self.powers = Powers()
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, *range(9, 14)]] = True

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        b = np.frombuffer(data, dtype=np.uint8)
        gap = np.ones(len(b) + 2, dtype=bool)
        gap[1:-1] = self.space[b]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edge[::2], edge[1::2]
        up, down = self.powers(len(b) + 1)
        names = []
        for values in (b.astype(np.uint64) + np.uint64(1), BYTES[b]):
            sums = np.zeros(len(b) + 1, dtype=np.uint64)
            np.cumsum(values * down[:-1], out=sums[1:])
            names.append(stirred((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64)))
        return starts, ends, *names


@dataclass
class Phrases:
    """Phrases in order: names, first word, words, document; and the words on which the cutting depends."""

    a: np.ndarray
    b: np.ndarray
    at: np.ndarray
    n: np.ndarray
    of: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    fresh: np.ndarray

    def kept(self, keep: np.ndarray) -> Phrases:
        return Phrases(*(getattr(self, f)[keep] for f in self.__dataclass_fields__))


def with_runs(p: Phrases, most: int) -> Phrases:
    """Runs of equal phrases become one, where they are short enough."""
    same = (p.of[1:] == p.of[:-1]) & (p.a[1:] == p.a[:-1]) & (p.b[1:] == p.b[:-1])
    head = np.flatnonzero(np.r_[True, ~same])
    k = np.diff(np.r_[head, len(p.a)])
    join = (k > 1) & (k * p.n[head] <= most)
    if not join.any():
        return p
    at, times = head[join], k[join].astype(np.uint64)
    p.a[at], p.b[at] = joined(p.a[at], p.b[at], times, times, 1)
    p.n[at] *= k[join]
    p.fresh[at] = True
    keep = np.ones(len(p.a), dtype=bool)
    keep[np.repeat(join, k)] = False
    keep[at] = True
    return p.kept(keep)


def with_pairs(p: Phrases, most: int, turn: int, dependent: bool) -> Phrases:
    """A phrase of the left half and one of the right half after it become one, where they are short enough."""
    right = stirred(p.a ^ np.uint64((turn + 1) * int(P4) % (1 << 64))) >> np.uint64(63) == 1
    together = p.of[1:] == p.of[:-1]
    join = together & ~right[:-1] & right[1:] & (p.n[:-1] + p.n[1:] <= most)
    if dependent:
        # a left one may join what follows, a right one what is before; what comes of it depends on that neighbour
        after = np.r_[np.where(together, p.hi[1:], p.hi[:-1] + 1), p.hi[-1] + 1]
        before = np.r_[p.lo[0] - 1, np.where(together, p.lo[:-1], p.lo[1:] - 1)]
        p.lo, p.hi = np.where(right, np.minimum(p.lo, before), p.lo), np.where(right, p.hi, np.maximum(p.hi, after))
    i = np.flatnonzero(join)
    if not len(i):
        return p
    p.a[i], p.b[i] = joined(p.a[i], p.b[i], p.a[i + 1], p.b[i + 1], 2)
    p.n[i] += p.n[i + 1]
    p.lo[i], p.hi[i] = np.minimum(p.lo[i], p.lo[i + 1]), np.maximum(p.hi[i], p.hi[i + 1])
    p.fresh[i] = True
    keep = np.ones(len(p.a), dtype=bool)
    keep[i + 1] = False
    return p.kept(keep)


def stages(a: np.ndarray, b: np.ndarray, of: np.ndarray, width: int) -> Iterator[tuple[int, Phrases]]:
    """(stage, phrases): those of the first stage that can rule windows out, then those of each later one that are new and at least a window long."""
    if not len(a):
        return
    at = np.arange(len(a))
    p = Phrases(a.copy(), b.copy(), at, np.ones(len(a), dtype=np.int64), of, at.copy(), at + 1, np.ones(len(a), dtype=bool))
    for turn in range(FIRST_ROUNDS):
        p = with_pairs(p, FIRST, turn, True)
    yield 0, p.kept((p.n >= min(LEAST, width)) & (p.hi - p.lo <= width))
    most, turn = FIRST, FIRST_ROUNDS
    for stage in range(1, MOST_STAGES):
        most *= GROWTH
        for _ in range(LATER_ROUNDS):
            p = with_pairs(with_runs(p, most), most, turn, False)
            turn += 1
        found = p.fresh & (p.n >= width)
        if found.any():
            yield stage, p.kept(found)
            p.fresh &= ~found
        if not (p.of[1:] == p.of[:-1]).any():
            return


def grouped(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(lo, hi, data, begin): texts from lo to hi with a line feed between them, and where each begins."""
    lo, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append((text or "").encode())
        size += len(held[-1]) + 1
        if size >= GROUP or k + 1 == len(texts):
            yield lo, k + 1, b"\n".join(held), np.cumsum([0, *(len(h) + 1 for h in held)])
            lo, held, size = k + 1, [], 0


def first_of_each(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a name of a document stands first, and how often it does."""
    order = np.lexsort((b, a, of))
    o, x, y = of[order], a[order], b[order]
    new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(o)])
    return order[new], np.diff(np.r_[new, len(o)])


STAGE_BITS = 5


def symbols(docs: DataFrame, width: int) -> DataFrame:
    """(a, b, doc, part, code, n): names of each document, where they stand first in it (place and stage), how often."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in sliced(batches):
            doc, part = (batch.column(k).to_numpy() for k in (0, 1))
            for lo, _, data, begin in grouped(batch.column(2).to_pylist()):
                starts, _, a, b = words(data)
                first = np.searchsorted(starts, begin)
                n = np.diff(first)
                of = np.repeat(np.arange(len(n)), n)
                long = n[of] >= width
                place = (np.arange(len(of)) - first[of])[long]
                for stage, p in stages(a[long], b[long], of[long], width):
                    # the first stage only rules windows out, for which half a name will do
                    second = np.zeros_like(p.b) if stage == 0 else p.b
                    at, times = first_of_each(p.of, p.a, second)
                    row = lo + p.of[at]
                    code = place[p.at[at]] << STAGE_BITS | stage
                    columns = [p.a[at].view(np.int64), second[at].view(np.int64), doc[row], part[row], code, np.minimum(times, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["a", "b", "doc", "part", "code", "n"])

    return docs.select("doc", "part", "text").mapInArrow(parse, "a long, b long, doc long, part long, code long, n long")


def first_places(rows: DataFrame, unique: bool, seen: Column) -> DataFrame:
    """(doc, part, codes): for each document the places of names that stand nowhere before, as far as ``seen`` (over n, a, b and code) lets them through."""
    total = F.sum("n").alias("n")
    if unique:
        found = rows.groupBy("a", "b").agg(F.min("doc").alias("doc"), F.min_by("code", "doc").alias("code"), total).withColumn("part", F.lit(0).cast("long"))
    else:
        found = rows.groupBy("a", "b").agg(F.min(F.struct("doc", "part", "code")).alias("f"), total).select("a", "b", "f.*", "n")
    return found.where(seen).groupBy("doc", "part").agg(F.collect_list("code").alias("codes"))


def coverage(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans from lo to hi (without hi)."""
    steps = np.bincount(lo, minlength=n + 1)[: n + 1] - np.bincount(hi, minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def spans(mask: np.ndarray) -> np.ndarray:
    """Starts and ends of runs of True, one after the other."""
    return np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))


def picked(lists: pa.ListArray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(row counted from lo, value) of the lists of rows lo to hi; null lists are empty."""
    some = lists.slice(lo, hi - lo)
    sizes = pc.fill_null(pc.list_value_length(some), 0).to_numpy()
    return np.repeat(np.arange(hi - lo), sizes), some.flatten().to_numpy().astype(np.int64)


def examined(docs: DataFrame, width: int) -> DataFrame:
    """Each document with ``codes`` (places where it has a name first): its words joined by a space, cut already where nothing is left to find.

    ``gone`` and ``open`` are spans of words that go and of windows that may
    stand elsewhere; both are null if the text is done.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in sliced(batches):
            texts = batch.column(3).to_pylist()
            for lo, hi, data, begin in grouped(texts):
                starts, ends, a, b = words(data)
                first = np.searchsorted(starts, begin)
                n = np.diff(first)
                of = np.repeat(np.arange(len(n)), n)
                total = len(of)
                index = np.flatnonzero(n[of] >= width)
                row, code = picked(batch.column(4), lo, hi)
                known = np.unique(row << 44 | code)
                ruled, gone_lo, gone_hi = [], [], []
                for stage, p in stages(a[index], b[index], of[index], width):
                    place = index[p.at] - first[p.of]
                    listed = np.isin(p.of << 44 | place << STAGE_BITS | stage, known)
                    if stage == 0:
                        inside = np.flatnonzero(listed & (p.lo >= 0) & (p.hi <= len(index)))
                        ruled_lo, ruled_hi = index[p.lo[inside]], index[p.hi[inside] - 1] + 1
                        fits = ruled_hi - ruled_lo <= width
                        ruled = [ruled_lo[fits], ruled_hi[fits]]
                    else:
                        gone_lo.append(index[p.at[~listed]])
                        gone_hi.append(index[p.at[~listed]] + p.n[~listed])
                goes_lo, goes_hi = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (gone_lo, gone_hi))
                goes = coverage(goes_lo, goes_hi, total)
                may = np.arange(total) + width <= first[of + 1]
                if len(ruled):
                    may &= ~coverage(np.maximum(ruled[1] - width, 0), ruled[0] + 1, total)
                may &= ~coverage(goes_lo, goes_hi - width + 1, total)
                open_rows = np.zeros(len(n), dtype=bool)
                open_rows[of[may]] = True
                text, kept, gone, opened = [], [], [], []
                for k in range(len(n)):
                    s, e = first[k], first[k + 1]
                    own = [data[x:y] for x, y in zip(starts[s:e].tolist(), ends[s:e].tolist(), strict=True)]
                    if not open_rows[k]:
                        own = [w for w, g in zip(own, goes[s:e].tolist(), strict=True) if not g]
                    text.append(b" ".join(own).decode())
                    kept.append(len(own))
                    gone.append(spans(goes[s:e]).astype(np.int32) if open_rows[k] else None)
                    opened.append(spans(may[s:e]).astype(np.int32) if open_rows[k] else None)
                ints = pa.list_(pa.int32())
                columns = [pa.array(text), pa.array(n, type=pa.int64()), pa.array(np.array(kept), type=pa.int64()), pa.array(gone, type=ints), pa.array(opened, type=ints)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(3)), *columns], names=["doc_id", "doc", "part", "text", "n_words", "n_kept", "gone", "open"])

    fields = "doc_id long, doc long, part long, text string, n_words long, n_kept long, gone array<int>, open array<int>"
    return docs.select("doc_id", "doc", "part", "text", "codes").mapInArrow(look, fields)


def window_names(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all windows of words, put together from windows of half the size."""
    if width == 1:
        return a, b
    half = width // 2
    x, y = window_names(a, b, half)
    u, v = (x, y) if width == 2 * half else window_names(a, b, width - half)
    last = len(a) - width + 1
    return joined(x[:last], y[:last], u[half : half + last], v[half : half + last], 3)


def windows_from(spans_: np.ndarray) -> np.ndarray:
    """All places in the spans."""
    lo, n = spans_[::2], spans_[1::2] - spans_[::2]
    return np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def open_windows(docs: DataFrame, width: int) -> DataFrame:
    """(a, b, doc, part, code, n): the windows that may stand elsewhere, the first of each name in a document."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in sliced(batches):
            doc, part = (batch.column(k).to_numpy() for k in (0, 1))
            opened = batch.column(3)
            for lo, hi, data, begin in grouped(batch.column(2).to_pylist()):
                starts, _, a, b = words(data)
                if len(a) < width:
                    continue
                first = np.searchsorted(starts, begin)
                a, b = window_names(a, b, width)
                places = [windows_from(np.asarray(opened[k].values)) for k in range(lo, hi)]
                of = np.repeat(np.arange(hi - lo), [len(x) for x in places])
                place = np.concatenate(places)
                x, y = a[first[of] + place], b[first[of] + place]
                at, times = first_of_each(of, x, y)
                row = lo + of[at]
                columns = [x[at].view(np.int64), y[at].view(np.int64), doc[row], part[row], place[at], times]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["a", "b", "doc", "part", "code", "n"])

    return docs.select("doc", "part", "text", "open").mapInArrow(name, "a long, b long, doc long, part long, code long, n long")


def finished(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text, n_words, n_kept) of documents with ``codes``, the places of windows that stand nowhere before."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out, kept = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = text.split(" ")
                gone, opened, codes = (np.asarray(batch.column(c)[k].values if batch.column(c)[k].is_valid else [], dtype=np.int64) for c in (3, 4, 5))
                again = np.setdiff1d(windows_from(opened), codes)
                mask = coverage(np.r_[gone[::2], again], np.r_[gone[1::2], again + width], len(own))
                own = [w for w, g in zip(own, mask.tolist(), strict=True) if not g]
                out.append(" ".join(own))
                kept.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.string()), batch.column(2), pa.array(kept, type=pa.int64())], names=["doc_id", "text", "n_words", "n_kept"])

    return docs.select("doc_id", "text", "n_words", "gone", "open", "codes").mapInArrow(cut, "doc_id long, text string, n_words long, n_kept long")


def remove_repeated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, n_words, n_removed) of each row: the words that stay, joined by one space.

    A word goes if it lies in a window of ``width`` words whose words also
    start earlier: in a row of a smaller doc_id, or before in its own.  A null
    text has no words; texts of fewer words than a window stay.  Rows of one
    doc_id with unlike texts are in the order of a hash of the text; equal rows
    are one document and get the same result, a row each.  A null doc_id comes
    after all others.  Other columns are left aside.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_DOC)).alias("doc"), text.alias("text"))
    unique = not own.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    own = own.withColumn("part", F.lit(0).cast("long") if unique else F.xxhash64("text"))
    # of the first stage those that occur once, of later ones the first place
    once = (F.col("code") % (1 << STAGE_BITS) > 0) | (F.col("n") == 1)
    places = scratch.keep(first_places(symbols(own, width), unique, once))
    seen = scratch.keep(examined(own.join(places, ["doc", "part"], "left"), width))
    scratch.drop(places)
    pending, done = seen.where("open is not null"), seen.where("open is null")
    starts = first_places(open_windows(pending, width), unique, F.lit(True))
    late = finished(pending.join(starts, ["doc", "part"], "left"), width)
    every = done.select("doc_id", "text", "n_words", "n_kept").unionByName(late)
    return every.select("doc_id", "text", "n_words", (F.col("n_words") - F.col("n_kept")).alias("n_removed"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    return remove_repeated(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
