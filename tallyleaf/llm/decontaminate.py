"""Benchmark decontamination: BM25 index of test items, block-max WAND, overlap check.

The index has the test items' word trigrams as terms.  A posting holds the
BM25 impact of the term in its item as a share of the item's score against
itself, so one threshold suits items of every length.  Every passage of every
training document is a query; WAND with per-block maxima skips items that
can't reach the threshold, and retrieves all that do.  What is retrieved is
kept if the passage covers enough of the item's question and of its answer.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyleaf.llm.common import map_texts, sliced, tidied

WORDS = re.compile(r"\w+")
N = 3
K1, B = 1.2, 0.75
BLOCK = 16
BLOCK_ITEMS = 50_000
BLOCK_WORDS = 1_000_000
#: Words a vocabulary may have for three to fit in one 64-bit key.
EXACT = 1 << 21


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words: the last sentence is the answer, or the last third of a lone sentence."""
    words = WORDS.findall(text.lower())
    cuts = [m.end() for m in re.finditer(r"[.!?\n]+\s*", text.rstrip(" .!?\n\t"))]
    n = len(WORDS.findall(text[: cuts[-1]].lower())) if cuts else 0
    if n < N or len(words) - n < N:
        n = len(words) - max(N, len(words) // 3)
    return (words[:n], words[n:]) if n >= N else (words, words)


def grams(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[k : k + N]) for k in range(len(words) - N + 1)]


def room(n: int) -> int:
    """Length class of an item of n words: the least of 2, 3, 4, 6, 8, 12, ... that holds it; its passages have twice as many words."""
    size = 1 << max(n - 1, 1).bit_length()
    return 3 * size // 4 if 4 * n <= 3 * size else size


class Index:
    """Postings by term: items ascending, impacts, and the maximum of each block.

    Items are numbered by length class, so a class is a range of numbers.
    ``whole`` has what is known of the whole benchmark where the items are a
    part: how many items, their mean length, and in how many a term is.
    """

    def __init__(self, items: list[tuple[int, str]], whole: tuple[int, float, dict[tuple[str, ...], int]] | None = None):
        self.items, docs = [], []
        rooms = []
        order = lambda x: (room(len(WORDS.findall((x[1] or "").lower()))), x[0] is not None, x[0] or 0, x[1] or "")
        for item_id, text in sorted(items, key=order):
            words = WORDS.findall((text or "").lower())
            if len(words) >= N:
                question, answer = parts(text)
                self.items.append((item_id, frozenset(grams(question)), frozenset(grams(answer))))
                docs.append(Counter(grams(words)))
                rooms.append(room(len(words)))
        self.vocabulary: dict[str, int] = {}
        for d in docs:
            for g in d:
                for w in g:
                    self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        count, mean, df = whole or (len(docs), sum(sum(d.values()) for d in docs) / max(len(docs), 1), Counter(g for d in docs for g in d))
        self.postings: dict[tuple[str, ...], tuple[list[int], list[float], list[float], float]] = {}
        raw = defaultdict(list)
        for k, d in enumerate(docs):
            length = sum(d.values())
            weights = {g: math.log(1 + (count - df[g] + 0.5) / (df[g] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)) for g, tf in d.items()}
            whole = sum(weights.values())
            for g, x in weights.items():
                raw[g].append((k, x / whole))
        for g, found in raw.items():
            ids, impacts = [k for k, _ in found], [x for _, x in found]
            tops = [max(impacts[b : b + BLOCK]) for b in range(0, len(impacts), BLOCK)]
            self.postings[g] = (ids, impacts, tops, max(tops))
        sizes = sorted(set(rooms))
        #: (words, first item, end) of each length class.
        self.classes = [(size, bisect.bisect_left(rooms, size), bisect.bisect_right(rooms, size)) for size in sizes]
        base = len(self.vocabulary) + 1
        self.exact = base < EXACT
        if self.exact:
            keys = {(self.vocabulary[a] << 42) | (self.vocabulary[b] << 21) | self.vocabulary[c]: (a, b, c) for a, b, c in self.postings}
            self.keys = np.array(sorted(keys), dtype=np.int64)
            self.terms = [keys[k] for k in self.keys.tolist()]
        else:
            self.terms = sorted(self.postings)
        self.slots = {} if self.exact else {t: k for k, t in enumerate(self.terms)}
        #: Length classes of each term's items, a bit for each.
        self.held = np.array([sum({1 << sizes.index(rooms[k]) for k in self.postings[t][0]}) for t in self.terms], dtype=np.int64)

    def retrieve(self, terms: list[tuple[str, ...]], threshold: float, first: int = 0, end: int | None = None) -> Iterator[tuple[int, float]]:
        """Block-max WAND: every item from ``first`` to before ``end`` whose share reaches the threshold."""
        lists = [self.postings[t] for t in terms]
        at = [bisect.bisect_left(ids, first) for ids, _, _, _ in lists]
        stop = len(self.items) if end is None else end
        live = list(range(len(lists)))
        eps = 1e-9
        while True:
            live = [k for k in live if at[k] < len(lists[k][0]) and lists[k][0][at[k]] < stop]
            live.sort(key=lambda k: lists[k][0][at[k]])
            total, pivot = 0.0, None
            for n, k in enumerate(live):
                total += lists[k][3]
                if total >= threshold - eps:
                    pivot = n
                    break
            if pivot is None:
                return
            item = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
                pivot += 1
            ahead = live[: pivot + 1]
            bound, upto = 0.0, None
            for k in ahead:  # the blocks where the pivot would be
                ids, _, tops, _ = lists[k]
                pos = bisect.bisect_left(ids, item, at[k])
                if pos < len(ids):
                    b = pos // BLOCK
                    bound += tops[b]
                    last = ids[min((b + 1) * BLOCK, len(ids)) - 1]
                    upto = last if upto is None else min(upto, last)
            if bound >= threshold - eps:
                score = 0.0
                for k in ahead:
                    ids, impacts, _, _ = lists[k]
                    at[k] = bisect.bisect_left(ids, item, at[k])
                    if at[k] < len(ids) and ids[at[k]] == item:
                        score += impacts[at[k]]
                        at[k] += 1
                if score >= threshold - eps:
                    yield item, score
            else:  # no item up to the first block's end can reach it
                follow = upto + 1
                if pivot + 1 < len(live):
                    follow = min(follow, lists[live[pivot + 1]][0][at[live[pivot + 1]]])
                follow = max(follow, item + 1)
                for k in ahead:
                    at[k] = bisect.bisect_left(lists[k][0], follow, at[k])


def searcher(index: Index, threshold: float, overlap: float):
    def start():
        vocabulary = index.vocabulary.get

        def hits(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if not index.exact:
                slot = np.array([index.slots.get(g, -1) for g in grams(words)], dtype=np.int64)
                at = np.flatnonzero(slot >= 0)
                return at, slot[at]
            ids = np.fromiter((vocabulary(w, 0) for w in words), dtype=np.int64, count=len(words))
            known = ids > 0
            at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
            if not len(at):
                return at, at
            key = (ids[at] << 42) | (ids[at + 1] << 21) | ids[at + 2]
            slot = np.minimum(np.searchsorted(index.keys, key), len(index.keys) - 1)
            real = index.keys[slot] == key
            return at[real], slot[real]

        def of(text: str) -> list[tuple]:
            words = WORDS.findall(text.lower())
            if len(words) < N or not index.terms:
                return []
            every, slots = hits(words)
            best: dict[int, tuple] = {}
            for bit, (half, first, end) in enumerate(index.classes) if len(every) else ():
                own = index.held[slots] >> bit & 1 == 1
                at, slot = every[own], slots[own]
                for k in np.unique(np.concatenate([at // half, at // half - 1])).tolist() if len(at) else ():
                    if k < 0:
                        continue
                    lo, hi = np.searchsorted(at, [k * half, k * half + 2 * half - N + 1])
                    terms = [index.terms[s] for s in sorted(set(slot[lo:hi].tolist()))]
                    if not terms or sum(index.postings[t][3] for t in terms) < threshold - 1e-9:
                        continue
                    here = set(terms)
                    for item, score in index.retrieve(terms, threshold, first, end):
                        item_id, question, answer = index.items[item]
                        q, a = len(question & here) / len(question), len(answer & here) / len(answer)
                        if q >= overlap and a >= overlap and (item not in best or score > best[item][1]):
                            best[item] = (item_id, score, q, a, k)
            return [best[i] for i in sorted(best)]

        return lambda texts: (([tuple(x) for x in of(t)],) for t in texts)

    return start


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, passage) of every leak.

    Passages of an item are windows of twice its length class, half
    overlapping, so it lies whole in one and other items don't matter.  The
    index goes out in blocks of BLOCK_ITEMS items and about BLOCK_WORDS words,
    which bounds what a task holds; term and length statistics are those of
    the whole benchmark.  Null and empty texts,
    and items under three words, match nothing; repeated items each count.
    """
    out = None
    for index in indexes(benchmark):
        found = map_texts(docs, searcher(index, threshold, overlap), "leaks array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,passage:int>>")
        found = found.where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
        out = found if out is None else out.unionByName(found)
    return out


def described(benchmark: DataFrame) -> tuple[DataFrame, int, float]:
    """Items by length and id with their terms' item counts, how many items there are, and their mean length in terms.

    Rows are (item_id, text, copies, n, df), where df has a struct of term and
    items for each term; items under N words are left out.
    """

    def run(batches):
        for batch in batches:
            words = [WORDS.findall(t.lower()) for t in batch.column(1).to_pylist()]
            terms = [sorted({" ".join(g) for g in grams(w)}) for w in words]
            new = [pa.array([len(w) for w in words], type=pa.int64()), pa.array(terms, type=pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=["item_id", "text", "copies", "n", "terms"])

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    items = items.mapInArrow(tidied(run), "item_id long, text string, copies long, n long, terms array<string>").where(F.col("n") >= N)
    count, length = items.agg(F.sum("copies"), F.sum(F.col("copies") * (F.col("n") - N + 1))).first()
    single = items.select("item_id", "text", "copies", "n", F.explode("terms").alias("term"))
    df = single.groupBy("term").agg(F.sum("copies").alias("items"))
    joined = single.join(df, "term").groupBy("item_id", "text", "copies", "n").agg(F.collect_list(F.struct("term", "items")).alias("df"))
    return joined.orderBy("n", "item_id", "text"), count or 0, (length or 0) / max(count or 0, 1)


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """An index for each block of the benchmark; one that is empty without items."""
    items, count, mean = described(benchmark)
    block: list[tuple[int, str]] = []
    df: dict[tuple[str, ...], int] = {}
    words = 0
    for r in items.toLocalIterator():
        if block and (len(block) + r.copies > BLOCK_ITEMS or words + r.n > BLOCK_WORDS):
            yield Index(block, (count, mean, df))
            block, df, words = [], {}, 0
        block += [(r.item_id, r.text)] * r.copies
        df.update((tuple(term.split(" ")), n) for term, n in r.df)
        words += r.n
    if block or not count:
        yield Index(block, (count, mean, df))


def remove_leaking(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no leak.

    Each row is judged by its own text, whatever its doc_id, null and repeated
    ones included; a pass for each block of items, and texts do not move.
    """
    at = docs.columns.index("text")

    def without(start):
        def run(batches):
            rows = start()
            for batch in sliced(batches):
                keep = [not found for (found,) in rows([t or "" for t in batch.column(at).to_pylist()])]
                yield batch.filter(pa.array(keep, type=pa.bool_()))

        return run

    schema = docs.schema
    for index in indexes(benchmark):
        docs = docs.mapInArrow(tidied(without(searcher(index, threshold, overlap))), schema)
    return docs
