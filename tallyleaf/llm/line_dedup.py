"""Line dedup: exact set-similarity join of lines.

The tokens of a line are its distinct 5-word shingles (a shorter line has its
whole word sequence as its one token); words are folded to lower case.  Lines
of the same tokens are one class, for which its first line speaks.  Tokens are
put in order of rarity: how common the slot of the leading word is over all
texts, then the token's hash.  Each class is indexed under its prefix only,
and pairs pass a length and a positional filter before their Jaccard
similarity is verified.  A line goes if a line before it (by doc_id, then
place) has a similarity of at least 0.75; lines without words stay.

A line needs one match only.  So each is first held against two lines of its
lists, the earliest and the one with most copies, and only lines without a
match meet the other lines before them.  They do so in lists of fewer than
LONG lines; lines with a longer list are looked at with all their tokens, and
those of long lists go to the end of the order, so that the rest meets in
short lists again.  What is left are lines made of long lists for the most
part; they are held against the first unmatched line of their lists, and then,
still without a match, against all earlier lines of their lists.

Words are cut and hashed in NumPy, a megabyte of text at a time, because the
DataFrame form of this took most of the time allowed; all joins, counts and
filters are DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.llm.common import sliced, tidied
from tallyleaf.llm.ngram_join import P1, P2, Shingler, folded
from tallyleaf.llm.state import Scratch

WIDTH = 5
PERCENT = 75
#: How common words are is held for this many slots, whatever the input.
SLOT_BITS = 15
#: Bitmaps have 32 bits a key up to this size; beyond it they let more keys through.
MOST_BITS = 26
#: So many longs of a bitmap (two to this power) are put together at a time.
PART_BITS = 12
#: Lists of this many lines and more are long.
LONG = 24
#: Lines made of long lists are held against so many lines of their lists, besides the first unmatched one, before they meet all.
SEEDS = 7
LAST_DOC = (1 << 63) - 1
#: Bytes of text that are cut at a time (a longer text is a group of its own).
GROUP = 1 << 20


def text_column() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def named(docs: DataFrame) -> DataFrame:
    """(doc, part, text): part is a hash that tells rows of one doc_id with different texts apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_DOC)).alias("doc"), F.xxhash64(text_column()).alias("part"), text_column().alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(at, line): at is the doc_id, the part and the place."""
    placed = named(docs).select("doc", "part", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return placed.select(F.struct("doc", "part", "place").alias("at"), "line")


def groups(texts: list[str]) -> Iterator[tuple[int, int, bytes]]:
    """(lo, hi, data): texts from lo to hi, folded to lower case, with a line feed between them."""
    lo, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(text.lower().encode())
        size += len(held[-1]) + 1
        if size >= GROUP or k + 1 == len(texts):
            yield lo, k + 1, b"\n".join(held)
            lo, held, size = k + 1, [], 0


class Tokens:
    """The tokens of all lines of a group: line numbers, hashes and slots of the leading word, in no order."""

    def __init__(self):
        self.words = Shingler().words

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.frombuffer(data, dtype=np.uint8)
        starts, h = self.words(b)
        line = np.searchsorted(np.flatnonzero(b == 10), starts)
        of, keys, slots = [], [], []
        for width in range(1, WIDTH + 1):
            if len(h) < width:
                break
            last = len(h) - width + 1
            fits = line[:last] == line[width - 1 :]
            if width < WIDTH:
                # the whole of a short line: no word of it before, none after
                fits &= np.r_[True, line[1:last] != line[: last - 1]]
                fits[: last - 1] &= line[width:] != line[: last - 1]
            at = np.flatnonzero(fits)
            of.append(line[at])
            keys.append(folded(h, width)[at])
            slots.append((h[at] >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
        if not of:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.concatenate(of), np.concatenate(keys), np.concatenate(slots)


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each slot by how common its words are over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = Shingler().words, np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in sliced(batches):
            for _, _, data in groups(batch.column(0).to_pylist()):
                h = words(np.frombuffer(data, dtype=np.uint8))[1]
                n += np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["slot", "n"])

    counts = docs.select(text_column().alias("text")).mapInArrow(tidied(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    n = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for r in counts.toLocalIterator():
        n[r.slot] = r.n
    rank = np.empty(len(n), dtype=np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(len(n))
    return rank


def prefixes(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """(doc, part, place, a, b, n, reach, prefix) of each line with words: class, number of tokens, last token of the prefix and its tokens."""
    names = ["doc", "part", "place", "a", "b", "n", "reach", "prefix"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in sliced(batches):
            doc, part = (batch.column(k).to_numpy() for k in (0, 1))
            texts = batch.column(2).to_pylist()
            for lo, hi, data in groups(texts):
                line, key, slot = tokens(data)
                if not len(line):
                    continue
                # rank, then 48 bits of the hash: a token and its place in the order
                token = rank[slot] << 48 | (key >> np.uint64(16)).astype(np.int64)
                order = np.lexsort((token, line))
                line, token, key = line[order], token[order], key[order]
                first = np.r_[True, (line[1:] != line[:-1]) | (token[1:] != token[:-1])]
                line, token, key = line[first], token[first], key[first]
                start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
                n = np.diff(np.r_[start, len(line)])
                own = n - -(-PERCENT * n // 100) + 1
                # a line of one token is similar to those of its class only
                own[n == 1] = 0
                held = np.arange(len(line)) - np.repeat(start, n) < np.repeat(own, n)
                a, b = (np.add.reduceat((key ^ key >> np.uint64(s)) * p, start) for s, p in ((31, P1), (33, P2)))
                at = line[start]
                breaks = np.cumsum([0, *(t.count("\n") + 1 for t in texts[lo : hi - 1])])
                of = np.searchsorted(breaks, at, side="right") - 1
                columns = [doc[lo + of], part[lo + of], (at - breaks[of]).astype(np.int32), a.view(np.int64), (b >> np.uint64(32)).astype(np.uint32).view(np.int32), n.astype(np.int32), token[start + np.maximum(own, 1) - 1]]
                prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(own)].astype(np.int32)), pa.array(token[held]))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), prefix], names=names)

    return named(docs).mapInArrow(tidied(describe), "doc long, part long, place int, a long, b int, n int, reach long, prefix array<long>")


def token_sets(lines: DataFrame) -> DataFrame:
    """(id, set) of lines (id, line) with words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in sliced(batches, 10_000):
            ids = batch.column(0).to_numpy()
            for lo, _, data in groups(batch.column(1).to_pylist()):
                line, key, _ = tokens(data)
                order = np.lexsort((key, line))
                line, key = line[order], key[order]
                first = np.r_[True, (line[1:] != line[:-1]) | (key[1:] != key[:-1])][: len(line)]
                line, key = line[first], key[first]
                start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]][: len(line)])
                sets = pa.ListArray.from_arrays(pa.array(np.r_[start, len(line)].astype(np.int32)), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + line[start]]), sets], names=["id", "set"])

    return lines.select("id", "line").mapInArrow(tidied(cut), "id long, set array<long>")


class Marks:
    """A bitmap over hashed keys (a table of one column ``key``), of bounded size."""

    def __init__(self, keys: DataFrame, scratch: Scratch):
        n = max(keys.count(), 1)
        self.bits = min(MOST_BITS, max(18, math.ceil(math.log2(32 * n))))
        at = F.shiftrightunsigned("key", 64 - self.bits)
        longs = 1 << self.bits - 6
        own = keys.select(F.shiftright(at, 6).alias("long"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
        every = keys.sparkSession.range(longs).select(F.col("id").alias("long"), F.lit(0).cast("long").alias("bits"))
        joined = own.unionByName(every).groupBy("long").agg(F.bit_or("bits").alias("bits"))
        parts = joined.groupBy(F.shiftright("long", PART_BITS).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("long", "bits"))), lambda x: x["bits"]).alias("bits"))
        whole = parts.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "bits"))), lambda x: x["bits"])).alias("bits"))
        self.table = scratch.keep(whole)

    def hold(self, key: Column) -> Column:
        at = F.shiftrightunsigned(key, 64 - self.bits)
        return F.getbit(F.get(self.table.scalar(), F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose sets reach the similarity."""
    x, y = (sets.select(F.col("id").alias(k), F.col("set").alias(f"s{k}")) for k in "xy")
    both = pairs.select("x", "y").join(x, "x").join(y, "y")
    common = F.size(F.array_intersect("sx", "sy"))
    return both.where(100 * common >= PERCENT * (F.size("sx") + F.size("sy") - common)).select("x", "y")


def met(left: DataFrame, right: DataFrame, fits: str) -> DataFrame:
    """(x, y): lines, as structs, with the same token, x before y, that the length filter lets through."""
    both = left.select("token", F.col("line").alias("x")).join(right.select("token", F.col("line").alias("y")), "token")
    return both.where("x.first < y.first").where(fits).select("x", "y")


#: Length filter, and the one where the number of repeated tokens is known too.
LENGTHS_FIT = f"100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)"
REPEATS_FIT = f"{100 + PERCENT} * least(x.again, y.again) >= {PERCENT} * (x.n + y.n)"


def ids() -> list[Column]:
    return [F.col(f"{k}.id").alias(k) for k in "xy"]


def counted(both: DataFrame) -> DataFrame:
    """(x, y): pairs of lines whose common tokens can be enough.

    Of two prefixes the one that ends first holds all common tokens up to its
    end; beyond it lies at most the rest of its line.
    """
    shared = both.groupBy(*ids()).agg(F.count(F.lit(1)).alias("c"), *[F.min(f"{k}.{f}").alias(f"{k}_{f}") for k in "xy" for f in ("n", "reach", "own")])
    rest = F.when(F.col("x_reach") <= F.col("y_reach"), F.col("x_n") - F.col("x_own")).otherwise(F.col("y_n") - F.col("y_own"))
    return shared.where((100 + PERCENT) * (F.col("c") + rest) >= PERCENT * (F.col("x_n") + F.col("y_n"))).select("x", "y")


def stars(posting: DataFrame, lines: DataFrame, hubs: list[Column]) -> DataFrame:
    """(x, y): for each line y of ``lines`` the few lines before it (as many as kinds of hubs) that are hubs of most of its lists in ``posting``."""
    found = posting.groupBy("token").agg(*[h.alias(f"h{k}") for k, h in enumerate(hubs)])
    both = lines.select("token", F.col("line").alias("y")).join(found, "token")
    both = both.select("y", F.explode(F.array_distinct(F.array(*[F.col(f"h{k}") for k in range(len(hubs))]))).alias("x"))
    best = both.where("x.first < y.first").where(LENGTHS_FIT).groupBy(*ids()).agg(F.count(F.lit(1)).alias("c"))
    # at most the tokens of a line's prefix times the kinds of hubs are sorted here
    top = best.groupBy("y").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "x")), False), 1, len(hubs)).alias("top"))
    return top.select(F.explode("top.x").alias("x"), "y")


def any_of(seed: int) -> Column:
    """One line of a list, another for each seed."""
    return F.min(F.struct(F.xxhash64("line.id", F.lit(seed)).alias("h"), "line"))["line"]


def line_id(at: str) -> Column:
    return F.xxhash64(F.col(f"{at}.doc"), F.col(f"{at}.part"), F.col(f"{at}.place"))


def sets_of(docs: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, set) of the given lines (first) and of few others; texts without one of them are not split."""
    doc = F.xxhash64("first.doc", "first.part")
    marks = Marks(lines.select(F.explode(F.array(doc, line_id("first"))).alias("key")), scratch)
    some = docs.select("doc_id", "text").where(marks.hold(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_DOC)), F.xxhash64(text_column()))))
    found = lines_of(some).select(line_id("at").alias("id"), "line").where(marks.hold(F.col("id")))
    sets = scratch.keep(token_sets(found))
    scratch.drop(marks.table)
    return sets


def short_lists(sets: DataFrame, lines: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(x, y) that share enough tokens of short lists, over whole sets, y being open; and facts of each line.

    Facts: n, how many tokens are in long lists, how many are in any list of
    two lines or more (``again``).
    """
    every = sets.select("id", F.explode("set").alias("token"))
    key = F.xxhash64("token")
    counts = scratch.keep(every.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    long, short = (Marks(counts.where(c).select(key.alias("key")), scratch) for c in (F.col("n") >= LONG, F.col("n") < LONG))
    of_long, of_short = long.hold(key), short.hold(key)
    facts = scratch.keep(every.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(of_long).alias("long"), F.count_if(of_long | of_short).alias("again")))
    known = lines.join(facts, "id").select("id", "open", F.struct("first", "id", "n", "long").alias("line"))
    posting = every.where(of_short & ~of_long).join(known, "id").select("token", "open", "line")
    near = met(posting, posting.where("open"), LENGTHS_FIT).groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    pairs = scratch.keep(near.where(f"{100 + PERCENT} * (c + least(x.long, y.long)) >= {PERCENT} * (x.n + y.n)").select(*ids()))
    scratch.drop(counts, long.table, short.table)
    return pairs, facts


def similar_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, part, place) of every line that goes."""
    described = scratch.keep(prefixes(docs, rarity(docs)).select(F.struct("doc", "part", "place").alias("at"), "a", "b", "n", "reach", "prefix"))
    speaker = F.min(F.struct("at", "n", "reach", "prefix")).alias("s")
    lead = described.groupBy("a", "b").agg(speaker, F.count(F.lit(1)).cast("int").alias("copies"))
    lead = scratch.keep(lead.select("a", "b", "copies", F.col("s.at").alias("first"), "s.n", "s.reach", "s.prefix"))
    # prefixes are large: tables that are needed to the end go on without them
    places = scratch.keep(described.select("at", "a", "b"))
    scratch.drop(described)
    twice = scratch.keep(lead.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("len")).where("len > 1"))
    repeated = Marks(twice.select(F.xxhash64("token").alias("key")), scratch)
    line = F.struct("first", line_id("first").alias("id"), "n", "reach", F.size("prefix").alias("own")).alias("line")
    posting = lead.select(line, "copies", F.explode("prefix").alias("token")).where(repeated.hold(F.xxhash64("token")))
    posting = scratch.keep(posting.join(twice, "token"))
    leads = scratch.keep(lead.select("a", "b", "first", "copies"))
    scratch.drop(lead, twice, repeated.table)
    lines = scratch.keep(posting.groupBy("line.id", "line.first").agg(F.max("len").alias("len")))
    sets = sets_of(docs, lines, scratch)

    # each line against hubs of its lists; only lines without a match go on
    hubs = [F.min("line"), F.min(F.struct((-F.col("copies")).alias("copies"), "line"))["line"]]
    tried = scratch.keep(stars(posting, posting, hubs))
    matched = scratch.keep(similar(tried, sets).select(F.col("y").alias("id")).distinct())
    state = scratch.keep(lines.join(matched.withColumn("hit", F.lit(True)), "id", "left").select("id", "first", "len", F.col("hit").isNull().alias("open")))
    posting_open = posting.join(state.select(F.col("id").alias("own_id"), "open"), F.col("line.id") == F.col("own_id")).drop("own_id")
    posting_open = scratch.keep(posting_open)
    scratch.drop(posting, lines)

    # pairs of which one line at least has short lists only
    short = posting_open.where(F.col("len") < LONG)
    pairs = scratch.keep(counted(met(short, short.where("open"), LENGTHS_FIT)))
    # lines with a long list: all their tokens are looked at
    busy = scratch.keep(state.where(F.col("len") >= LONG).select("id", "first", "open"))
    # equal rows have equal lines, of which one counts
    more, facts = short_lists(sets.join(busy.select("id"), "id", "left_semi").dropDuplicates(["id"]), busy, scratch)
    every = scratch.keep(pairs.union(more).distinct().join(tried, ["x", "y"], "left_anti"))
    hits = scratch.keep(similar(every, sets).select(F.col("y").alias("id")).union(matched).distinct())
    # lines that consist of long lists: against the first unmatched ones, then, still without a match, against all
    heavy = facts.where(f"n - long < n - ceil(n * {PERCENT} / 100.0) + 1").select("id", "again")
    among = posting_open.join(heavy, F.col("line.id") == heavy.id).select("token", "open", F.struct("line.first", "line.id", "line.n", "again", "line.reach", "line.own").alias("line"))
    among = scratch.keep(among.join(hits.select(F.col("id").alias("hit")), F.col("line.id") == F.col("hit"), "left").withColumn("open", F.col("hit").isNull()).drop("hit"))
    again = scratch.keep(stars(among, among.where("open"), [F.min(F.when(F.col("open"), F.col("line"))), *map(any_of, range(SEEDS))]).join(every, ["x", "y"], "left_anti"))
    late = scratch.keep(similar(again, sets).select(F.col("y").alias("id")).distinct())
    opened = among.where("open").join(late.select(F.col("id").alias("hit")), F.col("line.id") == F.col("hit"), "left_anti")
    seen = every.union(tried).union(again)
    rest = scratch.keep(counted(met(among, opened, f"{LENGTHS_FIT} and {REPEATS_FIT}")).join(seen, ["x", "y"], "left_anti"))
    hits = scratch.keep(similar(rest, sets).select(F.col("y").alias("id")).union(hits).union(late).distinct().withColumn("hit", F.lit(True)))
    scratch.drop(posting_open, pairs, busy, state, sets, more, facts, among, every, rest, tried, matched, again, late)

    # a class goes whole if its first line has a match before it, else but for that line
    gone = leads.select("a", "b", "first", "copies", line_id("first").alias("id")).join(hits, "id", "left").where("hit or copies > 1")
    out = scratch.keep(places.select("a", "b", "at").join(gone, ["a", "b"]).where("hit or at > first").select("at.doc", "at.part", "at.place").distinct())
    scratch.drop(places, leads, hits)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) with ``text`` rid of the lines that go, and ``n_removed_lines``.

    A null text stays null.  Equal rows (doc_id and text) are one document
    and keep the same lines; a null doc_id comes after all others.  A row
    stays even if no line does.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    gone = similar_lines(docs, scratch).groupBy(F.col("doc").alias("__doc"), F.col("part").alias("__part")).agg(F.sort_array(F.collect_list("place")).alias("__gone"))
    gone = scratch.keep(gone)
    changed = Marks(gone.select(F.xxhash64("__doc", "__part").alias("key")), scratch)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_DOC)), "__part": F.xxhash64(text)})
    marked = changed.hold(F.xxhash64("__doc", "__part"))
    joined = keyed.where(marked).join(gone, ["__doc", "__part"], "left")
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.array_join(F.transform(F.filter(numbered, lambda s: ~F.array_contains(F.col("__gone"), s["i"])), lambda s: s["x"]), "\n")
    cut = joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).withColumn("n_removed_lines", F.coalesce(F.size("__gone"), F.lit(0)))
    # texts that lose no line do not move
    whole = keyed.where(~marked).withColumn("n_removed_lines", F.lit(0))
    return whole.drop("__doc", "__part").unionByName(cut.drop("__doc", "__part", "__gone"))
