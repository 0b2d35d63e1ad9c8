"""SentencePiece encoding and decoding over a relational lattice.

A text is encoded as its words, each with the spaces before it (written as
U+2581; one is put in front of the text).  The lattice of a word has an edge
for each substring of bounded length that is in the piece table.  A character in
no piece becomes its UTF-8 bytes.  The fold over the lattice follows the
model: for a unigram model it is Viterbi, the path of the highest total
score, where equal scores prefer the longer last piece.  For a BPE model the
scores are ranks of merges, and the path is the one that the merges leave:
again and again the best edge over two neighbouring pieces joins them, the
left one of equals.  Viterbi over ranks would give other ids than the model's.

``lexicon`` builds the lattices of a table of words with relational
operators: explode the substrings, join them to the piece table, group the
edges by word and fold with ``aggregate``.  It serves the most frequent words
of the corpus, a table of bounded size that every task can hold; a word
outside it is encoded in place by the same lattice and fold.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyleaf.llm.common import STEP, tidied

SPACE = "▁"
#: Units never span these cuts, and no piece does: a space run begins a unit, a line feed is one (and keeps a word that follows at once).
UNIT = re.compile(" +[^ \n]*|\n[^ \n]*")
NO_PIECE = -1e30
UNKNOWN_PENALTY = 10.0
LEXICON_WORDS = 50_000
LEXICON_CHARS = 24
TOP_GROUPS = 64


class Pieces:
    """A piece table: text and score of each id, the byte pieces apart."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.texts, self.normal, self.bytes = [], {}, {}
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            self.texts.append(text)
            if sp.is_byte(i):
                self.bytes[int(text[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.normal[text] = (i, sp.get_score(i))
        self.longest = max(map(len, self.normal))
        self.scores = {t: s for t, (_, s) in self.normal.items()}
        ranks = [s for _, s in sorted(self.normal.values()) if s > -1e8]
        self.by_merges = all(s <= 0 and s == int(s) for s in ranks) and all(a > b for a, b in zip(ranks, ranks[1:], strict=False))
        self.unknown = min(s for _, s in self.normal.values() if s > -1e8) - UNKNOWN_PENALTY
        self.symbols, self.pairs = self.merges() if self.by_merges else ({}, ())

    def merges(self) -> tuple[dict[str, int], tuple[np.ndarray, ...]]:
        """Symbols of single characters, and (pair, piece, rank) of all pairs of symbols that are a piece, in order of pairs."""
        symbols = {t: i for t, (i, _) in self.normal.items()}
        # characters that are in pieces only get symbols of their own
        for c in sorted(set("".join(symbols))):
            symbols.setdefault(c, len(symbols) + len(self.texts))
        rank = {s: k for k, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        cuts = ((t[:k], t[k:], i, rank[s]) for t, (i, s) in self.normal.items() for k in range(1, len(t)))
        found = sorted(((symbols[a] + 1 << 32) | symbols[b] + 1, i, r) for a, b, i, r in cuts if a in symbols and b in symbols)
        keys, made, ranks = (np.array([x[k] for x in found], dtype=t) for k, t in enumerate((np.int64, np.int32, np.int32)))
        return {t: i for t, i in symbols.items() if len(t) == 1}, (keys, made, ranks)

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score); as an Arrow table it reaches Spark without Python workers, of which a list of rows starts a second set."""
        ids, scores = zip(*self.normal.values(), strict=True)
        return spark.createDataFrame(pa.table({"piece": pa.array(self.normal, pa.string()), "id": pa.array(ids, pa.int32()), "score": pa.array(scores, pa.float64())}))


def units_of(text: str) -> list[str]:
    """The units of a text, U+2581 read as a space: each without the first of its spaces, or a line feed and the word right after it."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    spread = text.replace("\n", " \n")
    if "  " in spread or spread[0] == " " or spread[-1] == " ":
        return [u[1:] if u[0] == " " else u for u in UNIT.findall(" " + text)]
    return spread.split(" ")


def viterbi(word: str, pieces: Pieces) -> tuple[int, ...]:
    """The best path through a word's lattice."""
    n, normal = len(word), pieces.normal
    best, back = [0.0] + [None] * n, [None] * (n + 1)
    for end in range(1, n + 1):
        top, by = None, None
        for start in range(max(0, end - pieces.longest), end):
            found = normal.get(word[start:end])
            if found:
                score = best[start] + found[1]
                if top is None or score > top:  # the earliest start wins ties
                    top, by = score, (start, (found[0],))
            elif start == end - 1:
                score = best[start] + pieces.unknown
                if top is None or score > top:
                    top, by = score, (start, tuple(pieces.bytes[b] for b in word[start].encode()))
        best[end], back[end] = top, by
    path, end = [], n
    while end:
        start, ids = back[end]
        path.append(ids)
        end = start
    return tuple(i for ids in reversed(path) for i in ids)


def merged(word: str, pieces: Pieces) -> tuple[int, ...]:
    """The path that merges in order of score leave."""
    normal = pieces.normal
    parts: list[str | None] = list(word)
    if len(parts) <= 24:
        score = pieces.scores.get
        ranks = list(map(score, map(add, word, word[1:]), repeat(NO_PIECE)))
        while ranks:
            best = max(ranks)
            if best == NO_PIECE:
                break
            at = ranks.index(best)
            del ranks[at]
            parts[at] = both = parts[at] + parts.pop(at + 1)
            if at:
                ranks[at - 1] = score(parts[at - 1] + both, NO_PIECE)
            if at < len(ranks):
                ranks[at] = score(both + parts[at + 1], NO_PIECE)
    else:
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < len(parts) and (found := normal.get(both := parts[k] + parts[after[k]])):
                heapq.heappush(heap, (-found[1], k, both))

        for k in range(len(parts) - 1):
            offer(k)
        while heap:
            _, k, both = heapq.heappop(heap)
            if parts[k] is None or after[k] >= len(parts) or parts[k] + parts[after[k]] != both:
                continue
            gone = after[k]
            parts[k], parts[gone], after[k] = both, None, after[gone]
            if after[k] < len(parts):
                before[after[k]] = k
            offer(before[k])
            offer(k)
    out: list[int] = []
    for part in parts:
        if part is not None:
            found = normal.get(part)
            out += (found[0],) if found else [pieces.bytes[b] for b in part.encode()]
    return tuple(out)


def segment(word: str, pieces: Pieces) -> tuple[int, ...]:
    return merged(word, pieces) if pieces.by_merges else viterbi(word, pieces)


class Merger:
    """``merged`` for many words at a time: each round joins the best pair of every word."""

    CHARS, WORDS = 24, 4096
    NONE = np.iinfo(np.int32).max

    def __init__(self, pieces: Pieces):
        self.known = len(pieces.texts)
        self.keys, self.made, self.ranks = pieces.pairs
        self.of = np.full(0x110000, -1, dtype=np.int32)
        self.of[[ord(t) for t in pieces.symbols]] = list(pieces.symbols.values())
        # pairs are found by a table of their hashes, on a clash by a search
        self.slots = np.full(1 << 20, -1, dtype=np.int32)
        self.slots[self.slot(self.keys)] = np.arange(len(self.keys))
        self.clash = np.zeros(1 << 20, dtype=bool)
        lost = self.slots[self.slot(self.keys)] != np.arange(len(self.keys))
        self.clash[self.slot(self.keys[lost])] = True

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(STEP)) >> np.uint64(44)).astype(np.int64)

    def pair(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, rank) of neighbours, NONE where they are none."""
        if not len(self.keys):
            return np.full(len(x), -1, dtype=np.int32), np.full(len(x), self.NONE, dtype=np.int32)
        keys = (x.astype(np.int64) + 1 << 32) | (y.astype(np.int64) + 1)
        slot = self.slot(keys)
        at = self.slots[slot]
        odd = np.flatnonzero(self.clash[slot])
        at[odd] = np.minimum(np.searchsorted(self.keys, keys[odd]), len(self.keys) - 1)
        fits = self.keys[at] == keys
        return np.where(fits, self.made[at], -1), np.where(fits, self.ranks[at], self.NONE)

    def chunk(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of each word, one word after the other, and their numbers."""
        n, wide = len(words), int(sizes[-1]) + 1
        place = np.arange(wide)
        real = place < sizes[:, None]
        flat = np.full((n, wide), -2, dtype=np.int32)
        flat[real] = self.of[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
        # the last column stands for the end, at which nothing is joined
        after = np.minimum(np.tile(place + 1, (n, 1)), wide - 1)
        before = np.tile(place - 1, (n, 1))
        made = np.full((n, wide), -1, dtype=np.int32)
        rank = np.full((n, wide), self.NONE, dtype=np.int32)
        both = real[:, 1:] & real[:, :-1]
        made[:, :-1][both], rank[:, :-1][both] = self.pair(flat[:, :-1][both], flat[:, 1:][both])
        alive, row = real, np.arange(n)
        while len(row):
            at = rank[row].argmin(axis=1) if len(row) < n else rank.argmin(axis=1)
            some = rank[row, at] != self.NONE
            row, at = row[some], at[some]
            gone = after[row, at]
            flat[row, at] = made[row, at]
            alive[row, gone] = False
            rank[row, gone] = self.NONE
            after[row, at] = then = after[row, gone]
            before[row, then] = at
            made[row, at], rank[row, at] = self.pair(flat[row, at], flat[row, then])
            inner = np.flatnonzero(before[row, at] >= 0)
            r, left = row[inner], before[row[inner], at[inner]]
            made[r, left], rank[r, left] = self.pair(flat[r, left], flat[r, at[inner]])
        return flat[alive], alive.sum(axis=1)

    def __call__(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Words and their packed ids, without those that are long or hold a character that is no piece."""
        words = sorted((w for w in words if 0 < len(w) <= self.CHARS), key=len)
        for lo in range(0, len(words), self.WORDS):
            some = words[lo : lo + self.WORDS]
            ids, n = self.chunk(some, np.fromiter(map(len, some), dtype=np.int64, count=len(some)))
            ends = np.cumsum(n)
            bad = np.add.reduceat((ids < 0) | (ids >= self.known), ends - n) > 0
            data = ids.astype("<i4").tobytes()
            for word, a, b, odd in zip(some, (4 * (ends - n)).tolist(), (4 * ends).tolist(), bad.tolist(), strict=True):
                if not odd:
                    yield word, data[a:b]


def lexicon(words: DataFrame, table: DataFrame, longest: int, unknown: float, first_byte: int, by_merges: bool = False) -> DataFrame:
    """(word, ids) of distinct words, by a relational lattice.

    ``table`` (piece, id, score) is small and goes to every task; the words
    stay where they are from the distinct on, so nothing else moves.
    """
    spots = words.select("word").distinct().withColumn("length", F.char_length("word")).where("length > 0")
    starts = spots.select("word", "length", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("start"))
    parts = starts.select("word", "length", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("length") - F.col("start") + 1))).alias("size"))
    parts = parts.select("word", "length", "start", (F.col("start") + F.col("size")).alias("end"), F.substring(F.col("word"), F.col("start"), F.col("size")).alias("piece"), "size")
    edges = parts.join(F.broadcast(table), "piece", "left").where("id is not null or size = 1")
    edges = edges.select("word", "length", F.struct("end", "start", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(unknown)).alias("score"), F.when(F.col("id").isNull(), F.col("piece")).alias("char")).alias("edge"))
    grouped = edges.groupBy("word", "length").agg(F.collect_list("edge").alias("edges"))
    if by_merges:
        return fold_merges(grouped, first_byte)
    path = "array<struct<score:double,start:int,id:int,char:string>>"

    def step(best: Column, end: Column) -> Column:
        into = F.filter(F.col("edges"), lambda e: e["end"] == end + 1)
        offers = F.transform(into, lambda e: F.struct((F.element_at(best, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("start"), e["id"].alias("id"), e["char"].alias("char")))
        return F.concat(best, F.array(F.array_max(offers).cast("struct<score:double,start:int,id:int,char:string>")))

    origin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(-2).alias("id"), F.lit(None).cast("string").alias("char"))).cast(path)
    folded = grouped.select("word", "length", F.aggregate(F.sequence(F.lit(1), F.col("length")), origin, step).alias("best"))

    def walk(acc: Column, end: Column) -> Column:
        here = F.element_at(F.col("best"), end + 1)
        taken = F.struct((-here["start"]).alias("want"), F.concat(ids_of(here, first_byte), acc["ids"]).alias("ids"))
        return F.when(acc["want"] == end + 1, taken).otherwise(acc)

    start = F.struct((F.col("length") + 1).alias("want"), F.array().cast("array<int>").alias("ids"))
    return folded.select("word", F.aggregate(F.reverse(F.sequence(F.lit(1), F.col("length"))), start, walk, lambda acc: acc["ids"]).alias("ids"))


def ids_of(edge: Column, first_byte: int) -> Column:
    """The id of an edge, or the byte pieces of its character."""
    hexes = F.regexp_extract_all(F.hex(F.encode(edge["char"], "UTF-8")), F.lit("[0-9A-F]{2}"), 0)
    return F.when(edge["id"] >= 0, F.array(edge["id"])).otherwise(F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("int") + first_byte))


def fold_merges(grouped: DataFrame, first_byte: int) -> DataFrame:
    """Folds lattices by merges: the state is the array of cuts that are left."""

    def step(cuts: Column, _: Column) -> Column:
        # distances of cuts: an edge over two neighbouring pieces spans two
        spans = F.filter(F.col("edges"), lambda e: (F.array_position(cuts, e["end"]) - F.array_position(cuts, e["start"]) == 2) & (F.array_position(cuts, e["start"]) > 0))
        best = F.array_max(F.transform(spans, lambda e: F.struct(e["score"].alias("score"), (-e["start"]).alias("left"))))
        inner = F.get(cuts, F.array_position(cuts, -best["left"]).cast("int"))
        return F.when(best.isNull(), cuts).otherwise(F.array_remove(cuts, inner))

    cuts = F.aggregate(F.sequence(F.lit(1), F.col("length")), F.sequence(F.lit(1), F.col("length") + 1), step)
    cut = grouped.select("word", "edges", cuts.alias("cuts"))

    def part(start: Column, k: Column) -> Column:
        mine = F.filter(F.col("edges"), lambda e: (e["start"] == start) & (e["end"] == F.get(F.col("cuts"), k + 1)))
        return ids_of(F.get(mine, F.lit(0)), first_byte)

    starts = F.slice("cuts", F.lit(1), F.size("cuts") - 1)
    return cut.select("word", F.flatten(F.transform(starts, part)).alias("ids"))


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """The ``most`` most frequent words of at most LEXICON_CHARS characters over all texts, with their space.

    Each partition's first words meet those of some others in one of TOP_GROUPS
    groups, whose first words meet in one task: that task takes at most
    TOP_GROUPS times ``most`` words, however many partitions there are.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", " ")
    words = docs.select(F.explode(F.split(text, " ")).alias("word")).where(f"word <> '' and char_length(word) < {LEXICON_CHARS} and not contains(word, '{SPACE}')")
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    w = Window.partitionBy("_group").orderBy(F.desc("n"), "word")
    first = counted.withColumn("_group", F.spark_partition_id() % TOP_GROUPS).withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most)
    return first.orderBy(F.desc("n"), "word").limit(most).select(F.concat(F.lit(SPACE), "word").alias("word"))


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    ids = tuple(ids)
    return struct.pack(f"<{len(ids)}i", *ids)


class Memory(dict):
    """Units to packed ids: the lexicon, then what was met lately (two generations)."""

    ROOM = 280_000

    def __init__(self, lexicon: dict[str, bytes], pieces: Pieces):
        super().__init__()
        self.lexicon, self.pieces, self.old = lexicon, pieces, {}
        self.merger = Merger(pieces) if pieces.by_merges else None

    def learn(self, units: Iterable[list[str]]) -> None:
        """Takes up the units of some texts that are not known yet, together."""
        if not self.merger:
            return
        fresh = set().union(*units).difference(self, self.lexicon, self.old)
        if len(self) + len(fresh) > self.ROOM:
            self.old = dict(self)
            self.clear()
        plain = (SPACE + u.replace(" ", SPACE) for u in fresh if not u.startswith("\n"))
        self.update((w[1:].replace(SPACE, " "), ids) for w, ids in self.merger(plain))

    def found(self, word: str) -> bytes:
        if not word.startswith("\n"):
            return packed(segment(SPACE + word.replace(" ", SPACE), self.pieces))
        return packed(segment("\n", self.pieces)) + packed(segment(word[1:], self.pieces))

    def __missing__(self, word: str) -> bytes:
        found = self.lexicon.get(word) or self.old.get(word)
        if found is None:
            found = self.found(word)
        if len(word) <= 64:
            if len(self) >= self.ROOM:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Decoder:
    """Text of a sequence of ids; runs of byte pieces are read as UTF-8."""

    def __init__(self, texts: list[str], byte_of: dict[int, int]):
        self.texts, self.byte_of = texts, byte_of
        # each byte below 128 is a character by itself
        self.plain = [t.replace(SPACE, " ") if byte_of.get(i, 128) > 127 else chr(byte_of[i]) for i, t in enumerate(texts)]
        self.high = np.array([byte_of.get(i, 0) > 127 for i in range(len(texts))])

    def __call__(self, ids: np.ndarray) -> str:
        if not self.high[ids].any():
            text = "".join(map(self.plain.__getitem__, ids.tolist()))
            return text[1:] if text.startswith(" ") else text
        out, held = [], bytearray()
        for i in ids.tolist():
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.texts[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def decode_ids(ids: list[int], texts: list[str], byte_of: dict[int, int]) -> str:
    return Decoder(texts, byte_of)(np.array(ids, dtype=np.int32))


def broadcast_lexicon(docs: DataFrame, pieces: Pieces, most: int) -> dict[str, bytes]:
    table = pieces.table(docs.sparkSession)
    found = lexicon(frequent_words(docs, most), table, pieces.longest, pieces.unknown, pieces.bytes[0], pieces.by_merges)
    return {r.word.removeprefix(SPACE): packed(r.ids) for r in found.toLocalIterator()}


def _mapped(docs: DataFrame, extra: list, work) -> DataFrame:
    """All columns of ``docs`` and those of ``extra`` that ``work`` makes of texts, a few hundred rows at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = {f.name for f in extra}
    docs = docs.select(*[c for c in docs.columns if c not in names])
    schema = StructType([*docs.schema.fields, *extra])
    source, width = (docs.columns.index("text") if "text" in docs.columns else -1), len(docs.columns)
    ids_at = docs.columns.index("ids") if "ids" in docs.columns else -1

    def run(batches):
        target = to_arrow_schema(schema)
        rows = work()
        for whole in batches:
            for lo in range(0, max(whole.num_rows, 1), 500):
                batch = whole.slice(lo, 500)
                made = rows(batch.column(source).to_pylist() if source >= 0 else None, batch.column(ids_at).to_pylist() if ids_at >= 0 else None)
                kept = [batch.column(k).cast(target.field(k).type) for k in range(width)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, type=target.field(width + k).type) for k, c in enumerate(made))], names=target.names)

    return docs.mapInArrow(tidied(run), schema)


def encode(docs: DataFrame, model_file: str, most: int = LEXICON_WORDS) -> DataFrame:
    """All columns of ``docs`` and ``ids`` (array<int>); null and empty texts have no ids.

    Clashes: an own column named ids is replaced.  The model file's path must
    be readable on the driver; tasks get the table.
    """
    from pyspark.sql.types import ArrayType, IntegerType, StructField

    pieces = Pieces(model_file)
    words = broadcast_lexicon(docs, pieces, most)

    def work():
        memory = Memory(words, pieces)
        return lambda texts, _: ([encoded(t, memory) for t in texts],)

    return _mapped(docs.drop("ids"), [StructField("ids", ArrayType(IntegerType()))], work)


def encoded(text: str | None, memory: Memory) -> list[int]:
    units = units_of(text or "")
    memory.learn([units])
    return np.frombuffer(b"".join(map(memory.__getitem__, units)), dtype="<i4").tolist()


def decode(coded: DataFrame, model_file: str) -> DataFrame:
    """All columns and ``decoded``, the text of ``ids`` (null ids: empty).

    It equals the encoded text but where that holds U+2581 itself, which
    comes back as a space.
    """
    from pyspark.sql.types import StringType, StructField

    pieces = Pieces(model_file)
    texts, byte_of = pieces.texts, {i: b for b, i in pieces.bytes.items()}

    def work():
        decoder = Decoder(texts, byte_of)
        return lambda _, ids: ([decoder(np.array(x or [], dtype=np.int32)) for x in ids],)

    return _mapped(coded, [StructField("decoded", StringType())], work)


def encode_digest(docs: DataFrame, model_file: str, most: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip): encodes, decodes and compares in one task.

    The digest is of the ids as little-endian 32-bit integers; the round trip
    takes U+2581 for a space, as the decoder must.
    """
    from pyspark.sql.types import BooleanType, LongType, StringType, StructField

    pieces = Pieces(model_file)
    words = broadcast_lexicon(docs, pieces, most)
    byte_of = {i: b for b, i in pieces.bytes.items()}

    def work():
        memory, decoder = Memory(words, pieces), Decoder(pieces.texts, byte_of)

        def rows(texts, _):
            sizes, shas, trips = [], [], []
            units = [units_of(t or "") for t in texts]
            memory.learn(units)
            for text, parts in zip(texts, units, strict=True):
                data = b"".join(map(memory.__getitem__, parts))
                ids = np.frombuffer(data, dtype="<i4")
                sizes.append(len(ids))
                shas.append(hashlib.sha256(data).hexdigest())
                trips.append(decoder(ids) == (text or "").replace(SPACE, " "))
            return sizes, shas, trips

        return rows

    extra = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("round_trip", BooleanType())]
    return _mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), extra, work).drop("text")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
