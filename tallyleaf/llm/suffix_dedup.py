"""Removal of long repeated strings by suffix arrays built with two-stage sorting.

Every 200-byte string of a text belongs to one anchor, the least hash of the
32-byte strings in it, so equal strings have equal anchors.  Only strings
whose anchor occurs twice with the same 84 bytes before or after it are looked
at: they travel in pieces (the strings of one anchor occurrence overlap) to a
bucket of their anchor.  A bucket
joins its distinct pieces and sorts their suffixes in two stages: suffixes
smaller than their successors are sorted directly, the rest are induced by
scanning the buckets of the first byte in order.  Neighbours in that order
with 200 bytes in common are repeats.

An anchor with very many occurrences is dealt out over several buckets;
what is single in its bucket is then counted across buckets by the digest of
its 200 bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyleaf.llm.common import STEP, Powers, sliced
from tallyleaf.llm.state import Packed, Scratch

LENGTH = 200
GRAM = 32
SPAN = LENGTH - GRAM + 1
#: Bytes on one side of an anchor that any string around it has at least.
SIDE = (LENGTH - GRAM) // 2
SEGMENT = 1 << 23
BITMAP_BITS = 27
BUCKET_BYTES = 4_000_000
#: Occurrences of an anchor beyond which its pieces are dealt over several buckets.
HOT = 20_000
FLUSH = 2_000_000
LOW24 = np.uint64((1 << 24) - 1)


class Hashes:
    """Hashes of substrings of a text, by prefix sums."""

    def __init__(self, b: np.ndarray, powers: Powers):
        self.up, down = powers(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(b * down[: len(b)], out=self.sums[1:])

    def mixed(self, h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h

    def grams(self, first: int, last: int) -> np.ndarray:
        """Of the grams that start from ``first`` and end by ``last``."""
        return self.mixed((self.sums[first + GRAM : last + 1] - self.sums[first : last + 1 - GRAM]) * self.up[first : last + 1 - GRAM])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return self.mixed((self.sums[starts + length] - self.sums[starts]) * self.up[starts])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = x
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(b: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """(key, first, last, left, right) of the anchors of a text.

    ``first`` and ``last`` are the string starts that belong to an anchor,
    ``left`` and ``right`` hash it with the SIDE bytes before or after it (0
    where the text ends).  Of a string, SIDE bytes at least lie on one side of
    its anchor, so equal strings have equal ``left`` or equal ``right``.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for base in range(0, max(len(b) - LENGTH + 1, 0), SEGMENT):
        lo, end = max(0, base - SIDE), min(len(b), base + SEGMENT + LENGTH - 1)
        part = b[lo : end + SIDE]
        hashes = Hashes(part, powers)
        h = hashes.grams(base - lo, end - lo)
        packed = (h & ~LOW24) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_least(packed, SPAN) & LOW24).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        own = at[first] + base - lo
        left, right = np.zeros(len(own), dtype=np.uint64), np.zeros(len(own), dtype=np.uint64)
        some = own >= SIDE
        left[some] = hashes.at(own[some] - SIDE, SIDE + GRAM) | np.uint64(1)
        some = own + GRAM + SIDE <= len(part)
        right[some] = (hashes.at(own[some], GRAM + SIDE) | np.uint64(1)) ^ np.uint64(1 << 63)
        found.append((h[at[first]], first + base, np.append(first[1:], len(at)) - 1 + base, left, right))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def count_anchors(batches):
    """Rows (side, key, n): how often an anchor with what stands on one side of it occurs in a part of a task."""
    powers, held, size = Powers(), [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            key, _, _, left, right = anchors(np.frombuffer((text or "").encode(), dtype=np.uint8), powers)
            sides = np.concatenate([left, right])
            held.append(np.stack([sides, np.concatenate([key, key])])[:, sides != 0])
            size += len(sides)
            if size >= FLUSH:
                yield from counted(held)
                held, size = [], 0
    if size:
        yield from counted(held)


def counted(held):
    side, key = np.concatenate(held, axis=1)
    side, first, n = np.unique(side, return_index=True, return_counts=True)
    key = key[first]
    for lo in range(0, len(side), 100_000):
        cut = slice(lo, lo + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(signed(side[cut])), pa.array(signed(key[cut])), pa.array(n[cut].astype(np.int32))], names=["side", "key", "n"])


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the leading bits of the keys, which are hashes."""
    slot = F.shiftrightunsigned(F.col("key"), 64 - BITMAP_BITS)
    made = keys.select(slot.alias("slot")).groupBy((F.col("slot") / 32768).cast("int").alias("part")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bits"))
    out = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
    for r in made.toLocalIterator():
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


PIECES = "bucket int, key long, hot boolean, sig binary, first long, copies long, piece binary"


def cut(packed: Packed, hot_keys: np.ndarray, hot_parts: np.ndarray, buckets: int):
    """Pieces of the texts of a batch; equal texts of a batch are cut once."""

    def run(batches):
        powers, bits = Powers(), packed.bits()
        for batch in batches:
            copies: dict[bytes, int] = {}
            texts: dict[bytes, bytes] = {}
            for text in batch.column(0).to_pylist():
                if text:
                    data = text.encode()
                    sig = xxhash.xxh3_128_digest(data)
                    copies[sig] = copies.get(sig, 0) + 1
                    texts[sig] = data
            rows: list[tuple] = []
            for sig, data in texts.items():
                key, first, last, left, right = anchors(np.frombuffer(data, dtype=np.uint8), powers)
                pick = ((left != 0) & holds(bits, left)) | ((right != 0) & holds(bits, right))
                if not pick.any():
                    continue
                key, first, last = key[pick], first[pick], last[pick]
                parts = np.ones(len(key), dtype=np.uint64)
                if len(hot_keys):
                    at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                    parts = np.where(hot_keys[at] == key, hot_parts[at], np.uint64(1))
                salt = (np.uint64(int.from_bytes(sig[:8], "little")) + first.astype(np.uint64)) % parts
                bucket = ((key + salt * np.uint64(STEP)) % np.uint64(buckets)).astype(np.int64)
                n = copies[sig]
                rows += [
                    (b, k, p > 1, sig, f, n, data[f : e + LENGTH])
                    for b, k, p, f, e in zip(bucket.tolist(), signed(key).tolist(), parts.tolist(), first.tolist(), last.tolist(), strict=True)
                ]
                if len(rows) > 50_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    return run


def batch_of(rows):
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is not."""
    n = len(t)
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    rises = np.zeros(len(ends), dtype=bool)
    rises[:-1] = t[ends[:-1]] < t[ends[:-1] + 1]
    return np.repeat(rises, np.diff(np.append(-1, ends)))


def block_ranks(t: np.ndarray) -> np.ndarray:
    """Dense ranks of the 8 bytes at every position (zeros follow the end)."""
    n = len(t)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = t
    block = np.ndarray(n, dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(block)
    ordered = block[order]
    rank = np.empty(n + LENGTH + 8, dtype=np.int64)
    rank[n:] = -1
    rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
    return rank


def sort_directly(at: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes at ``at`` in the order of their first ``depth`` bytes."""
    order = at[np.argsort(rank[at])]
    low = rank[order]
    slots, starts = np.arange(len(order)), np.append(True, low[1:] != low[:-1])[: len(order)]
    for off in range(8, depth, 8):
        # those that stand alone have found their place
        tied = np.flatnonzero(~(starts & np.append(starts[1:], True)))
        if not len(tied):
            break
        slots = slots[tied]
        pos = order[slots]
        key = (np.cumsum(starts)[tied] << 32) | (rank[pos + off] + 1)
        by = np.argsort(key)
        order[slots] = pos[by]
        key = key[by]
        starts = np.append(True, key[1:] != key[:-1])
    return order


def two_stage(t: np.ndarray, rank: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` bytes at least."""
    rising = smaller_than_next(t)
    direct = sort_directly(np.flatnonzero(rising), rank, depth)
    first = t[direct]
    edges = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    last = len(t) - 1
    waiting[t[last]].append(np.array([last]))
    out = []

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~rising[before]]
        if len(before):
            c = t[before]
            order = np.argsort(c, kind="stable")
            before, c = before[order], c[order]
            cuts = np.append(0, np.flatnonzero(c[1:] != c[:-1]) + 1)
            for byte, lo, hi in zip(c[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(c)], strict=True):
                waiting[byte].append(before[lo:hi])

    for c in range(256):
        while waiting[c]:  # fills again while runs of one byte are induced
            found = np.concatenate(waiting[c])
            waiting[c] = []
            out.append(found)
            induce(found)
        if edges[c] < edges[c + 1]:
            own = direct[edges[c] : edges[c + 1]]
            out.append(own)
            induce(own)
    return np.concatenate(out)


def same_prefix(sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether each suffix shares LENGTH bytes with the one before it."""
    same = np.zeros(len(sa), dtype=bool)
    live = np.arange(1, len(sa))
    for off in range(0, LENGTH, 8):
        live = live[rank[sa[live] + off] == rank[sa[live - 1] + off]]
    same[live] = True
    return same


RESULT = pa.schema([("sig", pa.binary()), ("spans", pa.binary()), ("digest", pa.binary()), ("n", pa.int64())])


def resolve(table: pa.Table) -> pa.Table:
    """Spans of repeated strings in a bucket, and open cases of hot anchors by digest."""
    keys = table.column("key").to_numpy()
    _, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, weights=table.column("copies").to_numpy())
    live = (total[inverse] > 1) | table.column("hot").to_numpy(zero_copy_only=False)
    table = table.filter(pa.array(live))
    if not table.num_rows:
        return RESULT.empty_table()
    pieces: dict[bytes, int] = {}
    of = np.array([pieces.setdefault(p, len(pieces)) for p in table.column("piece").to_pylist()], dtype=np.int64)
    copies = np.bincount(of, weights=table.column("copies").to_numpy()).astype(np.int64)
    hot = np.zeros(len(pieces), dtype=bool)
    hot[of[table.column("hot").to_numpy(zero_copy_only=False)]] = True
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    t = np.frombuffer(b"\xff".join(pieces) + b"\xff", dtype=np.uint8)
    begin = np.append(0, np.cumsum(sizes + 1)[:-1])
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    whole = np.arange(len(t)) - begin[owner] <= (sizes - LENGTH)[owner]
    rank = block_ranks(t)
    sa = two_stage(t, rank)
    sa = sa[whole[sa]]
    same = same_prefix(sa, rank)
    group = np.cumsum(~same) - 1
    n = np.bincount(group, weights=copies[owner[sa]]).astype(np.int64)
    twice = np.zeros(len(t), dtype=bool)
    twice[sa] = n[group] > 1
    # maximal runs of starts within a piece
    runs = np.flatnonzero(twice & ~np.append(False, twice[:-1])), np.flatnonzero(twice & ~np.append(twice[1:], False))
    lo, hi = np.searchsorted(runs[0], begin), np.searchsorted(runs[0], begin + sizes)
    pairs = np.stack([runs[0], runs[1] + LENGTH], axis=1).astype(np.int64)
    sigs, firsts = table.column("sig").to_pylist(), table.column("first").to_numpy()
    out = {(sigs[k], firsts[k]): of[k] for k in np.flatnonzero((hi > lo)[of]).tolist()}
    rows = [(sig, (pairs[lo[p] : hi[p]] + (first - begin[p])).tobytes(), None, 0) for (sig, first), p in out.items()]
    if hot.any():
        rows += open_cases(t, sa, group, n, hot, owner, begin, of, sigs, firsts)
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, RESULT, strict=True)], schema=RESULT)


def open_cases(t, sa, group, n, hot, owner, begin, of, sigs, firsts):
    data = t.tobytes()
    members: dict[int, list[int]] = {}
    for k, p in enumerate(of.tolist()):
        if hot[p]:
            members.setdefault(p, []).append(k)
    lead = np.append(True, group[1:] != group[:-1])
    for s, g in zip(sa[lead].tolist(), group[lead].tolist(), strict=True):
        p = int(owner[s])
        if hot[p]:
            digest = xxhash.xxh3_128_digest(data[s : s + LENGTH])
            if n[g] > 1:
                yield None, None, digest, int(n[g])
            else:
                k = members[p][0]
                a = int(s - begin[p] + firsts[k])
                yield sigs[k], np.array([a, a + LENGTH]).tobytes(), digest, 1


def finish(packed: Packed):
    """Rows (doc_id, sig, n_bytes, digest, data): data only where a span may be."""

    def run(batches):
        bits = packed.bits()
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                sig = xxhash.xxh3_128_digest(data)
                at = int.from_bytes(sig[:8], "big") >> (64 - BITMAP_BITS)
                may = len(data) >= LENGTH and bits[at >> 3] >> (at & 7) & 1
                rows.append((sig, len(data), None if may else hashlib.sha256(data).hexdigest(), data if may else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            types = [pa.binary(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "sig", "n_bytes", "whole", "data"])

    return run


def union_of(spans: list[bytes]) -> list[tuple[int, int]]:
    pairs = np.concatenate([np.frombuffer(s, dtype=np.int64) for s in spans]).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    cuts = np.flatnonzero(pairs[1:, 0] > ends[:-1]) + 1
    return list(zip(pairs[np.append(0, cuts), 0].tolist(), ends[np.append(cuts, len(pairs)) - 1].tolist(), strict=True))


def remove(batches):
    for batch in batches:
        doc_ids, sizes, wholes, datas, spans = (batch.column(k) for k in range(5))
        rows = []
        for size, whole, data, found in zip(sizes.to_pylist(), wholes.to_pylist(), datas.to_pylist(), spans.to_pylist(), strict=True):
            if found and data is not None:
                runs = union_of(found)
                kept, at = [], 0
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                rest = b"".join(kept)
                rows.append((size, size - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest))
            else:
                rows.append((size, 0, 0, whole or hashlib.sha256(data).hexdigest(), data))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, type=t) for c, t in zip(columns[:4], types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, spans): for each distinct text its spans of repeated strings, as int64 pairs."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    sides = texts.mapInArrow(count_anchors, "side long, key long, n int").groupBy("side").agg(F.sum("n").alias("n"), F.min("key").alias("key")).where("n > 1")
    sides = scratch.keep(sides)
    # an occurrence counts for one side at least and for two at most
    counts = scratch.keep(sides.groupBy("key").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT, total >> 20)
    hot = counts.where(F.col("n") > limit).toPandas()
    hot_keys = hot["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hot_keys)
    parts = (1 + hot["n"].to_numpy(dtype=np.int64) // limit).astype(np.uint64)
    buckets = max(8, -(-total * (LENGTH + SPAN // 2) // (2 * BUCKET_BYTES)))
    pieces = texts.mapInArrow(cut(Packed(bitmap(sides.select(F.col("side").alias("key")))), hot_keys[order], parts[order], buckets), PIECES)
    found = scratch.keep(pieces.groupBy("bucket").applyInArrow(resolve, "sig binary, spans binary, digest binary, n long"))
    twice = found.where("digest is not null").groupBy("digest").agg(F.sum("n").alias("total")).where("total > 1").select("digest")
    late = found.where("digest is not null and sig is not null").join(twice, "digest").select("sig", "spans")
    spans = scratch.keep(found.where("digest is null").select("sig", "spans").unionByName(late).groupBy("sig").agg(F.collect_list("spans").alias("spans")))
    scratch.drop(sides, counts, found)
    return spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    A byte goes if a 200-byte string over it starts anywhere else too, in any
    row (equal rows included).  Null and empty texts have no bytes; texts
    under 200 bytes lose none.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    spans = repeated_spans(docs, scratch)
    leading = spans.select(F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long").alias("key"))
    read = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(finish(Packed(bitmap(leading))), "doc_id long, sig binary, n_bytes long, whole string, data binary")
    joined = read.join(spans, "sig", "left").select("doc_id", "n_bytes", "whole", "data", "spans")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
