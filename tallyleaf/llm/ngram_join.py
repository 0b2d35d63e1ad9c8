"""Near-duplicate join on word n-grams: T-occurrence search with DivideSkip.

Two documents link when their sets of 5-word shingles have a Jaccard
similarity of at least 0.75.  Documents with the same set are one node.  A
node's inverted lists are divided: the shorter ones are merged and counted,
the long ones (and the rest, up to one less than the required overlap) are
only probed.  With n shingles, an overlap of T = ceil(3n/4) is needed by any
partner; when all but s lists are skipped, a partner shows up at least
T - (n - s) times in the s merged ones.  Pairs that reach this count are
verified by binary probes of the smaller set into the larger.

Large groups of near copies would fill lists with pairs.  So links between
each node and the least node of a few of its lists are verified first, and
lists then yield pairs across different groups only.  That first round adds
true links only; the counting round alone decides what is missing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyleaf.llm.common import Powers, tidied
from tallyleaf.llm.state import Packed, Scratch, components

WIDTH = 5
PERCENT = 75
#: Share of a set that is merged beyond what a single shared list needs.
EXTRA = 0.15
SKETCH = 8
CHUNK = 4_000_000
#: Lists of this many nodes and more are long: probed, not merged, as far as possible.
LONG = 24
#: Which lists are long, and which have more than one entry, is kept in bitmaps of fixed size.
KEY_BITS = 27
BITMAP_BITS = 26
PER_BUCKET = 4_000_000
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Shingler:
    """Sorted 48-bit ids of texts' distinct 5-word shingles (ASCII capitals folded).

    A text with fewer words has one, of its whole sequence; without words,
    none.  Texts are hashed by the group, all words of a group at once.
    """

    GROUP = 1 << 19

    def __init__(self):
        self.powers = Powers()
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, *range(9, 14)]] = True

    def __call__(self, texts: list[str]):
        held, size = [], 0
        for text in texts:
            held.append((text or "").encode().lower())
            size += len(held[-1]) + 1
            if size >= self.GROUP:
                yield from self.group(held)
                held, size = [], 0
        if held:
            yield from self.group(held)

    def words(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start, and their hashes."""
        gap = np.ones(len(b) + 2, dtype=bool)
        gap[1:-1] = self.space[b]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edge[::2], edge[1::2]
        up, down = self.powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * down[:-1], out=sums[1:])
        h = (sums[ends] - sums[starts]) * up[starts]
        h ^= h >> np.uint64(31)
        h *= P2
        h ^= h >> np.uint64(33)
        return starts, h

    def group(self, data: list[bytes]):
        starts, h = self.words(np.frombuffer(b"\n".join(data), dtype=np.uint8))
        begin = np.cumsum([0, *(len(d) + 1 for d in data)])
        at = np.searchsorted(starts, begin).tolist()
        five = mixed(h, WIDTH) if len(h) >= WIDTH else None
        for lo, hi in zip(at, at[1:], strict=False):
            n = hi - lo
            if n >= WIDTH:
                yield np.unique(five[lo : hi - WIDTH + 1])
            else:
                yield mixed(h[lo:hi], n) if n else np.empty(0, dtype=np.uint64)


def folded(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of so many words."""
    key = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        key = key * P1 + h[k : len(h) - width + 1 + k]
    key ^= key >> np.uint64(32)
    key *= P2
    key ^= key >> np.uint64(29)
    return key


def mixed(h: np.ndarray, width: int) -> np.ndarray:
    return folded(h, width) >> np.uint64(16)


def signature(ids: np.ndarray) -> int:
    """Node of a set: equal sets, equal nodes."""
    return xxhash.xxh3_64_intdigest(ids.tobytes()) - (1 << 63)


def required(n: int) -> int:
    """Least overlap with any partner of a set of n."""
    return -(-PERCENT * n // 100)


def linked(common: int, n: int, m: int) -> bool:
    return 100 * common >= PERCENT * (n + m - common)


def pack(ids: np.ndarray) -> bytes:
    """Six bytes an id."""
    return ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    raw[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return raw.view("<u8").ravel()


def text_batches(batches, at: int):
    for batch in batches:
        yield batch, [t or "" for t in batch.column(at).to_pylist()]


def keys_by_range(ranges: int):
    """All shingles of a chunk of nodes by range of their leading 36 bits.

    A range holds the last 16 bits of each key in order, and how many keys
    there are under each of the leading 20 bits: a little over two bytes a key.
    Counts take two bytes each, or four in a range where one is too large.
    """

    def packed(c):
        return c.astype("<u2" if c.max() < 1 << 16 else "<u4").tobytes()

    def pack_chunk(held):
        keys = np.sort(np.concatenate(held) >> np.uint64(12))
        counts = np.bincount((keys >> np.uint64(16)).astype(np.int64), minlength=1 << 20)
        low = (keys & np.uint64(0xFFFF)).astype("<u2")
        ends = np.append(0, np.cumsum(counts.reshape(ranges, -1).sum(axis=1)))
        counts = counts.reshape(ranges, -1)
        rows = [(r, packed(counts[r]), low[ends[r] : ends[r + 1]].tobytes()) for r in range(ranges) if ends[r] < ends[r + 1]]
        r, c, k = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(r, type=pa.int32()), pa.array(c, type=pa.binary()), pa.array(k, type=pa.binary())], names=["range", "counts", "low"])

    def run(batches):
        shingles, held, size, seen = Shingler(), [], 0, set()
        for _, texts in text_batches(batches, 0):
            for ids in shingles(texts):
                node = signature(ids)
                if not len(ids) or node in seen:
                    continue
                seen.add(node)
                held.append(ids)
                size += len(ids)
                if size >= CHUNK:
                    yield pack_chunk(held)
                    held, size = [], 0
                    seen.clear()
        if held:
            yield pack_chunk(held)

    return run


def measure_lists(ranges: int):
    """Bitmaps of a range: lists with more than one entry, and long lists."""
    width = (1 << KEY_BITS) // ranges
    leads = (1 << 20) // ranges

    def run(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        keys = []
        for c, k in zip(table.column("counts").to_pylist(), table.column("low").to_pylist(), strict=True):
            lead = np.repeat(np.arange(leads, dtype=np.uint32), np.frombuffer(c, dtype="<u2" if len(c) == 2 * leads else "<u4"))
            keys.append((lead << np.uint32(16)) | np.frombuffer(k, dtype="<u2")) if len(lead) else None
        keys = np.sort(np.concatenate(keys))
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.diff(np.append(start, len(keys)))
        slot = (keys[start] >> np.uint32(36 - KEY_BITS)).astype(np.int64)
        out = []
        for least in (2, LONG):
            bits = np.zeros(width, dtype=np.uint8)
            bits[slot[n >= least]] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.table({"range": pa.array([r], type=pa.int32()), "repeated": pa.array([out[0]], type=pa.binary()), "long": pa.array([out[1]], type=pa.binary())})

    return run


def list_bitmaps(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, long) over all shingles of all documents, by their leading bits."""
    ranges = 16
    while ranges < min(1 << 16, 2 * docs.rdd.getNumPartitions()):
        ranges *= 2
    made = docs.select("text").mapInArrow(tidied(keys_by_range(ranges)), "range int, counts binary, low binary").groupBy("range").applyInArrow(measure_lists(ranges), "range int, repeated binary, long binary")
    both = np.zeros((2, (1 << KEY_BITS) // 8), dtype=np.uint8)
    step = both.shape[1] // ranges
    for row in made.toLocalIterator():
        for k, part in enumerate((row["repeated"], row["long"])):
            both[k, row["range"] * step : (row["range"] + 1) * step] = np.frombuffer(part, dtype=np.uint8)
    return both[0], both[1]


def held_by(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = (ids >> np.uint64(48 - KEY_BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def describer(packed_repeated: Packed, packed_long: Packed):
    """Rows (doc_id, node, n, odd, mins, extra, longs, merged); all but the first three once for each node of a task.

    ``odd`` is the thousandths of a set that are not in long lists: in a large
    group of near copies the text they were made from has the least.
    """

    def run(batches):
        shingles, seen = Shingler(), set()
        repeated, long = packed_repeated.bits(), packed_long.bits()
        for batch, texts in text_batches(batches, 1):
            rows = []
            for ids in shingles(texts):
                n = len(ids)
                if not n:
                    rows.append((None, 0, None, None, None, None, None))
                    continue
                node = signature(ids)
                if node in seen:
                    rows.append((node, n, None, None, None, None, None))
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                is_long, again = held_by(long, ids), held_by(repeated, ids)
                lists, extra = divide(ids, is_long, again)
                rows.append((node, n, 1000 * (n - int(is_long.sum())) // n, ids[again][:SKETCH].astype(np.int64).tolist(), extra, int(is_long.sum()), pack(lists)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "node", "n", "odd", "mins", "extra", "longs", "merged"])

    return run


def divide(ids: np.ndarray, is_long: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, int]:
    """The lists to merge, and how often beyond once a partner shows up in them.

    Lists with a single entry are among the merged but hold no partner.
    """
    n = len(ids)
    need = n - required(n) + 1
    short = np.flatnonzero(~is_long)
    order = short if len(short) >= need else np.concatenate([short, np.flatnonzero(is_long)])
    take = max(need, min(len(short), need + int(EXTRA * n)))
    order = order[:take]
    return ids[order[again[order]]], take - need


def spread(buckets: int):
    """Postings by bucket of their key: packed keys, nodes and what is known of them."""

    def run(batches):
        for batch in batches:
            nodes, groups, sizes, extras, longs = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            found = batch.column(5).to_pylist()
            if not found:
                continue
            keys = unpack(b"".join(found))
            ref = np.repeat(np.arange(len(found), dtype=np.int64), [len(x) // 6 for x in found])
            bucket = (keys % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                pick = order[ends[b] : ends[b + 1]]
                if len(pick):
                    own, local = np.unique(ref[pick], return_inverse=True)
                    rows.append((b, pack(keys[pick]), local.astype(np.uint32 if len(own) > 65_535 else np.uint16).tobytes(), np.stack([nodes[own], groups[own]]).tobytes(), np.stack([x[own].astype(np.int32) for x in (sizes, extras, longs)]).tobytes()))
            if not rows:
                continue
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], type=pa.int32()), *(pa.array(c, type=pa.binary()) for c in columns[1:])], names=["bucket", "keys", "refs", "nodes", "facts"])

    return run


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("extra", pa.int32()), ("n", pa.int64())])


def merger(packed_long: Packed):
    return lambda table: merge(table, packed_long.bits())


def merge(table: pa.Table, long: np.ndarray) -> pa.Table:
    """Pairs of nodes from different groups that share lists of a bucket, with counts.

    Nodes that merge long lists have merged all their short ones; if they
    share none of these, their overlap is at most that of their long lists.
    """
    keys, refs, nodes, facts, base = [], [], [], [], 0
    for k, r, d, f in zip(*(table.column(c).to_pylist() for c in ("keys", "refs", "nodes", "facts")), strict=True):
        keys.append(unpack(k))
        refs.append(np.frombuffer(r, dtype=np.uint16 if len(r) == 2 * len(keys[-1]) else np.uint32).astype(np.int64) + base)
        nodes.append(np.frombuffer(d, dtype=np.int64).reshape(2, -1))
        facts.append(np.frombuffer(f, dtype=np.int32).reshape(3, -1))
        base += nodes[-1].shape[1]
    key, ref = np.concatenate(keys), np.concatenate(refs)
    node, group = np.concatenate(nodes, axis=1)
    size, extra, longs = np.concatenate(facts, axis=1)
    del keys, refs, nodes, facts
    order = np.argsort(key, kind="stable")
    key = key[order]
    again = key[1:] == key[:-1]
    shared = np.zeros(len(key), dtype=bool)
    shared[1:] |= again
    shared[:-1] |= again
    key, ref = key[shared], ref[order[shared]]
    order = np.lexsort((node[ref], size[ref], key))
    key, ref = key[order], ref[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (node[ref[1:]] != node[ref[:-1]])
    key, ref = key[first], ref[first]
    key, ref = across(key, ref, group)
    is_long = held_by(long, key)
    out = []
    live, step = np.arange(len(key)), 1
    held: list[np.ndarray] = []
    count = 0
    while len(live):
        live = live[live + step < len(key)]
        i, j = live, live + step
        ok = (key[i] == key[j]) & (100 * size[ref[i]].astype(np.int64) >= PERCENT * size[ref[j]].astype(np.int64))
        live = live[ok]
        i, j = ref[live], ref[live + step]
        most = np.minimum(longs[i], longs[j]).astype(np.int64)
        differ = (group[i] != group[j]) & (~is_long[live] | ((100 + PERCENT) * most >= PERCENT * (size[i].astype(np.int64) + size[j])))
        if differ.any():
            held.append(np.stack([i[differ], j[differ]]))
            count += int(differ.sum())
        if count > 4_000_000:
            counted(held, node, extra, out)
            held, count = [], 0
        step += 1
    if held:
        counted(held, node, extra, out)
    return pa.concat_tables(out) if out else PAIRS.empty_table()


def counted(held, node, extra, out) -> None:
    i, j = np.concatenate(held, axis=1)
    a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    low = np.minimum(extra[i], extra[j])
    order = np.lexsort((b, a))
    a, b, low = a[order], b[order], low[order]
    start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    n = np.diff(np.append(start, len(a)))
    out.append(pa.Table.from_arrays([pa.array(a[start]), pa.array(b[start]), pa.array(low[start], type=pa.int32()), pa.array(n.astype(np.int64))], schema=PAIRS))


def across(key: np.ndarray, ref: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only lists that hold nodes of more than one group."""
    if not len(key):
        return key, ref
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    own = group[ref]
    mixed = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
    keep = np.repeat(mixed, np.diff(np.append(start, len(key))))
    return key[keep], ref[keep]


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, ids) of the wanted nodes and of few others, each once a task."""
    packed = Packed(bits_of_nodes(wanted))

    def run(batches):
        shingles, seen, small = Shingler(), set(), packed.bits()
        for _, texts in text_batches(batches, 0):
            nodes, found = [], []
            for ids in shingles(texts):
                if not len(ids):
                    continue
                node = signature(ids)
                at = slot_of(node)
                if small[at >> 3] >> (at & 7) & 1 and node not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    found.append(pack(ids))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array(found, type=pa.binary())], names=["node", "ids"])

    return docs.select("text").mapInArrow(tidied(run), "node long, ids binary")


def slot_of(node: int) -> int:
    return (node + (1 << 63)) >> (64 - BITMAP_BITS)


def bits_of_nodes(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the leading bits of the nodes, which are hashes."""
    slot = F.shiftrightunsigned(F.col("node"), 64 - BITMAP_BITS).bitwiseXOR(F.lit(1 << (BITMAP_BITS - 1)))
    made = nodes.select(slot.alias("slot")).groupBy((F.col("slot") / 32768).cast("int").alias("part")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bits"))
    out = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
    for r in made.toLocalIterator():
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def verify(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that link: the smaller set is probed into the larger."""
    wanted = scratch.keep(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    sets = scratch.keep(sets_of(docs, wanted).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("ids").alias("ids")))
    right = sets.select(F.col("node").alias("b"), F.col("ids").alias("ids_b"))
    left = sets.select(F.col("node").alias("a"), F.col("ids").alias("ids_a"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = sorted((unpack(x), unpack(y)), key=len)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(linked(int((y[at] == x).sum()), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    found = scratch.keep(pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ids_a", "ids_b").mapInArrow(tidied(run), "a long, b long"))
    scratch.drop(wanted, sets)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    ``component_id`` is the smallest doc_id reachable by links, the row's own
    included; rows without words are linked with nothing.  A null doc_id
    takes part under its text and gets the smallest id of its component.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scratch = Scratch(spark, "ngram-join")
    repeated, long = map(Packed, list_bitmaps(docs))
    known = scratch.keep(docs.mapInArrow(tidied(describer(repeated, long)), "doc_id long, node long, n long, odd int, mins array<long>, extra int, longs int, merged binary"))
    nodes = known.where("merged is not null").select("node", "n", "odd", "mins", "extra", "longs", "merged")

    # first round: each node against the most typical nodes of its sketch's lists
    listed = nodes.select("node", "n", "odd", F.explode("mins").alias("key"))
    hubs = listed.groupBy("key").agg(F.min(F.struct("odd", "node", "n")).alias("hub"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "hub")
    stars = (
        listed.join(hubs, "key")
        .where("node <> hub.node")
        .where(f"100 * least(n, hub.n) >= {PERCENT} * greatest(n, hub.n)")
        .groupBy("node")
        .agg(F.slice(F.array_sort(F.collect_set("hub")), 1, 3).alias("hubs"))
        .select("node", F.explode("hubs.node").alias("hub"))
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .distinct()
    )
    stars = scratch.keep(stars)
    first = verify(stars, docs, scratch)
    groups = components(first, scratch)

    # second round: count shared lists across groups
    postings = nodes.join(groups, "node", "left").select("node", F.coalesce("label", "node").alias("group"), "n", "extra", "longs", "merged")
    total = nodes.agg(F.sum(F.octet_length("merged"))).first()[0] or 0
    buckets = max(2, math.ceil(total / 6 / PER_BUCKET))
    merged = postings.mapInArrow(tidied(spread(buckets)), "bucket int, keys binary, refs binary, nodes binary, facts binary").groupBy("bucket").applyInArrow(merger(long), "a long, b long, extra int, n long")
    pairs = merged.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("extra").alias("extra")).where("n > extra").select("a", "b")
    pairs = scratch.keep(pairs.join(stars, ["a", "b"], "left_anti"))
    second = verify(pairs, docs, scratch)
    labels = components(first.unionByName(second), scratch)

    ids = known.where("node is not null").select("doc_id", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = ids.join(lowest, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = known.where("node is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    result = scratch.keep(out.unionByName(empty))
    scratch.drop(known, stars, pairs, first, second)
    return result
