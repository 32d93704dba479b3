"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document that comes earlier. Suffixes are
sorted to find such strings, in three steps.

1. *Which suffixes.* The smallest hash of the 20-byte grams in a string of ``LENGTH`` bytes marks its anchor, which
   depends on the string alone. The starts of one anchor lie side by side; they and the bytes up to the end of their
   last string are a zone. A string that occurs twice lies in two zones with the same gram, so only grams seen in two
   documents go on (two bits each in a filter that grows with the table up to 64 MB; bits set by chance only cost work).
2. *Runs.* A task sorts the suffixes that begin at its anchors, each cut at the end of its zone, keeps of equal zones the
   one of the earliest document (the others are repeats by this alone), and writes them front-coded: how many bytes a
   suffix shares with the one before, then the rest. Zones of a gram of very many documents are then cut into their
   strings, each a suffix of its own, of which the earliest is kept likewise and dealt by its own hash, so that no gram
   fills a task.
3. *Merge.* Per bucket equal zones are settled: the earliest wins. A loser tree combines the runs of those that are left
   and whose gram another one has. It holds with every suffix how much of it equals the last winner, which settles most
   matches without a look at the bytes; else comparison starts behind what is known to be equal. Zones of one gram come
   out side by side: two of them share the strings in the bytes around the anchor that are equal; where there are many,
   their strings are compared.

Zones are rows of bytes of equal width, so that all but the tree works on whole arrays.

Texts are shuffled once, when their repeated stretches come back to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import in_bitmap, small_batches, stage

LENGTH = 50
GRAM = 20
GRAM_BYTES = 6  # of a gram's hash that are exchanged
# Bits that tell which grams are shared: so many for each bucket of grams, and at most so many in all (64 MB).
BUCKET_BITS = 1 << 20
FILTER_BITS = 1 << 29
# A gram sent more often than this has its strings sorted one by one. A batch of texts sends it 1 + log2(texts) times, so
# the zones of any other gram are a few megabytes.
HOT_SENDS = 2048
HOT_BITS = 1 << 20
BUCKET_BYTES = 16 << 20  # of text for each bucket of grams and of suffixes
RUN_SUFFIXES = 400_000  # sorted in memory at a time
PAIRED = 16  # zones of a gram that are compared pair by pair
ROWS = 1 << 15  # rows of bytes compared at a time
BATCH_DOCS = 500
BLOCK = 32 << 10  # bytes hashed at a time, few enough for the processor's cache
LAST = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at every place, put together from hashes of powers of two."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    part = (data.astype(np.uint64) + np.uint64(1)) * _SPREAD
    part ^= part >> np.uint64(32)
    width, factor = 1, _MIX
    whole, covered = None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                if whole is None:
                    whole = part
                else:
                    n = len(data) - covered - width + 1
                    whole = whole[:n] * factor + part[covered : covered + n]
                covered += width
            if 2 * width > k:
                break
            n = len(part) - width
            part = part[:n] * factor + part[width : width + n]
            width, factor = 2 * width, factor * factor
        whole = whole * _SPREAD
    return whole ^ (whole >> np.uint64(31))


def gram_key(h: np.ndarray) -> np.ndarray:
    """The first ``GRAM_BYTES`` bytes of a hash."""
    return (h >> np.uint64(64 - 8 * GRAM_BYTES)).view(np.int64)


def zones(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Zones of texts that lie one behind the other: first and last start, anchor, and hash of its gram.

    ``ends`` holds the end of the text every place belongs to.
    """
    gram = min(GRAM, length)
    none = np.zeros(0, np.int64)
    h = gram_hashes(data, gram)
    starts = len(data) - length + 1
    if starts <= 0:
        return none, none, none, h[:0]
    # smallest (hash, place) of the grams of each string, windows growing by doubling
    low = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    window, width = length - gram + 1, 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = window - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.flatnonzero(np.arange(starts) + length <= ends[:starts])
    if not len(inside):
        return none, none, none, h[:0]
    at = anchor[inside]
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(inside) != 1)) + 1
    first = np.r_[0, cut]
    last = np.r_[cut, len(inside)] - 1
    # anchors have small hashes: mixed once more, they are spread evenly
    with np.errstate(over="ignore"):
        return inside[first], inside[last], at[first], (h[at[first]] ^ (h[at[first]] >> np.uint64(32))) * _MIX


def blocks(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts one behind the other, about ``BLOCK`` bytes at a time; longer ones in pieces that share ``length - 1`` bytes.

    ``(data, piece of every byte, end of its piece, text of a piece, what turns a place in data into one in the text)``.
    A zone that a piece cuts in two is two zones of the same gram.
    """
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def pack() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for _, _, p in part])
        stop = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(part)), sizes)
        shift = stop - sizes - np.array([offset for _, offset, _ in part])
        return b"".join(p for _, _, p in part), piece, stop[piece], np.array([doc for doc, _, _ in part]), shift

    for doc, text in enumerate(texts):
        for offset in range(0, len(text) - length + 1, BLOCK):
            part.append((doc, offset, text[offset : offset + BLOCK + length - 1]))
            size += len(part[-1][2])
            if size >= BLOCK:
                yield pack()
                part, size = [], 0
    if part:
        yield pack()


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """How many first bytes are equal, ``known`` of which need no look."""
    end = min(len(a), len(b))
    while known < end:
        if a[known] != b[known]:
            return known
        step = min(end - known, 64)
        x = int.from_bytes(a[known : known + step], "big") ^ int.from_bytes(b[known : known + step], "big")
        if x:
            return known + step - (x.bit_length() + 7) // 8
        known += step
    return end


def shared_bytes(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many first bytes are equal in each two rows, ``most`` of which count."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), ROWS):
        differ = a[i : i + ROWS] != b[i : i + ROWS]
        at = differ.argmax(axis=1)
        at[~differ[np.arange(len(at)), at]] = a.shape[1]
        out[i : i + ROWS] = at
    return np.minimum(out, most)


def front_code_rows(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Sorted keys, the first bytes of rows, as (bytes shared with the key before, bytes that follow, those, compressed)."""
    shared = np.zeros(len(keys), np.int32)
    shared[1:] = shared_bytes(keys[1:], keys[:-1], np.minimum(sizes[1:], sizes[:-1]))
    column = np.arange(keys.shape[1])
    tails = keys[(column >= shared[:, None]) & (column < sizes[:, None])]
    return shared, sizes.astype(np.int32) - shared, zstandard.compress(tails.tobytes(), 1)


def front_code(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """``front_code_rows`` of a list."""
    width = max(1, *map(len, keys)) if keys else 1
    rows = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), np.uint8).reshape(-1, width)
    return front_code_rows(rows, np.fromiter(map(len, keys), np.int64, len(keys)))


def front_decode(shared: np.ndarray, tail: np.ndarray, data: np.ndarray, width: int) -> np.ndarray:
    """The keys of front-coded runs that lie one behind the other, as rows of ``width`` bytes."""
    size, row = shared + tail, np.arange(len(shared))
    begin = np.cumsum(tail, dtype=np.int64) - tail - shared  # of a key in data, were it whole
    keys = np.zeros((len(shared), width), np.uint8)
    for c in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > c)
        writer = np.maximum.accumulate(np.where(shared <= c, row, 0))[here]  # the last key that brought this byte
        keys[here, c] = data[begin[writer] + c]
    return keys


class Run:
    """A front-coded run, read key by key."""

    def __init__(self, shared: np.ndarray, tail: np.ndarray, data: bytes):
        self.shared, self.tail, self.data = shared.tolist(), tail.tolist(), zstandard.decompress(data)
        self.next, self.offset, self.key, self.lcp = 0, 0, b"", 0

    def advance(self) -> bool:
        """Go to the next key; ``lcp`` becomes what it shares with the one before."""
        i = self.next
        if i == len(self.shared):
            return False
        self.lcp, size = self.shared[i], self.tail[i]
        self.key = self.key[: self.lcp] + self.data[self.offset : self.offset + size]
        self.offset += size
        self.next = i + 1
        return True


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, int, bytes, int]]:
    """``(run, place in it, key, bytes shared with the key before)`` of all runs in order, by a loser tree.

    Every key in the tree carries in ``lcp`` what it shares with the last winner. Of two keys the one that shares more
    comes first; only where both share the same are bytes compared, from there on, and the loser then knows what it
    shares with the winner.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    lcps = [0 if i < len(runs) and runs[i].advance() else -1 for i in range(leaves)]  # -1: the run has ended
    keys = [run.key for run in runs] + [b""] * (leaves - len(runs))

    def before(a: int, b: int) -> bool:
        """Whether key ``a`` comes before ``b``, which shares as much with the last winner; the loser's ``lcp`` is set."""
        p, q = keys[a], keys[b]
        same = common_prefix(p, q, lcps[a])
        if same == len(p) or (same < len(q) and p[same] < q[same]):
            lcps[b] = same
            return True
        lcps[a] = same
        return False

    losers = [0] * leaves

    def build(node: int) -> int:
        if node >= leaves:
            return node - leaves
        a, b = build(2 * node), build(2 * node + 1)
        if lcps[a] < lcps[b] or (lcps[a] == lcps[b] >= 0 and not before(a, b)):
            a, b = b, a
        losers[node] = b
        return a

    winner = build(1) if leaves > 1 else 0
    while lcps[winner] >= 0:
        run = runs[winner]
        yield winner, run.next - 1, keys[winner], lcps[winner]
        if run.advance():
            keys[winner], lcps[winner] = run.key, run.lcp
        else:
            lcps[winner] = -1
        known, node = lcps[winner], (winner + leaves) >> 1
        while node:
            other = losers[node]
            theirs = lcps[other]
            if known < theirs or (known == theirs >= 0 and not before(winner, other)):
                losers[node], winner, known = winner, other, theirs
            node >>= 1


RUN_SCHEMA = "bucket int, shared binary, tail binary, data binary, left_size binary, left_data binary, place binary, ord binary, row binary"
HIT_SCHEMA = "row long, lo int, hi int"


def merged(hits: np.ndarray) -> np.ndarray:
    """Stretches ``(row, lo, hi)`` with those of a row that overlap or touch put together."""
    if not len(hits):
        return hits
    hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
    base = (hits[:, 0] - hits[:, 0].min()).astype(np.int64)
    rank = np.cumsum(np.r_[0, base[1:] != base[:-1]]) << 32  # keeps the ends of one row from reaching into the next
    reach = np.maximum.accumulate(rank + hits[:, 2])
    first = np.flatnonzero(np.r_[True, rank[1:] + hits[1:, 1] > reach[:-1]])
    last = np.r_[first[1:], len(hits)] - 1
    return np.stack([hits[first, 0], hits[first, 1], reach[last] - rank[last]], axis=1)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row, of a multiple of eight bytes."""
    h = np.zeros(len(rows), np.uint64)
    for word in np.ascontiguousarray(rows).view(np.uint64).T:
        h = (h ^ word) * _SPREAD
        h ^= h >> np.uint64(29)
    return h


def widths(length: int) -> tuple[int, int]:
    """Bytes a row has for a zone's key and for what stands left of it."""
    return -(-length // 8) * 8, max(8, -(-(length - min(GRAM, length)) // 8) * 8)


class Zones:
    """Zones as rows of bytes: the key from the anchor on, what stands left of it, read backwards, and both sizes.

    Equal zones are equal rows, and rows are in the order of the keys.
    """

    def __init__(self, key: np.ndarray, size: np.ndarray, left: np.ndarray, left_size: np.ndarray):
        sizes = np.stack([size, left_size], axis=1).astype(">u4").view(np.uint8).reshape(-1, 8)
        sizes = sizes if len(key) else np.zeros((0, 8), np.uint8)
        self.rows, self.wide = np.concatenate([key, sizes[:, :4], sizes[:, 4:], left], axis=1), key.shape[1]
        self.size, self.left_size = np.asarray(size, np.int64), np.asarray(left_size, np.int64)

    def __len__(self) -> int:
        return len(self.rows)

    @property
    def key(self) -> np.ndarray:
        return self.rows[:, : self.wide]

    @property
    def left(self) -> np.ndarray:
        return self.rows[:, self.wide + 8 :]

    def take(self, at: np.ndarray) -> Zones:
        out = Zones.__new__(Zones)
        out.rows, out.wide, out.size, out.left_size = self.rows[at], self.wide, self.size[at], self.left_size[at]
        return out

    @staticmethod
    def joined(parts: list[Zones]) -> Zones:
        out = Zones.__new__(Zones)
        out.rows, out.wide = np.concatenate([p.rows for p in parts]), parts[0].wide
        out.size, out.left_size = (np.concatenate([getattr(p, c) for p in parts]) for c in ("size", "left_size"))
        return out

    def bytes_of(self, i: int) -> tuple[bytes, bytes]:
        """What stands left, and the key."""
        return self.left[i, : self.left_size[i]][::-1].tobytes(), self.key[i, : self.size[i]].tobytes()


def cut_zones(data: bytes, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int) -> Zones:
    """Zones of texts that lie one behind the other."""
    wide, left_wide = widths(length)
    padded = np.frombuffer(bytes(left_wide) + data + bytes(wide), np.uint8)
    size, left_size = last + length - anchor, anchor - first
    view = np.lib.stride_tricks.sliding_window_view
    key, left = view(padded, wide)[anchor + left_wide], view(padded, left_wide)[anchor][:, ::-1]
    return Zones(key * (np.arange(wide) < size[:, None]), size, left * (np.arange(left_wide) < left_size[:, None]), left_size)


class _Sorter:
    """Zones of one task; sorts them when there are enough and gives out runs, and the repeats already settled."""

    def __init__(self, buckets: int, length: int, most: int):
        self.buckets, self.length, self.most = buckets, length, most
        self.parts: list[tuple[Zones, np.ndarray]] = []  # zones, and (bucket, ord, row, place, hot) of each
        self.count = 0
        self.settled: list[np.ndarray] = []

    def add(self, zones: Zones, bucket, ord_, row, place, hot) -> Iterator[pa.RecordBatch]:
        if len(zones):
            self.parts.append((zones, np.stack([np.asarray(c, np.int64) for c in (bucket, ord_, row, place, hot)])))
            self.count += len(zones)
            if self.count >= self.most:
                yield from self.flush()

    def _earliest(self, zones: Zones, of: np.ndarray) -> tuple[Zones, np.ndarray]:
        """Sorted by bucket and key; of equal zones, which share a bucket, those of the earliest document. The others are settled."""
        n = len(zones)
        bucket = of[0].astype(">u4").view(np.uint8).reshape(n, 4)
        ord_ = (of[1].view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(n, 8)
        whole = np.concatenate([bucket, zones.rows, ord_], axis=1)
        order = np.argsort(whole.view(f"S{whole.shape[1]}").ravel(), kind="stable")
        del whole
        zones, of = zones.take(order), of[:, order]
        new = np.ones(n, bool)
        for i in range(1, n, ROWS):
            j = min(n, i + ROWS)
            new[i:j] = (zones.rows[i:j] != zones.rows[i - 1 : j - 1]).any(axis=1) | (of[0, i:j] != of[0, i - 1 : j - 1])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        later = of[1] != of[1, start]
        gone, kept = np.flatnonzero(later), np.flatnonzero(~later)
        self.settled.append(np.stack([of[2, gone], of[3, gone] - zones.left_size[gone], of[3, gone] + zones.size[gone]], axis=1))
        return zones.take(kept), of[:, kept]

    def _strings(self, zones: Zones, of: np.ndarray) -> tuple[Zones, np.ndarray]:
        """The strings of zones, each a zone without a left part."""
        wide, left_wide = widths(self.length)
        whole = np.concatenate([zones.left[:, ::-1], zones.key], axis=1)
        keys, numbers = [], []
        for c in range(whole.shape[1] - self.length + 1):
            here = np.flatnonzero((c >= left_wide - zones.left_size) & (c + self.length <= left_wide + zones.size))
            key = np.zeros((len(here), wide), np.uint8)
            key[:, : self.length] = whole[here, c : c + self.length]
            part = of[:, here]
            part[0] = (row_hashes(key) % np.uint64(self.buckets)).astype(np.int64)
            part[3] += c - left_wide
            keys.append(key)
            numbers.append(part)
        key = np.concatenate(keys)
        none = np.zeros(len(key), np.int64)
        return Zones(key, none + self.length, np.zeros((len(key), left_wide), np.uint8), none), np.concatenate(numbers, axis=1)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """A run per bucket, and the settled repeats as rows without bytes."""
        if self.parts:
            zones, of = Zones.joined([z for z, _ in self.parts]), np.concatenate([o for _, o in self.parts], axis=1)
            self.parts, self.count = [], 0
            zones, of = self._earliest(zones, of)
            hot = np.flatnonzero(of[4])
            if len(hot):
                rest = np.flatnonzero(of[4] == 0)
                strings, strings_of = self._earliest(*self._strings(zones.take(hot), of[:, hot]))
                zones, of = Zones.joined([zones.take(rest), strings]), np.concatenate([of[:, rest], strings_of], axis=1)
                zones, of = self._earliest(zones, of)
            edge = np.flatnonzero(np.r_[True, of[0, 1:] != of[0, :-1], True])
            for i, j in zip(edge[:-1], edge[1:]):
                part = zones.take(slice(i, j))
                left = part.left[np.arange(part.left.shape[1]) < part.left_size[:, None]].tobytes()
                sizes = part.left_size.astype(np.int32)
                yield _run_row(int(of[0, i]), *front_code_rows(part.key, part.size), sizes, zstandard.compress(left, 1), of[3, i:j], of[1, i:j], of[2, i:j])
        hits = merged(np.concatenate([np.zeros((0, 3), np.int64), *self.settled]))
        for i in range(0, len(hits), 50_000):
            part, none = hits[i : i + 50_000], np.zeros(0, np.int32)
            yield _run_row(int(part[0, 0] % self.buckets), none, none, b"", none, b"", part[:, 1], part[:, 2], part[:, 0])
        self.settled = []


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, first all lowest bytes, compressed."""
    planes = np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _run_row(bucket: int, shared, tail, data: bytes, left_size, left_data: bytes, place, ord_, row) -> pa.RecordBatch:
    values = [shared.tobytes(), tail.tobytes(), data, left_size.tobytes(), left_data, _packed(place), _packed(ord_), _packed(row)]
    names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], names)


def _group_hits(group: list[tuple[bytes, bytes, int]], length: int) -> list[tuple[int, int] | None]:
    """For each of different zones ``(left, key, ord)`` of one gram the repeated stretch, in bytes before and behind its anchor."""
    first: dict[bytes, int] = {}
    for left, key, ord_ in group:
        zone = left + key
        for i in range(len(zone) - length + 1):
            s = zone[i : i + length]
            if ord_ < first.get(s, LAST + 1):
                first[s] = ord_
    out = []
    for left, key, ord_ in group:
        zone = left + key
        hit = [i for i in range(len(zone) - length + 1) if first[zone[i : i + length]] < ord_]
        # all strings of a zone hold its anchor, so their union has no hole
        out.append((len(left) - hit[0], hit[-1] + length - len(left)) if hit else None)
    return out


def _stretches(zones: Zones, ord_: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of zones that are grouped by gram, and different in a group, the repeated bytes before and behind the anchor; -1 for none.

    Two zones have a string in common if as many bytes around the anchor are equal, and then all strings in these bytes.
    """
    before, behind = (np.full(len(zones), -1, np.int64) for _ in range(2))
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    sizes = np.repeat(np.diff(edge), np.diff(edge))
    for step in range(1, PAIRED):
        a = np.flatnonzero((group[step:] == group[:-step]) & (sizes[step:] <= PAIRED) & (ord_[step:] != ord_[:-step]))
        for i in range(0, len(a), ROWS):
            x, y = a[i : i + ROWS], a[i : i + ROWS] + step
            right = shared_bytes(zones.key[x], zones.key[y], np.minimum(zones.size[x], zones.size[y]))
            left = shared_bytes(zones.left[x], zones.left[y], np.minimum(zones.left_size[x], zones.left_size[y]))
            later, found = np.where(ord_[x] < ord_[y], y, x), left + right >= length
            np.maximum.at(before, later[found], left[found])
            np.maximum.at(behind, later[found], right[found])
    for i, j in zip(edge[:-1], edge[1:]):
        if j - i > PAIRED:
            for at, hit in enumerate(_group_hits([(*zones.bytes_of(k), int(ord_[k])) for k in range(i, j)], length), i):
                if hit:
                    before[at], behind[at] = hit
    return before, behind


def _merge_bucket(table: pa.Table, length: int) -> np.ndarray:
    """Repeated stretches ``(row, lo, hi)`` of a bucket."""
    out, ready, numbers = [np.zeros((0, 3), np.int64)], [], []
    wide, left_wide = widths(length)
    part: list[list[np.ndarray]] = []

    def decode() -> None:
        shared, tail, data, left_size, left = (np.concatenate(c) for c in zip(*part))
        shown = np.arange(left_wide) < left_size[:, None]
        lefts = np.zeros(shown.shape, np.uint8)
        lefts[shown] = left
        ready.append(Zones(front_decode(shared, tail, data, wide), shared + tail, lefts, left_size))
        part.clear()

    for row in table.to_pylist():
        place, ord_, number = (_unpacked(row[c]) for c in ("place", "ord", "row"))
        if not row["shared"]:  # settled in its task
            out.append(np.stack([number, place, ord_], axis=1))
            continue
        shared, tail, left_size = (np.frombuffer(row[c], np.int32) for c in ("shared", "tail", "left_size"))
        data, left = (np.frombuffer(zstandard.decompress(row[c]), np.uint8) for c in ("data", "left_data"))
        part.append([shared, tail, data, left_size, left])
        numbers.append(np.stack([np.full(len(place), len(numbers)), ord_, number, place]))
        if sum(len(p[0]) for p in part) >= ROWS:
            decode()
    if part:
        decode()
    if not ready:
        return merged(out[0] if len(out) == 1 else np.concatenate(out))
    zones, (run, ord_, number, place) = Zones.joined(ready), np.concatenate(numbers, axis=1)
    ready.clear()

    # equal zones: the earliest document keeps them
    h = row_hashes(zones.rows)
    order = np.lexsort((ord_, h))
    same = h[order[1:]] == h[order[:-1]]
    for i in range(0, len(same), ROWS):
        y = order[i + 1 : i + ROWS + 1]
        x = order[i : i + len(y)]
        same[i : i + ROWS] &= (zones.rows[x] == zones.rows[y]).all(axis=1)
    start = np.flatnonzero(np.r_[True, ~same])
    of = np.empty(len(zones), np.int64)  # the one a zone is represented by
    of[order] = np.repeat(order[start], np.diff(np.r_[start, len(order)]))
    gone = np.flatnonzero(ord_ != ord_[of])
    out.append(np.stack([number[gone], place[gone] - zones.left_size[gone], place[gone] + zones.size[gone]], axis=1))

    # different zones of one gram: put together by the loser tree, those whose gram is alone left out
    ones = np.flatnonzero(of == np.arange(len(zones)))
    gram = np.zeros((len(ones), 8 * -(-min(GRAM, length) // 8)), np.uint8)
    gram[:, : min(GRAM, length)] = zones.key[ones, : min(GRAM, length)]
    _, at, times = np.unique(row_hashes(gram), return_inverse=True, return_counts=True)
    ones = ones[times[at] > 1]
    if len(ones):
        edge = np.flatnonzero(np.r_[True, run[ones][1:] != run[ones][:-1], True])
        runs = [Run(*front_code_rows(zones.key[ones[i:j]], zones.size[ones[i:j]])) for i, j in zip(edge[:-1], edge[1:])]
        begin = edge.tolist()
        came = np.array([(begin[r] + i, shared) for r, i, _, shared in merge_runs(runs)], np.int64)
        ones, group = ones[came[:, 0]], np.cumsum(came[:, 1] < min(GRAM, length))
        before, behind = (np.full(len(zones), -1, np.int64) for _ in range(2))
        before[ones], behind[ones] = _stretches(zones.take(ones), ord_[ones], group, length)
        hit = np.flatnonzero((behind[of] >= 0) & (ord_ == ord_[of]))
        out.append(np.stack([number[hit], place[hit] - before[of[hit]], place[hit] + behind[of[hit]]], axis=1))
    return merged(np.concatenate(out))


def _bytes(text: object) -> bytes:
    return text.encode("utf-8", "replace") if isinstance(text, str) else b""


def shared_key(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a gram's hash; buckets follow each other as hashes do."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def filter_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits that ``gram_key``s set among those of their bucket."""
    keys = keys.view(np.uint64)
    return keys % np.uint64(bits), ((keys * _SPREAD) >> np.uint64(20)) % np.uint64(bits)


def in_filter(words: np.ndarray, bits: int, h: np.ndarray, buckets: int) -> np.ndarray:
    """Which hashes of grams have both bits set in a filter, whose buckets have ``bits`` bits each."""
    base = shared_key(h, buckets) * np.uint64(bits)
    found = np.ones(len(h), bool)
    for place in filter_places(gram_key(h), bits):
        bit = base + place
        found &= (words[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return found


def filter_bits(buckets: int) -> int:
    return max(64, min(BUCKET_BITS, FILTER_BITS // buckets) & ~7)


def gram_rows(texts: list[bytes], length: int, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Buckets, and the first bytes of the hashes of the anchors' grams that go there."""
    found, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for data, piece, ends, doc_of, _ in blocks(texts, length):
        _, _, anchor, h = zones(np.frombuffer(data, np.uint8), ends, length)
        found.append(h)
        docs.append(doc_of[piece[anchor]])
    h, doc = np.concatenate(found), np.concatenate(docs)
    # six bytes of a hash: equal ones only cost work
    low = np.uint64(64 - 8 * GRAM_BYTES)
    if len(texts) <= 1 << int(low):
        both = np.sort((h >> low << low) | doc.astype(np.uint64))
        h = both >> low << low
        new = np.r_[True, both[1:] != both[:-1]]
    else:
        order = np.lexsort((doc, h >> low))
        h, doc = h[order] >> low << low, doc[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    if not len(h):
        return np.zeros(0, np.int32), []
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    texts_of = np.add.reduceat(new.astype(np.int64), start)
    # of one text once, of two or three texts twice, and so on
    sent = np.repeat(h[start], 1 + np.log2(texts_of).astype(np.int64))
    bucket = shared_key(sent, buckets).astype(np.int32)
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    six = np.ascontiguousarray(sent.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES]).tobytes()
    stop = np.r_[edge[1:], len(sent)]
    return bucket[edge], [six[GRAM_BYTES * i : GRAM_BYTES * j] for i, j in zip(edge.tolist(), stop.tolist())]


def several(parts: list[bytes], bits: int, most: int) -> tuple[bytes, bytes]:
    """The bits of the grams of a bucket that are in two documents or more, and the keys of those sent more than ``most`` times."""
    six = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, GRAM_BYTES)
    every = np.zeros((len(six), 8), np.uint8)
    every[:, 8 - GRAM_BYTES :] = six
    every = np.sort(every.view(">u8").ravel().astype(np.uint64))
    start = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    n = np.diff(np.r_[start, len(every)])
    flags = np.zeros(bits, bool)
    for place in filter_places(every[start][n > 1], bits):
        flags[place.astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes(), every[start][n > most].tobytes()


def shared_grams(texts: DataFrame, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter of the grams of anchors in two documents or more, and a bitmap of the hot ones among them.

    Both only spare other zones the exchange.
    """
    bits, most = filter_bits(buckets), HOT_SENDS

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, parts = gram_rows([_bytes(t) for t in batch.column("text").to_pylist()], length, buckets)
            if len(parts):
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(parts, pa.binary())], ["bucket", "grams"])

    def found(table: pa.Table) -> pa.Table:
        words, hot = several(table.column("grams").to_pylist(), bits, most)
        return pa.table({"bucket": table.column("bucket")[:1], "words": pa.array([words], pa.binary()), "hot": pa.array([hot], pa.binary())})

    packed = texts.select("text").mapInArrow(grams, "bucket int, grams binary")
    with small_batches(texts.sparkSession, BATCH_DOCS):
        rows = packed.groupBy("bucket").applyInArrow(found, "bucket int, words binary, hot binary").toArrow()
    words, hot = np.zeros(buckets * bits // 8, np.uint8), np.zeros(HOT_BITS // 32, np.uint32)
    for batch in rows.to_batches():
        for bucket, part, keys in zip(*[batch.column(c) for c in ("bucket", "words", "hot")]):
            begin = bucket.as_py() * bits // 8
            words[begin : begin + bits // 8] = np.frombuffer(part.as_buffer(), np.uint8)
            bit = np.frombuffer(keys.as_py(), np.uint64) % np.uint64(HOT_BITS)
            np.bitwise_or.at(hot, (bit >> np.uint64(5)).astype(np.int64), np.uint32(1) << (bit & np.uint64(31)).astype(np.uint32))
    return words, hot


def task_runs(batches: Iterator[tuple[list[int], list[int], list[bytes]]], words: np.ndarray, hot: np.ndarray, length: int, buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """The runs of a task, from ``(rows, ords, texts)``."""
    sorter, bits = _Sorter(buckets, length, most), filter_bits(buckets)
    seen: dict[bytes, int] = {}  # digests of the texts of this task, and their earliest document
    for rows, ords, texts in batches:
        whole = []
        for i, text in enumerate(texts):
            if len(text) >= length:
                digest = hashlib.blake2b(text, digest_size=16).digest()
                if seen.setdefault(digest, ords[i]) < ords[i]:
                    whole.append((rows[i], 0, len(text)))
                    texts[i] = b""
                else:
                    seen[digest] = ords[i]
        sorter.settled.append(np.array(whole, np.int64).reshape(-1, 3))
        row_of, ord_of = np.array(rows, np.int64), np.array(ords, np.int64)
        for data, piece, ends, doc_of, shift in blocks(texts, length):
            first, last, anchor, h = zones(np.frombuffer(data, np.uint8), ends, length)
            here = np.flatnonzero(in_filter(words, bits, h, buckets))
            first, last, anchor, h = (a[here] for a in (first, last, anchor, h))
            at = piece[anchor]
            bucket, doc = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), doc_of[at]
            cut = cut_zones(data, first, last, anchor, length)
            yield from sorter.add(cut, bucket, ord_of[doc], row_of[doc], anchor - shift[at], in_bitmap(hot, gram_key(h)))
    yield from sorter.flush()


def repeat_hits(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(row, lo, hi)``: stretches of text ``row`` that occur in an earlier one of ``(row, ord, size, text)``."""
    spark = texts.sparkSession
    size = texts.agg(F.sum("size").alias("b")).first()["b"] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    shared, hot = (spark.sparkContext.broadcast(a) for a in shared_grams(texts, length, buckets))
    most = RUN_SUFFIXES

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ((b.column("row").to_pylist(), b.column("ord").to_pylist(), [_bytes(t) for t in b.column("text").to_pylist()]) for b in batches)
        return task_runs(read, shared.value, hot.value, length, buckets, most)

    def merge(table: pa.Table) -> pa.Table:
        hits = _merge_bucket(table, length)
        return pa.table({"row": hits[:, 0], "lo": hits[:, 1].astype(np.int32), "hi": hits[:, 2].astype(np.int32)})

    return texts.select("row", "ord", "text").mapInArrow(suffixes, RUN_SCHEMA).groupBy("bucket").applyInArrow(merge, HIT_SCHEMA)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut stretches out of texts. Ids and texts stay in Arrow."""
    for batch in batches:
        sizes, removed, spans, kept = [], [], [], []
        for text, los, his in zip(*[batch.column(c).to_pylist() for c in ("text", "lo", "hi")]):
            data, runs = _bytes(text), []
            for lo, hi in sorted(zip(los or (), his or ())):
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            edges = [0, *[e for r in runs for e in r], len(data)]
            sizes.append(len(data))
            removed.append(sum(b - a for a, b in runs))
            spans.append([{"lo": a, "hi": b} for a, b in runs])
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        span_type = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        values = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(map(len, spans), pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(values, ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, spans, kept``.

    ``spans`` are the removed stretches ``(lo, hi)`` in bytes of the text, ``kept`` the bytes that are left. Documents
    come in the order of ``doc_id``, a null id behind all others; rows with equal ids, null ones included, remove nothing
    from each other. Null texts are empty, and texts shorter than ``length`` stay whole. Very long texts are read whole.
    Equal rows get equal results. An empty table gives no rows; extra columns are not read.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), order.alias("ord"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    numbered = numbered.withColumn("size", F.octet_length("text"))  # read alone
    texts = stage(numbered, "texts", BATCH_DOCS)
    hits = stage(repeat_hits(texts, length), "hits", BATCH_DOCS)
    spans = hits.groupBy("row").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    schema = "doc_id {}, n_bytes long, n_removed long, n_spans long, spans array<struct<lo:int,hi:int>>, kept binary"
    found = texts.join(spans, "row", "left").select("doc_id", "text", "lo", "hi")
    return found.mapInArrow(_cut, schema.format(docs.schema["doc_id"].dataType.simpleString()))
