"""Removal of repeated 100-byte strings by a distributed merge sort of sampled suffixes.

Sampling.  Every window of SPAN bytes picks the position of its least KMER-byte hash (leftmost of equal ones).  Equal windows
pick equal positions, so it suffices to sort the suffixes at picked positions ("anchors"), about one in 35.  An anchor stands
for the windows that picked it and carries the bytes these cover: `right` from the anchor on, at most SPAN, and `left` before it.

1. Anchors' hashes are exchanged in sorted, delta-coded blocks; those that occur twice fill a filter of fixed size.
2. Anchors that pass are exchanged with a 64-bit digest of all their bytes.  Of anchors with the same bytes all but the earliest
   are repeats in full.  Where one hash comes with several contexts, the earliest anchor of each fills a second filter.
3. Each task sorts the suffixes of anchors that pass both into runs, front-codes them (length of the prefix shared with the
   previous suffix, then the rest) and exchanges them by hash bucket.  Equal contexts within a run travel once.
4. A bucket's runs are combined with loser trees that keep, for each candidate, the length of the prefix it is known to share
   with the last output, and compare bytes only from there on; one tree for each fine bucket, all advancing in step.  The
   merge leaves the suffixes in order with the shared prefix lengths of neighbours.  The (reversed) left contexts are sorted too.
5. Two windows that lie o bytes before their anchors are equal where the suffixes share SPAN - o bytes and the left contexts
   o bytes, that is, where no smaller shared length lies between them in either order.  In each such class all but the
   earliest window are repeats; their byte ranges go back to their documents.

Filters only let more anchors pass than needed, never fewer, so what they hold does not change the result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recovery import release, stored
from .text import mix, slices, utf8

SPAN, KMER = 100, 32
REACH = SPAN - KMER  # most bytes before an anchor
PICKS = REACH + 1  # k-mers in a window
WIDTH = 104  # SPAN in whole 64-bit words
#: Bits of the filter of repeated anchors, in blocks of a hash range; 16 MB in all.
FILTER_BLOCKS, BLOCK_BITS = 256, 1 << 19
FINE = 256  # loser trees that advance in step in a bucket
FAN_IN = 64  # runs that one tree combines
RUN = 360_000  # anchors in a run: what repeats within it travels once
_BYTE = np.random.default_rng(1990).integers(1, 2**64, 256, dtype=np.uint64)
_B = 0x9E3779B97F4A7C15


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, hash) positions in data for all windows that lie within one text."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none.astype(np.uint64)
    h, step = _BYTE[data], 1
    while step < KMER:
        h = h[:-step] * np.uint64(pow(_B, step, 2**64)) + h[step:]
        step *= 2
    h = mix(h)
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= PICKS:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < PICKS:
        least = np.minimum(least[: len(least) - (PICKS - size)], least[PICKS - size :])
    picked = (least & low).astype(np.int64)
    valid = np.ones(n + SPAN, bool)
    for back in range(1, SPAN):
        valid[np.maximum(offsets[1:] - back, 0)] = False
    v = np.flatnonzero(valid[: len(picked)])
    if not len(v):
        return none, none, none, none.astype(np.uint64)
    at = picked[v]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(v) != 1)]))
    last = np.append(new[1:], len(v)) - 1
    p = at[new]
    return p, v[new], v[last], h[p]


def _segments(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple]:
    """(ids, digests, bases, data, offsets) of about `most` bytes; a longer text comes in pieces that share SPAN - 1 bytes."""
    for batch in slices(batches, "text", most):
        ids, digests = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "digest"))
        data, offsets = utf8(batch.column("text"))
        if batch.num_rows == 1 and len(data) > 2 * most:
            for a in range(0, len(data) - SPAN + 1, most):
                piece = data[a : a + most + SPAN - 1]
                yield ids, digests, np.array([a]), piece, np.array([0, len(piece)])
        else:
            yield ids, digests, np.zeros(len(ids), np.int64), data, offsets


def _packed(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))


def _planes(deltas: np.ndarray) -> np.ndarray:
    """64-bit numbers as eight planes of bytes, which compress well where the high ones are zero."""
    return np.ascontiguousarray(deltas.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, payload): sorted anchor hashes of a filter block, with a mark for those met twice."""
    held, count = [], 0

    def out() -> pa.RecordBatch:
        keys, times = np.unique(np.concatenate(held), return_counts=True)
        cut = np.searchsorted(keys >> np.uint64(56), np.arange(FILTER_BLOCKS + 1, dtype=np.uint64))
        blobs = [_packed(_planes(np.diff(keys[a:b], prepend=np.uint64(0))), np.packbits(times[a:b] > 1)) for a, b in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(FILTER_BLOCKS, dtype=np.int32)), pa.array(blobs, pa.binary())], ["bucket", "payload"])

    for _, _, _, data, offsets in _segments(batches):
        held.append(anchors(data, offsets)[3])
        count += len(held[-1])
        if count > 1 << 21:
            yield out()
            held, count = [], 0
    if count:
        yield out()


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key within its filter block."""
    mask = np.uint64(BLOCK_BITS - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(24)) & mask).astype(np.int64)


def _filter_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
            by.setdefault(bucket, []).append(blob)
    for bucket, blobs in by.items():
        keys, twice = [], []
        for planes, marks in map(_unpacked, blobs):
            k = np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)
            keys.append(k)
            twice.append(k[np.unpackbits(marks, count=len(k)).astype(bool)])
        k = np.sort(np.concatenate(keys))
        again = np.concatenate([*twice, k[1:][k[1:] == k[:-1]]])
        bits = np.zeros(BLOCK_BITS, np.uint8)
        for slot in _slots(again):
            bits[slot] = 1
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bucket", "payload"])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the shared prefix of rows of two byte matrices."""
    same = a == b
    return np.where(same.all(1), a.shape[1], same.argmin(1))


def _run(held: list[tuple], buckets: int) -> pa.RecordBatch:
    """A sorted, front-coded run of anchors, cut by bucket."""
    key, doc, pos, right, left, suffix, before, ids, digests = (np.concatenate([h[i] for h in held]) for i in range(9))
    held.clear()
    place = (key >> np.uint64(32)).astype(np.int64) % (buckets * FINE)
    # by bucket and suffix, then by what tells contexts apart, then by position
    order = np.lexsort((pos, digests[doc], ids[doc], np.ascontiguousarray(before).view(f"S{REACH}").ravel(), left, right, suffix.view(f"S{WIDTH}").ravel(), place))
    place, doc, pos, right, left, suffix, before = (x[order] for x in (place, doc, pos, right, left, suffix, before))
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = _common(suffix[1:], suffix[:-1])
    equal = np.zeros(len(order), bool)
    equal[1:] = (lcp[1:] == WIDTH) & (right[1:] == right[:-1]) & (left[1:] == left[:-1]) & (place[1:] == place[:-1]) & (before[1:] == before[:-1]).all(1)
    lcp[1:] = np.where(place[1:] == place[:-1], np.minimum(lcp[1:], np.minimum(right[1:], right[:-1])), 0)
    lead = np.flatnonzero(~equal)
    owner = np.cumsum(~equal) - 1
    cut = np.searchsorted(place[lead], np.arange(buckets + 1) * FINE)
    names, blobs = [], []
    for bucket in np.flatnonzero(np.diff(cut)):
        a, b = cut[bucket], cut[bucket + 1]
        i = lead[a:b]
        later = np.flatnonzero(equal & (owner >= a) & (owner < b)) if equal.any() else i[:0]
        used, doc_of = np.unique(doc[np.concatenate([i, later])], return_inverse=True)
        column = np.arange(WIDTH)
        tail = suffix[i][(column >= lcp[i][:, None]) & (column < right[i][:, None])]
        lefts = before[i][np.arange(REACH) < left[i][:, None]]
        small = lambda x, kind: x.astype(kind)
        blobs.append(_packed(small(place[i] - bucket * FINE, np.uint16), small(lcp[i], np.uint8), small(right[i], np.uint8), small(left[i], np.uint8), tail, lefts, small(doc_of, np.int32), _planes(np.concatenate([pos[i], pos[later]])), small(owner[later] - a, np.int32), ids[used], digests[used]))
        names.append(bucket)
    return pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int32)), pa.array(blobs, pa.binary())], ["bucket", "payload"])


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter may hold; all that it holds are among them."""
    block, keep = (hashes >> np.uint64(56)).astype(np.int64) * BLOCK_BITS, np.ones(len(hashes), bool)
    for slot in _slots(hashes):
        at = block + slot
        keep &= (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
    return keep


def _identity(ids: np.ndarray, digests: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A hash of a place: document and position."""
    return mix(mix(mix(ids.view(np.uint64)) + digests.view(np.uint64)) + pos.astype(np.uint64))


class _Contexts:
    """Digests of byte ranges, from running sums over a segment."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            n = len(data) + 1
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_B, pow(_B, -1, 2**64)))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * self.up[: len(data)], dtype=np.uint64)])
        return mix((sums[end] - sums[start]) * self.down[start] + mix((left.astype(np.uint64) << np.uint64(32)) + (end - start).astype(np.uint64)))


def _places(table, buckets: int):
    """(bucket, payload): anchors that pass the filter, with the digests of their contexts."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        key, digest, doc, pos, right, left, ids, digests = (np.concatenate([h[i] for h in held]) for i in range(8))
        bucket = ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((digest, key, bucket))
        key, digest, doc, pos, right, left, bucket = (x[order] for x in (key, digest, doc, pos, right, left, bucket))
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        names = np.flatnonzero(np.diff(cut))
        blobs = []
        for a, b in zip(cut[names], cut[names + 1]):
            used, doc_of = np.unique(doc[a:b], return_inverse=True)
            blobs.append(_packed(_planes(np.diff(key[a:b], prepend=np.uint64(0))), _planes(digest[a:b]), doc_of.astype(np.int32), _planes(pos[a:b]), right[a:b].astype(np.uint8), left[a:b].astype(np.uint8), ids[used], digests[used]))
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "payload"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, contexts = np.frombuffer(table.value, np.uint8), _Contexts()
        held, count, docs = [], 0, 0
        for ids, digests, bases, data, offsets in _segments(batches):
            p, a, b, key = anchors(data, offsets)
            keep = _passes(bits, key)
            p, a, b, key = p[keep], a[keep], b[keep], key[keep]
            doc = np.searchsorted(offsets, p, "right") - 1
            held.append((key, contexts.of(data, a, b + SPAN, p - a), doc + docs, p - offsets[doc] + bases[doc], b + SPAN - p, p - a, ids, digests))
            docs += len(ids)
            count += len(p)
            if count > 2 * RUN:
                yield out(held)
                held, count, docs = [], 0, 0
        if count:
            yield out(held)

    return rows


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, payload) of a bucket of `_places`: ranges of later copies (0), and, by filter block, the places of the
    earliest of several contexts of one hash (1)."""
    by: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
            by.setdefault(bucket, []).append(blob)
    while by:
        bucket, blobs = by.popitem()
        parts = [_unpacked(b) for b in blobs]
        plain = lambda planes, kind: np.ascontiguousarray(planes.T).view(kind).ravel()
        key = np.concatenate([np.cumsum(plain(p[0], "<u8"), dtype=np.uint64) for p in parts])
        digest, pos = np.concatenate([plain(p[1], "<u8") for p in parts]), np.concatenate([plain(p[3], "<i8") for p in parts])
        ids, digests = np.concatenate([p[6][p[2]] for p in parts]), np.concatenate([p[7][p[2]] for p in parts])
        right, left = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (4, 5))
        order = np.lexsort((pos, digests, ids, digest, key))
        key, digest, ids, digests, pos, right, left = (x[order] for x in (key, digest, ids, digests, pos, right, left))
        same_key = np.concatenate([[False], key[1:] == key[:-1]])
        copy = same_key & np.concatenate([[False], digest[1:] == digest[:-1]])
        group = np.cumsum(~same_key) - 1
        several = (np.bincount(group, ~copy) > 1)[group] & ~copy
        place = np.sort(_identity(ids[several], digests[several], pos[several]))
        cut = np.searchsorted(place >> np.uint64(56), np.arange(FILTER_BLOCKS + 1, dtype=np.uint64))
        rows = [(bucket, 0, _packed(ids[copy], digests[copy], pos[copy] - left[copy], pos[copy] + right[copy]))]
        rows += [(b, 1, _packed(place[cut[b] : cut[b + 1]])) for b in np.flatnonzero(np.diff(cut)).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "payload"])


def _place_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
            bits = blocks.setdefault(bucket, np.zeros(BLOCK_BITS, np.uint8))
            for slot in _slots(_unpacked(blob)[0]):
                bits[slot] = 1
    for bucket, bits in blocks.items():
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bucket", "payload"])


def _copy_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("payload").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpacked(blob)], ["key", "digest", "start", "end"])


def _runs(table, places, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, wanted = np.frombuffer(table.value, np.uint8), np.frombuffer(places.value, np.uint8)
        held, count, docs = [], 0, 0
        for ids, digests, bases, data, offsets in _segments(batches):
            p, a, b, key = anchors(data, offsets)
            doc = np.searchsorted(offsets, p, "right") - 1
            keep = np.flatnonzero(_passes(bits, key))
            at = doc[keep]
            keep = keep[_passes(wanted, _identity(ids[at], digests[at], p[keep] - offsets[at] + bases[at]))]
            p, a, b, key, doc = p[keep], a[keep], b[keep], key[keep], doc[keep]
            right, left = b + SPAN - p, p - a
            padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(WIDTH, np.uint8)])
            suffix = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[p + REACH].copy()
            suffix[np.arange(WIDTH) >= right[:, None]] = 0
            before = np.lib.stride_tricks.sliding_window_view(padded, REACH)[p][:, ::-1].copy()
            before[np.arange(REACH) >= left[:, None]] = 0
            held.append((key, doc + docs, p - offsets[doc] + bases[doc], right, left, suffix, before, ids, digests))
            docs += len(ids)
            count += len(p)
            if count > RUN:
                yield _run(held, buckets)
                held, count, docs = [], 0, 0
        if count:
            yield _run(held, buckets)

    return rows


class Suffixes:
    """Suffixes of one bucket as rows of big-endian words, for comparisons that start at a known shared length."""

    def __init__(self, matrix: np.ndarray):
        self.words = np.ascontiguousarray(matrix).view(">u8").astype(np.uint64)
        self.last = self.words.shape[1]

    def compare(self, x: np.ndarray, y: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether x comes first (equal ones: the smaller index), and the full shared length, given a known part of it."""
        first, shared = x < y, np.full(len(x), self.last * 8, np.int64)
        word = known // 8
        todo = np.flatnonzero(word < self.last)
        word = word[todo]
        while len(todo):
            a, b = self.words[x[todo], word], self.words[y[todo], word]
            apart = a != b
            diff = (a ^ b)[apart]
            zero = sum((diff < np.uint64(1 << s)).astype(np.int64) for s in range(8, 64, 8))
            i = todo[apart]
            first[i], shared[i] = a[apart] < b[apart], word[apart] * 8 + zero
            todo, word = todo[~apart], word[~apart] + 1
            more = word < self.last
            todo, word = todo[more], word[more]
        return first, shared


def merge(suffixes: Suffixes, lcp: np.ndarray, fine: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by (fine bucket, suffix), with each one's shared length with its predecessor there.

    The input is sorted by (run, fine bucket, suffix), lcp being the length shared with the predecessor in run and bucket.
    Runs are combined by LCP loser trees of FAN_IN leaves, one for each fine bucket, in as many rounds as needed.
    """
    order = np.arange(len(lcp))
    while True:
        group, leaf = run // FAN_IN, run % FAN_IN
        tree = group * FINE + fine
        by = np.lexsort((np.arange(len(order)), leaf, tree))
        out, shared = _one_round(suffixes, order[by], lcp[by], tree[by], leaf[by])
        tree = tree[by]
        sort = np.argsort(tree, kind="stable")
        order, lcp, run, fine = out, shared, tree[sort] // FINE, tree[sort] % FINE
        if run.max() == 0:
            return order, lcp


def _one_round(s: Suffixes, item: np.ndarray, lcp: np.ndarray, tree: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the leaves of every tree; rows are sorted by (tree, leaf), then in order.  Returns rows sorted by tree, suffix."""
    k = 1 << max(1, int(leaf.max()).bit_length())
    trees, row_tree = np.unique(tree, return_inverse=True)
    slot = row_tree * k + leaf
    begin = np.searchsorted(slot, np.arange(len(trees) * k))
    end = np.searchsorted(slot, np.arange(len(trees) * k), "right")
    head = np.where(begin < end, begin, -1).reshape(-1, k)  # next row of each leaf, -1: none
    end = end.reshape(-1, k)
    loser = np.full((len(trees), k), -1, np.int64)
    loser_lcp = np.full((len(trees), k), -1, np.int64)

    def play(x, lx, y, ly):
        """Winners and losers of x against y with known shared lengths; -1 is no suffix and always loses."""
        x_wins, equal = lx > ly, np.flatnonzero((lx == ly) & (lx >= 0))
        lose_lcp = np.where(x_wins, ly, lx)
        if len(equal):
            first, shared = s.compare(item[x[equal]], item[y[equal]], lx[equal])
            x_wins[equal], lose_lcp[equal] = first, shared
        return np.where(x_wins, x, y), np.where(x_wins, lx, ly), np.where(x_wins, y, x), lose_lcp

    level, level_lcp, width = head, np.where(head >= 0, 0, -1), k
    while width > 1:
        w, wl, lo, ll = play(*(a.ravel() for a in (level[:, ::2], level_lcp[:, ::2], level[:, 1::2], level_lcp[:, 1::2])))
        width //= 2
        loser[:, width : 2 * width], loser_lcp[:, width : 2 * width] = lo.reshape(-1, width), ll.reshape(-1, width)
        level, level_lcp = w.reshape(-1, width), wl.reshape(-1, width)
    won, won_lcp = level[:, 0], level_lcp[:, 0]
    write = np.searchsorted(row_tree, np.arange(len(trees)))
    out, shared = np.empty(len(item), np.int64), np.empty(len(item), np.int64)
    live = np.flatnonzero(won >= 0)
    while len(live):
        w = won[live]
        out[write[live]], shared[write[live]] = item[w], won_lcp[live]
        write[live] += 1
        at = leaf[w]
        more = w + 1 < end[live, at]
        x = np.where(more, w + 1, -1)
        lx = np.where(more, lcp[np.minimum(w + 1, len(lcp) - 1)], -1)  # its shared length with w, the last output
        node = (at + k) >> 1
        while node[0] >= 1:
            x, lx, y, ly = play(x, lx, loser[live, node], loser_lcp[live, node])
            loser[live, node], loser_lcp[live, node] = y, ly
            node = node >> 1
        won[live], won_lcp[live] = x, lx
        live = live[x >= 0]
    return out, shared


def _decoded(blobs: list[bytes]) -> tuple:
    parts = [_unpacked(b) for b in blobs]
    fine, lcp, right, left, tail, lefts = (np.concatenate([p[i] for p in parts]).astype(np.int64 if i < 4 else np.uint8) for i in range(6))
    run = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    n, column = len(lcp), np.arange(WIDTH)
    own = (column >= lcp[:, None]) & (column < right[:, None])
    suffix = np.zeros((n, WIDTH), np.uint8)
    suffix[own] = tail
    rows = np.arange(n)
    for j in range(SPAN):  # a byte within the shared prefix is that of the last suffix that spells it out
        src = np.maximum.accumulate(np.where(lcp <= j, rows, 0))
        suffix[:, j] = suffix[src, j]
    before = np.zeros((n, REACH), np.uint8)
    before[np.arange(REACH) < left[:, None]] = lefts
    size = [len(p[0]) for p in parts]
    base = np.cumsum([0, *size])
    pos = [np.ascontiguousarray(p[7].T).view("<i8").ravel() for p in parts]
    doc_ids, doc_digests = [p[9][p[6]] for p in parts], [p[10][p[6]] for p in parts]
    lead = tuple(np.concatenate([x[:m] for x, m in zip(c, size)]) for c in (doc_ids, doc_digests, pos))
    later = tuple(np.concatenate([x[m:] for x, m in zip(c, size)]) for c in (doc_ids, doc_digests, pos))
    owner = np.concatenate([p[8].astype(np.int64) + b for p, b in zip(parts, base)])
    return fine, lcp, right, left, run, suffix, before, lead, later, owner


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest, start, end): byte ranges of documents that repeated windows cover."""
    by: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
            by.setdefault(bucket, []).append(blob)
    while by:
        fine, lcp, right, left, run, suffix, before, lead, later, owner = _decoded(by.popitem()[1])
        n = len(lcp)
        order, lcp = merge(Suffixes(suffix), lcp, fine, run)
        new_bucket = np.concatenate([[True], np.diff(fine[order]) != 0])
        lcp = np.where(new_bucket, 0, lcp)
        back = np.argsort(before.view(f"S{REACH}").ravel(), kind="stable")
        back_lcp = np.concatenate([[0], _common(before[back[1:]], before[back[:-1]])])
        age = np.lexsort((lead[2], lead[1], lead[0]))  # earliest first
        alone = np.zeros(n, bool)
        shared = np.append(lcp, 0)
        alone[order] = np.maximum(shared[:-1], shared[1:]) < KMER
        age = age[~alone[age]]
        starts, stops, who = [], [], []
        right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
        opened = np.full(n, -1, np.int64)  # first repeated offset of the run of offsets that is open
        for o in range(REACH + 2):
            repeat = np.zeros(n, bool)
            if o <= REACH:
                has = age[(left[age] >= o) & (right[age] >= SPAN - o)]
                if len(has) > 1:
                    right_class[order] = np.cumsum(lcp < SPAN - o)
                    left_class[back] = np.cumsum(back_lcp < o)
                    both = right_class[has] * (n + 1) + left_class[has]
                    rank = np.argsort(both, kind="stable")
                    same = np.zeros(len(has), bool)
                    same[1:] = both[rank][1:] == both[rank][:-1]
                    repeat[has[rank[same]]] = True
            closing = np.flatnonzero((opened >= 0) & ~repeat)
            who.append(closing)
            starts.append(lead[2][closing] - (o - 1))
            stops.append(lead[2][closing] - opened[closing] + SPAN)
            opened[closing] = -1
            opened[repeat & (opened < 0)] = o
        who = np.concatenate(who)
        key, digest = np.concatenate([lead[0][who], later[0]]), np.concatenate([lead[1][who], later[1]])
        start, end = np.concatenate([*starts, later[2] - left[owner]]), np.concatenate([*stops, later[2] + right[owner]])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (key, digest, start, end)], ["key", "digest", "start", "end"])


def repeated_ranges(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs (key BIGINT, digest BIGINT, text) to (key, digest, start, end): ranges whose union every repeated window covers."""
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blob, ranges = "bucket int, payload binary", "key long, digest long, start long, end long"

    def filled(blocks: DataFrame):
        """A filter from its blocks, FILTER_BLOCKS rows at most, broadcast."""
        size = BLOCK_BITS // 8
        bits = bytearray(FILTER_BLOCKS * size)
        for r in blocks.toLocalIterator():
            bits[r["bucket"] * size : (r["bucket"] + 1) * size] = r["payload"]
        return spark.sparkContext.broadcast(bytes(bits))

    table = filled(docs.mapInArrow(_hash_blocks, blob).repartition("bucket").mapInArrow(_filter_blocks, blob))
    release(spark)
    found = stored(docs.mapInArrow(_places(table, buckets), blob).repartition(buckets, "bucket").mapInArrow(_copies, "bucket int, kind int, payload binary"))
    places = filled(found.where("kind = 1").select("bucket", "payload").repartition("bucket").mapInArrow(_place_blocks, blob))
    release(spark)
    copies = found.where("kind = 0").select("payload").mapInArrow(_copy_ranges, ranges)
    return copies.union(docs.mapInArrow(_runs(table, places, buckets), blob).repartition(buckets, "bucket").mapInArrow(_repeats, ranges))


def _joined(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, digests_only: bool = False) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept BINARY), or kept_sha256 in place of kept.

    Texts count as UTF-8 bytes, null as empty.  A byte goes if a SPAN-byte string covers it that also starts earlier: in a
    smaller doc_id or earlier in the same text.  Rows of equal doc_id and text are one document (none of them repeats
    another); of rows with one doc_id and different texts a hash of the text decides which is earlier; null ids come first.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = plain.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("digest", F.xxhash64("text"))
    spans = repeated_ranges(keyed.select("key", "digest", "text")).groupBy("key", "digest").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = keyed.join(spans, ["key", "digest"], "left").select("doc_id", "text", "spans")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            raw, out = data.tobytes(), []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                text, gone = raw[offsets[i] : offsets[i + 1]], _joined(spans or [])
                kept = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)]))
                out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest() if digests_only else kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*out))], ["doc_id", "n_bytes", "n_removed", "n_spans", last])

    last = "kept_sha256" if digests_only else "kept"
    return joined.mapInArrow(rows, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {'string' if digests_only else 'binary'}")
