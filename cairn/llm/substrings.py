"""Substring dedup: near-duplicate passages by compact windows.

A document is its sequence of 5-word shingle hashes. For each of ``HASHES`` hash functions the
Cartesian tree over the hashed sequence (smallest value at the root) names its compact windows: node
``c`` with range ``l`` to ``r`` stands for all subsequences between ``l`` and ``r`` that contain ``c``; they share
that min-hash. Only nodes whose range holds ``LENGTH`` shingles are kept, about ``2 n / LENGTH`` for each
function, and every passage of that length lies in exactly one of them. Long documents grow trees over
pieces of ``ROUND`` positions that overlap by one passage less a shingle, which keeps that true.

1. Of windows that are alike in min-hash and in the shingles 16 places to either side, a batch of documents
   sends on those of two documents and pairs the others with the first at once. What is left is dealt
   out by min-hash and met in order: a window pairs with the first window of its group, of its context
   on the left and on the right, and with the one before it (a window of the first's own document with the
   first of another document). Rows grow with the windows, never with their pairs, and a task
   holds distinct windows only, however large a group is.
2. Pairs of windows of two documents are sorted by diagonal; where overlapping intervals come from
   at least ``AGREE`` of the functions, a few anchors go on.
3. Verification: for each pair of documents the words around its anchors travel to the other document, where the
   Jaccard similarity of passages of ``LENGTH`` shingles (as sets of 64-bit hashes) that contain an anchor
   decides (``PERCENT``/100 or more). Overlapping verified passages are merged. A document with more
   than ``SALT`` anchors is copied to several tasks that share them.
4. Exact repeats don't rest on partners. Equal runs of ``LENGTH`` shingles lie in windows of equal min-hash
   under every function, and reach 16 shingles to the left or to the right of its place; so runs all of whose windows share
   min-hash and a context with another document are hashed, and each occurrence of a run in another
   document than the first matches the first. None is lost, and rows grow with the repeated words.

Documents with equal sequences of words are one to these steps; the others of each such class then match its first.

5. Near repeats meet in steps 1 and 2 with high probability only. So what is found so far makes components of documents, and
   what could still link two of them is looked for exactly: shingles that several components have are marked in
   a bitmap; a passage can match in another component only if 75 % of its distinct shingles are marked, and
   two that match have a common one among a few smallest of each (its seeds). Seeds carry the 45 shingles to either side (32 bits of each) to where
   equal ones meet; there all passages around them that can match are compared, until no two components are left that a match
   joins, and only those matches go through step 3. So rows grow with the seeds, not with their pairs; documents
   that hold matching passages are always in one component of the links, up to hash collisions; of documents in one
   component, not each pair is a row.

Defined cases: null and empty texts, and those under ``LENGTH + 4`` words, have no passages; passages
repeated inside one document alone are not reported; a null ``doc_id`` is not compared; rows that repeat an id
with different texts are compared each for itself, though never with one another; rows that repeat id
and text are one; of equally early occurrences the smaller place comes first; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkTables, hash_runs, hash_words, likely_in, prepare, shingles_of, text_bytes, uncollected, unlikely_in, word_spans
from .components import components, spread_join

WIDTH = 5
LENGTH = 46
HASHES = 4
AGREE = 2
PERCENT = 75
CONTEXT = 16
#: Positions of one round of tree building.
ROUND = 1 << 16
_POSITION = 16
#: Anchors in one document that one task verifies.
SALT = 2000
#: Windows that wait until they are met with those before, at least.
PENDING = 200_000
#: Odd multipliers of the hash functions (fixed values).
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def mixed(tokens: np.ndarray, k: int) -> np.ndarray:
    x = tokens ^ (tokens >> np.uint64(31))
    x = x * np.uint64(_ODD[k])
    x ^= x >> np.uint64(29)
    return x * np.uint64(_ODD[k] ^ 0x5555555555555554)


def compact_windows(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``l, c, r`` (inclusive) of all tree nodes of at least ``length`` positions, for many sequences that lie in one array.

    A node is so long if and only if it is the smallest value (the leftmost of equals) of some ``length`` positions. Its range grows
    to either side by halving steps over a sparse table, all nodes at once; so equal values, whose trees are chains, cost no more.
    """
    n = len(values)
    live = stops - starts >= length
    starts, stops = starts[live], stops[live]
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z
    depth = int((stops - starts).max()).bit_length()
    table = np.empty((depth, n), np.uint64)
    np.bitwise_or(values >> np.uint64(_POSITION) << np.uint64(_POSITION), np.arange(n, dtype=np.uint64), out=table[0])
    for k in range(1, depth):
        half = 1 << (k - 1)
        np.minimum(table[k - 1, : n - half], table[k - 1, half:], out=table[k, : n - half])
        table[k, n - half :] = table[k - 1, n - half :]
    k = length.bit_length() - 1
    first, off = n - length + 1, length - (1 << k)
    least = np.minimum(table[k, :first], table[k, off : off + first])
    new = np.ones(first, bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    begin = np.flatnonzero(new)  # smallest places follow one another, so each is one run of starts in its sequence
    begin = np.unique(np.concatenate([begin, starts]))
    of = np.searchsorted(starts, begin, "right") - 1
    within = (of >= 0) & (begin + length <= stops[of])
    of = of[within]
    c = (least[begin[within]] & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    start, stop, own = starts[of], stops[of], table[0, c]
    low, high = c.copy(), c + 1
    for k in range(depth - 1, -1, -1):
        size = 1 << k
        at = low - size
        low = np.where((at >= start) & (table[k, np.maximum(at, 0)] > own), at, low)
        high = np.where((high + size <= stop) & (table[k, np.minimum(high, n - 1)] > own), high + size, high)
    return low, c, high - 1


_WINDOWS = "kind int, slot bigint, doc_id bigint, row bigint, n int, s1 bigint, s2 bigint, pid int, payload binary"
_WINDOW_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_RECORD = np.dtype([("value", "<u8"), ("own", "<u4"), ("l", "<i4"), ("c", "<i4"), ("r", "<i4"), ("left", "<u2"), ("right", "<u2"), ("hash", "<u2"), ("pad", "<u2")])
DOCUMENT, MEETING, MET = 0, 1, 2


def _rounds(starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and stops of the sequences, cut and put together to rounds of at most ROUND positions."""
    step = ROUND - LENGTH + 1
    some, total = [], 0
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        for p in range(a, max(a + 1, b - LENGTH + 1), step):
            q = min(p + ROUND, b)
            if some and total + q - p > ROUND:
                yield tuple(np.array(some, np.int64).T)
                some, total = [], 0
            some.append((p, q))
            total += q - p
    if some:
        yield tuple(np.array(some, np.int64).T)


def window_records(tokens: list[np.ndarray], own: list[int]) -> np.ndarray:
    """The compact windows of some documents under all hash functions."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    order = np.argsort(lengths, kind="stable")  # the sparse table is as deep as a round's longest sequence needs
    flat, lengths = np.concatenate([tokens[i] for i in order.tolist()]), lengths[order]
    stops = np.cumsum(lengths)
    starts = stops - lengths
    owner, context = np.array(own, np.uint32)[order], (flat & np.uint64(0xFFFF)).astype(np.uint16)
    rounds = list(_rounds(starts, stops))
    out = []
    for k in range(HASHES):
        values = mixed(flat, k)
        for a, b in rounds:
            at = a[0]
            lo, c, hi = (x + at for x in compact_windows(values[at : b[-1]], a - at, b - at))
            d = np.searchsorted(starts, c, "right") - 1
            rec = np.zeros(len(c), _RECORD)
            rec["value"], rec["own"], rec["hash"] = values[c], owner[d], k
            rec["l"], rec["c"], rec["r"] = lo - starts[d], c - starts[d], hi - starts[d]
            for side, near in (("left", c - CONTEXT), ("right", c + CONTEXT)):
                inside = (near >= starts[d]) & (near < stops[d])
                rec[side] = np.where(inside, context[np.clip(near, 0, len(flat) - 1)], 0)
            out.append(rec)
    rec = np.concatenate(out)
    return rec[np.argsort(rec["own"].astype(np.uint64) << np.uint64(32) | rec["c"].astype(np.uint64), kind="stable")]


def _part_kind(parts: int) -> type:
    """Numbers of parts as narrow as they can be: short ones are sorted by radix."""
    return np.uint16 if parts < 1 << 16 else np.int64


def _dealt(rows: np.ndarray, value: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    pid = ((value >> np.uint64(7)) % np.uint64(parts)).astype(_part_kind(parts))
    order = np.argsort(pid, kind="stable")
    cuts = np.searchsorted(pid[order], np.arange(parts + 1))
    return [(p, rows[order[cuts[p] : cuts[p + 1]]].tobytes()) for p in range(parts) if cuts[p + 1] > cuts[p]]


def _windows(parts: int):
    """Rows of kind DOCUMENT, one for each document; MEETING, windows dealt out by min-hash; MET, pairs dealt out likewise."""
    import xxhash

    names = [c.split()[0] for c in _WINDOWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 34
        seen: set[bytes] = set()
        for b in batches:
            docs = b.num_rows
            n, sums = np.zeros(docs, np.int32), np.zeros((docs, 2), np.int64)
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            tokens, own = [], []
            for i, h in enumerate(shingles_of(b.column(2), WIDTH)):
                n[i] = len(h)
                if len(h) < LENGTH or not known[i]:
                    continue
                digest = xxhash.xxh3_128_digest(h.tobytes())
                sums[i] = np.frombuffer(digest, "<i8")
                if digest not in seen:
                    seen.add(digest)
                    tokens.append(h)
                    own.append(i)
            null = pa.nulls
            made = [pa.array(np.full(docs, DOCUMENT, np.int32)), pa.array(base + np.arange(docs)), b.column(0), b.column(1), pa.array(n), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
            yield pa.record_batch(made + [null(docs, k) for k in _WINDOW_KINDS[7:]], names)
            if tokens:
                rec = window_records(tokens, own)
                rec, first, later = settled(rec)
                met = np.concatenate([pair_rows(first, later, first["own"], later["own"], base), self_rows(later, base + later["own"].astype(np.int64))])
                for kind, dealt in ((MEETING, _dealt(rec, rec["value"], parts)), (MET, _dealt(met, mixed(met["b"].astype(np.uint64), 0), parts))):
                    m = len(dealt)
                    if m:
                        cols = [pa.array(np.full(m, kind, np.int32)), pa.array(np.full(m, base)), *[null(m, k) for k in _WINDOW_KINDS[2:7]]]
                        yield pa.record_batch([*cols, pa.array([p for p, _ in dealt], pa.int32()), pa.array([x for _, x in dealt], pa.binary())], names)
            base += docs

    return run


_PAIRS = "a bigint, b bigint, diagonal int, ca int, cb int, left int, right int, hash int"
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("diagonal", "<i4"), ("ca", "<i4"), ("cb", "<i4"), ("left", "<i4"), ("right", "<i4"), ("hash", "<i4")])
#: Shift between neighbours on almost the same diagonal.
SHIFT = 12


def pair_rows(x: np.ndarray, y: np.ndarray, slot_x: np.ndarray, slot_y: np.ndarray, base: int = 0) -> np.ndarray:
    """Pairs of windows of different documents, the smaller slot first, that leave room for a passage."""
    slot_x, slot_y = base + slot_x.astype(np.int64), base + slot_y.astype(np.int64)
    swap = slot_x > slot_y
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    out = np.zeros(len(x), _PAIR)
    out["a"], out["b"] = np.minimum(slot_x, slot_y), np.maximum(slot_x, slot_y)
    out["ca"], out["cb"], out["diagonal"], out["hash"] = x["c"], y["c"], x["c"] - y["c"], x["hash"]
    out["left"] = np.minimum(x["c"] - x["l"], y["c"] - y["l"])
    out["right"] = np.minimum(x["r"] - x["c"], y["r"] - y["c"])
    return out[(out["a"] != out["b"]) & (out["left"] + out["right"] + 1 >= LENGTH - SHIFT)]


def self_rows(x: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Of a window that shares a context, the first and last run around its place (a document with itself)."""
    out = np.zeros(len(x), _PAIR)
    out["a"] = out["b"] = slot
    out["ca"], out["cb"], out["hash"] = np.maximum(x["l"], x["c"] - LENGTH + 1), np.minimum(x["c"], x["r"] - LENGTH + 1), x["hash"]
    return out


def _keys(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window its group and the group with the context on the left, on the right and on both sides, as one number each."""
    group = rec["value"] ^ rec["hash"].astype(np.uint64)
    left, right = ((rec[c].astype(np.uint64) + np.uint64(1)) * np.uint64(m) for c, m in (("left", _ODD[2]), ("right", _ODD[3])))
    return group, mixed(group ^ left, 1), mixed(group ^ right, 2), mixed(group ^ left ^ right, 3)


def _sorted_runs(key: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of documents and places: order by key; where runs of equal keys begin; for each place the run's first and its first of another document (or the length)."""
    o = np.argsort(key, kind="stable")
    n = len(o)
    new = np.ones(n, bool)
    new[1:] = key[o][1:] != key[o][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    other = slot[o] != slot[o[first]]
    second = np.minimum.reduceat(np.where(other, np.arange(n), n), np.flatnonzero(new))[np.cumsum(new) - 1]
    return o, new, first, second


def settled(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that go on; and of the others, alike on both sides to windows of two documents of this batch, the first and themselves."""
    if not len(rec):
        return rec, rec, rec
    o, _, first, second = _sorted_runs(_keys(rec)[3], rec["own"])
    own = rec["own"][o]
    met = second < len(o)
    goes = (own == own[first]) | (met & (own == own[np.where(met, second, 0)])) | (rec["left"][o] == 0) | (rec["right"][o] == 0)
    return rec[np.sort(o[goes])], rec[o[first[~goes]]], rec[o[~goes]]


class Meeting:
    """Windows that come in order of their documents and places and meet those before them.

    Held are windows that are alike to none of another document, the first and the first of another
    document of those that are alike on both sides, and the last of each group; so what is held grows with the
    distinct windows and not with the groups.
    """

    def __init__(self):
        self.rec, self.slot, self.shared = np.zeros(0, _RECORD), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, rec: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Pairs with the windows held and among the new ones, which become held."""
        old = np.concatenate([np.ones(len(self.rec), bool), np.zeros(len(rec), bool)])
        shared = np.concatenate([self.shared, np.zeros(len(rec), bool)])
        rec, slot = np.concatenate([self.rec, rec]), np.concatenate([self.slot, slot])
        group = rec["value"] ^ rec["hash"].astype(np.uint64)
        alone = np.ones(len(rec), bool)
        order = np.argsort(group)
        again = group[order][1:] == group[order][:-1]
        alone[order[1:][again]] = alone[order[:-1][again]] = False
        many = np.flatnonzero(~alone)
        if not len(many):
            self.rec, self.slot, self.shared = rec, slot, shared
            return np.zeros(0, _PAIR)
        r, s, was = rec[many], slot[many], shared[many]
        group, left, right, both = _keys(r)
        now, pairs, keep = was.copy(), [], np.zeros(len(many), bool)
        for key, chain in ((group, True), (left, False), (right, False)):
            o, new, first, second = _sorted_runs(key, s)
            partner = np.where(s[o] != s[o[first]], first, second)
            met = partner < len(o)
            pairs.append(np.stack([o[partner[met]], o[met]]))
            if chain:
                pairs.append(np.stack([o[:-1], o[1:]])[:, ~new[1:]])
                keep[o[np.append(new[1:], True)]] = True
            else:
                now[o[second < len(o)]] = True
        o, new, _, second = _sorted_runs(both, s)
        keep[o[new]] = True
        keep[o[second[second < len(o)]]] = True
        keep |= ~now
        pair = np.concatenate(pairs, axis=1)
        fresh = ~old[many]
        pair = pair[:, (fresh[pair[0]] | fresh[pair[1]]) & (s[pair[0]] != s[pair[1]])]
        low, high = np.minimum(pair[0], pair[1]).astype(np.int64), np.maximum(pair[0], pair[1])
        x, y = np.divmod(np.unique(low * len(many) + high), len(many))
        told = now & ~was
        out = np.concatenate([pair_rows(r[x], r[y], s[x], s[y]), self_rows(r[told], s[told])])
        shared[many] = now
        alone[many[keep]] = True
        self.rec, self.slot, self.shared = rec[alone], slot[alone], shared[alone]
        return out


def _as_pairs(rows: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(rows[c])) for c in _PAIR.names], list(_PAIR.names))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows sorted by range of min-hashes and document: the pairs of windows that meet."""
    pid, meeting, waiting, size = None, Meeting(), [], 0

    def meet() -> Iterator[pa.RecordBatch]:
        if waiting:
            rec, slot = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            found = meeting.add(rec, slot)
            for k in range(0, len(found), 20_000):
                yield _as_pairs(found[k : k + 20_000])

    for b in batches:
        for kind, base, p, payload in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if p != pid:
                yield from meet()
                pid, meeting, size = p, Meeting(), 0
            if kind == MET:
                yield _as_pairs(np.frombuffer(payload, _PAIR))
                continue
            rec = np.frombuffer(payload, _RECORD)
            waiting.append((rec, base + rec["own"].astype(np.int64)))
            size += len(rec)
            if size >= max(PENDING, len(meeting.rec)):
                yield from meet()
                size = 0
    yield from meet()


_ANCHORS = "a bigint, b bigint, ca int, cb int"


def _covered(slot: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of runs, first and last, that have a window of every function (a run lies in one of each)."""
    at = np.concatenate([low, high + 1])
    step = np.repeat([1, -1], len(low))
    slot = np.concatenate([slot, slot])
    o = np.lexsort((at, slot))
    at, slot, depth = at[o], slot[o], np.cumsum(step[o])
    some = np.flatnonzero((depth[:-1] == HASHES) & (at[1:] > at[:-1]) & (slot[1:] == slot[:-1]))
    slot, low, high = slot[some], at[some], at[some + 1] - 1
    new = np.ones(len(some), bool)
    new[1:] = (slot[1:] != slot[:-1]) | (low[1:] != high[:-1] + 1)
    return slot[new], low[new], high[np.append(new[1:], True)] if len(some) else high


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pairs sorted by documents, diagonal and position: anchors where enough functions agree, and runs to hash (``a`` twice)."""

    def settle(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        a, b, diagonal, ca, cb, left, right, hash_ = cols
        if not len(a):
            return None
        same = a == b
        runs, low, high = _covered(a[same], ca[same], cb[same])
        a, b, diagonal, ca, cb, left, right, hash_ = (c[~same] for c in cols)
        if not len(a):
            return pa.record_batch([pa.array(x) for x in (runs, runs, low, high)], names) if len(runs) else None
        new = np.ones(len(a), bool)
        # the next interval overlaps the one before it if it begins before that one ends
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (np.abs(np.diff(diagonal)) > SHIFT) | (ca[1:] - left[1:] > ca[:-1] + right[:-1]) | (ca[1:] + right[1:] < ca[:-1] - left[:-1])
        at = np.flatnonzero(new)
        agree = np.bitwise_or.reduceat(np.left_shift(1, hash_), at)
        votes = sum((agree >> k) & 1 for k in range(HASHES))
        run = np.cumsum(new) - 1
        keep = (votes >= AGREE)[run]
        # one anchor for each half passage of a run
        bin_ = ca // (LENGTH // 2)
        first = np.ones(len(a), bool)
        first[1:] = (run[1:] != run[:-1]) | (bin_[1:] != bin_[:-1])
        keep &= first
        out = [pa.array(np.concatenate([x[keep], y])) for x, y in zip((a, b, ca, cb), (runs, runs, low, high), strict=True)]
        return pa.record_batch(out, names) if len(out[0]) else None

    names = ["a", "b", "ca", "cb"]
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        # the last two documents' pairs may go on in the next batch
        cut = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])))
        out = settle([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
        if out is not None:
            yield out
    if held is not None:
        out = settle(held)
        if out is not None:
            yield out


_STRETCH = np.dtype([("low", "<u8"), ("slot", "<i8"), ("key", "<i8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])


def runs_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and smallest ``mixed`` value of each run of LENGTH shingles."""
    n = len(h) - LENGTH + 1
    x, low = mixed(h, 4), mixed(h, 0)
    total, done, size, factor = np.zeros(n, np.uint64), 0, 1, _ODD[5]
    while True:
        if LENGTH & size:
            total = total * np.uint64(factor) + x[done : done + n]
            done += size
        if 2 * size > LENGTH:
            return total, np.minimum(low[:n], low[LENGTH - size :])
        x = x[:-size] * np.uint64(factor) + x[size:]
        low = np.minimum(low[:-size], low[size:])
        size, factor = 2 * size, factor * factor % (1 << 64)


def _stretches(made: list[tuple[np.ndarray, np.ndarray]], parts: int) -> list[tuple[int, bytes, bytes]]:
    """Stretches of runs with one smallest value, and their hashes, dealt out by that value.

    Neighbours mostly share that value, so they stay together, and it and six bytes more tell runs apart.
    """
    rec, total = (np.concatenate(x) for x in zip(*made, strict=True))
    pid = ((rec["low"] >> np.uint64(7)) % np.uint64(parts)).astype(_part_kind(parts))
    each = np.repeat(pid, rec["n"])
    order, inner = np.argsort(pid, kind="stable"), np.argsort(each, kind="stable")
    cuts, ends = (np.searchsorted(x, np.arange(parts + 1)) for x in (pid[order], each[inner]))
    small = total.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return [(p, rec[order[cuts[p] : cuts[p + 1]]].tobytes(), small[inner[ends[p] : ends[p + 1]]].tobytes()) for p in range(parts) if cuts[p + 1] > cuts[p]]


def stretches_of(asked: list[tuple[np.ndarray, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Stretches and hashes of the runs of some pieces of LENGTH shingles or more: shingles, place of the first, slot, key, document."""
    lengths = np.array([len(h) for h, *_ in asked], np.int64)
    total, low = runs_of(np.concatenate([h for h, *_ in asked]))
    ends = np.cumsum(lengths)
    begins, runs = ends - lengths, lengths - LENGTH + 1
    new = np.ones(len(low), bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[begins] = True
    inside = np.zeros(len(low) + 1, np.int8)
    inside[begins] += 1
    inside[begins + runs] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    low, total, at = low[inside], total[inside], np.flatnonzero(new[inside])
    before = np.cumsum(runs) - runs
    of = np.searchsorted(before, at, "right") - 1
    rec = np.zeros(len(at), _STRETCH)
    first, slot, key, doc = (np.array(c, np.int64)[of] for c in list(zip(*asked, strict=True))[1:])
    rec["low"], rec["slot"], rec["key"], rec["doc"], rec["start"], rec["n"] = low[at], slot, key, doc, first + at - before[of], np.diff(np.append(at, len(low)))
    return rec, total


class Repeats:
    """Runs that come document by document and are looked up among those before them.

    Held is the first occurrence of each run, in sorted blocks whose sizes double.
    """

    FIRST = np.dtype([("run", "<u8"), ("slot", "<i8"), ("key", "<i8"), ("doc", "<i8"), ("start", "<i4")])

    def __init__(self):
        self.blocks: list[np.ndarray] = []

    def _hold(self, rec: np.ndarray) -> None:
        while self.blocks and len(self.blocks[-1]) <= 2 * len(rec):
            both = np.concatenate([self.blocks.pop(), rec])
            rec = both[np.argsort(both["run"], kind="stable")]
        self.blocks.append(rec)

    def add(self, stretch: np.ndarray, small: np.ndarray) -> np.ndarray:
        """Stretches of runs that repeat the first occurrence of each in another document, as rows of the document with the larger slot."""
        own = np.repeat(np.arange(len(stretch)), stretch["n"])
        run = np.zeros((len(own), 8), np.uint8)
        run[:, 2:] = small
        run = run.view("<u8")[:, 0] ^ stretch["low"][own]
        start = stretch["start"][own] + np.arange(len(own), dtype=np.int32) - (np.cumsum(stretch["n"]) - stretch["n"])[own].astype(np.int32)
        order = np.argsort(run, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = run[order][1:] != run[order][:-1]
        firsts = np.zeros(int(new.sum()), self.FIRST)
        at = order[new]
        firsts["run"], firsts["start"] = run[at], start[at]
        for c in ("slot", "key", "doc"):
            firsts[c] = stretch[c][own[at]]
        known = np.zeros(len(firsts), bool)
        for block in self.blocks:
            at = np.minimum(np.searchsorted(block["run"], firsts["run"]), len(block) - 1)
            hit = block["run"][at] == firsts["run"]
            firsts[hit], known = block[at[hit]], known | hit
        if (~known).any():
            self._hold(firsts[~known])
        of = np.zeros(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        # back in order of stretches and places, in which runs of one head follow one another
        later = np.flatnonzero(stretch["doc"][own] != firsts["doc"][of])
        rec = np.zeros(len(later), self.FIRST)
        rec["start"] = start[later]
        for c in ("slot", "key", "doc"):
            rec[c] = stretch[c][own[later]]
        head = firsts[of[later]]
        begins = np.ones(len(rec), bool)
        begins[1:] = (rec["key"][1:] != rec["key"][:-1]) | (head["key"][1:] != head["key"][:-1]) | (rec["start"][1:] != rec["start"][:-1] + 1) | (head["start"][1:] != head["start"][:-1] + 1)
        at = np.flatnonzero(begins)
        out = np.zeros(len(at), _REPEAT)
        swap = rec["slot"][at] < head["slot"][at]
        low, high = np.where(swap, rec[at], head[at]), np.where(swap, head[at], rec[at])
        out["key"], out["a"], out["a_id"], out["ca"], out["cb"] = high["key"], low["key"], low["doc"], low["start"], high["start"]
        out["n"] = np.diff(np.append(at, len(rec)))
        return out


_REPEATS = "key bigint, a bigint, a_id bigint, ca int, cb int, n int"
_REPEAT = np.dtype([("key", "<i8"), ("a", "<i8"), ("a_id", "<i8"), ("ca", "<i4"), ("cb", "<i4"), ("n", "<i4")])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by range of values: stretches of ``n`` runs from ``cb`` on that repeat those from ``ca`` on of another document."""
    pid, held, waiting, size = None, Repeats(), [], 0

    def look() -> Iterator[pa.RecordBatch]:
        if waiting:
            out = held.add(np.frombuffer(b"".join(x for x, _ in waiting), _STRETCH), np.frombuffer(b"".join(x for _, x in waiting), np.uint8).reshape(-1, 6))
            waiting.clear()
            if len(out):
                yield pa.record_batch([pa.array(np.ascontiguousarray(out[c])) for c in _REPEAT.names], list(_REPEAT.names))

    for b in batches:
        for p, stretches, hashes in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if p != pid or size >= PENDING:
                yield from look()
                size = 0
            if p != pid:
                pid, held = p, Repeats()
            waiting.append((stretches, hashes))
            size += len(hashes) // 6
    yield from look()


#: Rows of runs (``pid``, ``base``, ``stretches``, ``hashes``) and of neighbourhoods, one for each two documents.
_AROUND = "pid int, base bigint, stretches binary, hashes binary, a bigint, a_id bigint, b bigint, ca binary, cb binary, firsts binary, counts binary, words string"
_AROUND_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.string()]
_MATCHES = "doc_id bigint, match_id bigint, start_word bigint, end_word bigint, match_start bigint, similarity double"


class _Document:
    """The document whose rows come: its shingles, the bytes of its words, id."""

    __slots__ = ("key", "doc", "h", "data", "starts", "ends")


def _documents(key: pa.Array, doc: pa.Array, text: pa.Array, spans: bool) -> dict[int, _Document]:
    """By row, documents of a batch that other rows follow (or may, in the next batch)."""
    valid = text.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(valid & np.append(~valid[1:], True))
    if not len(rows):
        return {}
    some = text.take(pa.array(rows))
    out: dict[int, _Document] = {}
    data, at = text_bytes(some)
    starts, ends, counts = word_spans(data, at)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    for i, (row, h) in enumerate(zip(rows.tolist(), shingles_of(some, WIDTH), strict=True)):
        d = out[row] = _Document()
        d.key, d.doc, d.h = key[row].as_py(), doc[row].as_py(), h
        if spans:
            d.data = data[at[i] : at[i + 1]].tobytes()
            d.starts, d.ends = starts[cuts[i] : cuts[i + 1]] - at[i], ends[cuts[i] : cuts[i + 1]] - at[i]
    return out


def _neighbourhood(doc: _Document, places: list[int]) -> tuple[bytes, bytes, str]:
    """First words and numbers of words of the merged stretches around some places, and their words."""
    n = len(doc.starts)
    firsts, lasts = [], []
    for c in places:
        first, last = max(0, c - LENGTH + 1), min(n, c + LENGTH + WIDTH - 1)
        if lasts and first <= lasts[-1]:
            lasts[-1] = max(lasts[-1], last)
        else:
            firsts.append(first)
            lasts.append(last)
    words = b"\n".join(doc.data[doc.starts[a] : doc.ends[b - 1]] for a, b in zip(firsts, lasts, strict=True)).decode()
    return np.array(firsts, "<i4").tobytes(), (np.array(lasts, "<i4") - np.array(firsts, "<i4")).tobytes(), words


def _around(parts: int):
    """From texts, runs to hash and anchors sorted by document, each text first: hashes of runs, and words around the anchors."""
    names = [c.split()[0] for c in _AROUND.split(", ")]

    def table(columns: dict[int, list], n: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns[k], kind) if k in columns else pa.nulls(n, kind) for k, kind in enumerate(_AROUND_KINDS)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: _Document | None = None
        pair: tuple | None = None  # document, the other, places in both
        for batch in batches:
            key, ids, text, slot, b, ca, cb = batch.columns
            texts = _documents(key, ids, text, True)
            made, asked, size, rows = [], [], 0, []

            def close(pair=None, rows=rows):
                if pair:
                    d, other, x, y = pair
                    rows.append((d.key, d.doc, other, np.array(x, "<i4").tobytes(), np.array(y, "<i4").tobytes(), *_neighbourhood(d, x)))

            for i, (k, own, other, x, y) in enumerate(zip(*[c.to_pylist() for c in (key, slot, b, ca, cb)], strict=True)):
                if x is None:
                    close(pair)
                    doc, pair = texts.get(i), None
                elif doc is None or doc.key != k:
                    continue
                elif other is None:
                    part = doc.h[x : y + LENGTH]
                    if len(part) >= LENGTH:
                        asked.append((part, x, own, doc.key, doc.doc))
                        size += len(part)
                        if size >= BLOCK:
                            made.append(stretches_of(asked))
                            asked, size = [], 0
                elif pair and pair[1] == other:
                    pair[2].append(x)
                    pair[3].append(y)
                else:
                    close(pair)
                    pair = (doc, other, [x], [y])
            if asked:
                made.append(stretches_of(asked))
            if made:
                dealt = _stretches(made, parts)
                n = len(dealt)
                yield table({0: [x[0] for x in dealt], 1: [int(made[0][0]["slot"][0])] * n, 2: [x[1] for x in dealt], 3: [x[2] for x in dealt]}, n)
            if rows:
                yield table({4 + k: c for k, c in enumerate(zip(*rows, strict=True))}, len(rows))
        rows = []
        if pair:
            close(pair, rows)
            yield table({4 + k: c for k, c in enumerate(zip(*rows, strict=True))}, 1)

    return run


def verify_all(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the first and last start (-1: none) in ``y`` and the best similarity of the passages that match.

    Rows of ``x`` and ``y`` are the shingles around an anchor (LENGTH - 1 before it, as many after it, 0
    where there are none). Passages without repeated shingles are compared place by place, which counts
    no more than sets share; where that finds none, an insertion may have shifted what follows, and
    in rows that share enough shingles at all every passage of ``x`` is compared with every passage of ``y`` as sets.
    """
    return matching_starts(x, y, percent)[:3]


def matching_starts(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``verify_all``, and the start in ``x`` of the passage that the first one in ``y`` matches best."""
    starts = x.shape[1] - LENGTH + 1
    plain = (_repeats(x) == 0) & (_repeats(y) == 0)  # else places don't count sets
    run = lambda flags: np.cumsum(np.pad(flags, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
    spans = lambda flags: (c := run(flags))[:, LENGTH:] - c[:, :-LENGTH]
    shared = spans((x == y) & (x != 0))
    x_full, y_full = spans(x != 0) == LENGTH, spans(y != 0) == LENGTH
    good = plain[:, None] & x_full & y_full & (100 * shared >= percent * (2 * LENGTH - shared))
    hit = good.any(axis=1)
    first = np.where(hit, good.argmax(axis=1), -1)
    last = np.where(hit, starts - 1 - good[:, ::-1].argmax(axis=1), -1)
    best = np.where(good, shared / (2.0 * LENGTH - shared), 0.0).max(axis=1)
    there = first.copy()
    rest = np.flatnonzero(~hit & x_full.any(axis=1) & y_full.any(axis=1))
    for a in range(0, len(rest), 256):
        some = rest[a : a + 256]
        equal = x[some][:, :, None] == y[some][:, None, :]
        equal &= (x[some] != 0)[:, :, None]
        # two passages share no more than the places of either that the other row has, and
        # a passage has at least LENGTH distinct shingles less the repeats of its row
        most = [np.where(full[some], spans(equal.any(axis=axis)), 0).max(axis=1) for full, axis in ((x_full, 2), (y_full, 1))]
        distinct = 2 * LENGTH - _repeats(x[some]) - _repeats(y[some])
        ok = (100 + percent) * np.minimum(*most) >= percent * distinct
        some, equal = some[ok], equal[ok]
        whole = plain[some]
        _by_sums(x, y, x_full, y_full, some[whole], percent, first, last, best, there)
        _by_firsts(x, y, equal[~whole], x_full, y_full, some[~whole], percent, first, last, best, there)
    return first, last, best, there


def _begun(rows: np.ndarray) -> np.ndarray:
    """For each row, place and start 1 where the place is in the passage and the first there with its value, else 0."""
    n, width = rows.shape
    order = np.argsort(rows, axis=1, kind="stable")
    ordered = np.take_along_axis(rows, order, axis=1)
    before = np.full((n, width), -1)
    before[:, 1:] = np.where(ordered[:, 1:] == ordered[:, :-1], order[:, :-1], -1)
    after = np.empty_like(before)
    np.put_along_axis(after, order, before, axis=1)
    start, place = np.arange(width - LENGTH + 1), np.arange(width)[:, None]
    return ((start <= place) & (start > place - LENGTH) & (start > after[:, :, None])).astype(np.float32)


def _by_firsts(x, y, equal, x_full, y_full, some, percent, first, last, best, there) -> None:
    """All passages of some rows against one another as sets: they share a value where the first places that have it in each are ``equal``."""
    for a in range(0, len(some), 64):
        rows = some[a : a + 64]
        p, q = _begun(x[rows]), _begun(y[rows])
        common = p.transpose(0, 2, 1) @ equal[a : a + 64].astype(np.float32) @ q
        union = p.sum(axis=1)[:, :, None] + q.sum(axis=1)[:, None, :] - common
        match = (100 * common >= percent * union) & x_full[rows][:, :, None] & y_full[rows][:, None, :]
        for i in np.flatnonzero(match.any(axis=(1, 2))).tolist():
            k = rows[i]
            similar = np.where(match[i], common[i].astype(np.float64) / union[i], 0.0)
            found = np.flatnonzero(match[i].any(axis=0))
            first[k], last[k], best[k] = found[0], found[-1], similar.max()
            there[k] = similar[:, found[0]].argmax()


def _by_sums(x, y, x_full, y_full, some, percent, first, last, best, there) -> None:
    """All passages of some rows without repeated shingles against one another: what they share is a sum over a square of equal places."""
    if not len(some):
        return
    n = x.shape[1]
    sums = np.zeros((len(some), n + 1, n + 1), np.int16)
    np.logical_and(x[some][:, :, None] == y[some][:, None, :], (x[some] != 0)[:, :, None], out=sums[:, 1:, 1:], casting="unsafe")
    np.cumsum(sums, axis=1, out=sums)
    np.cumsum(sums, axis=2, out=sums)
    common = sums[:, LENGTH:, LENGTH:] - sums[:, :-LENGTH, LENGTH:] - sums[:, LENGTH:, :-LENGTH] + sums[:, :-LENGTH, :-LENGTH]
    common[~x_full[some]] = 0
    common.transpose(0, 2, 1)[~y_full[some]] = 0
    most = common.max(axis=1)  # for each start in y
    match = (100 + percent) * most.astype(np.int64) >= percent * 2 * LENGTH
    for i in np.flatnonzero(match.any(axis=1)).tolist():
        k, found = some[i], np.flatnonzero(match[i])
        m = int(most[i].max())
        first[k], last[k], best[k] = found[0], found[-1], m / (2.0 * LENGTH - m)
        there[k] = common[i, :, found[0]].argmax()


def _repeats(rows: np.ndarray) -> np.ndarray:
    rows = np.sort(rows, axis=1)
    return ((rows[:, 1:] == rows[:, :-1]) & (rows[:, 1:] != 0)).sum(axis=1)


def _place(row: np.ndarray, h: np.ndarray, first: int, c: int) -> None:
    """Into ``row`` the stretch from LENGTH - 1 before ``c`` to as many after it; ``h`` begins at position ``first``."""
    low = c - LENGTH + 1
    lo, hi = max(first, low), min(first + len(h), c + LENGTH)
    if hi > lo:
        row[lo - low : hi - low] = h[lo - first : hi - first]


def _joined(spans: list[tuple]) -> list[tuple]:
    """Spans ``who, start, stop, match_start, similarity`` of one pair, overlapping ones merged."""
    out: list[list] = []
    for span in sorted(spans):
        if out and span[1] <= out[-1][2]:
            out[-1][2], out[-1][4] = max(out[-1][2], span[2]), max(out[-1][4], span[4])
        else:
            out.append(list(span))
    return [tuple(x) for x in out]


def distinct_counts(values: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """For each start the number of distinct values of the passage that begins there; ``piece`` numbers the sequences in order."""
    n = len(values)
    key = values ^ mixed(piece.astype(np.uint64), 5)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    # the few that are equal to others, in order of their places
    some = np.sort(order[np.append(same, False) | np.append(False, same)])
    some = some[np.lexsort((values[some], piece[some]))]
    again = np.flatnonzero((values[some][1:] == values[some][:-1]) & (piece[some][1:] == piece[some][:-1]))
    place, before = some[again + 1], some[again]
    near = place - before < LENGTH  # both are in passages that begin from place - LENGTH + 1 to before
    change = np.bincount(np.maximum(place[near] - LENGTH + 1, 0), minlength=n + 1) - np.bincount(before[near] + 1, minlength=n + 1)
    return LENGTH - np.cumsum(change)[:n]


def aligned(x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each start the least similarity that the passages of ``x`` and ``y`` there can have by their equal places; 0 if under ``PERCENT``.

    ``x`` and ``y`` are sequences of ``lengths`` shingles one after the other. Of two passages with ``d`` unlike places, one with
    ``m`` distinct shingles, at least ``m - d`` are shared and the union holds at most ``m + d``.
    """
    n = len(x)
    piece = np.repeat(np.arange(len(lengths)), lengths)
    unlike = np.concatenate([[0], np.cumsum(x != y)])
    inside = np.arange(n) + LENGTH <= np.repeat(np.cumsum(lengths), lengths)
    d = np.zeros(n, np.int64)
    d[: max(0, n - LENGTH + 1)] = unlike[LENGTH:] - unlike[: max(0, n - LENGTH + 1)]
    out = np.zeros(n)
    # no passage has more than LENGTH distinct shingles, so most sequences need no counts
    few = inside & (100 * (LENGTH - d) >= PERCENT * (LENGTH + d))
    asked = np.zeros(len(lengths), bool)
    asked[piece[few]] = True
    at = np.flatnonzero(asked[piece])
    if len(at):
        piece, d, inside = piece[at], d[at], inside[at]
        m = np.maximum(distinct_counts(x[at], piece), distinct_counts(y[at], piece))
        good = inside & (100 * (m - d) >= PERCENT * (m + d))
        out[at] = np.where(good, (m - d) / np.maximum(m + d, 1), 0.0)
    return out


#: Positions that are compared at once.
BLOCK = 1 << 17


class _Pair:
    """Anchors of two documents: their names, places in both, pieces of the one and shingles of the other."""

    __slots__ = ("who", "x", "y", "begins", "pieces", "h")

    def __init__(self, who, x, y, begins, pieces, h):
        self.who, self.x, self.y, self.begins, self.pieces, self.h = who, x, y, begins, pieces, h

    def piece(self, place: int) -> tuple[np.ndarray, int]:
        k = int(self.begins.searchsorted(place, "right")) - 1 if len(self.pieces) > 1 else 0
        return self.pieces[k], int(self.begins[k])

    def stretches(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Diagonal, first and last place (exclusive) in ``x`` and the anchors of stretches in which neighbourhoods join."""
        if len(self.x) == 1:
            c, off = int(self.x[0]), int(self.x[0] - self.y[0])
            part, begin = self.piece(c)
            yield off, max(begin, off, c - LENGTH + 1), min(begin + len(part), off + len(self.h), c + LENGTH), self.x
            return
        diagonal = self.x - self.y
        order = np.lexsort((self.x, diagonal))
        d, x = diagonal[order], self.x[order]
        cuts = np.flatnonzero((d[1:] != d[:-1]) | (x[1:] - x[:-1] > LENGTH)) + 1
        for some in np.split(np.arange(len(x)), cuts):
            part, begin = self.piece(int(x[some[0]]))
            off = int(d[some[0]])
            low = max(begin, off, int(x[some[0]]) - LENGTH + 1)
            high = min(begin + len(part), off + len(self.h), int(x[some[-1]]) + LENGTH)
            yield off, low, high, x[some]


def _decide(pairs: list[_Pair]) -> Iterator[tuple]:
    """Spans ``who, start, stop, match_start, similarity`` of the passages that match around the pairs' anchors."""
    runs = [(q, *stretch) for q in pairs for stretch in q.stretches()]
    xs, ys = [], []
    for q, off, low, high, _ in runs:
        part, begin = q.piece(low)
        xs.append(part[low - begin : max(low, high) - begin])
        ys.append(q.h[low - off : max(low, high) - off])
    lengths = np.array([len(v) for v in xs], np.int64)
    similar = aligned(np.concatenate(xs), np.concatenate(ys), lengths)
    good = similar > 0
    found = np.concatenate([[0], np.cumsum(good)])
    edges = np.cumsum(lengths) - lengths
    # whole runs of good starts are one span each
    new = good.copy()
    new[1:] &= ~good[:-1]
    new[edges[lengths > 0]] = good[edges[lengths > 0]]
    begins = np.flatnonzero(new)
    if len(begins):
        number = np.cumsum(new)[good] - 1
        last = np.zeros(len(begins), np.int64)
        np.maximum.at(last, number, np.flatnonzero(good))
        best = np.zeros(len(begins))
        np.maximum.at(best, number, similar[good])
        of = np.searchsorted(edges, begins, "right") - 1
        for i, s, e, v in zip(of.tolist(), begins.tolist(), last.tolist(), best.tolist(), strict=True):
            q, off, low, _, _ = runs[i]
            at = low + s - int(edges[i])
            yield (q.who, at - off, at + e - s + LENGTH + WIDTH - 1 - off, at, v)
    # anchors without a match at equal places: something may be inserted or left out
    places = np.concatenate([p for *_, p in runs])
    of = np.repeat(np.arange(len(runs)), [len(p) for *_, p in runs])
    low = np.array([r[2] for r in runs], np.int64)[of]
    a, b = (np.clip(v - low, 0, lengths[of]) + edges[of] for v in (places - LENGTH + 1, places + 1))
    lost = np.flatnonzero(found[a] == found[b])
    rest = [(runs[i][0], c, c - runs[i][1]) for i, c in zip(of[lost].tolist(), places[lost].tolist(), strict=True)]
    for k in range(0, len(rest), 1024):
        some = rest[k : k + 1024]
        x, y = (np.zeros((len(some), 2 * LENGTH - 1), np.uint64) for _ in range(2))
        for i, (q, ca, cb) in enumerate(some):
            _place(x[i], *q.piece(ca), ca)
            _place(y[i], q.h, 0, cb)
        for (q, ca, cb), lo, hi, v, there in zip(some, *(c.tolist() for c in matching_starts(x, y)), strict=True):
            if lo >= 0:
                yield (q.who, cb - LENGTH + 1 + lo, cb + hi + WIDTH, ca - LENGTH + 1 + there, v)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts, neighbourhoods and exact repeats sorted by document and other document: passages, overlapping ones merged."""
    doc: _Document | None = None
    spans: dict[tuple, list[tuple]] = {}
    names = [c.split()[0] for c in _MATCHES.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.float64()]

    def told(but: tuple | None = None) -> Iterator[pa.RecordBatch]:
        """What is known of all pairs of documents but the one that may go on."""
        rows = [row for who in [w for w in spans if w != but] for row in _joined(spans.pop(who))]
        if rows:
            columns = zip(*[(r[0][1], r[0][2], *r[1:]) for r in rows], strict=True)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        key, ids, text, a, a_id, at, to, n, ca, cb, firsts, counts, words = batch.columns
        texts = _documents(key, ids, text, False)
        some = np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False))
        read = lambda c: [np.frombuffer(v.as_py(), "<i4").astype(np.int64) for v in c.take(pa.array(some))]
        places, others, begins, lengths = (read(c) for c in (ca, cb, firsts, counts))
        h, _ = hash_words(words.take(pa.array(some)))
        h, sizes = hash_runs(h, np.concatenate([*lengths, np.zeros(0, np.int64)]).astype(np.int64), WIDTH)
        pieces = iter(np.split(h, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        number = {row: i for i, row in enumerate(some.tolist())}
        asked: list[_Pair] = []
        size, who = 0, None
        for i, (k, other, other_id, x, y, m) in enumerate(zip(*[c.to_pylist() for c in (key, a, a_id, at, to, n)], strict=True)):
            if other is None:
                doc = texts.get(i)
                continue
            j = number.get(i)
            own = [next(pieces) for _ in begins[j]] if j is not None else []
            if doc is None or doc.key != k:
                continue
            who = (k, doc.doc, other_id, other)
            if j is None:
                spans.setdefault(who, []).append((who, y, y + m - 1 + LENGTH + WIDTH - 1, x, 1.0))
                continue
            asked.append(_Pair(who, places[j], others[j], begins[j], own, doc.h))
            size += sum(map(len, own))
            if size >= BLOCK:
                for span in _decide(asked):
                    spans.setdefault(span[0], []).append(span)
                asked, size = [], 0
        if asked:
            for span in _decide(asked):
                spans.setdefault(span[0], []).append(span)
        yield from told(who)
    yield from told()


def _salted(rows: DataFrame, by: str, texts: DataFrame, work: WorkTables, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``salt``, a hash of ``by``, and texts copied to each salt of their key; few keys have more than one.

    How many salts a crowded key has is a table of at most a ``SALT``-th of the rows; it is joined as its size allows.
    """
    crowded = work.keep(rows.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > SALT).select("key", F.ceil(F.col("m") / SALT).cast("int").alias("salts")), name)
    salt = F.when(F.col("salts").isNotNull() & F.col(by).isNotNull(), F.pmod(F.xxhash64(by), F.col("salts")).cast("int")).otherwise(F.lit(0))
    dealt = rows.join(crowded, "key", "left").withColumn("salt", salt).drop("salts")
    copied = texts.join(crowded, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")
    return dealt, copied


def _together(texts: DataFrame, rows: DataFrame, columns: dict[str, str], order: list, parts: int) -> DataFrame:
    """Texts and the rows of their documents, sorted so that each text comes first."""
    null = lambda kind, c: F.lit(None).cast(kind).alias(c)
    one = texts.select("key", "salt", "id", "text", *[null(kind, c) for c, kind in columns.items()])
    two = rows.select("key", "salt", null("bigint", "id"), null("string", "text"), *columns)
    return one.unionByName(two).repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", F.col("text").isNull(), *order).drop("salt")


#: Bits of the map of shingles that several components have: 8 MB whatever the input; a full one lets more through and loses none.
MAP_BITS = 26
_DEALT = "pid int, hashes binary, counts binary, groups binary"
_BITS = "bucket int, bit int"
_SEEDS = "hash bigint, grp bigint, key bigint, place int, around binary"
_SEED_NAMES = [c.split()[0] for c in _SEEDS.split(", ")]


def _whole_shingles(b: pa.RecordBatch, seen: set[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Row and shingles of the documents of a batch (``key, grp, text``) that have passages, of equal ones of a component the first."""
    import xxhash

    for i, (h, group) in enumerate(zip(shingles_of(b.column(2), WIDTH), b.column(1).to_pylist(), strict=True)):
        if len(h) >= LENGTH:
            digest = xxhash.xxh3_128_digest(h.tobytes() + group.to_bytes(8, "little", signed=True))
            if digest not in seen:
                seen.add(digest)
                yield i, h


def _all_shingles(parts: int):
    """All shingles dealt out by value, each part with how many of them each document has and the documents' components."""
    names = [c.split()[0] for c in _DEALT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            some = list(_whole_shingles(b, seen))
            if not some:
                continue
            groups = b.column(1).to_numpy()[[i for i, _ in some]].astype("<i8")
            flat = np.concatenate([h for _, h in some])
            own = np.repeat(np.arange(len(some)), [len(h) for _, h in some])
            pid = ((flat >> np.uint64(7)) % np.uint64(parts)).astype(_part_kind(parts))
            order = np.argsort(pid, kind="stable")
            cuts = np.searchsorted(pid[order], np.arange(parts + 1))
            small = (flat >> np.uint64(32)).astype("<u4")
            rows = []
            for k in range(parts):
                o = order[cuts[k] : cuts[k + 1]]
                if len(o):
                    counts = np.bincount(own[o], minlength=len(some))
                    has = counts > 0
                    rows.append((k, small[o].tobytes(), counts[has].astype("<u4").tobytes(), groups[has].tobytes()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names)

    return run


def _in_several(t: pa.Table) -> pa.Table:
    """Of one range of shingles: bits of those that documents of several components have."""
    read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])
    value, group = read("hashes", "<u4"), np.repeat(read("groups", "<i8"), read("counts", "<u4"))
    order = np.argsort(value)
    value, group = value[order], group[order]
    begins = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    several = np.minimum.reduceat(group, begins) != np.maximum.reduceat(group, begins)
    at = np.unique(value[begins[several]] & np.uint32((1 << MAP_BITS) - 1))
    return pa.table([pa.array((at >> 15).astype(np.int32)), pa.array((at & 32767).astype(np.int32))], ["bucket", "bit"])


def open_passages(h: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Places of seeds: two passages that match have one's shingle in common, at a seed of each.

    Of a passage with ``m`` distinct shingles a matching one has ``PERCENT`` % at least, all of them ``shared``. So the passages with enough
    shared ones are left, and of each as many of its smallest shared values as may be amiss, and one more.
    """
    n = len(h) - LENGTH + 1
    held = np.concatenate([np.zeros(1, np.int64), np.cumsum(shared)])
    held = held[LENGTH:] - held[:-LENGTH]
    top = int(held.max())
    if not top:
        return np.zeros(0, np.int64)
    if 100 * top < PERCENT * LENGTH:
        # a passage has at least LENGTH distinct shingles less the repeats of its text
        ordered = np.sort(h)
        if 100 * top < PERCENT * (LENGTH - int((ordered[1:] == ordered[:-1]).sum())):
            return np.zeros(0, np.int64)
    piece = np.zeros(len(h), np.int64)
    m = distinct_counts(h, piece)[:n]
    # what no other component has, each once
    alone = distinct_counts(np.where(shared, np.uint64(0), h), piece)[:n] - (held > 0)
    most = m + (-PERCENT * m) // 100 + 1 - alone
    good = np.flatnonzero((held > 0) & (most > 0))
    none = np.uint64((1 << 64) - 1)
    views = np.lib.stride_tricks.sliding_window_view(np.where(shared, mixed(h, 1), none), LENGTH)
    seed = np.zeros(len(h), bool)
    for k in range(0, len(good), 4096):
        some = good[k : k + 4096]
        rows = views[some]
        order = np.argsort(rows, axis=1)
        rows = np.take_along_axis(rows, order, axis=1)
        rank = np.ones(rows.shape, np.int64)
        rank[:, 1:] += np.cumsum(rows[:, 1:] != rows[:, :-1], axis=1)
        seed[(some[:, None] + order)[(rank <= most[some][:, None]) & (rows != none)]] = True
    return _thinned(h, np.flatnonzero(seed))


def _thinned(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of places with equal shingles as many as it takes for every passage that has one of them to have one still."""
    places = places[np.argsort(h[places], kind="stable")]
    cuts = np.flatnonzero(np.diff(h[places].view(np.int64)) != 0) + 1
    out = []
    for some in np.split(places, cuts) if len(places) else []:
        at, last = 0, len(some) - 1
        out.append(int(some[0]))
        while at < last:
            at = max(at + 1, int(np.searchsorted(some, some[at] + LENGTH, "right")) - 1)
            out.append(int(some[at]))
    return np.array(sorted(out), np.int64)


def _seeds(bits):
    """From documents: the shingles of passages that can match in another component, each with its neighbourhood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bits.value, np.uint8)
        seen: set[bytes] = set()
        sent: dict[bytes, int] = {}  # of equal neighbourhoods of a component those of one document go on
        for b in batches:
            groups, keys = b.column(1).to_pylist(), b.column(0).to_pylist()
            some = list(_whole_shingles(b, seen))
            if not some:
                continue
            lengths = np.array([len(h) for _, h in some])
            at = (np.concatenate([h for _, h in some]) >> np.uint64(32)) & np.uint64((1 << MAP_BITS) - 1)
            shared = (marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            begins = np.cumsum(lengths) - lengths
            rows = []
            for k in np.flatnonzero(np.logical_or.reduceat(shared, begins)).tolist():
                i, h = some[k]
                places = open_passages(h, shared[begins[k] : begins[k] + lengths[k]])
                if not len(places):
                    continue
                for c, around in zip(places.tolist(), neighbourhoods(h, places), strict=True):
                    around = around.tobytes()
                    if sent.setdefault(around + groups[i].to_bytes(8, "little", signed=True), keys[i]) == keys[i]:
                        rows.append((int(h[c].view(np.int64)), groups[i], keys[i], c, around))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], _SEED_NAMES)

    return run


def neighbourhoods(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The upper halves of the shingles around each place, as ``matching_starts`` reads them."""
    edge = np.zeros(LENGTH - 1, np.uint32)
    small = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, small, edge]), 2 * LENGTH - 1)[places]


class _Places:
    """Rows of ``neighbourhoods`` numbered by value: which of their passages can match in another row."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        values, ids = np.unique(rows, return_inverse=True)
        n, width = rows.shape
        self.ids, self.has, self.none = ids.reshape(rows.shape), np.zeros(len(values), bool), values[0] == 0
        # the place before with the same value
        order = np.argsort(self.ids, axis=1, kind="stable")
        there = np.take_along_axis(self.ids, order, axis=1)
        before = np.full((n, width), -1)
        before[:, 1:] = np.where(there[:, 1:] == there[:, :-1], order[:, :-1], -1)
        self.begins = np.empty_like(before)
        np.put_along_axis(self.begins, order, before + 1, axis=1)
        self.begins = np.maximum(self.begins, np.arange(width) - LENGTH + 1)
        full = rows != 0
        self.plain = (np.where(full, self.begins, 0) <= np.maximum(np.arange(width) - LENGTH + 1, 0)).all(axis=1)
        # distinct shingles of each passage, too many where there is none
        self.sizes = np.where(self._spans(full) == LENGTH, self._distinct(np.arange(n), full), 4 * LENGTH)
        self.least = self.sizes.min(axis=1)

    @staticmethod
    def _spans(flags: np.ndarray) -> np.ndarray:
        c = np.zeros((len(flags), flags.shape[1] + 1), np.int16)
        np.cumsum(flags, axis=1, out=c[:, 1:])
        return c[:, LENGTH:] - c[:, :-LENGTH]

    def _distinct(self, some: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """For each passage of some rows how many distinct values are flagged."""
        r, p = np.nonzero(flags)
        begin = self.begins[some][r, p]
        ok = begin < LENGTH  # else the value is counted at the place before in all passages
        r, p, begin = r[ok], p[ok], begin[ok]
        change = np.zeros((len(some), 2 * LENGTH), np.int32)
        size = change.size
        change += np.bincount(r * 2 * LENGTH + begin, minlength=size).reshape(change.shape)
        change -= np.bincount(r * 2 * LENGTH + p + 1, minlength=size).reshape(change.shape)
        return np.cumsum(change, axis=1)[:, :LENGTH]

    def _enough(self, shared: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
        return ((100 + PERCENT) * shared.astype(np.int64) >= PERCENT * (sizes + least)).any(axis=1)

    def like(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of other rows those with a passage that shares enough values with row ``i``, and the other way round."""
        if self.least[i] > LENGTH:
            return others[:0]
        self.has[self.ids[i]] = True
        self.has[0] &= not self.none
        flags = self.has[self.ids[others]]
        self.has[self.ids[i]] = False
        ok = self._enough(self._spans(flags), self.sizes[others], self.least[i])  # places are no fewer than values
        others, flags = others[ok], flags[ok]
        rest = np.flatnonzero(~self.plain[others])
        if len(rest):
            ok = np.ones(len(others), bool)
            ok[rest] = self._enough(self._distinct(others[rest], flags[rest]), self.sizes[others[rest]], self.least[i])
            others = others[ok]
        return others


def links_of_seed(grp: np.ndarray, key: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """Of places with one seed, in order of documents, pairs ``earlier, later`` whose passages match and that join all components which a match joins.

    Two components that are joined already are compared no more, save for other places of the document that
    joined them; of equal neighbourhoods of a component the first document's are compared, once.
    """
    same: dict[tuple, list[int]] = {}
    for i, (g, k, around) in enumerate(zip(grp.tolist(), key.tolist(), rows, strict=True)):
        at = same.setdefault((g, around.tobytes()), [i])
        if at[0] != i and key[at[0]] == k:
            at.append(i)
    kept = np.array([at[0] for at in same.values()])
    of = dict(zip(kept.tolist(), same.values(), strict=True))
    comp, key = grp[kept].copy(), key[kept]
    places, out = _Places(rows[kept]), []
    rows = places.rows
    via: list[int] = []  # documents that this one is joined with
    for i in range(1, len(kept)):
        if key[i] != key[i - 1]:
            via = []
        asked = comp[:i] != comp[i]
        if via:
            asked |= np.isin(key[:i], via)
        left = np.flatnonzero(asked)
        if len(left):
            left = places.like(i, left)
        told: set[int] = set()
        while len(left):
            some, left = left[:64], left[64:]
            some = np.array([j for j in some.tolist() if len(places.like(j, np.array([i])))], np.int64)
            if not len(some):
                continue
            match = matching_starts(rows[some], np.broadcast_to(rows[i], (len(some), rows.shape[1])))[0] >= 0
            for j in some[match].tolist():
                k = int(key[j])
                if comp[j] != comp[i] or k in via and k not in told:
                    out.extend((int(kept[j]), later) for later in of[int(kept[i])])
                    told.add(k)
                    if k not in via:
                        via.append(k)
                    comp[comp == comp[j]] = comp[i]
            left = left[(comp[left] != comp[i]) | np.isin(key[left], [k for k in via if k not in told])]
    return out


def _seed_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From seeds sorted by hash, document and place: pairs of places whose passages match, the smaller key first.

    Places are compared here and only matches are rows, for each seed no more than join its components.
    """

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        around = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint32).reshape(-1, 2 * LENGTH - 1)
        return *[b.column(k).to_numpy() for k in range(4)], around

    def links(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        seed, grp, key, place, rows = cols
        begins = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
        sizes = np.diff(np.append(begins, len(seed)))
        two = begins[sizes == 2]
        two = two[grp[two] != grp[two + 1]]
        pairs = [np.zeros((0, 2), np.int64)]
        for k in range(0, len(two), 4096):
            some = two[k : k + 4096]
            some = some[matching_starts(rows[some], rows[some + 1])[0] >= 0]
            pairs.append(np.stack([some, some + 1], 1))
        for a, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if (grp[a : a + n] != grp[a]).any():
                met = links_of_seed(grp[a : a + n], key[a : a + n], rows[a : a + n])
                pairs.append(a + np.array(met, np.int64).reshape(-1, 2))
        x, y = np.concatenate(pairs).T
        if len(x):
            yield pa.record_batch([pa.array(key[x]), pa.array(key[y]), pa.array(place[x]), pa.array(place[y])], ["key", "b", "ca", "cb"])

    held: tuple[np.ndarray, ...] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = read(b)
        if held is not None:
            cols = tuple(np.concatenate(x) for x in zip(held, cols, strict=True))
        cut = int(np.argmax(cols[0] == cols[0][-1]))
        held = tuple(c[cut:] for c in cols)
        if cut:
            yield from links(tuple(c[:cut] for c in cols))
    if held is not None:
        yield from links(held)


def _across(texts: DataFrame, found: DataFrame, work: WorkTables, parts: int) -> DataFrame:
    """Anchors ``key, slot, b, ca, cb`` around passages that match and join the components of ``found``; none that can be joined is left apart.

    Only texts that are linked already are shuffled for their component; the others are one each.
    """
    spark = texts.sparkSession
    linked = components(found.select(F.col("doc_id").alias("u"), F.col("match_id").alias("v")), work, "linked").select(F.col("node").alias("id"), "root")
    joined = likely_in(texts, "id", linked.select("id")).join(linked.hint("shuffle_hash"), "id", "left")
    joined = work.keep(joined.select("key", F.coalesce("root", "id").alias("grp"), "text"), "grouped")
    grouped = joined.unionByName(unlikely_in(texts, "id", linked.select("id")).select("key", F.col("id").alias("grp"), "text"))
    work.release()
    dealt = grouped.mapInArrow(uncollected(_all_shingles(parts)), _DEALT)
    several = dealt.groupBy("pid").applyInArrow(_in_several, _BITS)
    maps = several.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("map")).collect()
    bits = bytearray(1 << MAP_BITS - 3)
    for r in maps:
        bits[r.bucket << 12 : (r.bucket + 1) << 12] = r.map
    work.release()
    seeds = grouped.mapInArrow(uncollected(_seeds(spark.sparkContext.broadcast(bytes(bits)))), _SEEDS)
    met = seeds.repartition(parts, "hash").sortWithinPartitions("hash", "key", "place").mapInArrow(uncollected(_seed_links), "key bigint, b bigint, ca int, cb int")
    across = work.keep(met.select("key", F.lit(None).cast("bigint").alias("slot"), "b", "ca", "cb"), "across")
    work.drop("grouped")
    work.release()
    return across


def _matched(anchors: DataFrame, texts: DataFrame, work: WorkTables, parts: int, name: str) -> DataFrame:
    """Passages that match around anchors, and exact repeats among runs to hash."""
    dealt, copied = _salted(anchors, "b", likely_in(texts, "key", anchors.select("key")), work, f"crowded{name}")
    ordered = _together(copied, dealt, {"slot": "bigint", "b": "bigint", "ca": "int", "cb": "int"}, [F.col("b").asc_nulls_first(), "ca", "cb"], parts)
    around = work.keep(ordered.mapInArrow(uncollected(_around(parts)), _AROUND), f"around{name}")
    work.release()

    runs = around.filter(F.col("pid").isNotNull()).select("pid", "base", "stretches", "hashes")
    repeated = runs.repartition(parts, "pid").sortWithinPartitions("pid", "base").drop("base").mapInArrow(uncollected(_repeated), _REPEATS)
    repeated = work.keep(repeated, f"repeated{name}")
    near = around.filter(F.col("a").isNotNull())
    work.release()

    null = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    two = near.select(F.col("b").alias("key"), "a", "a_id", *null("int", "at", "to", "n"), "ca", "cb", "firsts", "counts", "words")
    three = repeated.select("key", "a", "a_id", F.col("ca").alias("at"), F.col("cb").alias("to"), "n", *null("binary", "ca", "cb", "firsts", "counts"), *null("string", "words"))
    found = two.unionByName(three)
    dealt, copied = _salted(found, "a", likely_in(texts, "key", found.select("key")), work, f"crowded-matches{name}")
    columns = {f.name: f.dataType.simpleString() for f in found.schema if f.name != "key"}
    ordered = _together(copied, dealt, columns, ["a", F.col("at").asc_nulls_first(), "to"], parts)
    return ordered.mapInArrow(uncollected(_verified), _MATCHES)


def passages(docs: DataFrame, work: WorkTables, text: str = "text") -> DataFrame:
    """``doc_id, match_id, start_word, end_word, match_start, similarity`` of repeated passages.

    ``match_id`` is a document that holds the passage too. Overlapping passages that match the same
    document are one row: ``match_start`` is where the first of them begins there, ``similarity`` the best's.
    """
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.xxhash64("doc_id", text)
    source = docs.select("doc_id", row.alias("row"), F.col(text).alias("text"))
    made = work.keep(source.mapInArrow(uncollected(_windows(parts)), _WINDOWS), "windows")
    rows = work.keep(made.filter(F.col("kind") == DOCUMENT).select("slot", "doc_id", "row", "n", "s1", "s2"), "rows")
    windows = made.filter(F.col("kind") != DOCUMENT).select("kind", "slot", "pid", "payload")
    pairs = windows.repartition(parts, "pid").sortWithinPartitions("pid", "slot", "kind").mapInArrow(uncollected(_pairs), _PAIRS)
    anchors = pairs.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "diagonal", "ca", "cb", "hash").mapInArrow(_anchors, _ANCHORS)
    of = lambda name: rows.select(F.col("slot").alias(name), F.col("doc_id").alias(f"{name}_id"), F.col("row").alias(f"{name}_row"))
    anchors = anchors.join(of("a"), "a").join(of("b"), "b").filter((F.col("a") == F.col("b")) | (F.col("a_id") != F.col("b_id")))
    anchors = work.keep(anchors.select(F.col("a_row").alias("key"), F.when(F.col("a") == F.col("b"), F.col("a")).alias("slot"), F.when(F.col("a") != F.col("b"), F.col("b_row")).alias("b"), "ca", "cb"), "anchors")
    work.drop("windows")
    work.release()

    texts = source.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("row").alias("key"), F.col("doc_id").alias("id"), "text")
    long = rows.filter((F.col("n") >= LENGTH) & F.col("doc_id").isNotNull())
    firsts = long.groupBy("s1", "s2").agg(F.min("doc_id").alias("match_id"), F.max("doc_id").alias("most"), F.count("*").alias("ends")).filter(F.col("match_id") < F.col("most")).drop("most")
    copies = spread_join(long, firsts, ["s1", "s2"], rows.count()).filter(F.col("doc_id") != F.col("match_id")).select("doc_id", "match_id", F.lit(0).cast("long").alias("start_word"), (F.col("n") + WIDTH - 1).cast("long").alias("end_word"), F.lit(0).cast("long").alias("match_start"), F.lit(1.0).alias("similarity"))
    found = work.keep(_matched(anchors, texts, work, parts, "").unionByName(copies.distinct()), "found")
    work.drop("anchors", "around", "repeated", "crowded", "crowded-matches")
    work.release()
    return found.unionByName(_matched(_across(texts, found, work, parts), texts, work, parts, "-across"))
