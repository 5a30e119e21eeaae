"""N-gram Jaccard join: prefix-tree verification of what exact prefix filters leave over.

A document is its set of 5-word shingles (64-bit hashes); two link when their Jaccard similarity is
at least ``PERCENT``/100. The result is every document's connected component. No link between
different sets is lost:

1. **Sets.** Each task writes, for the first of equal sets it meets, the smallest ``k + l`` hashes of
   the set, ``k`` being the hashes that a linked document may lack and ``l`` about ``k / 2`` more.
   Two linked sets share at least ``l`` of them (of the smaller's), so sets that share fewer with
   all others are done.
2. **Rare first.** The rest order their shared hashes by document frequency and keep all but the
   last ``l - 1``: two linked sets share at least one of those, and frequent passages drop out.
3. **Candidates.** Documents that share such a hash, sorted by size, join the first of their run of
   compatible sizes: rows grow with the documents and not with their pairs. Components of these
   joins hold all links.
4. **Whole sets.** A frequent passage may be among the smallest hashes of a great many documents that share little else, so
   components of more than ``CHUNK_BYTES`` of hashes go through step 2 and 3 again with all hashes of their sets: linked sets
   share ``l`` of them, ``l`` being what they have in common at least. Inside a task the same is done again, with the
   frequencies among its sets, until components don't fall apart any more.
5. **Tries.** In each component, sets are ordered by one global order (frequent first, then hash) and
   stored in a radix trie, without the hashes that no other has. Probes walk it together, sharing the overlap of common beginnings, and leave a
   subtree when the sizes below it, the misses so far or the rest of the probe are too little, or
   when all sets below are in its own component already. Components that are still of more than ``CHUNK_BYTES`` of hashes
   are cut into classes by set size, linked sets being in the same or in neighbouring classes, and classes
   into chunks of that many bytes; pairs of chunks that can link go to tasks of their own, so no task
   holds an unbounded group.
6. Components of the verified links, spread to equal sets.

Defined cases: a document without words (or with a null text) has an empty set, links with nothing and is
its own component; shorter texts than five words are one shingle; a null ``doc_id`` links with nothing and
has a null component; rows that repeat an id are one document, which links with all that any of its texts
links with, and each row has its own text's ``n_shingles``; other columns are ignored by
``join`` and kept by ``keep_first``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkTables, likely_in, map_batches, prepare, shingles_of, uncollected
from .components import components, spread_join

WIDTH = 5
PERCENT = 75
CHUNK_BYTES = 8 << 20
#: Size classes grow by this factor; it is over 100 / PERCENT, so linked sets are at most one class apart.
STEP = 1.35


def least_overlap(n, percent: int = PERCENT):
    """Of the hashes of a set of size ``n``, how many a linked set has at least."""
    return -(-percent * n // 100)


def spare(n, percent: int = PERCENT):
    """``l``: overlap that linked sets have among their smallest hashes, grows with n."""
    return np.maximum(1, -(-(n - least_overlap(n, percent)) // 2))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return int(min(n, n - least_overlap(n, percent) + spare(n, percent)))


def needed(n, percent: int = PERCENT):
    """Overlap among the prefixes with any set of compatible size."""
    return spare(least_overlap(n, percent), percent)


def digest_of(hashes: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


_SETS = "kind int, slot bigint, doc_id bigint, n int, s1 bigint, s2 bigint, pid int, tokens binary, counts binary, sizes binary"


def _sets(parts: int):
    """Rows of kind 0, one for each document, and of kind 1, prefixes dealt out by hash."""
    names = [c.split()[0] for c in _SETS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 34
        seen: set[bytes] = set()
        for b in batches:
            docs, rows = b.num_rows, []
            sizes, sent, tokens = np.zeros(docs, np.uint32), np.zeros(docs, np.int64), []
            sums = np.zeros((docs, 2), np.int64)
            ids = b.column(0).to_pylist()
            for i, h in enumerate(shingles_of(b.column(1), WIDTH)):
                if not len(h):
                    continue
                h = np.unique(h)
                sizes[i] = len(h)
                digest = digest_of(h)
                sums[i] = np.frombuffer(digest, "<i8")
                if ids[i] is not None and digest not in seen:
                    seen.add(digest)
                    some = h[: prefix_length(len(h))]
                    sent[i] = len(some)
                    tokens.append(some)
            n = pa.nulls
            rows.append(pa.record_batch([pa.array(np.zeros(docs, np.int32)), pa.array(base + np.arange(docs)), b.column(0), pa.array(sizes.astype(np.int32)), pa.array(sums[:, 0]), pa.array(sums[:, 1]), n(docs, kinds[6]), n(docs, kinds[7]), n(docs, kinds[8]), n(docs, kinds[9])], names))
            if tokens:
                out = _dealt(np.concatenate(tokens), np.repeat(np.arange(docs), sent), docs, parts)
                m = len(out)
                rows.append(pa.record_batch([pa.array(np.ones(m, np.int32)), pa.array(np.full(m, base)), n(m, kinds[2]), n(m, kinds[3]), n(m, kinds[4]), n(m, kinds[5]), pa.array([x[0] for x in out], kinds[6]), pa.array([x[1] for x in out], kinds[7]), pa.array([x[2] for x in out], kinds[8]), pa.array([sizes.astype("<u4").tobytes()] * m, kinds[9])], names))
            base += docs
            yield from rows

    return run


def _dealt(flat: np.ndarray, owner: np.ndarray, docs: int, parts: int) -> list[tuple[int, bytes, bytes]]:
    """Hashes dealt out by value, each part with how many of them each of the documents has."""
    pid = ((flat >> np.uint64(7)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(pid, kind="stable")
    cuts = np.searchsorted(pid[order], np.arange(parts + 1))
    return [(p, flat[o].tobytes(), np.bincount(owner[o], minlength=docs).astype("<u4").tobytes()) for p in range(parts) if len(o := order[cuts[p] : cuts[p + 1]])]


_WHOLE = "kind int, slot bigint, doc_id bigint, pid int, tokens binary, counts binary, sizes binary"


def _whole(parts: int):
    """From ids and whole sets: rows of kind 0, one for each set, and of kind 1, all hashes dealt out by value."""
    names = [c.split()[0] for c in _WHOLE.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 34
        for b in batches:
            docs = b.num_rows
            if not docs:
                continue
            sets = [np.frombuffer(x, "<u8") for x in b.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets], "<u4")
            yield pa.record_batch([pa.array(np.zeros(docs, np.int32)), pa.array(base + np.arange(docs)), b.column(0), *[pa.nulls(docs, k) for k in kinds[3:]]], names)
            out = _dealt(np.concatenate(sets), np.repeat(np.arange(docs), sizes), docs, parts)
            m = len(out)
            yield pa.record_batch([pa.array(np.ones(m, np.int32)), pa.array(np.full(m, base)), pa.nulls(m, kinds[2]), *[pa.array([x[i] for x in out], kinds[3 + i]) for i in range(3)], pa.array([sizes.tobytes()] * m, kinds[6])], names)
            base += docs

    return run


_SHARED = "part int, slots binary, sizes binary, lengths binary, tokens binary, counts binary"
_RARE = "token bigint, n int, slot bigint"


def _shared(parts: int):
    """Of one range of hashes: each document's hashes that another has too, with their frequencies.

    Documents are dealt out to ``parts`` rows, so the rows don't multiply with the ranges.
    """

    def run(t: pa.Table) -> pa.Table:
        tokens, slots, sizes = [], [], []
        for r in t.select(["slot", "tokens", "counts", "sizes"]).to_pylist():
            c = np.frombuffer(r["counts"], "<u4")
            own = np.repeat(np.arange(len(c)), c)
            tokens.append(np.frombuffer(r["tokens"], "<u8"))
            slots.append(r["slot"] + own)
            sizes.append(np.frombuffer(r["sizes"], "<u4")[own])
        token, slot, size = np.concatenate(tokens), np.concatenate(slots), np.concatenate(sizes)
        order = np.argsort(token, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(token[order]) != 0]))
        times = np.diff(np.append(begins, len(order)))
        df = np.empty(len(order), np.uint32)
        df[order] = np.repeat(times, times)
        keep = np.flatnonzero(df > 1)
        part = (slot[keep].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts)
        keep = keep[np.lexsort((slot[keep], part))]
        part = np.sort(part)
        token, slot, size, df = token[keep], slot[keep], size[keep], df[keep].astype("<u4")
        cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        rows = []
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            if a == b:
                continue
            first = np.flatnonzero(np.concatenate([[True], np.diff(slot[a:b]) != 0]))
            lengths = np.diff(np.append(first, b - a)).astype("<i4")
            rows.append((p, slot[a:b][first].tobytes(), size[a:b][first].astype("<i4").tobytes(), lengths.tobytes(), token[a:b].tobytes(), df[a:b].tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.table([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], [c.split()[0] for c in _SHARED.split(", ")])

    return run


def _rarest(order: np.ndarray, held: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which rows, in ``order`` of slots and rarest first, are all but the last ``most - 1`` of a slot's ``held``; none of slots that hold less than ``most``."""
    place = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
    return order[(place <= np.repeat(held - most, held)) & np.repeat(held >= most, held)]


def _rare(shared: Callable):
    """Of one part of the documents: the rarest shared hashes of those that share enough, by ``shared`` what a set of some size has to."""

    def run(t: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in t.column(c).to_pylist()]
        lengths = np.concatenate(read("lengths", "<i4"))
        slot, size = (np.repeat(np.concatenate(read(c, k)), lengths) for c, k in (("slots", "<i8"), ("sizes", "<i4")))
        token, df = np.concatenate(read("tokens", "<u8")), np.concatenate(read("counts", "<u4"))
        order = np.lexsort((token, df, slot))
        begins = np.flatnonzero(np.concatenate([[True], np.diff(slot[order]) != 0]))
        held = np.diff(np.append(begins, len(slot)))
        keep = _rarest(order, held, shared(size[order[begins]].astype(np.int64)))
        return pa.table([pa.array(token[keep].view(np.int64)), pa.array(size[keep].astype(np.int32)), pa.array(slot[keep])], [c.split()[0] for c in _RARE.split(", ")])

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by hash and size: each document joins the head of its run of compatible sizes."""
    last = None  # hash, size and head of the row before
    for b in batches:
        if not b.num_rows:
            continue
        token, n, slot = (c.to_numpy() for c in b.columns)
        begins = np.empty(len(token), bool)
        begins[1:] = (token[1:] != token[:-1]) | (100 * n[:-1].astype(np.int64) < PERCENT * n[1:].astype(np.int64))
        begins[0] = last is None or last[0] != token[0] or 100 * last[1] < PERCENT * int(n[0])
        at = np.maximum.accumulate(np.where(begins, np.arange(len(token)), -1))
        head = np.where(at < 0, last[2] if last else 0, slot[np.maximum(at, 0)])
        last = (token[-1], int(n[-1]), head[-1])
        pairs = np.unique(np.stack([slot, head], 1)[slot != head], axis=0)
        if len(pairs):
            yield pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["u", "v"])


class _Node:
    __slots__ = ("segment", "last", "kids", "low", "high", "slack", "here", "label")

    def __init__(self, segment: list[int], size: int, slack: int):
        self.segment, self.last = segment, segment[-1] if segment else -1
        self.kids: dict[int, _Node] = {}
        self.low = self.high = size  # sizes of the sets below
        self.slack = slack  # the most of (100 + percent) * ranks - percent * size of a set below
        self.here: list[int] = []  # sets that end here
        self.label = -1  # the component that all sets below are in, if it's one


#: Probes that walk the trie together, at most; and ranks of a segment, times probes, that are looked at between two cuts.
PROBES, PIECE = 1024, 1 << 15


class Trie:
    """Radix trie of sets, each a sorted list of ranks in one global order, with their components.

    ``sizes`` count the hashes that no other set has too; the ranks needn't hold those.
    """

    def __init__(self, sizes: np.ndarray, percent: int = PERCENT):
        self.sizes, self.percent = sizes, percent
        self.parent = list(range(len(sizes)))
        self.root = _Node([], 1 << 60, -(1 << 60))
        self.root.high = 0

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def add(self, me: int, ranks: list[int]) -> None:
        node, at, end, size = self.root, 0, len(ranks), int(self.sizes[me])
        slack = (100 + self.percent) * end - self.percent * size
        while True:
            node.low, node.high, node.slack = min(node.low, size), max(node.high, size), max(node.slack, slack)
            if at == end:
                node.here.append(me)
                return
            kid = node.kids.get(ranks[at])
            if kid is None:
                kid = node.kids[ranks[at]] = _Node(ranks[at:], size, slack)
                kid.here.append(me)
                return
            s, k = kid.segment, 0
            while k < len(s) and at + k < end and s[k] == ranks[at + k]:
                k += 1
            if k < len(s):  # the path parts inside the segment
                upper = _Node(s[:k], size, slack)
                upper.low, upper.high, upper.slack = kid.low, kid.high, kid.slack
                kid.segment = s[k:]
                upper.kids[s[k]] = kid
                node.kids[ranks[at]] = upper
                kid = upper
            node, at = kid, at + k

    def probe(self, sets: list[int], ranked: list[np.ndarray], larger: bool) -> None:
        """Join sets with the components of all stored sets that they link with; only of those not smaller than themselves, if ``larger``.

        Many probes walk the trie together, more from time to time: what the first have joined is one component to the next.
        """
        nodes = [self.root]
        for node in nodes:
            nodes.extend(node.kids.values())
            node.here.sort(key=self.sizes.__getitem__)
        at, step = 0, 64
        while at < len(sets):
            for node in reversed(nodes):
                labels = {self.find(i) for i in node.here[:2]} | {k.label for k in node.kids.values()}
                node.label = labels.pop() if len(labels) == 1 and all(self.find(i) == self.find(node.here[0]) for i in node.here[2:]) else -1
            some = sets[at : at + step]
            self._walk(np.array(some), [ranked[i] for i in some], larger)
            at, step = at + step, min(2 * step, PROBES)

    def _walk(self, some: np.ndarray, ranked: list[np.ndarray], larger: bool) -> None:
        t, m = self.percent, len(some)
        size, kept = self.sizes[some], np.array([len(r) for r in ranked])
        least, most = size if larger else -(-t * size // 100), 100 * size // t
        own = np.array([self.find(i) for i in some.tolist()])
        # ranks that many of the probes have are rows of a table, of the others there is a list of the probes that have them
        flat, who = np.concatenate(ranked), np.repeat(np.arange(m), kept)
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        times = np.diff(np.append(begins, len(flat)))
        many = times > max(1, m // 16)
        edges = flat[begins[many]]
        table = np.zeros((len(edges), m), np.uint8)
        table[np.repeat(np.arange(len(edges)), times[many]), who[np.repeat(many, times)]] = 1
        seen = np.concatenate([np.zeros((1, m), np.int32), np.cumsum(table, axis=0, dtype=np.int32)])  # of the table's ranks, in order
        row, few = (dict(zip(flat[begins[held]].tolist(), at, strict=True)) for held, at in ((many, range(len(edges))), (~many, begins[~many].tolist())))
        ends = dict(zip(begins.tolist(), (begins + times).tolist(), strict=True))
        stack = [(self.root, np.arange(m), np.zeros(m, np.int64), 0)]
        while stack:
            node, live, shared, depth = stack.pop()
            segment, low = node.segment, node.low
            k = 0
            while True:
                piece = segment[k : k + 32 + PIECE // len(live)]
                last, k = piece[-1] if piece else -1, k + len(piece)
                if piece:
                    rows, lists = [row[r] for r in piece if r in row], [who[few[r] : ends[few[r]]] for r in piece if r in few]
                    if rows:
                        shared = shared + table[rows].take(live, axis=1).sum(axis=0, dtype=np.int64)
                    if lists:
                        shared = shared + np.bincount(np.concatenate(lists), minlength=m)[live]
                    depth += len(piece)
                # ranks of the probe that may still come; those of the lists all may
                left = kept[live] - seen[np.searchsorted(edges, last, "right"), live]
                fits = (node.slack - (100 + t) * (depth - shared) >= t * size[live]) & (low <= most[live]) & (node.high >= least[live])
                fits &= (100 + t) * (shared + left) >= t * (size[live] + np.maximum(low, least[live]))
                if node.label >= 0:
                    fits &= own[live] != node.label
                live, shared = live[fits], shared[fits]
                if k >= len(segment) or not len(live):
                    break
            if not len(live):
                continue
            if node.here:
                # the smaller a set that ends here, the sooner it links
                count = np.searchsorted(self.sizes[node.here], (100 + t) * shared // t - size[live], "right")
                if count.any():
                    for i in some[live[count > 0]].tolist():
                        self.union(i, node.here[0])
                    for i in node.here[1 : int(count.max())]:
                        self.union(i, node.here[0])
            stack.extend((kid, live, shared, depth) for kid in node.kids.values())


def fall_apart(sets: list[np.ndarray], percent: int = PERCENT) -> list[np.ndarray]:
    """Components of sets, by position, that hold all links between them; sets that can't link are in none.

    Linked sets share one of the rarest of their hashes that another set has too, and have compatible sizes.
    """
    size = np.array([len(s) for s in sets], np.int64)
    own = np.repeat(np.arange(len(sets)), size)
    _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[inverse] > 1)
    token, own, df = inverse[some], own[some], times[inverse[some]]
    held = np.bincount(own, minlength=len(sets))
    keep = _rarest(np.lexsort((token, df, own)), held, least_overlap(size, percent))
    token, own = token[keep], own[keep]
    order = np.lexsort((own, size[own], token))
    token, own = token[order], own[order]
    n = size[own]
    joins = np.flatnonzero((token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:]))
    parent = list(range(len(sets)))
    for i, j in np.unique(np.stack([own[joins], own[joins + 1]], 1), axis=0).tolist():
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        parent[max(i, j)] = min(i, j)
    for i in range(len(sets)):
        parent[i] = parent[parent[i]]
    root = np.array(parent)
    order = np.argsort(root, kind="stable")
    cuts = np.flatnonzero(np.diff(root[order])) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def link(sets: list[np.ndarray], probes: list[bool] | None = None, stored: list[bool] | None = None, percent: int = PERCENT) -> list[int]:
    """For each set the first set (by position) of its component.

    ``probes`` and ``stored`` say which sets ask and which are asked; all by default.
    """
    first = list(range(len(sets)))
    todo = [np.arange(len(sets))] if sets else []
    while todo:
        some = todo.pop()
        if probes is not None and not (any(probes[i] for i in some) and any(stored[i] for i in some)):
            continue
        parts = fall_apart([sets[i] for i in some], percent)
        if len(parts) == 1 and len(parts[0]) == len(some):
            own = lambda flags: flags and [flags[i] for i in some]  # noqa: B023, E731
            for i, k in zip(some.tolist(), _tried([sets[i] for i in some], own(probes), own(stored), percent), strict=True):
                first[i] = int(some[k])
        else:
            todo.extend(some[p] for p in parts)
    return first


def _tried(sets: list[np.ndarray], probes: list[bool] | None, stored: list[bool] | None, percent: int) -> list[int]:
    """As ``link`` by a trie of all the sets; hashes that only one set has count in its size alone."""
    sizes = np.array([len(s) for s in sets], np.int64)
    own = np.repeat(np.arange(len(sets)), sizes)
    tokens, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -times))] = np.arange(len(tokens))
    some = np.flatnonzero(times[inverse] > 1)
    some = some[np.lexsort((rank[inverse[some]], own[some]))]
    ranked = np.split(rank[inverse[some]], np.cumsum(np.bincount(own[some], minlength=len(sets)))[:-1])
    trie = Trie(sizes, percent)
    order = [i for i in np.argsort(sizes, kind="stable").tolist() if len(ranked[i])]
    for i in order:
        if stored is None or stored[i]:
            trie.add(i, ranked[i].tolist())
    trie.probe([i for i in order if probes is None or probes[i]], ranked, probes is None)
    return [trie.find(i) for i in range(len(sets))]


_LINKS = "u bigint, v bigint"


def _verify(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Links of one component, or of one pair of its chunks, as a star for each component found."""
    _, a, b = (k.as_py() for k in key)
    docs = t.column("doc_id").to_pylist()
    sets = [np.frombuffer(x, "<u8") for x in t.column("tokens").to_pylist()]
    if a == b:
        found = link(sets)
    else:
        chunk = t.column("chunk").to_pylist()
        found = link(sets, [c == b for c in chunk], [c == a for c in chunk])
    pairs = [(docs[i], docs[k]) for i, k in enumerate(found) if docs[i] != docs[k]]
    return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])


def _heads_of(shared: DataFrame, least: Callable, parts: int) -> DataFrame:
    """Documents (by slot) and the heads that they join by their rarest shared hashes."""
    rare = shared.groupBy("part").applyInArrow(_rare(least), _RARE)
    return rare.repartition(parts, "token").sortWithinPartitions("token", "n", "slot").mapInArrow(_heads, _LINKS).distinct()


def _finer(sets: DataFrame, work: WorkTables, parts: int) -> DataFrame:
    """The sets with those of large groups in the components that their whole sets leave; sets that can't link are left out."""
    total = sets.groupBy("group").agg(F.sum(F.col("n").cast("long") * 8).alias("total"))
    large = work.keep(total.filter(F.col("total") > CHUNK_BYTES).select("group"), "large")
    if large.isEmpty():
        return sets
    big = sets.join(large, "group", "left_semi")
    made = work.keep(big.select("doc_id", "tokens").mapInArrow(uncollected(_whole(parts)), _WHOLE), "whole")
    shared = made.filter(F.col("kind") == 1).groupBy("pid").applyInArrow(_shared(parts), _SHARED)
    heads = work.keep(_heads_of(shared, least_overlap, parts), "finer-heads")
    of = lambda name: made.filter(F.col("kind") == 0).select(F.col("slot").alias(name), F.col("doc_id").alias(f"{name}_id"))
    joins = heads.join(of("u"), "u").join(of("v"), "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))
    groups = components(joins, work, "finer").select(F.col("node").alias("doc_id"), F.col("root").alias("group"))
    finer = work.keep(big.drop("group").join(groups, "doc_id").select(*sets.columns), "finer")
    work.drop("whole", "finer-heads")
    work.release()
    return sets.join(large, "group", "left_anti").select(*sets.columns).unionByName(finer)


def join(docs: DataFrame, work: WorkTables, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select("doc_id", F.col(text).alias("text"))

    made = work.keep(source.mapInArrow(uncollected(_sets(parts)), _SETS), "sets")
    rows = made.filter(F.col("kind") == 0).select("slot", "doc_id", "n", "s1", "s2")
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    known, total = rows.filter(linked), rows.count()
    first = known.groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.count("*").alias("ends"))
    # equal sets: every document has the first one of its set
    alone = rows.filter(~linked).select("slot", "doc_id", "n", F.col("doc_id").alias("first"))
    classes = work.keep(spread_join(known, first, ["s1", "s2"], total).select("slot", "doc_id", "n", "first").unionByName(alone), "classes")

    shared = made.filter(F.col("kind") == 1).groupBy("pid").applyInArrow(_shared(parts), _SHARED)
    heads = work.keep(_heads_of(shared, needed, parts), "heads")
    work.drop("sets")
    work.release()

    of = lambda name: classes.filter(F.col("first").isNotNull()).select(F.col("slot").alias(name), F.col("first").alias(f"{name}_first"))
    joins = heads.join(of("u"), "u").join(of("v"), "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    groups = work.keep(components(joins, work, "joins").select(F.col("node").alias("doc_id"), F.col("root").alias("group")), "groups")

    # whole sets of the candidates; rows that share an id have a set each
    chosen = likely_in(source, "doc_id", groups.select("doc_id")).join(groups, "doc_id")

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(h) for h in shingles_of(b.column(2), WIDTH)]
        sums = np.array([np.frombuffer(digest_of(s), "<i8") for s in sets], np.int64).reshape(-1, 2)
        cols = [b.column(0), b.column(1), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())]
        return pa.record_batch(cols, ["doc_id", "group", "s1", "s2", "n", "tokens"])

    sets = map_batches(chosen.select("doc_id", "group", "text"), read, "doc_id bigint, group bigint, s1 bigint, s2 bigint, n int, tokens binary")
    sets = work.keep(sets.filter(F.col("n") > 0).dropDuplicates(["doc_id", "s1", "s2"]).drop("s1", "s2"), "candidates")
    work.release()
    links = _in_chunks(_finer(sets, work, parts)).groupBy("group", "a", "b").applyInArrow(_verify, _LINKS)
    # a document that is in several classes of equal sets joins them
    several = classes.filter(F.col("first").isNotNull()).groupBy("doc_id").agg(F.min("first").alias("low"), F.max("first").alias("high")).filter(F.col("low") < F.col("high")).select(F.col("doc_id").alias("u"))
    same = several.join(classes.select(F.col("doc_id").alias("u"), F.col("first").alias("v")), "u").filter(F.col("v").isNotNull())
    roots = work.keep(components(links.unionByName(same), work, "links"), "roots")
    work.drop("candidates", "finer", "heads", "groups")
    # a set that a great many documents have would be one key of the join
    sizes = classes.filter(F.col("first").isNotNull()).groupBy("first").agg(F.count("*").alias("ends"))
    found = sizes.join(roots.select(F.col("node").alias("first"), "root"), "first", "left")
    made = spread_join(classes, found, ["first"], total).unionByName(classes.filter(F.col("first").isNull()).withColumn("root", F.lit(None).cast("long")))
    return made.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "first").alias("component_id"))


def _in_chunks(sets: DataFrame) -> DataFrame:
    """Sets with ``group``, the pair of chunks ``a, b`` that a task compares and the ``chunk`` the set is in.

    A chunk is a size class of a group or a salted part of one, numbered ``class << 32 | salt``; small groups are one chunk.
    """
    bytes_ = F.octet_length("tokens")
    sets = sets.withColumn("class", F.floor(F.log("n") / F.lit(float(np.log(STEP)))).cast("long"))
    total = sets.groupBy("group").agg(F.sum(bytes_).alias("total"))
    large = total.filter(F.col("total") > CHUNK_BYTES).select("group")
    small = sets.join(large, "group", "left_anti").select("group", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("chunk"), "doc_id", "tokens")
    big = sets.join(large, "group", "left_semi")
    parts = big.groupBy("group", "class").agg(F.ceil(F.sum(bytes_) / CHUNK_BYTES).cast("long").alias("salts"))
    near = parts.select("group", F.col("class").alias("next"), F.col("salts").alias("next_salts"))
    of = parts.join(near.withColumn("class", F.col("next") - 1).drop("next"), ["group", "class"], "left")
    below = near.withColumn("class", F.col("next") + 1).select("group", "class", F.col("next_salts").alias("last_salts"))
    of = of.join(below, ["group", "class"], "left")
    big = big.join(of, ["group", "class"]).withColumn("salt", F.pmod(F.xxhash64("doc_id", "n"), F.col("salts")))
    chunk = lambda c, salt: F.shiftleft(c, 32) + salt
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    own = chunk(F.col("class"), F.col("salt"))
    pairs = F.concat(
        F.transform(upto(F.col("salts")), lambda k: F.struct(F.least(own, chunk(F.col("class"), k)).alias("a"), F.greatest(own, chunk(F.col("class"), k)).alias("b"))),
        F.transform(upto(F.col("next_salts")), lambda k: F.struct(own.alias("a"), chunk(F.col("class") + 1, k).alias("b"))),
        F.transform(upto(F.col("last_salts")), lambda k: F.struct(chunk(F.col("class") - 1, k).alias("a"), own.alias("b"))),
    )
    big = big.withColumn("chunk", own).withColumn("pair", F.explode(pairs))
    return small.unionByName(big.select("group", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "chunk", "doc_id", "tokens"))


def keep_first(docs: DataFrame, work: WorkTables) -> DataFrame:
    """The rows, with all their columns, of documents that are the first of their component, and those with a null id.

    Rows that share an id are one document: all its different texts stay, of rows with equal texts one.
    """
    first = join(docs, work).filter(F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("component_id"))).select("doc_id").distinct()
    known = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    shingle = " || ' ' || ".join(f"ws[i + {k}]" if k else "ws[i]" for k in range(WIDTH))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM d WHERE len(ws) >= {WIDTH}),
s AS (SELECT DISTINCT doc_id, {shingle} AS s FROM e
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') AS s FROM d WHERE len(ws) > 0 AND len(ws) < {WIDTH}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * o >= {PERCENT} * (x.n + y.n - o)),
r AS (SELECT doc_id AS u, doc_id AS c FROM n UNION SELECT l.v AS u, r.c AS c FROM r JOIN l ON l.u = r.u),
c AS (SELECT u, min(c) AS c FROM r GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.u
"""
