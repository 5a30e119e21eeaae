"""Neighbourhood sums and nearest points of quantised clouds, block against block.

Pairs of points never become rows. The cloud is packed along its Morton curve into chunks of at most ``MOST`` points,
inside which each ``BLOCK`` points are a box of a k-d tree. Pairs of chunks within the radius meet, those of one chunk in
one task, one after the other. There a block whose box lies wholly inside a ball adds its sums, one wholly outside is left
out, and only blocks that the sphere may cut are compared point by point, as matrix products. Sums are of integers and exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import ship, written
from .chunks import node_code

AXES = ("x", "y", "z")
PRODUCTS = tuple((i, j) for i in range(3) for j in range(i, 3))
BLOCK = 128
#: Points of one chunk at most, and about how many chunks a smaller cloud has.
MOST = 16_384
PARTS = 128
#: More partitions than this are no help.
MOST_PARTITIONS = 2_000

_BOX = [f"{n}{a}" for n in "lh" for a in AXES]
_PACKED = "chunk long, " + ", ".join(f"{c} long" for c in _BOX) + ", ids binary, places binary"


def tree_order(places: np.ndarray) -> np.ndarray:
    """An order in which each run of ``BLOCK`` points is a leaf of a k-d tree."""
    out: list[np.ndarray] = []
    left = [np.arange(len(places))]
    while left:
        at = left.pop()
        if len(at) <= BLOCK:
            out.append(at)
            continue
        here = places[at]
        axis = int(np.argmax(here.max(0) - here.min(0)))
        half = BLOCK * (-(-len(at) // BLOCK) // 2)
        cut = np.argpartition(here[:, axis], half)
        left += [at[cut[half:]], at[cut[:half]]]
    return np.concatenate(out)


def _pack(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, places = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)

        def row(k: int) -> pa.RecordBatch:
            order = tree_order(places[:k])
            p = places[:k][order]
            box = [[int(v)] for v in (*p.min(0), *p.max(0))]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *[pa.array(v, pa.int64()) for v in box], pa.array([ids[:k][order].tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary())], names=["chunk", *_BOX, "ids", "places"])

        for b in batches:
            ids = np.concatenate([ids, b.column(0).to_numpy(zero_copy_only=False)])
            places = np.concatenate([places, np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)], 1)])
            while len(ids) >= size:
                yield row(size)
                chunk, ids, places = chunk + 1, ids[size:], places[size:]
        if len(ids):
            yield row(len(ids))

    return run


#: Stands for an id that is null.
NO_ID = -(1 << 63)


def packed(points: DataFrame, size: int | None = None) -> DataFrame:
    """The cloud as a written table of chunks: box, ids and places. Points without a place are in none."""
    ship(points.sparkSession)
    places = [f"q{a}" for a in AXES]
    p = points.select(F.coalesce(F.col("point_id").cast("long"), F.lit(NO_ID)).alias("point_id"), *[F.col(q).cast("long").alias(q) for q in places]).dropna(subset=places)
    b = p.agg(F.count("*").alias("n"), *[F.min(f"q{a}").alias(f"l{a}") for a in AXES], *[F.max(f"q{a}").alias(f"h{a}") for a in AXES]).first()
    size = size or min(MOST, max(BLOCK, -(-b.n // PARTS)))
    if b.n:
        low = [b[f"l{a}"] for a in AXES]
        edge = max(b[f"h{a}"] - lo for a, lo in zip(AXES, low, strict=True)) + 1
        p = p.withColumn("code", node_code(low, edge)).repartitionByRange(min(MOST_PARTITIONS, max(1, b.n // (4 * size))), "code", "point_id").sortWithinPartitions("code", "point_id")
    return written(p.select("point_id", "qx", "qy", "qz").mapInArrow(_pack(size), _PACKED), "chunks")


def _meeting(own: DataFrame, others: DataFrame, r2: int) -> DataFrame:
    """``own, near, other, ids, places``: each chunk's own points (``near`` -1) and, itself and near ones first, the chunks within the radius of its box."""
    boxes = [t.select("chunk", *_BOX) for t in (own, others)]
    widest = max((v or 0) for t in boxes for v in t.agg(*[F.max(F.col(f"h{a}") - F.col(f"l{a}")) for a in AXES]).first())
    edge = max(widest, math.isqrt(r2)) + 1
    cell = lambda a: F.expr(f"l{a} div {edge} - IF(l{a} % {edge} < 0, 1, 0)")
    # the low corners of boxes that are within the radius are less than two edges apart
    left = boxes[0].select(F.col("chunk").alias("own"), *[F.col(c).alias(f"own_{c}") for c in _BOX], *[cell(a).alias(f"o{a}") for a in AXES])
    for a in AXES:
        left = left.withColumn(f"c{a}", F.explode(F.sequence(F.col(f"o{a}") - 2, F.col(f"o{a}") + 2)))
    right = boxes[1].select(F.col("chunk").alias("other"), *_BOX, *[cell(a).alias(f"c{a}") for a in AXES])
    gaps = [F.greatest(F.col(f"l{a}") - F.col(f"own_h{a}"), F.col(f"own_l{a}") - F.col(f"h{a}"), F.lit(0)).cast("double") for a in AXES]
    near = gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]
    pairs = left.join(right, [f"c{a}" for a in AXES]).select("own", near.alias("near"), "other").filter(F.col("near") <= r2 * (1 + 1e-9) + 1)
    met = pairs.join(others.select(F.col("chunk").alias("other"), "ids", "places"), "other").select("own", "near", "other", "ids", "places")
    near = F.when(F.col("own") == F.col("other"), F.lit(-0.5)).otherwise(F.col("near")) if own is others else F.col("near")
    met = met.withColumn("near", near)
    first = own.select(F.col("chunk").alias("own"), F.lit(-1.0).alias("near"), F.lit(None).cast("long").alias("other"), "ids", "places")
    return first.unionByName(met).repartition(min(MOST_PARTITIONS, max(1, own.count())), "own").sortWithinPartitions("own", "near", "other")


def _places(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.int64).reshape(-1, 3)


def _boxes(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.arange(0, len(places), BLOCK)
    return starts, np.minimum.reduceat(places, starts, axis=0), np.maximum.reduceat(places, starts, axis=0)


def _terms(places: np.ndarray) -> np.ndarray:
    """Columns 1, x, y, z and their products."""
    return np.concatenate([np.ones((len(places), 1), places.dtype), places, *[places[:, i : i + 1] * places[:, j : j + 1] for i, j in PRODUCTS]], 1)


def _exact(*places: np.ndarray) -> bool:
    """Are sums of squares of these places exact as floating-point numbers?"""
    top = max(int(np.abs(p).max()) for p in places)
    return top * top * max(16, *[len(p) for p in places]) < 1 << 53


def _squares(of: np.ndarray, to: np.ndarray, exact: bool, reach: int) -> np.ndarray:
    """Squared distances of all pairs; -1 beyond ``reach`` along an axis where they might not fit a number."""
    if exact:
        a = np.concatenate([-2.0 * of, np.ones((len(of), 1)), (of * of).sum(1, keepdims=True)], 1)
        b = np.concatenate([to, (to * to).sum(1, keepdims=True), np.ones((len(to), 1))], 1)
        return a @ b.T
    gaps = [to[None, :, k] - of[:, None, k] for k in range(3)]
    inside = (np.abs(gaps[0]) <= reach) & (np.abs(gaps[1]) <= reach) & (np.abs(gaps[2]) <= reach)
    return np.where(inside, sum(np.where(inside, g, 0) ** 2 for g in gaps), -1)


class _Sums:
    """Counts, sums, products and, if wanted, height bounds of the neighbours of one chunk's points."""

    NONE = np.iinfo(np.int64)

    def __init__(self, r2: list[int], heights: bool):
        self.r2, self.heights = r2, heights

    def begin(self, ids: bytes, places: bytes) -> None:
        self.ids, p = np.frombuffer(ids, np.int64).copy(), _places(places)
        self.origin = (p.min(0) + p.max(0)) // 2
        self.p = p - self.origin
        self.starts, self.low, self.high = _boxes(self.p)
        self.sums = np.zeros((len(self.r2), len(p), 10), np.int64)
        self.least = np.full((len(self.r2), len(p)), self.NONE.max)
        self.most = np.full((len(self.r2), len(p)), self.NONE.min)

    def meet(self, ids: bytes, places: bytes) -> None:
        q = _places(places) - self.origin
        starts, low, high = _boxes(q)
        exact = _exact(self.p, q)
        kind = np.float64 if exact else np.int64
        terms = _terms(q.astype(kind))
        whole = np.add.reduceat(terms, starts, axis=0)
        near = (np.maximum(np.maximum(low[None] - self.high[:, None], self.low[:, None] - high[None]), 0).astype(float) ** 2).sum(2)
        far = (np.maximum(high[None] - self.low[:, None], self.high[:, None] - low[None]).astype(float) ** 2).sum(2)
        own = self.p.astype(kind)
        for k, r2 in enumerate(self.r2):
            full = far <= r2 * (1 - 1e-9) - 1
            cut = (near <= r2 * (1 + 1e-9) + 1) & ~full
            added = (full.astype(kind) @ whole).astype(np.int64)
            self.sums[k] += np.repeat(added, BLOCK, axis=0)[: len(own)]
            if self.heights:
                bottom = np.where(full, low[None, :, 1], self.NONE.max).min(1)
                top = np.where(full, high[None, :, 1], self.NONE.min).max(1)
                self.least[k] = np.minimum(self.least[k], np.repeat(bottom, BLOCK)[: len(own)])
                self.most[k] = np.maximum(self.most[k], np.repeat(top, BLOCK)[: len(own)])
            for b in np.flatnonzero(cut.any(1)):
                at = slice(b * BLOCK, (b + 1) * BLOCK)
                some = np.repeat(cut[b], BLOCK)[: len(q)]
                t = terms[some]
                d2 = _squares(own[at], t[:, 1:4], exact, math.isqrt(r2))
                inside = (d2 <= r2) if exact else (d2 <= r2) & (d2 >= 0)
                self.sums[k, at] += (inside.astype(kind) @ t).astype(np.int64)
                if self.heights:
                    y = q[some, 1]
                    self.least[k, at] = np.minimum(self.least[k, at], np.where(inside, y[None], self.NONE.max).min(1))
                    self.most[k, at] = np.maximum(self.most[k, at], np.where(inside, y[None], self.NONE.min).max(1))

    def end(self) -> list[np.ndarray]:
        out = [self.ids]
        x = self.p
        for k in range(len(self.r2)):
            n, s = self.sums[k, :, 0], self.sums[k, :, 1:4]
            out += [n, *[s[:, i] - n * x[:, i] for i in range(3)]]
            out += [self.sums[k, :, 4 + m] - x[:, i] * s[:, j] - x[:, j] * s[:, i] + n * x[:, i] * x[:, j] for m, (i, j) in enumerate(PRODUCTS)]
            if self.heights:
                out += [self.least[k] - x[:, 1], self.most[k] - x[:, 1]]
        return out


class _Nearest:
    """Counts, sums and products of up to ``most`` nearest points in the radius, nearer ones and smaller ids first."""

    STEPS = (4, 16, 64)

    def __init__(self, r2: int, most: int):
        self.r2, self.most = r2, most

    def begin(self, ids: bytes, places: bytes) -> None:
        self.ids, p = np.frombuffer(ids, np.int64).copy(), _places(places)
        self.origin = (p.min(0) + p.max(0)) // 2
        self.p = p - self.origin
        self.starts, self.low, self.high = _boxes(self.p)
        none = np.zeros(0, np.int64)
        self.kept = [(none, none, none, np.zeros((0, 3), np.int64)) for _ in self.starts]
        self.bound = np.full(len(p), self.r2)
        self.last = np.full(len(p), np.iinfo(np.int64).max)

    def meet(self, ids: bytes, places: bytes) -> None:
        names, q = np.frombuffer(ids, np.int64), _places(places) - self.origin
        _, low, high = _boxes(q)
        exact = _exact(self.p, q)
        kind = np.float64 if exact else np.int64
        near = (np.maximum(np.maximum(low[None] - self.high[:, None], self.low[:, None] - high[None]), 0).astype(float) ** 2).sum(2)
        own, to = self.p.astype(kind), q.astype(kind)
        for b in range(len(self.starts)):
            at = slice(b * BLOCK, (b + 1) * BLOCK)
            order = np.argsort(near[b], kind="stable")
            begin = 0
            for step in (*self.STEPS, len(order)):
                blocks = order[begin : begin + step]
                begin += step
                blocks = blocks[near[b, blocks] <= self.bound[at].max() * (1 + 1e-9) + 1]
                if not len(blocks):
                    break
                some = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                some = some[some < len(q)]
                d2 = _squares(own[at], to[some], exact, math.isqrt(self.r2))
                if not exact:
                    d2 = np.where(d2 < 0, np.iinfo(np.int64).max, d2)
                self._merge(b, at, d2, names[some], q[some])

    def _merge(self, b: int, at: slice, d2: np.ndarray, names: np.ndarray, places: np.ndarray) -> None:
        bound, last = self.bound[at], self.last[at]
        if d2.shape[1] > self.most:
            kth = np.partition(d2, self.most - 1, axis=1)[:, self.most - 1]
            nearer = kth < bound
            bound, last = np.where(nearer, kth, bound), np.where(nearer, np.iinfo(np.int64).max, last)
        row, col = np.nonzero((d2 < bound[:, None]) | ((d2 == bound[:, None]) & (names[None] <= last[:, None])))
        if not len(row):
            return
        new = (row, d2[row, col].astype(np.int64), names[col], places[col])
        both = [np.concatenate(v) for v in zip(self.kept[b], new, strict=True)]
        order = np.lexsort((both[2], both[1], both[0]))
        row = both[0][order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.most]
        self.kept[b] = row, far, name, _ = tuple(v[order] for v in both)
        starts = np.searchsorted(row, np.arange(len(d2) + 1))
        enough = np.flatnonzero(np.diff(starts) >= self.most)
        end = starts[enough] + self.most - 1
        self.bound[at.start + enough], self.last[at.start + enough] = far[end], name[end]

    def end(self) -> list[np.ndarray]:
        sums = []
        for b, (row, _, _, place) in enumerate(self.kept):
            own = self.p[b * BLOCK : (b + 1) * BLOCK]
            terms = _terms(place - own[row])
            made = np.zeros((len(own), 10), np.int64)
            np.add.at(made, row, terms)
            sums.append(made)
        return [self.ids, *np.concatenate(sums).T]


def _run(make: Callable, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        result = lambda: pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in state.end()], names=names)
        for b in batches:
            for near, ids, places in zip(*[b.column(c) for c in ("near", "ids", "places")], strict=True):
                ids, places = (np.frombuffer(v.as_buffer(), np.uint8) for v in (ids, places))
                if near.as_py() == -1:
                    if state:
                        yield result()
                    state = make()
                    state.begin(ids, places)
                else:
                    state.meet(ids, places)
        if state:
            yield result()

    return run


def sum_names(k: int, heights: bool) -> list[str]:
    return [f"n{k}", *[f"s{a}{k}" for a in AXES], *[f"s{AXES[i]}{AXES[j]}{k}" for i, j in PRODUCTS], *([f"low{k}", f"high{k}"] if heights else [])]


def _with_ids(sums: DataFrame, points: DataFrame) -> DataFrame:
    """Ids of their own type, and null where they were."""
    return sums.withColumn("point_id", F.when(F.col("point_id") != NO_ID, F.col("point_id")).cast(points.schema["point_id"].dataType))


def sums_within(points: DataFrame, r2: list[int], core: DataFrame | None = None, heights: bool = True, size: int | None = None) -> DataFrame:
    """``point_id`` and the sums of its neighbours' differences within each squared radius."""
    others = packed(points, size)
    own = others if core is None else packed(core, size)
    names = ["point_id", *[n for k in range(len(r2)) for n in sum_names(k, heights)]]
    rows = _meeting(own, others, max(r2)).select("near", "ids", "places")
    return _with_ids(rows.mapInArrow(_run(lambda: _Sums(list(r2), heights), names), ", ".join(f"{n} long" for n in names)), points if core is None else core)


def sums_of_nearest(points: DataFrame, r2: int, most: int, size: int | None = None) -> DataFrame:
    """``point_id`` and the sums of the differences of up to ``most`` nearest points within the radius, the point itself included."""
    p = packed(points, size)
    names = ["point_id", *sum_names(0, False)]
    rows = _meeting(p, p, r2).select("near", "ids", "places")
    return _with_ids(rows.mapInArrow(_run(lambda: _Nearest(r2, most), names), ", ".join(f"{n} long" for n in names)), points)
