"""Language ID: a bidirectional gated recurrent network over a document's bytes, trained in numpy.

The network reads the UTF-8 bytes of a whole text (A-Z in lower case, all else as it is) forwards and
backwards, labels every byte with probabilities of the languages, and a document's probability is the
mean over all its bytes. Both directions step together: the state ``h`` holds one half for each, and

    a = W[byte] + h U          W has a row for each byte, U a block for each direction
    z, c = (1 + s(a_z)) / 2, s(a_c)          s(x) = x / (1 + |x|)
    h = h + z (c - h)          z is the update gate, c the candidate
    p = softmax(forward h at the byte . V_f + backward h at the byte . V_b + d)

So that memory is bounded and many bytes are labelled at once, a text is run in pieces of ``PIECE``
bytes which begin ``RUN_UP`` bytes before and end ``RUN_UP`` bytes after the bytes that they label: each
direction's state has read at least that much of the text, or all there is, before it labels.

Training: backpropagation through time with Adam, fixed seeds, on a bounded sample: about ``SAMPLE_DOCS``
documents of each language, chosen by a hash of their id and text, read whole, and from all of their bytes
``SAMPLE_PIECES`` stretches drawn at random. Rows with a null ``lang`` or a held-out ``doc_id``, and texts without a
letter, are never learned from.

Defined cases: a null text or one without a letter (Unicode category L) gets ``und`` and score 0; a null
``doc_id`` counts as held out; a table without rows to learn from predicts ``und`` for all, and ``keep_known``
then rejects only what has no letter; equal probabilities go to the language that sorts first; repeated rows are
predicted one by one; other columns are ignored by ``predict`` and kept by ``keep_known``; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, prepare, text_bytes

PIECE = 512
RUN_UP = 64
#: Pieces that run together.
ROWS = 512
#: Documents of each language that are learned from, about.
SAMPLE_DOCS = 100
#: Stretches of the sampled documents in an epoch, and bytes of each.
SAMPLE_PIECES = 12_000
SAMPLE_BYTES = 96
EPOCHS = 3
HIDDEN = 8
FOLDS = 5
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_PAD = 256
_LOWER = np.arange(257, dtype=np.int16)
_LOWER[65:91] += 32


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


def _soft(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place."""
    np.abs(x, out=room)
    room += 1
    x /= room
    return x


class Network:
    """Weights of both directions and of the label layer.

    Columns of ``W`` and ``U``: gates forwards and backwards, candidates forwards and backwards. The row for
    padding shuts both gates, so that a state stays 0 until its text begins.
    """

    NAMES = ("W", "U", "V", "d")

    def __init__(self, languages: list[str], seed: int = 7, hidden: int = HIDDEN):
        g = np.random.default_rng(seed)
        self.languages, self.hidden = list(languages), hidden
        h, n = hidden, len(languages)
        self.W = (g.standard_normal((257, 4 * h)) * 0.7).astype(np.float32)
        self.W[:, : 2 * h] -= 0.7  # gates begin rather shut: memory is long
        self.W[_PAD, : 2 * h] = -1e9
        self.U = (g.standard_normal((2 * h, 4 * h)) * h**-0.5).astype(np.float32)
        self.V, self.d = (g.standard_normal((2 * h, n)) * h**-0.5).astype(np.float32), np.zeros(n, np.float32)
        self.ways = np.tile(np.repeat([True, False], h), 2)  # columns that read forwards
        self.U[self.ways != np.tile(np.repeat([True, False], h), 1)[:, None]] = 0

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        return np.where(self.ways, self.W, 0).astype(self.W.dtype), np.where(self.ways, 0, self.W).astype(self.W.dtype)

    def states(self, ids: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States after each step, time x rows x both halves; at a step the halves are at opposite places of a row."""
        T, B = ids.shape
        k, kind = 2 * self.hidden, self.W.dtype
        ahead, back = self._tables()
        h, out = np.zeros((B, k), kind), np.empty((T, B, k), kind)
        a, b, room = (np.empty((B, 2 * k), kind) for _ in range(3))
        for t in range(T):
            np.take(ahead, ids[t], axis=0, out=a, mode="clip")
            np.take(back, ids[T - 1 - t], axis=0, out=b, mode="clip")
            a += b
            np.matmul(h, self.U, out=b)
            a += b
            _soft(a, room)
            z = a[:, :k] * 0.5
            z += 0.5
            step = a[:, k:] - h
            if trace is not None:
                trace.append((h.copy(), a.copy(), z, step.copy()))
            step *= z
            h += step
            out[t] = h
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Of each place's languages: time x rows x languages."""
        h = self.hidden
        p = states[:, :, :h] @ self.V[:h]
        p += states[::-1, :, h:] @ self.V[h:]
        p += self.d
        p -= p.max(-1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(-1, keepdims=True)
        return p

    def loss_and_gradients(self, ids: np.ndarray, labels: np.ndarray):
        """Mean cross-entropy over the places that aren't padding, and its gradient for each weight."""
        T, B = ids.shape
        h, k = self.hidden, 2 * self.hidden
        trace: list = []
        states = self.states(ids, trace)
        p = self.probabilities(states)
        real = (ids != _PAD)[:, :, None]
        n = max(1, int(real.sum()))
        at = np.broadcast_to(labels[None, :, None], (T, B, 1))
        loss = float(-(np.log(np.maximum(np.take_along_axis(p, at, 2), 1e-12)) * real).sum() / n)
        np.put_along_axis(p, at, np.take_along_axis(p, at, 2) - 1, 2)
        p *= real / p.dtype.type(n)
        flat = p.reshape(-1, p.shape[2])
        dV = np.concatenate([states[:, :, :h].reshape(-1, h).T @ flat, states[::-1, :, h:].reshape(-1, h).T @ flat])
        dd = flat.sum(0)
        dstates = np.concatenate([p @ self.V[:h].T, (p @ self.V[h:].T)[::-1]], axis=2)
        dU, da = np.zeros_like(self.U), np.empty((T, B, 2 * k), p.dtype)
        dh = np.zeros((B, k), p.dtype)
        for t in range(T - 1, -1, -1):
            before, a, z, step = trace[t]
            dh += dstates[t]
            d = da[t]
            np.multiply(dh, step, out=d[:, :k])
            d[:, :k] *= 0.5
            np.multiply(dh, z, out=d[:, k:])
            slope = 1 - np.abs(a)
            slope *= slope
            d *= slope
            dU += before.T @ d
            dh *= 1 - z
            dh += d @ self.U.T
        dU[self.U == 0] = 0
        dW = np.zeros_like(self.W)
        np.add.at(dW, ids.ravel(), np.where(self.ways, da, 0).reshape(-1, 2 * k))
        np.add.at(dW, ids[::-1].ravel(), np.where(self.ways, 0, da).reshape(-1, 2 * k))
        dW[_PAD] = 0
        return loss, dict(zip(self.NAMES, (dW, dU, dV, dd), strict=True))

    def pooled(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each text, which lie one after the other, the mean over its bytes of the languages' probabilities (0 if it is empty)."""
        data, n = _LOWER[data], np.diff(at)
        doc = np.repeat(np.arange(len(n)), -(-n // PIECE))
        first = at[:-1][doc] + PIECE * (np.arange(len(doc)) - np.searchsorted(doc, doc))  # of the bytes that are labelled
        last = np.minimum(first + PIECE, at[1:][doc])
        begin, end = np.maximum(first - RUN_UP, at[:-1][doc]), np.minimum(last + RUN_UP, at[1:][doc])
        order = np.argsort(end - begin, kind="stable")
        sums = np.zeros((len(n), len(self.languages)))
        for k in range(0, len(order), ROWS):
            some = order[k : k + ROWS]
            T = int((end - begin)[some].max())
            place = begin[some] + np.arange(T)[:, None]
            inside = place < end[some]
            ids = np.where(inside, data[np.minimum(place, len(data) - 1)], _PAD).astype(np.intp)
            p = self.probabilities(self.states(ids))
            p *= ((place >= first[some]) & (place < last[some]))[:, :, None]
            np.add.at(sums, doc[some], p.sum(0, dtype=np.float64))
        return sums / np.maximum(n, 1)[:, None]

    def predict(self, texts: pa.Array) -> list[tuple[str, float]]:
        """Language and score of each text."""
        known = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
        some = texts.filter(pa.array(known))
        out = [(UNKNOWN, 0.0)] * len(texts)
        if len(some):
            p = self.pooled(*text_bytes(some))
            for i, k, v in zip(np.flatnonzero(known).tolist(), p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                out[i] = self.languages[k], min(1.0, v)
        return out


def pieces_of(texts: list[bytes], labels: list[int], g: np.random.Generator, count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``size`` bytes drawn over all bytes of the texts (time x rows, shorter texts padded), and their labels."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    at = np.cumsum(lengths) - lengths
    # languages in turn, so that a language of short texts is learned as well
    y = np.array(labels, np.int64)
    doc = np.zeros(count, np.int64)
    kinds = np.unique(y)
    for j, kind in enumerate(kinds.tolist()):
        own = np.flatnonzero(y == kind)
        turn = np.arange(j, count, len(kinds))
        doc[turn] = g.choice(own, len(turn), p=lengths[own] / lengths[own].sum())
    start = (g.random(count) * np.maximum(lengths[doc] - size + 1, 1)).astype(np.int64)
    place = start + np.arange(size)[:, None]
    inside = place < lengths[doc]
    return np.where(inside, data[np.minimum(at[doc] + place, len(data) - 1)], _PAD).astype(np.intp), y[doc]


def train(texts: list[bytes], labels: list[int], languages: list[str], epochs: int = EPOCHS, pieces: int = SAMPLE_PIECES, rows: int = 96, rate: float = 0.02, seed: int = 7) -> Network:
    net = Network(languages, seed)
    g = np.random.default_rng(seed)
    first = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    second = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    step, total = 0, epochs * -(-pieces // rows)
    for _ in range(epochs):
        ids, y = pieces_of(texts, labels, g, pieces, SAMPLE_BYTES)
        order = g.permutation(pieces)
        for a in range(0, pieces, rows):
            some = order[a : a + rows]
            _, grads = net.loss_and_gradients(ids[:, some], y[some])
            norm = np.sqrt(sum(float((d * d).sum()) for d in grads.values()))
            clip = min(1.0, 1.0 / max(norm, 1e-9))
            step += 1
            now = rate * (1 - 0.95 * step / total)
            for k, d in grads.items():
                d = d * clip
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.001 * (d * d - second[k])
                w = getattr(net, k)
                w -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """The network learned from about ``sample_docs`` documents of each language; None if nothing can be learned from."""
    rows = docs.select("doc_id", F.col(text).alias("text"), "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not counts:
        return None
    steps = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, sample_docs / n) * steps))])
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(steps)) < share[F.col("lang")])
    got = sorted((r.lang, r.text.encode()) for r in chosen.select("lang", "text").collect())
    if not got:
        return None
    languages = sorted({lang for lang, _ in got})
    return train([t for _, t in got], [languages.index(lang) for lang, _ in got], languages)


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row."""
    prepare(docs.sparkSession)
    source = docs.select("doc_id", held_out().alias("held_out"), F.col(text).alias("text"))
    if net is None:
        return source.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = net.predict(b.column(2))
        return pa.record_batch([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(source, run, "doc_id bigint, held_out boolean, lang_pred string, score double")


#: Documents whose best language has less than this mean probability are rejected.
LEAST_SCORE = 0.3


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows, with all their columns, whose text has a recognised language; a letter is enough where no row says its language."""
    net = fit(docs)
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    prepare(docs.sparkSession)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in net.predict(b.column(where))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
