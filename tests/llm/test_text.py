import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from cairn.llm import decontaminate, language, licenses, line_dedup, quality
from cairn.llm.common import WORDS, WorkTables, ascii_lower, words_of

from .conftest import lines, prose


def test_ascii_lower():
    assert ascii_lower("ABC É İ Σ") == "abc É İ Σ"


# quality rules


def brute_quality(text):
    text = text or ""
    w = WORDS.findall(text)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_measures(awkward, empty):
    rows = quality.judge(awkward).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((r.doc_id, *brute_quality(r.text)) for r in awkward.collect())
    assert all(not r.kept for r in rows if r.base_failed)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert quality.judge(empty).count() == 0


def test_quality_is_native(awkward):
    plan = quality.judge(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("Physical Plan")[1].replace("Exchange RoundRobin", "").replace("REPARTITION", "")


def test_quality_agrees_with_labels(spark, data):
    from cairn.llm import queries

    docs = queries.documents(spark, data)
    rows = quality.judge(docs).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    assert not any(r.kept for r in rows if r.quality == 0)


# licenses


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base(awkward, empty):
    rows = licenses.scan_licenses(awkward).collect()
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    assert got == Counter((r.doc_id, *brute_base(r.text)) for r in awkward.collect())
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MIT", (1.0, {"mit"})),
        ("(MIT OR Apache-2.0) AND BSD-3-Clause", (1.0, {"mit", "apache-2.0", "bsd-3-clause"})),
        ("Nothing-1.0 AND MIT", (0.5, {"nothing-1.0", "mit"})),
        ("Nothing-1.0 OR MIT", (1.0, {"nothing-1.0", "mit"})),
        ("GPL-2.0-only WITH Classpath-exception-2.0", (1.0, {"gpl-2.0-only with classpath-exception-2.0"})),
        ("MIT OR", None), ("( MIT", None), ("OR MIT", None), ("MIT )", None), ("", None),
    ],
)
def test_license_expressions(text, want):
    assert licenses.evaluate(licenses.tokens_of(text)) == want


def test_license_binding():
    assert licenses.postfix("mit or isc and zlib".split()) == ["mit", "isc", "zlib", "and", "or"]
    assert licenses.expression_at(" MIT and then some prose") == (0.5, {"mit", "then"})


@pytest.mark.parametrize("line, want", [(" MIT)", {"mit"}), (" MIT OR", {"mit"}), (" (MIT OR ISC) AND (", {"mit", "isc"}), (" MIT OR (ISC AND", {"mit"}), (" )", None), (" OR MIT", None), (" MIT ISC", {"mit"})])
def test_license_longest_prefix(line, want):
    found = licenses.expression_at(line)
    assert (found and found[1]) == want


def test_license_many_places():
    text = "under the mit license " * 20_000 + "cc by nc"
    found = licenses.scan(text)
    assert found[:4] == (80_003, 20_001, 0, 80_000) and found[4] == "cc-by-nc,mit"


def test_license_tags_and_overlaps():
    got = licenses.scan("// SPDX-License-Identifier: MIT OR Apache-2.0\nunder the MIT license under the mit license version 2")
    assert got[1] == 2 and got[5] == "apache-2.0,mit"
    assert licenses.scan("cc by nc by nc")[1] == 1
    assert licenses.scan("under the gnu general public license")[4:6] == ("", "gpl")


# line dedup


def brute_lines(rows):
    first = {}
    order = lambda d: (d is not None, d or 0)
    key = lambda x: x.encode().lower().strip(b" \t\n\v\f\r").decode()
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = key(x)
            if len(k) >= 10 and (k not in first or order(d) < order(first[k])):
                first[k] = d
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if len(key(x)) < 10 or first[key(x)] == d]
        out.append((d, len(ls), len(ls) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup(awkward, empty, work, spark):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert Counter(map(tuple, line_dedup.digest(awkward, work).collect())) == brute_lines(rows)
    assert line_dedup.digest(empty, WorkTables(spark, "t")).count() == 0
    kept = line_dedup.apply(awkward, WorkTables(spark, "t"))
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert line_dedup.apply(empty, WorkTables(spark, "t")).count() == 0


def test_line_dedup_clashing_columns(spark, work):
    """Columns of the input may have the names that the steps use inside."""
    line = "a line that two documents hold\nand one of them more"
    names = ["doc_id", "text", "__keep", "__last", "__doc", "__row", "row", "last", "keep", "doc", "own", "own_row", "text_row", "rest", "c0", "n_chars"]
    rows = [(i, t, *[f"v{i}"] * 13, len(t or "")) for i, t in ((1, line), (2, line + "\nlast"), (3, None), (None, "x"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in names[2:15]) + ", n_chars int")
    out = line_dedup.apply(df, work)
    assert out.columns == names and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == line and got[2].text == "last" and got[2].n_chars == 4 and got[3].text is None and got[3].n_chars == 0
    assert all(tuple(r)[2:15] == tuple(rows[[x[0] for x in rows].index(k)])[2:15] for k, r in got.items())


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_line_dedup_hot_line_over_partitions(spark, parts):
    rows = [(i, f"a very common line indeed\nline of document {i} alone\nshort\n a VERY common line indeed") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert Counter(map(tuple, line_dedup.digest(df, WorkTables(spark, "t")).collect())) == brute_lines(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bitmaps(spark, awkward):
    rows = line_dedup.keep_bitmaps(awkward, WorkTables(spark, "t")).collect()
    texts = {r.doc_id: r.text for r in awkward.collect()}
    for r in rows:
        n, gone, _ = line_dedup.lines_kept((texts[r.doc_id] or "").encode(), r.keep, r.last_dropped)
        assert gone == r.n_dropped <= n


# decontamination


def brute_leaks(docs, items):
    out = []
    for d, t in docs:
        w = words_of(t)
        for i, it in items:
            q = words_of(it)
            if not q:
                continue
            k = min(5, len(q))
            a, b = ({tuple(x[j : j + k]) for j in range(len(x) - k + 1)} for x in (q, w))
            if len(a & b) >= 0.75 * len(a):
                out.append((d, i, len(a & b), len(a)))
    return Counter(out)


def test_decontamination(spark, awkward, empty):
    shared = prose(70, 2)
    half = shared[:20] + prose(30, 99)
    most = shared[:40] + ["other"] + shared[41:60]
    items = [(1, " ".join(shared)), (1, " ".join(shared)), (2, " ".join(half)), (3, " ".join(most)), (4, None), (5, ""), (6, "one"), (7, "SAME line"), (None, " ".join(shared[10:40]).upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.matches(awkward, bench).collect())
    assert got == brute_leaks([(r.doc_id, r.text) for r in awkward.collect()], items)
    left = decontaminate.drop_contaminated(awkward, bench)
    assert left.columns == awkward.columns
    assert {r.doc_id for r in left.collect()}.isdisjoint({k[0] for k in got} - {None})
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(awkward, bench.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, awkward, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(prose(70, 2)[i : i + 30])) for i in range(20)], "item_id bigint, text string")
    whole = Counter(map(tuple, decontaminate.matches(awkward, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    assert Counter(map(tuple, decontaminate.matches(awkward, bench).collect())) == whole and whole


def test_sketch_loses_nothing():
    for n in range(1, 400):
        s = decontaminate.sketch_size(n)
        assert s >= min(n, n - -(-75 * n // 100) + 1)


# language


def test_gradients():
    net = language.Network(["a", "b", "c"], 3, 4)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    ids = np.full((6, 3), 256, np.intp)
    for i, t in enumerate((b"abcab", b"hellos", b"x")):
        ids[: len(t), i] = list(t)
    y = np.array([0, 1, 2])
    _, grads = net.loss_and_gradients(ids, y)
    g = np.random.default_rng(0)
    for k in net.NAMES:
        w = getattr(net, k)
        for _ in range(12):
            at = tuple(int(g.integers(0, s)) for s in w.shape)
            if k == "W":
                at = (int(g.choice(list(b"abhelo"))), at[1])
            if k == "U" and w[at] == 0:
                assert grads[k][at] == 0
                continue
            old = w[at]
            w[at] = old + 1e-5
            up = net.loss_and_gradients(ids, y)[0]
            w[at] = old - 1e-5
            down = net.loss_and_gradients(ids, y)[0]
            w[at] = old
            assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-6, k


def labelled_in_one_run(net, raw):
    """The network over a whole text at once, step by step in both directions."""
    h, ahead, back = net.hidden, np.zeros(net.hidden), np.zeros(net.hidden)
    low = [b + 32 if 65 <= b < 91 else b for b in raw]
    W, U = net.W.astype(float), net.U.astype(float)
    soft = lambda x: x / (1 + np.abs(x))

    def run(h0, some, way):
        z0, c0 = (0, 2 * h) if way else (h, 3 * h)
        rows = slice(0, h) if way else slice(h, 2 * h)
        out = []
        for b in some:
            z = 0.5 + 0.5 * soft(W[b, z0 : z0 + h] + h0 @ U[rows, z0 : z0 + h])
            c = soft(W[b, c0 : c0 + h] + h0 @ U[rows, c0 : c0 + h])
            h0 = h0 + z * (c - h0)
            out.append(h0)
        return np.array(out)

    f, b = run(ahead, low, True), run(back, low[::-1], False)[::-1]
    p = np.exp(f @ net.V[:h] + b @ net.V[h:] + net.d)
    return (p / p.sum(1, keepdims=True)).mean(0)


def test_network_reads_whole_texts(monkeypatch):
    """Pooled probabilities are those of one run over each text, but for what a state forgets within the run-up."""
    net = language.Network(["a", "b", "c"], 5)
    texts = [lines(prose(n, n)).encode() for n in (3, 40, 400)] + [b"x", "é\U0001f642 ABC".encode()]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = np.array([labelled_in_one_run(net, t) for t in texts])
    assert len(texts[2]) > 4 * language.PIECE
    assert np.abs(net.pooled(data, at) - want).max() < 1e-3
    monkeypatch.setattr(language, "PIECE", 1 << 20)
    assert np.abs(net.pooled(data, at) - want).max() < 1e-5


def test_language_accuracy(spark):
    from cairn.llm import queries

    docs = queries.documents(spark, "/root/testdata/sf0.01")
    made = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(made) > 100
    assert sum(r.lang == r.lang_pred for r in made) >= 0.97 * len(made)
    assert all(0 <= r.score <= 1 for r in made)


def test_language_edges(spark, awkward, empty):
    net = language.fit(awkward)
    rows = language.predict(awkward, net).collect()
    letters = {r.doc_id: bool(regex.search(r"\p{L}", r.text or "")) for r in awkward.collect() if r.doc_id is not None}
    assert all((r.lang_pred != "und") == letters[r.doc_id] for r in rows if r.doc_id is not None)
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language.fit(empty) is None
    assert language.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language.predict(awkward, None).collect()} == {"und"}
    kept = language.keep_known(awkward)
    assert kept.columns == awkward.columns and 15 not in {r.doc_id for r in kept.collect()}
    assert language.keep_known(empty).count() == 0


def test_language_numerals_are_no_letters(spark):
    net = language.Network(["a", "b"], 1)
    got = net.predict(pa.array(["½ ²", "Ⅷ", "½ a", None, "", "日"]))
    assert [x[0] == "und" for x in got] == [True, True, False, True, True, False]


def test_language_without_labels(spark, awkward):
    """Where no row says its language, nothing is recognised and only texts without a letter go."""
    docs = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert language.fit(docs) is None
    ids = {r.doc_id for r in language.keep_known(docs).collect()}
    assert {4, 5, 6, 14, 16} <= ids and ids.isdisjoint({1, 2, 3, 15})


def test_language_is_the_same_whatever_the_batch():
    net = language.Network(["a", "b"], 1)
    texts = [lines(prose(60 + 90 * k, k)) for k in range(6)]
    a = net.predict(pa.array(texts))
    b = [net.predict(pa.array([t]))[0] for t in texts]
    assert [x[0] for x in a] == [x[0] for x in b]
    assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-6)
