import random
import time
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from cairn.llm import jaccard_join, substrings
from cairn.llm.common import WorkTables, likely_in, shingle_hashes, words_of
from cairn.llm.components import components

from .conftest import SCHEMA, lines, prose


def brute_components(rows):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets[d] = frozenset(shingle_hashes(words_of(t)).tolist())
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def check_join(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, WorkTables(spark, "t")).collect()}
    assert got == brute_components(rows)


def mutated(words, k, seed):
    r, out = random.Random(seed), list(words)
    for _ in range(k):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return out


def test_join_edges(spark, awkward, empty, work):
    rows = jaccard_join.join(awkward, work).collect()
    want = brute_components([(r.doc_id, r.text) for r in awkward.collect()])
    assert len(rows) == awkward.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert jaccard_join.join(empty, WorkTables(spark, "t")).count() == 0


def test_join_near_copies_and_borders(spark):
    rows, k = [], 0
    for g in range(12):
        base = prose(40 + 17 * g, g)
        for m in range(8):
            rows.append((k, lines(mutated(base, m, 100 * g + m))))
            k += 1
    rows += [(k + i, " ".join(prose(n, 1))) for i, n in enumerate(range(1, 30))]
    check_join(spark, rows)


def test_join_hot_passage_and_chain(spark):
    hot = prose(60, 77)
    rows = [(i, lines(hot + prose(15 + i % 25, 1000 + i))) for i in range(150)]
    chain = prose(200, 5)
    rows += [(1000 + i, " ".join(chain[4 * i : 4 * i + 100])) for i in range(25)]
    check_join(spark, rows, 7)


def test_join_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_BYTES", 8_000)
    base = prose(120, 9)
    rows = [(i, lines(mutated(base, i % 7, i))) for i in range(80)]
    # a chain of growing texts crosses the size classes
    check_join(spark, rows + [(100 + i, lines(base[: 60 + 3 * i])) for i in range(20)])


def test_frequent_passage_needs_no_trie(monkeypatch):
    g = np.random.default_rng(4)
    hot = np.arange(20, dtype=np.uint64)
    sets = [np.concatenate([hot, np.sort(g.choice(1 << 40, 30, replace=False)).astype(np.uint64) + np.uint64(100)]) for _ in range(300)]
    sets += [np.append(s[:-1], np.uint64(1 << 50)) for s in sets[:5]]
    added = []
    add = jaccard_join.Trie.add
    monkeypatch.setattr(jaccard_join.Trie, "add", lambda self, me, ranks: (added.append(me), add(self, me, ranks))[1])
    assert jaccard_join.link(sets) == [*range(300), *range(5)]
    assert len(added) == 10
    chunk = [i % 2 == 0 for i in range(305)]
    found = jaccard_join.link(sets, chunk, [not c for c in chunk])
    assert found == [*range(300), *[i if chunk[i] == chunk[i - 300] else i - 300 for i in range(300, 305)]]


def test_large_groups_fall_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_BYTES", 8_000)
    sizes, in_chunks = [], jaccard_join._in_chunks
    monkeypatch.setattr(jaccard_join, "_in_chunks", lambda sets: (sizes.extend(r["count"] for r in sets.groupBy("group").count().collect()), in_chunks(sets))[1])
    hot = prose(16, 78)
    rows = [(i, lines(hot + prose(24, 2000 + i))) for i in range(200)]
    rows += [(500 + i, lines(mutated((hot + prose(24, 2000 + i)), 1, i))) for i in range(20)]
    check_join(spark, rows)
    assert sizes and max(sizes) <= 5


def test_size_classes_are_neighbours():
    n = np.arange(1, 20_000)
    cls = np.floor(np.log(n) / np.log(jaccard_join.STEP))
    assert (np.abs(cls - np.floor(np.log(jaccard_join.least_overlap(n)) / np.log(jaccard_join.STEP))) <= 1).all()


def test_join_repeated_ids(spark):
    base, other = prose(60, 31), prose(60, 32)
    rows = [(1, lines(base)), (2, lines([*base, "q"])), (2, lines(other)), (3, lines([*other, "q"])), (5, lines(prose(60, 33))), (5, lines([*base, "q"])), (6, lines(prose(60, 34))), (6, lines(prose(60, 34)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = jaccard_join.join(df, WorkTables(spark, "t")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((d, len(set(shingle_hashes(words_of(t)).tolist())), 6 if d == 6 else 1) for d, t in rows)
    kept = jaccard_join.keep_first(df, WorkTables(spark, "t")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({(d, t) for d, t in rows if d in (1, 6)})


def test_join_null_id_ahead(spark):
    base = prose(120, 21)
    rows = [(None, lines(base)), (1, lines(base)), (2, lines(mutated(base, 2, 8)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(df, WorkTables(spark, "t")).collect()}
    assert got == {None: None, 1: 1, 2: 1}


def test_trie_against_all_pairs():
    g = np.random.default_rng(2)
    sets = [np.unique(g.choice(60, g.integers(3, 25))).astype(np.uint64) for _ in range(150)]
    for percent in (50, 75):
        found = jaccard_join.link(sets, percent=percent)
        root = list(range(len(sets)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        assert [find(i) for i in range(len(sets))] == found


def test_near_copies_walk_together(monkeypatch):
    g, sets = np.random.default_rng(6), []
    for i in range(600):
        one = np.arange(120, dtype=np.uint64)
        at = g.choice(120, g.integers(2, 30), replace=False)
        one[at] = np.uint64(1000 + 200 * i) + at.astype(np.uint64)
        sets.append(np.sort(one[g.integers(0, 20) :]))
    has = np.zeros((600, 1000 + 200 * 601), np.float32)
    for i, s in enumerate(sets):
        has[i, s.astype(np.int64)] = 1
    common = has @ has.T
    sizes = has.sum(axis=1)
    joined = 100 * common >= 75 * (sizes[:, None] + sizes - common)
    root = np.arange(600)
    while not np.array_equal(root, after := np.where(joined, root, 600).min(axis=1)):
        root = after
    asked, find = [], jaccard_join.Trie.find
    monkeypatch.setattr(jaccard_join.Trie, "find", lambda self, i: (asked.append(i), find(self, i))[1])
    assert jaccard_join.link(sets) == root.tolist() and 20 < len(set(root.tolist())) < 580
    assert len(asked) < 60 * len(sets)


def test_prefix_bounds():
    for n in range(1, 300):
        for m in range(jaccard_join.least_overlap(n), n + 1):
            o = -(-75 * (n + m) // 175)  # smallest overlap of linked sets
            a, b = jaccard_join.prefix_length(n), jaccard_join.prefix_length(m)
            guaranteed = min(a - (n - o), b - (m - o))
            assert guaranteed >= min(jaccard_join.needed(n), jaccard_join.needed(m)) or a == n or b == m


def test_keep_first(spark, awkward, work):
    kept = jaccard_join.keep_first(awkward, work)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 6 in ids and 7 not in ids and 8 not in ids and ids.count(None) == 2


def test_components(spark, work):
    r = random.Random(4)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(3000, 2000 + i) for i in range(700)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "u bigint, v bigint"), work, "c").collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u bigint, v bigint"), WorkTables(spark, "t"), "c").count() == 0


def test_likely_in(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    ids = spark.range(0, 5000, 7)
    got = {r.k for r in likely_in(df, "k", ids).collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 800


# substrings


def brute_tree(v, a, b, length):
    if b - a + 1 < length:
        return []
    m = a + int(np.argmin(v[a : b + 1]))
    return [(a, m, b), *brute_tree(v, a, m - 1, length), *brute_tree(v, m + 1, b, length)]


def test_compact_windows():
    v = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    got = sorted(zip(*(x.tolist() for x in substrings.compact_windows(v, np.array([0, 150, 495]), np.array([150, 495, 500]), 20)), strict=True))
    assert got == sorted(brute_tree(v, 0, 149, 20) + brute_tree(v, 150, 494, 20))


def test_compact_windows_of_equal_values():
    """Equal values, whose trees are chains, take no step for each of them."""
    n = 60_000
    began = time.process_time()
    got = substrings.compact_windows(np.full(n, 1 << 40, np.uint64), np.array([0]), np.array([n]), 46)
    assert time.process_time() - began < 1
    lo, c, hi = (x[np.argsort(got[1])] for x in got)
    assert (c == np.arange(n - 45)).all() and (lo == c).all() and (hi == n - 1).all()


def test_matching_starts_of_repeats():
    """Passages with repeated shingles are compared as sets, place by place as Python's sets say."""
    r, n = np.random.default_rng(3), substrings.LENGTH
    x = r.integers(1, 40, (60, 2 * n - 1)).astype(np.uint64)
    y = np.where(r.random(x.shape) < 0.1, np.uint64(99), np.roll(x, 3, axis=1))
    first, last, best, there = substrings.matching_starts(x, y)
    some = 0
    for k in range(len(x)):
        p, q = ([set(v[i : i + n].tolist()) for i in range(n)] for v in (x[k], y[k]))
        similar = np.array([[len(a & b) / len(a | b) for b in q] for a in p])
        found = np.flatnonzero((similar >= 0.75).any(axis=0))
        assert (first[k], last[k]) == ((found[0], found[-1]) if len(found) else (-1, -1))
        if len(found):
            some += 1
            assert best[k] == similar[:, found].max() and similar[there[k], found[0]] == similar[:, found[0]].max()
    assert some > 20


def planted(seed=1, n=60):
    """Documents of which some share passages of 55 to 90 words, at any place, some with an edit."""
    r = random.Random(seed)
    rows, where = [], defaultdict(list)
    passages = [prose(r.randint(55, 90), 500 + k) for k in range(8)]
    for i in range(n):
        words = prose(r.randint(60, 400), 10_000 + i)
        if i % 2 == 0:
            k = r.randrange(len(passages))
            p = list(passages[k])
            if i % 8 == 0:
                p[r.randrange(len(p))] = "edited"
            at = r.randrange(len(words))
            words = words[:at] + p + words[at:]
            where[k].append(i)
        rows.append((i, lines(words)))
    return rows, where


@pytest.mark.parametrize("parts", [2, 9])
def test_substrings_planted(spark, parts):
    rows, where = planted()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = substrings.passages(df, WorkTables(spark, "t")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    flagged = {r.doc_id for r in found} | {r.match_id for r in found}
    wanted = {d for ds in where.values() if len(ds) > 1 for d in ds}
    assert wanted <= flagged
    assert all(d % 2 == 0 for d in flagged)
    words = {d: words_of(t) for d, t in rows}
    for r in found:
        assert 50 <= r.end_word - r.start_word and r.end_word <= len(words[r.doc_id]) and r.similarity >= 0.75


def test_substrings_edges(spark, awkward, empty, work):
    found = substrings.passages(awkward, work).collect()
    pairs = {frozenset((r.doc_id, r.match_id)) for r in found}
    assert frozenset((6, 7)) in pairs and frozenset((9, 10)) in pairs
    assert any(8 in p and (6 in p or 7 in p) for p in pairs)
    assert all(r.doc_id is not None and r.match_id is not None and r.doc_id != r.match_id for r in found)
    assert substrings.passages(empty, WorkTables(spark, "t")).count() == 0


def test_verify_insertion():
    g = np.random.default_rng(5)
    t = g.integers(1, 1 << 31, 200).astype(np.uint32)
    x = t[10 : 10 + 2 * substrings.LENGTH - 1]
    y = np.concatenate([x[:40], [7, 8, 9], x[40:-3]]).astype(np.uint32)
    z = t[::-1][: len(x)]
    first, last, best = substrings.verify_all(np.stack([x, x, x]), np.stack([x, y, z]))
    assert first[0] == 0 and last[0] == substrings.LENGTH - 1 and best[0] == 1.0
    assert first[1] >= 0 and 0.75 <= best[1] < 1 and first[2] == last[2] == -1


def around_anchor(h, c):
    row = np.zeros(2 * substrings.LENGTH - 1, np.uint32)
    substrings._place(row, h.astype(np.uint32), 0, c)
    return row


def brute_match(a, b, ca, cb):
    n = substrings.LENGTH
    near = lambda h, c: [set(h[s : s + n].tolist()) for s in range(max(0, c - n + 1), min(c, len(h) - n) + 1)]
    return max((len(p & q) / len(p | q) for p in near(a, ca) for q in near(b, cb)), default=0.0)


@pytest.mark.parametrize("size", range(50, 56))
def test_verify_edited_short_documents(size):
    """One word put in or left out of a document with room for few starts, against all pairs of passages."""
    r, lost, wanted = random.Random(size), 0, 0
    for trial in range(60):
        words = prose(size, 40_000 + 100 * size + trial)
        at = r.randrange(1, size)
        other = words[:at] + ["added"] + words[at:] if trial % 2 or size == 50 else words[:at] + words[at + 1 :]
        a, b = (shingle_hashes(words_of(lines(w))).astype(np.uint32) for w in (words, other))
        ca = r.choice([i for i, v in enumerate(a.tolist()) if v in set(b.tolist())])
        cb = b.tolist().index(a[ca])
        best = brute_match(a, b, ca, cb)
        first, _, got = substrings.verify_all(around_anchor(a, ca)[None], around_anchor(b, cb)[None])
        if best >= 0.75:
            wanted += 1
            lost += first[0] < 0
            assert first[0] < 0 or got[0] <= best + 1e-9
        else:
            assert first[0] == -1
    assert wanted > 30 and lost == 0


def test_substrings_exact_around_hot_phrase(spark):
    """Each repeated run of 50 words is covered, though many documents hold a shorter phrase of it."""
    rows, pairs = [], []
    for g in range(12):
        phrase = prose(42, 60_000 + g)
        before, after = prose(4, 61_000 + g), prose(4, 62_000 + g)
        for m in range(40):
            inside = before + phrase + after if m in (17, 33) else phrase
            i = 100 * g + m
            rows.append((i, lines(prose(40 + m, 63_000 + i) + inside + prose(45, 73_000 + i))))
        pairs.append((100 * g + 17, 100 * g + 33))
    random.Random(3).shuffle(rows)
    found = substrings.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), WorkTables(spark, "t")).collect()
    words = {d: words_of(t) for d, t in rows}
    by = defaultdict(list)
    for r in found:
        by[frozenset((r.doc_id, r.match_id))].append(r)
    for a, b in pairs:
        rs = by[frozenset((a, b))]
        assert len(rs) == 1 and rs[0].similarity == 1.0
        start = 40 + rs[0].doc_id % 100
        assert rs[0].start_word <= start and rs[0].end_word >= start + 50
        assert words[a][57:107] == words[b][73:123]


def test_runs_of():
    g = np.random.default_rng(9)
    h = g.integers(0, 1 << 63, 150).astype(np.uint64)
    h[90:140] = h[10:60]
    run, low = substrings.runs_of(h)
    assert len(run) == 150 - substrings.LENGTH + 1 and len(set(run.tolist())) == len(run) - 5
    assert (run[90:95] == run[10:15]).all()
    assert low.tolist() == [int(substrings.mixed(h[s : s + substrings.LENGTH], 0).min()) for s in range(len(run))]


def brute_passages(rows):
    """For each two documents whether passages of both are alike, by the sets of all their runs of LENGTH shingles."""
    n, sets = substrings.LENGTH, {}
    every = {v: i for i, v in enumerate(sorted({x for _, t in rows for x in shingle_hashes(words_of(t)).tolist()}))}
    for d, t in rows:
        h = [every[x] for x in shingle_hashes(words_of(t)).tolist()]
        if len(h) >= n:
            sets[d] = [frozenset(h[s : s + n]) for s in range(len(h) - n + 1)]
    everything = {d: frozenset().union(*s) for d, s in sets.items()}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and len(everything[a] & everything[b]) >= n // 2:
                common = everything[a] & everything[b]
                some = [p for p in sets[a] if len(p & common) >= n // 2]
                if any(100 * len(p & q) >= 75 * len(p | q) for p in some for q in sets[b]):
                    out.add((a, b))
    return out


def test_aligned():
    """The bound by places is at most the similarity of the sets, and equal to it where nothing repeats."""
    g = np.random.default_rng(3)
    n = substrings.LENGTH
    lengths = np.array([140, 60, n, 20])
    x = g.integers(0, 25, lengths.sum()).astype(np.uint64)
    x[:140] = np.arange(140) + 100
    x[150:190] = 7
    y = x.copy()
    y[[5, 70, 71, 72, 160, 205]] = 99
    got = substrings.aligned(x, y, lengths)
    edge = 0
    for size in lengths.tolist():
        for s in range(size):
            p, q = (set(v[edge + s : edge + s + n].tolist()) for v in (x, y))
            similar = len(p & q) / len(p | q)
            if s + n > size:
                assert got[edge + s] == 0
            else:
                assert got[edge + s] <= similar + 1e-9
                if len(p) == len(q) == n:
                    assert got[edge + s] == pytest.approx(similar if similar >= 0.75 else 0)
        edge += size
    assert (got > 0).sum() > 50
    assert substrings.distinct_counts(x[:200], np.repeat([0, 1], [140, 60]))[[0, 140]].tolist() == [n, len(set(x[140 : 140 + n].tolist()))]


def test_substrings_recall(spark):
    """Near repeats, some around phrases that many documents hold, against all passages of all documents."""
    r, rows = random.Random(17), []
    for g in range(6):
        phrase = prose(30, 90_000 + g)
        passages = [prose(12, 91_000 + 10 * g + k) + phrase + prose(14, 92_000 + 10 * g + k) for k in range(3)]
        for m in range(24):
            i = 100 * g + m
            inside = list(passages[m % 3]) if m < 12 else phrase
            if m < 12 and m % 2:
                inside[r.randrange(len(inside))] = "edited"
            if m < 12 and m % 4 == 3:
                inside.insert(r.randrange(10), "added")
            rows.append((i, lines(prose(r.randint(20, 60), 93_000 + i) + inside + prose(r.randint(20, 60), 94_000 + i))))
    wanted = brute_passages(rows)
    found = substrings.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), WorkTables(spark, "t")).collect()
    got = {(min(x.doc_id, x.match_id), max(x.doc_id, x.match_id)) for x in found}
    assert len(wanted) > 80 and got <= wanted
    # a link counts if the documents are joined, directly or through others
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(a)] = find(b)
    linked = sum(find(a) == find(b) for a, b in wanted) / len(wanted)
    alone = {d for p in wanted for d in p}
    assert linked >= 0.9 and len({d for p in got for d in p}) >= 0.95 * len(alone)


def test_substrings_lose_no_near_pair(spark):
    r = random.Random(11)
    words = lambda n: [f"{r.choice('abcdefgh')}{r.randrange(10**5)}" for _ in range(n)]
    rows = []
    for i in range(120):
        one = words(50)
        two = list(one)
        two[r.randrange(8, 42)] = "edited"  # 41 of 46 shingles are shared, 0.80
        more = r.choice((0, 30))
        rows += [(2 * i, " ".join(words(more) + one + words(more))), (2 * i + 1, " ".join(words(more) + two + words(more)))]
    found = substrings.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), WorkTables(spark, "t")).collect()
    assert {tuple(sorted((x.doc_id, x.match_id))) for x in found} == {(2 * i, 2 * i + 1) for i in range(120)}


def test_matching_passages_share_a_seed():
    g, n, count = np.random.default_rng(0), substrings.LENGTH, 0
    for trial in range(60):
        most = (10**6, 30, 12)[trial % 3]
        x = g.integers(1, most, 70).astype(np.uint64)
        if trial % 3 == 2:
            x = np.repeat(x, g.integers(1, 20, 70))[:90]
        y = x.copy()
        for _ in range(g.integers(0, 8)):
            y[g.integers(0, len(y))] = 10**7 + g.integers(0, 5)
        y = np.concatenate([g.integers(10**8, 10**9, 30).astype(np.uint64), y[g.integers(0, 20) :]])
        px, py = substrings.open_passages(x, np.isin(x, y)), substrings.open_passages(y, np.isin(y, x))
        for i in range(len(x) - n + 1):
            a = set(x[i : i + n].tolist())
            seeds = {int(x[p]) for p in px if i <= p < i + n}
            for j in range(len(y) - n + 1):
                b = set(y[j : j + n].tolist())
                if 100 * len(a & b) >= 75 * len(a | b):
                    count += 1
                    assert seeds & {int(y[p]) for p in py if j <= p < j + n}
    assert count > 1000


def test_substrings_compare_a_common_phrase_without_rows_for_pairs(spark):
    """Documents around a phrase too short to link are compared where they meet; rows are the matches that join components."""
    r = random.Random(23)
    words = lambda n: [f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n)]
    phrase, rows = words(41), []
    for i in range(60):
        before, after = words(30), words(30)
        rows.append((10 * i, " ".join(before + phrase + after)))
        if i % 6 == 0:
            phrase_of_two = list(phrase)
            phrase_of_two[20] = "edited"
            rows.append((10 * i + 1, " ".join(words(30) + before[-4:] + phrase_of_two + after[:5] + words(30))))
    sizes = {}

    class Sized(WorkTables):
        def keep(self, df, name, partition_by=None):
            kept = super().keep(df, name, partition_by)
            sizes[name] = kept.count()
            return kept

    found = substrings.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), Sized(spark, "t")).collect()
    assert {(min(x.doc_id, x.match_id), max(x.doc_id, x.match_id)) for x in found} <= brute_passages(rows)
    # ten documents match another each, by at most twelve seeds; the phrase alone makes 1,770 pairs
    assert sizes["across"] <= 120 and sizes["around-across"] <= 20


def test_links_of_a_seed_join_what_any_match_joins():
    g, n, joined = np.random.default_rng(4), substrings.LENGTH, 0
    for trial in range(40):
        count, most = int(g.integers(3, 40)), (10**6, 40, 25)[trial % 3]
        base = g.integers(1, most, (4, 2 * n - 1)).astype(np.uint32)
        if trial % 4 == 3:
            base = np.tile(base[:, :20], 5)[:, : 2 * n - 1]
        rows = base[g.integers(0, 4, count)]
        for row in rows:
            row[g.integers(0, 2 * n - 1, g.integers(0, 40))] = g.integers(1, most)
            row[: g.integers(0, n) if g.random() < 0.3 else 0] = 0
        rows[:, n - 1] = 7
        grp = g.integers(0, count, count)
        key = np.sort(g.integers(0, 2 * count, count))
        grp = grp[key % count]
        links = substrings.links_of_seed(grp, key, rows)
        a, b = np.triu_indices(count, 1)
        match = substrings.matching_starts(rows[a], rows[b])[0] >= 0
        wanted = {(int(x), int(y)) for x, y in zip(a[match], b[match]) if grp[x] != grp[y]}
        assert set(links) <= wanted

        def components(pairs):
            comp = grp.copy()
            for x, y in pairs:
                comp[comp == comp[y]] = comp[x]
            return [int(np.flatnonzero(comp == c)[0]) for c in comp]

        assert components(links) == components(wanted)
        joined += len(links)
    assert joined > 50


def test_substrings_small_rounds_and_salts(spark, monkeypatch):
    """Pieces of trees, crowded documents and meetings in many steps give what one of each gives."""
    rows, _ = planted(5, 80)
    copy = prose(90, 77)
    rows += [(1000 + i, lines(prose(20, 600 + i) + mutated(copy, i % 2, i) + prose(30, 700 + i))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    key = lambda r: (r.doc_id, r.match_id, r.start_word, r.end_word, r.match_start, r.similarity)
    whole = sorted(map(key, substrings.passages(df, WorkTables(spark, "t")).collect()))
    flagged = {d for r in whole for d in r[:2]}
    assert {1000 + i for i in range(60)} <= flagged
    monkeypatch.setattr(substrings, "SALT", 7)
    assert sorted(map(key, substrings.passages(df, WorkTables(spark, "t")).collect())) == whole


def test_meeting_in_steps():
    """Held windows meet later ones as if all came at once."""
    g = np.random.default_rng(8)
    tokens = [np.concatenate([g.integers(1, 1 << 60, 40), np.arange(200, 290), g.integers(1, 1 << 60, 30)]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(30)]
    rec = substrings.window_records(tokens, list(range(30)))
    rec = rec[np.argsort(rec["own"], kind="stable")]
    whole = substrings.Meeting().add(rec, rec["own"].astype(np.int64))
    steps, parts = substrings.Meeting(), []
    for d in range(0, 30, 4):
        some = rec[(rec["own"] >= d) & (rec["own"] < d + 4)]
        parts.append(steps.add(some, some["own"].astype(np.int64)))
    assert len(steps.rec) < len(rec)
    assert sorted(map(tuple, np.concatenate(parts).tolist())) == sorted(map(tuple, whole.tolist()))


def test_windows_in_pieces(monkeypatch):
    """Every passage lies in one window of its min-hash, however the document is cut."""
    h = np.random.default_rng(4).integers(0, 1 << 63, 700).astype(np.uint64)
    monkeypatch.setattr(substrings, "ROUND", 150)
    rec = substrings.window_records([h[:30], h], [0, 1])
    n = substrings.LENGTH
    for k in range(substrings.HASHES):
        v = substrings.mixed(h, k)
        mine = rec[(rec["own"] == 1) & (rec["hash"] == k)]
        for s in range(len(h) - n + 1):
            assert (((mine["l"] <= s) & (mine["r"] >= s + n - 1)) & (mine["value"] == v[s : s + n].min())).sum() == 1


def test_substrings_repeated_ids(spark):
    shared, other = prose(70, 81), prose(70, 82)
    rows = [(1, lines(prose(30, 1) + shared)), (1, lines(prose(30, 2) + other)), (2, lines(prose(50, 3) + shared)), (3, lines(prose(50, 4) + other)), (4, lines(prose(90, 5))), (4, lines(prose(90, 5))), (5, lines(shared[:49]))]
    found = substrings.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), WorkTables(spark, "t")).collect()
    assert {frozenset((r.doc_id, r.match_id)) for r in found} == {frozenset((1, 2)), frozenset((1, 3))}


# pipeline


def test_pipeline_stages(spark, awkward, data):
    docs = awkward.select(*[c for c in awkward.columns])
    for name, stage in corpus_pipeline.STAGES:
        docs = WorkTables(spark, "t").keep(stage(spark, docs, data), name)
        if name != "byte_bpe":
            assert docs.columns == awkward.columns
    ids = {r.doc_id for r in docs.collect()}
    assert 15 not in ids and 1 not in ids and 6 in ids and 14 in ids


def test_pipeline_joins_frequent_passages(spark, data, monkeypatch):
    sizes, in_chunks = [], jaccard_join._in_chunks
    monkeypatch.setattr(jaccard_join, "CHUNK_BYTES", 8_000)
    monkeypatch.setattr(jaccard_join, "_in_chunks", lambda sets: (sizes.extend(r["count"] for r in sets.groupBy("group").count().collect()), in_chunks(sets))[1])
    hot = prose(16, 79)
    texts = [hot + prose(24, 3000 + i) for i in range(150)]
    rows = [(i, lines(t)) for i, t in enumerate(texts)] + [(500 + i, lines([*t, "q"])) for i, t in enumerate(texts[:10])]
    docs = spark.createDataFrame([(i, t, "en", None, len(t), "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, data).collect()
    assert sorted(r.doc_id for r in kept) == [*range(150)]
    assert sizes and max(sizes) <= 4


def test_pipeline_on_empty(spark, empty, data):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = WorkTables(spark, "t").keep(stage(spark, docs, data), name)
    assert docs.count() == 0 and "lang" in SCHEMA


def test_pipeline_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    rows = out.collect()
    assert 0 < len(rows) <= 200 and all(r.n_tokens == len(r.ids) for r in rows)
