"""Line dedup, near duplicates, decontamination, fingerprints, components."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from scoreloom.llm import common, decontaminate, fingerprints, jaccard_join, line_dedup
from scoreloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _text(g, n, words):
    return " ".join(g.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Texts with exact and near copies, chains of edits, shared passages, short and empty ones."""
    g = random.Random(7)
    words = ["".join(g.choice("abcdefghij") for _ in range(g.randint(2, 6))) for _ in range(900)]
    out = [_text(g, g.randint(5, 300), words) for _ in range(150)]
    passage = _text(g, 60, words)
    for k in range(40):
        out[k] = f"{out[k]} {passage}"
    base = _text(g, 200, words).split()
    for _ in range(60):  # a hot group of near copies
        w = list(base)
        for _ in range(g.randint(0, 6)):
            w[g.randrange(len(w))] = g.choice(words)
        out.append(" ".join(w))
    chain = _text(g, 120, words).split()
    for k in range(30):  # each close to the next, the ends far apart
        chain[k * 4 % 120] = g.choice(words)
        out.append("\t".join(chain).upper())
    out += [out[3]] * 40 + ["", None, " ", "one", "ONE", "one two", "one two three", "a b c d", "a b c d", "a b c e"]
    g.shuffle(out)
    return [(k * 3, t, None if k % 17 == 0 else "en", f"s{k % 3}" if k % 4 else None, 0) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _components(rows, k, num):
    sets = {}
    for d, t, *_ in rows:
        w = common.space_words(t or "")
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted = collections.defaultdict(list)
    for d in sorted(sets):
        seen = collections.Counter(e for s in sets[d] for e in inverted[s])
        for e, o in seen.items():
            if 100 * o >= num * (len(sets[d]) + len(sets[e]) - o):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
        for s in sets[d]:
            inverted[s].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_join_against_brute_force(docs, rows, k, num, monkeypatch):
    if k == 4:  # so that buckets are dealt in blocks, and signatures come in runs with hot ones
        monkeypatch.setattr(jaccard_join, "BLOCK", 16)
        monkeypatch.setattr(jaccard_join, "CHUNK", 300)
        monkeypatch.setattr(jaccard_join, "HOT", 10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs, k, num).collect()}
    assert got == _components(rows, k, num)


def test_jaccard_join_odd_rows(spark, docs, rows):
    odd = spark.createDataFrame([(None, "a b c d e f", "x", "y", 1), (5, "a b c d e f", "x", "y", 1), (5, "a b c d e f", "x", "y", 1)], SCHEMA)
    got = sorted(map(tuple, jaccard_join.jaccard_join(odd).collect()), key=str)
    assert got == [(5, 2, 5), (5, 2, 5), (None, 2, None)]
    assert jaccard_join.jaccard_join(odd.limit(0)).count() == 0
    kept = jaccard_join.one_of_each(docs)
    want = {d for d, (_, c) in _components(rows, 5, 80).items() if c == d}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("base", [0, (1 << 63) - 1000])
def test_one_of_each_loses_no_text_of_a_repeated_id(spark, base):
    words = lambda name: " ".join(f"{name}{k}" for k in range(30))
    x, y, z = words("x"), words("y"), words("z")
    made = [(3, y, "a"), (5, x, "b"), (5, y, "c"), (7, x, "d"), (9, z, "e"), (9, z, "e"), (11, "", "f"), (11, None, "f")]
    made = [(base + d, t, n, "s", 0) for d, t, n in made] + [(None, x, "g", "s", 0), (None, x, "g", "s", 0)]
    kept = jaccard_join.one_of_each(spark.createDataFrame(made, SCHEMA).repartition(3))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted([(base + 3, y), (base + 5, x), (base + 9, z), (base + 11, ""), (None, x), (None, x)], key=str)


def test_signatures_lose_no_link():
    g = random.Random(9)
    for num in (85, 80, 60):
        rule = jaccard_join.Rule(4, num)
        for _ in range(400):
            n = g.choice([1, 2, 3, 5, 8, 13, 40, 100, 333, 1000])
            a = np.unique(np.array([g.getrandbits(64) for _ in range(n)], dtype=np.uint64))
            drop = g.randint(0, max(0, len(a) * (100 - num) // 100))
            b = np.unique(np.r_[a[drop:], np.array([g.getrandbits(64) for _ in range(g.randint(0, drop + 2))], dtype=np.uint64)])
            if len(b) and rule.linked(a, b):
                assert len(np.intersect1d(rule.signatures(a), rule.signatures(b))), (num, len(a), len(b))


def test_unrelated_texts_share_no_signature():
    """Sets with nothing in common meet nowhere: empty groups are named only where they may be all that agrees."""
    g = np.random.default_rng(8)
    rule = jaccard_join.Rule(5, 80)
    seen = set()
    for n in range(60, 900):
        own = set(rule.signatures(np.unique(g.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))).tolist())
        assert not own & seen, n
        seen |= own


def test_empty_groups_lose_no_link():
    """Sets in few groups, and sets that differ as much as linked ones can."""
    g = np.random.default_rng(5)
    for num in (80, 85, 95, 50):
        rule = jaccard_join.Rule(5, num)
        for trial in range(600):
            n, narrow = int(g.integers(1, 60 if trial % 2 else 900)), np.uint64(g.integers(0, 12) if trial % 3 else 0)
            draw = lambda k: g.integers(0, 1 << 63, k).astype(np.uint64) * np.uint64(2) >> narrow  # noqa: B023, E731
            a = np.unique(draw(n))
            kept = len(a) - int(g.integers(0, len(a) - -(-len(a) * num // 100) + 1))
            b = np.unique(np.r_[g.permutation(a)[:kept], draw(max(0, 100 * kept // num - len(a)))])
            assert rule.linked(a, b) and len(np.intersect1d(rule.signatures(a), rule.signatures(b))), (num, len(a), len(b))


def test_rtree_rules_out_no_link():
    g = np.random.default_rng(3)
    rule = jaccard_join.Rule(4, 85)
    base = g.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(np.r_[g.choice(base, g.integers(200, 300), replace=False), g.integers(0, 1 << 63, g.integers(0, 30)).astype(np.uint64)]) for _ in range(80)]
    tree = jaccard_join.RTree(jaccard_join.spread([jaccard_join.point(s) for s in sets]), np.array([len(s) for s in sets]), rule)
    for x, k in enumerate(tree.order.tolist()):
        near = set(tree.order[tree.near(x)[0]].tolist())
        assert {j for j, o in enumerate(sets) if rule.linked(sets[k], o)} <= near


@pytest.mark.parametrize("canopy", [4, 1024])
def test_what_a_block_gives(monkeypatch, canopy):
    """All surviving pairs if it says so; else every point is linked to the first one that survives with it, or to what that one is."""
    monkeypatch.setattr(jaccard_join, "CANOPY", canopy)
    g = np.random.default_rng(5)
    rule = jaccard_join.Rule(4, 85)
    pool = [g.integers(0, 1 << 63, 120).astype(np.uint64) * np.uint64(2) for _ in range(3)]
    sets = [np.unique(np.r_[g.choice(pool[k % 3], 115, replace=False), g.integers(0, 1 << 63, g.integers(0, 8)).astype(np.uint64)]) for k in range(70)]
    points, sizes = jaccard_join.spread([jaccard_join.point(s) for s in sets]), np.array([len(s) for s in sets])
    groups = np.array([0 if k % 3 == 0 else k for k in range(70)])
    blocks = np.zeros(70, dtype=int)
    links = {(x, y) for x in range(70) for y in range(x) if rule.linked(sets[x], sets[y]) and groups[x] != groups[y]}
    found, whole = jaccard_join.between(points, sizes, groups, blocks, rule, True)
    assert whole and links <= {(max(p), min(p)) for p in found.tolist()}
    found, whole = jaccard_join.between(points, sizes, groups, blocks, rule, False)
    assert not whole and len(found) <= 5 * 70
    up = list(groups)
    for x, y in found.tolist():
        a, b = up[x], up[y]
        up = [b if u == a else u for u in up]
    assert len(set(up)) < 12
    few, whole = jaccard_join.between(points[:8], sizes[:8], np.arange(8), blocks[:8], rule, False)
    assert canopy < 8 or whole and {p for p in links if p[0] < 8} <= {(max(p), min(p)) for p in few.tolist()}


def test_a_block_searches_for_what_lies_outside_its_largest_component(monkeypatch):
    asked, search = [], jaccard_join.RTree.pairs_of
    monkeypatch.setattr(jaccard_join.RTree, "pairs_of", lambda tree, places: asked.extend(places) or search(tree, places))
    g = np.random.default_rng(5)
    base = g.integers(0, 1 << 63, 120).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(g.choice(base, 118, replace=False)) for _ in range(200)]
    points, sizes = jaccard_join.spread([jaccard_join.point(s) for s in sets]), np.array([len(s) for s in sets])
    groups = np.array([k if k % 20 == 0 else 1 for k in range(200)])
    found, whole = jaccard_join.between(points, sizes, groups, np.zeros(200, dtype=int), jaccard_join.Rule(4, 85), True)
    assert whole and len(asked) == 10
    assert {frozenset(p) for p in found.tolist()} == {frozenset((x, y)) for x in range(0, 200, 20) for y in range(200) if x != y}


def test_jaccard_join_of_long_texts(spark):
    """Texts of 30,000 to 600,000 words, whose sets are compared whole."""
    g = random.Random(12)
    long = [f"w{g.randrange(10**6)}" for _ in range(30_000)]
    far = [f"w{g.randrange(10**6)}" if k % 9 == 0 else w for k, w in enumerate(long)]
    near = [f"w{g.randrange(10**6)}" if k % 60 == 0 else w for k, w in enumerate(long)]
    huge = [f"h{g.randrange(10**6)}" for _ in range(600_000)]
    rows = [(k, " ".join(w), "x", "y", 0) for k, w in enumerate((long, far, near, huge, [*huge, "end"], long[:10]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()}
    assert [got[k][1] for k in range(6)] == [0, 1, 0, 3, 3, 5]
    words = " ".join(long[:9]).encode().split()
    assert got[5][0] == 7 and (common.shingle_hashes(words * 20_000, 4) == np.tile(common.shingle_hashes(words * 2, 4)[:9], 20_000)[: 180_000 - 3]).all()


ODD = "doc_id long, `a.b` string, text string, TEXT string, `Doc_ID` int, `x``y` int, __gone boolean, __maybe int, source string, n_chars long, maybe int, bucket long, host string, row string"


def test_names_that_clash(spark):
    """Stages keep every column as it is, whatever its name; the values of each are told apart."""
    case = spark.conf.get("spark.sql.caseSensitive")
    same = " ".join(f"w{k}" for k in range(40))
    made = [(k, "ab", same if k < 3 else f"{same} other words of text number {k} v{k} x{k} y{k} z{k} " * 3, "OTHER", -k, k, k % 2 == 0, 7, "s", 1, 5, 6, "h", "r") for k in range(8)]
    made += [(None, "ab", None, None, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(made, ODD)
    want = {r[0]: tuple(r) for r in made}
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns and {r[0] for r in kept.collect()} == {0, 3, 4, 5, 6, 7, None} - ({4, 5, 6, 7} - {r[0] for r in kept.collect()})
    assert all(tuple(r) == want[r[0]] for r in kept.collect())
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and all(tuple(r)[:2] + tuple(r)[3:9] == want[r[0]][:2] + want[r[0]][3:9] for r in out.collect())
    clean = decontaminate.decontaminated(df, spark.createDataFrame([(1, "nothing of this")], "item_id long, text string"))
    assert clean.columns == df.columns and {tuple(r) for r in clean.collect()} == set(want.values())
    assert {r.doc_id for r in decontaminate.contamination(df, spark.createDataFrame([(1, same)], "item_id long, text string")).filter("contaminated").select("doc_id").collect()} == set(range(8))
    assert fingerprints.fingerprints(df).count() == 9 and line_dedup.line_report(df).count() == 9
    assert spark.conf.get("spark.sql.caseSensitive") == case


def test_components(spark):
    g = random.Random(1)
    edges = [(a, a + 1) for a in range(0, 60)] + [(100, 200), (200, 300), (400, 400), (None, 1)] + [(500 + g.randrange(40), 500 + g.randrange(40)) for _ in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[300] == got[100] == 100 and 400 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark, docs, rows):
    g = random.Random(4)
    made = []
    for k in range(120):
        lines = [f"own {k}", "", " footer of all ", f"rare {k % 60}"] + (["half"] if k % 2 else [])
        g.shuffle(lines)
        made.append((k, "\n".join(lines), None, ["a", "b", None][k % 3], 0))
    made += [(500, None, None, "a", 0), (501, "", None, "a", 0), (502, "footer of all", None, "a", 0), (503, "footer of all\n", None, "b", 0)]
    df = spark.createDataFrame(made, SCHEMA)
    got = line_dedup.line_report(df).toPandas().sort_values("doc_id").reset_index(drop=True)
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    want = c.execute(line_dedup.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    assert got.astype(str).equals(want[got.columns].astype(str))
    by = dict(zip(got.doc_id, got.text, strict=True))
    assert "footer" not in by[0] and "own 0" in by[0] and by[502] == "" and by[500] is None
    out = line_dedup.dedup_lines(df.withColumn("bad", df.doc_id).withColumn("lines", df.doc_id))
    assert out.columns == [*df.columns, "bad", "lines"] and out.count() == len(made)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_of_planted_passages(spark):
    """The ratio's border on a hot and a small host, as the README states it."""
    words = lambda name: " ".join(f"{name}{k}" for k in range(60))
    planted = {("hot", "over"): 41, ("hot", "under"): 40, ("small", "three"): 3, ("small", "two"): 2}
    made = []
    for host, pages in (("hot", 2000), ("small", 20)):
        for k in range(pages):
            lines = [words(name) for (of, name), n in planted.items() if of == host and k < n]
            made.append((len(made), "\n".join([f"own {host} {k}", *lines]), None, host, 0))
    got = "\n".join(r.text for r in line_dedup.line_report(spark.createDataFrame(made, SCHEMA)).collect()).split("\n")
    assert {name: got.count(words(name)) for _, name in planted} == {"over": 0, "under": 40, "three": 0, "two": 2}


def test_line_dedup_without_broadcast(spark, docs, monkeypatch):
    want = sorted(map(str, line_dedup.line_report(docs, ratio=0.01).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(map(str, line_dedup.line_report(docs, ratio=0.01).collect())) == want


def _brute_hits(text, windows):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, items = set(), set()
    for n in {len(k) for k in windows}:
        for k in range(len(w) - n + 1):
            if found := windows.get(tuple(w[k : k + n])):
                items |= found
                hit.update(range(k, k + n))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [1 << 20, 400])
def test_decontamination_against_brute_force(spark, limit):
    g = random.Random(11)
    words = ["".join(g.choice("abcdé0") for _ in range(g.randint(1, 3))) for _ in range(40)]
    items = [(k, _text(g, g.choice([1, 2, 5, 13, 14, 20, 40]), words)) for k in range(25)] + [(100, None), (101, "!!"), (7, "again " * 20), (None, "nameless item")]
    docs = [(k, _text(g, g.randint(0, 200), words) + g.choice(["", " " + g.choice(items[:25])[1].upper().replace(" ", "-- ")]), None, None, 0) for k in range(120)] + [(200, None, None, None, 0), (None, "nameless ITEM", None, None, 0), (201, "again " * 300, None, None, 0)]
    windows = collections.defaultdict(set)
    for name, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for k in range(len(w) - min(13, len(w)) + 1) if w else ():
            windows[tuple(w[k : k + min(13, len(w))])].add("" if name is None else str(name))
    df = spark.createDataFrame(docs, SCHEMA).repartition(2).withColumnsRenamed({"lang": "n_hit"})
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"), limit=limit).collect()
    want = {d: _brute_hits(t, windows) for d, t, *_ in docs}
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]
        assert sum(int(b) - int(a) for a, b in (s.split(":") for s in r.spans.split(",") if s)) == r.n_hit
    kept = decontaminate.decontaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if not w[4]}
    none = decontaminate.contamination(df, spark.createDataFrame([], "item_id long, text string")).collect()
    assert not any(r.contaminated for r in none) and len(none) == len(docs)


def test_fm_index():
    g = np.random.default_rng(2)
    for n, sigma in ((1, 2), (50, 3), (400, 6), (300, 2)):
        text = g.integers(1, sigma + 1, n)
        index = decontaminate.FMIndex(text)
        for m in (1, 2, 5):
            patterns = np.concatenate([g.integers(1, sigma + 3, (10, m)), np.stack([text[a : a + m] for a in g.integers(0, max(1, n - m), 10)])]) if n >= m else g.integers(1, sigma + 3, (10, m))
            lo, hi = index.search(patterns)
            for p, a, b in zip(patterns, lo, hi, strict=True):
                want = [k for k in range(n - m + 1) if (text[k : k + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_fingerprints(spark, rows):
    made = [(d, t, a, b, c) for d, t, a, b, c in rows] + [(None, "no id here at all", None, None, 0)]
    got = fingerprints.fingerprints(spark.createDataFrame(made, SCHEMA).repartition(5)).collect()
    order = sorted(made, key=lambda r: (r[0] is not None, r[0] or 0))
    by = {r.doc_id: r for r in got}
    assert len(got) == len(made)
    prints = {}
    for k, (d, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + nxt[:half]
        r = by[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.near_next == fingerprints.likeness(fingerprints.signature(t), fingerprints.signature(nxt))
        assert 0 <= r.near_edited <= 1 and (t != changed or r.near_edited == 1)
    assert fingerprints.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame(made[:1], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_samples_of_more_terms_than_draws():
    """Terms that share their draws don't shift the estimate: sets several times as large as the table of draws."""
    g = np.random.default_rng(18)
    gaps = []
    for share in (0.5, 0.8, 0.95):
        for _ in range(4):
            pool = np.unique(g.integers(0, 1 << 63, 150_000).astype(np.uint64) * np.uint64(2))
            own = g.random(len(pool))
            a, b = pool[own < (1 + share) / 2], pool[own > (1 - share) / 2]
            want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            gaps.append((fingerprints.weighted(a, np.ones(len(a), int)) == fingerprints.weighted(b, np.ones(len(b), int))).mean() - want)
    assert abs(np.mean(gaps)) < 0.04 and np.max(np.abs(gaps)) < 0.2


def test_samples_collide_as_often_as_the_weights_overlap():
    g = np.random.default_rng(8)
    gaps = []
    for _ in range(60):
        terms = np.sort(g.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2))
        a, b = g.integers(0, 5, 200), g.integers(0, 5, 200)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        same = (fingerprints.weighted(terms[a > 0], a[a > 0]) == fingerprints.weighted(terms[b > 0], b[b > 0])).mean()
        gaps.append(same - want)
    assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.1
