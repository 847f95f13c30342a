"""Exact top-k search, cascading erasure, spelling variants: against brute force."""

import datetime as dt
import glob
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import erasure, spelling, topk_search

# Top-k -----------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, `a.b` string, Vec_ID_ string"


def _top(rows, k, each):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(kept):
        if q % each == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for n, (i, b) in enumerate(kept) if n != at)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def _rows(spark, rows, k=5, each=50):
    frame = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], VECTORS).repartition(3)
    return sorted(map(tuple, topk_search.top_k(frame, F.col("vec_id") % each == 0, k).collect()))


@pytest.mark.parametrize("block", [2048, 3])
def test_top_k(spark, monkeypatch, block):
    """Ties, repeated ids and vectors, nulls, other lengths; in one block of queries and in several."""
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", block)
    g = np.random.default_rng(4)
    rows = [(k, (g.normal(size=8) / 3).astype(np.float32).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[7][1]) for k in range(40)]  # a common vector: ties beyond k
    rows += [(50, rows[3][1]), (50, rows[50][1]), (7, rows[7][1])]
    rows += [(None, rows[1][1]), (100, None), (150, [1.0, None]), (200, [float("nan")] * 8), (250, [float("inf")] * 8), (350, []), (399, [2.0] * 12), (400, [3.0, -1.0])]
    assert _rows(spark, rows) == _top(rows, 5, 50)


def test_top_k_small_and_large_scores(spark):
    assert _rows(spark, []) == []
    assert _rows(spark, [(1, [1.0])]) == []
    assert _rows(spark, [(50, [1.0])]) == []
    few = [(0, [1.0, 2.0]), (1, [0.5, 0.0]), (2, [0.0, 0.0])]
    assert _rows(spark, few) == _top(few, 5, 50) == [(0, 1, 1, 32768), (0, 2, 2, 0)]
    large = [(k, [float(np.float32(1e5 * (k + 1))), -3.0]) for k in range(9)]  # beyond what doubles add exactly
    assert _rows(spark, large, 3, 4) == _top(large, 3, 4)
    with pytest.raises(ValueError, match="64 bits"):
        _rows(spark, [(0, [1e9]), (1, [1e9])])


def test_histograms_find_the_kth_score():
    """Every pass leaves the k-th score inside the range, whatever the spread of the scores."""
    g = np.random.default_rng(1)
    data = [{"row": k, "vec_id": k, "v": g.integers(-900, 900, 3).tolist()} for k in range(50)]
    longest = max(math.sqrt(sum(x * x for x in r["v"])) for r in data)
    block = topk_search._Block(data[:6], longest, 4)
    batch = pa.RecordBatch.from_pydict({"row": [r["row"] for r in data], "vec_id": [r["vec_id"] for r in data], "v": [r["v"] for r in data]}, pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.int64()))]))
    while block.open.any():
        counts = [tuple(x.values()) for b in block.count([batch]) for x in b.to_pylist()]
        chosen = []
        for q in np.flatnonzero(block.open):
            before = 0
            for b, n in sorted(((b, n) for p, b, n in counts if p == q), reverse=True):
                if before + n >= block.k - block.above[q]:
                    chosen.append({"q": int(q), "b": b, "before": before})
                    break
                before += n
        block.narrow(chosen)
    want = [sorted((sum(x * y for x, y in zip(q["v"], r["v"], strict=True)) for r in data if r is not q), reverse=True)[3] for q in data[:6]]
    assert block.lo.tolist() == want
    assert not block.few.any()


# Erasure ---------------------------------------------------------------------------------------

T0 = dt.datetime(2024, 1, 1)
SCHEMAS = {
    "clients": "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, balance double",
    "clicks": "click_id long, ts timestamp_ntz, client_id long, kind string, value double, `a.b` string, CLIENT_ID_ string",
    "sales": "sale_id long, client_id long, status string, total double",
    "sale_lines": "sale_id long, line_no int, amount double, flag string, file_no int",
}


def _tables(seed, n):
    g = random.Random(seed)
    some = lambda v, p=0.1: None if g.random() < p else v
    clients = [(some(k % (n // 6), 0.03), some(g.randrange(n // 8)), "crm", some(T0 + dt.timedelta(hours=g.randrange(99))), f"n{k}", some(round(g.uniform(-99, 999), 2))) for k in range(n // 5)]
    clicks = [(some(k, 0.05), T0 + dt.timedelta(seconds=g.randrange(9)), some(7 if g.random() < 0.33 else g.randrange(n // 5)), some("é"), some(g.choice([1.005, 2.5, float("nan"), float("inf"), 0.0])), "x", None) for k in range(n)]
    clicks += clicks[:20]
    sales = [(some(k, 0.02), some(g.randrange(n // 5)), "done", some(g.uniform(0, 9))) for k in range(n // 2)]
    sales += [(5, 3, "again", 1.0), (5, None, "again", 1.0), sales[9]]
    lines = [(some(5 if g.random() < 0.33 else g.randrange(n)), some(k % 4), some(g.uniform(0, 9)), "kept", k) for k in range(2 * n)]
    return {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": lines + lines[:9]}


def _order(v):
    return (v is not None, (v != v, 0.0 if isinstance(v, float) and v != v else v.encode() if isinstance(v, str) else v) if v is not None else 0)


def _crc(v):
    return zlib.crc32(b"" if v is None else str(v).encode())


def _brute(tables, files, divisor):
    clients, clicks, sales, lines = (tables[t] for t in SCHEMAS)
    owner = {}
    for s, c, *_ in sales:
        if s is not None and c is not None:
            owner[s] = min(c, owner.get(s, c))
    per = Counter(r[2] for r in clicks if r[2] is not None)
    sums = Counter()
    for c, m in {(r[0], r[1]) for r in clients if r[1] is not None}:
        sums[m] += per.get(c, 0)
    masters = {m for m in sums if _crc(m) % divisor == 0} | ({min(sums, key=lambda m: (-sums[m], m))} if sums else set())
    gone = {r[0] for r in clients if r[1] in masters and r[0] is not None}
    lost = {r[0] for r in sales if r[1] in gone and r[0] is not None}
    of = {"clients": (lambda r: r[0], lambda r: r[1] in masters, 5), "clicks": (lambda r: r[2], lambda r: r[2] in gone, 4), "sales": (lambda r: r[1], lambda r: r[1] in gone, 3), "sale_lines": (lambda r: owner.get(r[0]), lambda r: r[0] in lost, 2)}
    out, kept = {}, {}
    for t, (client, victim, money) in of.items():
        rows = sorted(tables[t], key=lambda r: (_crc(client(r)), *map(_order, r)))
        size = 1 + len(rows) // files
        for number, lo in enumerate(range(0, len(rows), size)):
            part = rows[lo : lo + size]
            left = [r for r in part if not victim(r)]
            if left:
                cents = sum(math.floor(100 * r[money] + 0.5) for r in left if r[money] is not None and math.isfinite(r[money]))
                digest = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in left).encode()).hexdigest()
                names = ",".join(x.strip().rsplit(" ", 1)[0].strip("`") for x in SCHEMAS[t].split(","))
                out[t, number] = (len(left), len(part) - len(left), cents, len(left) < len(part), digest, names)
                kept[t, number] = left
    return out, kept


@pytest.mark.parametrize(("n", "files", "divisor"), [(600, 40, 11), (120, 350, 400)])
def test_erasure(spark, tmp_path, n, files, divisor):
    """The report, and the files themselves: rows in order, types, statistics, no other file, the untouched left alone."""
    tables = _tables(n, n)
    frames = [spark.createDataFrame(tables[t], s).repartition(3) for t, s in SCHEMAS.items()]
    folder = f"file://{tmp_path}/out"
    report = erasure.erase_clients(*frames, folder=folder, files=files, divisor=divisor)
    want, kept = _brute(tables, files, divisor)
    got = {(r["table_name"], r["file_no"]): r for r in report.collect()}
    assert {k: (r["n_rows"], r["n_erased"], r["cents"], r["rewritten"], r["ids_sha256"], r["columns"]) for k, r in got.items()} == want
    assert len({r["rewritten"] for r in got.values()}) == (2 if files == 40 else 1)  # files of one row are emptied or left alone
    assert len(got) < sum(-(-len(t) // (1 + len(t) // files)) for t in tables.values()) or files == 40
    there = sorted(f for f in glob.glob(f"{tmp_path}/out/**", recursive=True) if os.path.isfile(f) and not f.endswith(".crc"))
    assert there == sorted(r["path"].removeprefix("file://") for r in got.values())
    same = lambda x: "nan" if isinstance(x, float) and x != x else x
    for key, row in got.items():
        file = pq.ParquetFile(row["path"].removeprefix("file://"))
        rows = [tuple(map(same, r.values())) for r in file.read().to_pylist()]
        assert rows == [tuple(map(same, r)) for r in kept[key]]
        first = file.metadata.row_group(0).column(0).statistics
        ids = [r[0] for r in kept[key] if r[0] is not None]
        assert first.null_count == len(rows) - len(ids) and (not ids or (first.min, first.max) == (min(ids), max(ids)))
    read = spark.read.parquet(f"{folder}/clicks")
    assert dict(read.dtypes)["ts"] == "timestamp_ntz" and dict(read.dtypes)["click_id"] == "bigint"


def test_erasure_of_nothing(spark, tmp_path):
    """Empty tables have no files; without masters nobody is a victim."""
    frames = [spark.createDataFrame([], s) for s in SCHEMAS.values()]
    assert erasure.erase_clients(*frames, folder=f"file://{tmp_path}/none").count() == 0
    frames[0] = spark.createDataFrame([(1, None, "a", None, "n", 1.0)], SCHEMAS["clients"])
    rows = erasure.erase_clients(*frames, folder=f"file://{tmp_path}/one").collect()
    assert [(r["table_name"], r["n_rows"], r["rewritten"]) for r in rows] == [("clients", 1, False)]
    frames[0] = spark.createDataFrame([(1, 4, "a", None, "n", 1.0), (2, 3, "a", None, "n", 1.0)], SCHEMAS["clients"])
    rows = erasure.erase_clients(*frames, folder=f"file://{tmp_path}/tie").collect()
    assert [(r["n_rows"], r["n_erased"], r["ids_sha256"]) for r in rows] == [(1, 0, hashlib.sha256(b"1").hexdigest())]  # all at 0: the smallest master


def test_a_file_is_there_whole_or_not_at_all(tmp_path):
    schema = pa.schema([("x", pa.int64())])
    at = f"file:{tmp_path}/t/a.parquet"
    out = erasure._Writer(at, schema)
    out.writer.write_table(pa.table({"x": [1]}, schema))
    assert glob.glob(f"{tmp_path}/t/a.parquet") == []
    out.close()
    again = erasure._Writer(at, schema)  # a task that runs again replaces what it wrote
    again.writer.write_table(pa.table({"x": [1]}, schema))
    again.close()
    assert os.listdir(f"{tmp_path}/t") == ["a.parquet"]


# Spelling --------------------------------------------------------------------------------------


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _variants(rows, drop, letters=5, times=3):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    n = {w: k for w, k in total.items() if len(w) >= letters and k >= times}
    near = {w: [v for v in n if _one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def prose():
    g = random.Random(9)
    base = ["".join(g.choice("abcdeÀÉéöß") for _ in range(g.randint(3, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "ababab", "bababa"]
    words = [w for w in base for _ in range(g.randint(1, 30))]

    def edited(w):
        k, c = g.randrange(len(w)), g.choice("abcdeé")
        return g.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w.upper(), w.title()])

    rows = []
    for doc in range(120):
        some = [w if g.random() < 0.7 else edited(w) for w in g.choices(words, k=g.randint(1, 60))]
        rows.append((doc, g.choice([" ", ", ", "1", "\n×\n", "Ā"]).join(some)))
    rows += [(800 + k, "parole " * 3 + "paroli " * (k % 2) + "parroli " * (k % 6 == 0)) for k in range(40)]  # a form of a form
    return rows + [(None, rows[3][1]), (5, rows[5][1]), (700, None), (701, ""), (702, "12 34"), (703, "x" * 90 + " " + "aaaaaa"), (704, " ".join(g.choices(words, k=3000)))]


@pytest.mark.parametrize("drop", [97, 3])
def test_variants(spark, prose, drop):
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in prose], "doc_id long, text string, `w.x` int, Word int").repartition(3)
    got = sorted(map(tuple, spelling.variants(frame, drop).collect()), key=str)
    want = _variants(prose, drop)
    assert got == want and len(want) > 50
    assert any(r[1] != r[2] for r in want if r[1]) and any(r[4] > 1 for r in want)


def test_nothing_that_grows_with_the_vocabulary_is_broadcast(spark, prose, monkeypatch):
    """However small Spark takes the tables to be."""
    plans, real = [], spelling.staged
    plan = lambda frame: plans.append(frame._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(spelling, "staged", lambda frame, name: plan(frame) or real(frame, name))
    plan(spelling.variants(spark.createDataFrame(prose, "doc_id long, text string")))
    assert sum("SortMergeJoin" in p for p in plans) >= 3
    assert not [p for p in plans if "Broadcast" in p]


def test_no_variants(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = spelling.variants(spark.createDataFrame([(1, "lonely lonely lonely lonely")], "doc_id long, text string"), 1 << 40).collect()
    assert [tuple(r) for r in one] == [("lonely", None, "lonely", 4, 0, None)]


def test_counts_do_not_depend_on_parts_or_flushes(prose):
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in prose], "text": [t for _, t in prose]}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    def total(**how):
        out = Counter()
        for b in spelling.counted([batch], **how):
            out.update(dict(zip(b["word"].to_pylist(), b["n"].to_pylist(), strict=True)))
        return out

    whole = total()
    assert total(held=1) == whole
    long = "ab" * 40 + " " + "wörterÀ " * 500 + "z" * 300
    assert "".join(spelling.parts(long, 64)) == long
    assert [w for p in spelling.parts(long, 64) for w in re.findall("[A-Za-zÀ-ÿ]+", p)] == re.findall("[A-Za-zÀ-ÿ]+", long)


def test_words_one_edit_apart_share_a_key():
    """No pair is lost: for all pairs of edits over a small alphabet some key is common, in the right order of lengths."""
    g = random.Random(3)
    for _ in range(3000):
        w = "".join(g.choice("abcßÿ") for _ in range(g.randint(5, 12)))
        k, c = g.randrange(len(w) + 1), g.choice("abczé")
        longer = w[:k] + c + w[k:]
        k = g.randrange(len(w))
        other = w[:k] + c + w[k + 1 :]
        _, short, long = spelling.keyed([w, longer, other])
        assert set(short[0]) & set(long[1])
        assert set(short[0]) & set(long[2]) and set(short[2]) & set(long[0])


def test_roots_of_long_chains(spark):
    """A chain of many forms ends at its last word."""
    chain = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(100)] + [("x", "w050")]
    got = dict(map(tuple, spelling.rooted(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert set(got.values()) == {"w100"} and len(got) == 101
