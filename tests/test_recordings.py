"""Recorded captures as a source, and documents from their changes."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.sources import changes, recordings

INDEX = "file string, place int, timestamp string, original string, digest string, status string"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(f"part-{k // 4}", k, f"202401{k + 1:02d}000000", f"https://x/{k}", f"d{k % 3}", "200" if k % 2 else "404") for k in range(10)]
    pages = [("d0", "<p>zéro</p>"), ("d1", "one"), ("d2", "")]
    recordings.record(spark.createDataFrame(rows, INDEX).repartition(3), spark.createDataFrame(pages, "digest string, html string"), f"file://{tmp_path}/r")
    return f"{tmp_path}/r"


def test_captures_are_read_by_index_file(spark, folder):
    out = recordings.captured(spark, f"file://{folder}")
    assert sorted(os.listdir(f"{folder}/index")) == ["part-0.json", "part-1.json", "part-2.json"]
    rows = out.orderBy("timestamp").collect()
    assert [r["original"] for r in rows] == [f"https://x/{k}" for k in range(10)]
    assert {r["digest"]: r["html"] for r in rows} == {"d0": "<p>zéro</p>", "d1": "one", "d2": ""}
    assert out.rdd.getNumPartitions() == 3


def test_filters_keep_pages_closed(spark, folder):
    """Pages that the filters leave out are gone, and aren't missed; one that is wanted is."""
    os.remove(f"{folder}/pages/d0.html")
    out = recordings.captured(spark, f"file://{folder}")
    some = out.filter((F.col("timestamp") >= "20240105000000") & (F.col("status") == "200") & F.col("digest").isin("d1", "d2") & (F.length("html") >= 0))
    assert sorted(r["original"] for r in some.collect()) == ["https://x/5", "https://x/7"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    own = plan[plan.index("Filter") :] if "Filter" in plan else ""
    assert "length" in own and "timestamp" not in own.split("\n")[0] and "status" not in own.split("\n")[0]  # what is pushed isn't done again
    with pytest.raises(Exception, match="d0.html"):
        out.filter("timestamp < '20240102000000'").collect()


def test_no_index_and_bad_index(spark, tmp_path):
    assert recordings.captured(spark, f"file://{tmp_path}/none").count() == 0
    os.makedirs(f"{tmp_path}/bad/index")
    with open(f"{tmp_path}/bad/index/a.json", "w") as f:
        f.write("{")
    with pytest.raises(Exception, match="JSON"):
        recordings.captured(spark, f"file://{tmp_path}/bad").collect()
    with open(f"{tmp_path}/bad/index/a.json", "w") as f:
        f.write("[]")
    assert recordings.captured(spark, f"file://{tmp_path}/bad").count() == 0


def _random(g, depth=0):
    kind = g.randrange(3 if depth < 3 else 1)
    if kind == 1:
        return {k: _random(g, depth + 1) for k in g.sample(["a", "b", "c.d", "e\"f", "0", "é"], g.randint(0, 4))}
    if kind == 2:
        return [_random(g, depth + 1) for _ in range(g.randint(0, 3))]
    return g.choice([None, True, 1, 2.5, "x", "", "é\n", -0.0, 10**20])


def test_documents_come_back_from_their_changes(spark):
    """Random documents, keys in changing order, empty objects and lists, kinds that change: the same bytes each day."""
    g = random.Random(4)
    days = {dt.date(2024, 1, 1) + dt.timedelta(days=2 * k): json.dumps(_random(g) if k % 5 else [{}, {"q": g.randrange(3)}], indent=2) for k in range(25)}
    days[dt.date(2024, 3, 1)] = json.dumps({"a": 1, "b": {"x": 1, "y": 2}}, indent=2)
    days[dt.date(2024, 3, 2)] = json.dumps({"b": {"y": 2, "x": 1}, "a": 1}, indent=2)
    documents = spark.createDataFrame(list(days.items()), "as_of date, value string").repartition(4)
    changed = changes.changes(changes.leaves(documents))
    back = {r["as_of"]: r["value"] for r in changes.rebuilt(changed, documents.select("as_of")).collect()}
    assert back == days
    last = changed.filter("as_of = '2024-03-02'").collect()
    assert {r["op"] for r in last} == {"moved"} and len(last) == 3
    first = changed.filter("as_of = '2024-01-01'").collect()
    assert {r["op"] for r in first} == {"added"}
    assert changed.count() < sum(1 for _ in changes.leaves(documents).collect()) * 2


def test_changes_of_one_field(spark):
    days = [(dt.date(2024, 1, k), json.dumps({"games": [{"n": 1, "price": p}], "as_of": k})) for k, p in ((1, 2), (2, 2), (3, 5))]
    got = changes.changes(changes.leaves(spark.createDataFrame(days, "as_of date, value string")))
    assert [(r["path"], r["before"], r["value"]) for r in got.filter("op = 'changed' and path like '%price%'").collect()] == [('["games", 0, "price"]', "2", "5")]
    assert got.filter("op = 'added'").count() == 3
    assert changes.changes(changes.leaves(spark.createDataFrame([], "as_of date, value string"))).count() == 0


def test_many_index_files_share_partitions_and_pages(tmp_path, monkeypatch):
    """A page that many rows name is opened once a partition, and a partition holds several index files."""
    for part in ("index", "pages"):
        os.makedirs(f"{tmp_path}/{part}")
    for k in range(200):
        with open(f"{tmp_path}/index/part-{k:03d}.json", "w") as f:
            f.write(json.dumps([list(recordings.INDEXED), [f"t{k}", f"https://x/{k}", "d0", "200"], [f"u{k}", f"https://y/{k}", "d0", "200"]]))
    with open(f"{tmp_path}/pages/d0.html", "w") as f:
        f.write("page")
    seen, real = [], recordings.opened

    class Counted:
        def __init__(self, system):
            self.get_file_info, self.open_input_file = system.get_file_info, lambda path: seen.append(path) or system.open_input_file(path)

    monkeypatch.setattr(recordings, "opened", lambda uri: (Counted(real(uri)[0]), real(uri)[1]))
    reader = recordings.CaptureReader(f"{tmp_path}")
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) == 67 and len(rows) == 400 and {r["html"] for r in rows} == {"page"}
    assert sorted(r["original"] for r in rows) == sorted(f"https://{c}/{k}" for c in "xy" for k in range(200))
    assert sum(path.endswith(".html") for path in seen) == len(parts)
