"""Pages, files and streams."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreloom import schemas
from scoreloom.operators import meta
from scoreloom.sources import files, html
from scoreloom.streaming import history

HEAD = "<html><body><p>News</p><p>Unclaimed prizes as of July 11, 2026 7:05 AM </p><table class='x tbstriped'><tr><th>Price</th></tr>"


def tr(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


GAME = tr("$5.00", "720", "Big &amp; Bold", "89.2%", "$5,572,450", "$60,000", "5")
MORE = tr("&nbsp;", " ", "", "&nbsp;", "", "$10,000", "1,010")


def pages(spark, **by):
    return spark.createDataFrame(list(by.items()), "page string, html string")


def test_snapshot_pages(spark):
    df = pages(
        spark, ok=HEAD + GAME + MORE + tr("$1", "668", " Small One ", "6.1%", "$96,620.50", "$1,000", "5") + "</table><table class='tbstriped'><tr><td>later</td></tr></table>",
        orphan=HEAD + MORE + "</table>", bad=HEAD + tr("$x", "1", "n", "1%", "$1", "$1", "1") + "</table>", narrow=HEAD + tr("1", "2") + "</table>", none="<p>as of now</p>", late="<table class='tbstriped'></table>",
        car=HEAD + tr("$5", "9", "n", "1%", "$1", "A  new car", "1") + "</table>",
    )
    games, errors = html.snapshots(df)
    got = sorted(games.collect(), key=lambda r: r.ordinal)
    assert [(r.page, r.game_no, r.name, r.price, r.percent_unsold, r.total_unclaimed) for r in got] == [("ok", 720, "Big & Bold", 5.0, 89.2, 5572450.0), ("ok", 668, "Small One", 1.0, 6.1, 96620.5)]
    assert [tuple(t) for t in got[0].top_prizes] == [(60000, None, 5), (10000, None, 1010)] and got[0].source_timestamp == "July 11, 2026 7:05 AM"
    assert {(r.page, r.error) for r in errors.collect()} == {("orphan", "orphan continuation row"), ("bad", "malformed cell"), ("narrow", "not 7 cells"), ("none", "missing data table"), ("late", "no 'as of' paragraph"), ("car", "malformed cell")}
    car = html.snapshots(df.filter("page = 'car'"), tolerant=True)[0].collect()[0]
    assert tuple(car.top_prizes[0]) == (None, "A new car", 1)


@pytest.mark.parametrize(("printed", "want"), [("Tickets Printed 960,000", 960000), ("Ticket printed: 5,400,000", 5400000), ("Tickets Printed - 840,000", 840000), ("Tickets sold 3", None)])
def test_articles(spark, printed, want):
    page = f"<h1> Gold <b>Rush</b> </h1><p>Game #712</p><div>{printed}</div><p>HIGHEST INSTANT PRIZE ODDS 1:180,000</p><p>Overall odds of winning 1: 3.52</p><p>On Sale - July 2, 2026</p><p>Maximum Award: $60,000</p><script>Game #1</script>"
    df = spark.createDataFrame([("a1", page), ("a2", "<p>nothing</p>"), ("a3", None)], "article_id string, html string")
    by = {r.article_id: r for r in html.articles(df).collect()}
    r = by["a1"]
    assert (r.name, r.game_no, r.print_run, r.overall_odds, r.top_prize_value, str(r.on_sale)) == ("Gold Rush", 712, want, 3.52, 60000, "2026-07-02")
    assert by["a2"].game_no is None and by["a3"].name is None


def test_dates_and_tiles(spark):
    table = "<table class=tbstriped><tr><th>n</th></tr>" + tr("650", "Old", "March 1, 2026", "") + tr("650", "New", "April 2, 2026", "May 3, 2027") + tr("x", "y", "z", "w") + tr("1", "2", "3") + "</table>"
    r = html.scratch_dates(pages(spark, p=table)).collect()
    assert [(x.game_no, x.name, str(x.end_date), str(x.last_cash_date)) for x in r] == [(650, "New", "2026-04-02", "2027-05-03")]
    links = '<a href="/tools/whatsnew/index.php?topic=L&amp;id=77&amp;v=article"><h2>G</h2></a><a href="/tools/whatsnew/index.php?id=5&v=list">x</a><a href="/other?id=6&v=article">y</a><a href="whatsnew/index.php?id=77&v=article">again</a>'
    got = html.tile_prices(spark.createDataFrame([("scratch5dollar_2026.html", links), ("odd.html", "")], "file string, html string")).collect()
    assert [(x.article_id, x.price) for x in got] == [("77", 5.0)]


def test_history_and_panel(spark, tmp_path):
    for day, pu in (("2026-07-10", 10.0), ("2026-07-11", 0.0)):
        game = {"game_no": 7, "name": "A  B", "price": 1.0, "percent_unsold": pu, "total_unclaimed": 5.0, "top_prizes": [{"level": 1, "remaining": 2}]}
        (tmp_path / f"{day}.json").write_text(json.dumps({"as_of": day, "games": [game]}))
    daily = files.history(spark, f"{tmp_path}")
    archive = daily.filter("obs_date = '2026-07-10'").withColumn("source", F.lit("wayback")).withColumn("percent_unsold", F.lit(11.0))
    panel, log = files.panel_from(archive, daily)
    got = {r.obs_date: (r.source, r.percent_unsold, r.lifecycle_status) for r in panel.collect()}
    assert got == {"2026-07-10": ("daily", 10.0, "active"), "2026-07-11": ("daily", 0.0, "exited_observed")} and log.count() == 1
    assert {r.game_key for r in panel.collect()} == {"7:a-b"}
    out = f"{tmp_path}/out"
    files.write_jsonl(panel, out, ["obs_date", "game_no"])
    lines = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert len(lines) == 2 and list(lines[0]) == sorted(lines[0])
    assert all(list(tier) == ["level", "level_label", "remaining"] for line in lines for tier in line["top_prizes"])
    mixed = spark.sql("select named_struct('b', 1, 'a', array(named_struct('z', 1, 'y', cast(null as int)))) as s, 2 as k")
    files.write_jsonl(mixed, f"{tmp_path}/mixed", ["k"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/mixed").collect()] == ['{"k":2,"s":{"a":[{"y":null,"z":1}],"b":1}}']


def test_jsonl(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"task_id":"a","cost_usd_total":1.5}\n\n{broken\n{"task_id":"b"}\n')
    loose = files.jsonl(spark, f"file://{path}", schemas.COST_LOG, strict=False)
    assert sorted(r.task_id for r in loose.collect()) == ["a", "b"]
    with pytest.raises(Exception):  # noqa: B017
        files.jsonl(spark, f"file://{path}", schemas.COST_LOG).collect()
    assert files.jsonl(spark, f"file://{tmp_path}/none.jsonl", schemas.COST_LOG, strict=False).count() == 0


def test_captures(spark):
    rows = [["timestamp", "original", "digest", "statuscode"], ["20200102030405", "http://x", "d", "200"], ["20140102030405", "http://x", "e", "200"], ["bad", "http://x", "f", "200"]]
    got = files.captures(spark.createDataFrame([(json.dumps(rows),)], "value string")).collect()
    assert [r.status for r in got] == ["in_era", "era_skipped", "parse_failed"] and got[0].capture_ts == "2020-01-02T03:04:05+00:00" and got[0].capture_url.endswith("/20200102030405id_/http://x")
    with pytest.raises(Exception, match="no JSON list"):
        files.captures(spark.createDataFrame([("<html>",)], "value string")).collect()
    done = spark.createDataFrame([("ok", None), ("ok", None), ("era_skipped", None), ("parse_failed", "why")], "status string, detail string")
    r = files.backfill_summary(done).collect()[0]
    assert (r.captures_total, r.parsed, r.era_skipped, r.parse_failed, r.failures) == (4, 2, 1, 1, ["why"])


def test_settings_and_attachments(spark, tmp_path):
    lines = ['A="x # y" # c', "B=plain # c", "# C=1", "", "no sign", "A='z'", "D=\"open", "E="]
    got = {r.key: r.value for r in files.settings(spark.createDataFrame(list(enumerate(lines)), "ordinal long, value string")).collect()}
    assert got == {"A": "z", "B": "plain", "D": "open", "E": ""}
    for name, data in (("a.png", b"\x89P"), ("b.txt", "é".encode()), ("c.bin", b"\xff\xfe\xfa"), ("d.mp3", b"123")):
        (tmp_path / name).write_bytes(data)
    raw = spark.read.format("binaryFile").load(f"{tmp_path}")
    by = {r.path.split("/")[-1]: r for r in files.attachments(raw).collect()}
    assert by["a.png"].payload == "data:image/png;base64,iVA=" and by["b.txt"].payload.startswith("===== ATTACHED FILE: b.txt =====\né\n") and by["c.bin"].error == "unsupported type" and (by["d.mp3"].type, by["d.mp3"].payload) == ("input_audio", "MTIz")
    assert files.total_size(raw).collect()[0].passed


def test_metadata(spark):
    a = spark.createDataFrame([(1, "art", 100, "x1"), (2, "", None, "x2"), (None, "lost", 5, "x3"), (9, "later", 7, "x9")], "game_no long, name string, print_run long, article_id string")
    s = spark.createDataFrame([(1, "s1", 5.0), (2, "s2", 6.0), (3, "s3", 7.0)], "game_no long, name string, price double")
    d = spark.createDataFrame([(3, "d3", None, None), (8, "d8", None, None)], "game_no long, name string, end_date date, last_cash_date date")
    t = spark.createDataFrame([("x1", 4.0), ("x2", 6.0)], "article_id string, price double")
    m = meta.merged(a, s, d, t)
    assert {r.game_no: (r.name, r.price) for r in m.collect()} == {1: ("art", 4.0), 2: ("s2", 6.0), 3: ("s3", 7.0), 9: ("later", None)}
    assert [tuple(r) for r in meta.price_conflicts(m).collect()] == [(1, 4.0, 5.0)]
    c = meta.coverage(m).collect()[0]
    assert (c.active_games, c.with_print_run, c.coverage_pct, c.passed) == (3, 1, 33.3, False)


def test_documents(spark, tmp_path):
    rows = spark.createDataFrame([("2026-07-11", 9, None, 2e7), ("2026-07-11", 2, "b", 0.5)], "as_of string, game_no long, name string, money double")
    to, history = tmp_path / "latest.json", tmp_path / "history"
    files.write_document(rows, f"file://{to}", history=f"file://{history}")
    want = {"as_of": "2026-07-11", "games": [{"game_no": 2, "name": "b", "money": 0.5}, {"game_no": 9, "name": None, "money": 2e7}]}
    assert to.read_text().rstrip("\n") == json.dumps(want, indent=2)
    assert (history / "2026-07-11.json").read_bytes() == to.read_bytes()
    files.write_document(rows.filter("game_no = 2"), f"file://{to}", history=f"file://{history}")
    assert len(json.loads(to.read_text())["games"]) == 1 and (history / "2026-07-11.json").read_bytes() == to.read_bytes()
    with pytest.raises(ValueError):
        files.write_document(rows.withColumn("as_of", F.col("game_no").cast("string")), f"file://{to}")
    assert len(json.loads(to.read_text())["games"]) == 1 and {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"latest.json", "history"}
    got = files.document(spark, f"{to}", "as_of string, games array<struct<game_no:long,name:string>>").collect()
    assert [(g.game_no, g.name) for g in got[0].games] == [(2, "b")]
    for name in ("b.html", "a.html"):
        (tmp_path / name).write_text(name)
    assert files.first_file(files.whole_text(spark, f"{tmp_path}/*.html")).collect()[0].html == "a.html"


def test_streams(spark, tmp_path):
    rows = spark.sql("select id % 5 as k, timestamp'2026-01-01' + make_interval(0,0,0,0,0,0,id) as ts, 'e' as event_type, cast(id as double) value from range(20)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = history.observations(spark, f"{tmp_path}/in", "k bigint, ts timestamp, event_type string, value double")
    for _ in range(2):
        history.run_once(history.deduplicated(stream, ["k"]), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    verdicts = spark.createDataFrame([("t", "plan", "PASS", 1.0, False), ("t", "plan", "PASS", 1.0, False), ("u", "plan", "PASS", 2.0, False)], schemas.COST_LOG)
    verdicts.write.parquet(f"{tmp_path}/v")
    for k in range(2):
        history.log_costs(spark.readStream.schema(schemas.COST_LOG).parquet(f"{tmp_path}/v"), f"file://{tmp_path}/log", f"{tmp_path}/cp{k}")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


def test_article_provenance(spark, tmp_path):
    (tmp_path / "PROVENANCE.json").write_text(json.dumps({"11": {"source": "wayback", "url": "u"}, "12": {"url": "u"}, "99": {"source": "live"}}, indent=1))
    found = files.provenance(spark, str(tmp_path / "PROVENANCE.json"))
    articles = spark.createDataFrame([("11", 1, "A", 10), ("12", 2, "B", 20), ("13", 3, "C", 30)], "article_id string, game_no long, name string, print_run long")
    got = meta.with_source(articles, found)
    assert {r.article_id: r.source for r in got.collect()} == {"11": "wayback", "12": None, "13": None}
    games = spark.createDataFrame([(1, "A", 5.0), (4, "D", 5.0)], "game_no long, name string, price double")
    dates = spark.createDataFrame([], "game_no long, name string, end_date date, last_cash_date date")
    tiles = spark.createDataFrame([], "article_id string, price double")
    assert {r.game_no: r.source for r in meta.merged(got, games, dates, tiles).collect()} == {1: "wayback", 2: None, 3: None, 4: None}
    assert files.provenance(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="MALFORMED"):
        files.provenance(spark, str(tmp_path / "bad.json")).collect()


def test_titles_as_written(spark, tmp_path):
    from scoreloom.plans import catalog

    heads = {1: " A &amp;&amp; B ", 2: "cut &amp", 3: "say &quot;x&quot; &#65; &lt;", 4: "&amp;quot;", 5: "plain"}
    rows = [(k, f"<p>p</p><h1>{h}</h1><h1>later</h1>") for k, h in heads.items()]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.title for r in catalog.QUERIES["html_title"](spark, f"{tmp_path}").collect()}
    assert got == {1: "A && B", 2: "cut &amp", 3: "say &quot;x&quot; &#65; &lt;", 4: "&quot;", 5: "plain"}


def test_pages_are_scanned_once_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    games, errors = html.snapshots(pages(spark, ok=HEAD + GAME + MORE + "</table>"))
    for df in (games, errors):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow scan") + plan.count("MapInArrow run") == 1 and "EvalPython" not in plan
    if spark.sparkContext.getConf().get("spark.sql.execution.arrow.maxBytesPerBatch") is None:
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)


def test_items_are_given_on_by_the_megabyte(spark, monkeypatch):
    """The items of a batch never stand in Python all at once: they go on with each MB of pages, whole and in order."""
    df, calls = pages(spark, a="x"), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: calls.append(run) or self)
    html.scanned(df, ["page"], kinds=("p", "text"))
    keys = [f"{k}" for k in range(60)]
    texts = [None if k % 7 == 0 else f"<p>{k}</p>" + "x" * 100_000 for k in range(60)]
    given = list(calls[0](iter([pa.record_batch({"page": keys, "html": texts})])))
    assert [key for part in given for key in part.column("page").to_pylist()] == keys
    found = [items for part in given for items in part.column("found").to_pylist()]
    assert [[tuple(i.values()) for i in items] for items in found] == [html.scan(text) for text in texts]
    assert len(given) >= 5 and max(part.num_rows for part in given) <= 13  # 11 pages and the nulls among them


def test_documents_are_rendered_game_by_game(spark, monkeypatch):
    """The text is json.dumps' own, and no call of the rendering function sees more than a game."""
    rows = [("2026-07-10", 7, "é \"x\"\nz", 1e7, [{"level": 1, "label": None}]), ("2026-07-10", 2, "b", 0.1, []), ("2026-07-11", 1, None, None, None)]
    df = spark.createDataFrame(rows, "as_of string, game_no long, name string, price double, top array<struct<level:long,label:string>>")
    got = {r.as_of: r.value for r in files.document_text(df.withColumn("as_of", F.to_date("as_of"))).selectExpr("string(as_of) as as_of", "value").collect()}
    for day in got:
        games = [{"game_no": g, "name": n, "price": p, "top": t} for d, g, n, p, t in sorted(rows, key=lambda r: r[1]) if d == day]
        assert got[day] == json.dumps({"as_of": day, "games": games}, indent=2)
    plan = files.document_text(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("indented(") > plan.index("Aggregate")  # below the aggregation, where a row is a game
