"""Reviews: tolerant reading, unions, disputes, fail-closed verdicts; costs and loops."""

import json

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import num
from scoreloom.functions import text as T
from scoreloom.operators import config, cost, findings, gates, opinions

FIND = "task_id string, ord bigint, slug string, issue string, severity string, file string, line string, stance string"
RULE = "task_id string, ord bigint, id string, ruling string"


def verdict(spark, rows, rulings=()):
    found = findings.union(spark.createDataFrame(rows, FIND))
    return findings.verdicts(findings.ruled(found, spark.createDataFrame(list(rulings), RULE))).collect()[0]


def row(n, slug, severity, issue="Leak", line="3", stance=None):
    return ("t", n, slug, issue, severity, "a.py", line, stance)


def test_same_finding_is_one(spark):
    r = verdict(spark, [row(1, "x", "major"), row(2, "y", "major", " leak ")])
    assert (r.findings, r.disputed, r.verdict) == (1, 0, "REVISE")


@pytest.mark.parametrize(("rulings", "want"), [([("t", 1, "F1", "upheld")], "FAIL"), ([("t", 1, "F1", "rejected")], "PASS"), ([], "FAIL"), ([("t", 1, "F1", "perhaps")], "FAIL"), ([("t", 1, "F1", "rejected"), ("t", 2, "F1", "upheld")], "FAIL"), ([("t", 1, None, "rejected")], "FAIL")])
def test_disputes_fail_closed(spark, rulings, want):
    assert verdict(spark, [row(1, "x", "critical"), row(2, "y", "minor")], rulings).verdict == want


def test_union_order_lines_and_stances(spark):
    rows = [row(1, "x", "minor", "b"), row(2, "y", "critical", "a", "abc"), row(3, "z", "unknown", "c"), row(4, "x", "minor", "d", None, "not_an_issue"), row(5, "y", "minor", "d", None)]
    got = findings.union(spark.createDataFrame(rows, FIND)).orderBy("id").collect()
    assert [(r.id, r.issue, r.line, r.disputed) for r in got] == [("F1", "a", 0, False), ("F2", "b", 3, False), ("F3", "d", 0, True)]


def test_opinions(spark):
    want = {
        json.dumps({"analysis": " fine ", "findings": 1}): ("json", "fine", ""),
        "```json\n{\"summary\": \"s\"}\n```": ("fenced-json", "s", ""),
        'So: {"summary": "a } b", "x": "\\"}"} and {': ("embedded-json", "a } b", ""),
        'Bad ```[1]``` good ```{"decision": " go "}```': ("fenced-json", "go", "go"),
        json.dumps({"findings": [{"issue": "a"}, "b", {"title": "c"}, 7, None, {"issue": "d"}]}): ("json", "4 finding(s): a; b; c (+1 more)", ""),
        json.dumps({"findings": [{"severity": "major"}], "advice": 5}): ("json", "(structured findings only; no summary field returned)", ""),
        '{"summary": "x", "summary": "last", "confidence": NaN}': ("json", "last", ""),
        "x" * 40: ("prose", "x" * 40, ""),
        "y" * 5000: ("prose", "y" * 1200, ""),
        "no": ("noise", None, None),
        "[1, 2]": ("noise", None, None),
        "{}": ("noise", None, None),
        '{"summary": 3}': ("noise", None, None),
        "  ": ("empty", None, None),
        None: ("empty", None, None),
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(want)], "k int, content string")
    got = {r.k: r for r in opinions.read(df).collect()}
    for k, (note, summary, advice) in enumerate(want.values()):
        assert (got[k].note, got[k].summary, got[k].recommendation) == (note, summary, advice), k
        assert (got[k].payload is None) == (note in ("noise", "empty"))
    rows = [("t", 0, "m", json.dumps({"summary": "s", "confidence": 3, "plan": "p"}), None, 2, None), ("t", 1, "m", "", 1, 1, 0.5)]
    made = spark.createDataFrame(rows, "task_id string, idx int, slug string, content string, tokens_in long, tokens_out long, cost_usd double")
    assert [tuple(r) for r in opinions.projected(opinions.read(made)).collect()] == [("t", 0, "m", "s", "", "p", 1.0, 0, 2, 0.0)]


def test_odd_members_lose_no_finding(spark):
    critical = {"severity": "critical", "issue": "rce", "line": 3.7}
    payloads = [json.dumps({"findings": ["just text", critical, 7, None, [1], {"severity": 5}]}), '{"findings": {"severity": "critical"}}', '{"findings": [', "[1]"]
    entries = spark.createDataFrame([("t", k, f"m{k}", p, "json") for k, p in enumerate(payloads)], "task_id string, idx int, slug string, payload string, note string")
    rows = [r for r in findings.exploded(entries).collect() if r.severity == "critical"]
    assert [(r.slug, r.issue, r.line) for r in rows] == [("m0", "rce", "3")]
    got = findings.review(entries, spark.createDataFrame([], RULE)).collect()[0]
    assert (got.verdict, got.survivors, got.dropped) == ("FAIL", 2, ["m2", "m3"])


def test_unknown_costs_breach(spark):
    calls = spark.createDataFrame([("a", "m", 1e6, 1e6, None, None, None), ("b", "none", 1e6, 1e6, None, None, None), ("c", "none", 1e6, 1e6, None, 0.1, 0.2), ("d", "m", 1e6, 1e6, -1.0, 0.1, None)], "task_id string, model string, tokens_in double, tokens_out double, cost_usd double, own_in_per_1m double, own_out_per_1m double")
    prices = spark.createDataFrame([("m", 0.3, 0.4), ("m", 0.1, 9.0)], "slug string, in_per_1m double, out_per_1m double")
    got = {r.task_id: (r.calls, r.unmetered, round(r.cost_usd_total, 6), r.cost_cap_breached) for r in cost.totals(cost.metered(calls, prices), 1.0).collect()}
    assert got == {"a": (1, 0, 0.7, False), "b": (1, 1, 0.0, True), "c": (1, 0, 0.3, False), "d": (1, 0, 0.7, False)}


def test_the_last_prior_row_counts(spark):
    today = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "game_no int, ev_ratio double")
    prior = spark.createDataFrame([(1, 9.0, 0), (1, 1.1, 1), (2, 1.0, 0), (2, None, 1), (3, 5.0, 0)], "game_no int, ev_ratio double, place int")
    assert tuple(gates.diff_gate(today, prior, order="place").collect()[0]) == (2, 1, False)


def test_reviews(spark):
    good = json.dumps({"summary": "s", "findings": [{"severity": "major", "issue": "i", "file": "f", "line": 2}]})
    clean, odd = json.dumps({"summary": "ok", "findings": []}), json.dumps({"summary": "s", "findings": 1})
    prose = "This reads well enough to me, nothing else to add."
    answers = {"two": [good, clean], "one": [good, "?"], "prose": [prose, prose], "mixed": [clean, prose], "none": ["", None], "odd": [odd, odd]}
    rows = [(t, k, f"m{k}", a) for t, own in answers.items() for k, a in enumerate(own)]
    entries = spark.createDataFrame(rows, "task_id string, idx int, slug string, content string")
    entries = opinions.read(entries)
    got = {r.task_id: r for r in findings.review(entries, spark.createDataFrame([], RULE)).collect()}
    assert {t: r.verdict for t, r in got.items()} == {"two": "REVISE", "one": "REVISE", "prose": "REVISE", "mixed": "PASS", "none": "REVISE", "odd": "PASS"}
    assert got["one"].dropped == ["m1"] and got["one"].blind_spots == ["dropped expert: m1 — no usable output"]
    assert [r.label for r in findings.survivors(entries).filter("task_id = 'two'").orderBy("idx").collect()] == ["A", "B"]
    d = findings.diagnostics(entries.withColumn("content", F.repeat(F.lit("z"), 5000))).first()
    assert len(d.preview) == 4000 and d.truncated


def test_exit_codes(spark):
    rows = [("PASS", False, 0), ("FAIL", False, 1), ("REVISE", False, 2), ("PASS", True, 2), ("FAIL", True, 2), ("odd", False, 3), (None, None, 3)]
    df = spark.createDataFrame(rows, "v string, b boolean, want int").withColumn("got", findings.exit_code(F.col("v"), F.col("b")))
    assert df.filter("got <> want").count() == 0


def test_costs(spark):
    prices = spark.createDataFrame([("m", 0.435, 0.87)], "slug string, in_per_1m double, out_per_1m double")
    rows = [("a", "m", 1e6, 1e6, None), ("b", "m", 1e6, 1e6, -1.0), ("c", "m", 1e6, 1e6, float("nan")), ("d", "m", 1e6, 1e6, float("inf")), ("e", "x", 1.0, 1.0, 0.0123), ("e", "x", 1.0, 1.0, 0.02), ("f", "x", 1.0, 1.0, None)]
    got = {r.task_id: r for r in cost.totals(cost.metered(spark.createDataFrame(rows, "task_id string, model string, tokens_in double, tokens_out double, cost_usd double"), prices), 1.305).collect()}
    assert all(got[k].cost_usd_total == 1.305 and not got[k].cost_cap_breached for k in "abcd")
    assert got["e"].cost_usd_total == 0.0323 and got["f"].unmetered == 1


def test_cost_log(spark):
    v = spark.createDataFrame([("t1", 0.9), ("t1", 0.9), ("t2", 0.5), (None, None)], "task_id string, cost_usd_total double")
    log = cost.new_entries(v, v.limit(0))
    assert log.count() == 3 and cost.new_entries(v, log).count() == 0
    t = cost.tally(log.filter("task_id is not null").withColumn("ordinal", F.col("task_id"))).collect()[0]
    assert (t.entries, t.total_usd, t.latest) == (2, 1.4, "t2")


def test_loops_and_judges(spark):
    a = spark.createDataFrame([(1, 1, False, 5, 40), (1, 2, True, 9, 40), (1, 3, False, 9, 40), (2, 1, False, 3, 100), (2, 2, False, 4, 1)], "loop_id int, n int, passed boolean, score int, cost int")
    assert [r.allowed for r in cost.budgeted(a, 3, 100).orderBy("loop_id", "n").collect()] == [True, True, False, True, False]
    got = {r.loop_id: (r.status, r.best_n) for r in cost.loop_result(a).collect()}
    assert got == {1: ("PASS", 2), 2: ("EXHAUSTED", 2)}
    pool = spark.createDataFrame([("a/x", 0), ("b/y", 1)], "judge string, ordinal int")
    g = spark.createDataFrame([("A/m", None), ("A/m", "a/z"), ("c/m", "d/q"), ("c/m", "")], "generator string, preferred string")
    assert sorted(r.judge for r in cost.judged_by(g, pool).collect()) == ["a/x", "b/y", "b/y", "d/q"]
    times = spark.range(1).select(cost.frame_times(F.lit(10.0), F.lit(3)).alias("t"), cost.frame_times(F.lit(0.0), F.lit(1)).alias("u")).collect()[0]
    assert times.t == [0.1, 5.0, 9.9] and len(times.u) == 2
    assert num.backoff() == [0.5, 1.0, 2.0] and num.backoff(9) == [0.5, 1, 2, 4, 8]


def test_errors_and_words(spark):
    df = spark.createDataFrame([(200, "429", "transient"), (503, "400", "terminal"), (408, None, "transient"), (None, None, "terminal"), (502, "x", "transient")], "s int, c string, want string")
    assert df.filter(T.error_class(F.col("s"), F.col("c")) != F.col("want")).count() == 0
    r = spark.range(1).select(T.listed(F.lit(" a, ,b ,")).alias("l"), T.money(F.lit(" $1,234.50 ")).alias("m"), T.money(F.lit("n/a")).alias("bad"), T.family(F.lit("Open/x/y")).alias("f"), T.page_date(F.lit(" July 11, 2026 7:05 AM ")).alias("d"), T.month_day(F.lit("Smarch 1, 2020")).alias("n"), T.truthy(F.lit(" Yes")).alias("t")).collect()[0]
    assert (r.l, r.m, r.bad, r.f, str(r.d), r.n, r.t) == (["a", "b"], 1234.5, None, "open", "2026-07-11", None, True)


def test_settings(spark):
    kinds = {"A": "int", "B": "number", "C": "switch", "D": ("x", "y"), "E": "text"}
    rows = [("A", " 07 ", "7"), ("A", "0", None), ("A", "1.5", None), ("B", "1e-3", "1e-3"), ("B", "nan", None), ("B", "inf", None), ("B", "0", None), ("C", "ON", "1"), ("C", "no", "0"), ("C", "2", None), ("D", "x ", "x"), ("D", "z", None), ("E", "a b", "a b"), ("E", "a`b", None), ("E", "  ", None), ("F", "x", None)]
    got = config.validated(spark.createDataFrame(rows, "key string, value string, want string"), kinds)
    assert got.filter("not (clean <=> want)").count() == 0
    assert {r.error for r in got.filter("key = 'F'").collect()} == {"not editable"}
    r = spark.range(1).select(config.number_or(F.lit("inf"), 2.0).alias("n"), config.form_value(F.array(F.lit("a"), F.lit("b")), F.lit(True)).alias("l"), config.form_value(F.array(F.lit("a"), F.lit("b")), F.lit(False)).alias("s"), config.with_prefix(F.array(F.lit("xa"), F.lit("b")), "x").alias("p")).collect()[0]
    assert (r.n, r.l, r.s, r.p) == (2.0, "a,b", "b", ["xa"])
    names = spark.createDataFrame([("v20.9.0",), ("v20.10.1",), ("v18.99.9",), ("vx",), ("v21",)], "name string")
    assert config.newest(names).collect()[0].name == "v20.10.1"


def test_contradictions(spark):
    body = json.dumps({"contradictions": [{"topic": "t", "positions": [{"label": "A", "stance": "s"}]}, "loose", {"positions": 1}]})
    df = spark.createDataFrame([(body,), ('{"contradictions": "x"}',), ("{}",)], "p string").select(config.contradictions(F.col("p")).alias("c"))
    got = [[(c.topic, [tuple(p) for p in c.positions]) for c in r.c] for r in df.collect()]
    assert got == [[("t", [("A", "s")]), ("loose", []), ("", [])], [], []]


def test_sound_is_never_passed_unheard(spark):
    rows = [("PASS", "clear music", [], "REVISE"), ("PASS", "bright", [], "PASS"), ("PASS", "voice", [("audio", "quiet")], "PASS"), ("REVISE", "hum", [], "REVISE"), ("PASS", "sound", None, "REVISE")]
    df = spark.createDataFrame(rows, "v string, c string, d array<struct<criterion:string,problem:string>>, want string")
    assert df.filter(cost.guarded(F.col("v"), F.col("c"), F.col("d")) != F.col("want")).count() == 0
    assert df.select(cost.defect_text(F.col("d")).alias("t")).collect()[2].t == "audio: quiet"


def test_an_answer_that_overflows_is_no_acquittal(spark):
    """Numbers beyond all bounds, NaN, endless digits, repeated keys and too deep objects: the critical finding counts or the answer is lost."""
    bad = '"findings":[{"severity":"critical","issue":"x"}]'
    clean = '{"summary":"fine","findings":[]}'
    strange = ["1e999", "-1e999", "NaN", "9" * 5000, "[" * 30 + "]" * 30]
    deep = "[" * 100_000 + "]" * 100_000
    rows = [(f"t{k}", 0, "a", f'{{{bad},"big":{x}}}') for k, x in enumerate([*strange, deep])] + [("twice", 0, "a", f'{{"findings":[],{bad}}}')]
    rows += [(t, k, s, clean) for t, *_ in rows for k, s in ((1, "b"), (2, "c"))]
    answers = spark.createDataFrame(rows, "task_id string, idx int, slug string, content string")
    none = spark.createDataFrame([], RULE)
    got = {r["task_id"]: r for r in findings.review(opinions.read(answers), none).collect()}
    assert {t: r["verdict"] for t, r in got.items() if t != "t5"} == dict.fromkeys(["t0", "t1", "t2", "t3", "t4", "twice"], "FAIL")
    assert got["t5"]["survivors"] == 2 and len(got["t5"]["blind_spots"]) == 1
    raw = answers.select("task_id", "idx", "slug", F.col("content").alias("payload"), F.lit("json").alias("note"))
    got = {r["task_id"]: r["verdict"] for r in findings.review(raw, none).collect()}
    assert {t: v for t, v in got.items() if t != "t5"} == dict.fromkeys(["t0", "t1", "t2", "t3", "t4", "twice"], "FAIL")


def test_answers_go_through_python_once_a_reader(spark):
    """A filter on the payload isn't pushed below the readers: two of them for each of review's two branches, not four."""
    raw = spark.createDataFrame([("t", 0, "m0", '{"summary":"s"}'), ("t", 1, "m1", "x")], "task_id string, idx int, slug string, content string")
    kept = findings.readable(opinions.read(raw)).filter("payload is not null")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    assert [r.idx for r in kept.collect()] == [0]


def test_whole_answers_reach_python_in_small_batches(spark, tmp_path):
    """A batch is bounded by its bytes and not by its rows alone, so long answers don't add up in a worker."""
    from scoreloom.plans import catalog

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name) is not None:
        pytest.skip("the session says how large batches may be")
    spark.conf.unset(name)
    spark.range(100).select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"), F.repeat(F.lit("x"), F.lit(50_000)).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    out = catalog.QUERIES["diagnostic_whole"](spark, f"{tmp_path}")

    @F.pandas_udf("long")
    def given(texts):
        return texts.str.len() * 0 + texts.str.len().sum()

    seen = spark.read.parquet(f"{tmp_path}/conversations.parquet").select(given(F.repeat("text", F.lit(8))).alias("n")).collect()
    assert len(seen) == 100 and max(r.n for r in seen) <= (4 << 20) + 400_000
    assert {(r.survived, r.truncated) for r in out.collect()} == {(True, True)} and out.count() == 100


def test_mixed_reviews_ask_python_once_a_branch(spark):
    from scoreloom.plans import catalog

    plan = catalog.QUERIES["review_mixed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
