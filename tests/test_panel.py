"""The panel: supersession, lifecycles, windows, and the lag study."""

import hashlib
import inspect
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import kernel, panel
from scoreloom.plans import catalog

ROWS = "game_key string, obs_date string, capture_ts string, capture_url string, percent_unsold double, total_unclaimed double"


def make(spark, rows):
    return spark.createDataFrame([(k, d, t, f"u{n}", p, 1000.0 * p) for n, (k, d, t, p) in enumerate(rows)], ROWS)


def status(spark, rows):
    return {(r.game_key, r.obs_date): r.lifecycle_status for r in panel.with_lifecycle(make(spark, rows)).collect()}


def test_later_capture_supersedes(spark):
    rows = make(spark, [("706:a", "2026-06-01", "2026-06-01T00", 5.0), ("706:a", "2026-06-01", "2026-06-01T12", 4.5)])
    assert [r.percent_unsold for r in panel.deduped(rows, ["capture_url"]).collect()] == [4.5]
    log = panel.superseded(rows, ["capture_url"]).collect()
    assert [(r.superseded_capture_url, r.kept_capture_url) for r in log] == [("u0", "u1")]


def test_ties_go_to_the_later_row(spark):
    rows = make(spark, [("1:a", "2026-06-01", "t", 5.0), ("1:a", "2026-06-01", "t", 4.0)])
    assert [r.capture_url for r in panel.deduped(rows, ["capture_url"]).collect()] == ["u1"]


def test_lifecycles(spark):
    assert status(spark, [("706", "2026-01-01", "t", 10.0), ("706", "2026-02-01", "t", 8.0)]) == {("706", "2026-01-01"): "active", ("706", "2026-02-01"): "active"}
    assert status(spark, [("651", "2026-01-01", "t", 10.0), ("651", "2026-02-01", "t", 0.0)])[("651", "2026-02-01")] == "exited_observed"
    assert status(spark, [("800", "2026-01-01", "t", 1.0), ("801", "2026-01-01", "t", 1.0), ("801", "2026-02-01", "t", 1.0)])[("800", "2026-01-01")] == "exited_unobserved"
    reused = status(spark, [("399:old", "2017-01-01", "t", 1.0), ("399:new", "2021-01-01", "t", 1.0)])
    assert reused == {("399:old", "2017-01-01"): "exited_unobserved", ("399:new", "2021-01-01"): "active"}


def test_keys_and_intervals(spark):
    r = spark.sql("select 399 n, '  Lucky  7s  Big ' name, 0.0D pu").select(panel.game_key(F.col("n"), F.col("name")).alias("k"), panel.pu_interval(F.col("pu")).alias("i")).collect()[0]
    assert r.k == "399:lucky-7s-big" and (r.i.lo, r.i.hi) == (0.0, 0.05)


def test_windows_and_pairs(spark):
    rows = make(spark, [("a", f"2026-01-{d:02d}", "t", float(p)) for d, p in ((1, 90), (5, 80), (9, 78), (21, 40))])
    w = panel.windows(rows.withColumn("obs_date", F.to_date("obs_date")))
    assert sorted(r.dt for r in w.collect()) == [4, 4, 12]
    p = kernel.pairs(kernel.demeaned(w))
    assert p.count() == 3 and all(r.lag > 0 for r in p.collect())


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 2.0), (0, 3.0, 5.0), (0, 3.0, 9.0)], "bin int, s double, d double")
    r = kernel.spearman(df).collect()[0]
    assert r.n_pairs == 4 and abs(r.rho - 8 / 9) < 1e-6


def test_permutation_finds_an_echo(spark):
    """Claims that follow sales one window later are found; shuffled ones are not."""
    import random

    g = random.Random(5)
    rows = []
    for game in range(60):
        pu, u, sold = 100.0, 1e6, [g.choice([1.0, 6.0]) for _ in range(12)]
        for k in range(12):
            rows.append((f"g{game}", f"2026-{1 + k // 4:02d}-{1 + 7 * (k % 4):02d}", "t", "u", pu, u))
            pu, u = pu - sold[k], u - (sold[k - 1] * 9000 if k else 20000)
    w = panel.windows(spark.createDataFrame(rows, ROWS).withColumn("obs_date", F.to_date("obs_date")))
    got = {r.bin: r for r in kernel.permutation(kernel.demeaned(w), reps=60, bins=((0, 8.5), (8.5, 400))).collect()}
    assert got[0].rho > 0.5 and got[0].p < 0.05


def test_permutation_query_repeats_a_thousand_times(spark, monkeypatch):
    rule, seen = inspect.signature(kernel.permutation), []

    def told(*args, **given):
        bound = rule.bind(*args, **given)
        bound.apply_defaults()
        seen.append(bound.arguments["reps"])
        return spark.createDataFrame([], "bin int, n_pairs long, rho double, p double")

    monkeypatch.setattr(kernel, "permutation", told)
    catalog.QUERIES["permutation_test"](spark, "/root/testdata/sf0.001")
    assert seen[0] >= 1000


def _rho(rows):
    def ranks(v):
        return [sum(y < x for y in v) + (v.count(x) + 1) / 2 for x in v]

    a, b = ranks([r[0] for r in rows]), ranks([r[1] for r in rows])
    m = (len(rows) + 1) / 2
    over = sum((x - m) * (y - m) for x, y in zip(a, b, strict=True))
    return over / (sum((x - m) ** 2 for x in a) * sum((y - m) ** 2 for y in b)) ** 0.5


@pytest.mark.parametrize("reps", [7, 60])
def test_permutation_against_brute_force(spark, reps):
    g, bins = random.Random(2), ((0, 8), (8, 20))
    rows = []
    for game in range(25):
        for day in sorted(g.sample(range(1, 29), g.randint(1, 6))):
            rows.append((f"g{game}", f"2026-01-{day:02d}", "t", "u", float(g.randint(0, 9)), float(g.randint(1, 6))))
    w = kernel.demeaned(panel.windows(spark.createDataFrame(rows, ROWS).withColumn("obs_date", F.to_date("obs_date"))))
    w = spark.createDataFrame(w.collect(), w.schema)
    got = {r.bin: r for r in kernel.permutation(w, reps=reps, least=5, bins=bins).collect()}
    own = {}
    for r in sorted(w.collect(), key=lambda r: r.w_start):
        own.setdefault(r.game_key, []).append(r)
    pairs = []  # bin, s, game, place of d
    for game, ws in own.items():
        for a in ws:
            for k, b in enumerate(ws):
                lag = (b.w_start - a.w_start).days + (b.dt - a.dt) / 2
                pairs += [(n, a.s, game, k) for n, (lo, hi) in enumerate(bins) if b.w_start >= a.w_end and lo < lag <= hi]

    def shift(game, rep):
        prime = 2**31 - 1
        seed = int(hashlib.md5(game.encode()).hexdigest()[:8], 16) % prime
        x = ((seed + 7919 * (rep + 1)) % prime) ** 2 + rep
        return 1 + ((x % prime) ** 2 + seed) % prime % (len(own[game]) - 1)

    def rhos(rep):
        move = {x: shift(x, rep) if rep is not None and len(ws) > 1 else 0 for x, ws in own.items()}
        return [_rho([(s, own[x][(k + move[x]) % len(own[x])].d) for n, s, x, k in pairs if n == b]) for b in range(len(bins))]

    real, tops = rhos(None), [max(map(abs, rhos(rep))) for rep in range(reps)]
    assert len(got) == 2
    for b, r in got.items():
        assert r.n_pairs == sum(p[0] == b for p in pairs) and abs(r.rho - real[b]) < 1e-9
        assert abs(r.p - sum(t >= abs(real[b]) - 1e-9 for t in tops) / reps) < 1e-12
    assert any(0 < r.p < 1 for r in got.values())


def test_permutation_goes_through_the_responses_once(spark):
    """Batches of three windows, with responses that are tied across them and unknown, come to the same as one batch; there is one pass, and no group is held."""
    g = random.Random(4)
    rows = [(f"g{game}", f"2026-01-{day:02d}", "t", "u", float(g.randint(0, 9)), float(g.randint(0, 2)) if game else 0.0) for game in range(20) for day in range(1, 20, 2)]
    w = kernel.demeaned(panel.windows(spark.createDataFrame(rows, ROWS).withColumn("obs_date", F.to_date("obs_date"))))
    w = spark.createDataFrame(w.withColumn("d", F.when(F.col("game_key") != "g3", F.round("d", 1))).collect(), w.schema)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = kernel.permutation(w, reps=9, least=5, bins=((0, 8), (8, 20)))
    plan = whole._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 1 and "CoGroup" not in plan
    want, had = sorted(map(tuple, whole.collect())), spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        got = sorted(map(tuple, kernel.permutation(w, reps=9, least=5, bins=((0, 8), (8, 20))).collect()))
    finally:
        spark.conf.set(name, had)
    assert len(want) == 2 and got == want
    assert kernel.permutation(w, reps=9, least=10**6, bins=((0, 8),)).count() == 0


def test_quantile_by_histograms(spark):
    """Between two values in proportion, for ties, weights, single values, and values far apart and next to each other."""
    g = random.Random(6)
    cases = {0: [5.0], 1: [g.choice([1.0, 2.0]) for _ in range(99)], 2: [g.uniform(-1, 1) ** 9 for _ in range(300)], 3: [1e308, -1e308, 0.0, 1.0, 5e-324], 4: [1 + k * 2**-52 for k in range(700)], 5: [0.0, -0.0, 7.0]}
    rows = [(k, x, g.randint(1, 3)) for k, v in cases.items() for x in v]
    frame = spark.createDataFrame([*rows, (0, None, 9)], "bin int, x double, n long").repartition(3)
    for q in (0.0, 0.5, 0.9, 1.0):
        got = {r["bin"]: r["value"] for r in kernel.quantile(frame, "bin", "x", q, "n").collect()}
        for k in cases:
            whole = sorted(x for b, x, n in rows if b == k for _ in range(n))
            at = (len(whole) - 1) * q
            low, high = whole[int(at)], whole[min(len(whole) - 1, int(at) + 1)]
            assert got[k] == low + (high - low) * (at - int(at))
    assert kernel.quantile(frame.filter("false"), "bin", "x", 0.5, "n").count() == 0


def test_panel_inventory_by_source(spark):
    tiers = "array<struct<level:bigint,level_label:string,remaining:bigint>>"
    rows = [("a", "t1", "wayback", "active", [(None, "car", 1), (5, None, 2)]), ("b", "t1", "wayback", "active", [(5, None, 2)]), ("a", "t2", "daily", "exited_observed", [(None, "trip", 0)]), ("c", "t3", None, "active", None)]
    df = spark.createDataFrame(rows, f"game_key string, capture_ts string, source string, lifecycle_status string, top_prizes {tiers}")
    got = {r.source: (r.records, r.captures, r.lifecycles, r.active, r.noncash) for r in panel.inventory(df, "source").collect()}
    assert got == {"wayback": (2, 1, 2, 2, 1), "daily": (1, 1, 1, 0, 1), None: (1, 1, 1, 1, 0)}
    whole = panel.inventory(df).collect()[0]
    assert (whole.records, whole.lifecycles, whole.noncash) == (4, 3, 2)
    assert [r.noncash for r in panel.inventory(df.limit(0)).collect()] == [0]
