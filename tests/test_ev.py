"""Worked rows of the value core, scores, intervals and gates."""

import datetime as dt

import pytest

from scoreloom.operators import ev, gates, score, views
from scoreloom.schemas import LATEST_RULES, TIERS

DAY = dt.date(2026, 7, 11)
SNAP = f"as_of date, game_no bigint, name string, price double, percent_unsold double, total_unclaimed double, top_prizes {TIERS}"
META = "game_no bigint, print_run bigint, top_prize_value bigint, overall_odds double"


def tiers(text):
    return [(int(a), None, int(b)) for a, b in (x.split(":") for x in text.split())]


GAMES = [
    (DAY, 720, "A", 5.0, 89.2, 5572450.0, tiers("60000:5 10000:10 1000:69 500:315")),
    (DAY, 702, "B", 5.0, 0.4, 166190.0, tiers("500:36")),
    (DAY, 668, "C", 1.0, 6.1, 96620.0, tiers("1000:5")),
    (DAY, 617, "D", 5.0, 0.0, 124140.0, tiers("1000:2")),
    (DAY, 630, "E", 20.0, 11.2, 2940760.0, tiers("1000:1")),
]
RUNS = [(720, 1560000, 60000, 3.52), (702, 960000, 500, 3.56), (617, 1320000, 100000, None), (630, 960000, 1000, 2.84)]


@pytest.fixture(scope="module")
def games(spark):
    out = ev.with_ev(spark.createDataFrame(GAMES, SNAP), spark.createDataFrame(RUNS, META))
    return ev.with_scenarios(ev.with_intervals(score.with_scores(out)))


def test_worked_rows(games):
    by = {r.game_no: r for r in games.collect()}
    a, b, c, d = by[720], by[702], by[668], by[617]
    assert (a.remaining_tickets, a.ev_per_ticket, a.ev_ratio, a.top_prize_odds_now, a.relative_score, a.dead_game, a.flags, a.confidence) == (1391520, 4.004578, 0.800916, 278304.0, 62471.412556, False, [], "high")
    assert (b.remaining_tickets, b.ev_per_ticket, b.ev_ratio, b.top_prize_odds_now, b.flags, b.confidence) == (3840, 43.278646, 8.655729, 106.666667, ["anomaly_candidate", "ev_out_of_range", "low_inventory"], "low")
    assert (c.remaining_tickets, c.ev_ratio, c.relative_score, c.flags, c.confidence, c.reason) == (None, None, 15839.344262, ["no_print_run"], "low", "no_print_run")
    assert (d.remaining_tickets, d.ev_ratio, d.relative_score, d.dead_game, d.flags, d.reason) == (0, None, None, True, ["sold_out"], "dead")
    assert (a.remaining_tickets_min, a.remaining_tickets_max, a.ev_ratio_min, a.ev_ratio_max) == (1390740, 1392300, 0.800467, 0.801365)
    e = by[630]
    assert (e.remaining_tickets_min, e.remaining_tickets_max, e.ev_ratio_min, e.ev_ratio_max) == (107040, 108000, 1.361463, 1.373673)
    assert [x.ev_ratio for x in a.ev_scenarios] == [0.400458, 0.160183, 0.040046]
    assert [x.ev_ratio for x in e.ev_scenarios] == [0.683771, 0.273508, 0.068377]
    assert [x.ev_ratio for x in b.ev_scenarios] == [4.327865, 1.731146, 0.432786] and c.ev_scenarios is None
    assert b.reason == "claim_lag" and b.grade == "F" and a.overall_odds_launch == 3.52


def test_scores_of_a_known_curve(spark):
    rows = [(DAY, k, False, [] if n != 706 else ["ev_out_of_range"], 1, r, c) for k, (n, r, c) in enumerate([(630, 1.367541, "medium"), (662, 1.287899, "medium"), (675, 0.731252, "high"), (682, 0.921596, "high"), (706, 32.538542, "low")])]
    df = spark.createDataFrame(rows, "as_of date, game_no bigint, dead_game boolean, flags array<string>, print_run bigint, ev_ratio double, confidence string")
    got = [(r.value_score, r.grade, r.reason) for r in score.with_scores(df).orderBy("game_no").collect()]
    assert got == [(95, "A", "medium"), (87, "A", "medium"), (46, "D", "high"), (68, "B", "high"), (40, "F", "claim_lag")]
    alone = score.with_scores(df.filter("game_no = 2")).collect()[0]
    assert (alone.value_score, alone.grade) == (68, "B")
    two_days = df.unionByName(df.withColumn("as_of", df.as_of + 1).filter("game_no = 2"))
    assert {r.value_score for r in score.with_scores(two_days).filter("game_no = 2").collect()} == {46, 68}


def test_rounding_half_up_and_empty_interval(spark):
    df = spark.createDataFrame([(1.000001, 0.05, 1000000, 5.0, 1.0)], "ev_ratio double, percent_unsold double, print_run bigint, total_unclaimed double, price double")
    r = ev.with_scenarios(ev.with_intervals(df)).collect()[0]
    assert r.ev_scenarios[0].ev_ratio == 0.500001 and r.remaining_tickets_min == 0 and r.ev_ratio_max is None


def test_top_tier_ties_keep_the_first(spark):
    df = spark.createDataFrame([([(5, None, 3), (5, None, 9), (9, None, 0), (None, "car", 7)], 5)], f"top_prizes {TIERS}, top_prize_value bigint")
    r = df.select(ev.top_tier_remaining().alias("n"), ev.dead().alias("d")).collect()[0]
    assert (r.n, r.d) == (3, False)


def test_views_partition_the_games(games):
    rows = games.withColumn("bucket", views.bucket()).collect()
    assert {r.game_no: r.bucket for r in rows} == {720: "eligible", 702: "excluded", 668: "unrated", 617: "unrated", 630: "eligible"}
    assert [r.game_no for r in views.hero(games).collect()] == [630]
    assert [r.game_no for r in views.shortlist(games).collect()] == [720]


def test_gates_hold_back_publication(spark, games, tmp_path):
    assert all(r.violations == 0 for r in gates.violations(games, LATEST_RULES).collect())
    small = gates.parser_gate(games)
    assert not small.collect()[0].passed
    out = f"{tmp_path}/latest"
    with pytest.raises(gates.GateError):
        gates.publish(games, out, parser=small)
    assert not list(tmp_path.iterdir())
    gates.publish(games, out, rules=gates.violations(games, LATEST_RULES), diff=gates.diff_gate(games, games.limit(0)))
    gates.publish(games, out)
    assert spark.read.parquet(out).count() == len(GAMES)
    moved = games.withColumn("ev_ratio", games.ev_ratio + 1)
    assert not gates.diff_gate(moved, games).collect()[0].passed
    broken = games.withColumn("confidence", games.name)
    with pytest.raises(gates.GateError, match="confidence"):
        gates.held(rules=gates.violations(broken, LATEST_RULES))


def test_empty_day(spark):
    none = ev.with_ev(spark.createDataFrame([], SNAP), spark.createDataFrame([], META))
    assert score.with_scores(none).count() == 0 and gates.diff_gate(none, none).collect()[0].passed
