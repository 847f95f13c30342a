"""Expected value per unit price, flags, confidence, intervals and what-if scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import ratio, rounded, scenario, whole


@dataclass(frozen=True)
class Limits:
    low_inventory: float = 5.0
    high_confidence: float = 15.0
    anomaly: float = 0.85
    range_low: float = 0.0
    range_high: float = 1.5
    half_step: float = 0.05
    shares: tuple[int, ...] = (50, 80, 95)


LIMITS = Limits()


def top_tier_remaining():
    """Remaining prizes of the highest level that has any; of equal levels the first."""
    return F.expr(
        "aggregate(filter(top_prizes, x -> x.level is not null and x.remaining >= 1), cast(null as struct<level:bigint,remaining:bigint>),"
        " (a, x) -> case when a is null or x.level > a.level then named_struct('level', x.level, 'remaining', x.remaining) else a end).remaining"
    )


def dead():
    return F.coalesce(F.expr("top_prize_value is not null and not exists(top_prizes, x -> coalesce(x.level >= top_prize_value and x.remaining >= 1, false))"), F.lit(False))


def in_range(ev=None, limits: Limits = LIMITS):
    ev = F.col("ev_ratio") if ev is None else ev
    return F.coalesce((ev > limits.range_low) & (ev < limits.range_high), F.lit(False))


def with_ev(snapshot: DataFrame, meta: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """snapshot left-joined with meta (game_no, print_run, top_prize_value, overall_odds) and its value columns."""
    meta = meta.select(F.col("game_no").cast("bigint").alias("game_no"), "print_run", "top_prize_value", F.col("overall_odds").alias("overall_odds_launch"))
    pu, tu, pr = F.col("percent_unsold"), F.col("total_unclaimed"), F.col("print_run")
    out = snapshot.join(meta, "game_no", "left").withColumn("remaining_tickets", whole(pu * pr / 100))
    raw = ratio(tu, F.col("remaining_tickets").cast("double"))
    out = out.withColumns({"ev_per_ticket": rounded(raw), "ev_ratio": rounded(raw / F.col("price")), "relative_score": F.when(pu > 0, rounded(ratio(tu, pu))), "dead_game": dead()})
    live = (F.col("remaining_tickets") != 0) & ~F.col("dead_game")
    out = out.withColumns(
        {
            "ev_ratio_adjusted": F.lit(None).cast("double"),
            "top_prize_odds_now": F.when(live, rounded(ratio(F.col("remaining_tickets").cast("double"), top_tier_remaining().cast("double")))),
        }
    )
    ok, ev = in_range(limits=limits), F.col("ev_ratio")
    flags = F.array(
        F.when(ev > limits.anomaly, "anomaly_candidate"),
        F.when(ev.isNotNull() & ~ok, "ev_out_of_range"),
        F.when((pu > 0) & (pu < limits.low_inventory), "low_inventory"),
        F.when(pr.isNull(), "no_print_run"),
        F.when(pu == 0, "sold_out"),
    )
    known = pr.isNotNull() & ok
    confidence = F.when(known & (pu >= limits.high_confidence), "high").when(known & (pu >= limits.low_inventory), "medium").otherwise("low")
    return out.withColumns({"flags": F.sort_array(F.array_compact(flags)), "confidence": confidence})


def with_intervals(games: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Ticket and ratio bounds of the published share's rounding step; null where ev_ratio is."""
    step, run, known = F.lit(limits.half_step), F.col("print_run"), F.col("ev_ratio").isNotNull()
    low = whole(F.greatest(F.col("percent_unsold") - step, F.lit(0.0)) * run / 100)
    high = whole(F.least(F.col("percent_unsold") + step, F.lit(100.0)) * run / 100)
    out = games.withColumns({"remaining_tickets_min": F.when(known, low), "remaining_tickets_max": F.when(known, high)})
    at = lambda n: rounded(ratio(F.col("total_unclaimed"), F.col(n).cast("double")) / F.col("price"))
    return out.withColumns({"ev_ratio_min": at("remaining_tickets_max"), "ev_ratio_max": at("remaining_tickets_min")})


def with_scenarios(games: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    shares = F.array(*[F.lit(s) for s in limits.shares])
    made = F.transform(shares, lambda s: F.struct((s / 100).cast("double").alias("assumed_claimed_share"), scenario(F.col("ev_ratio"), s).alias("ev_ratio")))
    return games.withColumn("ev_scenarios", F.when(F.col("ev_ratio").isNotNull(), made))


def skeleton(snapshot: DataFrame) -> DataFrame:
    """The first-milestone shape: everything that needs metadata is null, no game is dead or flagged, none trusted."""
    nulls = {"print_run": "bigint", "remaining_tickets": "bigint", "ev_per_ticket": "double", "ev_ratio": "double", "ev_ratio_adjusted": "double"}
    fixed = {"dead_game": F.lit(False), "flags": F.array().cast("array<string>"), "confidence": F.lit("low")}
    return snapshot.withColumns({k: F.lit(None).cast(t) for k, t in nulls.items()} | fixed)


def tier_multiple(games: DataFrame) -> DataFrame:
    """The listed prizes' money and its share of all unclaimed money."""
    listed = F.expr("aggregate(top_prizes, 0D, (a, x) -> a + coalesce(x.level * x.remaining, 0))")
    return games.withColumn("listed_sum", listed).withColumn("multiple", rounded(ratio(F.col("listed_sum"), F.col("total_unclaimed"))))


def prize_gini(games: DataFrame) -> DataFrame:
    """Gini coefficient of a game's remaining prize money over its tiers (0: even), by ranks."""
    money = F.expr("array_sort(transform(top_prizes, x -> cast(x.level * x.remaining as double)))")
    out = games.withColumn("money", money).withColumn("tiers", F.size("money"))
    weighted = F.expr("aggregate(zip_with(money, sequence(1, greatest(tiers, 1)), (m, r) -> m * r), 0D, (a, x) -> a + coalesce(x, 0D))")
    total = F.expr("aggregate(money, 0D, (a, x) -> a + x)")
    return out.withColumn("gini", rounded(ratio(weighted * 2, total * F.col("tiers")) - (F.col("tiers") + 1) / F.col("tiers").cast("double")))
