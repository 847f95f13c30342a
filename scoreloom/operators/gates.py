"""Gates: conditions that a publication must meet. A failed gate writes nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .ev import in_range


class GateError(RuntimeError):
    pass


def parser_gate(snapshot: DataFrame, least_games: int = 40, least_money: float = 50_000_000.0) -> DataFrame:
    """One row: games, rows without a required value, all unclaimed money, whether all is well."""
    missing = F.col("price").isNull() | F.col("game_no").isNull() | F.col("percent_unsold").isNull() | F.col("total_unclaimed").isNull()
    out = snapshot.agg(F.count("*").alias("games"), F.count_if(missing).alias("incomplete"), F.coalesce(F.sum(F.col("total_unclaimed").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("money"))
    return out.withColumn("passed", (F.col("games") >= least_games) & (F.col("incomplete") == 0) & (F.col("money") > least_money))


def diff_gate(today: DataFrame, prior: DataFrame, move: float = 0.2, share: float = 0.30, order: str | None = None) -> DataFrame:
    """One row: games with a ratio on both days, those that moved by more than `move`, and whether their share is small.

    Of a game that the prior day has several times the last row by `order` counts (without one: the greatest
    ratio); if that row has no ratio, the game isn't compared.
    """
    a = today.filter("ev_ratio is not null").select("game_no", "ev_ratio")
    last = F.max_by(F.struct("ev_ratio"), order)["ev_ratio"] if order else F.max("ev_ratio")
    b = prior.groupBy("game_no").agg(last.alias("before")).filter("before is not null")
    out = a.join(b, "game_no").agg(F.count("*").alias("compared"), F.count_if(F.abs(F.col("ev_ratio") - F.col("before")) > move).alias("moved"))
    return out.withColumn("passed", F.coalesce(F.try_divide(F.col("moved"), F.col("compared")) <= share, F.lit(True)))


def history_gate(days: DataFrame, move: float = 0.2, share: float = 0.30) -> DataFrame:
    """as_of, prior, compared, moved, passed of each day, against the last day before it that itself passed; the first day passes.

    days: as_of, game_no, ev_ratio (null: not compared), each game once a day. Every day is tried as the one that passed:
    against the next day, then, where that fails, against the one after it, and so on, all days at once; so there are as many
    rounds as the longest run of days that fail against one. The days that hold are those that the first one leads to.
    """
    ratios = cut(days.filter("ev_ratio is not null").select("as_of", "game_no", "ev_ratio"))
    order = cut(days.select("as_of").distinct().withColumn("k", F.row_number().over(Window.orderBy("as_of"))))  # a row a day
    placed = ratios.join(F.broadcast(order), "as_of").select("k", "game_no", "ev_ratio")
    later = placed.select(F.col("k").alias("day"), F.col("game_no").alias("g"), F.col("ev_ratio").alias("now"))
    n, far, tried = order.count(), 1, []
    open_ = order.filter(F.col("k") < n).select("k")
    while True:
        pairs = placed.join(F.broadcast(open_), "k").join(later, (F.col("day") == F.col("k") + far) & (F.col("g") == F.col("game_no")))
        counts = pairs.groupBy(F.col("k").alias("of")).agg(F.count("*").alias("compared"), F.count_if(F.abs(F.col("now") - F.col("ev_ratio")) > move).alias("moved"))
        found = open_.join(counts, F.col("k") == F.col("of"), "left").select("k", (F.col("k") + far).alias("day"), F.coalesce("compared", F.lit(0)).alias("compared"), F.coalesce("moved", F.lit(0)).alias("moved"))
        found = cut(found.withColumn("passed", F.coalesce(F.try_divide(F.col("moved"), F.col("compared")) <= share, F.lit(True))))
        tried.append(found)
        far += 1
        open_ = found.filter(~F.col("passed") & (F.col("k") + far <= n)).select("k")
        if open_.isEmpty():
            break
    steps = cut(reduce(DataFrame.unionByName, tried))
    held = order.filter("k = 1").select("k")
    reached, ahead = held, held
    jumps = steps.filter("passed").select("k", F.col("day").alias("next"))
    while not ahead.isEmpty():  # days that hold: those reached so far and what they lead to, twice as many steps each time
        ahead = cut(reached.join(jumps, "k").select(F.col("next").alias("k")).join(reached, "k", "left_anti").distinct())
        reached = cut(reached.unionByName(ahead))
        jumps = cut(jumps.unionByName(jumps.join(jumps.select(F.col("k").alias("next"), F.col("next").alias("further")), "next").select("k", F.col("further").alias("next"))).distinct())
    names = order.select(F.col("k").alias("day"), "as_of")
    prior = order.select("k", F.col("as_of").alias("prior"))
    out = steps.join(reached, "k").join(names, "day").join(prior, "k").select("as_of", "prior", "compared", "moved", "passed")
    first = order.filter("k = 1").select("as_of", F.lit(None).cast("date").alias("prior"), F.lit(0).cast("long").alias("compared"), F.lit(0).cast("long").alias("moved"), F.lit(True).alias("passed"))
    return first.unionByName(out)


def violations(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule, violations: how many rows break each rule (null counts as broken); one pass over the rows."""
    counted = rows.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(f"`{n}`".strip("`")) for n, c in rules.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")).select("r.rule", "r.violations")


def math_gate(games: DataFrame, least: int = 20) -> DataFrame:
    """Ratios out of range must carry their flag and low confidence; enough must be in range."""
    wrong = F.col("ev_ratio").isNotNull() & ~in_range() & ~(F.array_contains("flags", "ev_out_of_range") & (F.col("confidence") == "low"))
    out = games.agg(F.count_if(in_range()).alias("in_range"), F.count_if(wrong).alias("unmarked"))
    return out.withColumn("passed", (F.col("in_range") >= least) & (F.col("unmarked") == 0))


def held(**gates: DataFrame) -> None:
    """Raise GateError with the rows of all gates that did not pass (each gate is one row, or rule rows)."""
    failed = {}
    for name, gate in gates.items():
        rows = [r.asDict() for r in gate.collect()]
        if any(not r.get("passed", r.get("violations", 0) == 0) for r in rows):
            failed[name] = rows
    if failed:
        raise GateError(str(failed))


def publish(games: DataFrame, path: str, **gates: DataFrame) -> None:
    """Write the day's rows under its date, after every gate has passed; a day written again replaces itself."""
    held(**gates)
    games.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)
