"""Cost metering, caps, logs; generate-and-judge loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import sane_cost
from ..functions.text import family

#: Fixed words that make a criterion one about sound.
AUDIO = ("audio", "sound", "music", "narration", "dialogue", "voice", "hum", "sfx", "soundtrack")


def metered(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with `cost`: the reported one if sane, else tokens times price; null where neither is known.

    calls: model, tokens_in, tokens_out, cost_usd and, if a call has a price of its own, own_in_per_1m and
    own_out_per_1m (both, or the table's holds); prices: slug, in_per_1m, out_per_1m. Of a slug that the
    table has twice the dearer price counts.
    """
    table = prices.groupBy("slug").agg(F.max(F.struct("in_per_1m", "out_per_1m")).alias("listed"))
    out = calls.join(table, F.col("model") == F.col("slug"), "left")
    price = F.col("listed")
    if {"own_in_per_1m", "own_out_per_1m"} <= set(calls.columns):
        own = F.struct(F.col("own_in_per_1m").cast("double").alias("in_per_1m"), F.col("own_out_per_1m").cast("double").alias("out_per_1m"))
        price = F.when(F.col("own_in_per_1m").isNotNull() & F.col("own_out_per_1m").isNotNull(), own).otherwise(price)
    priced = (F.col("tokens_in") / 1e6) * price.in_per_1m + (F.col("tokens_out") / 1e6) * price.out_per_1m
    return out.withColumn("cost", F.coalesce(sane_cost(F.col("cost_usd")), priced)).drop("slug", "listed")


def nano(x):
    """Billionths as integers: their sums don't depend on order."""
    return F.rint(x * F.lit(1e9)).cast("bigint")


def totals(metered_: DataFrame, cap: float, key: str = "task_id") -> DataFrame:
    """Per task: calls, calls without any cost, total, and whether it is over the cap.

    A call whose cost isn't known could be over it, so it counts as a breach.
    """
    out = metered_.groupBy(key).agg(F.count("*").alias("calls"), F.count_if(F.col("cost").isNull()).alias("unmetered"), F.coalesce(F.sum(nano(F.col("cost"))), F.lit(0)).alias("n"))
    return out.select(key, "calls", "unmetered", (F.col("n") / F.lit(1e9)).alias("cost_usd_total"), ((F.col("n") > F.lit(round(cap * 1e9))) | (F.col("unmetered") > 0)).alias("cost_cap_breached"))


def new_entries(verdicts: DataFrame, log: DataFrame) -> DataFrame:
    """Verdicts whose (task_id, cost) the log doesn't have; nulls equal nulls; each once."""
    same = verdicts["task_id"].eqNullSafe(log["task_id"]) & verdicts["cost_usd_total"].eqNullSafe(log["cost_usd_total"])
    return verdicts.join(log, same, "left_anti").dropDuplicates(["task_id", "cost_usd_total"])


def tally(log: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row: total, entries, the latest entry's task."""
    cost = F.coalesce(F.col("cost_usd_total").try_cast("double"), F.lit(0.0))
    return log.agg(F.count("*").alias("entries"), (F.coalesce(F.sum(F.rint(cost * 1e6).cast("bigint")), F.lit(0)) / F.lit(1e6)).alias("total_usd"), F.max_by("task_id", ordinal).alias("latest"))


def used_share(cost, cap):
    """Percent of the cap, at most 100, and its state."""
    share = F.least(F.try_divide(cost * 100.0, cap), F.lit(100.0))
    return share, F.when(cost * 100.0 >= cap * 100.0, "breach").when(share >= 80, "warn").otherwise("ok")


def spark_line(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """value scaled to 0..1 over each key's rows; equal values give 0."""
    w = Window.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("y", (F.col(value) - low) / F.when(high == low, 1).otherwise(high - low)).withColumn("is_last", F.col(order) == F.max(order).over(w))


def budgeted(attempts: DataFrame, most: int, cap: int) -> DataFrame:
    """Attempts (loop_id, n, passed, cost: integer cents) that the loop still allows: none passed before, n and spend within bounds."""
    before = Window.partitionBy("loop_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    done, spent = F.coalesce(F.bool_or("passed").over(before), F.lit(False)), F.coalesce(F.sum("cost").over(before), F.lit(0))
    return attempts.withColumns({"spent_before": spent, "allowed": ~done & (F.col("n") <= most) & (spent < cap)})


def loop_result(attempts: DataFrame) -> DataFrame:
    """Per loop: status, cost, the best attempt (greatest score, first of equals)."""
    best = F.max_by("n", F.struct("score", -F.col("n")))
    return attempts.groupBy("loop_id").agg(F.when(F.bool_or("passed"), "PASS").otherwise("EXHAUSTED").alias("status"), F.sum("cost").alias("cost"), best.alias("best_n"), F.max("score").alias("best_score"))


def judged_by(generators: DataFrame, pool: DataFrame) -> DataFrame:
    """generator, preferred -> judge: the preferred one if of another family, else the pool's first such; null if there is none."""
    g = generators.withColumn("own", family(F.col("generator")))
    c = pool.select(F.col("judge").alias("candidate"), "ordinal", family(F.col("judge")).alias("theirs"))
    first = g.select("own").distinct().join(F.broadcast(c), F.col("own") != F.col("theirs")).groupBy("own").agg(F.min_by("candidate", "ordinal").alias("candidate"))  # the pool is a short fixed list
    out = g.join(first, "own", "left")
    honoured = F.col("preferred").isNotNull() & (F.col("preferred") != "") & (family(F.col("preferred")) != F.col("own"))
    return out.select("generator", "preferred", F.when(honoured, F.col("preferred")).otherwise(F.col("candidate")).alias("judge"))


def sanitised(verdict, defects):
    """Unknown verdicts, and passes with defects, are REVISE."""
    return F.when((verdict == "PASS") & (F.coalesce(defects, F.lit(0)) == 0), "PASS").otherwise("REVISE")


def hears(criteria):
    return F.lower(criteria).rlike("|".join(AUDIO))


def guarded(verdict, criteria, defects):
    """A pass on criteria about sound needs a defect that names audio; frames show none, so else it is REVISE."""
    named = F.exists(defects, lambda d: F.lower(d.problem).contains("audio") | F.lower(d.criterion).contains("audio"))
    return F.when((verdict == "PASS") & hears(criteria) & ~F.coalesce(named, F.lit(False)), "REVISE").otherwise(verdict)


def guarded_defects(verdict, criteria, defects):
    """The defects, and one more (its words are fixed) if guarded() turned the verdict round."""
    kept = F.coalesce(defects, F.array().cast("array<struct<criterion:string,problem:string>>"))
    more = F.array(F.struct(F.lit("audio criteria present").alias("criterion"), F.lit("audio cannot be verified from frames \u2014 human ears required").alias("problem")))
    return F.when((verdict == "PASS") & (guarded(verdict, criteria, defects) == "REVISE"), F.concat(kept, more)).otherwise(kept)


def defect_text(defects):
    """'criterion: problem' joined by '; '."""
    return F.array_join(F.transform(defects, lambda d: F.concat(d.criterion, F.lit(": "), d.problem)), "; ")


def frame_times(duration, n):
    """Ascending sample times between the ends of a clip."""
    count, length = F.greatest(n, F.lit(2)), F.greatest(duration, F.lit(0.2))
    eps = F.least(F.lit(0.1), length / 20)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: eps + i * ((length - eps - eps) / (count - 1)))
