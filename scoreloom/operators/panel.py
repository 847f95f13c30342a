"""The observation panel: dedup, interval censoring, lifecycle labels, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import rounded
from ..functions.text import slug

KEY = ("game_key", "obs_date")


def game_key(game_no, name):
    return F.concat(game_no.cast("string"), F.lit(":"), slug(name))


def pu_interval(pu):
    """[x - 0.05, x + 0.05), not under 0."""
    return F.struct(rounded(F.greatest(pu - 0.05, F.lit(0.0)), 10).alias("lo"), rounded(pu + 0.05, 10).alias("hi"))


def has_noncash(tiers):
    return F.exists(tiers, lambda x: x.level.isNull())


def _latest(order: list[str]):
    return Window.partitionBy(*KEY).orderBy(*[F.desc(c) for c in ("capture_ts", *order)])


def deduped(rows: DataFrame, order: list[str]) -> DataFrame:
    """The row of the latest capture for each game and day; `order` breaks ties, the greatest wins."""
    return rows.withColumn("__rn", F.row_number().over(_latest(order))).filter("__rn = 1").drop("__rn")


def superseded(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows that lost, each with the one that won."""
    w = _latest(order)
    out = rows.withColumns({"__rn": F.row_number().over(w), "kept_capture_ts": F.first("capture_ts").over(w), "kept_capture_url": F.first("capture_url").over(w)})
    return out.filter("__rn > 1").select(*KEY, F.col("capture_ts").alias("superseded_capture_ts"), F.col("capture_url").alias("superseded_capture_url"), "kept_capture_ts", "kept_capture_url")


def with_lifecycle(panel: DataFrame, confirmed: str | None = None) -> DataFrame:
    """active, but for a game's last day: exited_observed at 0, exited_unobserved if the panel goes on.

    `confirmed` names a column with the end date that is known of a game; one before the panel's end is an observed exit.
    """
    last = panel.agg(F.max("obs_date").alias("panel_end"))  # one row
    out = panel.withColumn("__next", F.lead("obs_date").over(Window.partitionBy("game_key").orderBy("obs_date"))).crossJoin(F.broadcast(last))
    seen = F.col("percent_unsold") == 0
    if confirmed:
        seen = seen | F.coalesce(F.col(confirmed) < F.col("panel_end"), F.lit(False))
    status = F.when(F.col("__next").isNotNull(), "active").when(seen, "exited_observed").when(F.col("panel_end") > F.col("obs_date"), "exited_unobserved").otherwise("active")
    return out.withColumn("lifecycle_status", status).drop("__next", "panel_end")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, known: str, stretch: str = "month") -> DataFrame:
    """left with the columns of the last row of right that is not after it: right[known] <= left[at]; nulls if there is none.

    Both are sorted as one, without a join of rows. A key's rows are taken in stretches of time (month, week, ...), and what
    a stretch leaves known goes to the next ones, so a long or hot key isn't sorted in one task. right has one row for
    each key and time; a null time is never known.
    """
    told = [c for c in right.columns if c not in keys]
    a = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("l"), *keys, F.col(at).alias("t"), F.lit(None).cast(right.select(F.struct(*told)).schema[0].dataType).alias("r"))
    b = right.filter(F.col(known).isNotNull()).select(F.lit(None).cast(a.schema["l"].dataType).alias("l"), *keys, F.col(known).alias("t"), F.struct(*told).alias("r"))
    both = a.unionByName(b).withColumn("part", F.date_trunc(stretch, "t"))
    last = both.filter("r is not null").groupBy(*keys, "part").agg(F.max_by("r", "t").alias("left_known"))
    parts = both.select(*keys, "part").distinct().join(last, [*keys, "part"], "left")
    before = F.last("left_known", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    same = [F.col(k) == F.col(f"of_{k}") for k in keys] + [F.col("part").eqNullSafe(F.col("of_part"))]
    carried = parts.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("part").alias("of_part"), before.alias("carried"))
    within = F.last("r", ignorenulls=True).over(Window.partitionBy(*keys, "part").orderBy(F.col("t"), F.col("r").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("found", within).filter("l is not null").join(carried, same, "left")
    return found.select("l.*", *[F.coalesce(F.col("found"), F.col("carried"))[c].alias(c) for c in told])


def windows(panel: DataFrame) -> DataFrame:
    """Consecutive observations of a game: start, end, days, sales and claims rates.

    If the panel has top_remaining, also the top tier's rate: its decrement by days and the game's greatest count.
    """
    w = Window.partitionBy("game_key").orderBy("obs_date")
    whole = Window.partitionBy("game_key")
    nxt = lambda c: F.lead(c).over(w)
    top = "top_remaining" in panel.columns
    more = {"r_end": nxt("top_remaining"), "r_max": F.max("top_remaining").over(whole)} if top else {}
    out = panel.withColumns({"w_end": nxt("obs_date"), "pu_end": nxt("percent_unsold"), "u_end": nxt("total_unclaimed"), "u_max": F.max("total_unclaimed").over(whole)} | more)
    out = out.filter("w_end is not null").withColumn("dt", F.date_diff("w_end", "obs_date"))
    rate = F.try_divide(F.col("top_remaining") - F.col("r_end"), F.col("dt") * F.col("r_max")).alias("d_top") if top else None
    return out.select(
        "game_key", F.col("obs_date").alias("w_start"), "w_end", "dt", "u_max", F.col("total_unclaimed").alias("u_start"),
        F.try_divide(F.col("percent_unsold") - F.col("pu_end"), F.col("dt")).alias("s"),
        F.try_divide(F.col("total_unclaimed") - F.col("u_end"), F.col("dt") * F.col("u_max")).alias("d"),
        *(["r_max", rate] if top else []),
    )


def jumps(panel: DataFrame) -> DataFrame:
    """Days on which a game's unsold share rose: a reprint or a mistake."""
    before = F.lag("percent_unsold").over(Window.partitionBy("game_key").orderBy("obs_date"))
    return panel.withColumn("before", before).filter("percent_unsold > before")


def inventory(panel: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each value of `by` ("source"). A record is noncash if a prize has no level."""
    return panel.groupBy(*by).agg(
        F.count("*").alias("records"), F.count_distinct("capture_ts").alias("captures"), F.count_distinct("game_key").alias("lifecycles"),
        *[F.count_if(F.col("lifecycle_status") == s).alias(s) for s in ("active", "exited_observed", "exited_unobserved")],
        F.count_if(has_noncash(F.col("top_prizes"))).alias("noncash"),
    )
