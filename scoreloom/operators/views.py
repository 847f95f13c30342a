"""What readers see: eligible games, the best pick, shortlists, buckets, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucket():
    """eligible, excluded (rated, but the numbers mislead) or unrated: a lossless partition."""
    misleading = F.arrays_overlap("flags", F.array(F.lit("ev_out_of_range"), F.lit("low_inventory")))
    return F.when(F.col("rated") & ~misleading, "eligible").when(F.col("rated"), "excluded").otherwise("unrated")


def ranked(games: DataFrame, scope: str | None = None, day: str = "as_of") -> DataFrame:
    """Eligible games with their rank in the day (and scope): score first, then the lower number."""
    keys = [day, scope] if scope else [day]
    order = Window.partitionBy(*keys).orderBy(F.desc("value_score"), F.asc("game_no"))
    return games.filter(bucket() == "eligible").withColumn("rank", F.row_number().over(order))


#: Parts that a day's games are ranked in first.
PARTS = 64


def best(games: DataFrame, last: int, scope: str | None = None, day: str = "as_of") -> DataFrame:
    """The `last` best eligible games of a day (and scope) with their rank.

    Each part of a day gives its own best ones, and only these are ranked together, so no day is sorted in one task.
    """
    order = Window.partitionBy(*[day, scope] if scope else [day], "part").orderBy(F.desc("value_score"), F.asc("game_no"))
    parts = games.filter(bucket() == "eligible").withColumn("part", F.pmod(F.xxhash64("game_no"), F.lit(PARTS)))
    first = parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= last).drop("part", "rank")
    return ranked(first, scope, day).filter(F.col("rank") <= last)


def hero(games: DataFrame, scope: str | None = None) -> DataFrame:
    return best(games, 1, scope)


def shortlist(games: DataFrame, scope: str | None = None, last: int = 10) -> DataFrame:
    return best(games, last, scope).filter("rank >= 2")


def stale(as_of, now, hours: int = 48):
    return (now.cast("timestamp").cast("double") - as_of.cast("timestamp").cast("double")) > hours * 3600
