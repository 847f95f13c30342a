"""Metadata from several sources: one row a game, with fixed precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import rounded


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def with_source(articles: DataFrame, provenance: DataFrame) -> DataFrame:
    """articles with the `source` of their page, null where there is none. provenance: one row an article_id."""
    return articles.join(provenance.select("article_id", "source"), "article_id", "left")


def merged(articles: DataFrame, snapshot: DataFrame, dates: DataFrame, tiles: DataFrame) -> DataFrame:
    """Games of the snapshot or the articles; names: article, snapshot, dates; prices: tile, snapshot."""
    a = articles.filter("game_no is not null").join(tiles.withColumnRenamed("price", "tile_price"), "article_id", "left").withColumnsRenamed({"name": "a_name"}).withColumn("is_article", F.lit(True))
    s = snapshot.select("game_no", F.col("name").alias("s_name"), F.col("price").alias("s_price")).withColumn("is_active", F.lit(True))
    d = dates.select("game_no", F.col("name").alias("d_name"), "end_date", "last_cash_date")
    out = a.join(s, "game_no", "full_outer").join(d, "game_no", "left")
    name = F.when(F.col("a_name") != "", F.col("a_name")).when(F.col("is_active"), F.col("s_name")).otherwise(F.col("d_name"))
    return out.withColumns({"name": name, "price": F.coalesce("tile_price", "s_price"), "is_active": F.coalesce("is_active", F.lit(False)), "is_article": F.coalesce("is_article", F.lit(False))})


def price_conflicts(games: DataFrame) -> DataFrame:
    return games.filter("tile_price <> s_price").select("game_no", "tile_price", F.col("s_price").alias("unclaimed_price"))


def coverage(games: DataFrame, least: float = 80.0) -> DataFrame:
    """One row: active games, those with a print run, the share, whether it reaches `least`."""
    active = games.filter("is_active")
    out = active.agg(F.count("*").alias("active_games"), F.count("print_run").alias("with_print_run"))
    share = F.coalesce(F.try_divide(F.col("with_print_run") * 100.0, F.col("active_games")), F.lit(0.0))
    return out.select("active_games", "with_print_run", rounded(share, 1).alias("coverage_pct"), F.lit(least).alias("gate_threshold_pct"), (share >= least).alias("passed"))


def layered(keys: DataFrame, file: DataFrame, env: DataFrame) -> DataFrame:
    """key, value: the environment (unless empty), else the file, else the default."""
    out = keys.select("key", F.col("value").alias("d")).join(file.select("key", F.col("value").alias("f")), "key", "left").join(env.select("key", F.col("value").alias("e")), "key", "left")
    return out.select("key", F.coalesce(F.nullif("e", F.lit("")), "f", "d").alias("value"))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that both have, once each; nulls equal nulls."""
    return a.intersect(b)
