"""The engine's relations, derived from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cost, ev, panel, score
from ..shared import shared_dir
from ..shipping import ship

TODAY, YESTERDAY = "2001-01-01", "2000-12-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def inventory(spark, sf_dir, since: str = TODAY) -> tuple[DataFrame, DataFrame]:
    """(snapshot, metadata): parts are games, their line items tickets and prize tiers."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz")).alias("live"))
    money = F.sum(F.when(F.col("live"), F.col("l_extendedprice").cast("decimal(18,2)")))
    tier = line.groupBy("l_partkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_if("live").alias("live"), F.sum("l_quantity").alias("q"), money.alias("m"))
    item = F.struct((F.col("l_linenumber").cast("bigint") * 1000).alias("level"), F.lit(None).cast("string").alias("level_label"), F.col("live").alias("remaining"))
    game = tier.groupBy("l_partkey").agg(
        F.sum("n").alias("n"), F.sum("live").alias("live"), F.sum("q").alias("q"), F.coalesce(F.sum("m"), F.lit(0)).cast("double").alias("total_unclaimed"),
        F.sort_array(F.collect_list(item)).alias("top_prizes"), (F.max("l_linenumber").cast("bigint") * 1000).alias("top"),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    base = part.join(game, part["p_partkey"] == game["l_partkey"])
    snapshot = base.select(
        F.lit(since).cast("date").alias("as_of"), F.col("p_partkey").alias("game_no"), F.col("p_name").alias("name"), F.col("p_brand").alias("scope"), (F.col("p_retailprice") / 1000).alias("price"),
        (F.rint(F.lit(1000) * F.col("live") / F.col("n")) / 10).alias("percent_unsold"), "total_unclaimed", "top_prizes",
    )
    orders = line.groupBy("l_partkey", "l_orderkey").agg(F.count("*").alias("c")).groupBy(F.col("l_partkey").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("o"))
    known = base.filter("p_size % 7 <> 0").join(orders, F.col("p_partkey") == F.col("k"))
    meta = known.select(F.col("p_partkey").alias("game_no"), (F.col("q") * 2500).cast("bigint").alias("print_run"), F.col("top").alias("top_prize_value"), (F.col("c") / F.col("o")).alias("overall_odds"))
    return snapshot, meta


def games(spark, sf_dir, since: str = TODAY) -> DataFrame:
    return ev.with_ev(*inventory(spark, sf_dir, since))


def latest(spark, sf_dir, since: str = TODAY) -> DataFrame:
    return ev.with_scenarios(ev.with_intervals(score.with_scores(games(spark, sf_dir, since))))


def observations(spark, sf_dir) -> DataFrame:
    """Events as observations of user_id:event_type."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("game_key"), F.col("ts").cast("date").alias("obs_date"), F.col("ts").alias("capture_ts"),
        F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("capture_url"), F.floor("value").cast("double").alias("percent_unsold"), (F.col("value") * 100).alias("total_unclaimed"), "event_id",
    )


def panel_rows(spark, sf_dir) -> DataFrame:
    return panel.deduped(observations(spark, sf_dir), ["event_id"])


def panel_records(spark, sf_dir) -> DataFrame:
    """panel_rows with lifecycle, source (null where it isn't known) and prizes, of which some have no level."""
    k = F.col("event_id")
    tier = F.array(F.struct(F.when(k % 9 != 0, k).alias("level"), F.when(k % 9 == 0, "car").alias("level_label"), F.lit(1).cast("bigint").alias("remaining")))
    source = F.when(k % 11 == 0, None).when(k % 5 == 0, "daily").otherwise("wayback")
    return panel.with_lifecycle(panel_rows(spark, sf_dir)).withColumns({"source": source, "top_prizes": F.when(k % 4 != 0, tier)})


def findings(spark, sf_dir) -> DataFrame:
    """Events as findings of five reviewers on forty tasks."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    severity = F.when(F.col("value") < 40, "critical").when(F.col("value") < 160, "major").when(F.col("value") < 400, "minor").otherwise("unknown")
    return e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string")).alias("task_id"), F.col("event_id").alias("ord"), F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")).alias("slug"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.upper("event_type"))).otherwise(F.col("event_type")).alias("issue"), severity.alias("severity"), F.concat(F.lit("f"), (F.col("k") % 3).cast("string")).alias("file"),
        F.when(F.col("k") % 4 == 0, F.lit("abc")).otherwise((F.col("k") % 20).cast("string")).alias("line"), F.when(F.col("k") % 11 == 0, F.lit("not_an_issue")).when(F.col("k") % 2 == 0, F.lit("issue")).alias("stance"),
    )


def rulings(spark, sf_dir) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    return e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string")).alias("task_id"), F.col("event_id").alias("ord"), F.concat(F.lit("F"), (F.col("event_id") % 60 + 1).cast("string")).alias("id"),
        F.when(k == 0, "upheld").when(k == 1, "rejected").when(k == 2, "maybe").alias("ruling"),
    )


def calls(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Line items as model calls, nations as the price table."""
    line = table(spark, sf_dir, "lineitem")
    reported = F.when(F.col("l_orderkey") % 5 == 0, F.lit(None).cast("double")).when(F.col("l_orderkey") % 7 == 0, F.lit(-1.0)).otherwise(F.col("l_discount"))
    made = line.select(
        F.col("l_orderkey").alias("task_id"), F.concat(F.lit("n"), (F.col("l_suppkey") % 25).cast("string")).alias("model"), (F.col("l_quantity") * 1000).alias("tokens_in"),
        (F.col("l_linenumber") * 500).cast("double").alias("tokens_out"), reported.alias("cost_usd"),
    )
    n = F.col("n_nationkey")
    prices = table(spark, sf_dir, "nation").filter("n_nationkey % 6 <> 0").select(F.concat(F.lit("n"), n.cast("string")).alias("slug"), (n + F.lit(0.5)).cast("double").alias("in_per_1m"), (n * 2 + 1).cast("double").alias("out_per_1m"))
    return made, prices


def attempts(spark, sf_dir) -> DataFrame:
    """Events as attempts of generate-and-judge loops; costs in cents."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("loop_id").orderBy("event_id"))
    out = e.select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("loop_id"), "event_id", F.floor(F.col("value") / 10).cast("bigint").alias("score"), (F.col("value") > 420).alias("passed"), (F.lit(10) + F.get_json_object("props", "$.k").cast("bigint") % 30).alias("cost"))
    return out.withColumn("n", n).drop("event_id")


def cost_log(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(verdicts, log): every order's verdict, of which even orders are in the log already, some twice."""
    made, prices = calls(spark, sf_dir)
    t = cost.totals(cost.metered(made, prices), 0.3).select(F.col("task_id").cast("string").alias("task_id"), F.when(F.col("task_id") % 13 != 0, F.col("cost_usd_total")).alias("cost_usd_total"))
    line = F.col("task_id").cast("bigint")
    return t.unionByName(t.filter(line % 3 == 0)), t.filter(line % 2 == 0)


def metadata(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(articles, snapshot, dates, tiles) from suppliers and customers, with keys that overlap in part."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    k = F.col("s_suppkey")
    a = s.filter("s_suppkey % 3 <> 0").select(
        F.when(k % 50 != 1, k).alias("game_no"), F.when(k % 4 == 0, "").otherwise(F.col("s_name")).alias("name"), F.when(k % 5 != 0, k * 1000).alias("print_run"), F.concat(F.lit("a"), k.cast("string")).alias("article_id")
    )
    snap = s.filter("s_suppkey % 2 = 0").select(k.alias("game_no"), F.concat(F.lit("snap "), k.cast("string")).alias("name"), (k % 7).cast("double").alias("price"))
    dates = c.select(F.col("c_custkey").alias("game_no"), F.col("c_name").alias("name"), F.lit(None).cast("date").alias("end_date"), F.lit(None).cast("date").alias("last_cash_date"))
    tiles = s.filter("s_suppkey % 4 <> 3").select(F.concat(F.lit("a"), k.cast("string")).alias("article_id"), (k % 5).cast("double").alias("price"))
    return a, snap, dates, tiles


def provenance(spark, sf_dir) -> DataFrame:
    """Where an article's page is from: for some of the articles, and for pages that aren't articles."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 2").select(F.concat(F.lit("a"), k.cast("string")).alias("article_id"), F.when(k % 8 != 0, F.when(k % 5 == 0, "wayback").otherwise("live")).alias("source"))
