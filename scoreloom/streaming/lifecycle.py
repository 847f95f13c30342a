"""Lifecycles and superseded captures as state: a keyed processor and an aggregation that emit change rows, and a sink that folds them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

#: Keyed state of any kind needs this store.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LABELS = "game_key string, obs_date date, lifecycle_status string, version long"
CAPTURES = "kind string, sign int, game_key string, obs_date date, at long, capture_url string, percent_unsold double, kept_at long, kept_capture_url string"
#: Fixed value, which a checkpoint depends on: games are dealt by their hash to this many keys, so Python is called a key and not a game.
BUCKETS = 512
_DAY = 86_400_000
_HELD = {"game_key": "string", "day": "int", "at": "long", "place": "long", "percent_unsold": "double", "version": "long", "over": "boolean"}


class Lifecycle(StatefulProcessor):
    """The last observation of each of a bucket's games, and a timer for the first end of such a day: when the watermark passes that, the panel goes on without these games.

    A batch's rows are reduced to game and day as they come in, so a task holds these and the bucket's games, not the rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.games = handle.getValueState("games", ", ".join([f"{c} array<{kind}>" for c, kind in _HELD.items()] + ["timer long"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = None
        for part in rows:
            part = part[["game_key", "day", "at", "place", "percent_unsold"]]
            fresh = _latest(part if fresh is None else pd.concat([fresh, part], ignore_index=True))
        old, timer = self._held()
        fresh = fresh.assign(version=0, over=False, fresh=True)
        days = _latest(pd.concat([fresh, old.assign(fresh=False)], ignore_index=True) if len(old) else fresh)
        # a day gets one label from a batch at most, so the labels of a game's batch share a version
        given = days.assign(version=days.groupby("game_key", dropna=False)["version"].transform("max"), said=days.groupby("game_key", dropna=False)["fresh"].transform("any"))
        last = ~given.duplicated("game_key", keep="last")
        gone = given["day"] < timerValues.getCurrentWatermarkInMs() // _DAY
        status = pd.Series(np.where(~last, "active", np.where(given["percent_unsold"] == 0, "exited_observed", np.where(gone, "exited_unobserved", "active"))), given.index)
        said = given["said"]
        given = given.assign(version=given["version"] + said, over=np.where(said, status != "active", given["over"]), lifecycle_status=status)
        yield _labelled(given[said])
        self._hold(given[last], timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        games, _ = self._held()
        gone = ~games["over"] & (games["day"] < timerValues.getCurrentWatermarkInMs() // _DAY)
        games = games.assign(version=games["version"] + gone, over=games["over"] | gone)
        if gone.any():
            yield _labelled(games[gone].assign(lifecycle_status="exited_unobserved"))
        self._hold(games, None)  # Spark drops a timer that has passed

    def _held(self) -> tuple[pd.DataFrame, int | None]:
        if not self.games.exists():
            return pd.DataFrame(columns=list(_HELD)), None
        *columns, timer = self.games.get()
        return pd.DataFrame(dict(zip(_HELD, columns, strict=True))), timer

    def _hold(self, games: pd.DataFrame, timer: int | None) -> None:
        open_ = games.loc[~games["over"].astype(bool), "day"]
        wanted = (int(open_.min()) + 1) * _DAY - 1 if len(open_) else None
        self.games.update((*(games[c].tolist() for c in _HELD), wanted))
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)


def _latest(rows: pd.DataFrame) -> pd.DataFrame:
    """A game's days in order, each with its latest row."""
    return rows.sort_values(["game_key", "day", "at", "place"], kind="stable").drop_duplicates(["game_key", "day"], keep="last")


def _labelled(days: pd.DataFrame) -> pd.DataFrame:
    return days[["game_key", "day", "lifecycle_status", "version"]]


def lifecycle_changes(rows: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream of observations (game_key, obs_date, capture_ts, place, percent_unsold) as changes of labels.

    Labels are those of panel.with_lifecycle() once the watermark, `late` behind the newest capture, has passed; until
    then a game's last day is active. Spark drops captures that are older than the watermark. `place` breaks ties of capture times.
    """
    time = F.col("capture_ts").cast("timestamp")
    bucket = F.pmod(F.xxhash64("game_key"), F.lit(BUCKETS)).cast("int").alias("bucket")
    rows = rows.select(bucket, "game_key", F.unix_date("obs_date").alias("day"), time.alias("capture_ts"), F.unix_micros(time).alias("at"), "place", "percent_unsold")
    ship(rows.sparkSession)
    rows.sparkSession.conf.set(*_STORE)
    schema = LABELS.replace("obs_date date", "day int")
    out = rows.withWatermark("capture_ts", late).groupBy("bucket").transformWithStateInPandas(statefulProcessor=Lifecycle(), outputStructType=schema, outputMode="Update", timeMode="EventTime")
    return out.select("game_key", F.date_from_unix_date("day").alias("obs_date"), "lifecycle_status", "version")


def labels(changes: DataFrame) -> DataFrame:
    """The last label that was given to each game and day."""
    return changes.groupBy("game_key", "obs_date").agg(F.max_by("lifecycle_status", "version").alias("lifecycle_status"))


def capture_changes(rows: DataFrame) -> DataFrame:
    """A stream of captures, in any order, as rows that are added (sign 1) and taken back (-1): of the panel and of the superseded log.

    The state of a game's day is its captures, so it grows with these; nothing is dropped for being late. Times (`at`,
    `kept_at`) are microseconds since 1970. The captures are collected by Spark's own aggregation, and each bears the time of
    its batch, which is one and the same in a batch and in its repetitions: what bears another time was there before.
    """
    rows.sparkSession.conf.set(*_STORE)
    now = F.unix_micros(F.current_timestamp())
    at = F.unix_micros(F.col("capture_ts").cast("timestamp")).alias("at")
    fresh = rows.select("game_key", "obs_date", at, "place", "capture_url", "percent_unsold", now.alias("seen"))
    held = fresh.groupBy("game_key", "obs_date").agg(F.collect_list(F.struct("at", "place", "capture_url", "percent_unsold", "seen")).alias("held"))
    held = held.select("game_key", "obs_date", F.sort_array("held").alias("held"), now.alias("now"))
    held = held.withColumn("old", F.filter("held", lambda c: c.seen != F.col("now")))
    held = held.withColumns({"best": F.element_at("held", -1).dropFields("seen"), "before": F.try_element_at("old", F.lit(-1)).dropFields("seen")})

    def panel(sign: int, c):
        nothing = F.lit(None).cast("long").alias("kept_at"), F.lit(None).cast("string").alias("kept_capture_url")
        return F.struct(F.lit("panel").alias("kind"), F.lit(sign).alias("sign"), c.at.alias("at"), c.capture_url.alias("capture_url"), c.percent_unsold.alias("percent_unsold"), *nothing)

    def superseded(sign: int, losers, c):
        unsold = F.lit(None).cast("double").alias("percent_unsold")
        kept = c.at.alias("kept_at"), c.capture_url.alias("kept_capture_url")
        return F.transform(losers, lambda x: F.struct(F.lit("superseded").alias("kind"), F.lit(sign).alias("sign"), x.at.alias("at"), x.capture_url.alias("capture_url"), unsold, *kept))

    best, before = F.col("best"), F.col("before")
    but_last = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    first = F.concat(F.array(panel(1, best)), superseded(1, but_last("held"), best))
    moved = F.concat(F.array(panel(-1, before)), superseded(-1, but_last("old"), before), first)
    same = superseded(1, F.filter("held", lambda c: c.seen == F.col("now")), best)
    changes = F.when(F.size("old") == 0, first).when(best.eqNullSafe(before), same).otherwise(moved)
    return held.select("game_key", "obs_date", F.explode(changes).alias("c")).select("c.kind", "c.sign", "game_key", "obs_date", *[f"c.{c}" for c in ("at", "capture_url", "percent_unsold", "kept_at", "kept_capture_url")])


def fold_into(changes: DataFrame, folder: str, checkpoint: str) -> None:
    """Take in all there is: each batch's changes go to a folder named by its number, which a repeated batch replaces."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    changes.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def folded(spark: SparkSession, folder: str, schema: str = CAPTURES) -> DataFrame:
    """What the changes of all batches come to: rows that were added more often than taken back, as often as that."""
    rows = spark.read.schema(schema).parquet(folder)
    names = [c for c in rows.columns if c not in ("sign", "batch")]
    left = rows.groupBy(*names).agg(F.sum("sign").alias("times")).filter("times > 0")
    return left.withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(*names)


def compacted(spark: SparkSession, folder: str, to: str, schema: str = CAPTURES) -> None:
    """The folded rows as one batch of additions in another folder; later batches may be written beside it."""
    folded(spark, folder, schema).withColumn("sign", F.lit(1)).select(*[c.split()[0] for c in schema.split(", ")]).write.mode("overwrite").parquet(f"{to}/batch=-1")
