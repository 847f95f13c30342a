"""Queries of recorded days and captures: state streams, the schema gate, gates over a history, as-of joins, changes between days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, json_schema, panel
from ..sources import changes, files, recordings
from ..streaming import lifecycle
from . import mappings as M
from .catalog import _EV, _PANEL, _query


def _observed(spark, sf_dir):
    return M.observations(spark, sf_dir).withColumnRenamed("event_id", "place").select("game_key", "obs_date", "capture_ts", "place", "capture_url", "percent_unsold")


# Streams with state ----------------------------------------------------------------------------


@_query(f"{_PANEL} SELECT game_key, obs_date, status AS lifecycle_status FROM l")
def stream_lifecycle(spark, sf_dir):
    """Observations as a stream with a state for each game, in two runs from one checkpoint: the labels of the whole panel."""
    base, rows = M.folder(spark, "lifecycle"), _observed(spark, sf_dir)
    half = rows.agg((F.min(F.unix_timestamp(F.col("capture_ts").cast("timestamp"))) + F.max(F.unix_timestamp(F.col("capture_ts").cast("timestamp")))) / 2)
    first = F.unix_timestamp(F.col("capture_ts").cast("timestamp")) < half.first()[0]
    for part in (first, ~first):
        rows.filter(part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        lifecycle.fold_into(lifecycle.lifecycle_changes(stream), f"{base}/out", f"{base}/state")
    return lifecycle.labels(spark.read.schema(lifecycle.LABELS).parquet(f"{base}/out"))


@_query(f"""{_PANEL} SELECT 'panel' AS kind, game_key, obs_date, capture_url, NULL AS kept_capture_url, pu AS percent_unsold FROM p
UNION ALL SELECT 'superseded', game_key, obs_date, capture_url, kept_url, NULL FROM r WHERE rn > 1""")
def stream_superseded(spark, sf_dir):
    """Captures that come in any order, in three runs from one checkpoint: the panel and the superseded log of all of them."""
    base, rows = M.folder(spark, "superseded"), _observed(spark, sf_dir)
    for k in range(3):
        rows.filter(F.pmod(F.xxhash64("place"), F.lit(3)) == k).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        lifecycle.fold_into(lifecycle.capture_changes(stream), f"{base}/out", f"{base}/state")
    return lifecycle.folded(spark, f"{base}/out").select("kind", "game_key", "obs_date", "capture_url", "kept_capture_url", "percent_unsold")


# The schema gate -------------------------------------------------------------------------------

_FLAGS = ("anomaly_candidate", "ev_out_of_range", "low_inventory", "no_print_run", "sold_out")
_GRADES = ("A", "A-", "B+", "B", "B-", "C", "D", "F")


def _broken_documents(spark, sf_dir):
    """A document for each game, of which each keyword of the schema is broken in turn."""
    k, known = F.col("game_no") % 17, F.col("ev_ratio").isNotNull()
    scenario = F.element_at("ev_scenarios", 1)
    rows = M.latest(spark, sf_dir).withColumns(
        {
            "confidence": F.when(k == 2, "odd").otherwise(F.col("confidence")),
            "grade": F.when(k == 3, "Z").otherwise(F.col("grade")),
            "flags": F.when(k == 4, F.array(F.lit("zz"), F.lit("sold_out"))).otherwise(F.col("flags")),
            "ev_scenarios": F.when((k == 5) & known, F.slice("ev_scenarios", 1, 2)).when((k == 11) & known, F.array_append("ev_scenarios", scenario)).otherwise(F.col("ev_scenarios")),
            "name": F.when(k == 6, "").otherwise(F.col("name")),
            "top_prizes": F.when(k == 10, F.transform("top_prizes", lambda x: x.withField("level", F.lit(None).cast("bigint")))).otherwise(F.col("top_prizes")),
        }
    )
    game = F.struct("game_no", "name", "price", "percent_unsold", "total_unclaimed", "top_prizes", "print_run", "ev_ratio", "dead_game", "flags", "confidence", "grade", "reason", "ev_scenarios")
    text = F.to_json(F.struct(F.col("as_of").cast("string").alias("as_of"), F.lit("July 11, 2026 7:05 AM").alias("source_timestamp"), F.array(game).alias("games")), {"ignoreNullFields": "false"})
    text = F.when(k == 1, F.replace(text, F.lit('"name":'), F.lit('"nom":'))).when(k == 8, F.regexp_replace(text, r'"price":([0-9.]+)', '"price":"$1"')).when(k == 10, F.replace(text, F.lit('"level_label"'), F.lit('"label"'))).when(k == 12, F.regexp_replace(text, r'"game_no":(\d+)', '"game_no":$1.5')).when(k == 13, F.substring(text, 1, 50)).otherwise(text)
    return rows.select("game_no", text.alias("document"))


_BROKEN = f"""{_EV}, t AS (SELECT k, count(*) n FROM tiers GROUP BY 1), v AS (
SELECT '$.games[].name' AS path, 'required' AS keyword, count(*) AS n FROM latest WHERE game_no % 17 = 1
UNION ALL SELECT '$.games[].confidence', 'enum', count(*) FROM latest WHERE game_no % 17 = 2 UNION ALL SELECT '$.games[].grade', 'enum', count(*) FROM latest WHERE game_no % 17 = 3
UNION ALL SELECT '$.games[].flags[]', 'enum', count(*) FROM latest WHERE game_no % 17 = 4 UNION ALL SELECT '$.games[].ev_scenarios', 'minItems', count(ev) FROM latest WHERE game_no % 17 = 5
UNION ALL SELECT '$.games[].name', 'minLength', count(*) FROM latest WHERE game_no % 17 = 6 UNION ALL SELECT '$.games[].price', 'type', count(*) FROM latest WHERE game_no % 17 = 8
UNION ALL SELECT '$.games[].top_prizes[].level_label', 'required', coalesce(sum(n), 0)::BIGINT FROM latest JOIN t ON k = game_no WHERE game_no % 17 = 10
UNION ALL SELECT '$.games[].ev_scenarios', 'maxItems', count(ev) FROM latest WHERE game_no % 17 = 11 UNION ALL SELECT '$.games[].game_no', 'type', count(*) FROM latest WHERE game_no % 17 = 12
UNION ALL SELECT '$', 'json', count(*) FROM latest WHERE game_no % 17 = 13)"""


@_query(f"{_BROKEN} SELECT path, keyword, n FROM v WHERE n > 0")
def gate_schema(spark, sf_dir):
    """Documents against the schema, which is data: violations by path and keyword."""
    found = json_schema.violations(_broken_documents(spark, sf_dir), "document", json_schema.latest(_FLAGS, _GRADES))
    return found.groupBy(F.regexp_replace("path", r"\d+", "").alias("path"), "keyword").agg(F.count("*").alias("n"))


@_query(f"{_EV} SELECT count(*) AS documents, 0::BIGINT AS broken, 0::BIGINT AS violations, true AS passed FROM latest")
def gate_schema_passed(spark, sf_dir):
    """The documents as they are: the schema has no fault to find."""
    rows = M.latest(spark, sf_dir)
    game = F.struct("game_no", "name", "price", "percent_unsold", "total_unclaimed", "top_prizes", "print_run", "ev_ratio", "dead_game", "flags", "confidence", "grade", "reason", "ev_scenarios")
    text = F.to_json(F.struct(F.col("as_of").cast("string").alias("as_of"), F.lit("now").alias("source_timestamp"), F.array(game).alias("games")), {"ignoreNullFields": "false"})
    return json_schema.gate(rows.select(text.alias("document")), "document", json_schema.latest(_FLAGS, _GRADES))


# Gates over a history --------------------------------------------------------------------------

_DAYS = """WITH RECURSIVE e AS (SELECT ts::DATE AS as_of, user_id % 60 AS game_no, round_even(avg(value) / 100::DOUBLE * 1e6, 0) / 1e6 AS ratio FROM events GROUP BY ALL),
r AS (SELECT as_of, game_no, CASE WHEN day(as_of) % 4 = 0 THEN ratio + (game_no % 5) * 2 ELSE round_even(ratio / 8 * 1e6, 0) / 1e6 + CASE WHEN day(as_of) % 7 = 0 THEN 3 ELSE 0 END END AS ratio FROM e),
d AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS k, (SELECT map(list(game_no), list(ratio)) FROM r WHERE r.as_of = x.as_of) AS m FROM (SELECT DISTINCT as_of FROM r) x),
f AS (SELECT k, as_of, m AS held, NULL::DATE AS prior, as_of AS last, 0::BIGINT AS compared, 0::BIGINT AS moved, true AS passed FROM d WHERE k = 1
UNION ALL SELECT k, as_of, CASE WHEN ok THEN m ELSE held END, last, CASE WHEN ok THEN as_of ELSE last END, compared, moved, ok FROM (
  SELECT *, coalesce(moved / nullif(compared, 0) <= 0.3::DOUBLE, true) AS ok FROM (
  SELECT d.k, d.as_of, d.m, f.held, f.last, (SELECT count(*) FROM (SELECT unnest(map_keys(d.m)) g) WHERE f.held[g] IS NOT NULL)::BIGINT AS compared,
    (SELECT count(*) FROM (SELECT unnest(map_keys(d.m)) g) WHERE abs(d.m[g] - f.held[g]) > 0.2::DOUBLE)::BIGINT AS moved FROM f JOIN d ON d.k = f.k + 1)))"""


@_query(f"{_DAYS} SELECT as_of, prior, compared, moved, passed FROM f")
def gate_history(spark, sf_dir):
    """Each day against the last day before it that itself passed."""
    e = M.table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("as_of"), (F.col("user_id") % 60).alias("game_no")).agg((F.rint(F.avg("value") / 100 * 1e6) / 1e6).alias("ratio"))
    day = F.dayofmonth("as_of")
    ratio = F.when(day % 4 == 0, F.col("ratio") + (F.col("game_no") % 5) * 2).otherwise(F.rint(F.col("ratio") / 8 * 1e6) / 1e6 + F.when(day % 7 == 0, 3).otherwise(0))
    return gates.history_gate(e.select("as_of", "game_no", ratio.alias("ev_ratio")))


# End dates as they were known ------------------------------------------------------------------

_ENDS = f"""{_PANEL}, a AS (SELECT game_key, known_at, arg_max(end_date, event_id) AS end_date FROM (SELECT game_key, capture_ts AS known_at, event_id, obs_date + (event_id % 25)::INT AS end_date FROM o WHERE event_id % 3 = 0) GROUP BY ALL),
j AS (SELECT p.*, a.end_date, a.known_at FROM p ASOF LEFT JOIN a ON p.game_key = a.game_key AND p.capture_ts >= a.known_at)"""


def _ends(spark, sf_dir):
    o = M.observations(spark, sf_dir).filter("event_id % 3 = 0")
    said = o.select("game_key", F.col("capture_ts").alias("known_at"), "event_id", F.date_add("obs_date", (F.col("event_id") % 25).cast("int")).alias("end_date"))
    return said.groupBy("game_key", "known_at").agg(F.max_by("end_date", "event_id").alias("end_date"))


@_query(f"{_ENDS} SELECT game_key, obs_date, end_date, known_at FROM j")
def end_dates_known(spark, sf_dir):
    """The end date that was known of a game when it was observed."""
    return panel.as_of(M.panel_rows(spark, sf_dir), _ends(spark, sf_dir), ["game_key"], "capture_ts", "known_at").select("game_key", "obs_date", "end_date", "known_at")


@_query(f"""{_ENDS}, e AS (SELECT *, lead(obs_date) OVER (PARTITION BY game_key ORDER BY obs_date) IS NULL AS is_last FROM j)
SELECT game_key, obs_date, CASE WHEN NOT is_last THEN 'active' WHEN pu = 0 OR end_date < (SELECT max(obs_date) FROM p) THEN 'exited_observed' WHEN obs_date < (SELECT max(obs_date) FROM p) THEN 'exited_unobserved' ELSE 'active' END AS lifecycle_status FROM e""")
def lifecycle_confirmed(spark, sf_dir):
    """Lifecycles where an end date that was known in time counts as an observed exit."""
    rows = panel.as_of(M.panel_rows(spark, sf_dir), _ends(spark, sf_dir), ["game_key"], "capture_ts", "known_at")
    return panel.with_lifecycle(rows, confirmed="end_date").select("game_key", "obs_date", "lifecycle_status")


# Recordings ------------------------------------------------------------------------------------


@_query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS timestamp, event_id % 97 AS page, 10 + event_id % 97 AS chars FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_id % 3 <> 0")
def recorded_captures(spark, sf_dir):
    """Events as recorded captures: index files and pages are written, and read through filters that the source takes over."""
    folder, e = M.folder(spark, "recordings"), M.table(spark, sf_dir, "events")
    k = F.col("event_id")
    index = e.select(
        F.format_string("part-%08d", F.expr("event_id div 500")).alias("file"), k.alias("place"), F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"), F.concat(F.lit("https://x/"), k.cast("string")).alias("original"),
        F.concat(F.lit("d"), (k % 97).cast("string")).alias("digest"), F.when(k % 3 == 0, "404").otherwise("200").alias("status"),
    )
    pages = e.select((k % 97).alias("n")).distinct().select(F.concat(F.lit("d"), F.col("n").cast("string")).alias("digest"), F.repeat(F.lit("x"), (F.col("n") + 10).cast("int")).alias("html"))
    recordings.record(index, pages, folder)
    found = recordings.captured(spark, folder).filter("timestamp >= '20240110000000' and status = '200'")
    return found.select(F.regexp_extract("original", r"(\d+)$", 1).cast("bigint").alias("event_id"), "timestamp", F.substring("digest", 2, 9).cast("bigint").alias("page"), F.length("html").cast("bigint").alias("chars"))


# Documents and their changes -------------------------------------------------------------------

_DOCS = """WITH g AS (SELECT ts::DATE AS as_of, user_id % 40 AS game_no, count(*) AS n, arg_max(event_type, event_id) AS name FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY game_no) - 1 AS i FROM g)"""


def _documents(spark, sf_dir):
    e = M.table(spark, sf_dir, "events")
    games = e.groupBy(F.col("ts").cast("date").cast("string").alias("as_of"), (F.col("user_id") % 40).alias("game_no")).agg(F.count("*").alias("n"), F.max_by("event_type", "event_id").alias("name"))
    return files.document_text(games)


@_query(f"""{_DOCS}, v AS (SELECT as_of, 'games.' || i || '.' || f AS path, v FROM (SELECT as_of, i, unnest(['game_no', 'n', 'name']) f, unnest([game_no::VARCHAR, n::VARCHAR, '"' || name || '"']) v FROM r) UNION ALL SELECT DISTINCT as_of, 'as_of', '"' || as_of::VARCHAR || '"' FROM g),
d AS (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS next FROM (SELECT DISTINCT as_of FROM g)),
c AS (SELECT coalesce(a.as_of, b.next) AS as_of, coalesce(a.path, b.path) AS path, b.v AS before, a.v AS value, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS op
  FROM v a FULL JOIN (SELECT v.*, next FROM v JOIN d USING (as_of) WHERE next IS NOT NULL) b ON a.as_of = b.next AND a.path = b.path WHERE a.v IS DISTINCT FROM b.v)
SELECT as_of, path, before, value, op FROM c""")
def history_changes(spark, sf_dir):
    """What each day's document adds to, changes in and takes from the one before it, field by field."""
    out = changes.changes(changes.leaves(_documents(spark, sf_dir)))
    return out.select("as_of", F.array_join(F.from_json("path", "array<string>"), ".").alias("path"), "before", "value", "op")


@_query(f"""{_DOCS} SELECT as_of, sha256('{{' || chr(10) || '  "as_of": "' || as_of || '",' || chr(10) || '  "games": [' || chr(10) || string_agg('    {{' || chr(10) || '      "game_no": ' || game_no || ',' || chr(10) || '      "n": ' || n || ',' || chr(10) || '      "name": "' || name || '"' || chr(10) || '    }}', ',' || chr(10) ORDER BY i) || chr(10) || '  ]' || chr(10) || '}}') AS sha256 FROM r GROUP BY 1""")
def history_rebuilt(spark, sf_dir):
    """Each day's document, byte by byte, from the first one and the changes."""
    documents = _documents(spark, sf_dir)
    out = changes.rebuilt(changes.changes(changes.leaves(documents)), documents.select(F.col("as_of").cast("date").alias("as_of")))
    return out.select("as_of", F.sha2("value", 256).alias("sha256"))
