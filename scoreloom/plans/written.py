"""Queries of what is written and read back, and of values that no other query compares."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import config, findings, gates, opinions
from ..schemas import PANEL_RULES, TIERS
from ..sources import files
from . import mappings as M
from .catalog import _EV, _PANEL, _query

# Files -----------------------------------------------------------------------------------------

_DAY = """'{"as_of":"2001-01-01","games":[{"game_no":' || p_partkey || ',"name":"' || p_name || '","price":' || p_size || ',"percent_unsold":' || p_size % 100 || ',"total_unclaimed":5,"top_prizes":[]}]}'"""


@_query(f"SELECT p_partkey AS game_no, sha256({_DAY}) AS content_hash, '2001-01-01T00:00:00+00:00' AS retrieved_at, '/h/' || p_partkey || '.json' AS capture_url, 'daily@1' AS parser_version, false AS has_noncash_prize FROM part")
def history_hashes(spark, sf_dir):
    """Where each record of a history file is from: the file's digest, its path and time."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size")
    text = F.concat(F.lit('{"as_of":"2001-01-01","games":[{"game_no":'), k, F.lit(',"name":"'), "p_name", F.lit('","price":'), size.cast("string"), F.lit(',"percent_unsold":'), (size % 100).cast("string"), F.lit(',"total_unclaimed":5,"top_prizes":[]}]}'))
    raw = M.table(spark, sf_dir, "part").select(F.concat(F.lit("/h/"), k, F.lit(".json")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    return files.observed(raw).select("game_no", "content_hash", "retrieved_at", "capture_url", "parser_version", "has_noncash_prize")


@_query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE strftime(ts, '%Y%m%d%H%M%S') END AS timestamp, CASE WHEN event_id % 10 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS capture_ts,
  'https://web.archive.org/web/' || CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE strftime(ts, '%Y%m%d%H%M%S') END || 'id_/' || event_type AS capture_url FROM events""")
def capture_rows(spark, sf_dir):
    """Each row of the capture indexes: its time in both forms and its address."""
    ts = F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    row = F.to_json(F.array(F.array(F.lit("timestamp"), F.lit("original"), F.lit("digest")), F.array(ts, F.col("event_type"), F.col("event_id").cast("string"))))
    out = files.captures(M.table(spark, sf_dir, "events").select(row.alias("value")))
    return out.select(F.col("digest").cast("bigint").alias("event_id"), "timestamp", "capture_ts", "capture_url")


@_query(f"""{_PANEL}, s AS (SELECT *, event_id % 3 = 0 AS daily FROM o),
q AS (SELECT *, row_number() OVER (PARTITION BY game_key, obs_date ORDER BY capture_ts DESC, daily DESC, capture_url DESC) rn FROM s), z AS (SELECT * FROM q WHERE rn = 1),
e AS (SELECT *, CASE WHEN lead(obs_date) OVER (PARTITION BY game_key ORDER BY obs_date) IS NOT NULL THEN 'active' WHEN pu = 0 THEN 'exited_observed' WHEN obs_date < (SELECT max(obs_date) FROM z) THEN 'exited_unobserved' ELSE 'active' END status FROM z)
SELECT '{{"capture_url":"' || capture_url || '","game_key":"' || game_key || '","lifecycle_status":"' || status || '","note":null,"obs_date":"' || obs_date::VARCHAR || '","source":"' || CASE WHEN daily THEN 'daily' ELSE 'wayback' END || '"}}' AS line, true AS in_order FROM e""")
def panel_written(spark, sf_dir):
    """The panel of two sources as sorted lines of JSON, keys in order, nulls written: the lines, and whether each comes after the one before it."""
    o = M.observations(spark, sf_dir).withColumn("content_hash", F.lit(""))
    daily = F.col("event_id") % 3 == 0
    merged, _ = files.panel_from(o.filter(~daily).withColumn("source", F.lit("wayback")), o.filter(daily).withColumn("source", F.lit("daily")))
    at = M.folder(spark, "panel")
    files.write_jsonl(merged.select("obs_date", "game_key", "lifecycle_status", "source", "capture_url", F.lit(None).cast("string").alias("note")), at, ["obs_date", "game_key"])
    lines = spark.read.text(at).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
    key = F.concat_ws(" ", F.get_json_object("value", "$.obs_date"), F.get_json_object("value", "$.game_key"))
    before = F.lag(key).over(Window.partitionBy("file").orderBy("place"))
    return lines.select(F.col("value").alias("line"), F.coalesce(before <= key, F.lit(True)).alias("in_order"))


@_query(f"{_EV} SELECT game_no, name, price, pu AS percent_unsold, tu AS total_unclaimed, '{M.TODAY}' AS as_of, 2::BIGINT AS copies, true AS same FROM latest")
def document_written(spark, sf_dir):
    """A day as one document: written, kept under its date as well with the same bytes, and read back strictly."""
    at = M.folder(spark, "document")
    files.write_document(M.inventory(spark, sf_dir)[0].select("as_of", "game_no", "name", "price", "percent_unsold", "total_unclaimed"), f"{at}/latest.json", history=f"{at}/history")
    day = files.document(spark, f"{at}/latest.json", "as_of string, games array<struct<game_no:bigint,name:string,price:double,percent_unsold:double,total_unclaimed:double>>")
    texts = files.whole_text(spark, f"{at}/latest.json").unionByName(files.whole_text(spark, f"{at}/history/*.json"))
    facts = texts.agg(F.count("*").alias("copies"), (F.count_distinct("html") == 1).alias("same"))
    first = files.first_file(files.whole_text(spark, f"{at}/history/*.json")).select(F.regexp_replace("file", r"\.json$", "").alias("day"))
    rows = day.select("as_of", F.explode("games").alias("g")).join(F.broadcast(first), F.col("day") == F.col("as_of")).crossJoin(F.broadcast(facts))  # one row each
    return rows.select("g.*", "as_of", "copies", "same")


@_query(f"{_EV} SELECT game_no, price, '{M.TODAY}'::DATE AS as_of FROM latest UNION ALL SELECT game_no, price, '{M.YESTERDAY}'::DATE FROM latest")
def published_days(spark, sf_dir):
    """Two days published behind a gate, one of them twice: a day replaces itself and leaves the other alone."""
    at = M.folder(spark, "published")
    for since, off in ((M.TODAY, 1.0), (M.YESTERDAY, 0.0), (M.TODAY, 0.0)):
        games = M.inventory(spark, sf_dir, since)[0]
        gates.publish(games.select("as_of", "game_no", (F.col("price") + off).alias("price")), at, parser=gates.parser_gate(games, 1, 1.0))
    return spark.read.schema("game_no bigint, price double, as_of date").parquet(at)


@_query("SELECT event_id, event_type AS kind, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events")
def lines_strict(spark, sf_dir):
    """Events as JSON lines, nulls written, read back by the strict reader."""
    at = M.folder(spark, "lines")
    rows = M.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    files.write_jsonl(rows, at, ["event_id"])
    return files.jsonl(spark, at, "event_id bigint, kind string, value double")


@_query("SELECT sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, sum(octet_length(encode(coalesce(text, '')))) <= 20971520 AS passed FROM documents")
def attachments_total(spark, sf_dir):
    raw = M.table(spark, sf_dir, "documents").select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return files.total_size(raw).select(F.col("bytes").cast("bigint").alias("bytes"), "passed")


_BAD = "SELECT event_id % 13 AS k, event_id % 4 <> 0 AS prized FROM l"


@_query(f"""{_PANEL}, b AS ({_BAD}) SELECT rule, n AS violations FROM (SELECT count(*) FILTER (WHERE k = 1) AS source, count(*) FILTER (WHERE k = 2) AS lifecycle, count(*) FILTER (WHERE k = 3) AS "interval", count(*) FILTER (WHERE k = 4 AND prized) AS labels FROM b) UNPIVOT (n FOR rule IN (source, lifecycle, "interval", labels))""")
def gate_panel(spark, sf_dir):
    """Panel records that break each rule in turn."""
    k = F.col("event_id") % 13
    pu = F.col("percent_unsold")
    rows = M.panel_records(spark, sf_dir).withColumns(
        {
            "source": F.when(k == 1, "other").otherwise("daily"),
            "lifecycle_status": F.when(k == 2, "gone").otherwise(F.col("lifecycle_status")),
            "pu_interval": F.when(k == 3, F.array(pu + 1, pu)).otherwise(F.array(pu, pu + 1)),
            "top_prizes": F.when(F.col("event_id") % 4 != 0, F.when(k == 4, F.transform("top_prizes", lambda t: t.withField("level", F.lit(None).cast("bigint")).withField("level_label", F.lit(None).cast("string")))).otherwise(F.col("top_prizes"))).otherwise(F.array().cast(TIERS)),
        }
    )
    return gates.violations(rows, PANEL_RULES)


# Values ----------------------------------------------------------------------------------------


@_query("SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS said FROM orders")
def page_dates(spark, sf_dir):
    """Dates with times as pages write them, behind `as of` or without it."""
    written = F.concat(F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" 7:05 AM "))
    page = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "now ").otherwise("Prizes as of "), written)
    return M.table(spark, sf_dir, "orders").select("o_orderkey", T.page_date(written).alias("day"), T.page_date(T.after_as_of(page)).alias("said"))


@_query("""SELECT conv_id::VARCHAR AS task_id, turn AS idx, CASE (conv_id + turn) % 10 WHEN 0 THEN 0.25 WHEN 1 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 0.75 ELSE 0 END::DOUBLE AS confidence FROM conversations""")
def opinion_confidence(spark, sf_dir):
    """Confidences within and beyond 0 and 1, as text, missing, and beyond all bounds."""
    k = (F.col("conv_id") + F.col("turn")) % 10
    said = F.element_at(F.array(*[F.lit(x) for x in (',"confidence":0.25', ',"confidence":7', ',"confidence":-0.5', "", ',"confidence":1.0', ',"confidence":1e999', ',"confidence":0.75', ',"confidence":"0.5"', ',"confidence":true', ',"confidence":-Infinity')]), (k + 1).cast("int"))
    rows = M.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("task_id"), F.col("turn").alias("idx"), F.concat(F.lit('{"summary":"x"'), said, F.lit("}")).alias("content"))
    return opinions.read(rows).select("task_id", "idx", "confidence")


@_query("""WITH t AS (SELECT conv_id, count(*) AS survivors FROM conversations GROUP BY 1)
SELECT conv_id::VARCHAR AS task_id, survivors, CASE WHEN conv_id % 3 = 2 THEN 1 ELSE 0 END::BIGINT AS findings, CASE WHEN survivors < 2 THEN 'REVISE' WHEN conv_id % 3 = 0 THEN 'REVISE' WHEN conv_id % 3 = 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM t""")
def review_prose(spark, sf_dir):
    """Tasks where all answer in prose, where one says in JSON that there is nothing, and where one finds something."""
    c = M.table(spark, sf_dir, "conversations")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    k = F.col("conv_id") % 3
    prose = F.rpad(F.concat(F.lit("I looked at turn "), F.col("turn").cast("string"), F.lit(" and it seems fine to me")), 60, ".")
    content = F.when(first & (k == 1), '{"summary":"fine","findings":[]}').when(first & (k == 2), '{"findings":[{"severity":"critical","issue":"x"}]}').otherwise(prose)
    rows = c.select(F.col("conv_id").cast("string").alias("task_id"), F.col("turn").alias("idx"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("slug"), content.alias("content"))
    return findings.review(opinions.read(rows), M.rulings(spark, sf_dir).filter("false")).select("task_id", "survivors", "findings", "verdict")


@_query("""SELECT p_partkey, p_type || '|' || p_size AS listed, CASE WHEN p_size % 4 = 0 THEN p_size::DOUBLE WHEN p_size % 4 = 1 THEN p_size / 2::DOUBLE ELSE 7.5 END AS number,
  CASE WHEN p_size % 2 = 0 THEN 'a,' || p_size ELSE p_size::VARCHAR END AS field, CASE WHEN p_size % 3 = 0 THEN 'x-' || p_size || '|x-' ELSE 'x-' END AS prefixed FROM part""")
def config_values(spark, sf_dir):
    """Comma lists, numbers or their default, fields given twice, values with a prefix."""
    size = F.col("p_size").cast("string")
    part = M.table(spark, sf_dir, "part")
    number = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" "), size)).when(F.col("p_size") % 4 == 1, (F.col("p_size") / 2).cast("string")).when(F.col("p_size") % 4 == 2, F.lit("-3")).otherwise(F.lit("many"))
    own = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("x-"), size)).otherwise(F.concat(F.lit("y-"), size))
    return part.select(
        "p_partkey", F.array_join(T.listed(F.concat(F.lit(" ,"), "p_type", F.lit(" , ,"), size, F.lit(","))), "|").alias("listed"), config.number_or(number, 7.5).alias("number"),
        config.form_value(F.array(F.lit("a"), size), F.col("p_size") % 2 == 0).alias("field"), F.array_join(config.with_prefix(F.array(own, F.lit("x-"), F.lit("yx-")), "x-"), "|").alias("prefixed"),
    )


@_query("""SELECT conv_id, turn, unnest(CASE (conv_id + turn) % 3 WHEN 0 THEN ['t' || turn || ':A=yes;B=no', 'loose:'] WHEN 1 THEN ['plain:'] ELSE [] END) AS found FROM conversations""")
def contradiction_rows(spark, sf_dir):
    """Contradictions of JSON answers: topics with positions, topics without, text in place of an object, none."""
    k = (F.col("conv_id") + F.col("turn")) % 3
    whole = F.concat(F.lit('{"contradictions":[{"topic":"t'), F.col("turn").cast("string"), F.lit('","positions":[{"label":"A","stance":"yes"},{"label":"B","stance":"no"}]},{"topic":"loose","positions":null}]}'))
    payload = F.when(k == 0, whole).when(k == 1, '{"contradictions":["plain"]}').otherwise('{"findings":[]}')
    out = M.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(config.contradictions(payload)).alias("c"))
    said = F.array_join(F.transform("c.positions", lambda p: F.concat(p.label, F.lit("="), p.stance)), ";")
    return out.select("conv_id", "turn", F.concat("c.topic", F.lit(":"), said).alias("found"))


@_query("""WITH en AS (SELECT conv_id::VARCHAR task_id, turn idx, repeat(text, 8) AS content FROM conversations), t AS (SELECT *, trim(content, ' ' || chr(9) || chr(10)) t FROM en)
SELECT task_id, idx, length(t) >= 40 AS survived, CASE WHEN length(t) >= 40 THEN 'prose' WHEN length(t) > 0 THEN 'noise' ELSE 'empty' END AS recovered_via, md5(left(content, 4000)) AS preview, length(content) > 4000 AS truncated FROM t""")
def diagnostic_whole(spark, sf_dir):
    """What became of long answers, with the previews that the log keeps of them."""
    c = M.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("task_id"), F.col("turn").alias("idx"), F.repeat("text", F.lit(8)).alias("content"))
    out = findings.diagnostics(opinions.read(c))
    return out.select("task_id", "idx", "survived", "recovered_via", F.md5("preview").alias("preview"), "truncated")
