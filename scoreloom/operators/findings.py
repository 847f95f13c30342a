"""Reviewers' findings: union, disputes, rulings and fail-closed verdicts, for many tasks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .opinions import first_object

RANKS = {"critical": 0, "major": 1, "minor": 2}
KEY = ("task_id", "issue_key", "file", "line")
_FIELDS = {"severity": "string", "issue": "string", "file": "string", "line": "int", "stance": "string"}


def rank(severity):
    out = F.lit(3)
    for name, k in RANKS.items():
        out = F.when(severity == name, k).otherwise(out)
    return out


def survivors(entries: DataFrame) -> DataFrame:
    """Entries (task_id, idx, slug, payload, note) whose answer could be read, labelled A, B, ... in order, without slug."""
    kept = entries.filter("payload is not null")
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("idx"))
    return kept.withColumn("label", F.char(F.lit(64) + place)).drop("slug")


#: Fixed words of a lost expert, and of a panel that could not form.
NO_OUTPUT = "no usable output"
NO_PANEL = "Panel could not form: fewer than 2 experts returned usable output."
TOO_FEW = "Fewer than two experts survived; a single opinion is not a panel."


def enough(entries: DataFrame, least: int = 2) -> DataFrame:
    """Per task: survivors, dropped slugs, blind spots, whether there are enough, and how many answered in more than prose.

    An entry may have an `error`, which is then the reason why it was dropped.
    """
    why = F.coalesce("error", F.lit(NO_OUTPUT)) if "error" in entries.columns else F.lit(NO_OUTPUT)
    lost = F.array_sort(F.collect_list(F.when(F.col("payload").isNull(), F.struct("idx", "slug", why.alias("why")))))
    out = entries.groupBy("task_id").agg(F.count("payload").alias("survivors"), lost.alias("lost"), F.count_if(F.col("payload").isNotNull() & (F.col("note") != "prose")).alias("structured"))
    spots = F.transform("lost", lambda x: F.concat(F.lit("dropped expert: "), x.slug, F.lit(" \u2014 "), x.why))
    return out.select("task_id", "survivors", F.transform("lost", lambda x: x.slug).alias("dropped"), "structured", (F.col("survivors") >= least).alias("enough"), spots.alias("blind_spots"))


def with_listed(state: DataFrame, listed: DataFrame) -> DataFrame:
    """state (of enough()) whose blind spots begin with those that the synthesizer lists: listed (task_id, spots)."""
    own = listed.groupBy("task_id").agg(F.flatten(F.collect_list("spots")).alias("spots"))
    return state.join(own, "task_id", "left").withColumn("blind_spots", F.concat(F.coalesce("spots", F.array().cast("array<string>")), "blind_spots")).drop("spots")


def failures(entries: DataFrame, role: str = "reviewer") -> DataFrame:
    """One row for each task without enough survivors: the opinions there are, or a stand-in, and the verdict REVISE.

    entries as opinions.read() gives them, with tokens_in, tokens_out and cost_usd.
    """
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    opinion = F.struct("idx", F.col("slug").alias("model"), F.lit(role).alias("role"), "summary", "recommendation", "confidence", zero("tokens_in", "bigint"), zero("tokens_out", "bigint"), zero("cost_usd", "double"))
    held = entries.groupBy("task_id").agg(F.array_sort(F.collect_list(F.when(F.col("payload").isNotNull(), opinion))).alias("held"))
    empty = F.struct(F.lit(0).alias("idx"), F.lit("panel/none").alias("model"), F.lit(role).alias("role"), F.lit(NO_PANEL).alias("summary"), F.lit("").alias("recommendation"), F.lit(0.0).alias("confidence"), F.lit(0).cast("bigint").alias("tokens_in"), F.lit(0).cast("bigint").alias("tokens_out"), F.lit(0.0).alias("cost_usd"))
    given = F.transform(F.when(F.size("held") > 0, F.col("held")).otherwise(F.array(empty)), lambda o: o.dropFields("idx"))
    out = enough(entries).filter("not enough").join(held, "task_id")
    return out.select("task_id", "survivors", given.alias("opinions"), "blind_spots", F.lit(TOO_FEW).alias("rationale"), F.lit("REVISE").alias("verdict"))


def dispatched(entries: DataFrame, seed: int) -> DataFrame:
    """entries with `turn`: the seeded order in which they are asked; answers are still collected by idx."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), "task_id", "slug"))
    return entries.withColumn("turn", F.row_number().over(Window.partitionBy("task_id").orderBy(mixed, "idx")))


def parsed(payload):
    """The payload as a variant, or null if it is no JSON object."""
    value = F.try_parse_json(payload)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def readable(entries: DataFrame) -> DataFrame:
    """entries with payloads that a strict reader takes (of a repeated key the last value, NaN and infinities null).

    One that still can't be read counts as a lost answer: it must not pass as one without findings.
    """
    own = F.col("payload")
    strict = parsed(own).isNotNull()
    anew = F.col("__anew.object")
    read = entries.withColumn("__anew", first_object(F.when(own.isNotNull() & ~strict, F.array(own))))
    return read.withColumn("payload", F.when(strict, own).otherwise(F.when(parsed(anew).isNotNull(), anew))).drop("__anew")


def exploded(entries: DataFrame) -> DataFrame:
    """One row for each finding of a readable answer.

    A `findings` field that is no list counts as none; members that are no objects are left out, each by itself.
    """
    listed = F.try_variant_get(parsed(F.col("payload")), "$.findings", "array<variant>")
    out = entries.filter("payload is not null").select("task_id", "idx", "slug", F.posexplode(listed).alias("pos", "f")).filter(F.schema_of_variant("f").startswith("OBJECT"))
    fields = [F.try_variant_get("f", f"$.{name}", kind).cast("string").alias(name) for name, kind in _FIELDS.items()]
    return out.select("task_id", F.struct("idx", "pos").alias("ord"), "slug", *fields)


def union(findings: DataFrame) -> DataFrame:
    """One row a distinct finding: worst severity, dispute, models; the text first seen.

    findings: task_id, ord, slug, issue, severity, file, line, stance. Unknown severities are left out;
    a line that is no number is 0; a missing stance is 'issue'.
    """
    rows = findings.filter(F.col("severity").isin(*RANKS)).select(
        "task_id", "ord", "slug", "severity", F.coalesce("issue", F.lit("")).alias("issue"), F.coalesce("file", F.lit("")).alias("file"),
        F.coalesce(F.col("line").cast("string").try_cast("int"), F.lit(0)).alias("line"), F.coalesce("stance", F.lit("issue")).alias("stance"),
    )
    grouped = rows.withColumn("issue_key", F.lower(F.trim("issue"))).groupBy(*KEY).agg(
        F.min(rank(F.col("severity"))).alias("worst"),
        F.collect_set("severity").alias("severities"),
        F.collect_set("stance").alias("stances"),
        F.sort_array(F.collect_set("slug")).alias("source_models"),
        F.min_by("issue", "ord").alias("issue"),
    )
    split = F.array_contains("stances", "issue") & F.array_contains("stances", "not_an_issue")
    out = grouped.withColumns({"severity": F.element_at(F.array(*[F.lit(s) for s in RANKS]), F.col("worst") + 1), "disputed": (F.size("severities") > 1) | split})
    order = Window.partitionBy("task_id").orderBy("worst", "issue_key", "file", "line")
    return out.withColumn("id", F.concat(F.lit("F"), F.row_number().over(order))).withColumn("confidence", F.lit(0.0)).drop("stances")


def ruled(found: DataFrame, rulings: DataFrame) -> DataFrame:
    """Disputed findings with the last ruling on them; anything but upheld or rejected is no ruling."""
    w = Window.partitionBy("task_id", "id").orderBy(F.desc("ord"))
    last = rulings.filter("id is not null").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("task_id", "id", F.when(F.col("ruling").isin("upheld", "rejected"), F.col("ruling")).alias("said"))
    return found.join(last, ["task_id", "id"], "left").withColumn("arbiter_ruling", F.when(F.col("disputed"), F.col("said"))).drop("said")


def counts():
    """A finding counts unless it is disputed and expressly rejected: no ruling is no acquittal."""
    return ~(F.col("disputed") & F.col("arbiter_ruling").eqNullSafe(F.lit("rejected")))


def verdicts(found: DataFrame) -> DataFrame:
    worst = F.min(F.when(counts(), F.col("worst")))
    return found.groupBy("task_id").agg(F.count("*").alias("findings"), F.count_if(F.col("disputed")).alias("disputed"), F.when(worst == 0, "FAIL").when(worst == 1, "REVISE").otherwise("PASS").alias("verdict"))


def review(entries: DataFrame, rulings: DataFrame) -> DataFrame:
    """The verdict of each task: too few survivors, or prose alone without findings, is REVISE."""
    entries = readable(entries)
    state = enough(entries)
    found = verdicts(ruled(union(exploded(entries)), rulings)).withColumnRenamed("verdict", "derived")
    out = state.join(found, "task_id", "left")
    failed = ~F.col("enough") | ((F.col("structured") == 0) & F.col("findings").isNull())
    return out.select("task_id", "survivors", "dropped", "blind_spots", F.coalesce("findings", F.lit(0)).alias("findings"), F.when(failed, "REVISE").otherwise(F.coalesce("derived", F.lit("PASS"))).alias("verdict"))


def plan_verdict(worst, contradictions):
    """FAIL on a critical finding, REVISE on a major one or any contradiction."""
    return F.when(worst == 0, "FAIL").when((worst == 1) | (contradictions > 0), "REVISE").otherwise("PASS")


def exit_code(verdict, breached):
    return F.when(verdict.isNull() | ~verdict.isin("PASS", "FAIL", "REVISE"), 3).when(F.coalesce(breached, F.lit(False)) | (verdict == "REVISE"), 2).when(verdict == "FAIL", 1).otherwise(0)


def diagnostics(entries: DataFrame, cap: int = 4000) -> DataFrame:
    """entries with what became of each answer: survived, how it was recovered, the first `cap` characters, whether that is all."""
    text = F.coalesce("content", F.lit(""))
    return entries.withColumns({"survived": F.col("payload").isNotNull(), "recovered_via": F.col("note"), "preview": F.substring(text, 1, cap), "truncated": F.length(text) > cap})
