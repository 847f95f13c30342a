"""Settings as rows: validation, vocabularies, versions, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that no setting may hold, and the words for true and false.
FORBIDDEN = "[\"'\\n\\r$`\\\\]"
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def text_value(v: Column) -> Column:
    """The trimmed text, or null if it is empty or holds a forbidden character."""
    s = F.trim(v)
    return F.when((s != "") & ~s.rlike(FORBIDDEN), s)


def positive_int(v: Column) -> Column:
    s = F.trim(v)
    n = F.when(s.rlike("^[0-9]+$"), s).try_cast("bigint")
    return F.when(n >= 1, n.cast("string"))


def positive_number(v: Column) -> Column:
    s = F.trim(v)
    n = F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s).try_cast("double")
    return F.when((n > 0) & (n < F.lit(float("inf"))), s)


def switch(v: Column) -> Column:
    s = F.lower(F.trim(v))
    return F.when(s.isin(*TRUE), "1").when(s.isin(*FALSE), "0")


def one_of(v: Column, allowed) -> Column:
    s = F.trim(v)
    return F.when(s.isin(*allowed), s)


def validated(updates: DataFrame, kinds: dict[str, str | tuple]) -> DataFrame:
    """updates (key, value) with `clean` and `error`; kinds: key -> text, int, number, switch or a tuple of words.

    Keys without a kind are not editable.
    """
    checks = {"text": text_value, "int": positive_int, "number": positive_number, "switch": switch}
    clean, known = F.lit(None).cast("string"), F.col("key").isin(*kinds)
    for key, kind in kinds.items():
        value = one_of(F.col("value"), kind) if isinstance(kind, tuple) else checks[kind](F.col("value"))
        clean = F.when(F.col("key") == key, value).otherwise(clean)
    out = updates.withColumn("clean", clean)
    return out.withColumn("error", F.when(~known, "not editable").when(F.col("clean").isNull(), "invalid value"))


def number_or(v: Column, default: float) -> Column:
    """A finite positive number, or the default."""
    return F.coalesce(positive_number(v).try_cast("double"), F.lit(default))


def vocabulary(prices: DataFrame, used: DataFrame) -> DataFrame:
    """Distinct slugs of both, in order."""
    return prices.select("slug").union(used.select("slug")).filter("slug <> ''").distinct().orderBy("slug")


def newest(names: DataFrame, least_major: int = 20) -> DataFrame:
    """One row: the name (v1.2.3) whose numbers are greatest, of those with at least `least_major` first."""
    parts = F.transform(F.split(F.regexp_replace("name", "^v", ""), r"\."), lambda x: x.try_cast("int"))
    good = names.withColumn("parts", parts).filter((F.size("parts") == 3) & ~F.exists("parts", lambda x: x.isNull())).filter(F.col("parts")[0] >= least_major)
    return good.agg(F.max_by("name", "parts").alias("name"))


def missing_lines(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """The lines of `wanted` (ordinal, line) that `there` (line) doesn't have, in order."""
    return wanted.join(there.select(F.col("line").alias("__line")), F.col("line") == F.col("__line"), "left_anti").orderBy("ordinal")


def form_value(values: Column, is_list: Column) -> Column:
    """A field given several times: joined for a list, else its last value."""
    return F.when(is_list, F.array_join(values, ",")).otherwise(F.element_at(values, -1))


def with_prefix(values: Column, prefix: str) -> Column:
    return F.filter(values, lambda x: F.startswith(x, F.lit(prefix)))


def contradictions(payload: Column) -> Column:
    """The `contradictions` of a JSON answer as topic and positions; what is no object is its own topic."""
    listed = F.coalesce(F.from_json(F.get_json_object(payload, "$.contradictions"), "array<string>"), F.array().cast("array<string>"))
    kind = "struct<topic:string,positions:array<struct<label:string,stance:string>>>"

    def one(x):
        parsed = F.from_json(x, kind)
        loose = F.coalesce(F.get_json_object(x, "$.topic"), F.lit(""))
        positions = F.coalesce(F.filter(parsed.positions, lambda p: p.isNotNull()), F.array().cast("array<struct<label:string,stance:string>>"))
        return F.when(x.startswith("{"), F.struct(loose.alias("topic"), positions.alias("positions"))).otherwise(F.struct(x.alias("topic"), F.array().cast("array<struct<label:string,stance:string>>").alias("positions")))

    return F.transform(listed, one)
