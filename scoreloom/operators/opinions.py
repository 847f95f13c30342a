"""Models' answers: the JSON object that an answer holds, and the reviewer's opinion in it, as columns.

Steps: an answer's candidates for being JSON (the whole, each fenced block, what begins at its first
brace), the first of them that is an object, and then the opinion's fields, each the first one that is
told under any of its names.
"""

from __future__ import annotations

import json
import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.num import clamp
from ..functions.text import plain

#: Names under which models give a summary, a recommendation, an issue (fixed values, in order of preference).
SUMMARY_KEYS = ("summary", "analysis", "assessment", "overview", "review", "opinion")
ADVICE_KEYS = ("recommendation", "recommendations", "advice", "decision")
ISSUE_KEYS = ("issue", "problem", "finding", "where", "title", "description")
#: The fence, the least length of prose that counts, the most of it that is kept, a fixed sentence.
FENCE = r"(?s)```(?:json|JSON)?\s*(.*?)```"
LEAST_PROSE, MOST_SUMMARY = 40, 1200
ONLY_FINDINGS = "(structured findings only; no summary field returned)"
#: Findings that a summary made of them names.
NAMED = 3


def candidates(text: Column) -> Column:
    """What may be JSON in an answer, in the order in which it is tried."""
    tail = F.substring(text, F.greatest(F.instr(text, "{"), F.lit(1)), F.length(text))
    return F.concat(F.array(text), F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)), F.array(tail))


#: In place of an object that is there but can't be read: such an answer is lost, it isn't prose.
UNREADABLE = ""


def finite(text: str) -> float | None:
    """A number, the greatest there is in place of one beyond all bounds, null for NaN."""
    value = float(text)
    return None if math.isnan(value) else max(-sys.float_info.max, min(sys.float_info.max, value))


#: Whole numbers of more digits are rounded.
DIGITS = 38


def decoder() -> json.JSONDecoder:
    """Reads what models write: NaN, infinities and numbers beyond a double's reach become what JSON can hold."""
    return json.JSONDecoder(parse_constant=finite, parse_float=finite, parse_int=lambda t: int(t) if len(t) <= DIGITS else finite(t))


@F.pandas_udf(T.StructType([T.StructField("object", T.StringType()), T.StructField("place", T.IntegerType())]))
def first_object(lists):
    """The first candidate that is a JSON object, written anew (of a repeated key the last value), and its place.

    The last candidate may go on after its object, the others may not.
    """
    import pandas as pd

    decode, out = decoder().raw_decode, []
    for parts in lists:
        found = (None, None)
        for place, part in enumerate(() if parts is None else parts):
            start = (part or "").lstrip(" \t\n\r")
            try:
                value, end = decode(start)
            except ValueError:
                continue
            except RecursionError:
                found = (UNREADABLE, place)
                break
            if isinstance(value, dict) and (place == len(parts) - 1 or not start[end:].strip(" \t\n\r")):
                found = (json.dumps(value, allow_nan=False), place)
                break
        out.append(found)
    return pd.DataFrame(out, columns=["object", "place"]).astype({"place": "Int32"})


#: A filter on what follows from it isn't pushed below it, which would ask Python again, in more workers a task.
first_object = first_object.asNondeterministic()


def loose(found: Column, tried: Column) -> Column:
    """object (JSON text) and how it was found: json, fenced-json, embedded-json; both null if there is none. found is a column, as it is asked for often."""
    how = F.when(found.place == 0, "json").when(found.place == F.size(tried) - 1, "embedded-json").when(found.place.isNotNull(), "fenced-json")
    return F.struct(found.object.alias("object"), how.alias("how"))


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def told(value: Column, names) -> Column:
    """The first of the names under which an object has a text that isn't blank."""
    return F.coalesce(*[F.when(_kind(value, f"$.{n}") == "STRING", F.nullif(plain(F.try_variant_get(value, f"$.{n}", "string")), F.lit(""))) for n in names])


def _headline(listed: Column) -> Column:
    """A summary made of findings: how many name an issue, and the first ones."""
    names = F.transform(listed, lambda f: F.when(F.schema_of_variant(f) == "STRING", F.nullif(plain(F.try_variant_get(f, "$", "string")), F.lit(""))).when(F.schema_of_variant(f).startswith("OBJECT"), told(f, ISSUE_KEYS)))
    names = F.array_compact(names)
    count = F.size(names)
    more = F.when(count > NAMED, F.concat(F.lit(" (+"), (count - NAMED).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(count > 0, F.concat(count.cast("string"), F.lit(" finding(s): "), F.array_join(F.slice(names, 1, NAMED), "; "), more))


def read(answers: DataFrame, content: str = "content") -> DataFrame:
    """answers with payload (the object; null for a lost answer), note, summary, recommendation, plan and confidence.

    note: how the object was found, or prose, noise, empty. Prose of some length is an opinion without
    findings; an object with neither a summary nor findings is none. Confidence is within 0 and 1.
    """
    text = F.col(content)
    out = answers.withColumn("read", first_object(candidates(text))).withColumn("read", loose(F.col("read"), candidates(text))).withColumn("value", F.try_parse_json("read.object"))
    value, prose = F.col("value"), plain(F.coalesce(text, F.lit("")))
    listed = F.try_variant_get(value, "$.findings", "array<variant>")
    advice = told(value, ADVICE_KEYS)
    out = out.withColumns({"said": F.coalesce(told(value, SUMMARY_KEYS), _headline(listed), advice), "advice": advice, "prose": prose})
    usable = value.isNotNull() & (F.col("said").isNotNull() | (F.coalesce(F.size(listed), F.lit(0)) > 0))
    numeric = _kind(value, "$.confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")  # a number told as text is none
    lost = F.col("read.object").isNotNull() & value.isNull()  # there is an object that can't be read
    long = (F.length("prose") >= LEAST_PROSE) & ~lost
    note = F.when(usable, F.col("read.how")).when(lost, "empty").when(long, "prose").when(F.length("prose") > 0, "noise").otherwise("empty")
    out = out.withColumns(
        {
            "note": note,
            "payload": F.when(usable, F.col("read.object")).when(long, '{"findings": []}'),
            "summary": F.when(usable, F.coalesce("said", F.lit(ONLY_FINDINGS))).when(long, F.substring("prose", 1, MOST_SUMMARY)),
            "recommendation": F.when(usable, F.coalesce("advice", F.lit(""))).when(long, ""),
            "plan": F.when(usable & (_kind(value, "$.plan") == "STRING"), F.try_variant_get(value, "$.plan", "string")).when(usable | long, ""),
            "confidence": F.when(usable | long, clamp(F.coalesce(F.when(numeric, F.try_variant_get(value, "$.confidence", "double")), F.lit(0.0)), 0.0, 1.0)),
        }
    )
    return out.drop("read", "value", "said", "advice", "prose")


def projected(read_: DataFrame) -> DataFrame:
    """The opinions of readable answers: unknown tokens and costs are 0."""
    none = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    columns = ["task_id", "idx", "slug", "summary", "recommendation", "plan", "confidence", none("tokens_in", "bigint"), none("tokens_out", "bigint"), none("cost_usd", "double")]
    return read_.filter("payload is not null").select(*columns)
