"""The schema gate: a JSON Schema, read as data, becomes one column expression over documents held as variants.

Each keyword gives an array of violations (path, keyword), so a scan of the documents counts all of them at once.
Keywords that are annotations say nothing; one that isn't known is an error, so that no rule passes unseen.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords of the standard that state nothing about a document.
ANNOTATIONS = ("$schema", "$id", "$defs", "definitions", "$comment", "title", "description", "default", "examples", "format", "deprecated")
FOUND = "array<struct<path:string,keyword:string>>"
#: Keywords that look at no member and no item.
SINGLE = {*ANNOTATIONS, "type", "enum", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}


def violations(documents: DataFrame, document: str, schema: dict | str) -> DataFrame:
    """documents (with a column of JSON text) with path and keyword of each violation; documents without one give no row.

    A text that is null or no JSON violates `json` at the root. Paths are like $.games[3].price. Reals that are whole
    count as integers. References lead into the schema itself; one that leads back to itself is an error.
    """
    out = documents.withColumn("__value", F.try_parse_json(document))
    return out.withColumn("__found", F.explode(_found(schema))).select(*[F.col(f"`{c}`") for c in documents.columns], "__found.path", "__found.keyword")


def gate(documents: DataFrame, document: str, schema: dict | str) -> DataFrame:
    """One row: documents, those with violations, violations, and whether there is none; one pass over the documents."""
    n = documents.select(F.try_parse_json(document).alias("__value")).select(F.size(_found(schema)).alias("n"))
    broken = F.col("n") > 0
    counts = n.agg(F.count("*").alias("documents"), F.count_if(broken).alias("broken"), F.coalesce(F.sum(F.when(broken, F.col("n"))), F.lit(0)).alias("violations"))
    return counts.withColumn("passed", F.col("violations") == 0)


def _found(schema: dict | str) -> Column:
    """The violations of the document in `__value`."""
    rules = json.loads(schema) if isinstance(schema, str) else schema
    bad = _one(F.col("__value").isNull(), F.lit("$"), "json")
    return F.when(F.col("__value").isNull(), bad).otherwise(_let(rules, F.col("__value"), lambda x: _check(rules, x, F.lit("$"), rules, ())))


def _none() -> Column:
    return F.array().cast(FOUND)


def _one(broken: Column, path: Column, keyword: str) -> Column:
    return F.when(broken, F.array(F.struct(path.alias("path"), F.lit(keyword).alias("keyword"))).cast(FOUND)).otherwise(_none())


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _fine(schema, value: Node, root: dict, seen: tuple) -> Column:
    return F.size(_check(schema, value, F.lit(""), root, seen)) == 0


class Node:
    """A variant that is there, its kind, and its members or items where a rule asks for them, all bound by a lambda, so that a value is taken apart once."""

    def __init__(self, bound: Column, single: bool):
        self.value, self.kind = bound["v"], bound["k"]
        self.members, self.items = (None, None) if single else (bound["m"], bound["a"])


def _is_single(schema) -> bool:
    return isinstance(schema, bool) or set(schema) <= SINGLE


def _nodes(values: Column, single: bool) -> Column:
    """Variants with object, array, string, boolean, null or number; objects and arrays that are taken apart are known by that, as a variant's schema goes through all below it."""
    kinds = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    of = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    kind = lambda v: F.coalesce(F.try_element_at(of, F.substring_index(F.schema_of_variant(v), "<", 1)), F.lit("number"))
    if single:
        return F.transform(values, lambda v: F.struct(v.alias("v"), kind(v).alias("k")))
    apart = F.transform(values, lambda v: F.struct(v.alias("v"), F.try_variant_get(v, "$", "map<string,variant>").alias("m"), F.try_variant_get(v, "$", "array<variant>").alias("a")))
    return F.transform(apart, lambda x: x.withField("k", F.when(x["m"].isNotNull(), "object").when(x["a"].isNotNull(), "array").otherwise(kind(x["v"]))))


def _member(node: Node, name: str) -> Column:
    """A member of an object: SQL null if it isn't there, a null variant if it is null."""
    return F.try_element_at(node.members, F.lit(name))


def _members(node: Node) -> Column:
    return F.map_entries(node.members)


def _number(node: Node) -> Column:
    return F.try_variant_get(node.value, "$", "double")


def _equal(node: Node, wanted) -> Column:
    """Whether a variant is this value; numbers by their value, objects and arrays by their text."""
    if wanted is None:
        return node.kind == "null"
    if isinstance(wanted, bool):
        return (node.kind == "boolean") & (F.try_variant_get(node.value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, int | float):
        return (node.kind == "number") & (_number(node) == F.lit(float(wanted)))
    if isinstance(wanted, str):
        return (node.kind == "string") & (F.try_variant_get(node.value, "$", "string") == F.lit(wanted))
    return F.to_json(node.value) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


def _among(node: Node, wanted: list) -> Column:
    texts = [w for w in wanted if isinstance(w, str)]
    text = [(node.kind == "string") & F.try_variant_get(node.value, "$", "string").isin(texts)] if texts else []
    return _any([*text, *[_equal(node, w) for w in wanted if not isinstance(w, str)]])


def _typed(node: Node, kind: str) -> Column:
    if kind == "integer":
        n = _number(node)
        return (node.kind == "number") & (n == F.floor(n).cast("double"))
    return node.kind == kind


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _count(conditions: list[Column]) -> Column:
    out = F.lit(0)
    for c in conditions:
        out = out + c.cast("int")
    return out


def _within(schema, items: Column, rule) -> Column:
    single = _is_single(schema)
    nodes = _nodes(F.coalesce(items, F.array().cast("array<variant>")), single)
    return F.flatten(F.transform(nodes, lambda x, k: rule(Node(x, single), k)))


def _let(schema, value: Column, rule) -> Column:
    """rule(x) for a value that is there, computed once; nothing for one that isn't."""
    single = _is_single(schema)
    # an aggregate over the one node: taking it out of an array would work out the rules' types anew for each value
    return F.aggregate(_nodes(F.array(value), single), _none(), lambda none, x: F.when(x["v"].isNotNull(), rule(Node(x, single))).otherwise(none))


def _check(schema, v: Node, path: Column, root: dict, seen: tuple) -> Column:
    if isinstance(schema, bool):
        return _none() if schema else _one(F.lit(True), path, "false")
    known = {k: x for k, x in schema.items() if k not in ANNOTATIONS}
    parts = [_RULES[k](x, v, path, root, seen, schema) for k, x in known.items() if k in _RULES]
    if unknown := set(known) - set(_RULES) - {"then", "else"}:
        raise ValueError(f"keywords that aren't known: {sorted(unknown)}")
    return _all(parts)


def _reference(to: str, v, path, root, seen, _):
    if not to.startswith("#"):
        raise ValueError(f"a reference out of the schema: {to}")
    if to in seen:
        raise ValueError(f"a reference that leads back to itself: {to}")
    part = root
    for name in filter(None, to[1:].split("/")):
        part = part[name.replace("~1", "/").replace("~0", "~")]
    return _check(part, v, path, root, (*seen, to))


def _required(names: list, v, path, *_):
    absent = F.filter(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: F.try_element_at(v.members, n).isNull())
    told = F.transform(absent, lambda n: F.struct(F.concat(path, F.lit("."), n).alias("path"), F.lit("required").alias("keyword")))
    return F.when(v.kind == "object", told.cast(FOUND)).otherwise(_none())


def _properties(rules: dict, v, path, root, seen, _):
    below = lambda name, rule: _let(rule, _member(v, name), lambda x: _check(rule, x, F.concat(path, F.lit(f".{name}")), root, seen))
    return _all([below(name, rule) for name, rule in rules.items()])


def _additional(rule, v, path, root, seen, schema):
    named = list(schema.get("properties", {}))
    rest = F.filter(F.coalesce(_members(v), F.array().cast("array<struct<key:string,value:variant>>")), lambda e: ~e.key.isin(named) if named else F.lit(True))
    if rule is False:
        return F.transform(rest, lambda e: F.struct(F.concat(path, F.lit("."), e.key).alias("path"), F.lit("additionalProperties").alias("keyword"))).cast(FOUND)
    return F.flatten(F.transform(rest, lambda e: _let(rule, e.value, lambda x: _check(rule, x, F.concat(path, F.lit("."), e.key), root, seen))))


def _each(rule, v, path, root, seen, _):
    return _within(rule, v.items, lambda x, k: _check(rule, x, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")), root, seen))


def _if(rule, v, path, root, seen, schema):
    then, other = (_check(schema[k], v, path, root, seen) if k in schema else _none() for k in ("then", "else"))
    return F.when(_fine(rule, v, root, seen), then).otherwise(other)


def _when(kind: str, keyword: str, broken):
    """A rule that says something about values of one kind alone."""
    return lambda x, v, path, root, seen, _: _one(F.coalesce((v.kind == kind) & broken(v, x), F.lit(False)), path, keyword)


def _repeated(v, x):
    texts = F.transform(v.items, lambda i: F.to_json(i))
    return F.lit(bool(x)) & (F.size(F.array_distinct(texts)) < F.size(texts))


def _text(v):
    return F.try_variant_get(v.value, "$", "string")


def _step(v, x):
    ratio = _number(v) / F.lit(float(x))
    return ratio != F.rint(ratio)


_RULES = {
    "$ref": _reference,
    "type": lambda x, v, path, *_: _one(~_any([_typed(v, k) for k in ([x] if isinstance(x, str) else x)]), path, "type"),
    "enum": lambda x, v, path, *_: _one(~_among(v, x), path, "enum"),
    "const": lambda x, v, path, *_: _one(~_any([_equal(v, x)]), path, "const"),
    "required": _required,
    "properties": _properties,
    "additionalProperties": _additional,
    "items": _each,
    "if": _if,
    "minItems": _when("array", "minItems", lambda v, x: F.size(v.items) < x),
    "maxItems": _when("array", "maxItems", lambda v, x: F.size(v.items) > x),
    "uniqueItems": _when("array", "uniqueItems", _repeated),
    "minProperties": _when("object", "minProperties", lambda v, x: F.size(_members(v)) < x),
    "maxProperties": _when("object", "maxProperties", lambda v, x: F.size(_members(v)) > x),
    "minLength": _when("string", "minLength", lambda v, x: F.length(_text(v)) < x),
    "maxLength": _when("string", "maxLength", lambda v, x: F.length(_text(v)) > x),
    "pattern": _when("string", "pattern", lambda v, x: ~F.regexp_like(_text(v), F.lit(x))),
    "minimum": _when("number", "minimum", lambda v, x: _number(v) < float(x)),
    "maximum": _when("number", "maximum", lambda v, x: _number(v) > float(x)),
    "exclusiveMinimum": _when("number", "exclusiveMinimum", lambda v, x: _number(v) <= float(x)),
    "exclusiveMaximum": _when("number", "exclusiveMaximum", lambda v, x: _number(v) >= float(x)),
    "multipleOf": _when("number", "multipleOf", _step),
    "allOf": lambda x, v, path, root, seen, _: _all([_check(s, v, path, root, seen) for s in x]),
    "anyOf": lambda x, v, path, root, seen, _: _one(~_any([_fine(s, v, root, seen) for s in x]), path, "anyOf"),
    "oneOf": lambda x, v, path, root, seen, _: _one(_count([_fine(s, v, root, seen) for s in x]) != 1, path, "oneOf"),
    "not": lambda x, v, path, root, seen, _: _one(_fine(x, v, root, seen), path, "not"),
}


def latest(flags: tuple, grades: tuple) -> dict:
    """The schema of the published document, as data: a day and its games."""
    maybe = lambda kind: {"type": [kind, "null"]}
    number = {"type": "number"}
    prize = {"type": "object", "required": ["level", "remaining"], "properties": {"level": maybe("integer"), "level_label": maybe("string"), "remaining": {"type": "integer"}}, "if": {"properties": {"level": {"const": None}}}, "then": {"required": ["level_label"]}}
    scenario = {"type": "object", "required": ["assumed_claimed_share", "ev_ratio"], "properties": {"assumed_claimed_share": number, "ev_ratio": maybe("number")}}
    game = {
        "type": "object",
        "required": ["game_no", "name", "price", "percent_unsold", "total_unclaimed", "top_prizes", "ev_ratio", "dead_game", "flags", "confidence"],
        "properties": {
            "game_no": {"type": "integer"}, "name": {"type": "string", "minLength": 1}, "price": number, "percent_unsold": number, "total_unclaimed": number,
            "top_prizes": {"type": "array", "items": {"$ref": "#/$defs/prize"}}, "print_run": maybe("integer"), "ev_ratio": maybe("number"), "dead_game": {"type": "boolean"},
            "flags": {"type": "array", "items": {"enum": list(flags)}}, "confidence": {"enum": ["high", "medium", "low"]}, "grade": {"enum": [*grades, None]}, "reason": {"type": "string", "minLength": 1},
            "ev_scenarios": {"type": ["array", "null"], "minItems": 3, "maxItems": 3, "items": {"$ref": "#/$defs/scenario"}},
        },
    }
    return {"type": "object", "required": ["as_of", "source_timestamp", "games"], "properties": {"as_of": {"type": "string"}, "source_timestamp": {"type": "string"}, "games": {"type": "array", "items": {"$ref": "#/$defs/game"}}}, "$defs": {"game": game, "prize": prize, "scenario": scenario}}

