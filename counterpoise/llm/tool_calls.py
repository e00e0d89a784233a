"""Tool calls of chats: linked to their results, ordered, validated, serialised.

Only DataFrame functions are used. Calls and results are first reduced to one
row for each (conversation, identifier), with map-side combining, so a repeated
identifier is never gathered; the two sides then have unique keys and are
hash-joined. Arguments are parsed as variants, checked against the tool's schema
by compiled column expressions, and written as JSON with sorted keys.

Order: where every dependency of a conversation points to an earlier call, place
in the chat is a topological order already. In the other conversations a call's
place follows from its level, the length of the longest chain below it: where each
call waits for one other at most by pointer doubling, in as many rounds as the
logarithm of the longest chain; where a call waits for several, levels are peeled
off, a semi-join on narrow edges for each. Calls that never get a level lie on a
cycle or behind one. Steps are numbered through one global
sort, not by a window over a conversation, so a conversation that holds a third
of all calls is no single task.

Defined results: a null conversation is a conversation; calls without identifier
are told apart by position and never link; of repeated identifiers the earliest
row counts (``n_calls``, ``n_results`` say how many there were; of rows at one
position the smallest); results without call are returned as ``orphan_result``; dependencies on unknown calls are
reported as errors and do not order; malformed, missing and non-object arguments
are errors and serialise as null (non-objects as they are); keys repeated in an
object are malformed; numbers are written as Spark's variants write them (1.0 as
1); calls on a cycle come last in their conversation, in chat order; unknown
tools are errors; schema keywords that cannot be checked raise an error when the
schemas are compiled; very long texts are linked and written whole; an empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import ranked
from counterpoise.operators.lineage import materialise, write_down
from counterpoise.operators.lookup import lookup_join

# JSON schema types by the types that variants report.
TYPES = {
    "string": "^STRING$",
    "integer": r"^BIGINT$|^DECIMAL\([0-9]+,0\)$",
    "number": r"^BIGINT$|^DECIMAL|^DOUBLE$|^FLOAT$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<",
    "array": "^ARRAY<",
    "null": "^VOID$",
}


# Schema keywords that are checked, and those that say nothing about validity.
CHECKED = frozenset(
    "type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern "
    "items minItems maxItems uniqueItems properties required additionalProperties minProperties maxProperties".split()
)
NOTES = frozenset("title description default examples format deprecated readOnly writeOnly $schema $id $comment".split())


def _canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _child(value: Column, name: str) -> Column:
    quoted = name.replace("'", "\\'")
    return F.variant_get(value, f"$['{quoted}']", "variant")


def _messages(found: list[Column], lists: list[Column]) -> Column:
    """The messages that are not null, and those of the lists."""
    none = F.array().cast("array<string>")
    own = F.filter(F.array(*found), lambda c: c.isNotNull()) if found else none
    return F.concat(own, *[F.coalesce(x, none) for x in lists]) if lists else own


def violations(value: Column, rule: Mapping, label: str, root: bool = False) -> Column:
    """Messages for every keyword of the schema that ``value`` (a variant) breaks; a null value breaks none.

    Nested objects and the items of arrays are checked at every depth. A keyword
    that is neither checked nor a note raises an error, and so do schemas in
    place of ``additionalProperties`` or lists in place of ``items``.
    """
    if unknown := set(rule) - CHECKED - NOTES:
        raise ValueError(f"schema keywords that cannot be checked at {label or 'the root'}: {', '.join(sorted(unknown))}")
    if not isinstance(rule.get("additionalProperties", True), bool) or not isinstance(rule.get("items", {}), Mapping):
        raise ValueError(f"only true, false or a schema can be checked for the parts of {label or 'the root'}")
    kind = F.schema_of_variant(value)
    found: list[Column] = []
    lists: list[Column] = []
    of = "arguments" if root else label

    def wrong(when: Column, what: str) -> None:
        found.append(F.when(value.isNotNull() & F.coalesce(when, F.lit(False)), F.lit(f"{of}: {what}")))

    if (kinds := rule.get("type")) is not None and not root:
        kinds = [kinds] if isinstance(kinds, str) else list(kinds)
        wrong(~kind.rlike("|".join(TYPES[k] for k in kinds)), f"not of type {' or '.join(kinds)}")
    if "enum" in rule:
        wrong(~F.to_json(value).isin([_canonical(v) for v in rule["enum"]]), "not an allowed value")
    if "const" in rule:
        wrong(F.to_json(value) != _canonical(rule["const"]), "not the one allowed value")
    number = F.when(kind.rlike(TYPES["number"]), F.try_variant_get(value, "$", "double"))
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    if "minimum" in rule:
        wrong(number < F.lit(float(rule["minimum"])), f"below {rule['minimum']}")
    if "maximum" in rule:
        wrong(number > F.lit(float(rule["maximum"])), f"above {rule['maximum']}")
    if "exclusiveMinimum" in rule:
        wrong(number <= F.lit(float(rule["exclusiveMinimum"])), f"not above {rule['exclusiveMinimum']}")
    if "exclusiveMaximum" in rule:
        wrong(number >= F.lit(float(rule["exclusiveMaximum"])), f"not below {rule['exclusiveMaximum']}")
    if "multipleOf" in rule:
        times = number / F.lit(float(rule["multipleOf"]))
        wrong(F.abs(times - F.round(times)) > 1e-9, f"not a multiple of {rule['multipleOf']}")
    if "minLength" in rule:
        wrong(F.length(text) < rule["minLength"], f"shorter than {rule['minLength']}")
    if "maxLength" in rule:
        wrong(F.length(text) > rule["maxLength"], f"longer than {rule['maxLength']}")
    if "pattern" in rule:
        wrong(~text.rlike(rule["pattern"]), "does not match the pattern")
    if not rule.keys().isdisjoint(("items", "minItems", "maxItems", "uniqueItems")):
        parts = F.when(kind.startswith("ARRAY<"), F.try_variant_get(value, "$", "array<variant>"))
        if "minItems" in rule:
            wrong(F.size(parts) < rule["minItems"], f"fewer items than {rule['minItems']}")
        if "maxItems" in rule:
            wrong(F.size(parts) > rule["maxItems"], f"more items than {rule['maxItems']}")
        if rule.get("uniqueItems"):
            wrong(F.size(F.array_distinct(F.transform(parts, lambda x: F.to_json(x)))) < F.size(parts), "items are not unique")
        if rule.get("items"):
            lists.append(F.array_distinct(F.flatten(F.transform(parts, lambda x: violations(x, rule["items"], f"{of}[]")))))
    rules: Mapping = rule.get("properties", {})
    inner = "" if root else f"{label}."
    is_object = F.coalesce(kind.startswith("OBJECT<"), F.lit(False))
    for prop, nested in sorted(rules.items()):
        lists.append(F.when(is_object, violations(_child(value, prop), nested, f"{inner}{prop}")))
    for prop in rule.get("required", []):
        found.append(F.when(is_object & _child(value, prop).isNull(), F.lit(f"{inner}{prop}: missing")))
    held = F.when(is_object, F.json_object_keys(F.to_json(value)))
    if rule.get("additionalProperties") is False:
        known = F.array(*[F.lit(p) for p in sorted(rules)]).cast("array<string>")
        wrong(F.size(F.array_except(held, known)) > 0, "unknown property")
    if "minProperties" in rule:
        wrong(F.size(held) < rule["minProperties"], f"fewer properties than {rule['minProperties']}")
    if "maxProperties" in rule:
        wrong(F.size(held) > rule["maxProperties"], f"more properties than {rule['maxProperties']}")
    return _messages(found, lists)


def argument_errors(name: Column, arguments: Column, parsed: Column, schemas: Mapping[str, Mapping]) -> Column:
    """Sorted messages; ``schemas`` has a JSON schema of an object for each tool."""
    is_object = F.coalesce(F.schema_of_variant(parsed).rlike("^OBJECT<"), F.lit(False))
    by_tool = F.when(name.isNull() | ~name.isin(list(schemas)), F.array(F.lit("name: unknown tool")))
    for tool, schema in sorted(schemas.items()):
        by_tool = by_tool.when(name == tool, F.array_sort(violations(parsed, schema, "", root=True)))
    shape = F.when(arguments.isNull(), F.array(F.lit("arguments: missing")))
    shape = shape.when(parsed.isNull(), F.array(F.lit("arguments: not JSON"))).when(~is_object, F.array(F.lit("arguments: not an object")))
    return shape.otherwise(by_tool)


def _label(col: Column) -> Column:
    """A key that equals itself where the value is null."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def _identity(mark: str) -> Column:
    """The identifier, or a place of its own for a row without one."""
    return F.coalesce(F.concat(F.lit("="), F.col("call_id")), F.concat(F.lit(mark), F.coalesce(F.col("position").cast("string"), F.lit(""))))


def _chain_levels(edges: DataFrame) -> DataFrame:
    """(chat, id, level, in_cycle) where every call waits for one other at most, by pointer doubling.

    A call knows another one some steps ahead, and how many. Joined with itself
    it knows one twice as far; the number of rounds is the logarithm of the
    longest chain. Calls that still point to others when a round settles none
    lie on a cycle or behind one.
    """
    waits = write_down(edges.select("chat", F.col("id").alias("dep"), F.lit(True).alias("_open")))
    ahead = lookup_join(edges, waits, ["chat", "dep"], "left")
    ahead = ahead.select("chat", "id", F.when(F.col("_open"), F.col("dep")).alias("to"), F.lit(1).cast("bigint").alias("level"))
    known, open_ = write_down(ahead), -1
    while True:
        pending = known.df.filter("to IS NOT NULL").count()
        if pending in (0, open_):
            break
        open_ = pending
        there = known.df.select("chat", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("level").alias("_level"))
        joined = lookup_join(known.df, replace(known, df=there), ["chat", "to"], "left")
        known = write_down(joined.select("chat", "id", F.col("_to").alias("to"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")))
    looped = F.col("to").isNotNull()
    return known.df.select("chat", "id", F.when(~looped, F.col("level")).alias("level"), looped.alias("in_cycle"))


def levels(edges: DataFrame) -> DataFrame:
    """(chat, id, level, in_cycle) of every call with dependencies.

    ``edges`` is (chat, id, dep). A call's level is the length of the longest
    chain below it; calls on or behind a cycle have no level. Chats in which
    every call waits for one other at most take rounds by the logarithm of their
    longest chain; in the others levels are peeled off one by one.
    """
    edges = materialise(edges.select("chat", "id", "dep").distinct())
    several = edges.groupBy("chat", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("chat").distinct()
    several = write_down(several.withColumn("_several", F.lit(True)))
    marked = lookup_join(edges, several, ["chat"], "left")
    single = materialise(marked.filter("_several IS NULL").select("chat", "id", "dep"))
    out = _chain_levels(single)
    return out if several.rows == 0 else out.unionByName(_peeled(marked.filter("_several").drop("_several")))


def _peeled(edges: DataFrame) -> DataFrame:
    left = write_down(edges)
    layers, level = [], 0
    none = F.lit(None).cast("bigint")
    while left.rows:
        level += 1
        waiting = materialise(left.df.select("chat", "id").distinct())
        above = left.df.join(waiting.withColumnRenamed("id", "dep"), ["chat", "dep"], "left_semi")
        following = write_down(above.select("chat", "id", "dep"))
        if following.rows == left.rows:
            layers.append(waiting.withColumn("level", none).withColumn("in_cycle", F.lit(True)))
            break
        if following.rows:
            still = following.df.select("chat", "id").distinct()
            waiting = waiting.join(still, ["chat", "id"], "left_anti")
        layers.append(materialise(waiting.withColumn("level", F.lit(level).cast("bigint")).withColumn("in_cycle", F.lit(False))))
        left = following
    return functools.reduce(DataFrame.unionByName, layers)


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row for each call and each result without call.

    ``calls``: (conversation, call_id, position, name, arguments, depends_on);
    ``results``: (conversation, call_id, position, content). Returns
    (conversation, call_id, step, status, n_calls, n_results, in_cycle, errors,
    valid, canonical): ``step`` numbers a conversation's calls from 1 in
    topological order, ``canonical`` is the linked call as JSON with sorted keys.
    """
    first = F.struct("position", "name", "arguments", F.array_sort(F.array_distinct(F.coalesce("depends_on", F.array().cast("array<string>")))).alias("depends_on"))
    keyed = calls.withColumn("chat", _label(F.col("conversation"))).withColumn("id", _identity("?"))
    asked = keyed.groupBy("chat", "id").agg(
        F.min("conversation").alias("conversation"), F.min("call_id").alias("call_id"), F.min(first).alias("call"), F.count(F.lit(1)).alias("n_calls")
    )
    keyed = results.withColumn("chat", _label(F.col("conversation"))).withColumn("id", _identity("!"))
    answered = keyed.groupBy("chat", "id").agg(
        F.min("conversation").alias("conversation_r"),
        F.min("call_id").alias("call_id_r"),
        F.min(F.struct("position", "content")).alias("result"),
        F.count(F.lit(1)).alias("n_results"),
    )
    joined = materialise(asked.join(answered.hint("shuffle_hash"), ["chat", "id"], "full_outer"))
    known = joined.filter("call IS NOT NULL")

    wanted = known.select("chat", "id", F.col("call.position").alias("position"), F.explode("call.depends_on").alias("dep")).filter("dep IS NOT NULL")
    wanted = wanted.withColumn("dep", F.concat(F.lit("="), "dep"))
    targets = known.select("chat", F.col("id").alias("dep"), F.col("call.position").alias("dep_position"))
    edges = materialise(wanted.join(targets, ["chat", "dep"], "left").withColumn("known", F.col("dep_position").isNotNull()))
    missing = edges.filter("NOT known").groupBy("chat", "id").agg(F.array_sort(F.collect_set(F.substring("dep", 2, 1 << 30))).alias("missing"))
    ahead = edges.filter("known AND NOT coalesce(dep_position < position, false)").select("chat").distinct()
    tangled = edges.filter("known").join(ahead, "chat", "left_semi")
    level = levels(tangled)

    full = joined.join(missing, ["chat", "id"], "left").join(level, ["chat", "id"], "left")
    position = F.coalesce(F.col("call.position"), F.col("result.position"))
    is_call = F.col("call").isNotNull()
    looped = F.coalesce("in_cycle", F.lit(False))
    full = full.withColumn("position", position).withColumn("_class", F.when(~is_call, 2).when(looped, 1).otherwise(0))
    full = full.withColumn("_level", F.coalesce("level", F.lit(0)))
    placed, _ = ranked(full, ["chat", "_class", "_level", "position", "id"], "_rank")
    starts = write_down(placed.groupBy("chat").agg(F.min("_rank").alias("_start"), F.count(F.lit(1)).alias("_rows")))
    begun = write_down(starts.df.select("chat", "_start"))
    placed = lookup_join(placed, begun, ["chat"], rows_per_key=starts.df.select("chat", "_rows"))

    parsed = F.try_parse_json("call.arguments")
    rows = placed.withColumn("_parsed", parsed)
    unknown = F.transform(F.coalesce("missing", F.array().cast("array<string>")), lambda m: F.concat(F.lit("depends_on: no call "), m))
    errors = F.concat(argument_errors(F.col("call.name"), F.col("call.arguments"), F.col("_parsed"), schemas), unknown)
    errors = F.when(is_call, errors).otherwise(F.array().cast("array<string>"))
    early = F.col("result.position") < F.col("call.position")
    status = F.when(~is_call, "orphan_result").when(F.col("result").isNull(), "no_result").when(early, "early_result").otherwise("linked")
    line = F.struct(
        F.col("_parsed").alias("arguments"),
        F.coalesce("call_id", "call_id_r").alias("call_id"),
        F.col("result.content").alias("content"),
        F.coalesce(F.col("call.depends_on"), F.array().cast("array<string>")).alias("depends_on"),
        F.col("call.name").alias("name"),
        F.col("position").alias("position"),
    )
    return rows.select(
        F.coalesce("conversation", "conversation_r").alias("conversation"),
        F.coalesce("call_id", "call_id_r").alias("call_id"),
        F.when(is_call, F.col("_rank") - F.col("_start") + 1).alias("step"),
        status.alias("status"),
        F.coalesce("n_calls", F.lit(0).cast("bigint")).alias("n_calls"),
        F.coalesce("n_results", F.lit(0).cast("bigint")).alias("n_results"),
        looped.alias("in_cycle"),
        errors.alias("errors"),
        (is_call & (F.size(errors) == 0)).alias("valid"),
        F.to_json(line, {"ignoreNullFields": "false"}).alias("canonical"),
    )
