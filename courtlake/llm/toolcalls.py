"""Tool-call linking, in DataFrame functions only.

Calls and results are hash-joined by conversation and identifier. Arguments are parsed and checked against the schema of
their tool. Calls are ordered by level and position: a call whose needs all stand before it keeps the level of what it
needs, one that needs a later call comes a level behind it, so sorting a conversation by (level, position) puts every
call behind what it needs. Levels grow round by round as joins of the needs, as many rounds as levels travel, and only
over calls that stand behind some need of a later call; no conversation is gathered anywhere. Each linked call is written as
canonical JSON: keys sorted, no spaces, numbers and strings as parsed.

Defined cases: of calls or results that share an identifier the first counts (by position, then by content) and the
status tells; a call or result without identifier is kept as a row of its own with status ``no id``; a null conversation is
a conversation; null or malformed arguments are invalid; null text of a result is an empty result; needs that name no
call of the conversation, and calls that need themselves through others, have a status of their own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Tool: field -> (type, required). Types as parsed from JSON.
Schemas = dict[str, dict[str, tuple[str, bool]]]


def _problems(name: Column, parsed: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments, as a sorted array of texts."""
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    found = F.when(parsed.isNull() | F.json_object_keys(arguments).isNull(), F.array(F.lit("malformed")))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            value = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
            checks.append(F.when(~F.array_contains(keys, field), F.lit(f"missing {field}") if required else F.lit(None)).when(~F.coalesce(value, F.lit("VOID")).isin(kind), F.lit(f"{field} is no {kind.lower()}")))
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(f) for f in fields])), lambda k: F.concat(F.lit("unknown "), k))
        found = found.when(name == tool, F.array_sort(F.concat(F.array_compact(F.array(*checks)), extra)))
    return found.otherwise(F.array(F.lit("unknown tool")))


def _levels(needs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``conv, call_id, level`` of the calls above level 0; level -1: on or behind a cycle. ``needs``: conv, call_id, need, later."""
    now = stored(needs.where("later = 1").select("conv", "call_id", F.when(F.col("call_id") == F.col("need"), -1).otherwise(1).alias("level")).groupBy("conv", "call_id").agg(F.min("level").alias("low"), F.max("level").alias("high")).select("conv", "call_id", F.when(F.col("low") < 0, -1).otherwise(F.col("high")).alias("level")), "levels")
    needs = stored(needs.where("call_id <> need").join(sizes, needs["conv"].eqNullSafe(sizes["c"])).select("conv", "call_id", "need", "later", "size"), "needs")
    while True:
        known = now.select(F.col("conv").alias("k"), F.col("call_id").alias("known"), "level")
        reached = needs.join(known, needs["conv"].eqNullSafe(F.col("k")) & (F.col("need") == F.col("known"))).select("conv", "call_id", F.when((F.col("level") < 0) | (F.col("level") + F.col("later") > F.col("size")), -1).otherwise(F.col("level") + F.col("later")).alias("level"))
        after = stored(now.unionByName(reached).groupBy("conv", "call_id").agg(F.min("level").alias("low"), F.max("level").alias("high")).select("conv", "call_id", F.when(F.col("low") < 0, -1).otherwise(F.col("high")).alias("level")), "levels")
        mark = lambda df: df.agg(F.count("*"), F.sum("level"), F.sum((F.col("level") < 0).cast("int"))).first()
        if mark(after) == mark(now):
            return after
        now = after


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call and per unmatched result: ``conv, call_id, level, position, status, problems, json``.

    ``calls``: conv, call_id, position, name, arguments (JSON text), needs (array of call ids); ``results``: conv,
    call_id, position, content."""
    call, result = F.struct("position", "name", "arguments", "needs"), F.struct("position", F.coalesce("content", F.lit("")).alias("content"))
    one = calls.where("call_id is not null").groupBy("conv", "call_id").agg(F.min(call).alias("call"), F.count("*").alias("n_calls"))
    got = results.where("call_id is not null").groupBy(F.col("conv").alias("rc"), F.col("call_id").alias("ri")).agg(F.min(result).alias("result"), F.count("*").alias("n_results"))
    linked = one.join(got, F.col("conv").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "full")
    linked = linked.select(F.when(F.col("call").isNotNull(), F.col("conv")).otherwise(F.col("rc")).alias("conv"), F.coalesce("call_id", "ri").alias("call_id"), "call", "result", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"))
    loose = calls.where("call_id is null").select("conv", "call_id", call.alias("call"), F.lit(None).cast(linked.schema["result"].dataType).alias("result"), F.lit(1).alias("n_calls"), F.lit(0).alias("n_results"))
    stray = results.where("call_id is null").select("conv", "call_id", F.lit(None).cast(linked.schema["call"].dataType).alias("call"), result.alias("result"), F.lit(0).alias("n_calls"), F.lit(1).alias("n_results"))
    rows = stored(linked.unionByName(loose).unionByName(stray), "linked")
    known = rows.where("call is not null and call_id is not null").select("conv", "call_id", F.col("call.position").alias("position"), F.array_distinct("call.needs").alias("needs"))
    asked = known.select("conv", "call_id", "position", F.explode("needs").alias("need"))
    there = known.select(F.col("conv").alias("dc"), F.col("call_id").alias("di"), F.col("position").alias("dp"))
    asked = stored(asked.join(there, F.col("conv").eqNullSafe(F.col("dc")) & (F.col("need") == F.col("di")), "left").select("conv", "call_id", "need", F.col("di").isNull().alias("unknown"), (F.struct("dp", "need") >= F.struct("position", "call_id")).cast("int").alias("later")), "asked")
    sizes = known.groupBy(F.col("conv").alias("c")).agg(F.count("*").alias("size"))
    levels = _levels(asked.where("not unknown").drop("unknown"), sizes).withColumnsRenamed({"conv": "lc", "call_id": "li"})
    lost = asked.where("unknown").select(F.col("conv").alias("uc"), F.col("call_id").alias("ui")).distinct()
    out = rows.join(levels, F.col("conv").eqNullSafe(F.col("lc")) & (F.col("call_id") == F.col("li")), "left").join(lost, F.col("conv").eqNullSafe(F.col("uc")) & (F.col("call_id") == F.col("ui")), "left")
    parsed = F.try_parse_json(F.col("call.arguments"))
    out = out.select("*", parsed.alias("parsed"), F.coalesce("level", F.lit(0)).alias("order_level"), F.when(F.col("call").isNotNull(), _problems(F.col("call.name"), parsed, F.col("call.arguments"), schemas)).otherwise(F.array().cast("array<string>")).alias("problems"))
    status = F.when(F.col("call_id").isNull(), "no id").when(F.col("call").isNull(), "orphan result").when(F.size("problems") > 0, "invalid arguments").when(F.col("ui").isNotNull(), "unknown need").when(F.col("order_level") < 0, "cycle").when((F.col("n_calls") > 1) | (F.col("n_results") > 1), "repeated id").when(F.col("result").isNull(), "no result").otherwise("ok")
    text = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), F.col("call.name").alias("name"), F.array_sort("call.needs").alias("needs"), F.col("result.content").alias("result"), status.alias("status")))
    return out.select("conv", "call_id", F.col("order_level").alias("level"), F.coalesce("call.position", "result.position").alias("position"), status.alias("status"), F.array_join("problems", "; ").alias("problems"), text.alias("json"))
