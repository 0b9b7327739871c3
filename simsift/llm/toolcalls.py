"""Tool calls of conversations: linked to results, ordered, validated, serialised.

calls: conv_id, call_id, tool, arguments (JSON text), depends_on (array of call ids of
the same conversation). results: conv_id, call_id, content.

* Linking: an equi-join by (conv_id, call_id), never by conversation alone, so a
  conversation with a third of all rows spreads over all tasks. The first result by
  content order counts where several name one call; their number is kept.
* Order: a call's level is 0 without known dependencies, else one more than the
  highest of them. Levels come from rounds over the edges whose ends are still open;
  each round stores its few columns. (level, turn order) sorts a conversation. Calls
  on a cycle, or behind one, have no level.
* Validation: arguments must be a JSON object with all required parameters, no
  unknown ones, and values of the named types.
* Canonical JSON: object keys sorted, no spaces, one record per call.

Calls without conv_id or call_id cannot be linked and have status ``unlinked``. Repeated calls of
one id are repeated rows with the same level. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: JSON types of a parameter -> how the type of a parsed value begins.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"),
         "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for the calls that have one."""
    nodes = calls.select("conv_id", "call_id").filter("conv_id IS NOT NULL AND call_id IS NOT NULL").distinct()
    named = calls.select("conv_id", "call_id", F.explode("depends_on").alias("on")).distinct()
    targets = nodes.select("conv_id", F.col("call_id").alias("on"))
    edges = stored(named.join(targets, ["conv_id", "on"]), "edges")
    free = nodes.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
    done = [stored(free.withColumn("level", F.lit(0)), "level")]
    latest = done[0]
    while True:
        # an edge is settled when its target has got its level in the last round
        settled = latest.select("conv_id", F.col("call_id").alias("on"), "level")
        marked = stored(edges.join(settled, ["conv_id", "on"], "left"), "edges")
        ready = marked.groupBy("conv_id", "call_id").agg(
            F.count_if(F.col("level").isNull()).alias("open")
        ).filter("open = 0").select("conv_id", "call_id")
        # targets settled in earlier rounds have left the table, so this round's level is the highest
        latest = stored(ready.withColumn("level", F.lit(len(done))), "level")
        if latest.isEmpty():
            break
        done.append(latest)
        edges = marked.filter("level IS NULL").drop("level")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def errors(arguments: Column, tool: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted texts of what is wrong; schemas: tool -> parameter -> (type, required)."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    names = F.json_object_keys(arguments)
    out = None
    for name, params in schemas.items():
        wrong = []
        for param, (type_name, required) in sorted(params.items()):
            given = F.schema_of_variant(F.try_variant_get(value, f"$.{param}", "variant"))
            absent = ~F.array_contains(names, param)
            fits = F.lit(False)
            for start in TYPES[type_name]:
                fits = fits | given.startswith(start)
            bad_type = F.when(~absent & ~fits, F.lit(f"type:{param}"))
            wrong.append(F.when(absent, F.lit(f"missing:{param}")).otherwise(bad_type) if required else bad_type)
        unknown = F.transform(
            F.array_except(names, F.array(*[F.lit(p) for p in params]).cast("array<string>")),
            lambda p: F.concat(F.lit("unknown:"), p),
        )
        found = F.array_sort(F.concat(F.array_compact(F.array(*wrong)), unknown))
        out = F.when(tool == name, found) if out is None else out.when(tool == name, found)
    no_tool = F.array(F.lit("tool"))
    checked = no_tool if out is None else out.otherwise(no_tool)
    return F.when(kind.startswith("OBJECT"), checked).otherwise(F.array(F.lit("json")))


def linked(
    calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]
) -> DataFrame:
    """One row per call: its own columns, level, n_results, status, errors, record (canonical JSON).

    status: ``invalid`` (arguments), ``unlinked`` (no result), ``cycle`` (no level) or ``ok``.
    """
    answers = results.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(
        F.min("content").alias("content"), F.count(F.lit(1)).alias("n_results")
    )
    base = calls.drop("level", "n_results", "content", "errors", "status", "record")
    rows = base.join(answers, ["conv_id", "call_id"], "left").join(levels(calls), ["conv_id", "call_id"], "left")
    rows = rows.withColumns(
        {
            "errors": errors(F.col("arguments"), F.col("tool"), schemas),
            "n_results": F.coalesce("n_results", F.lit(0)).cast("bigint"),
        }
    )
    status = (
        F.when(F.size("errors") > 0, "invalid").when(F.col("n_results") == 0, "unlinked")
        .when(F.col("level").isNull(), "cycle").otherwise("ok")
    )
    # fields in the order of their names; a parsed object writes its own keys sorted
    record = F.to_json(
        F.struct(
            F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"),
            F.col("tool").alias("name"), F.col("content").alias("result"),
        ),
        {"ignoreNullFields": "false"},
    )
    return rows.withColumns({"status": status, "record": record})
