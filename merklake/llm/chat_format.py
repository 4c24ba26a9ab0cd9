"""Chat formatting with tool calls: results linked to calls, messages put in order, arguments checked, canonical JSON.

Results are hash-joined to calls by conversation and identifier. Where an identifier is used twice, the first call (by turn,
then place) is meant, and later ones are marked. A call may come after another one, whose result it needs: every message
hangs on at most one other. Order is topological and stays as close to the given one as it can: a message sorts by the
latest turn among itself and all it hangs on (calls and their first results), then by how many steps down it is, then by
its own turn and place. Both follow from
pointer doubling, so rounds grow with the logarithm of the longest chain; what hangs on itself is marked as a cycle.

The result is one row a message, with its keys of order, not one a conversation: a conversation of any length is never
gathered in one task. All is DataFrame operations. Joins are by identifier, never by conversation, and adaptive execution may
split a call with many results. Null texts, names and arguments are left out of the JSON; messages without conversation or
turn are kept, link to nothing, and sort first. Repeated rows stay. Other input columns are left out, whatever their names.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.sources.scratch import materialize


@dataclass(frozen=True)
class Parameter:
    """kind: string, integer, number or boolean. Bounds are of a number's value, or of a string's length in characters."""

    kind: str = "string"
    required: bool = True
    least: float | None = None
    most: float | None = None


Schemas = dict[str, dict[str, Parameter]]  # parameters by tool

_FORM = {"integer": "^-?(0|[1-9][0-9]*)$", "number": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "boolean": "^(true|false)$"}
MESSAGES = "conv_id bigint, turn bigint, role string, text string, calls array<struct<id:string,name:string,arguments:map<string,string>,after:string>>, call_id string"


def quoted(text: Column) -> Column:
    """A string as JSON writes it; null for null."""
    array = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(array, F.lit(2), F.length(array) - 2))


def _faults_of(name: str, p: Parameter) -> list[Column]:
    """What is wrong with one argument, as text; null where nothing is."""
    value = F.col("arguments")[name]
    wrong = F.lit(False) if p.kind == "string" else ~value.rlike(_FORM[p.kind])
    size = F.char_length(value).cast("double") if p.kind == "string" else value.try_cast("double")
    outside = F.lit(False)
    if p.least is not None:
        outside = outside | (size < p.least)
    if p.most is not None:
        outside = outside | (size > p.most)
    there = F.when(wrong, F.lit(f"type:{name}")).when(outside, F.lit(f"range:{name}"))
    return [F.when(value.isNotNull(), there).otherwise(F.lit(f"missing:{name}" if p.required else None).cast("string"))]


def argument_faults(schemas: Schemas) -> Column:
    """Sorted faults of the columns `name` and `arguments`: tool, missing, type, range and unknown."""
    cases = F.lit(None).cast("array<string>")
    for tool, parameters in sorted(schemas.items()):
        own = F.array(*[c for name, p in sorted(parameters.items()) for c in _faults_of(name, p)]) if parameters else F.array().cast("array<string>")
        names = F.array(*map(F.lit, sorted(parameters))) if parameters else F.array().cast("array<string>")
        extra = F.transform(F.array_except(F.map_keys(F.coalesce("arguments", _no_arguments())), names), lambda k: F.concat(F.lit("unknown:"), k))
        cases = F.when(F.col("name") == tool, F.array_sort(F.array_compact(F.concat(own, extra)))).otherwise(cases)
    return F.coalesce(cases, F.array(F.concat(F.lit("tool:"), F.coalesce("name", F.lit("")))))


def _no_arguments() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def canonical_arguments(schemas: Schemas) -> Column:
    """`arguments` of `name` as JSON: keys in order; numbers and booleans bare where schema and form agree, else strings."""
    forms = [x for tool, ps in sorted(schemas.items()) for n, p in sorted(ps.items()) for x in (F.lit(f"{tool} {n}"), F.lit(_FORM.get(p.kind, "$^")))]
    entries = F.array_sort(F.map_entries(F.map_filter("arguments", lambda k, v: v.isNotNull())))

    def written(e: Column) -> Column:
        if not forms:
            return quoted(e["value"])
        form = F.coalesce(F.try_element_at(F.create_map(*forms), F.concat_ws(" ", F.col("name"), e["key"])), F.lit("$^"))
        return F.when(F.regexp_like(e["value"], form), e["value"]).otherwise(quoted(e["value"]))

    pairs = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), written(e)))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _object(**fields: Column) -> Column:
    """A JSON object of the given values, already JSON, in order of their keys; null ones are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _nodes(messages: DataFrame) -> DataFrame:
    """Calls and messages as nodes: a message's own row, and one for each call it makes."""
    base = messages.select("conv_id", "turn", "role", "text", "call_id", "calls")
    own = base.select(
        "conv_id", "turn", F.lit(0).alias("place"), F.when(F.col("role") == "tool", "result").otherwise("message").alias("kind"), "role", "text",
        F.when(F.col("role") == "tool", F.col("call_id")).alias("id"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("map<string,string>").alias("arguments"), F.lit(None).cast("string").alias("after"),
    )
    made = base.select("conv_id", "turn", "role", F.posexplode("calls").alias("at", "c")).select(
        "conv_id", "turn", (F.col("at") + 1).alias("place"), F.lit("call").alias("kind"), "role", F.lit(None).cast("string").alias("text"),
        F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"),
    )
    return own.unionByName(made)


def _chains(calls: DataFrame) -> DataFrame:
    """conv_id, id, latest (turn by which all it hangs on is done, and its own), depth (calls it hangs on), cycle of every call.

    A row looks up the chain as far as `next`, and what it has passed is in `above` and `depth`. Each round doubles that; a
    chain that never ends has no root, and its calls still have a `next` when they have looked further than there are calls.
    """
    state = calls.select(
        "conv_id", "id", F.col("after").alias("next"), "turn", F.greatest("turn", "answered").alias("done"),
        F.lit(None).cast("bigint").alias("above"), F.lit(0).cast("bigint").alias("depth"),
    )
    state = materialize(state, "chains")
    total, reach = state.where("next is not null").count(), 1
    while reach <= 2 * total and state.where("next is not null").take(1):
        up = state.select(
            "conv_id", F.col("id").alias("next"), F.col("next").alias("u_next"), F.greatest("done", "above").alias("u_above"), F.col("depth").alias("u_depth")
        )
        state = state.join(up, ["conv_id", "next"], "left").select(
            "conv_id", "id", F.col("u_next").alias("next"), "turn", "done", F.greatest("above", "u_above").alias("above"),
            (F.col("depth") + F.coalesce(F.col("u_depth") + 1, F.lit(0))).alias("depth"),
        )
        state, reach = materialize(state, "chains"), reach * 2
    return state.select("conv_id", "id", F.greatest("turn", "above").alias("latest"), "depth", F.col("next").isNotNull().alias("cycle"))


def format_chats(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each message, call and result of `messages` (columns as in MESSAGES).

    conv_id, latest, depth, turn, place (the order, in this sequence), kind (message, call, result), id, status, json. Status is
    ok; for calls also invalid with the faults, duplicate, no_result or cycle; for results no_call.
    """
    nodes = _nodes(messages)
    calls = nodes.where("kind = 'call' and id is not null and conv_id is not null and turn is not null")
    meant = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place", "after")).alias("c"))
    answered = nodes.where("kind = 'result'").groupBy("conv_id", "id").agg(F.min("turn").alias("answered"), F.count("*").alias("results"))
    meant = meant.select("conv_id", "id", "c.turn", "c.place", "c.after").join(answered, ["conv_id", "id"], "left")
    meant = materialize(meant, "calls")
    known = meant.withColumnsRenamed({"turn": "c_turn", "place": "c_place"}).drop("after", "answered")
    known = materialize(known.join(_chains(meant), ["conv_id", "id"]), "linked_calls")
    linked = nodes.join(known.hint("shuffle_hash"), ["conv_id", "id"], "left")
    call, result, hangs = F.col("kind") == "call", F.col("kind") == "result", F.col("c_turn").isNotNull()
    first = (F.col("c_turn") == F.col("turn")) & (F.col("c_place") == F.col("place"))
    faults = argument_faults(schemas)
    status = (
        F.when(result, F.when(hangs, "ok").otherwise("no_call"))
        .when(call & hangs & ~first, "duplicate")
        .when(call & F.coalesce("cycle", F.lit(False)), "cycle")
        .when(call & (F.size(faults) > 0), F.concat(F.lit("invalid "), F.array_join(faults, " ")))
        .when(call & F.col("results").isNull(), "no_result")
        .otherwise("ok")
    )
    json = F.when(
        call, _object(arguments=F.coalesce(canonical_arguments(schemas), F.lit("{}")), call=quoted(F.col("id")), name=quoted(F.col("name")), role=quoted(F.col("role")))
    ).otherwise(_object(call=quoted(F.col("id")), content=quoted(F.col("text")), role=quoted(F.col("role"))))
    latest = F.when(hangs, F.greatest("turn", "latest")).otherwise(F.col("turn"))
    depth = F.when(hangs, 2 * F.col("depth") + F.when(result, 1).otherwise(0)).otherwise(F.lit(0)).cast("bigint")
    return linked.select("conv_id", latest.alias("latest"), depth.alias("depth"), "turn", "place", "kind", "id", status.alias("status"), json.alias("json"))
