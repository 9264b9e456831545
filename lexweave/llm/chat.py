"""Chat formatting with linked tool calls, in built-in functions only.

A message whose text is a JSON object with at least one of the keys ``content``, ``tools`` (name and JSON schema of the
arguments), ``tool_calls`` (id, name, arguments, and the ids it needs in ``depends_on``) and ``tool_call_id`` (for the role
``tool``, a result) is read by these keys; its other fields, and those of its calls, go to ``extra``. Calls and results meet in a hash join on (conversation, id), so even a conversation with a third of
all rows is spread by id and never gathered. A result's place is after its call, a call's place after the results it
needs; the order is topological: ``rank`` is the largest turn among a message and all it rests on, ``level`` the length
of the longest chain of links before it. Arguments are checked against the schema that the conversation declares,
to ``DEPTH`` levels of nested objects and arrays: ``type`` (a name or a list), ``enum``, ``const``, ``minimum``, ``maximum``,
``exclusiveMinimum``, ``exclusiveMaximum``, ``minLength``, ``maxLength``, ``minItems``, ``maxItems``, ``required``, ``properties``,
``additionalProperties`` and ``items`` (one schema). Any other keyword that restricts (``pattern``, ``format``, ``anyOf``, ``$ref``, ...),
one of an unexpected form and all below ``DEPTH`` is listed in the call's ``unchecked``. Numbers inside arrays or objects of
``enum`` and ``const`` are compared as they are written.
Each message becomes one line of canonical JSON: keys sorted, no blanks, absent fields left out.

Defined results: a null or plain text is content; text that is not valid JSON or has none of the keys is content as well;
``tools`` are carried as given, and ``tool_calls`` that are not a list of objects go to ``extra``; an arguments string that is
not JSON is carried as it is; of calls that share an id
in one conversation the first by (turn, place) is linked, the others are ``duplicate``; a result without a call is an
``orphan``; calls in a cycle of dependencies are ``cyclic`` and keep the order of their turns; null conversations, turns or ids never
link, but their calls stay in the message; repeated rows stay as they are; an empty table gives an empty table; only the named columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, materialise

_CALL = "struct<id:string,name:string,arguments:variant,depends_on:array<string>>"
_TOOL = "struct<name:string,parameters:string>"
_MESSAGE = f"struct<content:variant,tool_call_id:string,tool_calls:array<{_CALL}>,tools:array<{_TOOL}>>"

PROTOCOL = ("content", "tool_call_id", "tool_calls", "tools")
_OF_CALL = ("id", "name", "arguments", "depends_on")

# JSON schema types and the variant kinds that satisfy them.
KINDS = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*",
    "boolean": "BOOLEAN",
    "array": "ARRAY.*",
    "object": "OBJECT.*",
    "null": "VOID",
}
# The keywords that are checked with the variant kinds of their values, and those that restrict nothing.
_NUMBER = KINDS["number"]
CHECKED = {
    "type": "STRING|ARRAY<STRING>",
    "enum": "ARRAY.*",
    "const": ".*",
    **dict.fromkeys(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"), _NUMBER),
    **dict.fromkeys(("minLength", "maxLength", "minItems", "maxItems"), "BIGINT"),
    "required": "ARRAY<STRING>|ARRAY<VOID>",
    "properties": "OBJECT.*",
    "additionalProperties": "BOOLEAN|OBJECT.*",
    "items": "OBJECT.*",
}
NOTES = "title description default example examples deprecated readOnly writeOnly $schema $id $comment".split()
DEPTH = 16


def parsed(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, m, tools, extra, call_extras): ``m`` is the message's object or null if its text is plain.

    ``tools`` and ``extra`` are variants, ``call_extras`` the JSON texts of what else each call has.
    """
    text = F.col(text_col).cast("string")
    looks = text.rlike(r"^\s*\{") & F.try_parse_json(text).isNotNull()
    fields = F.when(looks, F.from_json(text, "map<string,variant>"))
    at = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text.alias("text"), fields.alias("fields"))
    spoken = F.arrays_overlap(F.map_keys("fields"), F.array(*map(F.lit, PROTOCOL)))
    at = at.withColumn("m", F.when(spoken, F.from_json("text", _MESSAGE)))
    listed = F.coalesce(F.forall("m.tool_calls", lambda c: c.isNotNull()), F.lit(False))
    at = at.withColumn("m", F.col("m").withField("tool_calls", F.when(listed, F.col("m.tool_calls"))))
    unread = lambda k, v: ~k.isin(*PROTOCOL) | ((k == "tool_calls") & ~listed & (F.schema_of_variant(v) != "VOID"))
    calls = F.from_json("text", "struct<tool_calls:array<map<string,variant>>>")["tool_calls"]
    return at.select(
        "conv", "turn", "role", "text", "m",
        F.when(F.col("m").isNotNull(), F.try_element_at("fields", F.lit("tools"))).alias("tools"),
        F.when(F.col("m").isNotNull(), _extra(F.map_filter("fields", unread))).alias("extra"),
        F.when(F.col("m.tool_calls").isNotNull(), F.transform(calls, lambda c, i: F.to_json(_extra(F.map_filter(c, lambda k, v: ~k.isin(*_OF_CALL) | ((k == "depends_on") & F.get("m.tool_calls", i)["depends_on"].isNull() & (F.schema_of_variant(v) != "VOID"))))))).alias("call_extras"),
    )


def _extra(fields: Column) -> Column:
    """The fields as one variant, whose keys are in order; null if there are none."""
    return F.when(F.size(fields) > 0, F.try_parse_json(F.to_json(fields)))


def _arguments(call: Column) -> Column:
    """Arguments as a variant object; a string that holds JSON is read."""
    given = call["arguments"]
    return F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(F.try_variant_get(given, "$", "string"))).otherwise(given)


def _is(kind: Column, kinds: str) -> Column:
    return F.coalesce(kind.rlike(f"^(?:{kinds})$"), F.lit(False))


def _fields(v: Column) -> Column:
    """The fields of a variant object; none if it is not one."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    return F.coalesce(F.when(_is(F.schema_of_variant(v), "OBJECT.*"), F.try_variant_get(v, "$", "map<string,variant>")), none)


def _members(v: Column) -> Column:
    """The members of a variant array; none if it is not one."""
    return F.coalesce(F.when(_is(F.schema_of_variant(v), "ARRAY.*"), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def _text(v: Column) -> Column:
    return F.to_json(F.struct(v.alias("v")))


def _order(a: Column, b: Column) -> Column:
    """Sign of a - b of two variants that are numbers; whole numbers are compared without rounding."""
    both = lambda t: F.signum(F.when(F.try_variant_get(a, "$", t) < F.try_variant_get(b, "$", t), -1).when(F.try_variant_get(a, "$", t) > F.try_variant_get(b, "$", t), 1).otherwise(0))
    whole = _is(F.schema_of_variant(a), "BIGINT") & _is(F.schema_of_variant(b), "BIGINT")
    numbers = _is(F.schema_of_variant(a), _NUMBER) & _is(F.schema_of_variant(b), _NUMBER)
    return F.when(whole, both("bigint")).when(numbers, both("double"))


def _equal(a: Column, b: Column) -> Column:
    return F.coalesce(_order(a, b) == 0, _text(a) == _text(b))


_STRINGS = "array<string>"
_NODES = "array<struct<at:string,v:variant,s:variant>>"


def _node(x: Column) -> Column:
    """What a place, its value and the map of its schema have: faults, unchecked keywords and the nodes below."""
    at, v, s, inner, members = x["at"], x["v"], x["s"], x["inner"], x["members"]
    kind = F.schema_of_variant(v)
    place = F.when(at == "", "$").otherwise(at)
    below = lambda k: F.when(at == "", k).otherwise(F.concat(at, F.lit("."), k))
    said = lambda k: F.try_element_at(s, F.lit(k))
    form = lambda k: _is(F.schema_of_variant(said(k)), CHECKED[k])
    whole = F.try_variant_get(v, "$", "double")

    def fits(name: Column) -> Column:
        out = F.lit(False)
        for known, kinds in KINDS.items():
            is_kind = _is(kind, kinds) | (_is(kind, _NUMBER) & (whole == F.floor(whole)) if known == "integer" else F.lit(False))
            out = out | ((name == known) & is_kind)
        return F.coalesce(out, F.lit(False))

    one = _is(F.schema_of_variant(said("type")), "STRING")
    types = F.when(one, F.array(F.try_variant_get(said("type"), "$", "string"))).when(form("type"), F.try_variant_get(said("type"), "$", _STRINGS))
    known_types = F.coalesce(F.forall(types, lambda t: t.isin(*KINDS)), F.lit(False))
    tests = {
        "type": known_types & ~F.exists(types, fits),
        "enum": form("enum") & ~F.exists(_members(said("enum")), lambda e: _equal(v, e)),
        "const": said("const").isNotNull() & ~_equal(v, said("const")),
        "minimum": form("minimum") & (_order(v, said("minimum")) < 0),
        "maximum": form("maximum") & (_order(v, said("maximum")) > 0),
        "exclusiveMinimum": form("exclusiveMinimum") & (_order(v, said("exclusiveMinimum")) <= 0),
        "exclusiveMaximum": form("exclusiveMaximum") & (_order(v, said("exclusiveMaximum")) >= 0),
    }
    for what, size in (("Length", F.when(_is(kind, "STRING"), F.length(F.try_variant_get(v, "$", "string")))), ("Items", F.when(_is(kind, "ARRAY.*"), F.size(members)))):
        tests[f"min{what}"] = form(f"min{what}") & (size < F.try_variant_get(said(f"min{what}"), "$", "bigint"))
        tests[f"max{what}"] = form(f"max{what}") & (size > F.try_variant_get(said(f"max{what}"), "$", "bigint"))
    faults = F.filter(F.array(*[F.when(t, F.concat(F.lit(f"{k}:"), place)) for k, t in tests.items()]), lambda f: f.isNotNull())
    is_object = _is(kind, "OBJECT.*")
    given, parts = F.map_keys(inner), _fields(said("properties"))
    required = F.coalesce(F.when(is_object & form("required"), F.try_variant_get(said("required"), "$", _STRINGS)), F.array().cast(_STRINGS))
    missing = F.transform(F.array_except(required, given), lambda k: F.concat(F.lit("missing:"), below(k)))
    more = F.array_except(given, F.map_keys(parts))
    closed = F.coalesce(_is(F.schema_of_variant(said("additionalProperties")), "BOOLEAN") & ~F.try_variant_get(said("additionalProperties"), "$", "boolean"), F.lit(False))
    unknown = F.when(closed, F.transform(more, lambda k: F.concat(F.lit("unknown:"), below(k)))).otherwise(F.array().cast(_STRINGS))

    forms = F.create_map(*[F.lit(y) for k, kinds in CHECKED.items() for y in (k, f"^(?:{kinds})$")])
    expected = lambda k: k.isin(*NOTES) | F.coalesce(F.rlike(F.schema_of_variant(F.try_element_at(s, k)), F.try_element_at(forms, k)), F.lit(False)) & ((k != "type") | known_types)
    unchecked = F.transform(F.filter(F.map_keys(s), lambda k: ~expected(k)), lambda k: F.concat(k, F.lit(":"), place))

    child = lambda k, value, schema: F.struct(k.alias("at"), value.alias("v"), schema.alias("s"))
    named = F.transform(F.array_intersect(given, F.map_keys(parts)), lambda k: child(below(k), F.try_element_at(inner, k), F.try_element_at(parts, k)))
    other = F.when(form("additionalProperties") & _is(F.schema_of_variant(said("additionalProperties")), "OBJECT.*"), F.transform(more, lambda k: child(below(k), F.try_element_at(inner, k), said("additionalProperties")))).otherwise(F.array().cast(_NODES))
    items = F.when(form("items"), F.transform(members, lambda m, i: child(F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), m, said("items")))).otherwise(F.array().cast(_NODES))
    return F.struct(F.concat(faults, missing, unknown).alias("faults"), unchecked.alias("unchecked"), F.concat(named.cast(_NODES), other.cast(_NODES), items.cast(_NODES)).alias("nodes"))


def verdict(arguments: Column, schema: Column) -> Column:
    """(problems, unchecked): ``missing:k``, ``unknown:k``, ``type:k``, ``enum:k``, ... by path, or ``not an object``, and the keywords not checked; sorted.

    ``schema`` is a JSON text, null if the tool is not declared.
    """
    kind = f"struct<nodes:{_NODES},faults:{_STRINGS},unchecked:{_STRINGS}>"
    start = F.struct(F.array(F.struct(F.lit("").alias("at"), arguments.alias("v"), F.try_parse_json(schema).alias("s"))).alias("nodes"), F.array().alias("faults"), F.array().alias("unchecked")).cast(kind)

    def step(state: Column, _: Column) -> Column:
        readable = lambda n: _is(F.schema_of_variant(n["s"]), "OBJECT.*")
        opened = F.transform(F.filter(state["nodes"], readable), lambda n: F.struct(n["at"].alias("at"), n["v"].alias("v"), _fields(n["s"]).alias("s"), _fields(n["v"]).alias("inner"), _members(n["v"]).alias("members")))
        seen = F.transform(opened, _node)
        free = lambda n: F.coalesce(_is(F.schema_of_variant(n["s"]), "BOOLEAN") & F.try_variant_get(n["s"], "$", "boolean"), F.lit(False))
        odd = F.transform(F.filter(state["nodes"], lambda n: ~readable(n) & ~free(n)), lambda n: F.concat(F.lit("schema:"), F.when(n["at"] == "", "$").otherwise(n["at"])))
        return let(seen, lambda x: F.struct(F.flatten(x["nodes"]).alias("nodes"), F.concat(state["faults"], F.flatten(x["faults"])).alias("faults"), F.concat(state["unchecked"], odd, F.flatten(x["unchecked"])).alias("unchecked")).cast(kind))

    def told(state: Column) -> Column:
        deep = F.transform(state["nodes"], lambda n: F.concat(F.lit("depth:"), n["at"]))
        return F.struct(F.sort_array(state["faults"]).alias("problems"), F.sort_array(F.concat(state["unchecked"], deep)).alias("unchecked"))

    is_object = _is(F.schema_of_variant(arguments), "OBJECT.*")
    only = lambda p: F.struct(F.array(F.lit(p)).alias("problems"), F.array().cast(_STRINGS).alias("unchecked"))
    return F.when(~is_object, only("not an object")).when(schema.isNull(), only("undeclared")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, step, told))


def _calls(messages: DataFrame) -> DataFrame:
    """One row per call: the linked one of each (conv, id) has ``nth`` 0."""
    some = messages.where("m.tool_calls is not null").select("conv", "turn", "row", "call_extras", F.posexplode("m.tool_calls").alias("at", "call"))
    return some.select(
        "conv", "turn", "row", "at", F.col("call.id").alias("id"), F.col("call.name").alias("name"), _arguments(F.col("call")).alias("arguments"),
        F.try_variant_get("call.arguments", "$", "string").alias("raw"), F.coalesce("call.depends_on", F.array().cast("array<string>")).alias("needs"), F.get("call_extras", F.col("at")).alias("extra"),
    )


def linked(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, rank, level, role, status, n_calls, n_invalid, json) for every message."""
    messages = parsed(df, conv_col, turn_col, role_col, text_col).withColumn("row", F.xxhash64("conv", "turn", "role", "text"))
    calls = _calls(messages)
    tools = messages.where("m.tools is not null").select("conv", "turn", F.posexplode("m.tools").alias("at", "tool"))
    schemas = tools.groupBy("conv", F.col("tool.name").alias("name")).agg(F.min_by("tool.parameters", F.struct("turn", "at")).alias("schema"))
    schemas = schemas.select("conv", "name", F.coalesce("schema", F.lit("{}")).alias("schema"))
    checked = calls.join(schemas, ["conv", "name"], "left").withColumn("verdict", verdict(F.col("arguments"), F.col("schema")))
    text_of = F.to_json(F.struct(F.col("arguments").alias("a")))
    checked = materialise(checked.select("conv", "turn", "row", "at", "id", "name", F.when(F.col("arguments").isNotNull(), text_of.substr(F.lit(6), F.length(text_of) - 6)).otherwise(F.col("raw")).alias("arguments"), "needs", "verdict.problems", "verdict.unchecked", "extra"), "chat-calls")
    first = checked.where("conv is not null and turn is not null and id is not null").groupBy("conv", "id").agg(F.min(F.struct("turn", "at")).alias("f"))
    first = first.select("conv", "id", F.col("f.turn").alias("call_turn"), F.col("f.at").alias("call_at"))
    results = messages.where("role = 'tool' and m.tool_call_id is not null").select("conv", F.col("m.tool_call_id").alias("id"), "turn")
    answered = results.groupBy("conv", "id").agg(F.count("*").alias("n_results"), F.min("turn").alias("result_turn"))
    nodes = first.join(answered, ["conv", "id"], "left")
    needs = checked.select("conv", "id", F.explode("needs").alias("need")).distinct()
    ranked = _ranks(nodes.select("conv", "id", "call_turn", "result_turn"), needs)

    per_call = checked.join(nodes.join(ranked, ["conv", "id"], "left"), ["conv", "id"], "left")
    status = (
        F.when(F.col("call_turn").isNull() | F.col("turn").isNull(), "unnamed")
        .when((F.col("call_turn") != F.col("turn")) | (F.col("call_at") != F.col("at")), "duplicate")
        .when(F.col("cyclic"), "cyclic")
        .when(F.col("n_results").isNull(), "unanswered")
        .otherwise("answered")
    )
    # canonical: the keys of each object in sorted order
    item = F.struct(F.col("at"), F.struct(F.col("arguments"), F.when(F.size("needs") > 0, F.col("needs")).alias("depends_on"), F.col("extra"), F.col("id"), F.col("name"), F.when(F.size("problems") > 0, F.col("problems")).alias("problems"), status.alias("status"), F.when(F.size("unchecked") > 0, F.col("unchecked")).alias("unchecked")).alias("c"))
    per_message = per_call.groupBy("conv", "turn", "row").agg(
        F.sort_array(F.collect_set(item)).alias("items"),
        F.max("rank").alias("call_rank"),
        F.max("level").alias("call_level"),
    )
    # Only messages with calls and results with an id take part in joins; plain ones, most of all, are never dealt by a key.
    tool_id = F.when(F.col("role") == "tool", F.col("m.tool_call_id"))
    marked = messages.withColumn("id", tool_id).withColumn("has_calls", F.coalesce(F.size("m.tool_calls") > 0, F.lit(False)))
    of_message = per_message.withColumnsRenamed({k: f"{k}_of" for k in ("conv", "turn", "row")})
    same = F.col("conv").eqNullSafe(F.col("conv_of")) & F.col("turn").eqNullSafe(F.col("turn_of")) & (F.col("row") == F.col("row_of"))
    calling = marked.where("has_calls").join(of_message, same, "left").drop("conv_of", "turn_of", "row_of")
    at = calling.unionByName(marked.where("not has_calls"), allowMissingColumns=True)
    owner = nodes.join(ranked, ["conv", "id"], "left").select("conv", "id", F.col("call_turn").alias("own_turn"), F.coalesce("rank", "call_turn").alias("own_rank"), F.coalesce("level", F.lit(0)).alias("own_level"))
    at = at.where("id is not null").join(owner, ["conv", "id"], "left").unionByName(at.where("id is null"), allowMissingColumns=True)
    is_result = F.col("id").isNotNull()
    state = F.when(is_result & F.col("own_turn").isNull(), "orphan").when(is_result, "result").when(F.size("items") > 0, "calls").otherwise("plain")
    content = F.when(F.col("m").isNull(), F.col("text")).otherwise(
        F.when(F.schema_of_variant("m.content") == "STRING", F.try_variant_get("m.content", "$", "string")).when(F.col("m.content").isNotNull(), F.to_json("m.content"))
    )
    of_call = F.transform("items", lambda x: x["c"].withField("extra", F.try_parse_json(x["c"]["extra"])))
    line = F.struct(content.alias("content"), F.col("extra"), F.col("role"), state.alias("status"), F.col("m.tool_call_id").alias("tool_call_id"), of_call.alias("tool_calls"), F.col("tools"))
    none = F.lit(0).cast("long")
    return at.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.greatest(F.col("turn"), F.when(is_result, F.col("own_rank")).otherwise(F.col("call_rank"))).alias("rank"),
        F.coalesce(F.when(is_result, F.col("own_level") + 1).otherwise(F.col("call_level")), F.lit(0)).cast("long").alias("level"),
        "role",
        state.alias("status"),
        F.coalesce(F.size("items").cast("long"), none).alias("n_calls"),
        F.coalesce(F.size(F.filter("items", lambda x: x["c"]["problems"].isNotNull())).cast("long"), none).alias("n_invalid"),
        F.to_json(line).alias("json"),
    )


def _ranks(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv, id, rank, level, cyclic) of every call that needs another.

    Peels the graph: each round places the calls whose needs all have a place, and only calls that still wait go on, so
    the rounds follow the longest chain whatever cycles there are. When none can be placed, those that are left stand in or behind a
    cycle; they keep their own turn and level 0.
    """
    scratch = Scratch(nodes.sparkSession, "chat")
    linked = needs.join(nodes.select("conv", F.col("id").alias("need"), F.col("call_turn").alias("need_turn")), ["conv", "need"])
    linked = linked.join(nodes.select("conv", "id", "call_turn"), ["conv", "id"]).where("need_turn <> call_turn or need = id")  # calls of one message stand together
    waiting = scratch.table(linked.select("conv", "id", "need", F.lit(None).cast("long").alias("r"), F.lit(None).cast("int").alias("l")), "needs")
    if waiting.isEmpty():
        return waiting.select("conv", "id", F.col("r").alias("rank"), F.col("l").alias("level"), F.lit(False).alias("cyclic"))
    own = nodes.select("conv", "id", F.col("call_turn").alias("turn"), F.greatest("call_turn", F.coalesce("result_turn", "call_turn")).alias("done"))
    dependent = waiting.select("conv", "id").distinct()
    ready = own.join(dependent, ["conv", "id"], "left_anti").select("conv", "id", F.col("turn").alias("rank"), F.lit(0).alias("level"), "done")
    i = 0
    while True:
        below = ready.select("conv", F.col("id").alias("need"), F.greatest("rank", "done").cast("long").alias("new_r"), (F.col("level") + 2).alias("new_l"))
        waiting = waiting.join(below, ["conv", "need"], "left").select("conv", "id", "need", F.coalesce("r", "new_r").alias("r"), F.coalesce("l", "new_l").alias("l"))
        waiting = scratch.table(waiting, f"waiting-{i}")
        if i:
            scratch.drop(f"waiting-{i - 1}")
        placed = waiting.groupBy("conv", "id").agg(F.max("r").alias("r"), F.max("l").alias("l"), (F.count("r") == F.count("*")).alias("all")).where("all")
        placed = placed.join(own, ["conv", "id"]).select("conv", "id", F.greatest("r", "turn").alias("rank"), F.col("l").alias("level"), "done")
        ready = scratch.table(placed, f"placed/round={i}")
        if ready.isEmpty():
            break
        waiting = waiting.join(ready.select("conv", "id"), ["conv", "id"], "left_anti")
        i += 1
    at = scratch.read("placed", ready.schema).select("conv", "id", "rank", "level", F.lit(False).alias("cyclic"))
    left = waiting.select("conv", "id").distinct().join(own, ["conv", "id"])
    return at.unionByName(left.select("conv", "id", F.col("turn").alias("rank"), F.lit(0).alias("level"), F.lit(True).alias("cyclic")))
