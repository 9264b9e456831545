import json

from lexweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, id string"
TOOL = {"name": "get", "parameters": {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}, "n": {"type": "integer"}, "x": {"type": "number"}}, "additionalProperties": False}}


def call(name, arguments, call_id, needs=None):
    made = {"id": call_id, "name": name, "arguments": arguments}
    return made | ({"depends_on": needs} if needs else {})


def rows_of(spark, rows):
    df = spark.createDataFrame([(*r[:3], r[3] if r[3] is None or isinstance(r[3], str) else json.dumps(r[3]), "clash") for r in rows], SCHEMA)
    return sorted(chat.linked(df).collect(), key=lambda r: (str(r["conv_id"]), r["rank"], r["level"], r["turn"]))


def test_links_orders_and_validates(spark):
    got = rows_of(
        spark,
        [
            (1, 0, "system", {"content": "hi", "tools": [TOOL]}),
            (1, 1, "tool", {"tool_call_id": "a", "content": {"z": 1, "b": [2]}}),
            (1, 2, "assistant", {"tool_calls": [call("get", '{"q": "w", "n": 3}', "a"), call("get", {"n": "x", "m": 1}, "b")]}),
            (1, 3, "assistant", {"tool_calls": [call("put", {}, "c", ["d"]), call("get", [1], "a")]}),
            (1, 4, "assistant", {"tool_calls": [call("get", {"q": "é", "x": 1.5}, "d")]}),
            (1, 5, "tool", {"tool_call_id": "d", "content": "fine"}),
            (1, 6, "tool", {"tool_call_id": "zz", "content": "?"}),
        ],
    )
    assert [r["turn"] for r in got] == [0, 2, 1, 4, 5, 3, 6]
    by = {r["turn"]: json.loads(r["json"]) for r in got}
    first = by[2]["tool_calls"]
    assert [c["status"] for c in first] == ["answered", "unanswered"] and "problems" not in first[0]
    assert first[0]["arguments"] == '{"n":3,"q":"w"}' and first[1]["problems"] == ["missing:q", "type:n", "unknown:m"]
    assert [(c["status"], c["problems"]) for c in by[3]["tool_calls"]] == [("unanswered", ["undeclared"]), ("duplicate", ["not an object"])]
    assert by[1]["content"] == '{"b":[2],"z":1}' and by[6]["status"] == "orphan" and by[1]["status"] == "result"
    for r in got:
        assert list(json.loads(r["json"])) == sorted(json.loads(r["json"])) and ": " not in r["json"].replace("é", "")


def test_cycles_end(spark):
    got = rows_of(spark, [(3, 0, "assistant", {"tool_calls": [call("n", {}, "p", ["q"])]}), (3, 1, "assistant", {"tool_calls": [call("n", {}, "q", ["p"])]})])
    assert [json.loads(r["json"])["tool_calls"][0]["status"] for r in got] == ["cyclic", "cyclic"]


def test_plain_rows(spark, sf):
    odd = [(2, 0, "user", None), (2, 1, "assistant", "{broken"), (None, 3, "tool", {"tool_call_id": "x", "content": 1}), (2, 0, "user", None), (5, None, None, "")]
    got = chat.linked(spark.createDataFrame([(*r[:3], r[3] if r[3] is None or isinstance(r[3], str) else json.dumps(r[3]), "c") for r in odd], SCHEMA)).collect()
    assert len(got) == 5 and {r["status"] for r in got} == {"plain", "orphan"}
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    lines = {(r["conv_id"], r["turn"]): r for r in chat.linked(given).collect()}
    for r in given.collect():
        out = lines[r["conv_id"], r["turn"]]
        assert json.loads(out["json"]) == {"content": r["text"], "role": r["role"], "status": "plain"} and out["rank"] == r["turn"]
    assert len(lines) == given.count()
    assert chat.linked(given.limit(0)).count() == 0


def test_nothing_of_a_message_is_lost(spark):
    other = {"id": "b", "type": "function", "arguments": "{broken", "name": "get", "depends_on": "a"}
    rows = [
        (1, 0, "user", '{"a": 1}'),
        (1, 1, "system", {"content": "hi", "tools": [TOOL], "model": {"z": 1, "b": None}}),
        (1, 2, "assistant", {"tool_calls": [call("get", {"q": "w"}, "a"), other]}),
        (1, 3, "tool", {"tool_call_id": "a", "result": [1, None]}),
        (1, 4, "assistant", {"content": "x", "tool_calls": {"id": "c"}}),
        (1, 5, "assistant", {"content": "x", "tool_calls": None, "tool_call_id": "q"}),
        (None, 6, "assistant", {"tool_calls": [call("get", {"q": "w"}, "a")]}),
        (1, None, "assistant", {"tool_calls": [call("get", {"q": "v"}, "a", ["b"])]}),
        (1, 8, "assistant", {"tool_calls": ["odd", call("get", {}, "e")]}),
    ]
    df = spark.createDataFrame([(*r[:3], r[3] if isinstance(r[3], str) else json.dumps(r[3]), "clash") for r in rows], SCHEMA)
    got = {(r["conv_id"], r["turn"]): r for r in chat.linked(df).collect()}
    by = {k: json.loads(r["json"]) for k, r in got.items()}
    assert by[1, 0] == {"content": '{"a": 1}', "role": "user", "status": "plain"}
    assert by[1, 1]["tools"] == [TOOL] and by[1, 1]["extra"] == {"model": {"z": 1, "b": None}}
    first, second = by[1, 2]["tool_calls"]
    assert first["status"] == "answered" and "extra" not in first
    assert second["arguments"] == "{broken" and second["problems"] == ["not an object"] and second["extra"] == {"type": "function", "depends_on": "a"}
    assert by[1, 3]["extra"] == {"result": [1, None]} and by[1, 3]["status"] == "result"
    assert by[1, 4]["extra"] == {"tool_calls": {"id": "c"}} and "extra" not in by[1, 5] and by[1, 5]["tool_call_id"] == "q"
    for k in ((None, 6), (1, None)):
        assert got[k]["status"] == "calls" and got[k]["n_calls"] == 1 and by[k]["tool_calls"][0]["status"] == "unnamed"
    assert by[1, None]["tool_calls"][0]["depends_on"] == ["b"]
    assert by[1, 8]["extra"]["tool_calls"][0] == "odd" or [c.get("id") for c in by[1, 8]["tool_calls"]] == ["odd", "e"]
    for r in got.values():
        assert list(json.loads(r["json"])) == sorted(json.loads(r["json"]))


def test_schema_keywords(spark):
    cases = [
        ({"enum": ["a", 1]}, "b", ["enum:k"], []),
        ({"enum": ["a", 1]}, 1.0, [], []),
        ({"const": {"b": 1, "a": 2}}, {"a": 2, "b": 1}, [], []),
        ({"minimum": 2, "exclusiveMaximum": 3}, 1, ["minimum:k"], []),
        ({"minimum": 2, "exclusiveMaximum": 3}, 3.0, ["exclusiveMaximum:k"], []),
        ({"minimum": 9007199254740993}, 9007199254740992, ["minimum:k"], []),
        ({"type": ["string", "null"]}, None, [], []),
        ({"type": ["string", "null"]}, 3, ["type:k"], []),
        ({"type": "integer"}, 2.0, [], []),
        ({"type": "integer"}, 2.5, ["type:k"], []),
        ({"type": "array", "items": {"type": "integer"}, "maxItems": 1}, [1, "x"], ["maxItems:k", "type:k[1]"], []),
        ({"type": "object", "required": ["a"], "properties": {"b": {"minLength": 2}}, "additionalProperties": False}, {"b": "é", "c": 1}, ["minLength:k.b", "missing:k.a", "unknown:k.c"], []),
        ({"additionalProperties": {"type": "string"}}, {"x": 1}, ["type:k.x"], []),
        ({"pattern": "(", "format": "date", "title": "t", "anyOf": []}, "x", [], ["anyOf:k", "format:k", "pattern:k"]),
        ({"items": [{"type": "string"}], "type": "odd", "minimum": "2"}, [1], [], ["items:k", "minimum:k", "type:k"]),
        (True, 1, [], []),
        (False, 1, [], ["schema:k"]),
    ]
    tools = [{"name": f"t{i}", "parameters": {"type": "object", "properties": {"k": schema}}} for i, (schema, *_) in enumerate(cases)]
    deep, value = {"type": "string"}, 1
    for _ in range(chat.DEPTH):
        deep, value = {"items": deep}, [value]
    tools.append({"name": "deep", "parameters": {"properties": {"k": deep}}})
    calls = [call(f"t{i}", {"k": v}, f"c{i}") for i, (_, v, *_) in enumerate(cases)] + [call("deep", {"k": value}, "d")]
    got = rows_of(spark, [(1, 0, "system", {"tools": tools}), (1, 1, "assistant", {"tool_calls": calls})])
    made = json.loads(got[1]["json"])["tool_calls"]
    assert [(c.get("problems", []), c.get("unchecked", [])) for c in made[:-1]] == [(p, u) for *_, p, u in cases]
    assert "problems" not in made[-1] and made[-1]["unchecked"][0].startswith("depth:k[0]")
    assert got[1]["n_invalid"] == sum(bool(p) for *_, p, _ in cases)


def test_plan_is_native(spark, sf):
    plan = chat.linked(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_dependent_calls_with_cycles(spark, monkeypatch):
    """Ranks against a brute-force order; the rounds follow the longest chain, not the number of calls."""
    import random

    rng = random.Random(5)
    messages, results, graph = [], {}, {}
    for c in range(40):
        size = 25
        for k in range(size):
            needs = [f"c{n}" for n in {rng.randrange(max(0, k - 6), k) for _ in range(rng.randrange(3))}] if k else []
            if c % 4 == 0 and k in (3, 4):
                needs = ["c4" if k == 3 else "c3"]
            if c % 7 == 0 and k == 9:
                needs = ["c9", "nobody"]
            turn = rng.randrange(200) * 2
            while (c, turn) in results:
                turn += 2
            results[c, turn] = True
            messages.append((c, turn, "assistant", {"tool_calls": [call("n", {}, f"c{k}", needs)]}))
            answer = None
            if rng.random() < 0.7:
                answer = turn + rng.choice([1, 41, -39])
                messages.append((c, answer, "tool", {"tool_call_id": f"c{k}", "content": "x"}))
            graph[c, f"c{k}"] = (turn, answer, needs)

    def place(c, i, seen=()):
        """(rank, level), or None in or behind a cycle."""
        turn, _, needs = graph[c, i]
        if i in seen:
            return None
        rank, level = turn, 0
        for n in needs:
            if (c, n) not in graph:
                continue
            below = place(c, n, (*seen, i))
            if below is None:
                return None
            answer = graph[c, n][1]
            rank, level = max(rank, below[0], graph[c, n][0], answer if answer is not None else -1), max(level, below[1] + 2)
        return rank, level

    rounds = []
    table = chat.Scratch.table
    monkeypatch.setattr(chat.Scratch, "table", lambda self, df, name: (rounds.append(name), table(self, df, name))[1])
    got = [r for r in rows_of(spark, messages) if r["role"] == "assistant"]
    places = {k: place(*k) for k in graph}
    assert len(got) == len(graph) == 1000 and sum(p is None for p in places.values()) > 30
    for r in got:
        line = json.loads(r["json"])["tool_calls"][0]
        want = places[r["conv_id"], line["id"]]
        turn = graph[r["conv_id"], line["id"]][0]
        assert (r["rank"], r["level"]) == (want or (turn, 0)) and (line["status"] == "cyclic") == (want is None)
    longest = max(p[1] for p in places.values() if p) // 2
    assert sum(n.startswith("placed") for n in rounds) <= longest + 2


def test_long_text_and_ties(spark):
    long = "word " * 400_000
    rows = [(1, 0, "user", long), (1, 0, "user", long), (1, 0, "user", {"content": long}), (1, 0, "tool", {"tool_call_id": "a", "content": "1"}), (1, 0, "tool", {"tool_call_id": "a", "content": "2"})]
    got = rows_of(spark, rows)
    assert len(got) == 5 and [json.loads(r["json"])["content"] == long for r in got].count(True) == 3
    assert {r["status"] for r in got} == {"plain", "orphan"}
