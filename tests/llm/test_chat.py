import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vantage.llm import chat

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**18), 10**18) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_canonical(value):
    text = chat.canonical(value)
    assert json.loads(text) == value and chat.canonical(json.loads(text)) == text
    assert " " not in chat.canonical({"b": [1, 2.0], "a": {"c": None}}) and chat.canonical({"b": [1, 2.0], "a": {"c": None}}) == '{"a":{"c":null},"b":[1,2]}'


def test_schema():
    s = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "s": {"type": ["string", "null"], "pattern": "^a", "maxLength": 3}, "l": {"type": "array", "items": {"enum": [1, "x"]}, "minItems": 1}}, "required": ["n"], "additionalProperties": False}
    for good in ({"n": 1}, {"n": 2.0, "s": "ab", "l": [1, "x"]}, {"n": 5, "s": None}):
        assert chat.problems(good, s) == []
    for bad in ({}, {"n": 0}, {"n": True}, {"n": 1.5}, {"n": 1, "s": "b"}, {"n": 1, "s": "abcd"}, {"n": 1, "l": []}, {"n": 1, "l": [2]}, {"n": 1, "z": 1}, [], "n"):
        assert chat.problems(bad, s)


def plain_status(calls, results, schemas):
    """Each call's and stray result's status, by brute force."""
    out, seen = [], {}
    for c in sorted(calls, key=lambda c: (c[0], c[1], c[2])):
        key = (c[0], c[3])
        if key in seen:
            out.append((c[0], c[1], c[2], c[3], "repeated_call"))
        else:
            seen[key] = c
    answers = {}
    for r in sorted(results, key=lambda r: (r[0], r[1], r[2])):
        key = (r[0], r[3])
        if key not in seen:
            out.append((r[0], r[1], r[2], r[3], "orphan_result"))
        elif key in answers:
            out.append((r[0], r[1], r[2], r[3], "repeated_result"))
        else:
            answers[key] = r
    needs = {}
    for key, c in seen.items():
        args, refs, bad = chat.read_arguments(c[5], schemas.get(c[4]))
        needs[key] = (args, refs, bad)

    def stuck(key):
        """Whether what the call needs, all told, holds a cycle."""
        path, done = [], set()

        def walk(k):
            if k in path:
                return True
            if k in done or k not in seen:
                return False
            path.append(k)
            found = any(walk((k[0], x)) for x in needs[k][1])
            path.pop()
            done.add(k)
            return found

        return walk(key)

    for key, c in seen.items():
        args, refs, bad = needs[key]
        r = answers.get(key)
        status = "bad_arguments" if args is None or bad else "unknown_tool" if c[4] not in schemas else "unknown_ref" if any((c[0], x) not in seen for x in refs) else "cycle" if stuck(key) else "no_result" if r is None else "early_result" if r[1] < c[1] else "linked"
        out.append((c[0], c[1], c[2], c[3], status))
    return sorted(out), needs, seen, {key for key in seen if stuck(key)}


def test_random_conversations(spark):
    rng = random.Random(8)
    schemas = {"f": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}
    calls, results = [], []
    for conv in range(40):
        n = rng.randint(1, 9)
        turns = list(range(n))
        for t in turns:
            refs = {f"r{k}": {"$ref": f"c{rng.randrange(n + (rng.random() < 0.1))}"} for k in range(rng.choice([0, 0, 1, 1, 2]))}
            args = {"x": rng.choice([1, 2, 3, 4, 5, 6, "bad"]), **refs} if rng.random() < 0.97 else None
            calls.append((conv, t, rng.randrange(3), f"c{t if rng.random() < 0.95 else 0}", rng.choice("ffffffg"), json.dumps(args)))
            if rng.random() < 0.9:
                results.append((conv, t + rng.choice([1, 1, 1, 1, 0, -1]), 0, f"c{rng.choice([t, t, t, t, n + 3])}", "ok"))
    a = spark.createDataFrame(calls, "conv_id long, turn long, place int, call_id string, name string, arguments string")
    b = spark.createDataFrame(results, "conv_id long, turn long, place int, call_id string, content string")
    got = chat.link(a, b, schemas).collect()
    want, needs, seen, cyclic = plain_status(calls, results, schemas)
    assert sorted((r.conv_id, r.turn, r.place, r.call_id, r.status) for r in got) == want
    assert len({s for *_, s in want}) >= 8
    at = {(r.conv_id, r.call_id): (r.anchor_turn, r.anchor_place, r.level) for r in got if r.status not in ("repeated_call", "repeated_result", "orphan_result") and (r.conv_id, r.call_id) not in cyclic}
    for key, place in at.items():
        for x in needs[key][1]:
            if (key[0], x) in at:
                assert at[key[0], x] < place or at[key[0], x] == place and seen[key[0], x][:3] < seen[key][:3]
    for r in got:
        made = json.loads(r.json)
        assert chat.canonical(made) == r.json and made["id"] == r.call_id


def test_edge_cases(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "yes"), (1, 0, "user", None), (1, 1, "assistant", ""), (2, None, "user", "x"), (2, 3, None, "y"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "c"), (3, 2, "user", "w " * 100_000)]
    rows += [(4, 0, "user", "go"), (4, 1, "assistant", 'on <tool_call>{"id":"q","name":"reply","arguments":{"prompt":"p"}}</tool_call><tool_call>{bad</tool_call>'), (4, 2, "tool", '{"tool_call_id":"q","content":"done"}'), (4, 3, "tool", "no json")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, status string")
    got = chat.link_conversations(df).collect()
    found = sorted(((r.conv_id, r.turn, r.call_id, r.status) for r in got), key=str)
    assert (None, 0, "turn-0", "linked") in found and (1, 0, "turn-0", "bad_arguments") in found
    assert (3, 0, "turn-0", "linked") in found and (3, 0, "turn-0", "repeated_call") in found and (3, 1, "turn-0", "repeated_result") in found and (3, 2, "turn-2", "no_result") in found
    assert (4, 1, "q", "linked") in found and (4, 3, None, "orphan_result") in found and (4, 1, None, "bad_arguments") in found
    assert (2, None, None, "no_result") in found
    assert chat.link_conversations(df.limit(0)).collect() == []


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = df.collect()
    got = chat.link_conversations(df).collect()
    users = [(r.conv_id, r.turn) for r in rows if r.role == "user"]
    answers = {(r.conv_id, r.turn) for r in rows if r.role == "assistant"}
    linked = sorted((r.conv_id, r.turn) for r in got if r.status == "linked")
    assert linked == sorted({u for u in users if (u[0], u[1] + 1) in answers})
    assert {r.status for r in got} <= {"linked", "no_result", "orphan_result", "repeated_call", "repeated_result"}


def test_numbers_and_bad_arguments():
    assert [chat.canonical(x) for x in (1e-05, 1e-6, 1e-7, 123.5, 1e21, 1.5e300, -0.0, -2.50, 100.0, 1e20)] == ["0.00001", "0.000001", "1e-7", "123.5", "1e+21", "1.5e+300", "0", "-2.5", "100", "100000000000000000000"]
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "l": {"type": "array", "items": {"type": "string"}, "minItems": 2}, "prompt": {"type": "string"}}}
    assert chat.read_arguments('{"prompt":"\\ud800"}', schema)[0] is None
    assert chat.read_arguments('{"n":' + "9" * 400 + "}", schema)[2] == []
    assert chat.read_arguments('{"n":1e999}', schema)[0] is None
    assert chat.read_arguments('{"n":' + "9" * 9000 + "}", schema)[0] is None
    assert chat.read_arguments("[" * 100_000, schema)[0] is None
    assert chat.read_arguments('{"l":[{"$ref":"a"},"b"]}', schema) == ('{"l":[{"$ref":"a"},"b"]}', ["a"], [])
    assert chat.read_arguments('{"l":[{"$ref":"a"}]}', schema)[2] and chat.read_arguments('{"l":[{"$ref":"a"},3]}', schema)[2]


def test_tool_call_message_is_no_reply(spark):
    df = spark.createDataFrame([(1, 0, "assistant", '<tool_call>{"id":"q","name":"reply","arguments":{"prompt":"\\ud800"}}</tool_call>')], "conv_id long, turn long, role string, text string")
    assert [(r.call_id, r.turn) for r in chat.link_conversations(df).collect()] == [("q", 0)]


def test_long_waits_and_cycles(spark):
    """Waits longer than the rounds, and cycles with what hangs on them, end in the same places as a plain recursion."""
    n, calls = 45, []
    for i in range(n):  # each waits for the next: only the last stands at its own place
        calls.append((1, i, 0, f"c{i}", "f", json.dumps({"x": {"$ref": f"c{i + 1}"}} if i + 1 < n else {})))
    calls += [(2, 0, 0, "a", "f", '{"x":{"$ref":"b"}}'), (2, 1, 0, "b", "f", '{"x":{"$ref":"a"}}'), (2, 2, 0, "d", "f", '{"x":{"$ref":"b"}}'), (2, 3, 0, "e", "f", "{}"), (2, 4, 0, "s", "f", '{"x":{"$ref":"s"}}')]
    calls += [(3, 0, 0, "p", "f", '{"x":{"$ref":"q"}}'), (3, 5, 0, "q", "f", "{}"), (3, 2, 0, "r", "f", '{"x":{"$ref":"p"}}')]
    a = spark.createDataFrame(calls, "conv_id long, turn long, place int, call_id string, name string, arguments string")
    b = spark.createDataFrame([], "conv_id long, turn long, place int, call_id string, content string")
    got = {(r.conv_id, r.call_id): r for r in chat.link(a, b, {"f": {}}).collect()}
    for i in range(n):
        r = got[1, f"c{i}"]
        assert (r.anchor_turn, r.anchor_place, r.level, r.status) == (n - 1, 0, n - 1 - i, "no_result")
    assert {k[1] for k, r in got.items() if r.status == "cycle"} == {"a", "b", "d", "s"}
    assert all(got[2, c].anchor_turn == got[2, c].turn and got[2, c].level == 0 for c in "abdes")
    assert [(got[3, c].anchor_turn, got[3, c].level) for c in "qpr"] == [(5, 0), (5, 1), (5, 2)]
