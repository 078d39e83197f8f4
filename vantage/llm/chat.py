"""Tool calls of conversations, linked to their results, ordered, validated and serialised.

Calls and results are rows: a call has an identifier, a tool's name and JSON arguments; a result names the call that it
answers. Both are hash-joined by (conversation, identifier). A call depends on the calls whose identifiers its arguments
refer to, as objects {"$ref": "<identifier>"}. Arguments are validated against the tool's JSON schema, and every call is
serialised with its result as canonical JSON: sorted keys, no spaces, shortest numbers, UTF-8.

A row is returned for every call and every result without a call, with one status, the first that holds of
  repeated_call    another call of the conversation had the identifier before (by turn, then place)
  orphan_result    a result whose identifier no call has
  repeated_result  another result answered the call before
  bad_arguments    arguments that aren't a JSON object or don't fit the schema
  unknown_tool     no schema is known for the tool
  unknown_ref      arguments refer to an identifier that no call has
  cycle            the call depends on itself, by way of others or not
  early_result     the result comes before its call
  no_result        no result answers the call
  linked           none of these.
(anchor_turn, anchor_place, level) orders the calls of a conversation topologically: a call that comes after all it
depends on stands at its own place with level 0; any other stands right behind the last of those that it depends on, one
level deeper. Calls that depend on a cycle stand at their own places. Null conversation ids are one conversation; a null
identifier never links. Other columns are ignored, whatever their names. Texts of any length are read whole. Arguments
that hold what UTF-8 can't, such as lone surrogates, are bad arguments. An empty table gives no row.

Places are found in rounds over all conversations at once, from what must move on to what waits for it. Only where
``ROUNDS`` rounds don't settle them (long waits, or cycles) are the calls of one connected group sorted in one task: ids
alone, never a whole conversation.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import components, discard, map_batches, written

ROUNDS = 16
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


class _Ref:
    """Stands for a reference where arguments are validated: it fits any schema."""


REF = _Ref()


def number(value: float) -> str:
    """Integral numbers below 1e21 in full; others in the shortest form, with an exponent only below 1e-6 or from 1e21 on."""
    if not math.isfinite(value):
        raise ValueError("JSON has no such number")
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    own, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        text = f"{own[:point]}.{own[point:]}"
    elif -6 < point <= 0:
        text = f"0.{'0' * -point}{own}"
    else:
        text = f"{own[0]}{'.' if own[1:] else ''}{own[1:]}e{point - 1:+d}"
    return "-" * sign + text


def canonical(value: object) -> str:
    """Canonical JSON: keys sorted by UTF-16 code units, no spaces, shortest numbers, no escapes but needed ones."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return f"[{','.join(map(canonical, value))}]"
    if isinstance(value, _Ref):
        return '{"$ref"}'
    return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What keeps a value from fitting a JSON schema: type, enum, const, bounds, lengths, pattern, items, properties, required, additionalProperties."""
    out: list[str] = []
    if value is REF:
        return out
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds

        def fits(kind: str) -> bool:
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            if kind == "number":
                return number
            if kind == "integer":
                return number and (isinstance(value, int) or value.is_integer())
            return isinstance(value, TYPES[kind])

        if not any(map(fits, kinds)):
            return [f"{at}: not of type {' or '.join(kinds)}"]
    same = canonical(value) if "enum" in schema or "const" in schema else ""
    if "enum" in schema and same not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and same != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        for name, bad in (("minimum", lambda v, x: v < x), ("maximum", lambda v, x: v > x), ("exclusiveMinimum", lambda v, x: v <= x), ("exclusiveMaximum", lambda v, x: v >= x)):
            if name in schema and bad(value, schema[name]):
                out.append(f"{at}: {name} {schema[name]}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: length {len(value)}")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", math.inf):
            out.append(f"{at}: {len(value)} items")
        if "items" in schema:
            for k, x in enumerate(value):
                out += problems(x, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}: {k} is missing" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            if k in own:
                out += problems(x, own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}: {k} is unknown")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += problems(x, schema["additionalProperties"], f"{at}.{k}")
    return out


def references(value: object) -> list[str]:
    """Identifiers that a value refers to, in order, each once."""
    found: dict[str, None] = {}

    def walk(x: object) -> None:
        if isinstance(x, dict):
            if len(x) == 1 and isinstance(x.get("$ref"), str):
                found[x["$ref"]] = None
            for y in x.values():
                walk(y)
        elif isinstance(x, list):
            for y in x:
                walk(y)

    walk(value)
    return list(found)


def _no_constant(name: str) -> float:
    raise ValueError(name)


def read_arguments(text: str | None, schema: dict | None) -> tuple[str | None, list[str], list[str]]:
    """Canonical arguments (None if unreadable), references, and problems. References aren't held against the schema."""
    try:
        value = json.loads(text or "", parse_constant=_no_constant)
        if not isinstance(value, dict):
            return None, [], ["$: not an object"]
        text = canonical(value)
        text.encode()  # what UTF-8 can't hold is an error
        refs = references(value)

        def plain(x: object) -> object:
            if isinstance(x, dict):
                return REF if len(x) == 1 and isinstance(x.get("$ref"), str) else {k: plain(y) for k, y in x.items()}
            return [plain(y) for y in x] if isinstance(x, list) else x

        return text, refs, problems({k: plain(y) for k, y in value.items()}, schema or {})
    except (ValueError, RecursionError) as e:
        return None, [], [f"$: {type(e).__name__}"]


Place = tuple[int, int, int]


def settle(own: dict[int, Place], needs: dict[int, list[int]]) -> tuple[dict[int, Place], list[int]]:
    """Places of calls by what they depend on, in one task; and those that depend on a cycle."""
    order, stuck = kahn(own, needs)
    found: dict[int, Place] = {}
    for k in order:
        last = max((found[x] for x in needs.get(k, [])), default=None)
        found[k] = own[k] if last is None or last < own[k] else (last[0], last[1], last[2] + 1)
    return found, stuck


def kahn(places: dict, needs: dict) -> tuple[list, list]:
    """A topological order, ready identifiers by place, and those that depend on a cycle, by place."""
    left = {k: len([x for x in needs.get(k, []) if x in places]) for k in places}
    after: dict = {}
    for k, xs in needs.items():
        for x in xs:
            after.setdefault(x, []).append(k)
    ready = [(places[k], k) for k, n in left.items() if not n]
    heapq.heapify(ready)
    out = []
    while ready:
        _, k = heapq.heappop(ready)
        out.append(k)
        for x in after.get(k, []):
            left[x] -= 1
            if not left[x]:
                heapq.heappush(ready, (places[x], x))
    done = set(out)
    return out, sorted((k for k in places if k not in done), key=lambda k: places[k])


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, place, call_id, name, status, problems, anchor_turn, anchor_place, level, result_turn, json).

    ``calls`` has conv_id, turn, place, call_id, name, arguments (JSON text); ``results`` has conv_id, turn, place,
    call_id, content. Schemas are by tool name.
    """
    shared = calls.sparkSession.sparkContext.broadcast(schemas)  # the tools' schemas, whatever the corpus' size

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [read_arguments(a, shared.value.get(n)) for n, a in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            known = [n in shared.value for n in b.column(4).to_pylist()]
            cols = list(zip(*made, strict=True)) if made else [[]] * 3
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.string())), pa.array(["; ".join(x) for x in cols[2]], pa.string()), pa.array(known, pa.bool_())], ["conv_id", "turn", "place", "call_id", "name", "args", "refs", "problems", "known"])

    own = calls.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("place").cast("long"), "call_id", "name", "arguments")
    read = map_batches(own, check, "conv_id long, turn long, place long, call_id string, name string, args string, refs array<string>, problems string, known boolean")
    # the first call of an identifier is the call; a struct's minimum is combined before the shuffle, so no identifier is hot
    calls_ = written(read.withColumn("row", F.monotonically_increasing_id()), "calls")
    order = F.struct(F.coalesce("turn", F.lit(-1)).alias("t"), F.coalesce("place", F.lit(-1)).alias("p"), F.coalesce("args", F.lit("")).alias("a"), F.coalesce("name", F.lit("")).alias("n"), "row")
    named_first = calls_.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(order)["row"].alias("first"))
    bare = calls_.where("call_id is null").select(F.col("row").alias("first"))
    marked = calls_.join(named_first.select("first").unionByName(bare), F.col("row") == F.col("first"), "left")
    calls_ = written(marked.withColumn("nth", F.when(F.col("first").isNull(), 2).otherwise(1)).drop("first"), "calls")
    first = calls_.where("nth = 1")

    res = results.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("result_turn"), F.col("place").cast("long").alias("result_place"), "call_id", "content")
    res = written(res.withColumn("result_row", F.monotonically_increasing_id()), "results")
    order = F.struct(F.coalesce("result_turn", F.lit(-1)).alias("t"), F.coalesce("result_place", F.lit(-1)).alias("p"), F.coalesce("content", F.lit("")).alias("c"), "result_row")
    best = res.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(order)["result_row"].alias("first"))
    res = written(res.join(best.select("first"), F.col("result_row") == F.col("first"), "left").withColumn("answer", F.when(F.col("first").isNull() & F.col("call_id").isNotNull(), 2).otherwise(1)).drop("first"), "results")

    def on(a: DataFrame, b: DataFrame) -> Column:
        return a.conv_id.eqNullSafe(b.conv_id) & (a.call_id == b.call_id)

    # dependencies between identifiers; names only, no arguments
    place = F.struct(F.coalesce("turn", F.lit(-1)).alias("t"), F.coalesce("place", F.lit(-1)).alias("p"), F.lit(0).alias("l")).alias("at")
    named = first.where("call_id is not null").select("conv_id", "call_id", "row", place)
    needs = first.select("conv_id", "row", place, "refs").select("conv_id", "row", "at", F.explode("refs").alias("ref"))
    target = named.select(F.col("conv_id").alias("c2"), F.col("call_id").alias("ref2"), F.col("at").alias("at2"), F.col("row").alias("row2"))
    bound = written(needs.join(target, needs.conv_id.eqNullSafe(target.c2) & (needs.ref == target.ref2), "left"), "needs")
    unknown = bound.where("ref2 is null").select("row").distinct().withColumn("unknown", F.lit(True))
    edges = bound.where("ref2 is not null").select("row", "at", "row2", "at2")
    behind = lambda c: F.max(F.struct(F.col(f"{c}.t").alias("t"), F.col(f"{c}.p").alias("p"), (F.col(f"{c}.l") + 1).alias("l")))
    # a round: what stands behind or with a call that it depends on moves behind it
    front = written(edges.where("at2 >= at").groupBy("row").agg(behind("at2").alias("to")), "moved")
    moved, rounds = front, 0
    while rounds < ROUNDS and not front.isEmpty():
        step = edges.join(front.select(F.col("row").alias("row2"), F.col("to").alias("new2")), "row2").join(moved.withColumnRenamed("to", "now"), "row", "left")
        front = written(step.where("new2 >= coalesce(now, at)").groupBy("row").agg(behind("new2").alias("to")), "moved")
        every = written(moved.unionByName(front).groupBy("row").agg(F.max("to").alias("to")), "moved")
        discard(moved)
        moved, rounds = every, rounds + 1
    sorted_ = moved.select("row", F.col("to.t").alias("at_turn"), F.col("to.p").alias("at_place"), F.col("to.l").alias("level"), F.lit(False).alias("cycle"))
    if not front.isEmpty():
        roots = components(edges.select(F.col("row").alias("a"), F.col("row2").alias("b")))
        self_ = edges.where("row = row2").select(F.col("row").alias("node"), F.col("row").alias("root")).distinct()
        roots = written(roots.unionByName(self_.join(roots.select("node"), "node", "left_anti")), "groups")
        open_ = roots.join(front.select(F.col("row").alias("node")), "node").select("root").distinct()
        inside = written(roots.join(open_, "root").select(F.col("node").alias("row"), "root"), "groups")

        def sort(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            own = {int(r): (int(t), int(p), 0) for r, t, p, x in pdf[["row", "t", "p", "row2"]].itertuples(index=False) if pd.isna(x)}
            want: dict[int, list[int]] = {}
            for r, x in pdf.loc[pdf["row2"].notna(), ["row", "row2"]].itertuples(index=False):
                want.setdefault(int(r), []).append(int(x))
            found, stuck = settle(own, want)
            return pd.DataFrame([(r, *found.get(r, own[r]), r in set_) for set_ in (set(stuck),) for r in own], columns=["row", "at_turn", "at_place", "level", "cycle"])

        nodes = named.join(inside, "row").select("root", "row", F.col("at.t").alias("t"), F.col("at.p").alias("p"), F.lit(None).cast("long").alias("row2"))
        nameless = first.where("call_id is null").select("row", place).join(inside, "row").select("root", "row", F.col("at.t").alias("t"), F.col("at.p").alias("p"), F.lit(None).cast("long").alias("row2"))
        links = edges.join(inside, "row").select("root", "row", F.col("at.t").alias("t"), F.col("at.p").alias("p"), "row2")
        one = written(nodes.unionByName(nameless).unionByName(links).groupBy("root").applyInPandas(sort, "row long, at_turn long, at_place long, level int, cycle boolean"), "sorted")
        sorted_ = sorted_.join(inside, "row", "left_anti").unionByName(one)

    answered = first.join(res.where("answer = 1").drop("answer"), on(first, res), "left").select(first["*"], "result_turn", "content")
    full = answered.join(unknown, "row", "left").join(sorted_, "row", "left")
    status = (
        F.when(F.col("args").isNull() | (F.col("problems") != ""), "bad_arguments")
        .when(~F.col("known"), "unknown_tool")
        .when(F.col("unknown"), "unknown_ref")
        .when(F.col("cycle"), "cycle")
        .when(F.col("result_turn") < F.col("turn"), "early_result")
        .when(F.col("result_turn").isNull() & F.col("content").isNull(), "no_result")
        .otherwise("linked")
    )
    columns = ["conv_id", "turn", "place", "call_id", "name", "status", "problems", "anchor_turn", "anchor_place", "level", "result_turn", "args", "content"]
    full = full.select("conv_id", "turn", "place", "call_id", "name", status.alias("status"), "problems", F.coalesce("at_turn", "turn").alias("anchor_turn"), F.coalesce("at_place", "place").alias("anchor_place"), F.coalesce("level", F.lit(0)).alias("level"), "result_turn", "args", "content")
    again = calls_.where("nth > 1").select("conv_id", "turn", "place", "call_id", "name", F.lit("repeated_call").alias("status"), "problems", F.col("turn").alias("anchor_turn"), F.col("place").alias("anchor_place"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("result_turn"), "args", F.lit(None).cast("string").alias("content"))
    ids = named.select("conv_id", "call_id")
    matched = res.join(ids.withColumn("hit", F.lit(True)).withColumnsRenamed({"conv_id": "c2", "call_id": "i2"}), F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("call_id") == F.col("i2")), "left")
    rest = matched.where("hit is null or answer > 1").select("conv_id", F.col("result_turn").alias("turn"), F.col("result_place").alias("place"), "call_id", F.lit(None).cast("string").alias("name"), F.when(F.col("hit"), "repeated_result").otherwise("orphan_result").alias("status"), F.lit("").alias("problems"), F.col("result_turn").alias("anchor_turn"), F.col("result_place").alias("anchor_place"), F.lit(0).alias("level"), "result_turn", F.lit(None).cast("string").alias("args"), "content")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(i).to_pylist() for i, k in enumerate(columns)}
            made = [
                f'{{"arguments":{a or "null"},"id":{canonical(i)},"name":{canonical(n)},"result":{canonical(x)}}}' for a, i, n, x in zip(c["args"], c["call_id"], c["name"], c["content"], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:11], pa.array(made, pa.string())], [*columns[:11], "json"])

    rows = full.unionByName(again).unionByName(rest).select(columns)
    return map_batches(rows, write, "conv_id long, turn long, place long, call_id string, name string, status string, problems string, anchor_turn long, anchor_place long, level int, result_turn long, json string")


#: The tools that turns of plain conversations are read as calls of.
REPLY = {
    "reply": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "after": {"type": "string"}}, "required": ["prompt"], "additionalProperties": False},
    "review": {"type": "object", "properties": {"turns": {"type": "array", "items": {"type": "string"}, "minItems": 2}}, "required": ["turns"], "additionalProperties": False},
}


def as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text).

    Explicit ones are taken from the texts: an assistant's <tool_call>{"id", "name", "arguments"}</tool_call>, and a tool's
    message {"tool_call_id", "content"}. Besides, each user turn is a call of the tool ``reply`` named after its turn, and
    the assistant's message at the next turn is its result, unless it holds a tool call; the call refers to the user turn
    two before where there is one. Where a user turn has another two after it, a call of ``review`` beside it refers to
    both, so it has to wait for the later one.
    """
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    block = F.expr(r"regexp_extract_all(text, '(?s)<tool_call>(.*?)</tool_call>', 1)")
    said = m.where("role = 'assistant' and contains(text, '<tool_call>')").select("conv_id", "turn", F.posexplode(block).alias("place", "x"))
    field = lambda c, k: F.get_json_object(c, f"$.{k}")
    explicit = said.select("conv_id", "turn", (F.col("place") + 1).alias("place"), field("x", "id").alias("call_id"), field("x", "name").alias("name"), field("x", "arguments").alias("arguments"))
    tools = m.where("role = 'tool'").select("conv_id", "turn", F.lit(1).alias("place"), field("text", "tool_call_id").alias("call_id"), F.coalesce(field("text", "content"), "text").alias("content"))
    turn_id = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    users = m.where("role = 'user'")
    before = users.select(F.col("conv_id").alias("c2"), (F.col("turn") + 2).alias("t2")).distinct()
    users = users.join(before, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("turn") == F.col("t2")), "left")
    after = F.when(F.col("t2").isNotNull(), F.struct(turn_id(F.col("turn") - 2).alias("$ref")))
    replies = users.select("conv_id", "turn", F.lit(0).alias("place"), turn_id(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(after.alias("after"), F.col("text").alias("prompt"))).alias("arguments"))
    later = before.select("c2", (F.col("t2") - 4).alias("t2"))  # the user turn two before each
    both = m.where("role = 'user'").select("conv_id", "turn").distinct().join(later, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("turn") == F.col("t2")), "left_semi")
    refs = F.struct(F.array(*(F.struct(turn_id(F.col("turn") + n).alias("$ref")) for n in (0, 2))).alias("turns"))
    reviews = both.select("conv_id", "turn", F.lit(1).alias("place"), F.concat(F.lit("review-"), F.col("turn").cast("string")).alias("call_id"), F.lit("review").alias("name"), F.to_json(refs).alias("arguments"))
    answers = m.where("role = 'assistant' and not coalesce(contains(text, '<tool_call>'), false)").select("conv_id", "turn", F.lit(0).alias("place"), turn_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return replies.unionByName(reviews).unionByName(explicit), answers.unionByName(tools)


def link_conversations(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """``link`` of the calls and results of messages."""
    return link(*as_calls(messages), REPLY if schemas is None else schemas)
