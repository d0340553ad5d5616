"""Chat formatting: tool calls linked to their results.

Calls and results are hash-joined by (conv_id, call_id); the first of each in turn order counts, later ones are reported as
duplicates, and neither side is lost. Arguments are validated against a schema by tool name, a call's dependencies are the ids
it refers to as {"$ref": id} within its arguments, and calls get a topological position in their conversation, the earliest
first among those whose dependencies are done. Where every reference points backwards that is turn order, numbered over a range
shuffle; only conversations in which one points forwards go through Kahn's algorithm, on ids alone. Records are canonical JSON:
keys sorted by code point, no spaces, whole numbers without a fraction, lone surrogates as U+FFFD.

Events come from the table (conv_id, turn, role, text): `<tool_call>{"id", "name", "arguments"}</tool_call>` and
`<tool_response>{"id", "content"}</tool_response>` anywhere in a text. `tool_turns` writes such texts for plain conversations.

Defined results: null text counts as empty; a text without tags has no events; a null conversation is one conversation, a null
turn comes first; a call without a result is `unanswered`, a result without a call `orphan`; JSON that is malformed, or nested
more than `DEEPEST` levels deep, is a call or result with the error `malformed`, whose payload is its body and whose id is made of its place and a digest of its body, so that other bodies
at one place are other calls; ids without a call
that are referred to give `unknown reference`; calls on a cycle, or behind one, come after all others in turn order with the
error `cycle`; repeated rows are duplicates; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, load, pieces
from .jaccard_join import groups

#: Levels of arrays and objects in a payload.
DEEPEST = 200
SCHEMAS: dict[str, dict] = {
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "properties": {
            "prompt": {"type": "string", "minLength": 1},
            "turn": {"type": "integer", "minimum": 0},
            "after": {"type": "array", "items": {"type": "object", "required": ["$ref"], "properties": {"$ref": {"type": "string"}}}},
        },
        "additionalProperties": False,
    }
}
_TAG = re.compile(r"<tool_(call|response)>(.*?)</tool_\1>", re.S)
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def parse(text: str) -> Any:
    """JSON without NaN or infinities, also such as only numbers too large become; repeated keys and too many levels are refused by ValueError."""

    def whole(pairs: list[tuple[str, Any]]) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("repeated key")
        return out

    def no(name: str) -> None:
        raise ValueError(name)

    def finite(digits: str) -> float:
        return x if math.isfinite(x := float(digits)) else no(digits)

    try:
        x = json.loads(text, object_pairs_hook=whole, parse_constant=no, parse_float=finite)
    except RecursionError:
        raise ValueError("too deep") from None
    level, depth = [x], 0
    while level := [v for c in level if isinstance(c, (dict, list)) for v in (c.values() if isinstance(c, dict) else c)]:
        depth += 1
        if depth > DEEPEST:
            raise ValueError("too deep")
    return x


def plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {_sound(k): plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [plain(v) for v in x]
    if isinstance(x, str):
        return _sound(x)
    if isinstance(x, float):
        if not math.isfinite(x):
            return None
        return int(x) if x == int(x) and abs(x) < 2**53 else x
    return x


def _sound(s: str) -> str:
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical(x: Any) -> str:
    return json.dumps(plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def validate(x: Any, schema: dict, at: str = "$") -> list[str]:
    """Breaches of a schema: type, enum, const, required, properties, additionalProperties, items, and bounds of size and value."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    if kinds:
        fits = any((k == "number" and number) or (k == "integer" and number and x == int(x)) or (k in _KINDS and isinstance(x, _KINDS[k])) for k in kinds)
        if not fits:
            return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and x not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and x != schema["const"]:
        out.append(f"{at}: not the constant")
    if isinstance(x, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in x]
        for k in sorted(x):
            if k in known:
                out += validate(x[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unexpected")
    if isinstance(x, list) and "items" in schema:
        for i, v in enumerate(x):
            out += validate(v, schema["items"], f"{at}[{i}]")
    size = len(x) if isinstance(x, (str, list)) else None
    name = "Length" if isinstance(x, str) else "Items"
    if size is not None and (size < schema.get(f"min{name}", 0) or size > schema.get(f"max{name}", math.inf)):
        out.append(f"{at}: size {size}")
    if number and (x < schema.get("minimum", -math.inf) or x > schema.get("maximum", math.inf)):
        out.append(f"{at}: out of range")
    if isinstance(x, str) and "pattern" in schema and not re.search(schema["pattern"], x):
        out.append(f"{at}: no match")
    return out


def references(x: Any) -> list[str]:
    """Ids referred to, in order of first mention."""
    out: dict[str, None] = {}
    todo = [x]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if isinstance(v.get("$ref"), str):
                out[v["$ref"]] = None
            todo += [v[k] for k in sorted(v, reverse=True)]
        elif isinstance(v, list):
            todo += reversed(v)
    return list(out)


def topological(ids: list[str], needs: list[list[str]]) -> tuple[list[int], list[bool]]:
    """Position of each call, the earliest first among those free, and whether it lies on or behind a cycle. ids: distinct, in turn order."""
    at = {x: i for i, x in enumerate(ids)}
    wait = [len({at[d] for d in deps if d in at}) for deps in needs]
    freed: list[list[int]] = [[] for _ in ids]
    for i, deps in enumerate(needs):
        for j in {at[d] for d in deps if d in at}:
            freed[j].append(i)
    ready = [i for i, w in enumerate(wait) if not w]
    heapq.heapify(ready)
    order = []
    while ready:
        i = heapq.heappop(ready)
        order.append(i)
        for j in freed[i]:
            wait[j] -= 1
            if not wait[j]:
                heapq.heappush(ready, j)
    stuck = [w > 0 for w in wait]
    order += [i for i, s in enumerate(stuck) if s]
    position = [0] * len(ids)
    for k, i in enumerate(order):
        position[i] = k
    return position, stuck


def events_of(turn: int | None, text: str) -> list[tuple[str, str, str | None, str | None, list[str], list[str]]]:
    """Events of a turn: kind, call_id, name, payload (canonical JSON), references, errors."""
    out = []
    for n, (kind, body) in enumerate(_TAG.findall(text)):
        try:
            x = parse(body)
            if not isinstance(x, dict) or not isinstance(x.get("id"), str):
                raise ValueError("no id")
        except ValueError:
            out.append((kind, f"malformed-{turn}-{n}-{hashlib.sha256(body.encode()).hexdigest()[:16]}", None, canonical(body), [], ["malformed"]))
            continue
        if kind == "call":
            name, arguments = x.get("name"), x.get("arguments", {})
            out.append((kind, _sound(x["id"]), _sound(name) if isinstance(name, str) else None, canonical(arguments), references(plain(arguments)), []))
        else:
            out.append((kind, _sound(x["id"]), None, canonical(x.get("content")), [], []))
    return out


_EVENT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("k", pa.int32()), ("kind", pa.string()), ("call_id", pa.string()), ("name", pa.string()), ("payload", pa.string()), ("refs", pa.list_(pa.string())), ("errors", pa.list_(pa.string()))])


def events(conversations: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls, validated, and results of a table of turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                out = []
                for conv, turn, text in zip(*(piece.column(c).to_pylist() for c in ("conv_id", "turn", "text"))):
                    for k, (kind, call_id, name, payload, refs, errors) in enumerate(events_of(turn, text)):
                        if kind == "call" and not errors:
                            errors = validate(parse(payload), schemas[name]) if name in schemas else [f"unknown tool {name}"]
                        out.append((conv, turn, k, kind, call_id, name, payload, refs, errors))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _EVENT)], schema=_EVENT)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.mapInArrow(run, "conv_id long, turn long, k int, kind string, call_id string, name string, payload string, refs array<string>, errors array<string>")


def in_turn_order(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, seq: each call's place in its conversation by (turn, k). A conversation's calls may lie in several partitions of a range shuffle."""
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("k").asc()]
    placed = calls.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed.select("conv_id", "call_id", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")), "ordered")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = placed.join(F.broadcast(before), "part").select("conv_id", "call_id", (F.col("before") + F.col("at")).alias("at"))
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first")).withColumnRenamed("conv_id", "fc")
    return placed.join(first, F.col("conv_id").eqNullSafe(F.col("fc"))).select("conv_id", "call_id", (F.col("at") - F.col("first")).alias("seq"))


def tool_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, text: plain turns as calls of `reply` and their results, by fixed rules on the turn and a checksum of its text.

    A user turn calls `reply` with its text, after the user turn before it; an assistant turn is the result of the turn before
    it. Of the checksums some name the next user turn instead (a forward reference, unknown where there is none and often a
    cycle), none, or two turns before; some give a bad or an unexpected argument, and some calls and results come twice or
    under an id that nothing has."""
    text = F.coalesce("text", F.lit(""))
    turn, sum_ = F.col("turn").cast("long"), F.crc32(F.encode(text, "UTF-8"))
    ident = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    ref = lambda t: F.struct(ident(t).alias("$ref"))
    kind, rare = sum_ % 8, sum_ % 16
    after = F.when(kind == 1, F.array(ref(turn + 2))).when(kind.isin(3, 5) | (turn < 2), F.lit(None)).when((kind == 4) & (turn >= 4), F.array(ref(turn - 2), ref(turn - 4))).otherwise(F.array(ref(turn - 2)))
    given = lambda t: F.struct(text.alias("prompt"), t.alias("turn"), after.alias("after"))
    called = lambda arguments: F.concat(F.lit("<tool_call>"), F.to_json(F.struct(ident(turn).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"))), F.lit("</tool_call>"))
    call = F.when(rare == 5, called(given(turn.cast("string")))).when(rare == 6, called(F.struct(text.alias("prompt"), turn.alias("turn"), after.alias("after"), F.lit(True).alias("loud")))).otherwise(called(given(turn)))
    answer = lambda to: F.concat(F.lit("<tool_response>"), F.to_json(F.struct(to.alias("id"), text.alias("content"))), F.lit("</tool_response>"))
    result = F.when(kind == 1, answer(F.concat(ident(turn - 1), F.lit("-lost")))).otherwise(answer(ident(turn - 1)))
    tagged = F.when(F.col("role") == "user", F.repeat(call, F.when(rare == 7, 2).otherwise(1))).when(F.col("role") == "assistant", F.repeat(result, F.when(kind == 2, 2).otherwise(1)))
    return conversations.select("conv_id", turn.alias("turn"), tagged.alias("text"))


def link_tool_calls(conversations: DataFrame, schemas: dict[str, dict] = SCHEMAS) -> DataFrame:
    """One row per call, orphan result or duplicate: conv_id, call_id, turn, seq, name, status, valid, errors, record (canonical JSON)."""
    spark = conversations.sparkSession
    found = cut(events(conversations, schemas).withColumn("rid", F.monotonically_increasing_id()), "events")
    # the first of each id and kind, by a minimum that is combined before it is shuffled
    first = found.groupBy("conv_id", "call_id", "kind").agg(F.min(F.struct(F.col("turn").isNotNull().alias("later"), "turn", "k", "payload", "rid")).alias("x"), F.count(F.lit(1)).alias("n")).select(F.col("x.rid").alias("rid"), "n")
    found = cut(found.join(first, "rid", "left").withColumn("copy", F.when(F.col("n").isNull(), 2).otherwise(1)).drop("n", "rid"), "numbered")
    calls = found.filter("kind = 'call' and copy = 1").drop("kind", "copy")
    results = found.filter("kind = 'response' and copy = 1").select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("turn").alias("result_turn"), F.col("payload").alias("result"))
    # references: where they lead, and which conversations point forwards
    place = F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), "k")
    refs = calls.select("conv_id", "call_id", place.alias("at"), F.explode("refs").alias("ref"))
    target = calls.select(F.col("conv_id").alias("tc"), F.col("call_id").alias("ti"), place.alias("there"))
    led = cut(refs.join(target, F.col("conv_id").eqNullSafe(F.col("tc")) & (F.col("ref") == F.col("ti")), "left").select("conv_id", "call_id", "ref", "at", "there"), "references")
    forward = led.filter("there >= at").select("conv_id").distinct()
    lost = led.filter("there is null").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("unknown reference "), "ref"))).alias("lost"))
    natural = calls.select("conv_id", "call_id", "turn", "k", "refs")
    hinted = forward.withColumnRenamed("conv_id", "fc")
    bent = natural.join(hinted, natural.conv_id.eqNullSafe(hinted.fc), "left_semi")
    straight = natural.join(hinted, natural.conv_id.eqNullSafe(hinted.fc), "left_anti").select("conv_id", "call_id", "turn", "k")
    straight = in_turn_order(straight).withColumn("cycle", F.lit(False))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out_schema = pa.schema([("conv_id", pa.int64()), ("call_id", pa.string()), ("seq", pa.int64()), ("cycle", pa.bool_())])

    def kahn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["conv_id"]):
            position, stuck = topological(g["call_id"], g["refs"])
            yield pa.RecordBatch.from_arrays([pa.array(g["conv_id"], pa.int64()), pa.array(g["call_id"]), pa.array(position, pa.int64()), pa.array(stuck)], schema=out_schema)

    sorted_ = bent.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "k").select("conv_id", "call_id", "refs").mapInArrow(kahn, "conv_id long, call_id string, seq long, cycle boolean")
    order = straight.unionByName(sorted_).withColumnsRenamed({"conv_id": "oc", "call_id": "oi"})
    joined = calls.join(results.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "full_outer")
    lost = lost.withColumnsRenamed({"conv_id": "lc", "call_id": "li"})
    joined = joined.join(order, F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("call_id") == F.col("oi")), "left")
    joined = joined.join(lost, F.col("conv_id").eqNullSafe(F.col("lc")) & (F.col("call_id") == F.col("li")), "left")
    is_call = F.col("payload").isNotNull()
    none = F.array().cast("array<string>")
    errors = F.when(is_call, F.concat(F.coalesce("errors", none), F.coalesce("lost", none), F.when(F.col("cycle"), F.array(F.lit("cycle"))).otherwise(none))).otherwise(none)
    linked = joined.select(
        F.when(is_call, F.col("conv_id")).otherwise(F.col("rc")).alias("conv_id"),
        F.when(is_call, F.col("call_id")).otherwise(F.col("ri")).alias("call_id"),
        F.when(is_call, F.col("turn")).otherwise(F.col("result_turn")).alias("turn"),
        "seq",
        "name",
        F.when(~is_call, F.lit("orphan")).when(F.col("result").isNull(), F.lit("unanswered")).otherwise(F.lit("linked")).alias("status"),
        errors.alias("errors"),
        "payload",
        "result",
    )
    twice = found.filter("copy > 1").select("conv_id", "call_id", "turn", F.lit(None).cast("long").alias("seq"), "name", F.concat(F.lit("duplicate "), "kind").alias("status"), "errors", F.when(F.col("kind") == "call", F.col("payload")).alias("payload"), F.when(F.col("kind") == "response", F.col("payload")).alias("result"))

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "payload"):
                rows = piece.to_pylist()
                text = []
                for r in rows:
                    # payload and result are canonical already; the keys around them are in order
                    parts = {"arguments": r["payload"], "conversation": canonical(r["conv_id"]), "id": canonical(r["call_id"]), "name": canonical(r["name"]), "order": canonical(r["seq"]), "result": r["result"]}
                    text.append("{" + ",".join(f'"{k}":{v}' for k, v in parts.items() if v is not None) + "}")
                keep = [c for c in piece.schema.names if c not in ("payload", "result")]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array([not r["errors"] and r["status"] == "linked" for r in rows]), pa.array(text, pa.string())], [*keep, "valid", "record"])

    return linked.unionByName(twice).mapInArrow(record, "conv_id long, call_id string, turn long, seq long, name string, status string, errors array<string>, valid boolean, record string")


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(tool_turns(load(spark, sf_dir, "conversations")))
