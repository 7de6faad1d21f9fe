"""Tool-call linking: join calls with their results, order them, check arguments, write canonical JSON.

Calls and results meet by a hash join on (conversation, identifier).  A call may name others whose results it
needs.  Chains of calls that need one other each are shortened by doubling, and what is left is peeled in
rounds, one for each level of calls with several needs; what is on a cycle remains.  Positions come from one
range sort of all rows and each conversation's start in it, so a conversation that holds a third of all turns
is spread over many tasks.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicell.functions.rank import distributed_rank
from lumicell.llm.shared import cut, in_small_batches, map_batches

#: Arguments nested deeper than this are a problem, not a value.
MOST_NESTING = 128
#: Conversations with more than one in so many rows are met by broadcast (there are fewer than that of them).
HOT_PART = 1024
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
#: Strings, also one that is never closed, which takes the rest of the text; brackets.
_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[\[{]|[\]}]', re.S)
_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; whole floats below 2^53 are written as integers, lone surrogates as escapes."""

    def plain(x):
        if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 1 << 53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    if kind == "integer" and isinstance(value, float):
        return value == int(value)  # 1.0 is written as 1
    return isinstance(value, _TYPES[kind])


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema`` (type or list of types, enum, minimum, maximum, minLength, required, properties, additionalProperties, items).

    A bound says nothing about values of a kind that it does not measure; types that JSON has not are an error of the schema.
    """
    found = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else list(kinds or ())
    if unknown := [k for k in kinds if k not in _TYPES]:
        raise ValueError(f"the schema at {at} has unknown types: {unknown}")
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        found.append(f"{at}: not among the allowed values")
    if number and "minimum" in schema and value < schema["minimum"]:
        found.append(f"{at}: below the minimum")
    if number and "maximum" in schema and value > schema["maximum"]:
        found.append(f"{at}: above the maximum")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        found.append(f"{at}: too short")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        found += [p for i, v in enumerate(value) for p in problems(v, schema["items"], f"{at}[{i}]")]
    return [_SURROGATE.sub("\ufffd", p) for p in found]


def nesting(text: str) -> int:
    """How deep the brackets outside strings go."""
    deep = most = 0
    for m in _BRACKETS.finditer(text):
        if m.group() in ("[", "{"):
            deep += 1
            most = max(most, deep)
        elif m.group() in ("]", "}"):
            deep -= 1
    return most


def parsed(text: str | None):
    """The value of a JSON text; ValueError where it is none (not finite numbers are none)."""

    def finite(number: str) -> float:
        value = float(number)
        if not math.isfinite(value):
            raise ValueError("not a finite number")
        return value

    if nesting(text or "") > MOST_NESTING:
        raise ValueError("nested too deeply")
    return json.loads(text or "", parse_float=finite, parse_constant=finite)


def check_call(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[list[str], object, bool]:
    """``(problems, parsed arguments, whether they could be parsed)`` of one call."""
    try:
        value = parsed(arguments)
    except ValueError:
        return ["$: not JSON"], None, False
    return (problems(value, schemas[name]) if name in schemas else ["unknown tool"]), value, True


def _jumped(single: DataFrame) -> DataFrame:
    """Rows ``(conv_id, call_id, to, steps, ends)``: where chains of calls with one need each lead.

    Each round doubles the steps.  A chain that has not ended when it is longer than there are calls runs into a cycle.
    """
    rows = cut(single.withColumn("steps", F.lit(1).cast("long")).withColumn("ends", F.lit(False)))
    n, reach = rows.count(), 1
    while True:
        ahead = rows.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"), F.col("to").alias("far"), F.col("steps").alias("more"), F.col("ends").alias("end"))
        met = rows.filter("not ends").join(ahead, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("n")), "left")
        moved = met.select("conv_id", "call_id", F.coalesce("far", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("n").isNull() | F.coalesce("end", F.lit(False))).alias("ends"))
        rows = cut(rows.filter("ends").unionByName(moved))
        reach *= 2
        if reach > n or rows.filter("not ends").isEmpty():
            return rows


def depths(calls: DataFrame) -> DataFrame:
    """Rows ``(conv_id, call_id, depth)``: the longest chain of needs below each distinct call; null on or above a cycle.

    Needs that no call of the conversation answers are ignored here.
    """
    every = cut(calls.select("conv_id", "call_id").distinct())
    needs = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    known = every.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"))
    edges = cut(needs.join(known, (needs.conv_id == known.c) & (needs.need == known.n), "left_semi"))
    many = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("needed"), F.first("need").alias("to"))
    many = cut(many)
    chains = _jumped(many.filter("needed = 1").select("conv_id", "call_id", "to"))
    passed = chains.filter("ends").select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"), F.col("to").alias("far"), "steps")
    # calls with several needs, whose needs lead through chains to calls with none or several; what leads to a cycle waits for ever
    several = edges.join(many.filter("needed > 1").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
    pending = several.join(passed, (several.conv_id == passed.c) & (several.need == passed.n), "left")
    pending = cut(pending.select("conv_id", "call_id", "need", F.coalesce("far", "need").alias("to"), F.coalesce("steps", F.lit(0)).alias("steps"), F.lit(None).cast("long").alias("below")))
    placed = [cut(every.join(many.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(0).cast("long")))]
    while not pending.isEmpty() and not placed[-1].isEmpty():
        new = placed[-1].select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"), F.col("depth").alias("now"))
        met = pending.join(new, (pending.conv_id == new.c) & (pending["to"] == new.n), "left")
        pending = cut(met.select("conv_id", "call_id", "need", "to", "steps", F.coalesce("below", F.col("now") + F.col("steps")).alias("below")))
        ready = pending.groupBy("conv_id", "call_id").agg(F.count("*").alias("all"), F.count("below").alias("done"), F.max("below").alias("most"))
        placed.append(cut(ready.filter(F.col("all") == F.col("done")).select("conv_id", "call_id", (F.col("most") + 1).alias("depth"))))
        pending = pending.join(placed[-1].select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    ends = placed[0]
    for more in placed[1:]:
        ends = ends.unionByName(more)
    base = ends.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"), F.col("depth").alias("base"))
    above = chains.filter("ends").join(base, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("n"))).select("conv_id", "call_id", (F.col("base") + F.col("steps")).alias("depth"))
    return every.join(ends.unionByName(above), ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("depth").cast("int").alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Link ``calls(conv_id, call_id, turn, name, arguments, needs)`` with ``results(conv_id, call_id, turn, content)``.

    One row for each call and for each result without a call:
    ``conv_id, call_id, turn, status, valid, problems, depth, position, canonical``.

    ``status``: ``linked``; ``pending`` (no result); ``duplicate`` (a later call with an identifier already used, never
    linked); ``early`` (the result stands before its call); ``orphan`` (a result without a call); ``cycle``.  Of several
    results the first by turn counts, and a problem names how many there were.  ``position`` orders a conversation's rows from 0
    by depth (a cycle's and orphans last), turn, identifier and status; equal rows are interchangeable.  Rows without a
    conversation or identifier link with nothing, those without a conversation have no position; a null ``needs`` is empty; null
    or broken arguments (deeper than ``MOST_NESTING``, or with numbers that are not finite) are a problem and stay in ``canonical`` as
    they are, under ``raw``; empty tables give no rows; other columns are ignored.
    """
    in_small_batches(calls.sparkSession)
    calls = calls.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), "name", "arguments", F.coalesce("needs", F.expr("cast(array() as array<string>)")).alias("needs"))
    calls = cut(calls.withColumn("row", F.xxhash64("name", "arguments")))
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "row")).alias("first"))
    answers = results.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), "content")
    answers = answers.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("answers"))
    answers = answers.withColumn("has_answer", F.lit(True))
    chosen = calls.join(first, ["conv_id", "call_id"], "left").withColumn("used", (F.col("turn") > F.col("first.turn")) | ((F.col("turn") == F.col("first.turn")) & (F.col("row") != F.col("first.row"))))
    needed = depths(calls.filter("conv_id is not null and call_id is not null"))
    met = chosen.join(needed, ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "full")
    status = (
        F.when(F.col("row").isNull(), "orphan")
        .when(F.coalesce("used", F.lit(False)), "duplicate")
        .when(F.col("depth").isNull() & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull(), "cycle")
        .when(F.col("has_answer").isNull(), "pending")
        .when(F.col("answer.turn") < F.col("turn"), "early")
        .otherwise("linked")
    )
    rows = met.select(
        "conv_id", "call_id", F.coalesce("turn", "answer.turn").alias("turn"), status.alias("status"), "depth", "name", "arguments",
        F.col("answer.content").alias("content"), F.coalesce("answers", F.lit(0)).alias("answers"), "needs",
    )

    def write(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in batch.to_pylist():
            linked = r["status"] in ("linked", "early")
            if r["status"] == "orphan":
                found, body = ["result without a call"], {"id": r["call_id"], "result": r["content"]}
            else:
                found, value, whole = check_call(r["name"], r["arguments"], schemas)
                body = {"id": r["call_id"], "name": r["name"], "arguments": value, "needs": sorted({n for n in r["needs"] or () if n is not None})}
                body |= {} if whole else {"raw": r["arguments"]}
                body |= {"result": r["content"]} if linked else {}
            found += [f"{r['answers']} results"] * (linked and r["answers"] > 1)
            out.append((r["conv_id"], r["call_id"], r["turn"], r["status"], not found, found, r["depth"], canonical(body)))
        fields = list(zip(*out))
        kinds = [batch.schema.field("conv_id").type, pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.int32(), pa.string()]
        names = ["conv_id", "call_id", "turn", "status", "valid", "problems", "depth", "canonical"]
        return pa.RecordBatch.from_arrays([pa.array(f, k) for f, k in zip(fields, kinds)], names=names)

    conv = dict(rows.dtypes)["conv_id"]
    written = cut(map_batches(rows, write, f"conv_id {conv}, call_id string, turn long, status string, valid boolean, problems array<string>, depth int, canonical string"))

    late = F.coalesce(F.col("depth"), F.lit((1 << 31) - 1))
    columns = ["conv_id", "call_id", "turn", "status", "valid", "problems", "depth", "position", "canonical"]
    ranked = distributed_rank(written.filter("conv_id is not null").withColumn("layer", late).withColumn("tie", F.xxhash64("canonical", "problems")), ["conv_id", "layer", "turn", "call_id", "status", "tie"], "place")
    starts = ranked.groupBy(F.col("conv_id").alias("of")).agg(F.min("place").alias("start"), F.count("*").alias("n"))
    starts = cut(starts)
    most = starts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(starts.filter(F.col("n") * HOT_PART > most).select("of", "start"))  # fewer than HOT_PART rows
    rest = starts.filter(F.col("n") * HOT_PART <= most).select("of", "start")
    own = ranked.join(hot, ranked.conv_id == hot.of, "left").drop("of")
    placed = own.filter("start is not null").unionByName(own.filter("start is null").drop("start").join(rest, F.col("conv_id") == F.col("of")).drop("of"))
    nowhere = written.filter("conv_id is null").withColumn("position", F.lit(None).cast("long")).select(columns)
    return placed.withColumn("position", F.col("place") - F.col("start")).select(columns).unionByName(nowhere)


#: Tools that the conversations of the test tables are taken to call.
SCHEMAS = {
    "search": {
        "type": "object",
        "required": ["query", "limit"],
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}},
        "additionalProperties": False,
    },
    "measure": {
        "type": "object",
        "required": ["value", "unit"],
        "properties": {"value": {"type": "number"}, "unit": {"enum": ["words", "characters"]}},
    },
    "note": {
        "type": "object",
        "required": ["tags"],
        "properties": {"tags": {"type": "array", "items": {"type": "string"}}, "pinned": {"type": "boolean"}},
    },
}


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read into plain conversations: an assistant's turn calls a tool with its whole text, the user's turn after it answers.

    The tool follows from the turn; some arguments break their schema.  Three calls of every four need the one two turns before;
    a call without a user's turn after it is pending, a user's turn without a call before it answers nothing.  Null texts are empty;
    rows without a role, and system turns, call and answer nothing; repeated rows call again.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    size = F.length("text")
    search = F.to_json(F.struct(F.col("text").alias("query"), (size % 60).alias("limit")))
    measure = F.to_json(F.struct(F.when(size % 5 == 0, "lines").otherwise("words").alias("unit"), size.cast("double").alias("value"), F.col("text").alias("of")))
    note = F.concat(F.to_json(F.struct(F.split("text", "[.\n] *").alias("tags"), F.lit(True).alias("pinned"))), F.when(size % 13 == 0, ",").otherwise(""))
    tool = F.pmod(F.col("turn") + F.col("conv_id"), F.lit(3))
    calls = rows.filter("role = 'assistant'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn",
        F.when(tool == 0, "search").when(tool == 1, "measure").otherwise("note").alias("name"),
        F.when(tool == 0, search).when(tool == 1, measure).otherwise(note).alias("arguments"),
        F.when((F.col("turn") >= 2) & (F.floor(F.col("turn") / 2) % 4 != 0), F.array(name(F.col("turn") - 2))).otherwise(F.expr("cast(array() as array<string>)")).alias("needs"),
    )
    results = rows.filter("role = 'user' and turn > 0").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
