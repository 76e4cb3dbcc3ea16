"""Tool calls of conversations: linked to results, ordered, validated, serialised.

* *Linking* is a hash join of calls and results on (conversation, call id), after the
  results of an id were combined to the first one and their number.
* *Order.* A call follows the calls it names in ``after``. ``chain_level`` is the length of
  the longest chain before it, whatever the positions. Where every call of a conversation
  names one known call at most it comes from pointer doubling (rounds of joins: the
  logarithm of the longest chain), elsewhere from rounds that take away calls without open
  predecessors (as many as the longest chain); each round is written to the shared folder.
  ``level`` is the same where some predecessor stands later, and 0 in all other
  conversations, whose positions are a topological order already. Sorting by (level,
  position) or (chain_level, position) gives an order; no conversation is ever brought into
  one task, so one that holds a third of all rows is no special case.
* *Validation* joins each call with its tool's fields and compares names and types.
* *Canonical JSON*: keys sorted, no blanks, whole floats as integers, characters unescaped
  but for lone surrogates, which no UTF-8 text can hold and which stay ``\\udXXX``.

Defined cases: a null id links to nothing; an id used by several calls of a conversation is
reported as ``duplicate id`` and links each; an unknown predecessor is reported and ignored;
a call on or behind a cycle has null levels and ``cycle``; calls of one id share a chain level, and a null id has 0; arguments that are null, no JSON, no object,
nested too deeply for the interpreter's stack, or with a number that is not finite (``NaN``,
``Infinity``, ``1e999``) are ``{}`` with ``bad arguments``; arguments of any length are read whole; a tool without a schema is ``unknown tool``;
repeated rows are calls with a duplicate id; empty tables give empty results. Other columns
do not matter.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import materialize, slices, with_fields

TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


_SURROGATE = re.compile("[\ud800-\udfff]")


def _utf8(text: str) -> str:
    """``text`` with lone surrogates written as escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is no JSON number")
    return value


def canonical(value) -> str:
    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return _utf8(json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def check_arguments(text: str | None, fields: list[dict] | None) -> tuple[dict, list[str]]:
    """The arguments as an object, and what is wrong with them."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_finite) if text is not None else None
        canonical({"arguments": value})  # deeper nesting than the stack holds shows here at the latest
    except (ValueError, RecursionError):
        value = None
    errors = []
    if not isinstance(value, dict):
        value, errors = {}, ["bad arguments"]
    if fields is None:
        return value, [*errors, "unknown tool"]
    known = {f["field"]: f for f in fields}
    errors += [f"missing {n}" for n, f in sorted(known.items()) if f["required"] and n not in value]
    errors += [f"unknown {_utf8(n)}" for n in sorted(value) if n not in known]
    errors += [
        f"type of {n}" for n in sorted(value) if n in known and not TYPES.get(known[n]["type"], lambda v: True)(value[n])
    ]
    return value, errors


def _serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep = ["conv", "pos", "call_id", "n_results", "level", "chain_level"]
    for batch in batches:
        for part in slices(batch, "weight"):
            out, errors = [], []
            for row in part.select(["call_id", "name", "arguments", "content", "n_results", "fields", "problems"]).to_pylist():
                value, wrong = check_arguments(row["arguments"], row["fields"])
                errors.append(row["problems"] + wrong)
                call = {"id": row["call_id"], "name": row["name"], "arguments": value}
                if row["n_results"]:
                    call["result"] = row["content"]
                out.append(canonical(call))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in keep), pa.array(errors, pa.list_(pa.string())), pa.array(out, pa.string())],
                names=[*keep, "errors", "canonical"],
            )


def _peeled(open_calls: DataFrame, open_edges: DataFrame) -> DataFrame:
    """(conv, call_id, chain_level): calls without open predecessors go, round by round; null on or behind a cycle."""
    done, level = open_calls.limit(0).withColumn("chain_level", F.lit(0).cast("bigint")), 0
    while True:
        ready = materialize(open_calls.join(open_edges, ["conv", "call_id"], "left_anti"), "ready")
        if ready.isEmpty():
            return done.union(open_calls.withColumn("chain_level", F.lit(None).cast("bigint")))
        done = done.union(ready.withColumn("chain_level", F.lit(level).cast("bigint")))
        level += 1
        open_calls = materialize(open_calls.join(ready, ["conv", "call_id"], "left_anti"), "open-calls")
        taken = ready.select("conv", F.col("call_id").alias("before_id"))
        open_edges = materialize(open_edges.join(taken, ["conv", "before_id"], "left_anti").select("conv", "call_id", "before_id"), "open-edges")


def _doubled(edges: DataFrame) -> DataFrame:
    """(conv, call_id, chain_level) of calls with one predecessor each, by pointer doubling; null on or behind a cycle.

    A call points ``dist`` steps back to ``at``, a null ``at`` is past the chain's start.
    """
    chain = materialize(edges.select("conv", "call_id", F.col("before_id").alias("at"), F.lit(1).cast("bigint").alias("dist")), "chain")
    for _ in range(chain.count().bit_length() + 1):
        ahead = chain.filter("at IS NOT NULL")
        if ahead.isEmpty():
            break
        target = chain.select("conv", F.col("call_id").alias("at"), F.col("at").alias("then"), F.col("dist").alias("more"))
        moved = ahead.join(target, ["conv", "at"], "left").select(
            "conv", "call_id", F.col("then").alias("at"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist")
        )
        chain = materialize(moved.union(chain.filter("at IS NULL")), "chain")
    return chain.select("conv", "call_id", F.when(F.col("at").isNull(), F.col("dist")).alias("chain_level"))


def chain_levels(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, call_id, chain_level): the longest chain before each call, null on or behind a cycle; calls left out have 0.

    ``ids``: conv, call_id. ``edges``: conv, call_id, before_id, all of known calls.
    """
    edges = materialize(edges.select("conv", "call_id", "before_id").distinct(), "open-edges")
    many = materialize(edges.groupBy("conv", "call_id").count().filter("count > 1").select("conv").distinct(), "many-before")
    if many.isEmpty():
        return _doubled(edges)
    nodes = materialize(ids.join(many, "conv", "left_semi").select("conv", "call_id"), "open-calls")
    return _doubled(edges.join(many, "conv", "left_anti")).union(_peeled(nodes, edges.join(many, "conv", "left_semi")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call: ``conv``, ``pos``, ``call_id``, ``n_results``, ``level``, ``chain_level``, ``errors``, ``canonical``.

    ``calls``: conv, pos, call_id, name, arguments (JSON text), after (array of call ids).
    ``results``: conv, pos, call_id, content. ``schemas``: name, field, type, required.
    """
    calls = materialize(calls.select("conv", "pos", "call_id", "name", "arguments", "after"), "calls")
    ids = calls.filter("call_id IS NOT NULL").groupBy("conv", "call_id").agg(F.count("*").alias("uses"), F.min("pos").alias("first_pos"))
    found = results.filter("call_id IS NOT NULL").groupBy("conv", "call_id").agg(
        F.min(F.struct("pos", "content"))["content"].alias("content"), F.count("*").alias("n_results")
    )
    fields = schemas.groupBy("name").agg(F.collect_list(F.struct("field", "type", "required")).alias("fields"))
    named = calls.select("conv", "call_id", "pos", F.explode("after").alias("before_id"))
    known = ids.select("conv", F.col("call_id").alias("before_id"), F.col("first_pos").alias("before_pos"))
    edges = materialize(named.join(known, ["conv", "before_id"], "left"), "call-edges")
    lost = edges.filter("before_pos IS NULL").select("conv", "call_id").distinct().withColumn("lost", F.lit(True))
    mixed = materialize(edges.filter("before_pos >= pos").select("conv").distinct(), "mixed")
    levels = chain_levels(ids, edges.filter("before_pos IS NOT NULL")).withColumn("placed", F.lit(True))
    in_order = F.lit(True)
    if not mixed.isEmpty():
        levels = levels.join(mixed.withColumn("mixed", F.lit(True)), "conv", "left")
        in_order = F.col("mixed").isNull()
    problem = lambda when, text: F.when(when, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    whole = (
        calls.join(ids, ["conv", "call_id"], "left").join(found, ["conv", "call_id"], "left")
        .join(lost, ["conv", "call_id"], "left").join(levels, ["conv", "call_id"], "left").join(fields, "name", "left")
        .select(
            "conv", "pos", "call_id", "name", "arguments", "content", "fields",
            F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
            F.when(F.col("placed") & ~in_order, F.col("chain_level")).otherwise(F.lit(0)).cast("int").alias("level"),
            F.when(F.col("placed"), F.col("chain_level")).otherwise(F.lit(0)).cast("bigint").alias("chain_level"),
            F.concat(
                problem(F.coalesce(F.col("uses") > 1, F.lit(False)), "duplicate id"),
                problem(F.coalesce("lost", F.lit(False)), "unknown predecessor"),
                problem(F.coalesce(F.col("placed") & F.col("chain_level").isNull(), F.lit(False)), "cycle"),
            ).alias("problems"),
            F.concat_ws("", "arguments", "content").alias("weight"),
        )
    )
    kept = ["conv", "pos", "call_id", "n_results", "level", "chain_level"]
    return whole.mapInArrow(_serialise, with_fields(whole, kept, "errors array<string>, canonical string"))


#: The tool that :func:`turns_as_calls` sees in a conversation.
REPLY = [("reply", "prompt", "string", True), ("reply", "turn", "integer", True)]


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations (conv_id, turn, role, text).

    Each assistant turn is a call of ``reply``: its arguments are the turn before (the
    prompt) and its number, its result is the user turn after it, and it follows the
    assistant turn two before. Neighbours are found by joins on (conversation, turn).
    """
    own = turns.select("conv_id", "turn", "role", "text")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    at = lambda shift, prefix: own.select("conv_id", (F.col("turn") + shift).alias("turn"), *(F.col(c).alias(f"{prefix}_{c}") for c in ("role", "text")))
    before, two_before = at(1, "p"), at(2, "q").filter("q_role = 'assistant'").select("conv_id", "turn", "q_role").distinct()
    said = own.filter("role = 'assistant'")
    calls = (
        said.join(before, ["conv_id", "turn"], "left").join(two_before, ["conv_id", "turn"], "left")
        .select(
            F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"),
            F.to_json(F.struct(F.col("turn"), F.col("p_text").alias("prompt"))).alias("arguments"),
            F.when(F.col("q_role").isNotNull(), F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"),
        )
    )
    results = (
        own.filter("role = 'user'").join(said.select("conv_id", (F.col("turn") + 1).alias("turn")).distinct(), ["conv_id", "turn"], "left_semi")
        .select(F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    )
    return calls, results


#: The registered query in SQL (DuckDB).
ORACLE = """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
calls AS (
  SELECT a.conv_id, a.turn, p.text AS prompt, 'c' || a.conv_id || '-' || a.turn AS call_id,
         n.text AS result, n.conv_id IS NOT NULL AS linked
  FROM t a LEFT JOIN t p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1
           LEFT JOIN t n ON n.conv_id = a.conv_id AND n.turn = a.turn + 1 AND n.role = 'user'
  WHERE a.role = 'assistant')
SELECT conv_id, turn, call_id, (CASE WHEN linked THEN 1 ELSE 0 END)::BIGINT AS n_results, 0::INTEGER AS level,
       prompt IS NOT NULL AS valid,
       sha256('{"arguments":{' || CASE WHEN prompt IS NULL THEN '' ELSE '"prompt":' || to_json(prompt)::VARCHAR || ',' END
              || '"turn":' || turn || '},"id":' || to_json(call_id)::VARCHAR || ',"name":"reply"'
              || CASE WHEN linked THEN ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') ELSE '' END || '}') AS json_sha256
FROM calls"""


#: Chain levels of the registered query in SQL: places in runs of assistant turns two apart.
CHAIN_ORACLE = """
WITH a AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'),
runs AS (
  SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run
  FROM (SELECT DISTINCT conv_id, turn FROM a) d),
placed AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS chain_level FROM runs)
SELECT a.conv_id, a.turn, p.chain_level::BIGINT AS chain_level
FROM a JOIN placed p ON p.conv_id = a.conv_id AND p.turn = a.turn"""
