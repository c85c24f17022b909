"""Chat formatting: linked, ordered and checked tool calls.

Calls and results are linked by a hash join on (conversation, call id).  The
first call and the first result of an id are linked; repeats, results without
a call and calls without a result are kept and told by their status.

Order: a call comes after the calls it depends on and otherwise keeps its
place.  ``order_major`` is the largest position among a call and all it
depends on, directly or not; ``order_minor`` counts the steps among calls that
had to move behind the same later call.  Sorting a conversation by
(order_major, order_minor, position) is a topological order, and no
conversation has to be gathered to say so: both numbers come from joins of
narrow rows.  Chains are followed by pointer doubling, so a chain of n calls
issued too early takes about log n rounds; beyond that, rounds follow the
layers of calls that wait for several others.  Calls on a cycle, or that had
to move behind one, are told as ``cyclic``; ids that no call has are ignored
in the order.

Arguments are parsed and checked against the tool's schema (types, required,
bounds, lengths, choices, unknown names); each item becomes one canonical JSON
text: sorted keys, no spaces, literal non-ASCII characters.

Defined results: null ids never link; null arguments count as an empty object;
a tool without a schema is an error of the call; texts of any length are kept
whole; ties in position go by call id, then content; empty tables give an
empty result.  No argument makes a call fail: what is not JSON, repeats a name
in an object, holds a number out of range (``1e400``) or half a surrogate pair
is an error of the call, whose arguments are then given as their own text; a
bound that does not apply to a value's kind (a minimum of a text) is an error
too.  Turns that are neither call nor result (``others``) give a row of status
``other_turn``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

# A tool's schema: {"properties": {name: rule}, "required": [...], "additional": bool}
# rule: type (string, integer, number, boolean, array, object, null), minimum,
# maximum, min_length, max_length, choices.
Schemas = Mapping[str, Mapping]

_TYPES: dict[str, Callable] = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


_RULES = {"type", "minimum", "maximum", "min_length", "max_length", "choices"}


def check_schemas(schemas: Schemas) -> None:
    """Schemas are the caller's: an unknown rule or type raises at once."""
    for tool, schema in schemas.items():
        for name, rule in schema.get("properties", {}).items():
            if set(rule) - _RULES or rule.get("type", "null") not in _TYPES:
                raise ValueError(f"{tool}.{name}: unknown rule in {dict(rule)}")


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _measure(kind: str, value) -> tuple[object, str]:
    """What a bound is held against, and what to call a value without it."""
    if kind in ("minimum", "maximum"):
        return (value if _TYPES["number"](value) else None), "not a number"
    return (len(value) if isinstance(value, (str, list, dict)) else None), "without a length"


def violations(value: Mapping, schema: Mapping) -> list[str]:
    """What is wrong with an arguments object, in a fixed order."""
    rules = schema.get("properties", {})
    out = [f"{n}: missing" for n in sorted(schema.get("required", ())) if n not in value]
    for name in sorted(value):
        v, rule = value[name], rules.get(name)
        if rule is None:
            if not schema.get("additional", False):
                out.append(f"{name}: unknown")
            continue
        if "type" in rule and not _TYPES[rule["type"]](v):
            out.append(f"{name}: not {rule['type']}")
            continue
        bounds = (
            ("minimum", lambda v, x: v >= x, "too small"),
            ("maximum", lambda v, x: v <= x, "too large"),
            ("min_length", lambda v, x: v >= x, "too short"),
            ("max_length", lambda v, x: v <= x, "too long"),
        )
        for kind, ok, words in bounds:
            if kind in rule:
                measure, lacking = _measure(kind, v)
                if measure is None:
                    out.append(f"{name}: {lacking}")
                elif not ok(measure, rule[kind]):
                    out.append(f"{name}: {words}")
        # true and 1 are equal to Python, not to JSON
        if "choices" in rule and not any(v == x and isinstance(v, bool) == isinstance(x, bool) for x in rule["choices"]):
            out.append(f"{name}: not a choice")
    return out


class _Refused(Exception):
    """Why arguments are not taken."""


def _number(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise _Refused("number out of range")
    return value


def _object(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Refused("repeated name")
    return out


def _no_constant(token: str):
    raise ValueError(token)


def parse(arguments: str | None) -> tuple[object, list[str]]:
    """(value, errors); arguments that are refused stay text."""
    if arguments is None:
        return {}, []
    try:
        value = json.loads(arguments, parse_constant=_no_constant, parse_float=_number, object_pairs_hook=_object)
        canonical(value).encode()
    except _Refused as exc:
        return arguments, [f"arguments: {exc}"]
    except UnicodeEncodeError:
        return arguments, ["arguments: not Unicode"]
    except (ValueError, RecursionError):
        return arguments, ["arguments: not JSON"]
    return (value, []) if isinstance(value, dict) else (value, ["arguments: not an object"])


def message(schemas: Schemas, call_id, name, arguments, depends_on, status: str, content) -> tuple[list[str], str]:
    """(errors, canonical JSON) of one item."""
    if status == "other_turn":  # its role stands in the place of a name
        return [], canonical({"content": content, "id": call_id, "role": name, "status": status})
    if name is None and status in ("orphan_result", "duplicate_result"):
        return [], canonical({"content": content, "id": call_id, "role": "tool", "status": status})
    value, errors = parse(arguments)
    if not errors:
        errors = violations(value, schemas[name]) if name in schemas else ["name: no schema"]
    body = {
        "arguments": value,
        "content": content,
        "depends_on": sorted(depends_on) if depends_on is not None else [],
        "errors": errors,
        "id": call_id,
        "name": name,
        "role": "call",
        "status": status,
    }
    return errors, canonical(body)


def _rounds(n: int) -> int:
    """Doublings after which pointers over ``n`` steps have reached their end."""
    return max(1, n).bit_length() + 1


def _majors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``v, at, major``: the largest position among a call and all it depends
    on.  Each keeps a pointer to the ancestor that has it, so a round follows
    the dependencies by one step and the pointers by as many as are known."""
    state = written(nodes.select("v", "at", F.col("at").alias("major"), F.col("v").alias("far")), "call-major")
    while True:
        known = state.select(F.col("v").alias("u"), F.struct("major", "far").alias("theirs"))
        by_edge = edges.join(known, "u").select("v", "theirs")
        by_pointer = state.filter("far != v").select("v", F.col("far").alias("u")).join(known, "u").select("v", "theirs")
        best = by_edge.unionByName(by_pointer).groupBy("v").agg(F.max("theirs").alias("best"))
        higher = F.col("best.major") > F.col("major")
        new = state.join(best, "v", "left").select(
            "v",
            "at",
            F.when(higher, F.col("best.major")).otherwise(F.col("major")).alias("major"),
            F.when(higher, F.col("best.far")).otherwise(F.col("far")).alias("far"),
            F.coalesce(higher, F.lit(False)).alias("moved"),
        )
        new = written(new, "call-major")
        state = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return state.select("v", "at", "major")


def _chains(inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls that wait for one other only, with the end of their chain (the
    first that waits for none or for several) and the steps to it: ``v, t, d``;
    and the edges of the others.  The end is null on and behind a cycle."""
    waits = inner.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("u"))
    single = written(waits.filter("n = 1").select("v", F.col("u").alias("t"), F.lit(1).cast("long").alias("d")), "call-chains")
    several = inner.join(waits.filter("n > 1").select("v"), "v", "left_semi")
    ends, chain = single.select(F.col("v").alias("t")), single
    for _ in range(_rounds(single.count())):
        on = chain.select(F.col("v").alias("t"), F.col("t").alias("t2"), F.col("d").alias("d2"))
        chain = written(
            chain.join(on, "t", "left").select(
                "v", F.coalesce("t2", "t").alias("t"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")
            ),
            "call-chains",
        )
        if not chain.join(ends, "t", "left_semi").limit(1).count():
            break
    open_ = ends.withColumn("open", F.lit(True))
    return chain.join(open_, "t", "left").select("v", F.when(F.col("open").isNull(), F.col("t")).alias("t"), "d"), several


def _minors(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    """``v, minor``: steps of a call among those behind the same later one;
    no row on and behind a cycle."""
    chain, several = _chains(inner)
    chain = written(chain, "call-chain-ends")
    free = nodes.select("v").join(inner.select("v").distinct(), "v", "left_anti")
    # what calls with several dependencies wait for: ends of chains, some steps away
    to = several.join(chain.select(F.col("v").alias("u"), "t", "d", F.lit(True).alias("chained")), "u", "left").select(
        "v", F.when(F.col("chained"), F.col("t")).otherwise(F.col("u")).alias("t"), F.coalesce("d", F.lit(0)).alias("d")
    )
    first = free.select(F.col("v").alias("t"), F.lit(0).cast("long").alias("base"))
    waiting = written(to.join(first, "t", "left").select("v", "t", "d", "base"), "call-waiting")
    done = []
    while True:
        ready = (
            waiting.groupBy("v")
            .agg(F.count("*").alias("n"), F.count("base").alias("have"), F.max(F.col("base") + F.col("d")).alias("top"))
            .filter("n = have")
            .select("v", (F.col("top") + 1).alias("minor"))
        )
        ready = written(ready, "call-ready")
        if not ready.limit(1).count():
            break
        done.append(ready)
        more = ready.select(F.col("v").alias("t"), F.col("minor").alias("more"))
        left = waiting.join(ready.select("v"), "v", "left_anti").join(more, "t", "left")
        waiting = written(left.select("v", "t", "d", F.coalesce("base", "more").alias("base")), "call-waiting")
    settled = reduce(DataFrame.unionByName, done, free.select("v", F.lit(0).cast("long").alias("minor")))
    ends = settled.select(F.col("v").alias("t"), F.col("minor").alias("base"))
    return settled.unionByName(chain.join(ends, "t").select("v", (F.col("base") + F.col("d")).alias("minor")))


def _order(calls: DataFrame) -> DataFrame:
    """``row, order_major, order_minor, cyclic`` for linkable calls (unique by
    group and id) with ``row, position, depends_on``."""
    nodes = written(calls.select(F.col("row").alias("v"), F.col("position").alias("at")), "call-nodes")
    there = calls.select(F.col("grp").alias("g"), F.col("call_id").alias("dep"), F.col("row").alias("u"))
    wanted = calls.select("grp", F.col("row").alias("v"), F.explode(F.array_distinct("depends_on")).alias("dep")).filter("dep is not null")
    edges = written(
        wanted.join(there, wanted["grp"].eqNullSafe(there["g"]) & (wanted["dep"] == there["dep"])).select("v", "u"), "call-edges"
    )
    major = written(_majors(nodes, edges), "call-majors")
    # a call that moved, behind the same later call as what it depends on
    mine = major.select("v", "major", "at")
    theirs = major.select(F.col("v").alias("u"), F.col("major").alias("their_major"))
    inner = written(edges.join(theirs, "u").join(mine, "v").filter("their_major = major").select("v", "u", "at", "major"), "call-inner")
    # a call that is the latest of its own ancestors is on a cycle
    looped = inner.filter("at = major").select("v").distinct().withColumn("looped", F.lit(True))
    minor = _minors(nodes, inner.select("v", "u"))
    return major.join(looped, "v", "left").join(minor, "v", "left").select(
        F.col("v").alias("row"),
        F.col("major").alias("order_major"),
        F.coalesce("minor", F.lit(0)).alias("order_minor"),
        (F.coalesce("looped", F.lit(False)) | F.col("minor").isNull()).alias("cyclic"),
    )


def _first(rows: DataFrame, payload: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows split into the first of each (grp, call_id), by position and
    content, and all others."""
    linkable = rows.filter("call_id is not null")
    low = linkable.groupBy("grp", "call_id").agg(F.min(F.struct("position", *payload, "row")).alias("low"))
    first = low.select("grp", "call_id", "low.*")
    others = rows.join(first.select("row"), "row", "left_anti")
    return first, others


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas, others: DataFrame | None = None) -> DataFrame:
    """Linked calls and leftover results.

    ``calls(grp, call_id, position, name, arguments, depends_on)``,
    ``results(grp, call_id, position, content)``, ``others(grp, call_id,
    position, role, content)``.  Returns ``grp, call_id,
    name, position, order_major, order_minor, status, n_errors, errors, json``;
    status is ``answered``, ``early_result`` (its result stands before it),
    ``unanswered``, ``cyclic``, ``duplicate_call``, ``orphan_result``,
    ``duplicate_result`` or ``other_turn`` (``name`` is then the role).
    """
    check_schemas(schemas)
    c = written(
        calls.select("grp", "call_id", "position", "name", "arguments", "depends_on").withColumn("row", F.monotonically_increasing_id()),
        "calls",
    )
    r = written(results.select("grp", "call_id", "position", "content").withColumn("row", F.monotonically_increasing_id()), "results")
    first_c, other_c = _first(c, ("name", "arguments", "depends_on"))
    first_r, other_r = _first(r, ("content",))
    first_c = written(first_c, "calls-first")
    order = _order(first_c)
    res = first_r.select(F.col("grp").alias("g"), F.col("call_id").alias("i"), F.col("position").alias("answer_at"), "content")
    joined = first_c.join(res, first_c["grp"].eqNullSafe(res["g"]) & (first_c["call_id"] == res["i"]), "left").drop("g", "i")
    linked = joined.join(order, "row", "left")
    status = (
        F.when(F.col("cyclic"), F.lit("cyclic"))
        .when(F.col("answer_at").isNull() & F.col("content").isNull(), F.lit("unanswered"))
        .when(F.col("answer_at") < F.col("position"), F.lit("early_result"))
        .otherwise(F.lit("answered"))
    )
    shape = ["grp", "call_id", "name", "position", "order_major", "order_minor", "status", "arguments", "depends_on", "content"]
    none = F.lit(None).cast("string")
    main = linked.withColumn("status", status).select(*shape)
    repeated = other_c.select(
        "grp", "call_id", "name", "position", F.col("position").alias("order_major"), F.lit(0).cast("long").alias("order_minor"),
        F.when(F.col("call_id").isNull(), F.lit("unanswered")).otherwise(F.lit("duplicate_call")).alias("status"),
        "arguments", "depends_on", none.alias("content"),
    )

    def leftover(rows: DataFrame, word: str, name: Column = none) -> DataFrame:
        return rows.select(
            "grp", "call_id", name.alias("name"), "position", F.col("position").alias("order_major"),
            F.lit(0).cast("long").alias("order_minor"), F.lit(word).alias("status"), none.alias("arguments"),
            F.lit(None).cast("array<string>").alias("depends_on"), "content",
        )

    ids = first_c.select(F.col("grp").alias("g"), F.col("call_id").alias("i"))
    orphan = first_r.join(ids, first_r["grp"].eqNullSafe(ids["g"]) & (first_r["call_id"] == ids["i"]), "left_anti")
    null_ids = other_r.filter("call_id is null")
    repeats = other_r.filter("call_id is not null")
    parts = [main, repeated, leftover(orphan, "orphan_result"), leftover(null_ids, "orphan_result"), leftover(repeats, "duplicate_result")]
    if others is not None:
        parts.append(leftover(others, "other_turn", F.col("role")))
    items = reduce(DataFrame.unionByName, parts)
    known = {k: dict(v) for k, v in schemas.items()}
    out = T.StructType([items.schema[k] for k in shape[:7]]).add("n_errors", "long").add("errors", "string").add("json", "string")

    def run(batches):
        for p in batches:
            made = [
                message(known, *[_plain(v) for v in x])
                for x in zip(p["call_id"], p["name"], p["arguments"], p["depends_on"], p["status"], p["content"], strict=True)
            ]
            q = p[shape[:7]].copy()
            q["n_errors"] = pd.Series([len(e) for e, _ in made], dtype="int64", index=q.index)
            q["errors"] = pd.Series(["; ".join(e) for e, _ in made], dtype=object, index=q.index)
            q["json"] = pd.Series([j for _, j in made], dtype=object, index=q.index)
            yield q

    return items.select(*shape).mapInPandas(run, out)


def _plain(v):
    if isinstance(v, np.ndarray):
        return [x for x in v.tolist() if x is not None]
    return None if v is None or (isinstance(v, float) and v != v) else v


# Binding: every user turn calls ``reply``, answered by the turn after it; a
# system turn calls ``configure``, which the conversation's calls depend on.
TURN_SCHEMAS = {
    "reply": {
        "properties": {
            "question": {"type": "string", "min_length": 1, "max_length": 300},
            "words": {"type": "integer", "minimum": 1, "maximum": 60},
        },
        "required": ["question", "words"],
    },
    "configure": {"properties": {"text": {"type": "string", "min_length": 1, "max_length": 250}}, "required": ["text"]},
}


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of ``conversations(conv_id, turn, role, text)``."""
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))

    def ident(step: int):
        return F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + step).cast("string"))

    user = t.filter("role = 'user'")
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("long")
    calls = user.select(
        F.col("conv_id").alias("grp"),
        ident(0).alias("call_id"),
        F.col("turn").alias("position"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("question"), words.alias("words"))).alias("arguments"),
        F.when(F.col("turn") >= 1, F.filter(F.array(ident(-2), ident(-1)), lambda x: ~F.contains(x, F.lit(":-")))).otherwise(
            F.array().cast("array<string>")
        ).alias("depends_on"),
    )
    system = t.filter("role = 'system'").select(
        F.col("conv_id").alias("grp"),
        ident(0).alias("call_id"),
        F.col("turn").alias("position"),
        F.lit("configure").alias("name"),
        F.to_json(F.struct("text")).alias("arguments"),
        F.array().cast("array<string>").alias("depends_on"),
    )
    results = t.filter("role = 'assistant'").select(
        F.col("conv_id").alias("grp"), ident(-1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content")
    )
    return calls.unionByName(system), results


def other_turns(turns: DataFrame) -> DataFrame:
    """The turns of other roles, or none: neither call nor result."""
    known = F.coalesce(F.col("role").isin("user", "system", "assistant"), F.lit(False))
    turn = F.col("turn").cast("long")
    return turns.filter(~known).select(
        F.col("conv_id").alias("grp"),
        F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")).alias("call_id"),
        turn.alias("position"),
        "role",
        F.coalesce("text", F.lit("")).alias("content"),
    )
