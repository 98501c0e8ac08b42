"""Rules as rows: nested conditions as postfix arrays, evaluated by one fold a row, so that thousands of rules are one plan."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alerts import cooled
from .triggers import EPSILON

TOKEN = "struct<kind: string, parts: int, field: string, op: string, number: double, text: string>"
TEXT_OPS = ("contains", "not_contains", "regex")
JOINS = {"all": "and", "any": "or"}


def compiled(tree: dict) -> list[dict]:
    """A condition ``{"all": [...]}``, ``{"any": [...]}``, ``{"not": ...}`` or ``{"field", "op", "value"}`` in postfix order."""
    empty = {"parts": 0, "field": None, "op": None, "number": None, "text": None}
    for name, kind in JOINS.items():
        if name in tree:
            return [t for part in tree[name] for t in compiled(part)] + [empty | {"kind": kind, "parts": len(tree[name])}]
    if "not" in tree:
        return [*compiled(tree["not"]), empty | {"kind": "not", "parts": 1}]
    textual = tree["op"] in TEXT_OPS
    value = {"text": str(tree["value"])} if textual else {"number": float(tree["value"])}
    return [empty | {"kind": "test", "field": tree["field"], "op": tree["op"]} | value]


def restored(tokens: list[dict]) -> dict:
    """The condition that :func:`compiled` took."""
    stack: list[dict] = []
    for t in tokens:
        if t["kind"] == "test":
            stack.append({"field": t["field"], "op": t["op"], "value": t["text"] if t["op"] in TEXT_OPS else t["number"]})
        elif t["kind"] == "not":
            stack.append({"not": stack.pop()})
        else:
            parts = stack[len(stack) - t["parts"] :]
            stack = [*stack[: len(stack) - t["parts"]], {next(n for n, k in JOINS.items() if k == t["kind"]): parts}]
    return stack.pop()


def _parsed(text: str | None) -> list[dict] | None:
    try:
        return compiled(json.loads(text)) if text is not None else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def loaded(text: Column) -> Column:
    """Conditions from JSON; null where the text is null or no condition."""
    kind = pa.list_(pa.struct({"kind": pa.string(), "parts": pa.int32(), "field": pa.string(), "op": pa.string(), "number": pa.float64(), "text": pa.string()}))

    @F.arrow_udf(f"array<{TOKEN}>")
    def load(texts: pa.Array) -> pa.Array:
        return pa.array(map(_parsed, texts.to_pylist()), kind)

    return load(text)


def saved(tokens: Column) -> Column:
    """Conditions as JSON."""
    @F.arrow_udf("string")
    def save(lists: pa.Array) -> pa.Array:
        return pa.array([None if t is None else json.dumps(restored(t)) for t in lists.to_pylist()], pa.string())

    return save(tokens)


def _test(t: Column, numbers: Column, texts: Column) -> Column:
    x, y, op = F.try_element_at(numbers, t["field"]), t["number"], t["op"]
    text = F.try_element_at(texts, t["field"])
    held = (
        F.when(op == ">", x > y).when(op == "<", x < y).when(op == ">=", x - y >= -EPSILON).when(op == "<=", x - y <= EPSILON).when(op == "==", F.abs(x - y) < EPSILON)
        .when(op == "!=", F.abs(x - y) >= EPSILON).when(op == "contains", F.contains(text, t["text"])).when(op == "not_contains", ~F.contains(text, t["text"])).when(op == "regex", F.rlike(text, t["text"])))
    return F.coalesce(held, F.lit(False))


def holds(tokens: Column, numbers: Column, texts: Column) -> Column:
    """Whether a postfix condition holds for fields given as maps of numbers and of texts; missing fields and unknown operators don't."""
    def step(stack: Column, t: Column) -> Column:
        n, kind = F.size(stack), t["kind"]
        top = F.slice(stack, n - t["parts"] + 1, t["parts"])
        value = F.when(kind == "test", _test(t, numbers, texts)).when(kind == "not", F.exists(top, lambda x: ~x)).when(kind == "and", F.forall(top, lambda x: x)).otherwise(F.exists(top, lambda x: x))
        return F.concat(F.slice(stack, F.lit(1), n - t["parts"]), F.array(value))

    return F.coalesce(F.element_at(F.aggregate(tokens, F.array().cast("array<boolean>"), step), -1), F.lit(False))


def matched(rows: DataFrame, rules: DataFrame, columns: list[str]) -> DataFrame:
    """``rule`` and ``columns`` of each row ``name, numbers, texts`` and rule ``rule, metric, tokens`` of its name that holds.

    Rows and rules meet by an equal name; rules are the smaller side, which Spark broadcasts if it fits.
    """
    both = rows.join(rules.where("tokens IS NOT NULL"), rows["name"] == rules["metric"])
    rest = [c for c in rules.columns if c not in ("rule", "metric", "tokens")]
    return both.where(holds(F.col("tokens"), F.col("numbers"), F.col("texts"))).select("rule", *rest, *columns)


def raised(rows: DataFrame, rules: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`matched` without what comes within a rule's ``cooldown_us`` of the last match that it let through; ``columns`` hold ``us``."""
    return cooled(matched(rows, rules, columns), ["rule"], "cooldown_us")
