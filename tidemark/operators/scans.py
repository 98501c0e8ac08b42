"""Scans of long series in time slices: a slice is summed up in one row, states pass from slice to slice, each slice then works alone.

A series is cut into slices of time, so one series fills many tasks. Within a slice windows do the work. What a slice has to
know of the rows before it (moments, a run's start, a last value) comes from a fold over one row a slice and series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE_US = 86_400_000_000


def sliced(df: DataFrame, us: str, slice_us: int = SLICE_US) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(us) / slice_us))


ARROW = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string()}


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of equal keys together in one task, in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def entering(rows: DataFrame, by: list[str], summary: dict[str, Column], fold: Callable[[dict | None, dict], dict], kept: dict[str, str]) -> DataFrame:
    """Rows with the columns ``kept`` (name to type): what the slices before a row's slice left behind, null in a series' first.

    ``summary`` are aggregates of a slice, ``fold`` takes what was left and a slice's summary as dictionaries and returns
    what is left then. Summaries, one row a slice, pass through a task in order, those of one series after another.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    keys = [f"_key{i}" for i in range(len(by))]
    sums = rows.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col("_slice").alias("_at")).agg(*[c.alias(n) for n, c in summary.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, left = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (now := tuple(row[k] for k in keys)) != series:
                    series, left = now, None
                out.append(left or {})
                left = fold(left, row)
            held = [pa.array([o.get(n) for o in out], ARROW[t]) for n, t in kept.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "_at")), *held], [*keys, "_at", *kept])

    schema = ", ".join([*(f"`{k}` {types[b]}" for b, k in zip(by, keys, strict=True)), "`_at` long", *(f"`{n}` {t}" for n, t in kept.items())])
    states = in_order(sums, keys, ["_at"]).mapInArrow(run, schema)
    same = F.col("_slice").eqNullSafe(F.col("_at"))
    for b, k in zip(by, keys, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(k))
    return rows.join(states, same).drop("_at", *keys)


def passing(df: DataFrame, by: list[str], order: list[str], step: Callable[[dict | None, dict], tuple[dict, bool]], columns: list[str]) -> DataFrame:
    """The rows that ``step`` lets pass: it takes what a key's rows before left and a row's ``columns``, and returns what is left and its choice.

    Rows of a key pass through a task in order, key after key; nothing but what is left is kept of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left = None, None
        for batch in batches:
            chosen = []
            for row in batch.select([*by, *columns]).to_pylist():
                if (now := tuple(row[k] for k in by)) != key:
                    key, left = now, None
                left, choice = step(left, row)
                chosen.append(choice)
            yield batch.filter(pa.array(chosen, pa.bool_()))

    return in_order(df, by, order).mapInArrow(run, df.schema)


def window(by: list[str], order: list[str]):
    return W.partitionBy(*by, "_slice").orderBy(*order)


def merged(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """Number, mean and squared deviations of two sets of values together."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


def moments_before(df: DataFrame, by: list[str], order: list[str], value: str, slice_us: int = SLICE_US) -> DataFrame:
    """Adds ``_n, _mean, _m2``: number, mean and sum of squared deviations of all the series' values before a row."""
    rows = sliced(df, order[0], slice_us)
    x = F.col(value).cast("double")
    summary = {"n": F.count(x), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x)}

    def fold(left: dict | None, row: dict) -> dict:
        before = (left["c_n"], left["c_mean"], left["c_m2"]) if left else (0, 0.0, 0.0)
        return dict(zip(("c_n", "c_mean", "c_m2"), merged(before, (row["n"], row["mean"] or 0.0, row["m2"] or 0.0)), strict=True))

    rows = entering(rows, by, summary, fold, {"c_n": "long", "c_mean": "double", "c_m2": "double"})
    w = window(by, order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    rows = rows.withColumns({"i_n": F.count(x).over(w), "i_mean": F.coalesce(F.avg(x).over(w), zero), "i_m2": F.coalesce(F.var_pop(x).over(w) * F.count(x).over(w), zero)})
    rows = rows.withColumns({"c_n": F.coalesce("c_n", F.lit(0)), "c_mean": F.coalesce("c_mean", zero), "c_m2": F.coalesce("c_m2", zero)})
    n, gap = F.col("c_n") + F.col("i_n"), F.when((F.col("c_n") > 0) & (F.col("i_n") > 0), F.col("i_mean") - F.col("c_mean")).otherwise(zero)
    share = F.when(n > 0, F.col("i_n") / F.greatest(n, F.lit(1))).otherwise(zero)
    mean = F.when(F.col("c_n") == 0, F.col("i_mean")).otherwise(F.col("c_mean") + gap * share)
    return rows.withColumns({"_n": n, "_mean": mean, "_m2": F.col("c_m2") + F.col("i_m2") + gap * gap * F.col("c_n") * share}).drop("_slice", "c_n", "c_mean", "c_m2", "i_n", "i_mean", "i_m2")


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], slice_us: int = SLICE_US) -> DataFrame:
    """Adds the sums, under their names, over the rows up to each."""
    rows = sliced(df, order[0], slice_us).withColumns({f"_x_{n}": c.cast("double") for n, c in sums.items()})
    names = list(sums)
    rows = entering(rows, by, {n: F.sum(f"_x_{n}") for n in names}, lambda left, row: {f"_c_{n}": (row[n] or 0.0) + (left[f"_c_{n}"] if left else 0.0) for n in names}, {f"_c_{n}": "double" for n in names})
    w, zero = window(by, order).rowsBetween(W.unboundedPreceding, 0), F.lit(0.0)
    rows = rows.withColumns({n: F.coalesce(f"_c_{n}", zero) + F.coalesce(F.sum(f"_x_{n}").over(w), zero) for n in sums})
    return rows.drop("_slice", *[f"{p}{n}" for n in sums for p in ("_x_", "_c_")])


def runs(df: DataFrame, by: list[str], order: list[str], on: Column, hold_us: int, slice_us: int = SLICE_US) -> DataFrame:
    """Adds ``_on``, ``_fires`` and ``_was``: whether a row's condition holds, whether its run has then held ``hold_us`` since its
    first row (never on that row), and whether the run before its own came to that."""
    rows = sliced(df, order[0], slice_us).withColumn("_on", F.coalesce(on, F.lit(False)))
    w, us = window(by, order), F.col(order[0])
    rows = rows.withColumn("_new", F.coalesce(F.lag("_on").over(w) != F.col("_on"), F.lit(True)).cast("int"))
    rows = rows.withColumns({"_run": F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)), "_runs": F.sum("_new").over(W.partitionBy(*by, "_slice"))})
    inner = W.partitionBy(*by, "_slice", "_run").orderBy(*order)
    rows = rows.withColumns({"_start": F.first(us).over(inner), "_place": F.row_number().over(inner)})
    end = F.struct("_place", "_on", "_start", us.alias("_end"))
    summary = {"runs": F.max("_runs")} | {n: F.max(F.when(F.col("_run") == at, end)) for n, at in (("first", F.lit(1)), ("before", F.col("_runs") - 1), ("last", F.col("_runs")))}

    def fired(run: dict, start: int, more: bool) -> bool:
        return bool(run["_on"]) and (more or run["_place"] > 1) and run["_end"] - start >= hold_us

    def fold(left: dict | None, row: dict) -> dict:
        """The state of the slice's last run: its condition, start, whether it fired, and whether the run before it did."""
        first, last = row["first"], row["last"]
        same = left is not None and left["p_on"] == bool(first["_on"])
        start = left["p_start"] if same else first["_start"]
        first_fired = fired(first, start, same)
        if row["runs"] == 1:
            return {"p_on": bool(first["_on"]), "p_start": start, "p_fired": first_fired, "p_was": left["p_was"] if same else bool(left and left["p_fired"])}
        was = first_fired if row["runs"] == 2 else fired(row["before"], row["before"]["_start"], False)
        return {"p_on": bool(last["_on"]), "p_start": last["_start"], "p_fired": fired(last, last["_start"], False), "p_was": was}

    rows = entering(rows, by, summary, fold, {"p_on": "boolean", "p_start": "long", "p_fired": "boolean", "p_was": "boolean"})
    opening = F.col("_run") == 1
    same = opening & F.coalesce(F.col("p_on") == F.col("_on"), F.lit(False))
    start = F.when(same, F.col("p_start")).otherwise(F.col("_start"))
    rows = rows.withColumn("_fires", F.col("_on") & (same | (F.col("_place") > 1)) & (us - start >= hold_us))
    rows = rows.withColumn("_before", F.lag("_fires").over(w))
    carried = F.when(same, F.col("p_was")).otherwise(F.col("p_fired"))
    was = F.coalesce(F.when(opening, carried).otherwise(F.first("_before").over(inner)), F.lit(False))
    return rows.withColumn("_was", was).drop("_slice", "_new", "_run", "_runs", "_start", "_place", "_before", "p_on", "p_start", "p_fired", "p_was")


def pieces(df: DataFrame, by: list[str], us: str, gap_us: int | str, slice_us: int = SLICE_US) -> DataFrame:
    """Adds ``_piece``: when the row's piece began; a row ``gap_us`` or more (or what a key's column of that name says) after the row before begins one."""
    rows, w, at = sliced(df, us, slice_us), window(by, [us]), F.col(us)
    least = F.col(gap_us) if isinstance(gap_us, str) else F.lit(gap_us)
    rows = rows.withColumn("_gap", at - F.lag(us).over(w))
    summary = {"first": F.min(at), "last": F.max(at), "cut": F.max(F.when(F.col("_gap") >= least, at)), "least": F.max(least)}

    def fold(left: dict | None, row: dict) -> dict:
        piece = row["first"] if left is None or row["first"] - left["p_last"] >= row["least"] else left["p_piece"]
        return {"p_last": row["last"], "p_piece": piece if row["cut"] is None else row["cut"]}

    rows = entering(rows, by, summary, fold, {"p_last": "long", "p_piece": "long"})
    cut = F.coalesce(F.coalesce("_gap", at - F.col("p_last")) >= least, F.lit(True))
    inner = F.last(F.when(cut, at), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_piece", F.coalesce(inner, "p_piece")).drop("_slice", "_gap", "p_last", "p_piece")


def last_known(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, slice_us: int = SLICE_US) -> DataFrame:
    """Adds the newest non-null ``value`` at or before each row."""
    rows = sliced(df, order[0], slice_us).withColumn(name, value)
    newest = {"newest": F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(*order)))}
    kind = dict(rows.dtypes)[name]
    rows = entering(rows, by, newest, lambda left, row: {"_carry": (left or {}).get("_carry") if row["newest"] is None else row["newest"]}, {"_carry": kind})
    inner = F.last(name, ignorenulls=True).over(window(by, order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(inner, "_carry")).drop("_slice", "_carry")


def user_series(df: DataFrame, by: list[str], order: list[str], summary: dict[str, Column], fold: Callable[[dict | None, dict], dict], kept: dict[str, str], function: Callable[[pa.Table], pa.Array], result: str, slice_us: int = SLICE_US) -> DataFrame:
    """A user's function from a series to a series, slice by slice: ``by``, ``order`` and the ``result`` column (``name type``) for each row.

    ``summary``, ``fold`` and ``kept`` say what slices leave behind (:func:`entering`). The function gets one slice's rows in order as an
    Arrow table, with what the slices before left in columns of the kept names, and returns a value for each row.
    """
    name, _, kind = result.partition(" ")
    rows = entering(sliced(df, order[0], slice_us), by, summary, fold, kept)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = [*by, *order]

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in order])
        return part.select(out).append_column(name, function(part))

    return rows.groupBy(*by, "_slice").applyInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in out), f"`{name}` {kind}"]))
