"""State machines whose next state needs the one before: load levels with hysteresis, degradation, token buckets.

Each is a fold over one key's rows in order; keys are spread by Spark. Load levels take sorted rows batch by batch and carry only the
key's state; the others are pandas folds, so there the rows of one key must fit into a task.
"""

from __future__ import annotations

from bisect import bisect_right
from math import nan

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .triggers import LEVEL_BOUNDS, MEMORY_FLOORS, STRATEGIES

def adaptive_levels(df: DataFrame, by: str, us: str = "us", alpha: float = 0.7, margin: float | None = None, cooldown_us: int = 0, strategy: str = "balanced") -> DataFrame:
    """``key, us, cpu, memory, level, changed`` of each row of ``us, cpu, memory``.

    Use is smoothed only after the first change of level, and then changes keep ``cooldown_us`` between them. With a
    margin, a rise needs a pressure that exceeds the next level's bound by it, a fall one that is below the level's own
    bound by it. The first level is moderate. A key's rows are sorted by Spark, which spills, and never held at once.
    """
    names, bounds, floors, factor = list(LEVEL_BOUNDS), list(LEVEL_BOUNDS.values()), MEMORY_FLOORS, STRATEGIES[strategy]

    def fold(batches):
        last = object()
        for b in batches:
            out = []
            for key, at, c, m in zip(*(column.to_pylist() for column in b.columns), strict=True):
                if not (key == last or (key != key and last != last)):
                    last, level, changed_at, cpu, memory = key, names.index("moderate"), None, 0.0, 0.0
                c, m = (nan if x is None else x for x in (c, m))
                cpu, memory = (c, m) if changed_at is None else (alpha * c + (1 - alpha) * cpu, alpha * m + (1 - alpha) * memory)
                load = max(cpu, next((least for above, least in floors if memory > above), 0.0)) * factor
                new = max(bisect_right(bounds, load) - 1, 0)
                held = margin is not None and (load < bounds[level + 1] + margin if new > level else load > bounds[level] - margin if new < level else False)
                change = new != level and not held and (changed_at is None or (nan if at is None else at) - changed_at >= cooldown_us)
                if change:
                    level, changed_at = new, nan if at is None else at
                out.append((cpu, memory, names[level], change))
            if out:
                state = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), (pa.float64(), pa.float64(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *state], ["key", "us", "cpu", "memory", "level", "changed"])

    rows = df.selectExpr(f"`{by}` AS key", f"CAST(`{us}` AS BIGINT) AS us", "CAST(cpu AS DOUBLE) AS cpu", "CAST(memory AS DOUBLE) AS memory")
    kind = rows.schema["key"].dataType.simpleString()
    ordered = rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("us"))
    return ordered.mapInArrow(fold, f"key {kind}, us long, cpu double, memory double, level string, changed boolean")


def degradation(df: DataFrame, by: str, us: str, ok: str, failures: int = 3, most: int = 3) -> DataFrame:
    """``key, us, level`` after each call: one more after ``failures`` failures in a row, one less after a success."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, level, row_of, out = rows.sort_values("us", kind="stable"), 0, 0, []
        for good in rows["ok"]:
            row_of = 0 if good else row_of + 1
            if good:
                level = max(0, level - 1)
            elif row_of >= failures:
                level, row_of = min(most, level + 1), 0
            out.append(level)
        return rows.assign(level=out)[["key", "us", "level"]]

    rows = df.selectExpr(f"`{by}` AS key", f"`{us}` AS us", f"`{ok}` AS ok")
    return rows.groupBy("key").applyInPandas(fold, f"key {rows.schema['key'].dataType.simpleString()}, us long, level int")


def token_bucket(df: DataFrame, by: str, us: str, rate: float, burst: float) -> DataFrame:
    """``key, us, admitted``: each row takes a token of its key's bucket, which fills by ``rate`` a second up to ``burst``."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, tokens, last, out = rows.sort_values("us", kind="stable"), burst, None, []
        for at in rows["us"]:
            tokens = burst if last is None else min(burst, tokens + rate * (at - last) / 1e6)
            last = at
            out.append(tokens >= 1)
            tokens -= out[-1]
        return rows.assign(admitted=out)

    rows = df.selectExpr(f"`{by}` AS key", f"`{us}` AS us")
    return rows.groupBy("key").applyInPandas(fold, f"key {rows.schema['key'].dataType.simpleString()}, us long, admitted boolean")
