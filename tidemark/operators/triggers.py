"""Per-row conditions of ordered samples: moving windows, outliers, anomalies, slopes, gaps, load levels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scans import SLICE_US, moments_before
from .series import with_previous

EPSILON = 1e-9


def compared(value: Column, op: str, threshold: float) -> Column:
    """A numeric comparison; ``>`` and ``<`` are strict, the others allow for 1e-9."""
    d = value - threshold
    return {">": value > threshold, "<": value < threshold, ">=": d >= -EPSILON, "<=": d <= EPSILON, "==": F.abs(d) < EPSILON, "!=": F.abs(d) >= EPSILON}[op]


def in_range(value: Column, low: float, high: float, inside: bool = True) -> Column:
    c = value.between(low, high)
    return c if inside else ~c


def combined(op: str, parts: list[Column]) -> Column:
    """AND, OR, XOR (exactly one), NOT (of the first); without parts false."""
    if not parts:
        return F.lit(False)
    if op == "and":
        return reduce(lambda a, b: a & b, parts)
    if op == "or":
        return reduce(lambda a, b: a | b, parts)
    if op == "xor":
        return reduce(lambda a, b: a + b, [p.cast("int") for p in parts]) == 1
    if op == "not":
        return ~parts[0]
    raise ValueError(f"no such operation: {op}")


def condition(tree: dict, column=lambda name: F.col(name)) -> Column:
    """A nested rule ``{"all": [...]}``, ``{"any": [...]}``, ``{"not": ...}`` or ``{"field", "op", "value"}`` as a column."""
    if "all" in tree:
        return combined("and", [condition(t, column) for t in tree["all"]])
    if "any" in tree:
        return combined("or", [condition(t, column) for t in tree["any"]])
    if "not" in tree:
        return ~condition(tree["not"], column)
    field, op, value = column(tree["field"]), tree["op"], tree["value"]
    text = {"contains": lambda: F.contains(field, F.lit(value)), "not_contains": lambda: ~F.contains(field, F.lit(value)), "regex": lambda: field.rlike(value)}
    return text[op]() if op in text else compared(field, op, value)


def time_slices(df: DataFrame, span_us: int, slices: int = 16) -> DataFrame:
    """Adds ``_slice``, so that windows over ``span_us`` can be partitioned by it too, and one key fills many tasks.

    A slice is ``slices`` spans long; rows in the last span of one also come, with ``_own`` false, into the next, so a
    frame that looks back one span finds all its rows there. Rows that are not their own are dropped after the window.
    """
    width = span_us * slices
    at = F.floor(F.col("us") / width)
    late = F.col("us") >= (at + 1) * width - span_us
    places = F.when(late, F.array(F.struct(at.alias("s"), F.lit(True).alias("o")), F.struct((at + 1).alias("s"), F.lit(False).alias("o")))).otherwise(F.array(F.struct(at.alias("s"), F.lit(True).alias("o"))))
    return df.withColumn("_place", F.explode(places)).withColumns({"_slice": F.col("_place.s"), "_own": F.col("_place.o")}).drop("_place")


def moving(df: DataFrame, by: str, span_us: int, value: str = "value") -> DataFrame:
    """Count, sum, mean, extremes and rows a whole second over the time before each row, by event time, in time slices."""
    def frames(part: pa.Table) -> dict[str, pa.Array]:
        us, low, high = _bounds(part, span_us)
        x, known = _floats(part, value)
        n, total, least, greatest = _totals(known, x, low, high)
        seconds, none = (us[high - 1] - us[low]) // 1_000_000, n == 0
        rate = np.where(seconds != 0, n / np.maximum(seconds, 1), 0.0)
        return {"m_count": pa.array(n), "m_sum": pa.array(total, mask=none), "m_mean": pa.array(total / np.maximum(n, 1), mask=none), "m_min": pa.array(least, mask=none), "m_max": pa.array(greatest, mask=none), "m_rate": pa.array(rate)}

    kinds = {"m_count": "long", "m_sum": "double", "m_mean": "double", "m_min": "double", "m_max": "double", "m_rate": "double"}
    return _by_slices(time_slices(df, span_us), by, ["us"], frames, kinds)


def _by_slices(df: DataFrame, by: str, order: list[str], frames: Callable[[pa.Table], dict[str, pa.Array]], kinds: dict[str, str]) -> DataFrame:
    """Each slice's own rows with the columns that ``frames`` makes of its rows in order, an Arrow table.

    Spark makes up a frame that moves at both ends anew for each row, which takes the rows times the frame's; ``frames`` takes sums and
    extremes of all frames of a slice from arrays made once, so that dense series cost no more a row than others.
    """
    kept = [c for c in df.columns if c not in ("_slice", "_own")]

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in order])
        own, part_kept = part.column("_own"), part.select(kept)
        for name, column in frames(part).items():
            part_kept = part_kept.append_column(name, column)
        return part_kept.filter(own)

    schema = T.StructType([f for f in df.schema if f.name in kept] + [T.StructField(n, T.LongType() if k == "long" else T.DoubleType()) for n, k in kinds.items()])
    return df.groupBy(by, "_slice").applyInArrow(run, schema)


def _bounds(part: pa.Table, span_us: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times in order, and for each row the first and the end of the rows at most ``span_us`` before it, with those of its own time."""
    us = pc.fill_null(part.column("us"), 0).to_numpy()  # rows without a time have a slice of their own
    return us, np.searchsorted(us, us - span_us, "left"), np.searchsorted(us, us, "right")


def _floats(part: pa.Table, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Values as doubles, and which are not null."""
    column = part.column(value).cast(pa.float64())
    return pc.fill_null(column, 0.0).to_numpy(), column.is_valid().to_numpy()


def _folded(cells: list[np.ndarray], empty: list[float], merge: Callable[[list, list], list], low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """What ``merge`` makes of the rows' ``cells`` from ``low`` up to before ``high``.

    A frame is put together of stretches that are powers of two long, those of each length being made of two of half of it: nothing
    is subtracted, so sums and moments are as good as if they were taken of each frame alone.
    """
    size, at, width = high - low, low.copy(), 1
    out = [np.full(len(low), e, dtype=np.float64) for e in empty]
    while True:
        rows = np.flatnonzero(size & width)
        for o, m in zip(out, merge([o[rows] for o in out], [c[at[rows]] for c in cells]), strict=True):
            o[rows] = m
        at[rows] += width
        if 2 * width > size.max(initial=0):
            return out
        cells = merge([c[:-width] for c in cells], [c[width:] for c in cells])
        width *= 2


def _moments(a: list, b: list) -> list:
    """Number, means of x and y, and sums of products of deviations: xx and xy, of two sets of rows together."""
    n = a[0] + b[0]
    share, dx, dy = b[0] / np.maximum(n, 1), b[1] - a[1], b[2] - a[2]
    return [n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * a[0] * share, a[4] + b[4] + dx * dy * a[0] * share]


def _totals(known: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Number, sum, least and greatest of the known values of each frame."""
    cells = [known.astype(np.float64), np.where(known, x, 0.0), np.where(known, x, np.inf), np.where(known, x, -np.inf)]
    merge = lambda a, b: [a[0] + b[0], a[1] + b[1], np.minimum(a[2], b[2]), np.maximum(a[3], b[3])]
    n, *rest = _folded(cells, [0.0, 0.0, np.inf, -np.inf], merge, low, high)
    return [n.astype(np.int64), *rest]


def moving_at_most(df: DataFrame, by: str, order: list[str], span_us: int, most: int, value: str = "value") -> DataFrame:
    """Count, sum, mean and oldest time of the rows up to each that are at most ``span_us`` old, of the newest ``most`` of them.

    The frame is what a RANGE and a ROWS frame have in common: it begins at the later of their first rows, and the sum is the
    of the rows from there, in time slices. Later rows of the same time don't count.
    """
    def frames(part: pa.Table) -> dict[str, pa.Array]:
        us, low, _ = _bounds(part, span_us)
        x, known = _floats(part, value)
        high = np.arange(1, len(us) + 1)
        low = np.maximum(low, high - most)
        n, total, _, _ = _totals(known, x, low, high)
        return {"m_count": pa.array(n), "m_sum": pa.array(total), "m_mean": pa.array(total / np.maximum(n, 1), mask=n == 0), "m_oldest": pa.array(us[low], mask=part.column("us").is_null().to_numpy())}

    return _by_slices(time_slices(df, span_us), by, order, frames, {"m_count": "long", "m_sum": "double", "m_mean": "double", "m_oldest": "long"})


def outliers(df: DataFrame, by: str, order: list[str], k: float = 3.0, more_than: int = 10, slice_us: int = SLICE_US, relative: bool = True) -> DataFrame:
    """Flags rows more than ``k`` deviations off the mean of all rows before them, once there are more than ``more_than``.

    With ``relative`` the distance is divided by the deviation plus 1e-10; else it is compared with ``k`` deviations, and none is flagged if
    there is no deviation. Moments of the rows before come from a scan over time slices.
    """
    rows = moments_before(df, [by], order, "value", slice_us)
    sd = F.when(F.col("_n") > 1, F.sqrt(F.col("_m2") / (F.col("_n") - 1)))
    distance = F.abs(F.col("value") - F.col("_mean"))
    hit = distance / (sd + 1e-10) > k if relative else (sd > 0) & (distance > k * sd)
    return rows.withColumn("outlier", F.coalesce((F.col("_n") > more_than) & hit, F.lit(False))).drop("_n", "_mean", "_m2")


def anomalies(df: DataFrame, by: str, order: list[str], k: float = 3.0, rows: int = 100, least: int = 10) -> DataFrame:
    """Flags rows more than ``k`` sample deviations off the mean of the last ``rows``, themselves included."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(-(rows - 1), 0)
    sd = F.stddev_samp("value").over(w)
    hit = (F.count("value").over(w) >= least) & (sd >= 1e-10) & (F.abs(F.col("value") - F.avg("value").over(w)) / sd > k)
    return df.withColumn("anomaly", F.coalesce(hit, F.lit(False)))


def deltas(df: DataFrame, by: str, order: list[str], threshold: float, absolute: bool = True, slice_us: int = SLICE_US) -> DataFrame:
    """Flags changes since the row before that exceed a threshold; the first row is not flagged."""
    d = F.col("value") - F.col("previous.value")
    rows = with_previous(df, by, order, ["value"], slice_us)
    return rows.withColumn("delta", F.coalesce((F.abs(d) if absolute else d) > threshold, F.lit(False))).drop("previous")


def absences(df: DataFrame, by: str, order: list[str], longer_us: int, slice_us: int = SLICE_US) -> DataFrame:
    """Flags rows that come more than ``longer_us`` after the row before."""
    rows = with_previous(df, by, order, ["us"], slice_us).withColumn("gap_us", F.col("us") - F.col("previous.us"))
    return rows.withColumn("absent", F.coalesce(F.col("gap_us") > longer_us, F.lit(False))).drop("previous")


def slopes(df: DataFrame, by: str, window_us: int, threshold: float, direction: str = "either", least: int = 2) -> DataFrame:
    """The least-squares slope over the last ``window_us``, as change in a window, and whether it exceeds a threshold; in time slices."""
    def frames(part: pa.Table) -> dict[str, pa.Array]:
        us, low, high = _bounds(part, window_us)
        y, known = _floats(part, "value")
        x, zero = us / 1000.0 - us[0] / 1000.0, np.zeros(len(us))
        size, _, _, xx, _ = _folded([zero + 1, x, zero, zero, zero], [0.0] * 5, _moments, low, high)
        n, _, _, _, xy = _folded([known.astype(np.float64), np.where(known, x, 0.0), y, zero, zero], [0.0] * 5, _moments, low, high)
        spread = xx / size
        change = np.where((n >= least) & (spread > 1e-10), xy / np.maximum(n, 1) / np.where(spread > 0, spread, 1.0), 0.0) * (window_us / 1000.0)
        return {"change": pa.array(change)}

    rows = _by_slices(time_slices(df, window_us), by, ["us"], frames, {"change": "double"})
    hit = {"either": F.abs(F.col("change")) > threshold, "increasing": F.col("change") > threshold, "decreasing": F.col("change") < -threshold}[direction]
    return rows.withColumn("fast", hit)



#: Levels of load with the pressure at which they begin, and the memory use above which pressure is at least just past a
#: level's beginning (fixed values).
LEVEL_BOUNDS = {"idle": 0.0, "low": 20.0, "moderate": 40.0, "high": 60.0, "critical": 80.0}
MEMORY_FLOORS = tuple((above, LEVEL_BOUNDS[level] + 1.0) for above, level in ((85.0, "critical"), (70.0, "high")))
STRATEGIES = {"conservative": 0.8, "balanced": 1.0, "aggressive": 1.2}


def pressure(cpu: Column, memory: Column, strategy: str = "balanced") -> Column:
    """CPU use, raised to a floor when memory is short, times the strategy's factor."""
    floor = F
    for above, least in MEMORY_FLOORS:
        floor = floor.when(memory > above, least)
    return F.greatest(cpu, floor.otherwise(0.0)) * STRATEGIES[strategy]


def load_level(load: Column) -> Column:
    """The highest level whose bound a pressure reaches."""
    out = F
    for name, bound in sorted(LEVEL_BOUNDS.items(), key=lambda x: -x[1])[:-1]:
        out = out.when(load >= bound, name)
    return out.otherwise("idle")


def log_baseline(counts: DataFrame, by: str, order: str, value: str, before: int = 24, spike: float = 2.0, drop: float = 0.1) -> DataFrame:
    """Whether each period's count is a spike or a drop against the mean of the periods before it."""
    base = F.avg(value).over(W.partitionBy(by).orderBy(order).rowsBetween(-before, -1))
    state = F.when(F.col(value) > spike * base, "spike").when(F.col(value) < drop * base, "drop").otherwise("normal")
    return counts.withColumn("baseline", base).withColumn("state", state)


def scaling(df: DataFrame, by: str, order: list[str], up: float, down: float, stable: int = 3) -> DataFrame:
    """``up`` or ``down`` where the last ``stable`` rows are all beyond a bound, else ``hold``."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(-(stable - 1), 0)
    full = F.count("value").over(w) >= stable
    return df.withColumn("decision", F.when(full & (F.min("value").over(w) > up), "up").when(full & (F.max("value").over(w) < down), "down").otherwise("hold"))


def threshold_state(value: Column, warning: float, critical: float) -> Column:
    return F.when(value >= critical, 2).when(value >= warning, 1).otherwise(0)


def log_anomalies(periods: DataFrame, by: str, order: str, before: int = 24, error_spike: float = 3.0, latency_spike: float = 2.0, z: float = 3.0) -> DataFrame:
    """Flags of periods ``volume, error_rate, latency`` against the periods before: error and latency spikes, and volumes ``z`` deviations off."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(-before, -1)
    errors, latency, volume, sd = F.avg("error_rate").over(w), F.avg("latency").over(w), F.avg("volume").over(w), F.stddev_samp("volume").over(w)
    flag = {"error_spike": F.col("error_rate") > error_spike * errors, "slow": F.col("latency") > latency_spike * latency, "odd_volume": (sd > 1e-10) & (F.abs(F.col("volume") - volume) > z * sd)}
    return periods.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flag.items()})
