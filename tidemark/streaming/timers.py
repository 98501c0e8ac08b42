"""Streams with timers: a fold of each key's rows in event time, whose deadlines come due without further rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import ARROW

#: Rows that are Python values at once; all others of a bucket are Arrow columns.
CHUNK = 10_000
#: Buckets of keys: a call of the fold takes milliseconds, and most keys have few rows. It is part of a stream's state and so can't change while one lives.
BUCKETS = 1024


class Machine(Protocol):
    """What is kept of one key, as JSON values, and what rows and deadlines do to it."""

    def due(self, kept: dict) -> int | None:
        """When the next deadline is, in microseconds; None for none."""

    def fire(self, kept: dict, at: int) -> Iterator[tuple]:
        """Passes the deadline; yields result rows."""

    def row(self, kept: dict, at: int, values: tuple) -> Iterator[tuple]:
        """Takes a row; yields result rows."""


def horizon_us(newest_us: int, late_ms: int) -> int:
    """Up to when a stream has worked once its newest row is at ``newest_us``: Spark's watermark counts whole milliseconds."""
    return (newest_us // 1000 - late_ms - 1) * 1000


def folded(stream: DataFrame, key: str, order: list[str], columns: list[str], machine: Machine, schema: str, late_ms: int) -> DataFrame:
    """A machine's results for each key of a stream with a TIMESTAMP ``ts``; ``order`` begins with its microseconds.

    Rows wait until the watermark, ``late_ms`` behind the newest row, has passed them, and are then taken in ``order``, the
    machine sees their ``columns``; a deadline at or before a row's time comes first. So results don't depend on how rows are cut into
    batches, and deadlines pass as time goes on, with or without rows of the key. Between batches a key keeps what its machine
    keeps and its waiting rows; a key whose machine has nothing left to keep is forgotten. One state holds the keys of a bucket.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept, waiting = (dict(json.loads(state.get[0])), _unpacked(state.get[1])) if state.exists else ({}, held_schema.empty_table())
        waiting = pa.concat_tables([waiting, *(pa.Table.from_pandas(b.set_axis(held_schema.names, axis=1), held_schema, preserve_index=False) for b in batches)])
        now = (state.getCurrentWatermarkMs() - 1) * 1000
        out: list[tuple] = []

        def pass_deadlines(name: str | None, one: dict, upto: int) -> None:
            while (at := machine.due(one)) is not None and at <= upto:
                out.extend((name, *r) for r in machine.fire(one, at))

        if len(waiting) and pc.min(waiting.column(0)).as_py() <= now:
            waiting = waiting.take(pc.sort_indices(waiting, [(n, "ascending") for n in held_schema.names[: len(order)]], null_placement="at_start"))
            ready = int(np.searchsorted(waiting.column(0).to_numpy(), now, "right"))
            for i in range(0, ready, CHUNK):
                part = waiting.slice(i, min(CHUNK, ready - i))
                for at, name, values in zip(part.column(0).to_pylist(), part.column(len(order)).to_pylist(), zip(*(c.to_pylist() for c in part.columns[len(order) + 1 :]), strict=True), strict=True):
                    one = kept.setdefault(name, {})
                    pass_deadlines(name, one, at)
                    out.extend((name, *r) for r in machine.row(one, at, values))
                if len(out) >= CHUNK:
                    yield _frame(out, names)
                    out.clear()
            waiting = waiting.slice(ready)
        for name, one in kept.items():
            pass_deadlines(name, one, now)
        kept = {name: one for name, one in kept.items() if one}
        nexts = [t for t in (*map(machine.due, kept.values()), pc.min(waiting.column(0)).as_py()) if t is not None]
        if kept or len(waiting):
            state.update((json.dumps(list(kept.items())), _packed(waiting)))
            if nexts:
                state.setTimeoutTimestamp(max(-(-min(nexts) // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield _frame(out, names)

    names = ["key", *[c.split()[0] for c in schema.split(",")]]
    text = F.col(key).cast("string")
    held = [c.alias(f"_{i}") for i, c in enumerate([*map(F.col, order), text, *map(F.col, columns)])]
    rows = stream.withWatermark("ts", f"{late_ms} milliseconds").select("ts", F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int").alias("bucket"), *held)
    kinds = dict(rows.dtypes)
    held_schema = pa.schema([(f"_{i}", ARROW[kinds[f"_{i}"]]) for i in range(len(held))])
    return rows.groupBy("bucket").applyInPandasWithState(_without_ts(run, [f"_{i}" for i in range(len(held))]), f"key string, {schema}", "kept string, waiting binary", "append", "EventTimeTimeout")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def _packed(rows: pa.Table) -> bytes:
    """Waiting rows as a compressed Arrow stream: a row takes a few bytes in the state, not a text."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(kept: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(kept)).read_all()


def _without_ts(run, columns: list[str]):
    def call(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        return run(keys, (b[columns] for b in batches), state)

    return call


class GroupTimer:
    """Sends a group ``wait_us`` after its first alert and then every ``interval_us`` while it has members.

    Rows are ``fingerprint, firing``. A member that is resolved leaves ``resolve_us`` later, unless it fires again; a group
    without members is forgotten. At equal times members leave first, then groups are sent, then rows are taken.
    Results: ``us, size, firing``.
    """

    SCHEMA = "us long, size long, firing long"

    def __init__(self, wait_us: int, interval_us: int, resolve_us: int):
        self.wait_us, self.interval_us, self.resolve_us = wait_us, interval_us, resolve_us

    def _leaving(self, kept: dict) -> int | None:
        return min((m["resolved"] + self.resolve_us for m in kept["members"].values() if m["resolved"] is not None), default=None)

    def due(self, kept: dict) -> int | None:
        if not kept:
            return None
        leaving = self._leaving(kept)
        return kept["send"] if leaving is None else min(kept["send"], leaving)

    def fire(self, kept: dict, at: int) -> Iterator[tuple]:
        for name in [n for n, m in kept["members"].items() if m["resolved"] is not None and m["resolved"] + self.resolve_us <= at]:
            del kept["members"][name]
        if not kept["members"]:
            kept.clear()
        elif kept["send"] <= at:
            kept["send"] += self.interval_us
            yield at, len(kept["members"]), sum(m["resolved"] is None for m in kept["members"].values())

    def row(self, kept: dict, at: int, values: tuple) -> Iterator[tuple]:
        fingerprint, firing = values
        if not kept:
            kept.update(members={}, send=at + self.wait_us)
        kept["members"][fingerprint] = {"resolved": None if firing else at}
        return iter(())


class CacheTimer:
    """Lets an alert through unless one of the same state is remembered; what is remembered is forgotten ``keep_us`` after its first alert.

    With ``compat`` the first alert records no state, so one repeat passes. Rows are ``id, state``, results ``us, id, state``.
    """

    SCHEMA = "us long, id long, state string"

    def __init__(self, keep_us: int, compat: bool = False):
        self.keep_us, self.compat = keep_us, compat

    def due(self, kept: dict) -> int | None:
        return kept["first"] + self.keep_us + 1 if kept else None

    def fire(self, kept: dict, at: int) -> Iterator[tuple]:
        kept.clear()
        return iter(())

    def row(self, kept: dict, at: int, values: tuple) -> Iterator[tuple]:
        id_, state = values
        if not kept:
            kept.update(first=at, state=None if self.compat else state)
            yield at, id_, state
        elif kept["state"] != state:
            kept["state"] = state
            yield at, id_, state


class StateTimer:
    """The alert state machine with a resolve timeout: a key without a row for ``silent_us`` is resolved, and forgotten ``keep_us`` later.

    Rows are ``met``; results ``us, state`` at each change. ``hold_us`` is how long a condition has to hold before it fires.
    """

    SCHEMA = "us long, state string"

    def __init__(self, hold_us: int, silent_us: int, keep_us: int):
        self.hold_us, self.silent_us, self.keep_us = hold_us, silent_us, keep_us

    def due(self, kept: dict) -> int | None:
        if not kept:
            return None
        return kept["last"] + (self.silent_us if kept["state"] in ("pending", "firing") else self.keep_us)

    def fire(self, kept: dict, at: int) -> Iterator[tuple]:
        if kept["state"] == "firing":
            kept.update(state="resolved", last=at)
            yield at, "resolved"
        elif kept["state"] == "pending":
            kept.update(state="inactive", last=at)
            yield at, "inactive"
        else:
            kept.clear()

    def row(self, kept: dict, at: int, values: tuple) -> Iterator[tuple]:
        met, state = bool(values[0]), kept.get("state", "inactive")
        since = kept.get("since", at)
        new = state
        if met and state in ("inactive", "resolved"):
            new, since = "pending", at
        elif met and state == "pending" and at - since >= self.hold_us:
            new = "firing"
        elif not met and state == "firing":
            new = "resolved"
        elif not met and state == "pending":
            new = "inactive"
        kept.update(state=new, since=since, last=at)
        if new != state:
            yield at, new
