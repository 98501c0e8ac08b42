"""Alerts: rules, states, silences, inhibition, routes, groups, repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.folders import checkpointed
from ..functions.labels import label, message
from . import blocks
from .scans import SLICE_US, entering, last_known, passing, pieces, runs, sliced
from .series import with_neighbours
from .similarity import entries, expanded, reachable, same_entry, sides, similar_rows

SILENCES = 10_000
SEVERITIES = ("info", "warning", "critical", "emergency")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def threshold_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """One alert for each sample and enabled rule ``rule, metric, op, threshold, severity, enabled`` that it breaks.

    Comparisons are exact. The rules are the smaller side of an equi join, which Spark broadcasts if they fit.
    """
    v, t, op = F.col("value"), F.col("threshold"), F.col("op")
    hit = F.when(op == ">", v > t).when(op == "<", v < t).when(op == ">=", v >= t).when(op == "<=", v <= t).when(op == "==", v == t).when(op == "!=", v != t)
    return metrics.join(rules.where("enabled"), metrics["name"] == rules["metric"]).where(hit)


def labelled_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """:func:`threshold_alerts` of rules that also have ``labels``, an ``annotation`` and an ``alert_group``: ``rule, severity, group_key, labels, annotation, row_id, us``.

    An alert's labels are the metric's, over which the rule's win; its group is the rule's, or its name without one; the annotation's
    ``${rule}``, ``${name}``, ``${severity}`` and ``${value}`` are replaced.
    """
    hits = threshold_alerts(metrics, rules)
    own = F.map_filter(F.col("tags"), lambda k, _: ~F.map_contains_key(F.col("labels"), k))
    text = message(F.col("annotation"), {"rule": F.col("rule"), "name": F.col("name"), "severity": F.col("severity")}, F.col("value"))
    group = F.when(F.coalesce(F.col("alert_group"), F.lit("")) != "", F.col("alert_group")).otherwise(F.col("rule"))
    return hits.select("rule", "severity", group.alias("group_key"), F.map_concat(own, F.col("labels")).alias("labels"), text.alias("annotation"), "row_id", "us")


def states(df: DataFrame, by: list[str], order: list[str], met: str, hold_us: int = 0, slice_us: int = SLICE_US) -> DataFrame:
    """Adds ``state`` (inactive, pending, firing, resolved) of each evaluation, in order, for each key.

    A run of met conditions begins pending and fires at its next row that comes ``hold_us`` or more after its first; an
    unmet condition resolves a firing alert and drops a pending one. Within a run the state depends only on its first
    row and the run before, which a scan over time slices brings; ``order`` begins with the time.
    """
    rows = runs(df, by, order, F.col(met), hold_us, slice_us)
    state = F.when(F.col("_on"), F.when(F.col("_fires"), "firing").otherwise("pending")).when(F.col("_was"), "resolved").otherwise("inactive")
    return rows.withColumn("state", state).drop("_on", "_fires", "_was")


def transitions(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Evaluations that changed the state, with the state before."""
    before = F.coalesce(F.lag("state").over(W.partitionBy(*by).orderBy(*order)), F.lit("inactive"))
    return df.withColumn("before", before).where("state <> before")


def counters(changes: DataFrame, by: list[str]) -> DataFrame:
    return changes.groupBy(*by).agg(F.count_if(F.col("state") == "pending").alias("created"), F.count_if(F.col("state") == "firing").alias("fired"), F.count_if(F.col("state") == "resolved").alias("resolved"))


def silenced(alerts: DataFrame, silences: DataFrame, keep: bool = False) -> DataFrame:
    """Alerts that no silence ``matchers, starts_us, ends_us`` covers (or with ``keep``, those that one does).

    A silence covers an alert if it is running and all its label pairs match. Silences are entered by hand: up to
    ``SILENCES`` of them are broadcast, as a condition on all pairs needs; more must be given in parts, one after another.
    """
    if silences.count() > SILENCES:
        raise ValueError(f"more than {SILENCES} silences at once")
    wanted, absent = _pairs(F.col("matchers"))
    s = F.broadcast(silences.select("starts_us", "ends_us", wanted.alias("_wanted"), absent.alias("_absent")))
    pairs, _ = _pairs(F.col("labels"))
    named = F.map_keys(F.map_filter("labels", lambda _, v: v != ""))
    a = alerts.withColumns({"_pairs": pairs, "_named": named})
    cover = (a["us"] >= s["starts_us"]) & (a["us"] < s["ends_us"]) & (F.size(F.array_except(s["_wanted"], a["_pairs"])) == 0) & ~F.arrays_overlap(s["_absent"], a["_named"])
    return a.join(s, cover, "left_semi" if keep else "left_anti").drop("_pairs", "_named")


def _pairs(labels: Column) -> tuple[Column, Column]:
    """Label pairs with a value as texts, and the keys of those without, which stand for missing labels."""
    entries = F.map_entries(labels)
    full = F.transform(F.filter(entries, lambda e: e["value"] != ""), lambda e: F.concat(e["key"], F.lit("\x01"), e["value"]))
    return full, F.transform(F.filter(entries, lambda e: e["value"] == ""), lambda e: e["key"])


def inhibited(alerts: DataFrame, source: Column, target: Column, equal: list[str]) -> DataFrame:
    """Alerts that stay: a ``target`` goes if a firing ``source`` of another fingerprint has the same ``equal`` labels.

    Sources are reduced to two fingerprints a label set (the least and the greatest), which decide the same, so the equi
    join can't multiply rows.
    """
    keys = [label(F.col("labels"), k).alias(f"_k{i}") for i, k in enumerate(equal)] or [F.lit("").alias("_k0")]
    names = [f"_k{i}" for i in range(max(1, len(equal)))]
    sources = alerts.where(source & (F.col("state") == "firing")).groupBy(*keys).agg(F.min("fingerprint").alias("_low"), F.max("fingerprint").alias("_high"))
    sources = sources if equal else F.broadcast(sources)  # one row at most
    joined = alerts.select("*", *keys).join(sources, names, "left")
    blocked = target & F.col("_low").isNotNull() & ((F.col("_low") != F.col("fingerprint")) | (F.col("_high") != F.col("fingerprint")))
    return joined.where(~F.coalesce(blocked, F.lit(False))).drop(*names, "_low", "_high")


def routed(alerts: DataFrame, routes: list[tuple[Column, str]], default: str) -> DataFrame:
    """Adds ``receiver``: that of the first route whose condition holds."""
    out = F
    for when, receiver in routes:
        out = out.when(when, receiver)
    return alerts.withColumn("receiver", out.otherwise(default) if routes else F.lit(default))


def notified(alerts: DataFrame, folder: str) -> None:
    """Appends alerts as JSON lines to a folder for each ``receiver``."""
    alerts.write.mode("append").partitionBy("receiver").json(folder)


def deduplicated(alerts: DataFrame, by: list[str], order: list[str], compat: bool = False) -> DataFrame:
    """Drops repeats of a state: the second of two equal ones in a row, or, with ``compat``, from the third on.

    In the compatible mode the first sighting of a key records no state, so one repeat passes.
    """
    w = W.partitionBy(*by).orderBy(*order)
    before = F.lag("state").over(w)
    if compat:
        before = F.when(F.row_number().over(w) > 2, before)
    return alerts.withColumn("_before", before).where("_before is null or state <> _before").drop("_before")


def cooled(alerts: DataFrame, by: list[str], cooldown_us: int | str, slice_us: int = SLICE_US) -> DataFrame:
    """Alerts that come ``cooldown_us`` or more after the last one let through for their key.

    The greedy choice needs the rows in order. Each key is cut where gaps reach the cooldown, as every such row passes;
    pieces are folded one by one, so a key with many rows is spread over its pieces. A column's name as cooldown
    gives each key its own.
    """
    own = isinstance(cooldown_us, str)

    def step(last: dict | None, row: dict) -> tuple[dict, bool]:
        passes = last is None or row["us"] - last["us"] >= (row[cooldown_us] if own else cooldown_us)
        return ({"us": row["us"]} if passes else last), passes

    rows = pieces(alerts, by, "us", cooldown_us, slice_us)
    return passing(rows, [*by, "_piece"], ["us"], step, ["us", *([cooldown_us] if own else [])]).drop("_piece")


def grouped(alerts: DataFrame, key: Column) -> DataFrame:
    """Size, highest severity, first and last time of each group."""
    return alerts.groupBy(key.alias("group_key")).agg(
        F.count("*").alias("size"), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(severity_rank(F.col("severity"))).cast("int")).alias("max_severity"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def similar_alerts(alerts: DataFrame, window_us: int, least: float = 0.85, digits: int | None = None) -> DataFrame:
    """Pairs ``a, b`` of alert ids in one name whose texts are similar and whose times are within the window, the earlier first."""
    return similar_rows(alerts, "name", "id", "text", "us", window_us, least, digits)


def alike(alerts: DataFrame, window_us: int, least: float = 0.85, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> DataFrame:
    """Pairs ``a, b`` of alerts whose overall similarity is at least ``least``, the earlier first, with its three parts.

    The overall score weighs the Jaccard index of the labels, the similarity of the texts and the nearness in time. As
    the other parts are 1 at most, a pair's labels must have an index of ``floor`` or more, so of its sorted label pairs the
    rarest ones must meet (a prefix of each list, as in set joins): alerts are joined by those and by windows of time, alerts of
    equal texts and labels once for all of a window; alerts of a frequent label pair with short texts all at once, in blocks. Alerts without labels meet those without. ``least`` must be so high that labels have to agree in part.
    """
    by_label, by_text, by_time = weights
    floor = (least - by_text - by_time) / by_label
    if floor <= 0:
        raise ValueError("pairs without a common label could reach this score")
    reach = window_us * (1 - max(0.0, (least - by_label - by_text) / by_time)) if by_time else window_us
    width = max(1, int(reach))
    items = F.array_sort(F.array_distinct(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))))
    rows = alerts.where(F.col("text").isNotNull()).select("id", "text", "us", F.when(F.size("labels") > 0, items).otherwise(F.array(F.lit(""))).alias("items"))
    shares = rows.select("us", "text", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.min("us").alias("from"), F.max("us").alias("to"), F.max(F.length("text")).alias("longest"))
    packed = F.lit(dict(rows.dtypes)["id"] == "bigint") & blocks.worthwhile(F.col("n"), F.col("from"), F.col("to"), width, F.col("longest"))
    shares = shares.select("item", "n", packed.alias("packed"))
    ranked = rows.select("items").distinct().select("items", F.explode("items").alias("item")).join(shares, "item").groupBy("items").agg(F.array_sort(F.collect_list(F.struct("n", "item", "packed"))).alias("ranked"))
    kept = F.size("ranked") - F.ceil(F.size("ranked") * F.lit(floor - 1e-9)) + 1
    names = F.transform("ranked", lambda r: r["item"])
    ranked = ranked.select("items", names.alias("names"), F.slice("ranked", 1, F.greatest(kept, F.lit(1)).cast("int")).alias("prefix"))
    alike_rows = checkpointed(entries(rows, ["text", "items"], "id", "us", width).join(ranked, "items"))
    # null label values are equal to each other, but nothing is joined by them
    alike_rows = alike_rows.withColumns({"labels": F.size("items"), "nulls": (F.size("items") > F.size("names")).cast("int")})
    parts = 4 * int(alerts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows make many pairs, so they aren't coalesced
    alike_rows = alike_rows.withColumn("met", F.explode("prefix")).withColumns({"key": F.col("met.item"), "packed": F.col("met.packed")}).drop("met", "prefix")
    whole = alike_rows.where("packed").drop("packed")
    at_once = blocks.compared(whole, ["key"], ["text", "items", "part"], parts, _alike_blocks(weights, least, window_us, width), "a long, b long, s long, t long, label_similarity double, text_similarity double")
    a, b, on = sides(alike_rows.where("not packed").drop("packed"), ["key"], parts)
    met = a.join(b, on).where(reachable(["text", "items"], width)).withColumn("common", F.array_intersect("names", "names_b"))
    met = met.where(F.element_at("common", 1) == F.col("key"))  # a pair counts where its first common key is
    common = F.size("common") + F.least("nulls", "nulls_b")
    gap = F.greatest(F.col("lo_b") - F.col("hi"), F.col("lo") - F.col("hi_b"), F.lit(0))
    met = met.withColumns({"label_similarity": common / (F.col("labels") + F.col("labels_b") - common), "_rest": by_time * time_similarity(gap, F.lit(0), window_us), "_longer": F.greatest(F.length("text"), F.length("text_b"), F.lit(1))})
    lack = by_label * F.col("label_similarity") + by_text + F.col("_rest") - least + 1e-9
    met = met.where(lack >= 0)
    if by_text:
        most = F.floor(F.least(lack / by_text, F.lit(1.0)) * F.col("_longer") + 1e-6).cast("int")
        met = met.withColumn("_distance", F.call_function("levenshtein", F.col("text"), F.col("text_b"), most)).where("_distance >= 0")  # -1 beyond the bound
    else:
        met = met.withColumn("_distance", F.levenshtein("text", "text_b"))
    met = met.withColumns({"text_similarity": 1 - F.col("_distance") / F.col("_longer"), "own": same_entry(["text", "items"])})
    part = expanded(met, ["label_similarity", "text_similarity"], width).unionByName(at_once).withColumn("time_similarity", time_similarity(F.col("s"), F.col("t"), window_us))
    overall = by_label * F.col("label_similarity") + by_text * F.col("text_similarity") + by_time * F.col("time_similarity")
    part = part.where(overall >= least - 1e-8)  # rounding is slow
    return part.withColumn("similarity", F.round(overall, 9)).where(F.col("similarity") >= least).select("a", "b", "label_similarity", "text_similarity", "time_similarity", "similarity")


def _alike_blocks(weights: tuple[float, float, float], least: float, window_us: int, width: int):
    """Compares two blocks of alerts that share a label pair as :func:`alike` does; the pairs that it yields may still miss ``least`` by a rounding."""
    by_label, by_text, by_time = weights

    def compare(a: blocks.Side, b: blocks.Side, same: bool) -> Iterator[dict[str, pa.Array]]:
        key, size = a["key"][0].as_py(), [np.array([len(t) for t in x["text"].to_pylist()]) for x in (a, b)]
        lo, hi = [x.numbers("lo") for x in (a, b)], [x.numbers("hi") for x in (a, b)]
        labels, nulls = [x.numbers("labels") for x in (a, b)], [x.numbers("nulls") for x in (a, b)]
        number: dict[str, int] = {}
        lists = [[[number.setdefault(n, len(number)) for n in names] for names in x["names"].to_pylist()] for x in (a, b)]
        wide = [max(map(len, some)) for some in lists]
        x, y = (np.array([[*names, *[-1 - side] * (wide[side] - len(names))] for names in some], np.int32) for side, some in enumerate(lists))
        place = np.array([names.index(number[key]) for names in lists[0]])
        # the greatest distance at each number of common labels, if all else is at its best
        most_common = np.arange(x.shape[1] + 1) + min(n.max() for n in nulls)
        best = by_label * most_common / np.maximum(labels[0].min() + labels[1].min() - most_common, 1) + by_text + by_time - least + 1e-9
        cap = np.floor(np.minimum(best / by_text, 1.0) * max(1, *(n.max() for n in size)) + 1e-6) if by_text else np.where(best >= 0, blocks.LETTERS, -1)
        cap = np.clip(cap, -1, blocks.LETTERS).astype(np.int8)
        for start, found in blocks.distances(a["text"], b["text"]):
            end = start + found.shape[1]
            common, own = np.zeros(found.shape, np.uint8), np.ones(found.shape, bool)
            for p in range(x.shape[1]):
                equal = np.zeros(found.shape, bool)
                for q in range(y.shape[1]):
                    equal |= x[start:end, p] == y[:, q, None]
                common += equal
                if (earlier := p < place[start:end]).any():
                    own &= ~(equal & earlier)  # a pair counts where its first common key is
            own &= found <= cap.take(common)
            if same:
                own &= np.arange(start, end) <= np.arange(len(found))[:, None]
            j, i = np.divmod(np.flatnonzero(own), end - start)
            d, shared, i = found[j, i], common[j, i], i + start
            shared = shared + np.minimum(nulls[0][i], nulls[1][j])
            alike = shared / (labels[0][i] + labels[1][j] - shared)
            gap = np.maximum(np.maximum(lo[1][j] - hi[0][i], lo[0][i] - hi[1][j]), 0)
            lack = by_label * alike + by_text + by_time * np.maximum(1 - gap / window_us, 0.0) - least + 1e-9
            longer = np.maximum(np.maximum(size[0][i], size[1][j]), 1)
            near = (lack >= 0) & (gap <= width)
            if by_text:
                near &= d <= np.floor(np.minimum(lack / by_text, 1.0) * longer + 1e-6)
            i, j, alike, texts = i[near], j[near], alike[near], 1 - d[near] / longer[near]
            for k, pairs in blocks.expanded(a, b, i, j, same, width):
                close = np.maximum(1 - np.abs(np.asarray(pairs["s"]) - np.asarray(pairs["t"])) / window_us, 0.0)
                most = np.flatnonzero(by_label * alike[k] + by_text * texts[k] + by_time * close >= least - 1e-8)
                yield {n: c.take(pa.array(most)) for n, c in (pairs | {"label_similarity": pa.array(alike[k]), "text_similarity": pa.array(texts[k])}).items()}

    return compare


def active(states: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Keys whose newest state is pending or firing, with that state, its time and value."""
    newest = states.groupBy(*by).agg(F.max_by(F.struct("state", "us", "value"), F.struct(*order)).alias("_newest"))
    return newest.select(*by, "_newest.*").where(F.col("state").isin("pending", "firing"))


def resolved_by_hand(active_alerts: DataFrame, keys: DataFrame) -> DataFrame:
    """Active alerts, those that ``keys`` names as resolved; the keys are entered by hand, so Spark may broadcast them."""
    marked = keys.select(*keys.columns, F.lit(True).alias("_hand"))
    return active_alerts.join(marked, keys.columns, "left").withColumn("state", F.when(F.col("_hand"), "resolved").otherwise(F.col("state"))).drop("_hand")


def remembered(states: DataFrame, by: list[str], order: list[str], as_of_us: int, timeout_us: int) -> DataFrame:
    """Each key's newest state, without those resolved for longer than the timeout."""
    newest = states.groupBy(*by).agg(F.max_by(F.struct("state", "us"), F.struct(*order)).alias("_newest")).select(*by, "_newest.*")
    return newest.where((F.col("state") != "resolved") | (F.lit(as_of_us) - F.col("us") <= timeout_us))


def running(silences: DataFrame, as_of_us: int) -> DataFrame:
    return silences.where((F.col("starts_us") <= as_of_us) & (F.col("ends_us") > as_of_us))


def notifications(states: DataFrame, by: list[str], order: list[str], repeat_us: int) -> DataFrame:
    """Evaluations that notify: the start of firing, firing again ``repeat_us`` or more after the last, and the end.

    ``states`` are rows that no silence covers; a silenced evaluation sends nothing and starts no interval.
    """
    w = W.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.lag("state").over(w), F.lit("inactive"))
    rows = states.select(*by, *order, "state", before.alias("_before"))
    starts = ((F.col("state") == "firing") & (F.col("_before") != "firing")).cast("int")
    rows = rows.withColumn("_run", F.sum(starts).over(w.rowsBetween(W.unboundedPreceding, 0)))
    firing = cooled(rows.where("state = 'firing'"), [*by, "_run"], repeat_us)
    ended = rows.where("state = 'resolved' AND _before = 'firing'")
    return firing.unionByName(ended).drop("_before", "_run")


def group_flushes(alerts: DataFrame, by: list[str], wait_us: int, interval_us: int) -> DataFrame:
    """``by, us, id, size``: the alerts on whose arrival a group is sent, with its distinct alerts so far.

    A group is sent first when ``wait_us`` have passed since its first alert, then ``interval_us`` or more after the
    last time. Sizes are running counts of first sightings, in event time.
    """
    w = W.partitionBy(*by).orderBy("us", "id").rowsBetween(W.unboundedPreceding, 0)
    new = (F.row_number().over(W.partitionBy(*by, "fingerprint").orderBy("us", "id")) == 1).cast("int")
    rows = alerts.select(*by, "us", "id", "fingerprint").withColumn("_new", new)
    rows = rows.select(*by, "us", "id", F.sum("_new").over(w).alias("size"), F.min("us").over(w).alias("_first"))
    ready = rows.where(F.col("us") - F.col("_first") >= wait_us).drop("_first")
    return cooled(ready, by, interval_us)


def timed_flushes(rows: DataFrame, group: str, fingerprint: str, order: list[str], firing: str, wait_us: int, interval_us: int, resolve_us: int, until_us: int, slice_us: int = SLICE_US) -> DataFrame:
    """``key, us, size, firing``: when each group is sent up to ``until_us``, with its members then and how many of them fire.

    The batch form of :class:`timers.GroupTimer`. A fingerprint is a member from its first row until ``resolve_us`` after it is
    resolved; where these stretches overlap they make a group's life. A life is sent ``wait_us`` after it begins and then every
    ``interval_us`` while it lasts, so each stretch counts from one send to another: sizes are running sums of signed changes
    by the number of the send.
    """
    us, on, key = order[0], F.coalesce(F.col(firing), F.lit(False)), "key"
    r = rows.select(F.col(group).cast("string").alias(key), F.col(fingerprint).alias("_f"), *order, on.alias("_on"))
    r = with_neighbours(r, [key, "_f"], order, [us, "_on"], slice_us)
    ever = F.lit((1 << 62))
    end = F.coalesce(F.col(f"following.{us}"), ever)
    leave = F.when(F.col("_on"), end).otherwise(F.least(end, F.col(us) + resolve_us))
    fresh = F.col("previous").isNull() | (~F.col("previous._on") & (F.col(us) >= F.col(f"previous.{us}") + resolve_us))
    r = checkpointed(r.select(key, "_f", *order, "_on", leave.alias("_leave"), end.alias("_end"), F.when(fresh, F.col(us)).alias("_fresh")))
    r = last_known(r, [key, "_f"], order, F.col("_fresh"), "_start", slice_us)
    stretches = checkpointed(_lives(r.groupBy(key, "_f", "_start").agg(F.max("_leave").alias("_leave")).select(key, "_start", "_leave"), key, slice_us))
    lives = stretches.groupBy(key, "_first").agg(F.max("_leave").alias("_stop"))
    sends = checkpointed(lives.withColumn("_n", F.floor((F.least(F.col("_stop") - 1, F.lit(until_us)) - F.col("_first") - wait_us) / interval_us)).where("_n >= 0"))

    def numbers(df: DataFrame, begin: str, last: Column, name: str) -> DataFrame:
        """From which send of its life on a stretch counts, and from which no more."""
        at = df.join(sends, [key, "_first"])
        low = F.greatest(F.floor((F.col(begin) - F.col("_first") - wait_us) / interval_us) + 1, F.lit(0))
        high = F.least(F.floor((last - F.col("_first") - wait_us) / interval_us), F.col("_n"))
        both = at.select(key, "_first", low.alias("_low"), high.alias("_high")).where("_low <= _high")
        cells = F.explode(F.array(F.struct(F.col("_low").alias("i"), F.lit(1).alias("d")), F.struct((F.col("_high") + 1).alias("i"), F.lit(-1).alias("d"))))
        return both.select(key, "_first", cells.alias("c")).groupBy(key, "_first", F.col("c.i").alias("_i")).agg(F.sum("c.d").alias(name))

    size = numbers(stretches, "_start", F.col("_leave") - 1, "_size")
    starts = stretches.select(key, "_start", "_first").distinct()  # stretches of a group that start together are of one life
    fires = numbers(r.where("_on").select(key, "_start", F.col(us).alias("_from"), "_end").join(starts, [key, "_start"]), "_from", F.col("_end"), "_fires")
    each = sends.select(key, "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))).alias("_i"))
    steps = each.join(size, [key, "_first", "_i"], "left").join(fires, [key, "_first", "_i"], "left")
    upto = W.partitionBy(key, "_first").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    return steps.select(key, (F.col("_first") + wait_us + F.col("_i") * interval_us).alias("us"), F.sum(F.coalesce("_size", F.lit(0))).over(upto).alias("size"), F.sum(F.coalesce("_fires", F.lit(0))).over(upto).alias("firing"))


def _lives(stretches: DataFrame, key: str, slice_us: int) -> DataFrame:
    """The stretches with ``_first``, when the union of overlapping stretches begins that each is part of (those that only touch stay apart)."""
    rows = sliced(stretches, "_start", slice_us)
    w = W.partitionBy(key, "_slice").orderBy("_start", "_leave")
    rows = rows.withColumn("_inner", F.max("_leave").over(w.rowsBetween(W.unboundedPreceding, -1)))
    rows = entering(rows, [key], {"reach": F.max("_leave")}, lambda left, row: {"_reach": max(row["reach"], left["_reach"]) if left else row["reach"]}, {"_reach": "long"})
    far = F.greatest("_inner", "_reach")
    rows = rows.select(key, "_start", "_leave", F.when(far.isNull() | (F.col("_start") >= far), F.col("_start")).alias("_new"))
    return last_known(rows, [key], ["_start", "_leave"], F.col("_new"), "_first", slice_us).drop("_new")


def cached(rows: DataFrame, by: list[str], order: list[str], state: str, keep_us: int, compat: bool = False, slice_us: int = SLICE_US) -> DataFrame:
    """Rows that aren't repeats of a remembered state; what is remembered of a key is forgotten ``keep_us`` after its first row.

    The batch form of :class:`timers.CacheTimer`. Series are cut where gaps exceed ``keep_us``, as nothing is remembered there,
    and pieces are folded one by one. With ``compat`` the first row records no state, so one repeat passes.
    """
    us = order[0]

    def step(left: dict | None, row: dict) -> tuple[dict, bool]:
        if left is None or row[us] - left["first"] > keep_us:
            return {"first": row[us], "state": None if compat else row[state]}, True
        return left | {"state": row[state]}, row[state] != left["state"]

    return passing(pieces(rows, by, us, keep_us + 1, slice_us), [*by, "_piece"], order, step, [us, state]).drop("_piece")


def severity_summary(alerts: DataFrame) -> DataFrame:
    """Alerts of each severity, and the newest of them."""
    return alerts.groupBy("severity").agg(F.count("*").alias("alerts"), F.max("us").alias("last_us"), F.max_by("id", F.struct("us", "id")).alias("last_id"))


def silenced_by_pattern(alerts: DataFrame, silences: list[tuple[str, bool, int, int]], field: str = "fingerprint", keep: bool = False) -> DataFrame:
    """:func:`silenced` by texts ``(pattern, is_regex, starts_us, ends_us)``: part of the field, or a regular expression found in it.

    The list becomes one condition, so nothing is joined.
    """
    cover = F.lit(False)
    for pattern, regex, starts, ends in silences:
        hit = F.col(field).rlike(pattern) if regex else F.contains(F.col(field), F.lit(pattern))
        cover = cover | (hit & (F.col("us") >= starts) & (F.col("us") < ends))
    cover = F.coalesce(cover, F.lit(False))
    return alerts.where(cover if keep else ~cover)


def label_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of two label maps' pairs; 1 for two empty ones."""
    x, y = (F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])) for m in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(1.0)


def time_similarity(a: Column, b: Column, window_us: int) -> Column:
    """1 for equal times, falling to 0 at the window's width."""
    return F.greatest(1 - F.abs(a - b) / window_us, F.lit(0.0))


def text_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def common_labels(alerts: DataFrame, by: list[str]) -> DataFrame:
    """The label pairs that all alerts of a group have, as sorted ``k=v`` texts."""
    sizes = alerts.groupBy(*by).agg(F.count("*").alias("_size"))
    pairs = alerts.select(*by, F.explode(F.map_entries("labels")).alias("e")).groupBy(*by, "e").agg(F.count("*").alias("_n"))
    held = pairs.join(sizes, by).where("_n = _size").select(*by, F.concat("e.key", F.lit("="), "e.value").alias("_pair"))
    lists = held.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("_pair")), ",").alias("common"))
    return sizes.join(lists, by, "left").select(*by, F.col("_size").alias("size"), F.coalesce("common", F.lit("")).alias("common"))
