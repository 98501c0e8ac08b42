"""URL verdicts from rules and from trust that spreads over the links between hosts, with DataFrame operations only."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, checkpointed, dealt, partitions, spread_join

#: (verdict, host, path): the rules of the production query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Up to this many hosts, with their few rules and two ranks each, are broadcast.
BROADCAST_HOSTS = 50_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^/?#"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def host_edges(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """``src, dst, links``: links between different hosts, counted before they are shuffled."""
    linked = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))))
    edges = pages.where(F.col(host_col) != "").select(F.col(host_col).alias("src"), linked.alias("link"))
    edges = edges.select("src", lower_ascii(F.regexp_replace("link", "^(?i:https?:)?//", "")).alias("dst"))
    return edges.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, source: str, to: str, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank ``host, rank`` of seeds ``host, seed``: rank flows along ``source`` to ``to``.

    A host passes ``damping`` of its rank on, in proportion to link counts; rank of a host without such links ends
    there. Hosts that nothing reaches are left out. Only what a round adds is passed on in the next, and a host's rank is the sum of
    what it got. Rounds go on until they add at most ``tolerance`` of the seeds' sum in all; hosts whose share of that is
    smaller than an equal one don't pass it on. A round adds ``damping`` of the one before at most, so this ends. The
    links are dealt once, by the host that passes and for a hub by a salt; rounds join them where they lie.
    """
    parts = partitions(edges.sparkSession)
    salts = F.greatest(F.ceil(F.count("*") / HOT), F.lit(1)).cast("int")  # a hub's links are dealt over that many tasks
    total = checkpointed(edges.groupBy(F.col(source).alias("from")).agg(F.sum("links").alias("all"), F.count("*").alias("n"), salts.alias("salts")))
    flow = edges.select(F.col(source).alias("from"), F.col(to).alias("onto"), "links")
    flow = spread_join(flow, total, "from", "n", "onto").withColumn("salt", F.pmod(F.xxhash64("onto"), "salts").cast("int"))
    flow = flow.select("from", "salt", "onto", (F.col("links") / F.col("all") * damping).alias("part"))
    flow = dealt(flow, parts, "from", "salt")
    start = seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank"))
    added, got = start, [start]
    least = tolerance * (seeds.agg(F.sum("seed")).first()[0] or 0.0)
    moving = not edges.isEmpty()
    while moving:
        sent = added.join(total, F.col("host") == F.col("from")).select("from", "rank", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        passed = flow.join(sent, ["from", "salt"]).groupBy(F.col("onto").alias("host")).agg(F.sum(F.col("part") * F.col("rank")).alias("rank"))
        passed = checkpointed(passed)
        got.append(passed)
        n, mass = passed.agg(F.count("*"), F.sum("rank")).first()
        moving = n > 0 and mass > least
        added = passed.where(F.col("rank") > least / max(1, n))
    return reduce(DataFrame.unionByName, got).groupBy("host").agg(F.sum("rank").alias("rank"))


def with_hosts(pages: DataFrame, hosts: DataFrame, how: str, salt: int = 64) -> DataFrame:
    """Pages joined to one row a host: broadcast if the hosts are counted as few, else salted, so no host fills one task."""
    if hosts.count() <= BROADCAST_HOSTS:
        return pages.join(F.broadcast(hosts), "host", how)
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salt)).cast("int"))
    return salted.join(hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))), ["host", "salt"], how).drop("salt")


def judge(
    df: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, tolerance: float = 1e-9, ratio: float = 1.0,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for each row.

    A rule fits its host and subdomains if the path starts with the rule's; the longest wins (of equal length the first
    in code-point order). Without a rule the host decides: trust is personalised PageRank along links from hosts with
    allowed pages, distrust the same against links from hosts with blocked pages, both seeded by numbers of pages; a
    host is blocked if its distrust exceeds ``ratio`` times its trust, else allowed. Rules are joined to the distinct
    hosts' suffixes, so rule lists may be long, and the hosts' few rules and ranks to the pages by a broadcast of a
    checked size or a salted join, so a hot host's pages stay spread.

    Null URLs and URLs without ``://`` have empty host and path, match no rule and are allowed. Null html has no links.
    Repeated rows are judged alike. Empty tables give empty results; other columns are ignored.
    """
    spark = df.sparkSession
    url = F.col(url_col)
    pages = df.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = pages.select("host").distinct()
    table = spark.createDataFrame([(v, h, p, f"{h}{p}", len(h) + len(p)) for v, h, p in rules], "verdict string, end string, start string, rule string, length int")
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)  # a longer end of a host is no rule's
    ends = F.explode(F.array_distinct(F.array(*[F.substring_index("host", ".", -i) for i in range(1, labels + 1)])))
    fits = hosts.where("host <> ''").select("host", ends.alias("end")).join(table, "end")
    lists = fits.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("length"), "rule", "start", "verdict"))).alias("rules"))
    lists = checkpointed(lists)
    hit = F.try_element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(1))
    ruled = with_hosts(pages, lists, "inner").withColumn("hit", hit)
    counts = ruled.where("hit is not null").groupBy("host").agg(
        F.sum(F.when(F.col("hit.verdict") == "allow", 1.0).otherwise(0.0)).alias("good"), F.sum(F.when(F.col("hit.verdict") == "block", 1.0).otherwise(0.0)).alias("bad"))
    counts = checkpointed(counts)
    edges = checkpointed(host_edges(df.select(host_of(url).alias("h"), F.col(html_col).alias("x")), "h", "x"))
    trust = propagate(edges, counts.where("good > 0").select("host", F.col("good").alias("seed")), "src", "dst", damping, tolerance)
    distrust = propagate(edges, counts.where("bad > 0").select("host", F.col("bad").alias("seed")), "dst", "src", damping, tolerance)
    ranks = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    known = checkpointed(lists.join(ranks, "host", "full"))
    zero = F.lit(0.0)
    out = with_hosts(pages, known, "left").withColumns({"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)})
    out = out.withColumn("hit", hit)
    method = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "trust", "distrust")
