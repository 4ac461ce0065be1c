"""Allow and block rules over URLs as a sort-merge range join.

A host's canonical key is its labels in reverse order, each followed by a dot
(``example.org`` -> ``org.example.``). A rule's host and all its subdomains are then the keys in
``[key, key with its last dot raised to "/")``. Rule bounds and hosts are sorted together and
swept: at each bound the stack of active nested rules changes, and a host takes the stack
of the last bound before it. Distinct hosts are swept, not pages, and they are dealt over
salted groups that each hold all bounds of their top-level label, so no label is one group.

Defined results: a NULL url, or one without ``://``, has empty host and path and no rule;
repeated rules count once, of equal rules with both verdicts ``block`` wins; without a rule the
verdict is ``default``. The longest rule (host and path together) wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterbook.llm.common import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _top(key: Column) -> Column:
    return F.substring_index(key, ".", 1)


def rule_bounds(rules: DataFrame) -> DataFrame:
    """Bounds in key order with the stack of rules active from there on.

    ``rules``: host, path, action. A bound is (key, is_host = 0, stack); the stack holds the rules of
    the host itself and of all hosts above it.
    """
    cleaned = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action")
        .groupBy("host", "path")
        .agg(F.max("action").alias("action"))
        .withColumn("length", F.length("host") + F.length("path"))
    )
    of_host = cleaned.groupBy("host").agg(F.collect_list(F.struct("length", "host", "path", "action")).alias("own"))
    labels = F.split("host", r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    opened = of_host.select("host", F.posexplode(above).alias("up", "outer"))
    owned = of_host.select(F.col("host").alias("outer"), "own")
    stacks = (
        opened.join(owned, "outer")
        .groupBy("host")
        .agg(
            F.flatten(F.collect_list("own")).alias("stack"),
            F.flatten(F.collect_list(F.when(F.col("up") > 0, F.col("own")))).alias("below"),
        )
        .withColumn("key", host_key(F.col("host")))
    )
    closing = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    return stacks.select("key", "stack", _top(F.col("key")).alias("top")).unionByName(
        stacks.select(closing.alias("key"), F.col("below").alias("stack"), _top(F.col("key")).alias("top"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", salts: int = SALTS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path, NULL for none) and ``verdict``.

    Columns of ``pages`` with these names give way to the new ones.
    """
    host, path = url_parts(F.col(f"`{url}`"))
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"))
    hosts = judged.select("host").distinct().withColumn("key", host_key(F.col("host")))
    hosts = hosts.select(
        "host",
        "key",
        _top(F.col("key")).alias("top"),
        F.pmod(F.xxhash64("host"), F.lit(salts)).alias("salt"),
        F.lit(1).alias("is_host"),
    )
    bounds = rule_bounds(rules)
    marks = bounds.select(
        F.lit(None).cast("string").alias("host"),
        "key",
        "top",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"),
        F.lit(0).alias("is_host"),
        "stack",
    )
    events = hosts.withColumn("stack", F.lit(None).cast(bounds.schema["stack"].dataType)).unionByName(marks)
    # Of bounds with one key, a closing one comes first; the fuller stack is the opening one's.
    sweep = Window.partitionBy("top", "salt").orderBy("key", "is_host", F.size("stack"))
    swept = (
        events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep))
        .where("is_host = 1")
        .select("host", F.col("active").alias(fresh(judged, "active")))
    )
    active = F.col(fresh(judged, "active"))
    best = F.array_max(
        F.filter(active, lambda r: F.substring(F.col("path"), F.lit(1), F.length(r["path"])) == r["path"])
    )
    out = judged.join(swept, "host", "left").withColumn(fresh(judged, "best"), best)
    won = F.col(fresh(judged, "best"))
    return out.select(
        *[F.col(f"`{c}`") for c in own],
        "host",
        "path",
        F.concat(won["host"], won["path"]).alias("rule"),
        F.coalesce(won["action"], F.lit(default)).alias("verdict"),
    )
