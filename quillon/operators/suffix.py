"""Registrable domains by a table of public-suffix rules.

Rules have the usual text format: a suffix, ``*.`` before one for all its labels, ``!`` before an
exception to that, comments behind ``//``. The longest rule that matches decides, an exception before all; where
none does the suffix is the last label. Hosts and rules meet in a join of hosts' endings with rules,
each distinct host once, so a list of any length will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import url as U

#: Rules up to which they go to every task; a rule has at most 255 characters.
SENT = 30_000


def rules_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """(base, kind) of lines of a rule file: kind is plain, wild or exception; base has no mark."""
    text = F.lower(F.regexp_extract(F.trim(F.regexp_replace(column, "//.*$", "")), r"^\S*", 0))
    rules = lines.select(F.regexp_replace(text, r"^\.+|\.+$", "").alias("rule")).where("rule <> ''")
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wild").otherwise("plain")
    return rules.select(F.regexp_replace("rule", r"^(!|\*\.)", "").alias("base"), kind.alias("kind")).distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return rules_of(spark.read.text(path))


def _named(host: Column) -> Column:
    """Whether a host is made of names: no address, no single label."""
    return (F.size(F.split(host, r"\.")) > 1) & ~host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~host.startswith("[") & ~host.rlike(r"\.\.|^\.")


def registrable_domains(rows: DataFrame, rules: DataFrame, url: str = "url", out: str = "etld1") -> DataFrame:
    """``rows`` with the public suffix of their URL's host and one label more; empty where there is none:
    for addresses, single labels, hosts that are a suffix themselves, and nulls."""
    host = F.regexp_replace(U.host(F.coalesce(F.col(url), F.lit(""))), r"\.+$", "")
    labels, k = F.split("host__", r"\."), F.col("k")
    hosts = rows.select(host.alias("host__")).distinct().where(_named(F.col("host__")))
    ends = hosts.withColumn("n", F.size(labels)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    ends = ends.withColumn("base", F.array_join(F.slice(labels, F.col("n") - k + 1, k), "."))
    rules = rules if rules.count() > SENT else F.broadcast(rules)
    # a wild rule takes one label more than its base, an exception one less than itself
    taken = F.when(F.col("kind") == "wild", k + 1).when(F.col("kind") == "plain", k)
    met = ends.join(rules, "base").groupBy("host__").agg(F.max(F.when(taken <= F.col("n"), taken)).alias("most"), F.max(F.when(F.col("kind") == "exception", k - 1)).alias("except"))
    size = F.coalesce("except", "most", F.lit(1))
    found = hosts.join(met, "host__", "left").withColumn("n", F.size(labels)).withColumn("size", size)
    found = found.select("host__", F.when(F.col("n") > F.col("size"), F.array_join(F.slice(labels, F.col("n") - F.col("size"), F.col("size") + 1), ".")).otherwise("").alias(out))
    return rows.withColumn("host__", host).join(found, "host__", "left").withColumn(out, F.coalesce(out, F.lit(""))).drop("host__")
