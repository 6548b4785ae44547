"""URL rules by a sort-merge sweep over reversed-host keys (native Spark SQL only).

A rule (host, path) fits a URL whose host is the rule's host or below it and whose path starts
with the rule's. With labels reversed, "host or below" is a prefix, and all keys that share a
prefix form an interval. So URLs and rules are sorted together by key and swept once: the last
rule passed carries the stack of all rules that enclose it, and every rule that encloses the URL
is on that stack (any key between a prefix and a key that has it shares the prefix). A first sweep
finds the enclosing rule hosts, a second one, within each of them, the enclosing paths.

Both sweeps run within salts of the URLs (a hash of the row), so a host with a third of all URLs
is spread evenly. Rule events, the small side, are repeated once for each salt.

Defined results: a null URL, or one without ``://``, has an empty host and path and gets the
default verdict; repeated rows give repeated rows; without rules everything gets the default;
rules with a null or empty host are ignored; of equally long rules the one with the longer host
wins; of the same rule given twice, ``block`` wins. Columns other than ``page_id`` and ``url`` are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "rule_host string, rule_path string, verdict string"
#: Rules above this many are refused: their events are repeated for each salt.
MAX_RULES = 2_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def reversed_key(host: Column) -> Column:
    """``www.example.com`` -> ``com.example.www.``: all hosts below a host share its key as a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _stacks(starts: DataFrame, by: list[str]) -> DataFrame:
    """Each start with the stack of starts of the same ``by`` that are its prefixes, itself included.

    ``starts``: by..., key, distinct. All prefixes of a key are probed by an equi join.
    """
    probes = starts.select(*by, F.col("key").alias("of"), F.explode(F.expr("transform(sequence(0, length(key)), i -> substring(key, 1, i))")).alias("key"))
    return probes.join(starts, [*by, "key"]).groupBy(*by, "of").agg(F.array_sort(F.collect_list("key")).alias("stack")).withColumnRenamed("of", "key")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    spark = pages.sparkSession
    n_rules = rules.count()
    if n_rules > MAX_RULES:
        raise ValueError(f"{n_rules} rules; split the list, at most {MAX_RULES} a call")
    salts = 2 * width(spark)
    rules = (
        rules.select(F.translate("rule_host", UPPER, LOWER).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .where("rule_host <> ''")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("host_key", reversed_key(F.col("rule_host")))
    )
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")

    host, path = host_and_path(F.col("url"))
    urls = (
        pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
        .withColumns({"host": host, "path": path})
        .select("page_id", "url", "copies", "host", "path", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"))
    )
    nothing = F.lit(None).cast("array<string>")

    # Sweep 1: which rule hosts enclose the URL's host.
    hosts = _stacks(rules.select(F.col("host_key").alias("key")).distinct(), [])
    events = hosts.select(every_salt, "key", "stack")
    rows = urls.select("salt", reversed_key(F.col("host")).alias("key"), "page_id", "url", "copies", "host", "path", F.lit(1).alias("is_url"))
    swept = events.withColumn("is_url", F.lit(0)).unionByName(rows.withColumn("stack", nothing), allowMissingColumns=True)
    order = Window.partitionBy("salt").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("top", F.last("stack", ignorenulls=True).over(order)).where("is_url = 1")
    active = swept.select("salt", "page_id", "url", "copies", "host", "path", F.explode_outer(F.expr("filter(top, h -> startswith(key, h))")).alias("host_key"))

    # Sweep 2: within each enclosing rule host, which of its paths are prefixes of the URL's path.
    paths = _stacks(rules.select("host_key", F.col("rule_path").alias("key")), ["host_key"])
    events = paths.select(every_salt, "host_key", "key", "stack")
    rows = active.select("salt", "host_key", F.col("path").alias("key"), "page_id", "url", "copies", "host", "path", F.lit(1).alias("is_url"))
    swept = events.withColumn("is_url", F.lit(0)).unionByName(rows.withColumn("stack", nothing), allowMissingColumns=True)
    order = Window.partitionBy("salt").orderBy("host_key", "key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("last_rule", F.last(F.when(F.col("is_url") == 0, F.struct("host_key", "stack")), ignorenulls=True).over(order)).where("is_url = 1")
    fits = F.expr("filter(last_rule.stack, p -> startswith(path, p))")
    best = swept.withColumn("rule_path", F.when(F.col("last_rule.host_key") == F.col("host_key"), F.element_at(F.when(F.size(fits) > 0, fits), -1)))
    choice = F.when(F.col("rule_path").isNotNull(), F.struct((F.length("host_key") + F.length("rule_path")).alias("n"), F.length("host_key").alias("m"), "host_key", "rule_path"))
    judged = best.groupBy("page_id", "url", "host", "path", "copies").agg(F.max(choice).alias("hit"))
    verdicts = rules.select(F.col("host_key").alias("k"), F.col("rule_path").alias("p"), "rule_host", "rule_verdict")
    out = judged.join(verdicts, (F.col("hit.host_key") == F.col("k")) & (F.col("hit.rule_path") == F.col("p")), "left")
    return out.select(
        "page_id", "host", "path",
        F.when(F.col("hit").isNotNull(), F.concat("rule_host", "p")).alias("rule"),
        F.coalesce("rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    ).drop("copy")
