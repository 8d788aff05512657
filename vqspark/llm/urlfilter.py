"""URL rules by hash prefixes: expressions of each URL meet the rules in an equi-join.

Every distinct (host, path) expands into those of its host suffixes that have as
many labels as some rule's host, times those beginnings of its path that are as
long as some rule's path. Expressions and rules meet on
four bytes of their SHA-256, the full digest confirms, and the longest rule wins.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
#: Rules up to this many (about 150 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    at = F.locate("://", url)
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _hashed(frame: DataFrame, expression: str) -> DataFrame:
    digest = F.sha2(expression, 256)
    return frame.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, 8))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains where
    the path starts with the rule's. The longest rule (host and path together)
    wins; of equally long ones the longer host, then ``block``. Without a rule,
    ``rule`` is null and the verdict ``default``. A null url, or one without
    ``://``, has empty host and path. Hosts and paths may be of any length. Empty hosts fit no rule; rules with nulls
    are ignored. Repeated rows and null ids are kept, other columns not looked at.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))

    known = rules.where("host <> '' and path is not null and verdict is not null")
    known = known.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict").distinct()
    known = _hashed(known, F.concat("r_host", F.lit("\n"), "r_path"))
    lengths = sorted(r.n for r in known.select(F.length("r_path").alias("n")).distinct().collect())  # as many as different lengths of paths in rules
    depths = sorted(r.n for r in known.select(F.size(F.split("r_host", r"\.")).alias("n")).distinct().collect())  # as many as different numbers of labels
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    places = own.where("host <> ''").select("host", "path").distinct()
    labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    fitting = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda n: n <= labels)
    suffixes = F.transform(fitting, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    cuts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    grown = places.select("host", "path", F.explode(suffixes).alias("suffix"), cuts.alias("cuts")).select("host", "path", "suffix", F.explode("cuts").alias("n"))
    grown = grown.withColumn("part", F.substring(F.col("path"), F.lit(1), F.col("n")))
    grown = _hashed(grown, F.concat("suffix", F.lit("\n"), "part")).select("host", "path", "prefix", F.col("digest").alias("own"))
    met = grown.join(F.broadcast(known) if few else known, "prefix").where("own = digest")
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("verdict") == "block", "r_host", "r_path", "verdict")
    won = met.groupBy("host", "path").agg(F.max(order).alias("x"))
    won = won.select("host", "path", F.concat("x.r_host", "x.r_path").alias("rule"), F.col("x.verdict").alias("verdict"))
    judged = own.join(won, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given in code as ``(host, path, verdict)``."""
    return spark.createDataFrame([Row(host=h, path=p, verdict=v) for h, p, v in rules], "host string, path string, verdict string")
