"""URL filters by hashed host-suffix and path-prefix expressions (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the digest that the join uses; the rest is compared afterwards.
PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query, (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def with_host_path(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    url = F.coalesce("url", F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), locate('://', coalesce(url, '')) + 3)")).otherwise("")
    host = F.regexp_extract(F.col("rest"), r"^[^/?#]*", 0)
    tail = F.expr("substring(rest, length(raw_host) + 1)")
    return (
        pages.select("page_id", "url", rest.alias("rest"))
        .withColumn("raw_host", host)
        .select(
            "page_id",
            "url",
            F.translate("raw_host", UPPER, LOWER).alias("host"),
            F.regexp_extract(tail, r"^[^?#]*", 0).alias("path"),
        )
    )


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    Each distinct address is expanded into (suffix of its host at a label boundary) x (prefix of its path), both of
    lengths that some rule has, so a very long host or path gives no more expressions than a short one. The
    expressions are joined to the rules on the first digits of a SHA-256, and full digests are compared. The longest rule wins, then the longer host, then block, then the smaller
    string. Without a rule the verdict is ``default``. A null url, or one without ://, has an empty host and
    path and meets no rule with a host; repeated pages each get a row; no pages give no rows; rules with a null
    field are ignored. Only page_id and url are read, so names of other columns may clash. Distinct lengths of rule
    hosts and paths are the one thing that is collected: they are bounded by the longest of each.
    """
    rules = rules.dropna(subset=["verdict", "host", "path"]).dropDuplicates(["host", "path", "verdict"])
    host_lengths, path_lengths = (sorted(r[0] for r in rules.select(F.length(c)).distinct().collect()) for c in ("host", "path"))
    digest = F.sha2(F.concat("host", F.lit("\u0000"), "path"), 256)
    keyed = rules.select(
        F.substring(digest, 1, PREFIX_DIGITS).alias("short"),
        digest.alias("digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            (F.col("verdict") == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("hit"),
    )
    parsed = with_host_path(pages)
    address = parsed.select("host", "path").distinct()
    numbers = lambda found: F.array(*[F.lit(n) for n in found]) if found else F.expr("cast(array() as array<int>)")
    at_label = lambda n: (n == F.length("host")) | ((n < F.length("host")) & (F.col("host").substr(F.length("host") - n, F.lit(1)) == "."))
    expressions = (
        address.filter("host != ''")
        .withColumn("tail", F.explode_outer(F.filter(numbers([n for n in host_lengths if n]), at_label)))
        .withColumn("size", F.explode_outer(F.filter(numbers(path_lengths), lambda n: n <= F.length("path"))))
        .withColumn("suffix", F.expr("right(host, tail)"))
        .withColumn("digest", F.sha2(F.expr("concat(suffix, '\\0', left(path, size))"), 256))
        .select("host", "path", F.substring("digest", 1, PREFIX_DIGITS).alias("short"), "digest")
    )
    hits = (
        expressions.join(keyed.withColumnRenamed("digest", "rule_digest"), "short")
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max("hit").alias("hit"))
    )
    return parsed.join(hits, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
    )
