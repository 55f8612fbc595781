"""URL filters: host-suffix and path-prefix expressions against hashed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The rules of the contract, as (host, path, action).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """A literal table, so that its size is known to the planner."""
    rows = ", ".join("({})".format(", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in rule)) for rule in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(host, path, action)")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased) and path (then up to ``?``, ``#``).

    Both are empty where the url is null or has no ``://``.
    """
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the rule of most characters wins, ties go to the longer host, then to block. Without one the
    verdict is ``default`` and the rule null. Each url is expanded into the host
    suffixes and path prefixes of the shapes that rules have (number of labels,
    path length: a few numbers, however many rules there are), the expressions meet
    the rules by the first 32 bits of their SHA-256, and the full digests confirm.
    Repeated rows are all judged. No rows give no rows; without rules the default
    holds. Null urls have an empty host and path. Other columns are ignored.
    """
    host, path = split_url(F.col(url_col))
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p).cast("binary"), 256)
    keyed = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        digest(F.col("host"), F.col("path")).alias("r_full"),
        F.concat("host", "path").alias("r_name"),
        F.col("action").alias("r_action"),
        F.char_length(F.concat("host", "path")).alias("r_len"),
        F.char_length("host").alias("r_host_len"),
    )
    keyed = keyed.withColumn("short", F.substring("r_full", 1, 8))
    # label counts (at most 127 in a DNS name) and path lengths of the rules: a few integers
    shapes = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("host", "\\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.char_length("path"))).alias("lengths"),
    ).first()
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.size(F.split("host", "\\."))
    suffixes = F.array_compact(
        F.array(*[F.when(labels >= n, F.substring_index("host", ".", -n)) for n in shapes["labels"]]).cast("array<string>")
    )
    prefixes = F.array_compact(
        F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in shapes["lengths"]]).cast("array<string>")
    )
    expressions = rows.withColumn("s", F.explode_outer(suffixes)).withColumn("p", F.explode_outer(prefixes)).withColumn("full", digest(F.col("s"), F.col("p")))
    found = expressions.withColumn("short", F.substring("full", 1, 8)).join(keyed, "short", "left")
    fits = F.col("full") == F.col("r_full")
    best = F.max(F.when(fits, F.struct("r_len", "r_host_len", (F.col("r_action") == "block").alias("b"), "r_name", "r_action"))).alias("best")
    return found.groupBy("rid", "page_id", "host", "path").agg(best).select(
        "page_id", "host", "path", F.col("best.r_name").alias("rule"), F.coalesce("best.r_action", F.lit(default)).alias("verdict")
    )
