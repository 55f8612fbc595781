"""Keyed snapshot upserts, shared by every memory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .components import cut_lineage, few


def richer(a: Column, b: Column) -> Column:
    """The longer of two texts by trimmed length; the first of equals; whichever is there."""
    return F.when(F.coalesce(F.length(a), F.lit(0)) == 0, F.coalesce(b, a)).when(F.length(F.trim(b)) > F.length(F.trim(a)), b).otherwise(a)


def _ruled(rule: str, old: Column, new: Column) -> Column:
    if rule == "keep":
        return F.coalesce(old, new)
    if rule == "replace":
        return F.coalesce(new, old)
    if rule == "min":
        return F.least(old, new)
    if rule == "max":
        return F.greatest(old, new)
    if rule == "richer":
        return richer(old, new)
    if rule == "longer":
        return F.when(F.size(F.coalesce(new, F.array())) > F.size(F.coalesce(old, F.array())), new).otherwise(F.coalesce(old, new))
    raise ValueError(f"unknown rule {rule!r}")


def upsert_snapshot(base: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, str] | None = None, order: str = "ord", now: str = "updated_at") -> DataFrame:
    """The next snapshot: incoming rows inserted or patched onto ``base`` by key.

    Of incoming rows with one key the last by ``order`` counts. Only values that are
    given overwrite (``replace``); other rules are keep, min, max, richer and
    longer. ``created_at`` keeps the first value and ``updated_at`` the latest. Rows without a full key are left out.
    """
    rules = {"created_at": "keep", now: "max"} | (rules or {})
    columns = [c for c in base.columns if c not in keys]
    given = [c for c in incoming.columns if c in columns]
    keyed = incoming.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)))
    last = keyed.groupBy(*keys).agg(F.max_by(F.struct(*given), F.col(order)).alias("__new")) if given else keyed.select(*keys).distinct().withColumn("__new", F.struct())
    old = base.select(*keys, F.struct(*columns).alias("__old"))
    return old.join(last, keys, "full_outer").select(
        *keys, *(_ruled(rules.get(c, "replace"), F.col(f"__old.{c}"), F.col(f"__new.{c}")).alias(c) if c in given else F.col(f"__old.{c}").alias(c) for c in columns)
    )


def upsert_partitions(path: str, incoming: DataFrame, keys: list[str], partition: list[str], rules: dict[str, str] | None = None, order: str = "ord", now: str = "updated_at") -> DataFrame:
    """``upsert_snapshot`` onto a table stored by ``partition`` columns, in place: only partitions that ``incoming`` touches are read and written.

    A key stays in its partition: (partition, keys) is what rows are known by. The touched partitions are few rows, so they prune the scan as it
    runs; their next state is stored aside before it replaces them (dynamic partition overwrite), so a job that stops can be run again.
    Returns the touched partitions.
    """
    spark = incoming.sparkSession
    base = spark.read.parquet(path)
    touched = cut_lineage(incoming.select(*partition).distinct())
    old = base.join(few(touched, F.lit(64)), partition, "left_semi")
    after = cut_lineage(upsert_snapshot(old, incoming, [*partition, *keys], rules, order, now).select(*base.columns))
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
    return touched


def check_parents(rows: DataFrame, parents: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows whose parents all exist, and the others with the reason. ``parents``: column -> (table, its key)."""
    marked = rows.withColumn("__missing", F.array().cast("array<string>"))
    for column, (table, key) in parents.items():
        known = table.select(F.col(key).alias("__key")).distinct().withColumn("__known", F.lit(True))
        marked = marked.join(known, F.col(column) == F.col("__key"), "left")
        marked = marked.withColumn("__missing", F.when(F.col("__known").isNull(), F.array_append("__missing", F.lit(f"unknown {column}"))).otherwise(F.col("__missing"))).drop("__key", "__known")
    return marked.where(F.size("__missing") == 0).drop("__missing"), marked.where(F.size("__missing") > 0).withColumn("reason", F.array_join("__missing", "; ")).drop("__missing")


def check_unique(rows: DataFrame, name: Column) -> DataFrame:
    """Normalized names that more than one row has, with their number."""
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def cascade_delete(children: dict[str, tuple[DataFrame, str]], removed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each child table without the rows of removed parents. ``children``: name -> (table, its column)."""
    gone = removed.select(F.col(key).alias("__gone")).distinct()
    return {name: table.join(gone, F.col(column) == F.col("__gone"), "left_anti") for name, (table, column) in children.items()}
