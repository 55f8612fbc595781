"""Dictionary joins by substring: which texts hold which entries of a table, and what that is used for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .components import cut_lineage, few

#: Characters of the runs that texts and entries meet by; shorter entries meet as a whole.
GRAM = 6


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters, told in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def find_entries(texts: DataFrame, entries: DataFrame, text_id: str = "id", text: str = "text", entry: str = "entry") -> DataFrame:
    """(text_id, entry): every pair of a text and an entry that it holds as a substring, once.

    An entry is looked for by the one of its runs of ``GRAM`` characters that the fewest texts have, as counted over all texts; only texts with
    that run are compared. Runs that no entry has are dropped where the text is read, while the entries' runs are few (counted in bytes).
    Null texts, rows without an id and null or empty entries are left out; repeated rows and entries count once; texts are read whole.
    """
    rows = texts.select(F.col(text_id).alias("__id"), F.col(text).alias("__text")).where("__id IS NOT NULL AND __text IS NOT NULL")
    known = cut_lineage(entries.select(F.col(entry).alias("__entry")).where(F.length("__entry") > 0).distinct())
    size = F.least(F.length("__entry"), F.lit(GRAM))
    sizes = sorted(r["n"] for r in known.select(size.alias("n")).distinct().collect())  # GRAM numbers at most
    if not sizes:
        return rows.where(F.lit(False)).select(F.col("__id").alias(text_id), F.lit(None).cast("string").alias(entry))
    own = F.coalesce(*[F.when(size == n, _grams(F.col("__entry"), n)) for n in sizes])
    parts = cut_lineage(known.select("__entry", F.explode(own).alias("gram")))
    wanted = parts.select("gram").distinct()
    spread = rows.select("__id", F.explode(F.concat(*[_grams(F.col("__text"), n) for n in sizes])).alias("gram"))
    met = cut_lineage(spread.join(few(wanted, F.octet_length("gram")), "gram", "left_semi"))
    counts = met.groupBy("gram").agg(F.count("*").alias("n"))
    held = parts.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # a run that no text has rules its entry out
    anchors = held.groupBy("__entry").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.min("n").alias("n")).where("n > 0").drop("n")
    likely = cut_lineage(met.join(few(anchors, F.octet_length("gram") + F.octet_length("__entry")), "gram").select("__id", "__entry").distinct())
    pairs = rows.join(few(likely, F.octet_length("__entry")), "__id").where(F.contains("__text", "__entry"))
    return pairs.select(F.col("__id").alias(text_id), F.col("__entry").alias(entry)).distinct()


def first_entry(values: DataFrame, entries: DataFrame, value: str = "value", entry: str = "entry", nth: str = "nth") -> DataFrame:
    """(value, clean, entry): of each distinct value the first entry by ``nth`` that holds it or is held by it, else the value itself.

    Values are trimmed and lower-cased (``clean``), entries are taken as they are; of one entry given twice the lower ``nth`` counts. Both
    directions are one substring join each. Null and blank values are left out.
    """
    said = values.select(F.col(value).alias("value"), F.lower(F.trim(value)).alias("clean")).where("clean <> ''").distinct()
    told = cut_lineage(entries.select(F.col(entry).alias("entry"), F.col(nth).alias("nth")).where(F.length("entry") > 0).groupBy("entry").agg(F.min("nth").alias("nth")))
    clean = cut_lineage(said.select("clean").distinct())
    holding = find_entries(clean.withColumn("text", F.col("clean")), told, "clean")
    held = find_entries(told.withColumn("text", F.col("entry")), clean, "entry", "text", "clean").select("clean", "entry")
    best = holding.unionByName(held).join(few(told, F.octet_length("entry")), "entry").groupBy("clean").agg(F.min_by("entry", F.struct("nth", "entry")).alias("entry"))
    return said.join(best, "clean", "left").select("value", "clean", F.coalesce("entry", "clean").alias("entry"))


def scan_phrases(texts: DataFrame, phrases: DataFrame, text_id: str, source: str, text: str, phrase: str = "phrase") -> DataFrame:
    """(source, phrase, texts): how many texts of a source hold each phrase of a table, whatever the case; ``gaps.scan_claims`` for any number of phrases.

    ``text_id`` is the texts' own; a source that is null is one like others.
    """
    low = texts.select(F.col(text_id).alias("__of"), F.lower(text).alias("text"))
    hits = find_entries(low, phrases.select(F.lower(phrase).alias("phrase")), "__of", "text", "phrase")
    of = texts.select(F.col(text_id).alias("__of"), F.col(source).alias("source"))
    return of.join(hits, "__of").groupBy("source", "phrase").agg(F.count("*").alias("texts"))
