"""Landed feed files as paper rows, and the text gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T

PAPER = "id string, title string, abstract string, authors array<string>, publication_year int, venue string, doi string, url string, citation_count int, source string, external_ids map<string,string>"

_WORK = (
    "id string, title string, abstract_inverted_index string, authorships array<struct<author:struct<display_name:string>>>, publication_year string, "
    "primary_location struct<source:struct<display_name:string>,landing_page_url:string>, open_access struct<oa_url:string>, doi string, ids map<string,string>, cited_by_count string"
)
_S2 = "paperId string, externalIds map<string,string>, title string, abstract string, authors array<struct<name:string>>, year string, venue string, url string, doi string, citationCount string"
_ENTRY = "id string, title string, summary string, published string, author array<struct<name:string>>, `arxiv:doi` string, `arxiv:journal_ref` string"


def count_or_null(x: Column) -> Column:
    """Whole numbers from 0; true and false, signs and fractions are none."""
    return F.when(F.trim(x).rlike(r"^\d{1,9}$"), F.trim(x)).cast("int")


def inverted_abstract(raw: Column) -> Column:
    """Text from a JSON object of token -> positions; the last token wins a shared position, null when none is valid."""
    index = F.from_json(raw, "map<string,array<string>>")
    pairs = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e: F.transform(F.filter(F.coalesce(e["value"], F.array().cast("array<string>")), lambda p: p.rlike(r"^\d{1,9}$")), lambda p: F.struct(p.cast("int").alias("at"), e["key"].alias("token"))),
        )
    )

    def joined(placed: Column) -> Column:
        """In order of position, then of entry: the last of each position stays."""
        after = F.slice(placed, F.lit(2), F.greatest(F.size(placed), F.lit(1)))
        tokens = F.zip_with(placed, after, lambda p, q: F.when(q.isNull() | (q["at"] != p["at"]), p["token"]))
        return F.when(F.size(placed) > 0, F.array_join(tokens, " "))

    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["at"].alias("at"), i.alias("i"), p["token"].alias("token"))))
    return F.get(F.transform(F.array(placed), joined), F.lit(0))  # bound to a variable, so that the payload is parsed once


def _names(people: Column, name) -> Column:
    trimmed = F.transform(F.coalesce(people, F.array()), lambda p: F.trim(name(p)))
    return F.filter(trimmed, lambda n: n.isNotNull() & (n != ""))


def _with(ids: Column, key: str, value: Column) -> Column:
    """The map with the key set; a null value leaves it as it is."""
    rest = F.map_filter(ids, lambda k, _: k != key)
    return F.when(value.isNull(), ids).otherwise(F.map_concat(rest, F.create_map(F.lit(key), value)))


def openalex_papers(works: DataFrame) -> DataFrame:
    """Paper rows of works of the first feed; rows without id or title are left out."""
    raw_id, title = T.blank_to_null(F.col("id")), T.blank_to_null(F.col("title"))
    short = F.element_at(F.split(F.regexp_replace(raw_id, "/+$", ""), "/"), -1)
    known = T.known_external_ids(F.col("ids"))
    doi = F.coalesce(T.norm_doi(F.col("doi")), F.try_element_at(known, F.lit("doi")))
    url = F.coalesce(
        T.blank_to_null(F.col("primary_location.landing_page_url")), T.blank_to_null(F.col("open_access.oa_url")), F.concat(F.lit("https://doi.org/"), doi), raw_id
    )
    return works.where(raw_id.isNotNull() & title.isNotNull() & (short != "")).select(
        F.concat(F.lit("openalex:"), short).alias("id"), title.alias("title"), inverted_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        _names(F.col("authorships"), lambda a: a["author"]["display_name"]).alias("authors"), count_or_null(F.col("publication_year")).alias("publication_year"),
        T.blank_to_null(F.col("primary_location.source.display_name")).alias("venue"), doi.alias("doi"), url.alias("url"),
        count_or_null(F.col("cited_by_count")).alias("citation_count"), F.lit("openalex").alias("source"), _with(_with(known, "openalex", short), "doi", doi).alias("external_ids"),
    )


def read_openalex(spark: SparkSession, path: str) -> DataFrame:
    """Pages of works: JSON objects with a ``results`` array, one object a line."""
    pages = spark.read.schema(f"results array<struct<{_struct(_WORK)}>>").json(path)
    return openalex_papers(pages.select(F.inline("results")))


def _struct(ddl: str) -> str:
    """A column list as the inside of a struct type."""
    return ",".join(":".join(part.split(" ", 1)) for part in ddl.split(", "))


def semantic_scholar_papers(records: DataFrame, *more: Column) -> DataFrame:
    """Paper rows of records of the second feed, and ``more`` of the records beside them; rows without id or title are left out."""
    paper_id, title = T.blank_to_null(F.col("paperId")), T.blank_to_null(F.col("title"))
    known = T.known_external_ids(F.col("externalIds"))
    doi = F.coalesce(T.norm_doi(F.col("doi")), F.try_element_at(known, F.lit("doi")))
    return records.where(paper_id.isNotNull() & title.isNotNull()).select(
        F.concat(F.lit("semantic_scholar:"), paper_id).alias("id"), title.alias("title"), T.blank_to_null(F.col("abstract")).alias("abstract"),
        _names(F.col("authors"), lambda a: a["name"]).alias("authors"), count_or_null(F.col("year")).alias("publication_year"), T.blank_to_null(F.col("venue")).alias("venue"),
        doi.alias("doi"), T.blank_to_null(F.col("url")).alias("url"), count_or_null(F.col("citationCount")).alias("citation_count"), F.lit("semantic_scholar").alias("source"),
        _with(_with(known, "semantic_scholar", paper_id), "doi", doi).alias("external_ids"), *more,
    )


def read_semantic_scholar(spark: SparkSession, path: str) -> DataFrame:
    return semantic_scholar_papers(spark.read.schema(f"data array<struct<{_struct(_S2)}>>").json(path).select(F.inline("data")))


def arxiv_papers(entries: DataFrame) -> DataFrame:
    """Paper rows of Atom entries; error entries and rows without id or title are left out."""
    title, raw_id = F.nullif(T.collapse(F.col("title")), F.lit("")), T.blank_to_null(F.col("id"))
    arxiv, doi = T.norm_arxiv(raw_id), T.norm_doi(F.col("`arxiv:doi`"))
    names = F.filter(F.transform(F.coalesce("author", F.array()), lambda a: T.collapse(a["name"])), lambda n: n.isNotNull() & (n != ""))
    year = F.regexp_extract(F.trim("published"), r"^(\d{4})", 1)
    return entries.where(title.isNotNull() & (title != "Error") & arxiv.isNotNull()).select(
        F.concat(F.lit("arxiv:"), arxiv).alias("id"), title.alias("title"), F.nullif(T.collapse(F.col("summary")), F.lit("")).alias("abstract"), names.alias("authors"),
        F.nullif(year, F.lit("")).cast("int").alias("publication_year"), F.nullif(T.collapse(F.col("`arxiv:journal_ref`")), F.lit("")).alias("venue"), doi.alias("doi"),
        raw_id.alias("url"), F.lit(None).cast("int").alias("citation_count"), F.lit("arxiv").alias("source"),
        _with(F.create_map(F.lit("arxiv"), arxiv), "doi", doi).alias("external_ids"),
    )


def read_arxiv(spark: SparkSession, path: str) -> DataFrame:
    return arxiv_papers(spark.read.format("xml").option("rowTag", "entry").schema(_ENTRY).load(path))


def clean_papers(papers: DataFrame) -> DataFrame:
    """Trimmed strings, no blank authors or identifiers, no negative counts; rows without id, title or source go."""
    ids = F.transform_keys(F.coalesce("external_ids", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(F.trim(k)))
    ids = F.map_filter(F.transform_values(ids, lambda _, v: F.trim(v)), lambda k, v: (k != "") & v.isNotNull() & (v != ""))
    return papers.select(
        *(F.trim(c).alias(c) for c in ("id", "title", "abstract")),
        F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a.isNotNull() & (a != "")).alias("authors"),
        F.col("publication_year").cast("int").alias("publication_year"), *(F.trim(c).alias(c) for c in ("venue", "doi", "url")),
        F.when(F.col("citation_count") >= 0, F.col("citation_count").cast("int")).alias("citation_count"), F.trim("source").alias("source"), ids.alias("external_ids"),
    ).where("id <> '' AND title <> '' AND source <> ''")


def union_feeds(feeds: dict[str, DataFrame | None]) -> tuple[DataFrame, DataFrame]:
    """All papers, and a row for each expected feed: papers, and a warning where it is missing.

    A missing feed never counts as one without results; all missing is an error.
    """
    landed = {k: v for k, v in feeds.items() if v is not None}
    if not landed:
        raise ValueError("all feeds are missing")
    papers = None
    for df in landed.values():
        papers = df if papers is None else papers.unionByName(df, allowMissingColumns=True)
    spark = papers.sparkSession
    names = ", ".join(f"('{k}', {str(k in landed).lower()})" for k in feeds)
    expected = spark.sql(f"SELECT * FROM VALUES {names} AS f(source, landed)")
    counts = papers.groupBy("source").agg(F.count("*").alias("papers"))
    report = expected.join(counts, "source", "left").select(
        "source", F.when(F.col("landed"), F.coalesce("papers", F.lit(0))).alias("papers"),
        F.when(~F.col("landed"), F.concat("source", F.lit(" was unavailable; results may be partial."))).alias("warning"),
    )
    return papers, report


def text_gate(docs: DataFrame, text_col: str = "text", least: int = 200, most: int = 250_000) -> DataFrame:
    """Columns n_text, n_alnum, reject_reason (null: readable) and content_sha256 beside the documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n, alnum = F.length(text), F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    reason = F.when(n > most, "too_long").when((n < least) | (alnum < max(20, least // 5)), "too_little_text")
    return docs.withColumns({"n_text": n, "n_alnum": alnum, "reject_reason": reason, "content_sha256": F.sha2(text.cast("binary"), 256)})
