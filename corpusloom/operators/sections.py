"""Sectioning of document text, bounded selection, and evidence validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from .upsert import check_parents, upsert_snapshot

#: Section names in order, and the headings that stand for them.
SECTIONS = {
    "Abstract": ["abstract"],
    "Introduction": ["introduction"],
    "Related Work": ["related work", "background", "literature review"],
    "Method": ["method", "methods", "methodology", "proposed method", "approach", "materials and methods", "material and methods"],
    "Experiments": ["experiment", "experiments", "experimental setup", "experimental settings", "evaluation", "evaluations", "implementation details"],
    "Results": ["result", "results", "findings"],
    "Discussion": ["discussion"],
    "Limitations": ["limitation", "limitations"],
    "Conclusion": ["conclusion", "conclusions", "concluding remarks"],
    "References": ["reference", "references", "bibliography"],
}
#: Sections that are of use to a reader; all but the references.
USEFUL = [name for name in SECTIONS if name != "References"]
INLINE = r"^(.{1,100}?)\s*[:\-–—]\s+(.+)$"


def normalized_line(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t\f\x0B]+", " "))


def normalized_heading(x: Column) -> Column:
    """A heading without its number and trailing punctuation; ASCII headings need no folding beyond lower case."""
    bare = F.regexp_replace(F.lower(F.trim(x)), r"^((\d+(\.\d+)*)|([ivxlcdm]+))[\s.)\-:]+", "")
    return normalized_line(F.regexp_replace(bare, r"[.:;\-–—]+$", ""))


def section_name(x: Column) -> Column:
    """The canonical name of a heading, else null."""
    names = F.create_map(*[F.lit(v) for name, aliases in SECTIONS.items() for alias in aliases for v in (alias, name)])
    return F.try_element_at(names, normalized_heading(x))


def section_order(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SECTIONS)), name)


#: Where a text is cut into lines, as Python's splitlines does.
BREAKS = "\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def detect_sections(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, ord, section, body): the first heading of each name opens a section, which goes on to the next opened one.

    Texts are taken in compatibility form. A text's lines stay together in its row: no more than one row
    for each section leaves it, and nothing is shuffled.
    """
    lines = docs.select(F.col(key).alias("doc"), T.nfkc(F.col(text_col)).alias("t"))
    lines = lines.select("doc", F.transform(F.split("t", BREAKS), normalized_line).alias("lines"))
    lead = lambda x: F.when(x.rlike(r"[:\-–—]\s"), section_name(F.regexp_extract(x, INLINE, 1)))
    name = lambda x: F.when(x != "", F.coalesce(section_name(x), lead(x)))
    named = lines.withColumn("names", F.transform("lines", name))
    at = lambda section: F.array_position("names", F.lit(section)).cast("int")
    first = [F.when(at(x) > 0, F.struct(at(x).alias("pos"), F.lit(i + 1).alias("ord"), F.lit(x).alias("section"))) for i, x in enumerate(SECTIONS)]
    opened = named.select("doc", "lines", F.array_sort(F.array_compact(F.array(*first))).alias("opened"))
    rows = opened.select("doc", "lines", F.col("opened.pos").alias("starts"), "opened")

    def section(o: Column, i: Column) -> Column:
        head = F.element_at("lines", o["pos"])
        inline = F.when(section_name(head).isNull(), normalized_line(F.regexp_extract(head, INLINE, 2)))
        end = F.coalesce(F.get("starts", i + 1), F.size("lines") + 1)
        parts = F.concat(F.array_compact(F.array(inline)), F.slice("lines", o["pos"] + 1, end - o["pos"] - 1))
        return F.struct(o["ord"].alias("ord"), o["section"].alias("section"), F.array_join(F.filter(parts, lambda x: x != ""), "\n").alias("body"))

    # outer, else the optimizer takes what the array is made of into a filter below it, once for each place where it is used
    return rows.select("doc", F.inline_outer(F.transform("opened", section))).where("body <> ''")


def excerpt(x: Column, limit: Column) -> Column:
    """At most ``limit`` characters, cut at a space if one stands in the second half, with an ellipsis."""
    x = F.trim(x)
    head = F.substr(x, F.lit(1), F.greatest(F.lit(1), limit - 1))
    # the last space before the cut, counted from 0
    space = F.length(head) - F.locate(" ", F.reverse(head))
    space = F.when(F.locate(" ", F.reverse(head)) > 0, space).otherwise(F.lit(-1))
    cut = F.when(space > F.floor(limit / 2), F.rtrim(F.substr(head, F.lit(1), space))).otherwise(F.rtrim(head))
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(cut, F.lit("…")))


def select_sections(docs: DataFrame, sections: DataFrame, key: str = "doc_id", text_col: str = "text", most: int = 24_000, per_section: int = 6_000) -> DataFrame:
    """(doc, ord, section, excerpt): useful sections in order, each reserving its share of the budget.

    A section reserves min(what is left, per_section) whether it fills it or not, so its
    share follows from its place alone. A document without sections gives one labelled excerpt.
    """
    useful = sections.where(F.col("section").isin(USEFUL) & (F.trim("body") != ""))
    nth = F.row_number().over(W.partitionBy("doc").orderBy("ord"))
    share = F.least(F.lit(per_section), F.lit(most) - (F.col("nth") - 1) * per_section)
    chosen = useful.withColumn("nth", nth).withColumn("share", share).where("share > 0").select("doc", "ord", "section", excerpt(F.col("body"), F.col("share")).alias("excerpt"))
    # a text has ten sections at most; with them in one row, the sections are worked out once
    by_doc = chosen.groupBy("doc").agg(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), "section", "excerpt")).alias("chosen"))
    joined = docs.select(F.col(key).alias("doc"), F.col(text_col).alias("t")).join(by_doc, "doc", "left")
    whole = F.when(F.trim("t") != "", F.array(F.struct(F.lit(0).alias("ord"), F.lit("Unsectioned excerpt").alias("section"), excerpt(F.col("t"), F.lit(min(most, per_section))).alias("excerpt"))))
    return joined.select("doc", F.inline(F.coalesce("chosen", whole)))


def validate_evidence(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """Claims whose place can't be verified lose section and quote; others get the section's canonical name.

    ``claims`` has doc, claim, source_section and supporting_text; ``sections`` has
    doc, section and body. A quote has to occur in its section up to case and white space.
    """
    norm = lambda x: T.collapse(T.nfkc_casefold(x))
    bodies = sections.where(F.trim("body") != "").select("doc", F.col("section").alias("name"), norm(F.col("body")).alias("body"))
    named = claims.withColumn("name", section_name(F.col("source_section"))).withColumn("quote", norm(F.col("supporting_text")))
    joined = named.join(bodies, ["doc", "name"], "left")
    holds = F.col("body").isNotNull() & (F.col("quote").isNull() | F.contains(F.col("body"), F.col("quote")))
    rest = [c for c in claims.columns if c not in ("source_section", "supporting_text")]
    return joined.select(
        *rest, F.when(F.col("source_section").isNotNull() & holds, F.col("name")).alias("source_section"), F.when(F.col("source_section").isNotNull() & holds, F.col("supporting_text")).alias("supporting_text")
    )


def upsert_cards(cards: DataFrame, incoming: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next snapshot of cards, and incoming cards of unknown papers. Where a text came from is only overwritten when given."""
    accepted, rejected = check_parents(incoming, {"paper_id": (papers, "id")})
    accepted = accepted.withColumn("selected_sections", F.array_distinct("selected_sections"))
    return upsert_snapshot(cards, accepted, ["paper_id"]), rejected
