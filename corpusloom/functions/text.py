"""Text normalization and the five tokenizers, as column expressions.

Only Unicode NFKC/NFKD with full case folding has no built-in function; it runs as
one Arrow UDF at the point where a column is first normalized, and only texts with
other than ASCII characters are sent to it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Words left out of limitation statements.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with"]


@F.pandas_udf(StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _nfkd_lower(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).lower())


def _beyond_ascii(x: Column) -> Column:
    return F.when(F.octet_length(x) != F.length(x), x)


def nfkc_casefold(x: Column) -> Column:
    return F.coalesce(_nfkc_casefold(_beyond_ascii(x)), F.lower(x))


def nfkc(x: Column) -> Column:
    return F.coalesce(_nfkc(_beyond_ascii(x)), x)


def nfkd_lower(x: Column) -> Column:
    return F.coalesce(_nfkd_lower(_beyond_ascii(x)), F.lower(x))


def collapse(x: Column) -> Column:
    """White-space runs of any kind become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", F.trim(x))


def norm_title(x: Column) -> Column:
    """Dedup form of a title: folded, everything but word characters and white space to spaces."""
    return collapse(F.regexp_replace(nfkc_casefold(x), r"(?U)[^\w\s]", " "))


def norm_title_stored(x: Column) -> Column:
    """Stored form of a title: folded, punctuation of any category P to spaces."""
    return collapse(F.regexp_replace(nfkc_casefold(x), r"\p{P}", " "))


def title_identity(normalized: Column) -> Column:
    """Very short titles are no identity."""
    return F.when(F.length(normalized) >= 8, normalized)


def norm_doi(x: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(x), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))
    return F.nullif(F.lower(F.regexp_replace(bare, r"[/.,;]+$", "")), F.lit(""))


def norm_doi_stored(x: Column) -> Column:
    """As ``norm_doi`` after NFKC; both prefixes may stand one after the other."""
    bare = F.regexp_replace(F.trim(nfkc(x)), r"(?i)^https?://(dx\.)?doi\.org/", "")
    bare = F.trim(F.regexp_replace(bare, r"(?i)^doi:\s*", ""))
    return F.nullif(F.lower(F.regexp_replace(bare, r"[/.,;]+$", "")), F.lit(""))


def norm_arxiv(x: Column) -> Column:
    """The bare identifier without version; archive/number forms keep their archive."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(x), r"(?i)^arxiv:\s*", ""), "/+$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/*([^?#]*)", 1), "/+$", ""), "^(abs/|pdf/)", "")
    bare = F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), path).otherwise(bare)
    bare = F.regexp_replace(F.regexp_replace(bare, r"\.pdf$", ""), "^/+|/+$", "")
    legacy = r"(?i)^([a-z][a-z.-]+)/(\d{7})(v\d+)?$"
    old = F.concat(F.lower(F.regexp_extract(bare, legacy, 1)), F.lit("/"), F.regexp_extract(bare, legacy, 2))
    new = F.regexp_replace(F.element_at(F.split(bare, "/"), -1), r"(?i)v\d+$", "")
    return F.nullif(F.when(bare.rlike(legacy), old).otherwise(new), F.lit(""))


def norm_arxiv_stored(x: Column) -> Column:
    bare = F.regexp_replace(F.trim(nfkc(x)), r"(?i)^https?://arxiv\.org/(abs|pdf)/", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)^arxiv:\s*", ""), r"\.pdf$", "")
    return F.lower(F.regexp_replace(bare, r"(?i)v\d+$", ""))


def norm_provider(x: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(nfkc_casefold(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    known = F.when(bare == "arxiv_id", "arxiv").when(bare == "open_alex", "openalex").when(bare == "semantic_scholar_id", "semantic_scholar").otherwise(bare)
    return F.coalesce(F.nullif(known, F.lit("")), F.lit("unknown"))


def norm_external_id(provider: Column, x: Column) -> Column:
    """An identifier without its provider's address or prefix."""
    bare = F.trim(nfkc(x))
    bare = F.when(provider == "openalex", F.regexp_replace(bare, r"(?i)^https?://openalex\.org/", "")).otherwise(bare)
    bare = F.when(provider == "arxiv", F.regexp_replace(bare, r"(?i)^https?://arxiv\.org/(abs|pdf)/", "")).otherwise(bare)
    out = bare
    for separator in (" ", "-", "_"):
        prefix = F.concat(F.replace(provider, F.lit("_"), F.lit(separator)), F.lit(":"))
        out = F.when(F.startswith(F.lower(bare), prefix), F.trim(F.substr(bare, F.length(prefix) + 1))).otherwise(out)
    return F.when(provider == "doi", F.coalesce(norm_doi_stored(x), F.lit(""))).otherwise(F.regexp_replace(out, r"(?U)\s+", " "))


#: Identifiers that are kept from a feed's record.
KNOWN_IDS = ["arxiv", "doi", "pmid", "pmcid", "mag", "pubmed", "dblp", "acl"]


def known_external_ids(ids: Column) -> Column:
    """Of a map of strings only known names with scalar values, names in lower case."""
    named = F.transform_keys(ids, lambda k, _: F.lower(F.trim(k)))
    scalar = F.map_filter(named, lambda k, v: k.isin(KNOWN_IDS) & v.isNotNull() & (F.trim(v) != "") & ~F.trim(v).rlike(r"^[\[{]"))
    clean = F.transform_values(scalar, lambda k, v: F.when(k == "doi", norm_doi(v)).when(k == "arxiv", norm_arxiv(v)).otherwise(F.trim(v)))
    return F.coalesce(F.map_filter(clean, lambda _, v: v.isNotNull()), F.create_map().cast("map<string,string>"))


def slug(x: Column, length: int | None = None, default: str | None = None) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    out = F.substring(out, 1, length) if length else out
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default)) if default is not None else out


def norm_name(x: Column) -> Column:
    return collapse(nfkc_casefold(x))


def canonical_link(doi: Column, url: Column) -> Column:
    return F.coalesce(F.concat(F.lit("https://doi.org/"), F.regexp_replace(F.nullif(doi, F.lit("")), "^https://doi.org/", "")), url)


# -- tokenizers: arrays of distinct tokens in order ---------------------------------


def ranker_tokens(x: Column) -> Column:
    """Words of the dedup form of a text."""
    return F.array_distinct(F.filter(F.split(norm_title(F.coalesce(x, F.lit(""))), " "), lambda w: w != ""))


def stored_tokens(x: Column) -> Column:
    """Parts between white space of the folded text; punctuation stays attached."""
    return F.array_distinct(F.filter(F.split(collapse(nfkc_casefold(F.coalesce(x, F.lit("")))), " "), lambda w: w != ""))


def stored_title_tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm_title_stored(F.coalesce(x, F.lit(""))), " "), lambda w: w != ""))


def ask_tokens(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(nfkc_casefold(F.coalesce(x, F.lit(""))), F.lit(r"(?U)\b([a-z0-9]+)\b"), 1))


def miner_tokens(x: Column) -> Column:
    """Words of two characters at least after NFKD, but for stop words."""
    # a combining mark is no word character
    bare = F.regexp_replace(nfkd_lower(F.coalesce(x, F.lit(""))), r"\p{M}", " ")
    words = F.regexp_extract_all(bare, F.lit(r"(?U)\b([a-z0-9]{2,})\b"), 1)
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def critic_tokens(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"(?U)\b([a-zA-Z0-9]{3,})\b"), 1))


# -- absolute claims ------------------------------------------------------------------

#: Phrases that a candidate's text must not hold, and what replaces them.
ABSOLUTE_PHRASES = ["no one has", "nobody has", "never been studied", "does not exist", "first ever"]
ABSOLUTE_REPLACEMENT = "limited evidence was found for"
#: Patterns that an answer must not hold.
ABSOLUTE_PATTERNS = [r"\bno\s+one\s+has\s+studied\b", r"\bthis\s+is\s+the\s+first\b", r"\bno\s+research\s+exists\b", r"\bnobody\s+has\s+ever\b", r"\bfirst\s+paper\s+to\b"]
CORPUS_SCOPED = "Within the papers currently stored in this research memory"


def without_absolute_claims(x: Column) -> Column:
    for phrase in ABSOLUTE_PHRASES:
        x = F.regexp_replace(x, f"(?i){phrase}", ABSOLUTE_REPLACEMENT)
    return x


def rewrite_claims(x: Column, instead: str = CORPUS_SCOPED) -> Column:
    for pattern in ABSOLUTE_PATTERNS:
        x = F.regexp_replace(x, f"(?iU){pattern}", instead)
    return x


def gap_id(gap_type: str, topic: Column, phrase: Column) -> Column:
    t, p = slug(topic, 24, "topic"), slug(phrase, 24, "gap")
    return F.concat(F.lit(f"gap-{gap_type}-"), t, F.lit("-"), F.substring(F.sha2(F.concat_ws(":", F.lit(gap_type), t, p), 256), 1, 8))


def truncated(x: Column, length: int) -> Column:
    return F.when(F.length(x) <= length, x).otherwise(F.concat(F.substring(x, 1, length - 3), F.lit("...")))
