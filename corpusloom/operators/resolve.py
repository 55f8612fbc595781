"""Paper identity: keys, duplicate resolution, merging, and upserts into memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from .components import connected_components, cut_lineage

#: Order of feeds where two records are equally complete.
FEED_ORDER = {"openalex": 0, "semantic_scholar": 1, "arxiv": 2}


def normalize_identities(papers: DataFrame) -> DataFrame:
    """Columns n_title, n_title_stored, n_doi and n_arxiv beside the papers."""
    ids = F.col("external_ids")
    return papers.withColumns(
        {
            "n_title": T.norm_title(F.col("title")),
            "n_title_stored": T.norm_title_stored(F.col("title")),
            "n_doi": T.norm_doi(F.coalesce(F.nullif("doi", F.lit("")), F.try_element_at(ids, F.lit("doi")))),
            "n_arxiv": T.norm_arxiv(F.try_element_at(ids, F.lit("arxiv"))),
        }
    )


def _strong(ids: Column) -> Column:
    others = F.filter(F.map_entries(ids), lambda e: ~F.lower(e["key"]).isin("doi", "arxiv") & (F.trim(e["value"]) != ""))
    external = F.transform(F.array_sort(others), lambda e: F.concat(F.lit("external:"), F.lower(e["key"]), F.lit(":"), F.lower(F.trim(e["value"]))))
    return F.concat(F.array_compact(F.array(F.concat(F.lit("doi:"), "n_doi"), F.concat(F.lit("arxiv:"), "n_arxiv"))), F.coalesce(external, F.array().cast("array<string>")))


def identity_keys(papers: DataFrame, key: str = "id") -> DataFrame:
    """(id, pos, key): a row for each identity of each record, strong ones first, then a title of eight characters or more."""
    title = F.when(F.length("n_title") >= 8, F.array(F.concat(F.lit("title:"), "n_title"))).otherwise(F.array().cast("array<string>"))
    keyed = normalize_identities(papers).select(F.col(key), F.concat(_strong(F.col("external_ids")), title).alias("keys"))
    return keyed.select(key, F.posexplode("keys").alias("pos", "key"))


def _title_links(records: DataFrame) -> DataFrame:
    """(src, dst) components that a title joins: in each group in order, unless an identifier type is known with other values only.

    ``records`` has title, component, first (the component's place) and types, the types of identifier that it knows.
    Components never share a value, they would be one: so one that shares a type with what its group has taken
    in is in conflict. Each round takes the next one of every group and drops what conflicts with it; a group
    takes in no more than there are types, so rounds are few, and no group is ever gathered.
    """
    least = lambda rows: rows.groupBy("title").agg(F.min_by(F.struct("component", "types"), F.struct("first", "component")).alias("h"))
    rest, taken, lead = records, None, None
    while True:
        head = cut_lineage(least(rest).select("title", "h.component", "h.types"))
        if head.isEmpty():
            break
        lead = head if lead is None else lead
        taken = head.select("title", "component") if taken is None else taken.union(head.select("title", "component"))
        other = head.select("title", F.col("types").alias("known"), F.col("component").alias("of"))
        # without any type there is no conflict: those go along at once
        rest = cut_lineage(rest.where(F.size("types") > 0).join(other, "title").where(~F.arrays_overlap("types", "known") & (F.col("component") != F.col("of"))).drop("known", "of"))
    if taken is None:
        return records.select(F.col("component").alias("src"), F.col("component").alias("dst"))
    plain = records.where(F.size("types") == 0).select("title", "component")
    return taken.union(plain).join(lead.select("title", F.col("component").alias("dst")), "title").select(F.col("component").alias("src"), "dst").where("src <> dst").distinct()


def resolve_duplicates(papers: DataFrame) -> DataFrame:
    """(ord, component): records of one paper get the smallest ``ord`` of theirs.

    ``papers`` has ord, its records' order. First, records that share a strong key
    are one; then equal titles join what these made, in order, unless both know an identifier type
    with no value in common. Titles are settled in rounds over all groups at once, each against
    the components of the first step.
    """
    named = cut_lineage(normalize_identities(papers).select("ord", "n_title", _strong(F.col("external_ids")).alias("keys")))
    keys = named.select("ord", F.explode("keys").alias("key"))
    first = keys.groupBy("key").agg(F.min("ord").alias("dst"))
    edges = keys.join(first, "key").where("ord <> dst").select(F.col("ord").alias("src"), "dst")
    by_key = connected_components(edges)
    placed = named.join(by_key.withColumnRenamed("node", "ord"), "ord", "left").withColumn("component", F.coalesce("component", "ord"))
    placed = cut_lineage(placed)
    # the type is what stands before the last colon, so an identifier with a colon is a type of its own
    types = placed.select("component", F.explode("keys").alias("key")).groupBy("component").agg(F.collect_set(F.regexp_extract("key", r"(?s)^(.*):[^:]*$", 1)).alias("types"))
    titles = placed.where(F.length("n_title") >= 8).groupBy(F.col("n_title").alias("title"), "component").agg(F.min("ord").alias("first"))
    shared = titles.join(titles.groupBy("title").agg(F.count("*").alias("n")).where("n > 1"), "title")
    records = cut_lineage(shared.join(types, "component", "left").select("title", "component", "first", F.coalesce("types", F.array().cast("array<string>")).alias("types")))
    bridged = connected_components(_title_links(records)).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return placed.join(bridged, "component", "left").select("ord", F.coalesce("joined", "component").alias("component"))


def metadata_score() -> Column:
    given = [F.col(c).isNotNull() for c in ("abstract", "publication_year", "venue", "doi", "url", "citation_count")] + [F.size("authors") > 0]
    return sum((x.cast("int") for x in given), F.lit(0))


def merge_duplicates(papers: DataFrame, components: DataFrame) -> DataFrame:
    """One paper for each component: the most complete record leads, the others fill in what they have more of."""
    feed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FEED_ORDER.items() for x in kv]), F.col("source")), F.lit(99))
    rank = F.struct((-metadata_score()).alias("s"), feed.alias("f"), F.col("id"))
    rows = papers.join(components, "ord").withColumn("rank", rank).withColumn("n_doi", T.norm_doi(F.col("doi")))
    own = F.regexp_replace("id", "^[^:]*:", "")
    ids = F.map_filter("external_ids", lambda _, v: v.isNotNull() & (v != ""))
    first = lambda c, given: F.min_by(F.when(given, F.col(c)), F.when(given, F.col("rank")))
    grouped = rows.groupBy("component").agg(
        F.min_by(F.struct("id", "title", "source"), "rank").alias("lead"),
        F.min_by("abstract", F.when(F.length("abstract") > 0, F.struct((-F.length("abstract")).alias("l"), "rank"))).alias("abstract"),
        F.min_by("authors", F.struct((-F.size("authors")).alias("l"), "rank")).alias("authors"),
        first("publication_year", F.coalesce(F.col("publication_year") != 0, F.lit(False))).alias("publication_year"),
        first("venue", F.coalesce(F.col("venue") != "", F.lit(False))).alias("venue"),
        first("n_doi", F.col("n_doi").isNotNull()).alias("doi"),
        first("url", F.coalesce(F.col("url") != "", F.lit(False))).alias("url"),
        F.max("citation_count").alias("citation_count"),
        F.count("*").alias("records"),
    )
    # of each identifier the value of the last record that has it counts, else the first one's own id; a row for each identifier, however many records
    given = F.transform(F.map_entries(ids), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lit(False).alias("own")))
    entries = rows.select("component", "rank", F.inline(F.concat(F.coalesce(given, F.array().cast("array<struct<key:string,value:string,own:boolean>>")), F.array(F.struct(F.col("source").alias("key"), own.alias("value"), F.lit(True).alias("own"))))))
    by_key = entries.groupBy("component", "key").agg(
        F.coalesce(F.max_by(F.when(~F.col("own"), F.col("value")), F.when(~F.col("own"), F.col("rank"))), F.min_by(F.when(F.col("own"), F.col("value")), F.when(F.col("own"), F.col("rank")))).alias("value")
    )
    maps = by_key.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("ids"))
    put = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))  # noqa: E731  the later value wins
    grouped = grouped.join(maps, "component")
    merged = F.when(F.col("doi").isNotNull(), put(F.col("ids"), F.create_map(F.lit("doi"), F.col("doi")))).otherwise(F.col("ids"))
    return grouped.select(
        "component", "lead.id", "lead.title", "abstract", "authors", "publication_year", "venue", "doi", "url", "citation_count", "lead.source", merged.alias("external_ids"), "records"
    )


def source_pairs(papers: DataFrame, key: str = "id") -> DataFrame:
    """(id, pos, provider, external_id): distinct pairs in order: the own id, external ids, the doi."""
    entries = F.coalesce(F.map_entries("external_ids"), F.array().cast("array<struct<key:string,value:string>>"))
    raw = F.concat(
        F.array(F.struct(F.col("source").alias("key"), F.col("id").alias("value"))), F.array_sort(entries),
        F.when(F.col("doi").isNotNull(), F.array(F.struct(F.lit("doi").alias("key"), F.col("doi").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>")),
    )
    rows = papers.select(F.col(key).alias("__id"), F.posexplode(raw).alias("pos", "pair")).withColumn("provider", T.norm_provider(F.col("pair.key")))
    rows = rows.withColumn("external_id", T.norm_external_id(F.col("provider"), F.col("pair.value"))).where("external_id <> ''")
    return rows.groupBy(F.col("__id").alias(key), "provider", "external_id").agg(F.min("pos").alias("pos"))


def canonical_keys(papers: DataFrame, key: str = "id") -> DataFrame:
    """(id, canonical_key, keys): identities in the order doi, arxiv, other sources; a title only if there is none. The first leads."""
    pairs = source_pairs(papers, key)
    ranked = pairs.select(
        key, "pos",
        F.when(F.col("provider") == "doi", 0).when(F.col("provider") == "arxiv", 1).otherwise(2).alias("kind"),
        F.when(F.col("provider") == "doi", F.concat(F.lit("doi:"), "external_id")).when(F.col("provider") == "arxiv", F.concat(F.lit("arxiv:"), T.norm_arxiv_stored(F.col("external_id"))))
        .otherwise(F.concat_ws(":", F.lit("source"), "provider", F.lower("external_id"))).alias("name"),
    )
    keys = ranked.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("kind", "pos", "name"))), lambda x: x["name"])).alias("keys"))
    titled = papers.select(F.col(key), F.array(F.concat(F.lit("title:"), T.norm_title_stored(F.col("title")))).alias("by_title"))
    return titled.join(keys, key, "left").select(key, F.coalesce("keys", "by_title").alias("keys")).withColumn("canonical_key", F.col("keys")[0])


def _shared_keys(rows: DataFrame) -> DataFrame:
    """(id, key) by doi and by a title of eight characters or more."""
    doi, title = F.concat(F.lit("doi:"), T.norm_doi_stored(F.col("doi"))), F.concat(F.lit("title:"), T.title_identity(T.norm_title_stored(F.col("title"))))
    return rows.select("id", doi.alias("key")).unionByName(rows.select("id", title.alias("key")))


def _pair_key() -> Column:
    return F.concat_ws(":", F.lit("pair"), "provider", "external_id")


def stored_keys(memory: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, key): all that stored papers can be met by."""
    named = memory.select("id", F.concat(F.lit("key:"), "canonical_key").alias("key"))
    return named.unionByName(_shared_keys(memory)).unionByName(sources.select(F.col("paper_id").alias("id"), _pair_key().alias("key"))).where("key IS NOT NULL").distinct()


def incoming_keys(incoming: DataFrame) -> DataFrame:
    """(id, key): all that records of feeds can be met by."""
    named = canonical_keys(incoming).select("id", F.explode("keys").alias("k")).select("id", F.concat(F.lit("key:"), "k").alias("key"))
    return named.unionByName(_shared_keys(incoming)).unionByName(source_pairs(incoming).select("id", _pair_key().alias("key"))).where("key IS NOT NULL").distinct()


def match_memory(memory: DataFrame, sources: DataFrame, incoming: DataFrame) -> DataFrame:
    """(rid, paper_id): the stored paper that each stored or incoming record belongs to, one job for all.

    Records meet by source pair, canonical key, doi or a title of eight characters or more, without the
    conflict rule of feeds. Of stored papers that meet, the oldest by (created_at, id) stays;
    a group without one gets an id made from its first canonical key. ``rid`` is ``m:`` or ``i:`` and the record's id.
    """
    own = F.concat(F.lit("m:"), "id")
    new = F.concat(F.lit("i:"), "id")
    keys = stored_keys(memory, sources).select(own.alias("rid"), "key").unionByName(incoming_keys(incoming).select(new.alias("rid"), "key")).distinct()
    first = keys.groupBy("key").agg(F.min("rid").alias("dst"))
    groups = connected_components(keys.join(first, "key").where("rid <> dst").select(F.col("rid").alias("src"), "dst"))
    everyone = memory.select(own.alias("rid"), F.struct("created_at", "id").alias("age"), F.col("id").alias("stored")).unionByName(
        canonical_keys(incoming).select(new.alias("rid"), F.lit(None).cast("struct<created_at:timestamp,id:string>").alias("age"), F.lit(None).cast("string").alias("stored"))
    )
    made = canonical_keys(incoming).select(new.alias("rid"), F.substring(F.sha2("canonical_key", 256), 1, 32).alias("made"))
    placed = everyone.join(groups.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid")).join(made, "rid", "left")
    target = placed.groupBy("component").agg(F.coalesce(F.min_by("stored", "age"), F.min("made")).alias("paper_id"))
    return placed.join(target, "component").select("rid", "paper_id")


def upsert_papers(memory: DataFrame, sources: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The next snapshot of stored papers, after all incoming ones. Ties of order go by creation, then id."""
    ids = match_memory(memory, sources, incoming)
    stored = memory.select(
        F.concat(F.lit("m:"), "id").alias("rid"), "canonical_key", "title", "abstract", "authors", "publication_year", "venue", F.col("doi"), "url", "citation_count",
        "primary_source", "first_discovered_at", "created_at", "updated_at",
    )
    fresh = incoming.join(canonical_keys(incoming), "id").select(
        F.concat(F.lit("i:"), "id").alias("rid"), "canonical_key", "title", "abstract", "authors", "publication_year", "venue", T.norm_doi_stored(F.col("doi")).alias("doi"), "url",
        "citation_count", F.col("source").alias("primary_source"), now.alias("first_discovered_at"), now.alias("created_at"), now.alias("updated_at"),
    )
    rows = stored.unionByName(fresh).join(ids, "rid").withColumn("age", F.struct(F.startswith("rid", F.lit("i:")).alias("new"), "created_at", "rid"))
    out = merge_metadata(rows, "paper_id", "age")
    # the best key is adopted if nobody else has it
    taken = out.groupBy("best_key").agg(F.count("*").alias("n"))
    out = out.join(taken, "best_key").withColumn("canonical_key", F.when(F.col("n") == 1, F.col("best_key")).otherwise(F.col("canonical_key")))
    return out.drop("best_key", "n").withColumnRenamed("paper_id", "id")


def merge_metadata(rows: DataFrame, key: str, age: str) -> DataFrame:
    """One row for each key: the longest title, abstract and author list, the first year, venue, doi and url, most citations."""
    longest = lambda c: F.min_by(c, F.when(F.length(F.trim(c)) > 0, F.struct((-F.length(F.trim(c))).alias("l"), age)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(age)))
    kind = F.when(F.startswith("canonical_key", F.lit("doi:")), 0).when(F.startswith("canonical_key", F.lit("arxiv:")), 1).when(F.startswith("canonical_key", F.lit("source:")), 2).otherwise(3)
    out = rows.groupBy(key).agg(
        F.min_by("canonical_key", age).alias("canonical_key"), F.min_by("canonical_key", F.struct(kind, age)).alias("best_key"), longest("title").alias("title"),
        longest("abstract").alias("abstract"), F.min_by("authors", F.struct((-F.size("authors")).alias("l"), age)).alias("authors"),
        *(first(c).alias(c) for c in ("publication_year", "venue", "doi", "url")), F.max("citation_count").alias("citation_count"), F.min_by("primary_source", age).alias("primary_source"),
        F.min("first_discovered_at").alias("first_discovered_at"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
    )
    return out.withColumn("normalized_title", T.norm_title_stored(F.col("title")))


def _moved(table: DataFrame, id_map: DataFrame, column: str = "paper_id") -> DataFrame:
    """The table with ids replaced by the map (old_id, new_id); unmapped ids stay."""
    return table.join(id_map.select(F.col("old_id").alias(column), "new_id"), column, "left").withColumn("moved", F.coalesce("new_id", column)).drop("new_id")


def reconcile_sources(sources: DataFrame, id_map: DataFrame) -> DataFrame:
    """Provenance of the survivors: latest retrieval, the survivor's own url first."""
    own = (F.col("moved") != F.col("paper_id")).cast("int")
    return _moved(sources, id_map).groupBy(F.col("moved").alias("paper_id"), "provider", "external_id").agg(
        F.max("retrieved_at").alias("retrieved_at"), F.min_by("source_url", F.when(F.col("source_url") != "", F.struct(own, F.col("paper_id")))).alias("source_url")
    )


def reconcile_discoveries(discoveries: DataFrame, id_map: DataFrame) -> DataFrame:
    return _moved(discoveries, id_map).groupBy("watch_topic_id", F.col("moved").alias("paper_id")).agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("rank_score").alias("rank_score"), F.min("notified_at").alias("notified_at")
    )


def reconcile_cards(cards: DataFrame, id_map: DataFrame) -> DataFrame:
    """The newest card of each survivor, its own first of equals, created when the first was."""
    moved = _moved(cards, id_map)
    rest = [c for c in cards.columns if c not in ("paper_id", "created_at")]
    newest = F.max_by(F.struct(*rest), F.struct("updated_at", (F.col("moved") == F.col("paper_id")).alias("own"), "paper_id"))
    return moved.groupBy(F.col("moved").alias("paper_id")).agg(newest.alias("__card"), F.min("created_at").alias("created_at")).select(
        "paper_id", *(F.col(f"__card.{c}").alias(c) for c in rest), "created_at"
    ).select(*cards.columns)


def reconcile_links(links: DataFrame, id_map: DataFrame) -> DataFrame:
    """Project links follow their papers; of two to one paper the older stays."""
    rest = [c for c in links.columns if c not in ("project_id", "paper_id")]
    return _moved(links, id_map).groupBy("project_id", F.col("moved").alias("paper_id")).agg(F.min_by(F.struct(*rest), F.struct("created_at", "paper_id")).alias("l")).select(
        "project_id", "paper_id", *(F.col(f"l.{c}").alias(c) for c in rest)
    )


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "DataFrame", "W", "F", "T")]
