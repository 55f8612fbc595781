"""DuckDB equivalents of the registered queries, on the same tables.

Folding and word classes are spelled out for the letters of the tables: DuckDB has
neither NFKC nor Unicode word boundaries.
"""

from __future__ import annotations

import re

from ..functions.text import ABSOLUTE_PATTERNS, ABSOLUTE_PHRASES, CORPUS_SCOPED, STOP_WORDS
from ..operators.critic import QUESTION_STOPS
from ..operators.gaps import CLASSES, CONDITIONS, FEASIBILITY, FORMATS, GENERIC, NEGATIVE, POSITIVE
from ..operators.sections import SECTIONS
from .views import CLAIM_TAILS, CONDITION_WORDS, HEADINGS, METHOD_NAMES


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def parts(x: str) -> str:
    """Distinct parts between white space."""
    return rf"list_distinct(list_filter(regexp_split_to_array({fold(x)}, '\s+'), lambda w: w <> ''))"


def stored_title(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({fold(x)}, '\p{{P}}', ' ', 'g'), '\s+', ' ', 'g'))"


def dedup_title(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({fold(x)}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def words_of(x: str) -> str:
    return rf"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def plain_words(x: str, least: int) -> str:
    """Runs of word characters that are ASCII letters and digits only."""
    return rf"list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z0-9]{{{least},}}'))"


def decomposed(x: str) -> str:
    """Lower case with accents taken off, each leaving a gap."""
    out = f"lower({x})"
    for letter, accented in {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü", "y": "ýÿ"}.items():
        out = f"regexp_replace({out}, '[{accented}]', '{letter} ', 'g')"
    return out


def miner_words(x: str) -> str:
    return f"list_filter(list_distinct({plain_words(decomposed(x), 2)}), lambda w: NOT list_contains({_list(STOP_WORDS)}, w))"


def slug(x: str, n: int) -> str:
    return f"substr(trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '-'), 1, {n})"


def gap_id(kind: str, topic: str, phrase: str) -> str:
    t, p = slug(topic, 24), slug(phrase, 24)
    return f"'gap-{kind}-' || {t} || '-' || substr(sha256('{kind}:' || {t} || ':' || {p}), 1, 8)"


PAPERS = """papers AS (SELECT doc_id AS ord, 'd' || doc_id AS id, split_part(text, chr(10), 1) AS title, text AS abstract, source AS venue, lang,
    2000 + doc_id % 25 AS year, n_chars % 1000 AS cites, (['openalex', 'semantic_scholar', 'arxiv'])[doc_id % 3 + 1] AS feed,
    CASE WHEN doc_id % 2 = 0 THEN '10.5555/' || substr(md5(text), 1, 12) END AS doi FROM documents)"""

INDEX = f"""tokens AS (SELECT id, unnest({words_of(stored_title("title"))}) AS t, 3 AS w FROM papers UNION ALL SELECT id, unnest({parts("abstract")}), 2 FROM papers)"""

CARD_TOKENS = f"""card_tokens AS (SELECT 'd' || doc_id AS id, unnest({parts("concat_ws(' ', source, lang, text, text, CASE WHEN quality = 1 THEN 'improves' ELSE 'degrades' END)")}) AS t, 1 AS w
    FROM documents JOIN labels USING (doc_id))"""


def scores(cards: bool) -> str:
    source = "(SELECT * FROM tokens UNION ALL SELECT * FROM card_tokens)" if cards else "tokens"
    return f"""{PAPERS}, {INDEX}{', ' + CARD_TOKENS if cards else ''},
    q AS (SELECT item_id AS query_id, unnest({parts("text")}) AS t FROM benchmark),
    s AS (SELECT query_id, id, sum(w)::BIGINT AS score FROM {source} JOIN q USING (t) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, year DESC, cites DESC, {stored_title("title")}, id) AS rank,
                 count(*) OVER (PARTITION BY query_id) AS total_matching FROM s JOIN papers USING (id))"""


SCOPED = f"""{scores(True)},
    scope AS (SELECT query_id::VARCHAR AS topic, id AS paper_id, rank AS paper_ord, quality, abstract, venue, lang FROM r JOIN labels ON ord = doc_id WHERE rank <= 50)"""

STATEMENTS = f"""{SCOPED},
    st AS (SELECT topic, paper_id, trim(abstract, ' ') AS statement, {miner_words("abstract")} AS tokens, paper_ord FROM scope WHERE trim(abstract, ' ') <> ''),
    nst AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY paper_ord) AS nth FROM st WHERE len(tokens) > 0),
    f AS (SELECT topic, nth, 1::BIGINT AS grp, [tokens] AS gs FROM nst WHERE nth = 1
        UNION ALL SELECT topic, nth, coalesce(fit, len(gs) + 1) AS grp, CASE WHEN fit IS NULL THEN list_append(gs, tokens) ELSE list_transform(gs, lambda g, i: CASE WHEN i = fit THEN list_distinct(list_concat(g, tokens)) ELSE g END) END
          FROM (SELECT n.topic, n.nth, n.tokens, f.gs, list_position(list_transform(f.gs, lambda g: len(list_intersect(g, n.tokens)) >= 2 OR len(list_intersect(g, n.tokens)) / len(list_distinct(list_concat(g, n.tokens))) >= 0.35), true)::BIGINT AS fit
            FROM f JOIN nst n ON n.topic = f.topic AND n.nth = f.nth + 1)),
    g AS (SELECT topic, nth, grp FROM f),
    sg AS (SELECT nst.*, grp FROM nst JOIN g USING (topic, nth))"""

THEMES = f"""{STATEMENTS},
    gs AS (SELECT topic, grp, list(tokens ORDER BY nth) AS ts, first(statement ORDER BY nth) AS lead FROM sg GROUP BY ALL),
    sh AS (SELECT topic, grp, list_filter(regexp_extract_all(lead, '[\\p{{L}}\\p{{N}}_-]+'), lambda w: regexp_full_match(w, '[a-zA-Z0-9-]+')) AS ws, list_reduce(ts, lambda a, b: list_intersect(a, b)) AS shared FROM gs),
    cm AS (SELECT *, list_filter(ws, lambda w: list_contains(shared, lower(w))) AS common FROM sh),
    themes AS (SELECT topic, grp, CASE WHEN len(common) > 0 THEN array_to_string(common[1:5], ' ') WHEN len(ws) > 0 THEN array_to_string(ws[1:5], ' ') ELSE 'observed limitation' END AS theme FROM cm)"""

ORDERS = """m AS (SELECT DISTINCT l_orderkey AS p, p_brand || '/' || p_size AS method FROM lineitem JOIN part ON l_partkey = p_partkey),
    d AS (SELECT DISTINCT l_orderkey AS p, n_name AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    fm AS (SELECT method, count(*) AS method_papers FROM m GROUP BY 1 HAVING count(*) >= 2),
    j AS (SELECT method, value, count(*) AS n FROM m JOIN d USING (p) GROUP BY ALL)"""

EVALUATED = f"""c AS (SELECT doc_id, lang, source, ({_list(CONDITION_WORDS)})[n_chars % {len(CONDITION_WORDS)} + 1] AS word,
      CASE quality WHEN 1 THEN 'observed' WHEN 0 THEN 'explicitly_absent' ELSE 'unknown' END AS status FROM documents LEFT JOIN labels USING (doc_id)),
    k AS (SELECT *, coalesce(list_filter({_list(CONDITIONS)}, lambda s: contains(lower(trim(word)), s) OR contains(s, lower(trim(word))))[1], lower(trim(word))) AS cond FROM c),
    pp AS (SELECT lang, source, count(*) AS papers FROM c GROUP BY ALL HAVING count(*) >= 2),
    ev AS (SELECT lang, source, cond, count(*) FILTER (status = 'observed') AS o, count(*) FILTER (status = 'explicitly_absent') AS a FROM k WHERE list_contains({_list(CONDITIONS)}, cond) GROUP BY ALL),
    eg AS (SELECT ev.lang, ev.source, cond, papers, a FROM ev JOIN pp USING (lang, source) WHERE o = 0 AND a > 0)"""

SEEN = """seen AS (SELECT event_type, user_id::VARCHAR AS user, min(ts) AS f, max(ts) AS l, max(value / 500) AS r FROM events GROUP BY ALL)"""

_ALIASES = " ".join(f"WHEN list_contains({_list(v)}, {{h}}) THEN '{k}'" for k, v in SECTIONS.items())


def heading(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace(lower(trim({x})), '^(([0-9]+(\.[0-9]+)*)|([ivxlcdm]+))[\s.)\-:]+', ''), '[.:;\-–—]+$', '')"
    return rf"trim(regexp_replace({bare}, '[ \t]+', ' ', 'g'))"


def section_case(x: str) -> str:
    return f"CASE {_ALIASES.replace('{h}', heading(x))} END"


_INLINE = r"^(.{1,100}?)\s*[:\-–—]\s+(.+)$"
SECTIONED = rf"""docs AS (SELECT doc_id AS doc, list_reduce(list_prepend('', list_transform(range(len(ls)), lambda i: ({_list(HEADINGS)})[(i + doc_id) % {len(HEADINGS)} + 1] || chr(10) || ls[i + 1])), lambda a, b: CASE WHEN a = '' THEN b ELSE a || chr(10) || b END) AS text
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    raw AS (SELECT doc, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
    ln AS (SELECT doc, pos, trim(regexp_replace(x, '[ \t]+', ' ', 'g')) AS line FROM raw),
    nm AS (SELECT *, {section_case("line")} AS alone, {section_case(f"regexp_extract(line, '{_INLINE}', 1)")} AS lead FROM ln),
    n2 AS (SELECT doc, pos, line, CASE WHEN line <> '' THEN coalesce(alone, lead) END AS name, CASE WHEN line <> '' AND alone IS NULL AND lead IS NOT NULL THEN trim(regexp_replace(regexp_extract(line, '{_INLINE}', 2), '[ \t]+', ' ', 'g')) END AS inl FROM nm),
    op AS (SELECT *, name IS NOT NULL AND row_number() OVER (PARTITION BY doc, name ORDER BY pos) = 1 AS opens FROM n2),
    hd AS (SELECT *, last_value(CASE WHEN opens THEN name END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos) AS section FROM op),
    pt AS (SELECT doc, pos, section, CASE WHEN opens THEN inl ELSE line END AS part FROM hd WHERE section IS NOT NULL),
    sec AS (SELECT doc, list_position({_list(list(SECTIONS))}, section)::INT AS ord, section, string_agg(part, chr(10) ORDER BY pos) AS body FROM pt WHERE part <> '' GROUP BY ALL)"""


def cut(x: str, limit: str) -> str:
    head = f"substr(trim({x}), 1, greatest(1, {limit} - 1))"
    space = f"CASE WHEN strpos(reverse({head}), ' ') > 0 THEN length({head}) - strpos(reverse({head}), ' ') ELSE -1 END"
    return f"CASE WHEN length(trim({x})) <= {limit} THEN trim({x}) WHEN {space} > {limit} // 2 THEN rtrim(substr({head}, 1, {space})) || '…' ELSE rtrim({head}) || '…' END"


_POLARITY = "CASE WHEN pos AND NOT neg THEN 'positive' WHEN neg AND NOT pos THEN 'negative' ELSE 'neutral' END"
CONTRADICTIONS = rf"""{SCOPED},
    cl0 AS (SELECT *, abstract || CASE WHEN quality = 1 THEN ' improves' ELSE ' degrades' END AS claim FROM scope),
    cl1 AS (SELECT *, regexp_matches(lower(claim), '{"|".join(POSITIVE)}') AS pos, regexp_matches(lower(claim), '{"|".join(NEGATIVE)}') AS neg FROM cl0),
    cl AS (SELECT topic, paper_id, paper_ord, lang, claim, {_POLARITY} AS pol, list_filter({miner_words("claim")}, lambda w: length(w) >= 3 AND NOT list_contains({_list(GENERIC)}, w)) AS tk FROM cl1),
    pr AS (SELECT a.topic, a.paper_id AS paper_a, b.paper_id AS paper_b, array_to_string(list_sort(list_intersect(a.tk, b.tk))[1:3], ' ') AS concept, a.lang <> b.lang AS conditioned
      FROM cl a JOIN cl b ON a.topic = b.topic AND a.paper_ord < b.paper_ord WHERE a.pol <> 'neutral' AND b.pol <> 'neutral' AND a.pol <> b.pol AND len(list_intersect(a.tk, b.tk)) > 0)"""

FEED_RANK = "CASE feed WHEN 'openalex' THEN 0 WHEN 'semantic_scholar' THEN 1 ELSE 2 END"


def components(source: str) -> str:
    """Records of one doi are one; then the first of each title takes in those that share no type of identifier with what it has."""
    return f"""rc AS (SELECT *, CASE WHEN doi IS NULL THEN ord ELSE min(ord) OVER (PARTITION BY doi) END AS comp0, {dedup_title("title")} AS dt FROM {source}),
      ct AS (SELECT dt, comp0, list_distinct(list_concat(list(feed), list_filter([any_value(CASE WHEN doi IS NOT NULL THEN 'doi' END)], lambda x: x IS NOT NULL))) AS types FROM rc GROUP BY ALL),
      tf AS (SELECT dt, list_reduce(list({{'types': types, 'taken': [comp0]}} ORDER BY comp0), lambda a, b: CASE WHEN len(list_intersect(a.types, b.types)) > 0 THEN a
          ELSE {{'types': list_concat(a.types, b.types), 'taken': list_concat(a.taken, b.taken)}} END).taken AS taken FROM ct WHERE length(dt) >= 8 GROUP BY dt),
      tl AS (SELECT unnest(taken) AS comp0, taken[1] AS component FROM tf),
      cp AS (SELECT rc.*, coalesce(component, comp0) AS component FROM rc LEFT JOIN tl USING (comp0))"""


MERGED = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY doi IS NULL, {FEED_RANK}, id) AS k FROM cp),
      mf AS (SELECT component, feed, last(ord ORDER BY k) AS n FROM rk GROUP BY ALL),
      mi AS (SELECT component, string_agg('"' || feed || '":"' || n || '"', ',') FILTER (feed = 'arxiv') AS ar, string_agg('"' || feed || '":"' || n || '"', ',' ORDER BY feed) FILTER (feed <> 'arxiv') AS ot FROM mf GROUP BY 1),
      mg AS (SELECT component, first(id ORDER BY k) AS id, first(title ORDER BY k) AS title, first(abstract ORDER BY length(abstract) DESC, k) FILTER (length(abstract) > 0) AS abstract,
        first(concat_ws(',', venue, lang) ORDER BY k) AS authors, first(year ORDER BY k) AS publication_year, first(venue ORDER BY k) FILTER (venue <> '') AS venue, first(doi ORDER BY k) FILTER (doi IS NOT NULL) AS doi,
        first('https://papers.example/' || ord ORDER BY k) AS url, max(cites) AS citation_count, first(feed ORDER BY k) AS source, count(*) AS records FROM rk GROUP BY component)"""


def ranked(source: str) -> str:
    """rank and score of (query_id, id, title, abstract, publication_year, citation_count, venue, doi) rows beside q, their query's words."""
    return f"""rp AS (SELECT *, {dedup_title("title")} AS nt, {words_of(dedup_title("title"))} AS tt, {words_of(dedup_title("coalesce(abstract, '')"))} AS ab,
        ((abstract IS NOT NULL)::INT + (venue IS NOT NULL)::INT + (doi IS NOT NULL)::INT + 3) / 6 AS completeness FROM {source}),
      sc AS (SELECT *, 0.5 * coalesce(len(list_intersect(q, tt)) / nullif(len(q), 0), 0) + 0.25 * coalesce(len(list_intersect(q, ab)) / nullif(len(q), 0), 0)
        + 0.15 * greatest(0, least(1, 1 - (2026 - publication_year) / 10)) + 0.07 * least(ln(1 + citation_count) / ln(1001), 1) + 0.03 * completeness AS score FROM rp),
      fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, publication_year DESC, citation_count DESC, nt, id) AS rank FROM sc)"""


def said(kind: str, part: int, **columns: str) -> str:
    """A title (0) or question (1) as SQL, with each {name} replaced by its expression."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return " || ".join(columns[x] if i % 2 else quoted(x) for i, x in enumerate(re.split(r"\{(\w+)\}", FORMATS[kind][part])) if x)


def _contradicted(part: int) -> str:
    names = {x: x for x in ("topic", "concept", "paper_a", "paper_b")}
    return f"CASE WHEN conditioned THEN {said('conditioned', part, **names)} ELSE {said('contradiction', part, **names)} END"


_EVALUATION = {"topic": "lang", "method": "source", "condition": "cond"}
#: Contradictions and evaluation gaps as candidates, and their queries.
DERIVED = rf"""{CONTRADICTIONS}, {EVALUATED.replace("c AS (", "ec AS (", 1).replace(" FROM c)", " FROM ec)").replace("FROM c GROUP", "FROM ec GROUP")},
      cand AS (SELECT sha256(concat_ws(chr(31), 'contradiction', topic, paper_a, paper_b, concept)) AS id, 'c' AS kind, {_contradicted(0)} AS title, {_contradicted(1)} AS rq,
          topic, [paper_a] AS support, [paper_a, paper_b] AS cited, CASE WHEN conditioned THEN 0.38 ELSE 0.52 END AS confidence FROM pr
        UNION ALL SELECT sha256(concat_ws(chr(31), 'evaluation', lang, source, cond)), 'e', {said("evaluation", 0, **_EVALUATION)}, {said("evaluation", 1, **_EVALUATION)}, lang, ab.ids, ab.ids, 0.45
          FROM eg JOIN (SELECT lang, source, list('d' || doc_id) AS ids FROM ec GROUP BY ALL) AS ab USING (lang, source)),
      cw AS (SELECT *, list_filter({plain_words("rq", 3)}, lambda w: NOT list_contains({_list(QUESTION_STOPS)}, lower(w))) AS ws FROM cand),
      qs AS (SELECT id, CASE kind WHEN 'c' THEN [regexp_replace(title, '^(Conflicting evidence on|Context-conditioned disagreement on) ', ''), array_to_string(ws[1:3], ' ') || ' improves', array_to_string(ws[1:3], ' ') || ' degrades', array_to_string(ws[1:3], ' ') || ' evaluation benchmark']
               ELSE [title, array_to_string(ws[1:4], ' '), array_to_string(ws[1:3], ' ') || ' benchmark review', array_to_string(ws[1:2], ' ') || ' robustness solution'] END AS q FROM cw),
      oq AS (SELECT id, generate_subscripts(q, 1) AS pos, unnest(q) AS query FROM qs)"""

#: The best five papers of each such query, and which of them share three words with their candidate.
OVERLAPS = rf"""{DERIVED}, ot AS (SELECT id AS cid, pos, unnest({parts("query")}) AS t FROM oq), os AS (SELECT cid, pos, tokens.id, sum(tokens.w)::BIGINT AS hits FROM tokens JOIN ot USING (t) GROUP BY ALL),
      orr AS (SELECT *, row_number() OVER (PARTITION BY cid, pos ORDER BY hits DESC, year DESC, cites DESC, {stored_title("title")}, id) AS nth FROM os JOIN papers USING (id)),
      kw AS (SELECT *, list_distinct({plain_words("lower(title || ' ' || rq)", 3)}) AS kt FROM cand),
      fp AS (SELECT DISTINCT cid AS id, orr.id AS paper_id, list_distinct({plain_words("lower(concat_ws(' ', orr.title, abstract))", 3)}) AS pt FROM orr WHERE nth <= 5),
      ov AS (SELECT id, paper_id, len(list_intersect(kt, pt))::BIGINT AS shared FROM fp JOIN kw USING (id) WHERE NOT list_contains(support, paper_id) AND len(list_intersect(kt, pt)) >= 3)"""


def _rewritten(x: str) -> str:
    for pattern in ABSOLUTE_PATTERNS:
        x = f"regexp_replace({x}, '{pattern}', '{CORPUS_SCOPED}', 'gi')"
    return x


ORACLES: dict[str, str] = {
    "lexical_topk": f"WITH {scores(False)} SELECT query_id, rank, id AS paper_id, score FROM r WHERE rank <= 10",
    "rank_components": f"""WITH {scores(False)},
      p AS (SELECT query_id, r.id, r.year, r.cites, {dedup_title("title")} AS nt, {words_of(dedup_title("title"))} AS tt, {words_of(dedup_title("abstract"))} AS ab, {words_of(dedup_title("text"))} AS q,
                   (5 + (doi IS NOT NULL)::INT) / 6 AS completeness FROM r JOIN benchmark ON query_id = item_id WHERE rank <= 10),
      c AS (SELECT *, coalesce(len(list_intersect(q, tt)) / nullif(len(q), 0), 0) AS title_overlap, coalesce(len(list_intersect(q, ab)) / nullif(len(q), 0), 0) AS abstract_overlap,
                   greatest(0, least(1, 1 - (2026 - year) / 10)) AS recency, least(ln(1 + cites) / ln(1001), 1) AS citations FROM p),
      f AS (SELECT *, 0.5 * title_overlap + 0.25 * abstract_overlap + 0.15 * recency + 0.07 * citations + 0.03 * completeness AS score FROM c)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, year DESC, cites DESC, nt, id) AS rank, id, round(score, 9) AS score, round(title_overlap, 9) AS title_overlap,
             round(abstract_overlap, 9) AS abstract_overlap, round(recency, 9) AS recency, round(citations, 9) AS citations, round(completeness, 9) AS completeness FROM f""",
    "scoped_corpus": f"""WITH {scores(True)} SELECT query_id, rank AS paper_ord, id AS paper_id, score, ord IN (SELECT doc_id FROM labels) AS has_card, total_matching FROM r WHERE rank <= 50""",
    "evidence_retrieval": rf"""WITH {scores(True)},
      qq AS (SELECT item_id AS question_id, 'p' || item_id % 3 AS project_id, list_distinct({plain_words(fold("text"), 1)}) AS q FROM benchmark),
      lk AS (SELECT 'p' || doc_id % 3 AS project_id, 'd' || doc_id AS id, CASE WHEN toxic = 1 THEN 'seed' WHEN quality = 0 THEN 'background' ELSE 'other' END AS relation FROM labels),
      fl AS (SELECT id, list_distinct({plain_words(fold("title"), 1)}) AS t, list_distinct({plain_words(fold("abstract"), 1)}) AS a, list_distinct({plain_words(fold("concat_ws(' ', venue, papers.lang)"), 1)}) AS au,
               CASE WHEN quality IS NULL THEN [] ELSE list_distinct({plain_words(fold("concat_ws(' ', venue, papers.lang, abstract, abstract, CASE WHEN quality = 1 THEN 'improves' ELSE 'degrades' END)"), 1)}) END AS c FROM papers LEFT JOIN labels ON ord = doc_id),
      cd AS (SELECT query_id AS question_id, id FROM r WHERE rank <= 30 UNION SELECT question_id, id FROM qq JOIN lk USING (project_id)),
      h AS (SELECT question_id, project_id, id, 3.0 * len(list_intersect(q, t)) + 2.0 * len(list_intersect(q, a)) + len(list_intersect(q, c)) + len(list_intersect(q, au)) AS lexical FROM cd JOIN qq USING (question_id) JOIN fl USING (id)),
      b AS (SELECT h.*, relation, 2 * lexical + CASE relation WHEN 'seed' THEN 8 WHEN 'background' THEN 2 WHEN 'other' THEN 2 ELSE 0 END AS total FROM h LEFT JOIN lk USING (project_id, id) WHERE lexical > 0),
      z AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY total DESC, relation IS NULL, id) AS rank FROM b)
      SELECT question_id, rank, id AS paper_id, lexical::DOUBLE AS lexical, total::DOUBLE AS total FROM z WHERE rank <= 6""",
    "citation_whitelist": f"""WITH {scores(False)} SELECT query_id, string_agg(id, ',' ORDER BY rank DESC) AS ids FROM r WHERE rank <= 10 GROUP BY 1""",
    "identity_keys": f"""WITH {PAPERS}, k AS (SELECT id, list_filter([CASE WHEN doi IS NOT NULL THEN 'doi:' || doi END, CASE WHEN feed = 'arxiv' THEN 'arxiv:' || ord ELSE 'external:' || feed || ':' || ord END,
        CASE WHEN length({dedup_title("title")}) >= 8 THEN 'title:' || {dedup_title("title")} END], lambda x: x IS NOT NULL) AS ks FROM papers)
      SELECT id, generate_subscripts(ks, 1) - 1 AS pos, unnest(ks) AS key FROM k""",
    "source_pairs": f"""WITH {PAPERS} SELECT id, feed AS provider, id AS external_id FROM papers UNION SELECT id, feed, ord::VARCHAR FROM papers UNION SELECT id, 'doi', doi FROM papers WHERE doi IS NOT NULL""",
    "duplicate_components": f"""WITH {PAPERS}, {components("papers")} SELECT ord, component FROM cp""",
    "merged_papers": f"""WITH {PAPERS}, {components("papers")}, {MERGED} SELECT mg.*, '{{' || concat_ws(',', ar, '"doi":"' || doi || '"', ot) || '}}' AS external_ids FROM mg JOIN mi USING (component)""",
    "upserted_papers": f"""WITH {PAPERS}, g AS (SELECT *, ord IN (SELECT doc_id FROM labels) AS stored, CASE WHEN length({stored_title("title")}) >= 8 THEN 'title:' || {stored_title("title")} ELSE coalesce('doi:' || doi, id) END AS grp,
        CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN feed = 'arxiv' THEN 'arxiv:' || id ELSE 'source:' || feed || ':' || id END AS ck FROM papers),
      u AS (SELECT grp, 0 AS new, ord AS age, 's' || id AS rid, 'stored:' || id AS ck, 3 AS kind, cites, year, to_timestamp(ord)::TIMESTAMP AS ts FROM g WHERE stored
        UNION ALL SELECT grp, 1, 0, id, ck, CASE WHEN doi IS NOT NULL THEN 0 WHEN feed = 'arxiv' THEN 1 ELSE 2 END, cites, year, TIMESTAMP '2026-01-01' FROM g),
      o AS (SELECT grp, coalesce(first(rid ORDER BY age, rid) FILTER (new = 0), substr(min(sha256(ck)) FILTER (new = 1), 1, 32)) AS id, first(ck ORDER BY new, age, rid) AS own, first(ck ORDER BY kind, new, age, rid) AS best,
        max(cites) AS citation_count, first(year ORDER BY new, age, rid) AS publication_year, min(ts) AS first_discovered_at, max(ts) AS updated_at FROM u GROUP BY grp)
      SELECT id, CASE WHEN count(*) OVER (PARTITION BY best) = 1 THEN best ELSE own END AS canonical_key, citation_count, publication_year, first_discovered_at, updated_at FROM o""",
    "batched_search": f"""WITH {scores(False)}, ft AS (SELECT *, row_number() OVER (PARTITION BY query_id, feed ORDER BY score DESC, id) AS nth FROM s JOIN papers USING (id)),
      fe AS (SELECT query_id, ord FROM ft WHERE nth <= 10), us AS (SELECT * FROM papers WHERE ord IN (SELECT ord FROM fe)), {components("us")}, {MERGED},
      wq AS (SELECT DISTINCT query_id, component FROM fe JOIN cp USING (ord)), wp AS (SELECT query_id, {words_of(dedup_title("text"))} AS q, mg.* FROM wq JOIN mg USING (component) JOIN benchmark ON query_id = item_id), {ranked("wp")}
      SELECT query_id, rank, id, round(score, 9) AS score FROM fr WHERE rank <= 5""",
    "reconciled_discoveries": f"""WITH {SEEN} SELECT event_type AS watch_topic_id, (user::BIGINT % 25)::VARCHAR AS paper_id, min(f) AS first_seen_at, max(l) AS last_seen_at, max(r) AS rank_score FROM seen GROUP BY ALL""",
    "extraction_coverage": f"""WITH {EVALUATED} SELECT lang AS topic, 'evaluation_condition' AS dimension, count(*) FILTER (status = 'observed') AS extracted, count(*) AS cards,
      round(count(*) FILTER (status = 'observed') / count(*), 9) AS coverage FROM c GROUP BY lang HAVING count(*) FILTER (status = 'observed') > 0""",
    "coverage_gaps": f"""WITH {ORDERS}, fv AS (SELECT value, count(*) AS value_papers FROM d GROUP BY 1 HAVING count(*) >= 2)
      SELECT 'orders' AS topic, 'dataset' AS dimension, method, value, method_papers, value_papers, 0.4::DOUBLE AS confidence, {gap_id("coverage", "'orders'", f"{slug('method', 20)} || '-' || {slug('value', 20)}")} AS gap_id
      FROM fm CROSS JOIN fv WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.method = fm.method AND j.value = fv.value)""",
    "evaluation_gaps": f"""WITH {EVALUATED} SELECT lang AS topic, source AS method, cond AS condition, papers, a AS absent, 0.45::DOUBLE AS confidence,
      {gap_id("evaluation", "lang", f"{slug('source', 20)} || '-' || {slug('cond', 20)}")} AS gap_id FROM eg""",
    "method_transfers": f"""WITH {ORDERS}, fv AS (SELECT lower(value) AS target, count(*) AS target_papers FROM d GROUP BY 1 HAVING count(*) >= 2), k AS (SELECT method, lower(value) AS source, n FROM j)
      SELECT 'orders' AS topic, k.method, 'dataset' AS dimension, k.source, target, n AS source_papers, target_papers, 'unknown' AS method_class, 0.4::DOUBLE AS confidence,
        {gap_id("method_transfer", "'orders'", f"{slug('k.method', 20)} || '-dataset-' || {slug('k.source', 20)} || '-to-' || {slug('target', 20)}")} AS gap_id
      FROM k JOIN fv ON target <> k.source WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM k o WHERE o.method = k.method AND o.source = target)""",
    "contradictions": f"""WITH {CONTRADICTIONS} SELECT topic, paper_a, paper_b, concept, CASE WHEN conditioned THEN 'partially_compatible' ELSE 'compatible' END AS status,
      CASE WHEN conditioned THEN 0.38 ELSE 0.52 END::DOUBLE AS confidence, conditioned FROM pr""",
    "context_compatibility": f"""WITH {SCOPED}, f AS (SELECT topic, first(paper_id ORDER BY paper_ord) AS paper_a, first(lang ORDER BY paper_ord) AS la FROM scope GROUP BY 1)
      SELECT topic, paper_a, paper_id AS paper_b, CASE WHEN la <> lang THEN 'partially_compatible' ELSE 'compatible' END AS status, CASE WHEN la <> lang THEN 0.5 ELSE 0.7 END::DOUBLE AS compatibility
      FROM scope JOIN f USING (topic) WHERE paper_id <> paper_a""",
    "statement_groups": f"""WITH RECURSIVE {STATEMENTS} SELECT topic, paper_id, grp AS "group" FROM sg""",
    "theme_phrases": f"""WITH RECURSIVE {THEMES} SELECT topic, grp AS "group", theme FROM themes""",
    "explicit_gaps": f"""WITH RECURSIVE {THEMES}, n AS (SELECT topic, grp, count(DISTINCT paper_id) AS papers, count(*) AS statements FROM sg GROUP BY ALL HAVING count(DISTINCT paper_id) >= 2)
      SELECT topic, grp AS "group", papers, statements, least(1, round(0.4 + 0.15 * papers + 0.05 * statements, 2))::DOUBLE AS evidence_score, least(1, round(0.3 + 0.1 * papers, 2))::DOUBLE AS confidence, theme,
        {gap_id("explicit", "topic", "theme")} AS gap_id FROM n JOIN themes USING (topic, grp)""",
    "scan_claims": f"""WITH t AS (SELECT source, lower(text || CASE WHEN quality = 0 THEN ' No One Has seen the first ever' WHEN toxic = 1 THEN ' it does not exist' ELSE '' END) AS x FROM documents LEFT JOIN labels USING (doc_id)),
      p AS (SELECT unnest({_list(ABSOLUTE_PHRASES)}) AS phrase) SELECT source, phrase, count(*) AS texts FROM t JOIN p ON contains(x, phrase) GROUP BY ALL""",
    "track_discoveries": f"WITH {SEEN} SELECT event_type AS watch_topic_id, user AS paper_id, f AS first_seen_at, l AS last_seen_at, round(r, 9) AS rank_score FROM seen",
    "track_discoveries_stream": f"WITH {SEEN} SELECT event_type AS watch_topic_id, user AS paper_id, f AS first_seen_at, l AS last_seen_at, round(r, 9) AS rank_score FROM seen",
    "pending_notifications": f"""WITH {SEEN}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY r DESC, f, user) AS nth FROM seen WHERE r >= 0.35)
      SELECT event_type AS watch_topic_id, nth, user AS paper_id, round(r, 9) AS rank_score FROM n WHERE nth <= 3""",
    "notified_discoveries": f"""WITH {SEEN}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type, r >= 0.35 ORDER BY r DESC, f, user) AS nth FROM seen)
      SELECT event_type AS watch_topic_id, count(*) FILTER (r >= 0.35 AND nth <= 3) AS marked, count(*) FILTER (NOT (r >= 0.35 AND nth <= 3)) AS waiting FROM n GROUP BY 1""",
    "digest_windows": f"""WITH {SEEN} SELECT date_trunc('day', f)::TIMESTAMP AS period_start, event_type AS watch_topic_id, count(*) AS items, round(max(r), 9) AS highest_rank FROM seen GROUP BY ALL""",
    "digest_candidates": f"""WITH {SEEN}, days AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS d FROM events), it AS (SELECT user, min(l) AS fd FROM seen GROUP BY 1),
      a AS (SELECT d, user, list_sort(list_distinct(list(upper(event_type[1]) || lower(event_type[2:])))) AS names, max(r) AS hr FROM seen JOIN days ON f >= d AND f < d + INTERVAL 1 DAY GROUP BY ALL),
      b AS (SELECT d, user FROM it JOIN days ON fd >= d AND fd < d + INTERVAL 1 DAY UNION SELECT d, user FROM a)
      SELECT d AS period_start, row_number() OVER (PARTITION BY d ORDER BY coalesce(nullif(hr, 0), -1) DESC, fd DESC, 'user ' || user, user) AS rank, user AS paper_id, coalesce(array_to_string(names, ','), '') AS topic_names, round(hr, 9) AS highest_rank
      FROM b LEFT JOIN a USING (d, user) JOIN it USING (user)""",
    "digest_activity": f"""WITH {SEEN}, n AS (SELECT date_trunc('day', f)::TIMESTAMP AS period_start, upper(event_type[1]) || lower(event_type[2:]) AS topic, count(*) AS papers FROM seen GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY period_start ORDER BY papers DESC, lower(topic)) AS nth FROM n""",
    "scan_state": """WITH s AS (SELECT event_type AS id, ts, max(CASE WHEN value < 50 THEN 'low value ' || event_id END) AS e FROM events GROUP BY ALL)
      SELECT id, max(ts) FILTER (e IS NULL) AS last_scan_at, last(e ORDER BY ts) AS last_error FROM s GROUP BY id""",
    "digest_periods": """WITH r AS (SELECT date_trunc('day', ts)::TIMESTAMP AS s, count(*) AS n FROM events GROUP BY 1), c AS (SELECT max(s + INTERVAL 1 DAY) FILTER (n % 2 = 0) AS k FROM r)
      SELECT k AS period_start, TIMESTAMP '2100-01-01' AS period_end FROM c WHERE k IS NOT NULL UNION SELECT s, s + INTERVAL 1 DAY FROM r, c WHERE n % 2 = 1 AND (k IS NULL OR s + INTERVAL 1 DAY > k)
      UNION SELECT TIMESTAMP '2099-12-31', TIMESTAMP '2100-01-01' FROM c WHERE k IS NULL""",
    "detect_sections": f"WITH {SECTIONED} SELECT doc, ord, section, body FROM sec",
    "select_sections": f"""WITH {SECTIONED}, u AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord) AS nth FROM sec WHERE section <> 'References'), w AS (SELECT *, least(600, 1500 - (nth - 1) * 600) AS share FROM u),
      ch AS (SELECT doc, ord, section, {cut("body", "share")} AS excerpt FROM w WHERE share > 0)
      SELECT * FROM ch UNION ALL SELECT doc, 0, 'Unsectioned excerpt', {cut("text", "600")} FROM docs WHERE trim(text) <> '' AND doc NOT IN (SELECT doc FROM ch)""",
    "validate_evidence": rf"""WITH {SECTIONED}, cl AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS q, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS claim FROM documents),
      mb AS (SELECT doc, trim(regexp_replace({fold("body")}, '\s+', ' ', 'g')) AS b FROM sec WHERE section = 'Method'),
      v AS (SELECT doc, claim, q, coalesce(contains(b, trim(regexp_replace({fold("q")}, '\s+', ' ', 'g'))), false) AS ok FROM cl LEFT JOIN mb USING (doc))
      SELECT doc, claim, CASE WHEN ok THEN 'Method' END AS source_section, CASE WHEN ok THEN length(q) END AS quoted FROM v""",
    "text_gate": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), n AS (SELECT doc_id, x, length(x) AS n_text, length(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')) AS n_alnum FROM t)
      SELECT doc_id, n_text, n_alnum, CASE WHEN n_text > 250000 THEN 'too_long' WHEN n_text < 200 OR n_alnum < 40 THEN 'too_little_text' END AS reject_reason, sha256(x) AS content_sha256 FROM n""",
    "upsert_snapshot": """WITH i AS (SELECT o_custkey + 10 AS id, last(o_orderpriority ORDER BY o_orderkey) AS seg, last(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END ORDER BY o_orderkey) AS best FROM orders GROUP BY 1)
      SELECT coalesce(c_custkey, id) AS id, coalesce(c_name, 'x') AS name, greatest(c_acctbal, best) AS best, coalesce(seg, c_mktsegment) AS segment FROM customer FULL JOIN i ON c_custkey = id""",
    "parent_check": "SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NULL THEN 'unknown o_custkey' END AS reason FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0",
    "unique_names": "SELECT trim(regexp_replace(lower(trim(split_part(text, chr(10), 1))), '[^a-z0-9]+', '-', 'g'), '-') AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "cascade_delete": "SELECT l_suppkey, count(*) AS lines FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1",
    "feed_counts": f"""WITH {PAPERS} SELECT feed AS source, count(*) AS papers, NULL::VARCHAR AS warning FROM papers GROUP BY 1 UNION ALL SELECT 'other_feed', NULL, 'other_feed was unavailable; results may be partial.'""",
    "ingest_openalex": """SELECT 'openalex:W' || doc_id AS id, 'Work ' || doc_id AS title, text AS abstract, 2020 AS publication_year, lang AS venue, '10.1/a' || doc_id AS doi, 'https://doi.org/10.1/a' || doc_id AS url,
      CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS citation_count, '{"pmid":"' || doc_id || '","openalex":"W' || doc_id || '","doi":"10.1/a' || doc_id || '"}' AS external_ids FROM documents""",
    "derive_queries": f"""WITH {DERIVED} SELECT id, pos, query FROM oq""",
    "overlap_check": f"""WITH {OVERLAPS} SELECT id, paper_id, shared FROM ov""",
    "critic_decisions": f"""WITH {OVERLAPS}, on_card AS (SELECT 'd' || doc_id AS paper_id, doc_id, lang, list_distinct({plain_words("lower(source || ' improves under ' || word)", 3)}) AS cw FROM ec WHERE doc_id % 10 = 0),
      rs AS (SELECT id, first(paper_id ORDER BY doc_id) AS resolved_by FROM kw JOIN on_card ON topic = lang WHERE len(list_intersect(kt, cw)) >= 3 AND NOT list_contains(cited, paper_id) GROUP BY id),
      on_fresh AS (SELECT id, count(*) AS n FROM ov GROUP BY id),
      dc AS (SELECT kw.id, confidence, resolved_by, coalesce(n, 0) AS overlapping FROM kw LEFT JOIN rs USING (id) LEFT JOIN on_fresh USING (id))
      SELECT id, CASE WHEN resolved_by IS NOT NULL THEN 'rejected' WHEN overlapping > 0 THEN 'downgraded' ELSE 'preserved' END AS decision, resolved_by, overlapping::INT AS overlapping,
        CASE WHEN resolved_by IS NOT NULL THEN 0 WHEN overlapping > 0 THEN round(greatest(0.1, confidence - 0.15), 2) ELSE round(least(1, confidence + 0.15), 2) END::DOUBLE AS new_confidence FROM dc""",
    "ingest_arxiv": r"""SELECT 'arxiv:2401.' || doc_id AS id, 'Entry ' || doc_id AS title, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS abstract, source AS authors, (2000 + doc_id % 20)::INT AS publication_year, lang AS venue,
      CASE WHEN doc_id % 2 = 0 THEN '10.1/b' || doc_id END AS doi, 'http://arxiv.org/abs/2401.' || doc_id || 'v2' AS url,
      '{"arxiv":"2401.' || doc_id || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"doi":"10.1/b' || doc_id || '"' ELSE '' END || '}' AS external_ids FROM documents WHERE doc_id % 50 <> 0""",
    "ingest_semantic_scholar": r"""SELECT 'semantic_scholar:p' || doc_id AS id, 'Record ' || doc_id AS title, sha256(trim(text, ' ')) AS abstract, source AS authors, CASE WHEN doc_id % 3 <> 0 THEN 2019 END AS publication_year, lang AS venue,
      '10.2/c' || doc_id AS doi, 'https://s2.example/' || doc_id AS url, n_chars::INT AS citation_count, '{"arxiv":"2401.' || doc_id || '","semantic_scholar":"p' || doc_id || '","doi":"10.2/c' || doc_id || '"}' AS external_ids
      FROM documents WHERE doc_id % 50 <> 0""",
    "retrieved_gaps": rf"""WITH qq AS (SELECT item_id AS question_id, 'p' || item_id % 3 AS project_id, list_distinct({plain_words(fold("text"), 1)}) AS q FROM benchmark),
      gp AS (SELECT doc_id, 'g' || doc_id AS id, list_distinct({plain_words(fold("split_part(text, chr(10), 1)"), 1)}) AS t, list_distinct({plain_words(fold("text"), 1)}) AS d, list_distinct({plain_words(fold("split_part(text, chr(10), 1) || ' ' || source"), 1)}) AS r,
        row_number() OVER (ORDER BY n_chars DESC, 'g' || doc_id) <= 50 AS recent FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
      lk AS (SELECT 'p' || doc_id % 3 AS project_id, 'g' || doc_id AS id, CASE WHEN toxic = 1 THEN 'rejected' ELSE 'interesting' END AS status FROM labels WHERE quality = 0 OR toxic = 1),
      h AS (SELECT question_id, gp.id, recent, status, 3.0 * len(list_intersect(q, t)) + 2.0 * len(list_intersect(q, d)) + 2.0 * len(list_intersect(q, r)) AS lexical FROM qq CROSS JOIN gp LEFT JOIN lk ON lk.project_id = qq.project_id AND lk.id = gp.id),
      b AS (SELECT *, 2 * lexical + CASE WHEN status = 'interesting' THEN 4 ELSE 0 END AS total FROM h WHERE lexical > 0 AND (recent OR status IS NOT NULL)),
      z AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY total DESC, status IS NULL, id) AS rank FROM b)
      SELECT question_id, rank, id AS candidate_id, lexical::DOUBLE AS lexical, total::DOUBLE AS total FROM z WHERE rank <= 4""",
    "analyzed_topics": f"""WITH {CONTRADICTIONS}, c1 AS (SELECT query_id::VARCHAR AS query_id, count(*) FILTER (ord IN (SELECT doc_id FROM labels)) AS cards, count(*) FILTER (ord NOT IN (SELECT doc_id FROM labels)) AS unread, max(total_matching) AS matching FROM r WHERE rank <= 50 GROUP BY 1),
      m1 AS (SELECT topic AS query_id, count(DISTINCT (paper_a, paper_b, concept)) AS mined FROM pr GROUP BY 1),
      t1 AS (SELECT b.item_id::VARCHAR AS query_id, coalesce(cards, 0) AS cards, coalesce(unread, 0) AS unread, coalesce(matching, 0) AS matching, coalesce(mined, 0) AS mined FROM benchmark b LEFT JOIN c1 ON c1.query_id = b.item_id::VARCHAR LEFT JOIN m1 ON m1.query_id = b.item_id::VARCHAR)
      SELECT *, CASE WHEN cards < 2 THEN 'insufficient structured evidence' WHEN mined = 0 THEN 'no contradiction gap was found' ELSE 'mined' END AS status FROM t1""",
    "analyzed_gaps": f"""WITH {EVALUATED}, n AS (SELECT *, {gap_id("evaluation", "lang", f"{slug('source', 20)} || '-' || {slug('cond', 20)}")} AS id, sha256(concat_ws(chr(31), 'evaluation', lang, source, cond)) AS key FROM eg),
      o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY id, key) AS nth FROM n)
      SELECT lang AS topic, id, {said("evaluation", 0, **_EVALUATION)} AS title, CASE WHEN lang = 'en' THEN 0.9 ELSE 0.45 END::DOUBLE AS confidence, lang = 'en' AS was_stored FROM o WHERE nth <= 2""",
    "scanned_topics": f"""WITH {scores(False)}, ft AS (SELECT *, row_number() OVER (PARTITION BY query_id, feed ORDER BY score DESC, id) AS nth FROM s JOIN papers USING (id) WHERE query_id % 2 = 0),
      fe AS (SELECT query_id, ord FROM ft WHERE nth <= 20), us AS (SELECT * FROM papers WHERE ord IN (SELECT ord FROM fe)), {components("us")}, {MERGED},
      wq AS (SELECT DISTINCT query_id, component FROM fe JOIN cp USING (ord)), wp AS (SELECT query_id, {words_of(dedup_title("text"))} AS q, mg.* FROM wq JOIN mg USING (component) JOIN benchmark ON query_id = item_id), {ranked("wp")}
      SELECT query_id AS watch_topic_id, id AS paper_id, round(score, 9) AS rank_score, true AS is_new FROM fr WHERE rank <= 10""",
    "retrieval_log": f"""WITH {OVERLAPS}, g AS (SELECT cid AS id, pos, string_agg(orr.id, ',' ORDER BY nth) AS ids, count(*) AS n FROM orr WHERE nth <= 5 GROUP BY ALL)
      SELECT oq.id, oq.pos, query, coalesce(ids, '') AS ids, coalesce(n, 0) AS result_count, 'openalex,semantic_scholar' AS answered, 'arxiv' AS failed FROM oq LEFT JOIN g ON g.id = oq.id AND g.pos = oq.pos""",
    "appended_reviews": """WITH k AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
      a AS (SELECT o_custkey, o_orderkey, (coalesce(n, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS v FROM orders LEFT JOIN b USING (o_custkey) WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM k))
      SELECT o_custkey AS candidate_id, o_orderkey, v AS review_version, NULL::VARCHAR AS reason FROM a
      UNION ALL SELECT o_custkey, o_orderkey, NULL, 'unknown candidate_id' FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT c_custkey FROM k)""",
    "reconciled_cards": """SELECT (o_orderkey % 100)::VARCHAR AS paper_id, last(o_orderpriority ORDER BY o_orderdate, o_orderkey < 100, o_orderkey::VARCHAR) AS problem, to_timestamp(min(o_orderkey))::TIMESTAMP AS created_at,
      max(o_orderdate)::TIMESTAMP AS updated_at FROM orders GROUP BY 1""",
    "reconciled_sources": """WITH e AS (SELECT user_id, event_type, max(ts) AS t, min(event_id) AS e FROM events GROUP BY ALL)
      SELECT (user_id % 25)::VARCHAR AS paper_id, event_type AS provider, 'x' AS external_id, max(t) AS retrieved_at, first('https://events.example/' || e ORDER BY user_id >= 25, user_id::VARCHAR) FILTER (e % 3 <> 0) AS source_url FROM e GROUP BY ALL""",
    "picked_insights": """SELECT 'd' || doc_id AS paper_id, CASE doc_id % 5 WHEN 1 THEN 'Stored claim' WHEN 2 THEN 'Method' ELSE 'Contribution' END AS kind,
      CASE doc_id % 5 WHEN 2 THEN source ELSE text END AS text, CASE doc_id % 5 WHEN 1 THEN 'Results' END AS source_section FROM documents WHERE doc_id % 5 <> 4""",
    "first_fit_groups": f"""WITH RECURSIVE {STATEMENTS} SELECT topic, paper_id, grp AS "group" FROM sg""",
    "transfers_by_class": f"""WITH b AS (SELECT doc_id, lang, ({_list(METHOD_NAMES)})[n_chars % {len(METHOD_NAMES)} + 1] AS method, lower(source) AS dataset, 'modality ' || n_chars % 5 AS modality FROM documents WHERE n_chars % 10 <> 4),
      v AS (SELECT doc_id, lang, method, 'dataset' AS dimension, dataset AS value FROM b UNION ALL SELECT doc_id, lang, method, 'modality', modality FROM b), big AS (SELECT lang FROM b GROUP BY 1 HAVING count(*) >= 4),
      k AS (SELECT lang, method, dimension, value, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT lang, dimension, value AS target, count(*) AS target_papers FROM v GROUP BY ALL HAVING count(*) >= 2),
      cl AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(lower(method), '{'|'.join(w)}') THEN '{c}'" for c, w in CLASSES.items())} ELSE 'unknown' END AS method_class FROM k WHERE n >= 2 AND lang IN (SELECT lang FROM big)),
      fs(method_class, dimension, feasibility) AS (VALUES {", ".join(f"('{c}', '{d}', {x}::DOUBLE)" for c, ds in FEASIBILITY.items() for d, x in ds.items())})
      SELECT cl.lang AS topic, method, dimension, value AS source, target, n AS source_papers, target_papers, method_class, feasibility, round(least(0.8, feasibility * 0.8), 2) AS confidence
      FROM cl JOIN fs USING (method_class, dimension) JOIN t USING (lang, dimension) WHERE target <> value AND NOT EXISTS (SELECT 1 FROM k o WHERE o.lang = cl.lang AND o.method = cl.method AND o.dimension = cl.dimension AND o.value = target)""",
    "cleaned_papers": f"""WITH {PAPERS} SELECT id, 'T' || id AS title, venue, venue AS authors, CASE WHEN ord % 7 <> 0 THEN cites::INT END AS citation_count, '{{"doi":"' || id || '"}}' AS external_ids FROM papers WHERE ord % 50 <> 0""",
    "names_and_links": f"""WITH {PAPERS} SELECT id, 'topic ' || lower(venue) || ' ' || lang AS name, 'https://doi.org/' || doi AS link FROM papers WHERE doi IS NOT NULL
      UNION ALL SELECT id, 'topic ' || lower(venue) || ' ' || lang, 'https://papers.example/' || ord FROM papers WHERE doi IS NULL""",
    "rewritten_claims": f"""WITH t AS (SELECT doc_id, text || ({_list(CLAIM_TAILS)})[doc_id % {len(CLAIM_TAILS)} + 1] AS x FROM documents), y AS (SELECT doc_id, {_rewritten("x")} AS t FROM t)
      SELECT doc_id, length(t) AS n, sha256(t) AS digest FROM y""",
    "latest_reviews": "SELECT o_custkey AS candidate_id, max(o_orderkey) AS review_version, last(o_orderstatus ORDER BY o_orderkey) AS decision, last(o_orderpriority ORDER BY o_orderkey) AS rationale FROM orders GROUP BY 1",
    "candidate_details": """SELECT c_custkey AS id, CASE WHEN count(o_orderkey) > 0 THEN count(o_orderkey) END AS n, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS decisions FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "listed_candidates": "SELECT c_custkey AS id, c_mktsegment AS gap_type, to_timestamp(c_custkey % 100)::TIMESTAMP AS created_at FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey % 100 DESC, c_custkey LIMIT 20",
    "updated_status": """WITH l AS (SELECT o_custkey + 100 AS id, last(o_orderstatus ORDER BY o_orderkey) AS s, last(o_totalprice ORDER BY o_orderkey) AS p FROM orders GROUP BY 1)
      SELECT c_custkey AS id, c_mktsegment AS gap_type, coalesce(s, 'open') AS review_status, coalesce(p, c_acctbal) AS confidence FROM customer LEFT JOIN l ON id = c_custkey""",
    "upserted_cards": """WITH o AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), n AS (SELECT *, split_part(text, chr(10), 1) AS line, CASE WHEN doc_id % 4 = 0 THEN 'given' END AS url FROM documents WHERE doc_id % 2 = 0),
      a AS (SELECT * FROM n WHERE lang <> 'de')
      SELECT 'd' || coalesce(o.doc_id, a.doc_id) AS paper_id, coalesce(a.line, 'old') AS problem, coalesce(a.url, o.source) AS source_url, coalesce(a.source, o.lang) AS sections,
        coalesce(to_timestamp(o.doc_id)::TIMESTAMP, TIMESTAMP '2026-01-01') AS created_at, CASE WHEN a.doc_id IS NULL THEN to_timestamp(o.doc_id)::TIMESTAMP ELSE TIMESTAMP '2026-01-01' END AS updated_at, NULL::VARCHAR AS reason
      FROM o FULL JOIN a ON o.doc_id = a.doc_id
      UNION ALL SELECT 'd' || doc_id, line, url, source || ',' || source, TIMESTAMP '2026-01-01', TIMESTAMP '2026-01-01', 'unknown paper_id' FROM n WHERE lang = 'de'""",
}


_KEY = {
    "explicit": "sha256(concat_ws(chr(31), 'explicit', topic, grp, theme))", "contradiction": "sha256(concat_ws(chr(31), 'contradiction', topic, paper_a, paper_b, concept))",
    "evaluation": "sha256(concat_ws(chr(31), 'evaluation', lang, source, cond))", "coverage": "sha256(concat_ws(chr(31), 'coverage', lang, dimension, method, value))",
    "transfer": "sha256(concat_ws(chr(31), 'method_transfer', lang, method, dimension, source, target))",
}
#: Coverage gaps (cg) and transfers (tg) of documents as cards with methods, by language; vv and lv have each paper's values.
MOVED = f"""b AS (SELECT doc_id, 'd' || doc_id AS paper_id, lang, ({_list(METHOD_NAMES)})[n_chars % {len(METHOD_NAMES)} + 1] AS method, source AS dataset, 'Modality ' || n_chars % 5 AS modality FROM documents WHERE n_chars % 10 <> 4),
      vv AS (SELECT doc_id, paper_id, lang, method, 'dataset' AS dimension, dataset AS value FROM b UNION ALL SELECT doc_id, paper_id, lang, method, 'modality', modality FROM b), lv AS (SELECT * REPLACE (lower(value) AS value) FROM vv),
      big AS (SELECT lang, count(*) AS cards FROM b GROUP BY 1), cm AS (SELECT lang, method FROM b GROUP BY ALL HAVING count(*) >= 2), cv AS (SELECT lang, dimension, value FROM vv GROUP BY ALL HAVING count(*) >= 2),
      cg AS (SELECT lang, dimension, method, value FROM cm JOIN cv USING (lang) JOIN big USING (lang) WHERE cards >= 2 AND NOT EXISTS (SELECT 1 FROM vv o WHERE o.lang = cm.lang AND o.method = cm.method AND o.dimension = cv.dimension AND o.value = cv.value)),
      kn AS (SELECT lang, method, dimension, value AS source, CASE {" ".join(f"WHEN regexp_matches(lower(method), '{'|'.join(w)}') THEN '{c}'" for c, w in CLASSES.items())} ELSE 'unknown' END AS method_class FROM lv JOIN big USING (lang) WHERE cards >= 4 GROUP BY ALL HAVING count(*) >= 2),
      ft AS (SELECT lang, dimension, value AS target FROM lv GROUP BY ALL HAVING count(*) >= 2), fs(method_class, dimension) AS (VALUES {", ".join(f"('{c}', '{d}')" for c, ds in FEASIBILITY.items() for d in ds)}),
      tg AS (SELECT kn.lang, method, dimension, source, target FROM kn JOIN fs USING (method_class, dimension) JOIN ft USING (lang, dimension) WHERE source <> target AND NOT EXISTS (SELECT 1 FROM lv o WHERE o.lang = kn.lang AND o.method = kn.method AND o.dimension = kn.dimension AND o.value = target))"""
_REPEATED = "rg AS (SELECT topic, grp FROM sg GROUP BY ALL HAVING count(DISTINCT paper_id) >= 2)"

#: The papers that candidates of each kind rest on.
SUPPORTS = {
    "explicit": f"WITH RECURSIVE {THEMES}, {_REPEATED} SELECT DISTINCT {_KEY['explicit']} AS gap_key, paper_id, 'supporting' AS side FROM sg JOIN rg USING (topic, grp) JOIN themes USING (topic, grp)",
    "contradiction": f"WITH {CONTRADICTIONS} SELECT {_KEY['contradiction']} AS gap_key, paper_a AS paper_id, 'supporting' AS side FROM pr UNION SELECT {_KEY['contradiction']}, paper_b, 'conflicting' FROM pr",
    "evaluation": f"WITH {EVALUATED} SELECT {_KEY['evaluation']} AS gap_key, 'd' || doc_id AS paper_id, 'supporting' AS side FROM eg JOIN c USING (lang, source)",
    "coverage": f"WITH {MOVED} SELECT {_KEY['coverage']} AS gap_key, paper_id, 'supporting' AS side FROM cg JOIN b USING (lang, method) UNION SELECT {_KEY['coverage']}, paper_id, 'supporting' FROM cg JOIN (SELECT lang, dimension, value, paper_id FROM vv) USING (lang, dimension, value)",
    "transfer": f"""WITH {MOVED} SELECT {_KEY['transfer']} AS gap_key, paper_id, 'supporting' AS side FROM tg JOIN (SELECT lang, method, dimension, value AS source, paper_id FROM lv) USING (lang, method, dimension, source)
      UNION SELECT {_KEY['transfer']}, paper_id, 'supporting' FROM tg JOIN (SELECT lang, dimension, value AS target, paper_id FROM lv) USING (lang, dimension, target)""",
}


def _nth(keys: str, order: str = "paper_id") -> str:
    return f"row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS nth"


_ROW = "NULL::VARCHAR AS source_section"
#: Their pieces of evidence.
EVIDENCE = {
    "explicit": f"""WITH RECURSIVE {THEMES}, {_REPEATED} SELECT {_KEY['explicit']} AS gap_key, 'supporting' AS side, row_number() OVER (PARTITION BY topic, grp ORDER BY nth)::INT AS pos, paper_id, 'limitations[0]' AS claim_or_field,
      'limitations' AS source_section, statement AS supporting_text FROM sg JOIN rg USING (topic, grp) JOIN themes USING (topic, grp)""",
    "contradiction": f"""WITH {CONTRADICTIONS} SELECT {_KEY['contradiction']} AS gap_key, 'supporting' AS side, 1 AS pos, paper_a AS paper_id, 'main_claims' AS claim_or_field, {_ROW}, claim AS supporting_text FROM pr JOIN cl USING (topic) WHERE cl.paper_id = paper_a
      UNION ALL SELECT {_KEY['contradiction']}, 'conflicting', 1, paper_b, 'main_claims', NULL, claim FROM pr JOIN cl USING (topic) WHERE cl.paper_id = paper_b""",
    "evaluation": f"""WITH {EVALUATED}, ab AS (SELECT lang, source, cond, 'd' || doc_id AS paper_id, row_number() OVER (PARTITION BY lang, source, cond ORDER BY 'd' || doc_id) AS nth FROM k WHERE status = 'explicitly_absent'),
      a3 AS (SELECT eg.lang, eg.source, eg.cond, paper_id, nth FROM eg JOIN ab USING (lang, source, cond) WHERE nth <= 3),
      ot AS (SELECT lang, source, cond, 'd' || doc_id AS paper_id, row_number() OVER (PARTITION BY lang, source, cond ORDER BY 'd' || doc_id) AS nth FROM eg JOIN c USING (lang, source) WHERE NOT EXISTS (SELECT 1 FROM a3 x WHERE x.lang = eg.lang AND x.source = eg.source AND x.cond = eg.cond AND x.paper_id = 'd' || doc_id)),
      na AS (SELECT lang, source, cond, count(*) AS n FROM a3 GROUP BY ALL)
      SELECT {_KEY['evaluation']} AS gap_key, 'supporting' AS side, nth::INT AS pos, paper_id, 'evaluation_conditions' AS claim_or_field, {_ROW}, NULL::VARCHAR AS supporting_text FROM a3
      UNION ALL SELECT {_KEY['evaluation']}, 'supporting', (n + nth)::INT, paper_id, 'methods', NULL, 'uses ' || source FROM ot JOIN na USING (lang, source, cond) WHERE n + nth <= 3""",
    "coverage": f"""WITH {MOVED}, m2 AS (SELECT lang, method, paper_id, {_nth('lang, method')} FROM b), v2 AS (SELECT lang, dimension, value, paper_id, {_nth('lang, dimension, value')} FROM vv)
      SELECT {_KEY['coverage']} AS gap_key, 'supporting' AS side, nth::INT AS pos, paper_id, 'methods' AS claim_or_field, {_ROW}, 'uses ' || method AS supporting_text FROM cg JOIN m2 USING (lang, method) WHERE nth <= 2
      UNION ALL SELECT {_KEY['coverage']}, 'supporting', nth::INT + 2, paper_id, dimension, NULL, 'uses ' || value FROM cg JOIN v2 USING (lang, dimension, value) WHERE nth <= 2""",
    "transfer": f"""WITH {MOVED}, s2 AS (SELECT lang, method, dimension, value AS source, paper_id, {_nth('lang, method, dimension, value')} FROM lv), t2 AS (SELECT lang, dimension, value AS target, paper_id, {_nth('lang, dimension, value', 'doc_id')} FROM lv)
      SELECT {_KEY['transfer']} AS gap_key, 'supporting' AS side, nth::INT AS pos, paper_id, 'methods' AS claim_or_field, {_ROW}, NULL::VARCHAR AS supporting_text FROM tg JOIN s2 USING (lang, method, dimension, source) WHERE nth <= 2
      UNION ALL SELECT {_KEY['transfer']}, 'supporting', nth::INT + 2, paper_id, CASE dimension WHEN 'dataset' THEN 'datasets' ELSE 'modalities' END, NULL, NULL FROM tg JOIN t2 USING (lang, dimension, target) WHERE nth <= 2""",
}


def _union(parts: dict[str, str], *kinds: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({parts[k]})" for k in kinds or parts)


ORACLES["candidate_supports"] = f"WITH s AS ({_union(SUPPORTS)}) SELECT gap_key, side, count(*) AS papers, sha256(string_agg(paper_id, ',' ORDER BY paper_id)) AS ids_sha256 FROM s GROUP BY ALL"
ORACLES["candidate_evidence"] = _union(EVIDENCE)
_METHODS = {
    "coverage": {"method": "method", "value": "value", "dimension": "dimension", "topic": "lang"}, "method_transfer": {"method": "method", "target": "target", "source": "source", "dimension": "dimension", "topic": "lang"},
}
_USED = f"text || ' This uses ' || ({_list(METHOD_NAMES)})[n_chars % {len(METHOD_NAMES)} + 1] || ' evaluated on dataset ' || source"
ORACLES["overlap_of_methods"] = rf"""WITH {PAPERS.replace("text AS abstract", f"{_USED} AS abstract")}, {INDEX}, sp AS ({_union(SUPPORTS, "coverage", "transfer")}), {MOVED},
      cand AS (SELECT {_KEY["coverage"]} AS id, 'c' AS kind, {said("coverage", 0, **_METHODS["coverage"])} AS title, {said("coverage", 1, **_METHODS["coverage"])} AS rq FROM cg
        UNION ALL SELECT {_KEY["transfer"]}, 't', {said("method_transfer", 0, **_METHODS["method_transfer"])}, {said("method_transfer", 1, **_METHODS["method_transfer"])} FROM tg),
      cw AS (SELECT *, list_filter({plain_words("rq", 3)}, lambda w: NOT list_contains({_list(QUESTION_STOPS)}, lower(w))) AS ws FROM cand),
      qs AS (SELECT id, CASE kind WHEN 't' THEN [title, array_to_string(ws[1:3], ' '), array_to_string(ws[1:3], ' ') || ' evaluation', array_to_string(ws[1:3], ' ') || ' benchmark']
               ELSE [title, array_to_string(ws[1:4], ' '), array_to_string(ws[1:3], ' ') || ' benchmark review', array_to_string(ws[1:2], ' ') || ' robustness solution'] END AS q FROM cw),
      oq AS (SELECT id, generate_subscripts(q, 1) AS pos, unnest(q) AS query FROM qs),
      ot AS (SELECT id AS cid, pos, unnest({parts("query")}) AS t FROM oq), os AS (SELECT cid, pos, tokens.id, sum(tokens.w)::BIGINT AS hits FROM tokens JOIN ot USING (t) GROUP BY ALL),
      orr AS (SELECT *, row_number() OVER (PARTITION BY cid, pos ORDER BY hits DESC, year DESC, cites DESC, {stored_title("title")}, id) AS nth FROM os JOIN papers USING (id)),
      kw AS (SELECT *, list_distinct({plain_words("lower(title || ' ' || rq)", 3)}) AS kt FROM cand),
      fp AS (SELECT DISTINCT cid AS id, id AS paper_id FROM orr WHERE nth <= 5), pw AS (SELECT id AS paper_id, list_distinct({plain_words("lower(concat_ws(' ', title, abstract))", 3)}) AS pt FROM papers WHERE id IN (SELECT paper_id FROM fp))
      SELECT id, paper_id, len(list_intersect(kt, pt))::BIGINT AS shared FROM fp JOIN kw USING (id) JOIN pw USING (paper_id) WHERE NOT EXISTS (SELECT 1 FROM sp WHERE gap_key = id AND sp.paper_id = fp.paper_id) AND len(list_intersect(kt, pt)) >= 3"""
ORACLES["reviewed_provenance"] = rf"""WITH {OVERLAPS}, on_card AS (SELECT 'd' || doc_id AS paper_id, doc_id, lang, list_distinct({plain_words("lower(source || ' improves under ' || word)", 3)}) AS cw FROM ec WHERE doc_id % 10 = 0),
      rs AS (SELECT id, first(paper_id ORDER BY doc_id) AS resolved_by FROM kw JOIN on_card ON topic = lang WHERE len(list_intersect(kt, cw)) >= 3 AND NOT list_contains(cited, paper_id) GROUP BY id),
      on_fresh AS (SELECT id, count(*) AS n FROM ov GROUP BY id),
      g AS (SELECT cid AS id, pos, string_agg(orr.id, '+' ORDER BY nth) AS ids FROM orr WHERE nth <= 5 GROUP BY ALL),
      lg AS (SELECT oq.id, count(*) AS n, sha256(string_agg(query || '|' || coalesce(ids, '') || '|arxiv', ',' ORDER BY oq.pos)) AS retrieved FROM oq LEFT JOIN g ON g.id = oq.id AND g.pos = oq.pos GROUP BY oq.id),
      evd AS ({_union(EVIDENCE, "contradiction", "evaluation")}), su AS ({_union(SUPPORTS, "contradiction", "evaluation")}),
      e1 AS (SELECT gap_key, count(*) AS n, coalesce(string_agg(paper_id || ':' || claim_or_field, ',' ORDER BY pos) FILTER (side = 'supporting'), '') AS f, coalesce(string_agg(paper_id || ':' || claim_or_field, ',' ORDER BY pos) FILTER (side = 'conflicting'), '') AS a FROM evd GROUP BY 1),
      s1 AS (SELECT gap_key, count(*) FILTER (side = 'supporting') AS f, count(*) FILTER (side = 'conflicting') AS a FROM su GROUP BY 1),
      co AS (SELECT topic, count(DISTINCT paper_id) AS n FROM scope GROUP BY 1 UNION ALL SELECT lang, count(*) FROM ec GROUP BY 1)
      SELECT cand.id AS gap_key, CASE WHEN resolved_by IS NOT NULL THEN 'rejected' ELSE 'downgraded' END AS review_status, CASE WHEN resolved_by IS NOT NULL THEN 0 ELSE round(greatest(0.1, confidence - 0.15), 2) END::DOUBLE AS confidence, e1.n::INT AS evidence_count,
        s1.f::INT AS supporting, s1.a::INT AS conflicting, co.n::INT AS corpus, co.n || ' stored cards of ' || topic AS search_scope, lg.n::INT AS retrievals, retrieved, e1.f AS evidence_for,
        concat_ws(',', nullif(e1.a, ''), resolved_by || ':main_claims') AS evidence_against, (2 + (kind = 'c' AND confidence = 0.38)::INT + 1)::INT AS caveats
      FROM cand JOIN e1 ON e1.gap_key = cand.id JOIN s1 ON s1.gap_key = cand.id JOIN co USING (topic) JOIN lg ON lg.id = cand.id LEFT JOIN rs ON rs.id = cand.id LEFT JOIN on_fresh ON on_fresh.id = cand.id"""


def _short(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) <= {n} THEN {x} ELSE substr({x}, 1, {n - 3}) || '...' END)"


_CLAIM = "d.text || CASE WHEN quality = 1 THEN ' improves' ELSE ' degrades' END"
ORACLES["evidence_packets"] = f"""WITH ev AS ({ORACLES["evidence_retrieval"]}), gv AS ({ORACLES["retrieved_gaps"]}),
      asked AS (SELECT item_id AS question_id, 'p' || item_id % 3 AS project_id FROM benchmark), pj AS (SELECT DISTINCT 'p' || doc_id % 3 AS id FROM labels),
      bp AS (SELECT question_id, 0 AS part, 0 AS rank, concat_ws(chr(10), '# Project', 'name: Project ' || id, 'goal: ' || CASE WHEN id <> 'p0' THEN 'Goal of ' || id ELSE 'none' END, 'keywords: key, ' || id, 'constraints: few papers',
        CASE WHEN id = 'p1' THEN 'given up earlier, not to be proposed again: an old idea' END) AS text FROM asked JOIN pj ON id = project_id),
      pp AS (SELECT question_id, 1 AS part, rank, concat_ws(chr(10), '# Paper ' || paper_id, 'title: ' || split_part(d.text, chr(10), 1), 'abstract: ' || {_short("coalesce(nullif(d.text, ''), 'none')", 300)},
          CASE WHEN 'p' || doc_id % 3 = project_id AND quality IS NOT NULL THEN 'relation to the project: ' || CASE WHEN toxic = 1 THEN 'seed, note: read first' WHEN quality = 0 THEN 'background, note: none' ELSE 'other, note: none' END END,
          CASE WHEN quality IS NOT NULL THEN concat_ws(chr(10), 'methods: ' || source, 'data: ' || lang, 'claims: "' || {_short(_CLAIM, 100)} || '" [Section]', 'limitations: ' || nullif(d.text, '')) END) AS text
        FROM ev JOIN asked USING (question_id) JOIN documents d ON 'd' || doc_id = paper_id LEFT JOIN labels USING (doc_id)),
      gg AS (SELECT question_id, 2 AS part, rank, concat_ws(chr(10), '# Gap ' || candidate_id, 'title: ' || split_part(d.text, chr(10), 1), 'kind: explicit', 'review: pending', 'confidence: ' || CASE WHEN doc_id % 2 = 0 THEN '0.5' ELSE 'unknown' END,
          'question: ' || {_short("split_part(d.text, chr(10), 1) || ' ' || source", 200)}, 'description: ' || {_short("d.text", 200)},
          CASE WHEN 'p' || doc_id % 3 = project_id AND toxic = 1 THEN 'status in the project: rejected (closed, no open gap any more)' WHEN 'p' || doc_id % 3 = project_id AND quality = 0 THEN 'status in the project: interesting (open)' END,
          CASE WHEN doc_id % 2 = 0 THEN 'last review, version 2: downgraded; ' || {_short("split_part(d.text, chr(10), 1)", 150)} || '; caveats: ' || source || ', ' || lang END) AS text
        FROM gv JOIN asked USING (question_id) JOIN documents d ON 'g' || doc_id = candidate_id LEFT JOIN labels USING (doc_id)),
      al AS (SELECT question_id, part, rank, text FROM bp UNION ALL SELECT question_id, part, rank, {_short("text", 600)} FROM pp UNION ALL SELECT question_id, part, rank, {_short("text", 600)} FROM gg),
      pk AS (SELECT question_id, string_agg(text, chr(10) || chr(10) ORDER BY part, rank) AS p FROM al GROUP BY 1), tr AS (SELECT question_id, {_short("p", 8000)} AS p FROM pk)
      SELECT item_id AS question_id, length(coalesce(p, '')) AS n, sha256(coalesce(p, '')) AS digest FROM benchmark LEFT JOIN tr ON item_id = question_id"""

ORACLES["delivered_notifications"] = f"""WITH {SEEN}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY r DESC, f, user) AS nth FROM seen WHERE r >= 0.35)
      SELECT event_type AS watch_topic_id, user AS paper_id, round(r, 9) AS rank_score, 1::BIGINT AS times, nth::INT AS nth FROM n WHERE nth <= 3"""
ORACLES["daily_digests_stream"] = """WITH f AS (SELECT event_type, value / 500 AS r, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, value DESC) AS k FROM events)
      SELECT date_trunc('day', ts)::TIMESTAMP AS period_start, event_type AS watch_topic_id, count(*) AS items, round(max(r), 9) AS highest_rank FROM f WHERE k = 1 GROUP BY ALL"""
ORACLES["indexed_search"] = ORACLES["lexical_topk"]
ORACLES["upserted_partitions"] = """WITH i AS (SELECT o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 100000000 END AS id, o_orderpriority AS p, o_totalprice + 1 AS t FROM orders WHERE o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') AND o_orderstatus <> 'F'),
      a AS (SELECT coalesce(o_orderpriority, p) AS priority, coalesce(t, o_totalprice) AS total, o_orderstatus AS status FROM orders FULL JOIN i ON o_orderkey = id AND o_orderpriority = p)
      SELECT priority, count(*) AS orders, round(sum(total), 2) AS total, count(status) AS with_status, priority IN (SELECT p FROM i) AS rewritten FROM a GROUP BY priority"""
ORACLES["document_files"] = r"""WITH t AS (SELECT doc_id, coalesce(text, '') || chr(10) AS x FROM documents), n AS (SELECT doc_id, x, octet_length(encode(x)) AS b, length(x) AS n, length(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')) AS a FROM t),
      j AS (SELECT *, CASE WHEN b > 20000 THEN 'too_large' WHEN n < 200 OR a < 40 THEN 'too_little_text' END AS reason FROM n)
      SELECT doc_id, CASE WHEN reason IS NULL THEN n END AS n_text, CASE WHEN reason IS NULL THEN sha256(x) END AS content_sha256, reason FROM j"""
ORACLES["quarantined_feeds"] = """WITH r AS (SELECT 'openalex' AS source, CASE WHEN doc_id % 10 = 3 THEN 'not parsed' WHEN doc_id % 50 = 0 THEN 'no title' ELSE 'papers' END AS reason FROM documents
        UNION ALL SELECT 'semantic_scholar', CASE WHEN doc_id % 10 = 3 THEN 'not parsed' WHEN doc_id % 7 = 0 THEN 'no id' WHEN doc_id % 50 = 0 THEN 'no title' ELSE 'papers' END FROM documents
        UNION ALL SELECT 'arxiv', CASE WHEN doc_id % 10 = 3 THEN 'not parsed' WHEN doc_id % 50 = 0 THEN 'no entry but an error' ELSE 'papers' END FROM documents),
      l AS (SELECT source, count(*) AS n FROM r WHERE reason <> 'papers' GROUP BY 1)
      SELECT source, reason, count(*) AS records, CASE WHEN reason = 'papers' THEN n || ' records of ' || source || ' could not be used.' END AS warning FROM r JOIN l USING (source) GROUP BY source, reason, n
      UNION ALL SELECT 'other_feed', 'papers', NULL, 'other_feed was unavailable; results may be partial.'"""
ORACLES["scanned_status"] = f"""WITH {scores(False)}, ok AS (SELECT item_id, CASE WHEN item_id % 5 = 4 THEN 'no feed  answered' WHEN item_id % 7 = 3 THEN 'the query is empty' END AS error FROM benchmark),
      ft AS (SELECT *, row_number() OVER (PARTITION BY query_id, feed ORDER BY score DESC, id) AS nth FROM s JOIN papers USING (id) JOIN ok ON query_id = item_id WHERE error IS NULL),
      fe AS (SELECT query_id, ord FROM ft WHERE nth <= 20), us AS (SELECT * FROM papers WHERE ord IN (SELECT ord FROM fe)), {components("us")}, {MERGED},
      wq AS (SELECT DISTINCT query_id, component FROM fe JOIN cp USING (ord)), wp AS (SELECT query_id, {words_of(dedup_title("text"))} AS q, mg.* FROM wq JOIN mg USING (component) JOIN benchmark ON query_id = item_id), {ranked("wp")},
      cn AS (SELECT query_id, count(*) AS n, least(3, count(*) FILTER (score >= 0.35)) AS d FROM fr WHERE rank <= 10 GROUP BY 1)
      SELECT item_id AS watch_topic_id, error, coalesce(n, 0)::BIGINT AS retrieved, coalesce(n, 0)::BIGINT AS persisted, coalesce(n, 0)::BIGINT AS new, coalesce(d, 0)::BIGINT AS delivered,
        CASE WHEN error IS NULL THEN TIMESTAMP '2026-01-01' ELSE TIMESTAMP '2025-01-01' END AS last_scan_at, replace(error, '  ', ' ') AS last_error FROM ok LEFT JOIN cn ON query_id = item_id"""
#: As in one batch, but a paper's id is told by the first batch that has it.
ORACLES["grown_papers"] = ORACLES["upserted_papers"].replace("substr(min(sha256(ck)) FILTER (new = 1), 1, 32)", "substr(first(sha256(ck) ORDER BY rid >= 'd5', sha256(ck)) FILTER (new = 1), 1, 32)")
ORACLES["grown_components"] = f"""WITH i AS ({ORACLES["identity_keys"]}), g AS (SELECT id, coalesce(max(key) FILTER (key LIKE 'title:%'), max(key) FILTER (key LIKE 'doi:%'), id) AS grp FROM i GROUP BY id),
      n AS (SELECT DISTINCT grp, unnest([id, key]) AS node FROM i JOIN g USING (id)) SELECT node, min(node) OVER (PARTITION BY grp) AS component FROM n"""
_ITEM_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= {least})"
_PHRASES = f"w AS (SELECT {_ITEM_WORDS.format(least=1)} AS ws FROM benchmark), e AS (SELECT DISTINCT unnest(list_transform(range(1, len(ws) - 1), lambda k: array_to_string(ws[k:k + 2], ' '))) AS entry FROM w)"
ORACLES["dictionary_hits"] = f"WITH {_PHRASES} SELECT doc_id, entry FROM documents JOIN e ON contains(lower(text), entry)"
ORACLES["phrase_scan"] = f"WITH {_PHRASES} SELECT source, entry AS phrase, count(*) AS texts FROM documents JOIN e ON contains(lower(text), entry) GROUP BY ALL"
ORACLES["matched_entries"] = f"""WITH w AS (SELECT item_id, {_ITEM_WORDS.format(least=5)} AS ws FROM benchmark), p AS (SELECT item_id, generate_subscripts(ws, 1) AS k, unnest(ws) AS entry FROM w),
      e AS (SELECT entry, min((item_id, k)) AS nth FROM p GROUP BY entry), v AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS value FROM documents)
      SELECT value, coalesce(first(entry ORDER BY nth, entry), value) AS entry FROM v LEFT JOIN e ON contains(value, entry) OR contains(entry, value) WHERE value <> '' GROUP BY value"""
