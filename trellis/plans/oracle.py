"""DuckDB twins of the registered queries (the correctness gate).

Written against the driver's views (region, nation, customer, ...). The fixture
derivation, rule table and vocabulary are shared data; every operator is re-stated
in plain SQL: recursive CTE for the closure, ``regexp_extract_all`` for tokens,
``contains`` for mentions, explicit averages for the score propagation.

Limits of the twin (documented, checked against the fixtures): IRI encoding only
handles ``%``, blank and ``#`` (the only unsafe characters in the fixture names);
the HTML text of the fixtures is tag-stripped with a regex, which equals the parser
only because every tag in the generated HTML is a block tag.
"""

from __future__ import annotations

from trellis import vocab as V
from trellis.functions.text import TOKEN_PATTERN_RE2
from trellis.operators.mapping import ENTITY_RULES

NS = V.NS
B = "http://example.org/"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def iri(expr: str) -> str:
    enc = f"replace(replace(replace({expr}, '%', '%25'), ' ', '%20'), '#', '%23')"
    return f"CASE WHEN {expr} IS NULL OR {expr} = '' THEN NULL ELSE {q(NS)} || {enc} END"


def first_sentence(expr: str) -> str:
    return f"nullif(trim(regexp_extract({expr}, '^([^.!?\\n]*)', 1)), '')"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {q(TOKEN_PATTERN_RE2)})"


def _s(x) -> str:
    return f"CAST({x} AS VARCHAR)"


FIELDS = list(V.UNIFIED_FIELDS)


def _ent(label: str, src: str, **cols) -> str:
    sel = ", ".join(f"{cols.get(f, 'NULL')}::VARCHAR AS \"{f}\"" for f in FIELDS)
    return f"SELECT {q(label)} AS label, {sel} FROM {src}"


ENTITIES_SQL = " UNION ALL ".join([
    _ent("spaces", "region", _id=f"'region_' || {_s('r_regionkey')}", name="r_name",
         link=f"{q(B + 'region/')} || {_s('r_regionkey')}", type="'global'"),
    _ent("pages", "nation", _id=f"'nation_' || {_s('n_nationkey')}", title="n_name",
         link=f"{q(B + 'nation/')} || {_s('n_nationkey')}", ancestor=f"'region_' || {_s('n_regionkey')}", type="'page'"),
    _ent("pages", "customer", _id=f"'customer_' || {_s('c_custkey')}", title="c_name",
         link=f"{q(B + 'customer/')} || {_s('c_custkey')}", ancestor=f"'nation_' || {_s('c_nationkey')}",
         content=("'<h1>' || c_name || '</h1><p>Segment ' || c_mktsegment || '</p>' || "
                  "'<table><tr><th>custkey</th><th>name</th><th>nation</th><th>segment</th></tr><tr>' || "
                  f"'<td>' || {_s('c_custkey')} || '</td><td>' || c_name || '</td><td>' || {_s('c_nationkey')} || "
                  "'</td><td>' || c_mktsegment || '</td></tr></table>'"),
         type="'page'"),
    _ent("comments", "orders LEFT JOIN customer ON o_custkey = c_custkey",
         _id=f"'order_' || {_s('o_orderkey')}", title=f"'Order ' || {_s('o_orderkey')}",
         link=f"{q(B + 'order/')} || {_s('o_orderkey')}", ancestor=f"'customer_' || {_s('o_custkey')}",
         author="c_name", content="o_orderpriority", creationTime="strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')",
         type="'comment'"),
    _ent("users", "supplier", _id=f"'supplier_' || {_s('s_suppkey')}", name="s_name",
         email="lower(replace(s_name, '#', '.')) || '@example.org'", link=f"{q(B + 'supplier/')} || {_s('s_suppkey')}"),
    _ent("teams", "(SELECT DISTINCT lang FROM documents)", _id="'team_' || lang", name="lang",
         link=f"{q(B + 'team/')} || lang"),
    _ent("channels", "(SELECT DISTINCT lang, source FROM documents)", _id="'channel_' || lang || '_' || source",
         name="source", ancestor="'team_' || lang", link=f"{q(B + 'channel/')} || lang || '/' || source"),
    _ent("posts", "documents", _id=f"'doc_' || {_s('doc_id')}", title=first_sentence("text"), content="text",
         link=f"{q(B + 'doc/')} || {_s('doc_id')}", ancestor="'channel_' || lang || '_' || source", type="'message'"),
    _ent("posts", "conversations", _id=f"'conv_' || {_s('conv_id')} || '_' || {_s('turn')}",
         title=f"CASE WHEN turn = 0 THEN {first_sentence('text')} END", content="text", author="role",
         link=f"{q(B + 'conv/')} || {_s('conv_id')} || '/' || {_s('turn')}",
         ancestor=f"CASE WHEN turn > 0 THEN 'conv_' || {_s('conv_id')} || '_0' END", type="'message'"),
])


def _triples_for(label: str) -> str:
    r = ENTITY_RULES[label]
    subj = iri(f'"{r.subject}"')
    parts = [f"SELECT {subj} AS s, {q(V.RDF_TYPE)} AS p, {q(NS + r.cls)} AS o, 'iri' AS o_kind, NULL::VARCHAR AS o_lang "
             f"FROM ent WHERE label = {q(label)}"]
    for pred, kind, field in r.objects:
        obj = iri(f'"{field}"') if kind == "iri" else f'"{field}"'
        k = "iri" if kind == "iri" else "literal"
        parts.append(f"SELECT {subj} AS s, {q(pred)} AS p, {obj} AS o, {q(k)} AS o_kind, NULL::VARCHAR AS o_lang "
                     f"FROM ent WHERE label = {q(label)}")
    return " UNION ALL ".join(parts)


KNOWLEDGE_SQL = ("SELECT DISTINCT * FROM (" + " UNION ALL ".join(_triples_for(l) for l in ENTITY_RULES) +
                 ") WHERE s IS NOT NULL AND o IS NOT NULL")

_class_edges = " UNION ALL ".join(f"SELECT {q(NS + a)} AS sub, {q(NS + b)} AS sup" for a, b in V.CLASS_EDGES)
_labels = " UNION ALL ".join(
    f"SELECT {q(NS + c)} AS s, {q(V.RDFS_LABEL)} AS p, {q(t)} AS o, 'literal' AS o_kind, {q(l)} AS o_lang"
    for c, t, l in V.CLASS_LABELS)
ONTOLOGY_SQL = (f"SELECT sub AS s, {q(V.RDFS_SUBCLASS)} AS p, sup AS o, 'iri' AS o_kind, NULL::VARCHAR AS o_lang "
                f"FROM class_edges UNION ALL {_labels}")

CONTENT_SQL = (f"SELECT {q(NS + 'term_')} || {_s('item_id')} AS s, {q(V.TITLE)} AS p, text AS o, "
               "'literal' AS o_kind, NULL::VARCHAR AS o_lang FROM benchmark UNION ALL "
               f"SELECT DISTINCT {q(NS + 'segment_')} || lower(c_mktsegment), {q(V.TITLE)}, c_mktsegment, 'literal', NULL::VARCHAR FROM customer")

ARTIFACTS_SQL = f"""
SELECT t.s AS artifact,
       t.o || ' || ' || coalesce(
           trim(regexp_replace(regexp_replace(c.o, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS text
FROM (SELECT s, o FROM kg WHERE p = {q(V.TITLE)}) t
LEFT JOIN (SELECT s, o FROM kg WHERE p = {q(V.CONTENT)}) c ON t.s = c.s
"""

LINKS_SQL = f"""
SELECT DISTINCT a.artifact, t.s AS term
FROM artifacts a JOIN (SELECT s, o FROM cg WHERE p = {q(V.TITLE)}) t ON contains(lower(a.text), lower(t.o))
"""

REFERENCE_SQL = (f"SELECT artifact AS s, {q(V.REFERENCE)} AS p, term AS o, 'iri' AS o_kind, NULL::VARCHAR AS o_lang "
                 "FROM links")

GRAPH_CTES = f"""
ent AS ({ENTITIES_SQL}),
kg AS ({KNOWLEDGE_SQL}),
class_edges AS ({_class_edges}),
og AS ({ONTOLOGY_SQL}),
cg AS ({CONTENT_SQL}),
artifacts AS ({ARTIFACTS_SQL}),
links AS ({LINKS_SQL}),
rg AS ({REFERENCE_SQL}),
quads AS (SELECT DISTINCT * FROM (
    SELECT 'knowledge' AS g, * FROM kg UNION ALL SELECT 'ontology', * FROM og
    UNION ALL SELECT 'content', * FROM cg UNION ALL SELECT 'reference', * FROM rg)),
ug AS (SELECT DISTINCT s, p, o, o_kind, o_lang FROM quads),
edges AS (SELECT DISTINCT s AS child, o AS parent FROM ug WHERE p = {q(V.ANCESTOR)}),
paths AS (
    SELECT child AS "desc", parent AS anc, 1 AS depth FROM edges
    UNION
    SELECT c."desc", e.parent, c.depth + 1 FROM paths c JOIN edges e ON c.anc = e.child),
closure AS (SELECT "desc", anc, min(depth) AS depth FROM paths GROUP BY "desc", anc),
class_clo AS (
    SELECT sub, sup FROM class_edges
    UNION
    SELECT c.sub, e.sup FROM class_clo c JOIN class_edges e ON c.sup = e.sub),
direct_types AS (SELECT DISTINCT s, o AS cls FROM ug WHERE p = {q(V.RDF_TYPE)}),
types AS (SELECT s, cls FROM direct_types UNION SELECT d.s, c.sup FROM direct_types d JOIN class_clo c ON d.cls = c.sub)
"""

INDEX_CTES = f"""
entries AS (
    SELECT DISTINCT s, CASE p WHEN {q(V.TITLE)} THEN 'title' ELSE 'label' END AS field, o AS value, o_lang AS lang
    FROM ug WHERE p IN ({q(V.TITLE)}, {q(V.RDFS_LABEL)}) AND o_kind = 'literal'),
entry_toks AS (SELECT s, field, value, lang, {tokens('value')} AS toks FROM entries),
dl AS (SELECT s, field, value, lang, len(toks) AS dl FROM entry_toks),
stats AS (SELECT field, count(*) AS n_docs, avg(dl) AS avg_dl FROM dl GROUP BY field),
tf AS (SELECT s, field, value, lang, term, count(*) AS tf
       FROM (SELECT s, field, value, lang, unnest(toks) AS term FROM entry_toks) GROUP BY ALL),
term_df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY field, term),
postings AS (
    SELECT tf.s, tf.field, tf.value, tf.lang, tf.term, tf.tf, dl.dl,
           ln(1 + (st.n_docs - d.df + 0.5) / (d.df + 0.5)) * tf.tf
             / (tf.tf + {V.BM25_K1} * (1 - {V.BM25_B} + {V.BM25_B} * dl.dl / st.avg_dl)) AS w
    FROM tf
    JOIN dl ON tf.s = dl.s AND tf.field = dl.field AND tf.value = dl.value AND tf.lang IS NOT DISTINCT FROM dl.lang
    JOIN term_df d ON d.field = tf.field AND d.term = tf.term
    JOIN stats st ON st.field = tf.field)
"""

FULL_INDEX_CTES = INDEX_CTES.replace(
    f"CASE p WHEN {q(V.TITLE)} THEN 'title' ELSE 'label' END",
    f"CASE p WHEN {q(V.TITLE)} THEN 'title' WHEN {q(V.CONTENT)} THEN 'content' ELSE 'label' END",
).replace(f"p IN ({q(V.TITLE)}, {q(V.RDFS_LABEL)})", f"p IN ({q(V.TITLE)}, {q(V.RDFS_LABEL)}, {q(V.CONTENT)})")


# The same with digests in place of whole values: clauses join postings to postings, and a value would ride with each of its terms.
DIGEST_INDEX_CTES = FULL_INDEX_CTES.replace(
    f"entry_toks AS (SELECT s, field, value, lang, {tokens('value')} AS toks FROM entries)",
    f"entry_toks AS (SELECT s, field, md5(value) AS value, lang, {tokens('value')} AS toks FROM entries)")


def ancestors(part: str) -> str:
    """Titles (t) or links (l) of a group's ancestors, nearest first."""
    pairs = "list_sort(list_distinct(list({'d': ap.depth, 't': ap.a_title, 'l': ap.a_link}) FILTER (ap.s IS NOT NULL)))"
    return f"coalesce(array_to_string(list_transform({pairs}, lambda x: x.{part}), {q(V.ANCESTOR_SEPARATOR)}), '')"


BENCHMARK_SEARCHES = f"""    SELECT 'b' || {_s('item_id')} AS query_id, text FROM benchmark
    UNION ALL
"""
SEARCH_CTES = f"""
searches AS (
{BENCHMARK_SEARCHES}    SELECT 'n' || {_s('n_nationkey')} AS query_id, n_name || ' ' || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey),
qterms AS (SELECT query_id, term, count(*) AS qtf
           FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM searches) GROUP BY ALL),
matched AS (
    SELECT query_id, p.s, p.field, p.value, p.lang, sum(qtf * w) AS score
    FROM qterms JOIN postings p USING (term) GROUP BY ALL),
refs AS (SELECT s, o FROM ug WHERE p = {q(V.REFERENCE)}),
ref_mean AS (
    SELECT m.query_id, r.s, avg(m.score) AS refScore FROM refs r JOIN matched m ON m.s = r.o GROUP BY ALL),
pairs AS (
    SELECT c.query_id, c.s AS cs, c.score AS sc, p.s AS ps, p.score AS sp
    FROM matched c JOIN closure k ON k."desc" = c.s JOIN matched p ON p.query_id = c.query_id AND p.s = k.anc),
parent_mean AS (SELECT query_id, cs AS s, avg(sp) AS parentScore FROM pairs GROUP BY ALL),
child_mean AS (SELECT query_id, ps AS s, avg(sc) AS childScore FROM pairs GROUP BY ALL),
totals AS (
    SELECT o.query_id, o.s, o.score,
           o.score + {V.REF_WEIGHT} * coalesce(r.refScore, 0) + {V.PARENT_WEIGHT} * coalesce(pm.parentScore, 0)
                   + {V.CHILD_WEIGHT} * coalesce(cm.childScore, 0) AS totalScore
    FROM (SELECT DISTINCT query_id, s, score FROM matched) o
    LEFT JOIN ref_mean r ON r.query_id = o.query_id AND r.s = o.s
    LEFT JOIN parent_mean pm ON pm.query_id = o.query_id AND pm.s = o.s
    LEFT JOIN child_mean cm ON cm.query_id = o.query_id AND cm.s = o.s),
pv AS (SELECT DISTINCT s, p, o FROM ug),
props AS (
    SELECT l.s, l.o AS link, t.o AS title, c.o AS content, e.o AS email, ct.o AS creationTime, ut.o AS lastUpdateTime
    FROM (SELECT s, o FROM pv WHERE p = {q(V.LINK)}) l
    LEFT JOIN (SELECT s, o FROM pv WHERE p = {q(V.TITLE)}) t ON t.s = l.s
    LEFT JOIN (SELECT s, o FROM pv WHERE p = {q(V.CONTENT)}) c ON c.s = l.s
    LEFT JOIN (SELECT s, o FROM pv WHERE p = {q(V.EMAIL)}) e ON e.s = l.s
    LEFT JOIN (SELECT s, o FROM pv WHERE p = {q(V.CREATION_TIME)}) ct ON ct.s = l.s
    LEFT JOIN (SELECT s, o FROM pv WHERE p = {q(V.LAST_UPDATE_TIME)}) ut ON ut.s = l.s),
type_names AS (SELECT DISTINCT s, CASE WHEN contains(cls, '#') THEN regexp_extract(cls, '#([^#]*)$', 1) ELSE '' END AS tname FROM types),
anc_pairs AS (
    SELECT k."desc" AS s, k.depth, t.o AS a_title, l.o AS a_link
    FROM closure k
    JOIN (SELECT s, o FROM pv WHERE p = {q(V.TITLE)}) t ON t.s = k.anc
    JOIN (SELECT s, o FROM pv WHERE p = {q(V.LINK)}) l ON l.s = k.anc),
results AS (
    SELECT x.query_id, x.link, x.title, x.content, x.email, x.creationTime, x.lastUpdateTime,
           array_to_string(list_sort(list_distinct(list(tn.tname))), {q(V.TYPES_SEPARATOR)}) AS types,
           {ancestors('t')} AS ancestorTitles,
           {ancestors('l')} AS ancestorLinks,
           x.totalScore
    FROM (SELECT t.query_id, t.s, t.totalScore, p.link, p.title, p.content, p.email, p.creationTime, p.lastUpdateTime
          FROM totals t JOIN props p ON p.s = t.s
          WHERE EXISTS (SELECT 1 FROM type_names n WHERE n.s = t.s)) x
    JOIN type_names tn ON tn.s = x.s
    LEFT JOIN anc_pairs ap ON ap.s = x.s
    GROUP BY x.query_id, x.link, x.title, x.content, x.email, x.creationTime, x.lastUpdateTime, x.totalScore)
"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",".join(c.strip().rstrip(",") for c in ctes) + "\n" + body


WIKI = "https://wiki.example.org/wiki"
_N = "NULL::VARCHAR"


def _row(label, _id=_N, type=_N, name=_N, email=_N, title=_N, link=_N, content=_N, author=_N,
         creationTime=_N, lastUpdateTime=_N, ancestor=_N, src=""):
    cols = [_id, type, name, email, title, link, content, author, creationTime, lastUpdateTime, ancestor]
    sel = ", ".join(f"({c})::VARCHAR AS \"{n}\"" for c, n in zip(cols, FIELDS))
    return f"SELECT {q(label)} AS label, {sel} FROM {src}"


_first_post_titled = (
    "(SELECT turn = 0 AND " + first_sentence("text") + " IS NOT NULL FROM conversations WHERE length(text) > 0 "
    "ORDER BY 'posts:conv' || CAST(conv_id AS VARCHAR), floor(turn / 100), turn LIMIT 1)")

RAW_UNIFIED_SQL = " UNION ALL ".join([
    _row("spaces", _id="'home' || CAST(n_nationkey AS VARCHAR)", name="n_name",
         link=f"{q(WIKI + '/spaces/N')} || CAST(n_nationkey AS VARCHAR)", src="nation"),
    _row("pages", _id="'c' || CAST(c_custkey AS VARCHAR)", type="'page'", title="c_name",
         link=f"{q(WIKI + '/pages/c')} || CAST(c_custkey AS VARCHAR)", content="'<p>' || c_mktsegment || '</p>'",
         author="c_name", ancestor="'home' || CAST(c_nationkey AS VARCHAR)",
         src="customer JOIN nation ON c_nationkey = n_nationkey"),
    _row("comments", _id="'o' || CAST(o_orderkey AS VARCHAR)", type="'comment'",
         title="'Re: Order ' || CAST(o_orderkey AS VARCHAR)",
         link=f"{q(WIKI + '/comments/o')} || CAST(o_orderkey AS VARCHAR)", content="'<p>' || o_orderpriority || '</p>'",
         author="c_name", creationTime="strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')",
         ancestor="'c' || CAST(o_custkey AS VARCHAR)",
         src="orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    _row("users", name="s_name", email="lower(replace(s_name, '#', '.')) || '@example.org'",
         link=f"{q(WIKI + '/~s')} || CAST(s_suppkey AS VARCHAR)", src="supplier WHERE s_acctbal >= 0"),
    _row("teams", _id="'t' || CAST(r_regionkey AS VARCHAR)", name="r_name", content="'Team ' || r_name",
         link="'https://teams.example.org/t' || CAST(r_regionkey AS VARCHAR)", src="region"),
    _row("channels", _id="'ch' || CAST(n_nationkey AS VARCHAR)", name="n_name",
         email="lower(n_name) || '@example.org'", content="'Channel ' || n_name",
         link="'https://teams.example.org/ch' || CAST(n_nationkey AS VARCHAR)",
         ancestor="'t' || CAST(n_regionkey AS VARCHAR)", src="nation JOIN region ON n_regionkey = r_regionkey"),
    _row("posts", _id="'m' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR)", type="'message'",
         title=f"CASE WHEN {_first_post_titled} AND turn = 0 THEN {first_sentence('text')} END",
         link="'https://teams.example.org/m' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR)",
         content="text", author="role", ancestor="'conv' || CAST(conv_id AS VARCHAR)",
         src="conversations WHERE length(text) > 0"),
])

SNAPSHOT_COUNTS_SQL = """
SELECT 'spaces' AS label, count(*) AS n FROM nation
UNION ALL SELECT 'pages', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'comments', count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'users', count(*) FROM supplier WHERE s_acctbal >= 0
UNION ALL SELECT 'teams', count(*) FROM region
UNION ALL SELECT 'channels', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'posts', count(*) FROM conversations WHERE length(text) > 0
"""


def _long_date(expr: str) -> str:
    return f"strftime(strptime({expr}, '%Y-%m-%dT%H:%M:%SZ'), '%-d %B %Y')"


PRESENT_BODY = f"""
SELECT query_id, link,
       CASE WHEN title IS NOT NULL THEN title WHEN contains(types, 'Post') THEN {q(V.UNTITLED_POST)} END AS displayTitle,
       source,
       CASE WHEN length(raw) < {V.SNIPPET_CHARS} THEN raw ELSE substring(raw, 1, {V.SNIPPET_CHARS}) || '...' END AS snippet,
       CASE WHEN lastUpdateTime IS NOT NULL THEN 'Updated ' || {_long_date('lastUpdateTime')}
            WHEN creationTime IS NOT NULL THEN 'Created ' || {_long_date('creationTime')} END AS dateLine,
       CASE WHEN len(string_split(ancestorTitles, '///')) = len(string_split(ancestorLinks, '///'))
            THEN array_to_string(list_reverse(string_split(ancestorTitles, '///')), {q(V.BREADCRUMB_SEPARATOR)}) END
         AS breadcrumbText,
       CASE WHEN len(string_split(ancestorTitles, '///')) = len(string_split(ancestorLinks, '///'))
            THEN array_to_string(list_reverse(string_split(ancestorLinks, '///')), {q(V.BREADCRUMB_SEPARATOR)}) END
         AS breadcrumbLinks,
       round(totalScore, 6) AS totalScore
FROM (
  SELECT *,
         CASE WHEN source = 'Confluence' THEN
              CASE WHEN content LIKE '<h1>%'
                   THEN regexp_extract(content, '<h1>(.*?)</h1>', 1) || {q(V.BLOCK_SEPARATOR)} || regexp_extract(content, '<p>(.*?)</p>', 1)
                   ELSE '' END
              ELSE trim(regexp_replace(coalesce(content, ''), '[ \t\n\r\f]+', ' ', 'g')) END AS raw
  FROM (SELECT *, CASE WHEN contains(types, 'Confluence') THEN 'Confluence' WHEN contains(types, 'Teams') THEN 'Teams'
                       ELSE '' END AS source FROM results))
"""


CLAUSE_CTES = f"""
csearch AS (
    SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS query_id, r_name AS text, ['cust'] AS prefix,
           CASE WHEN NOT contains(r_name, ' ') THEN ['customer'] ELSE []::VARCHAR[] END AS must,
           [lpad(CAST(r_regionkey AS VARCHAR), 9, '0')] AS must_not,
           CASE WHEN contains(r_name, ' ') THEN r_name END AS phrase
    FROM region
    UNION ALL SELECT 'm' || CAST(r_regionkey AS VARCHAR), '', []::VARCHAR[], string_split(r_name, ' '), []::VARCHAR[], NULL FROM region
    UNION ALL SELECT 'p' || CAST(r_regionkey AS VARCHAR), '', []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], r_name FROM region),
cq AS (
    SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM csearch) GROUP BY ALL
    UNION ALL
    SELECT DISTINCT c.query_id, v.term, 1 AS qtf
    FROM (SELECT query_id, lower(unnest(prefix)) AS pfx FROM csearch) c
    JOIN (SELECT DISTINCT term FROM term_df) v ON starts_with(v.term, c.pfx)
    UNION ALL
    SELECT DISTINCT query_id, term, 1 AS qtf
    FROM (SELECT query_id, unnest(list_concat(list_transform(must, lambda x: lower(x)), coalesce({tokens('phrase')}, []::VARCHAR[]))) AS term
          FROM csearch WHERE len({tokens('text')}) = 0 AND len(prefix) = 0)),
cm AS (SELECT query_id, p.s, p.field, p.value, p.lang, sum(qtf * w) AS score FROM cq JOIN postings p USING (term) GROUP BY ALL),
must_terms AS (SELECT DISTINCT query_id, lower(unnest(must)) AS term FROM csearch),
must_need AS (SELECT query_id, count(*) AS need FROM must_terms GROUP BY query_id),
must_ok AS (
    SELECT h.query_id, h.s, h.field, h.value, h.lang FROM (
        SELECT m.query_id, p.s, p.field, p.value, p.lang, count(*) AS have
        FROM must_terms m JOIN (SELECT DISTINCT s, field, value, lang, term FROM postings) p USING (term)
        GROUP BY m.query_id, p.s, p.field, p.value, p.lang) h
    JOIN must_need n ON n.query_id = h.query_id AND h.have = n.need),
banned AS (
    SELECT DISTINCT b.query_id, p.s, p.field, p.value, p.lang
    FROM (SELECT query_id, lower(unnest(must_not)) AS term FROM csearch) b JOIN postings p USING (term)),
clause_matched AS (
    SELECT cm.* FROM cm JOIN csearch c USING (query_id)
    WHERE (len(c.must) = 0 OR EXISTS (SELECT 1 FROM must_ok o WHERE o.query_id = cm.query_id AND o.s = cm.s
                AND o.field = cm.field AND o.value = cm.value AND o.lang IS NOT DISTINCT FROM cm.lang))
      AND NOT EXISTS (SELECT 1 FROM banned b WHERE b.query_id = cm.query_id AND b.s = cm.s AND b.field = cm.field
                AND b.value = cm.value AND b.lang IS NOT DISTINCT FROM cm.lang)
      AND (c.phrase IS NULL OR EXISTS (SELECT 1 FROM entry_toks t WHERE t.s = cm.s AND t.field = cm.field AND t.value = cm.value
                AND t.lang IS NOT DISTINCT FROM cm.lang AND contains(' ' || array_to_string(t.toks, ' ') || ' ',
                                        ' ' || array_to_string({tokens('c.phrase')}, ' ') || ' '))))
"""


LANDED_ITEMS_SQL = """
SELECT 'spaces' AS label, count(*) AS n_items FROM nation
UNION ALL SELECT 'pages', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)
UNION ALL SELECT 'comments', count(*) FROM orders
UNION ALL SELECT 'users', 2 * count(*) FROM supplier
UNION ALL SELECT 'teams', count(*) FROM region
UNION ALL SELECT 'channels', count(*) FROM nation
UNION ALL SELECT 'posts', count(*) FROM conversations
"""


INFERRED_TYPES_SQL = with_ctes(
    f"ent AS ({ENTITIES_SQL})", f"kg AS ({KNOWLEDGE_SQL})", f"class_edges AS ({_class_edges})",
    "class_clo AS (SELECT sub, sup FROM class_edges UNION SELECT c.sub, e.sup FROM class_clo c JOIN class_edges e ON c.sup = e.sub)",
    f"direct_types AS (SELECT DISTINCT s, o AS cls FROM kg WHERE p = {q(V.RDF_TYPE)})",
    "types AS (SELECT s, cls FROM direct_types UNION SELECT d.s, c.sup FROM direct_types d JOIN class_clo c ON d.cls = c.sub)",
    body="SELECT s, regexp_extract(cls, '#([^#]*)$', 1) AS type FROM types")


ONTOLOGY_FIXPOINT_SQL = f"""
WITH RECURSIVE edges AS (
    SELECT 'customer_' || c_custkey AS s, 'nation_' || c_nationkey AS o FROM customer
    UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey FROM supplier
    UNION ALL SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey FROM nation),
parts AS (SELECT s, o FROM edges UNION SELECT p.s, e.o FROM parts p JOIN edges e ON p.o = e.s)
SELECT s, p, o FROM parts, (SELECT unnest(['partOf', 'within', 'relatedTo']) AS p)
UNION ALL SELECT o, 'hasPart', s FROM parts
UNION ALL SELECT DISTINCT s, {q(V.RDF_TYPE)}, 'Part' FROM parts
UNION ALL SELECT 'customer_' || c_custkey, {q(V.RDF_TYPE)}, c FROM customer, (SELECT unnest(['Customer', 'Client']) AS c)
"""
