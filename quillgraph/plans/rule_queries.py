"""Further queries: rules on names and headers, sources, resumed work, saved graphs. Each has its SQL; they register beside the others."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import config as C
from quillgraph.functions import predicates as P
from quillgraph.functions import text as T
from quillgraph.operators import graph as G
from quillgraph.operators import linking as L
from quillgraph.operators import lookup as Q
from quillgraph.operators import retrieval as R
from quillgraph.operators import sections as X
from quillgraph.plans.queries import _NORM, _TFIDF, _bench, _docs, _esc, _halves, _list, query
from quillgraph.plans.star import STAR, STAR_SQL, star_graph, table
from quillgraph.sources import staging
from quillgraph.sources import tables as S


def _pick(values: list[str], n: Column) -> Column:
    """The n-th of the values, round and round."""
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def _pick_sql(values: list[str], n: str) -> str:
    return f"([{_list(values)}])[1 + CAST(({n}) % {len(values)} AS INTEGER)]"


def _rows(name: str, table_: dict[str, object]) -> str:
    return f"{name}(k, v) AS (VALUES " + ", ".join(f"('{_esc(k)}', {v if isinstance(v, int) else repr(v)})" for k, v in table_.items()) + ")"


# --- names ---------------------------------------------------------------------------------------------------

_SHORT, _PLURALS = list(C.ABBREVIATIONS), list(C.SINGULARS)
#: From raw (id, name, ...) to canon (id, canonical).
_CANON = f"""{_rows("abbr", C.ABBREVIATIONS)}, {_rows("sing", C.SINGULARS)},
    spelled AS (SELECT id, trim(regexp_replace(coalesce(v, upper(name)), '[^A-Z0-9]+', ' ', 'g')) AS normal FROM raw LEFT JOIN abbr ON k = upper(name)),
    again AS (SELECT id, coalesce(v, normal) AS whole, regexp_extract(coalesce(v, normal), '(\\S+)$', 1) AS last FROM spelled LEFT JOIN abbr ON k = normal),
    canon AS (SELECT id, substr(whole, 1, length(whole) - length(last)) || coalesce(v, last) AS canonical FROM again LEFT JOIN sing ON k = last)"""


@query(f"""WITH raw AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN lower({_pick_sql(_SHORT, "p_partkey // 5")}) WHEN 1 THEN {_pick_sql(_SHORT, "p_partkey // 5")} || ' ' || {_pick_sql(_PLURALS, "p_partkey")}
    ELSE p_name || '-' || lower({_pick_sql(_PLURALS, "p_partkey")}) END AS name FROM part), {_CANON} SELECT id, name, canonical FROM raw JOIN canon USING (id)""")
def names_canonical(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    short, plural = _pick(_SHORT, F.expr("p_partkey div 5")), _pick(_PLURALS, n)
    name = F.when(n % 5 == 0, F.lower(short)).when(n % 5 == 1, F.concat(short, F.lit(" "), plural)).otherwise(F.concat("p_name", F.lit("-"), F.lower(plural)))
    return table(spark, d, "part").select(n.alias("id"), name.alias("name")).withColumn("canonical", T.canonical_name(F.col("name")))


_KINDS = ["CONDITION", "TREATMENT", "PREVALENCE_STATEMENT", "COURSE_FEATURE"]
_FILLERS = f"list_distinct([w FOR w IN string_split_regex(upper(name), '\\s+') IF w <> '' AND w NOT IN ({_list(C.GRAPH_STOP_WORDS)})])"
_PLACEHOLDER = lambda n: f"({n} IN ({_list(C.GENERIC_NAMES)}) OR starts_with({n}, 'DIAGNOSTIC CRITERION') OR (kind IN ('PREVALENCE_STATEMENT', 'CONDITION') AND NOT regexp_matches({n}, '[A-Z]')))"


@query(f"""WITH raw AS (SELECT p_partkey AS id, {_pick_sql(_KINDS, "p_partkey // 7")} AS kind, 'Told of  ' || p_type AS description, CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN {_pick_sql(C.FRAGMENTS, "p_partkey // 7")}
        WHEN 2 THEN {_pick_sql(C.FRAGMENTS, "p_partkey // 7")} || ' of ' || {_pick_sql(C.FRAGMENTS, "p_partkey // 5")} WHEN 3 THEN {_pick_sql(C.GENERIC_NAMES, "p_partkey // 7")} WHEN 4 THEN {_pick_sql(C.LOW_SIGNAL_NAMES, "p_partkey // 7")}
        WHEN 5 THEN p_partkey % 40 || '.5 %' ELSE 'course features' END AS name FROM part), {_CANON},
    j AS (SELECT *, {_NORM.format("name")} AS nn, {_FILLERS} AS w, trim(substr({_NORM.format("description")}, 1, 140)) AS told FROM raw JOIN canon USING (id))
    SELECT id, name, kind, len(w) = 0 OR length(name) <= 2 OR len([x FOR x IN w IF x NOT IN ({_list(C.FRAGMENTS)})]) = 0 OR (len(w) <= 2 AND len([x FOR x IN w IF x IN ({_list(C.FRAGMENTS)})]) > 0) AS garbage, {_PLACEHOLDER("nn")} AS placeholder,
        nn IN ({_list(C.LOW_SIGNAL_NAMES)}) OR contains(nn, '{C.LOW_SIGNAL_PART}') OR (kind = 'TREATMENT' AND (starts_with(nn, 'SCREENING FOR ') OR ends_with(nn, ' EVALUATION'))) AS low_signal,
        CASE WHEN told <> '' AND ((kind = 'PREVALENCE_STATEMENT' AND {_PLACEHOLDER("canonical")}) OR (kind = 'COURSE_FEATURE' AND canonical IN ('COURSE FEATURE', 'COURSE', 'DEVELOPMENT AND COURSE'))) THEN told ELSE canonical END AS derived FROM j""")
def names_judged(spark: SparkSession, d: str) -> DataFrame:
    n, a = F.col("p_partkey"), F.expr("p_partkey div 7")
    name = (
        F.when(n % 7 == 0, F.col("p_name")).when(n % 7 == 1, _pick(C.FRAGMENTS, a)).when(n % 7 == 2, F.concat(_pick(C.FRAGMENTS, a), F.lit(" of "), _pick(C.FRAGMENTS, F.expr("p_partkey div 5"))))
        .when(n % 7 == 3, _pick(C.GENERIC_NAMES, a)).when(n % 7 == 4, _pick(C.LOW_SIGNAL_NAMES, a)).when(n % 7 == 5, F.concat((n % 40).cast("string"), F.lit(".5 %"))).otherwise("course features")
    )
    told = table(spark, d, "part").select(n.alias("id"), name.alias("name"), _pick(_KINDS, a).alias("kind"), F.concat(F.lit("Told of  "), "p_type").alias("description"))
    name, kind = F.col("name"), F.col("kind")
    return told.select("id", "name", "kind", T.is_garbage(name).alias("garbage"), T.is_placeholder(name, kind).alias("placeholder"), T.is_low_signal(name, kind).alias("low_signal"), T.derived_name(name, kind, F.col("description")).alias("derived"))


_WORDS = list(C.STRENGTH_WORDS)


@query(f"""WITH {_rows("words", C.STRENGTH_WORDS)}, raw AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN p_partkey % 23 || '' WHEN 1 THEN p_partkey // 8 % 12 || '.5' WHEN 2 THEN ' ' || upper({_pick_sql(_WORDS, "p_partkey // 8")}) WHEN 3 THEN 'about ' || p_partkey % 15 || ' of 10'
        WHEN 4 THEN 'true' WHEN 5 THEN '' WHEN 6 THEN '-' || p_partkey % 4 ELSE 'unheard of' END AS value FROM part), v AS (SELECT id, value, lower(trim(value)) AS t FROM raw)
    SELECT id, value, CAST(CASE WHEN t IN ('', 'true', 'false') THEN 5 WHEN regexp_matches(t, '^-?\\d+(\\.\\d+)?$') THEN greatest(1, least(10, round_even(TRY_CAST(t AS DOUBLE), 0))) WHEN words.v IS NOT NULL THEN words.v
        WHEN regexp_matches(t, '\\d') THEN greatest(1, least(10, CAST(regexp_extract(t, '(\\d+)', 1) AS INTEGER))) ELSE 5 END AS INTEGER) AS strength FROM v LEFT JOIN words ON k = t""")
def strengths(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    text = lambda c: c.cast("string")
    value = (
        F.when(n % 8 == 0, text(n % 23)).when(n % 8 == 1, F.concat(text(F.expr("p_partkey div 8 % 12")), F.lit(".5"))).when(n % 8 == 2, F.concat(F.lit(" "), F.upper(_pick(_WORDS, F.expr("p_partkey div 8")))))
        .when(n % 8 == 3, F.concat(F.lit("about "), text(n % 15), F.lit(" of 10"))).when(n % 8 == 4, "true").when(n % 8 == 5, "").when(n % 8 == 6, F.concat(F.lit("-"), text(n % 4))).otherwise("unheard of")
    )
    return table(spark, d, "part").select(n.alias("id"), value.alias("value")).withColumn("strength", T.strength_of(F.col("value")))


@query("SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'PART ' || p_partkey WHEN 1 THEN 'part/' || p_partkey ELSE 'nothing ' || p_partkey END AS asked, CASE WHEN p_partkey % 3 < 2 THEN 'PART ' || p_partkey END AS name FROM part")
def names_resolved(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    asked = F.concat(F.when(n % 3 == 0, "PART ").when(n % 3 == 1, "part/").otherwise("nothing "), n.cast("string"))
    return L.resolve_names(table(spark, d, "part").select(asked.alias("asked")), star_graph(spark, d)[0])


_PHRASES = list(C.PHRASE_ALIASES)
_KNOWN = sorted({v for vs in C.PHRASE_ALIASES.values() for v in vs if len(v) % 2})


@query(f"""WITH alias(k, pref, name) AS (VALUES {", ".join(f"('{k}', {i}, '{v}')" for k, vs in C.PHRASE_ALIASES.items() for i, v in enumerate(vs))}), known AS (SELECT k, arg_min(name, pref) AS name FROM alias WHERE name IN ({_list(_KNOWN)}) GROUP BY k),
    q AS (SELECT p_partkey AS qid, 'I ' || lower({_pick_sql(_PHRASES, "p_partkey")}) || ', since ' || p_name AS question FROM part)
    SELECT DISTINCT qid, name, 'SYMPTOM' AS label FROM q JOIN known ON contains(' ' || {_NORM.format("question")} || ' ', ' ' || k || ' ')""")
def symptom_aliases(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.concat(F.lit("I "), F.lower(_pick(_PHRASES, F.col("p_partkey"))), F.lit(", since "), "p_name").alias("question"))
    return L.link_aliases(asked, spark.createDataFrame([(k, "SYMPTOM") for k in _KNOWN], "name string, label string"))


# --- headers, chunks and lines -------------------------------------------------------------------------------


def _stripped(x: str) -> str:
    for pattern, by in ((r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"<[^>]+>", " "), (r"[*_`~]+", ""), ("[™®]", " "), ("[‐-―]", "-"), (r"\s+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"trim({x})"


@query(f"""WITH raw AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '**' || upper({_pick_sql(C.DISCARD_PHRASES, "doc_id // 5")}) || '** of ' || source WHEN 1 THEN '__' || {_pick_sql(C.TITLE_HEADERS, "doc_id // 5")} || '__' WHEN 2 THEN 'Page ' || doc_id WHEN 3 THEN '*** <br>'
        ELSE '[' || source || '](http://x) <b>' || lang || '</b>™ – ~more~' END AS header FROM documents), s AS (SELECT doc_id, header, {_stripped("header")} AS plain FROM raw),
    h AS (SELECT *, trim(regexp_replace(lower(plain), '[^a-z0-9]+', ' ', 'g')) AS normal FROM s), p AS (SELECT *, list_sort([x FOR x IN [{_list(C.DISCARD_PHRASES)}] IF contains(normal, x)]) AS held FROM h)
    SELECT doc_id, header, plain, normal, CASE WHEN normal = '' THEN 'empty_header' WHEN normal IN ('preamble', 'document') THEN 'non_section_content' WHEN regexp_matches(normal, '^(?:page\\s+)?(?:\\d+|[ivxlcdm]+|[a-z]?\\d+)$') THEN 'page_marker_header'
        WHEN normal IN ({_list(C.TITLE_HEADERS)}) THEN 'title_header' WHEN len(held) > 0 THEN 'discard_header:' || held[1] END AS reason FROM p""")
def headers_judged(spark: SparkSession, d: str) -> DataFrame:
    n, a = F.col("doc_id"), F.expr("doc_id div 5")
    header = (
        F.when(n % 5 == 0, F.concat(F.lit("**"), F.upper(_pick(C.DISCARD_PHRASES, a)), F.lit("** of "), "source")).when(n % 5 == 1, F.concat(F.lit("__"), _pick(C.TITLE_HEADERS, a), F.lit("__")))
        .when(n % 5 == 2, F.concat(F.lit("Page "), n.cast("string"))).when(n % 5 == 3, "*** <br>").otherwise(F.concat(F.lit("["), "source", F.lit("](http://x) <b>"), "lang", F.lit("</b>™ – ~more~")))
    )
    h = F.col("header")
    return table(spark, d, "documents").select("doc_id", header.alias("header")).select("doc_id", "header", T.strip_markdown(h).alias("plain"), T.normalize_header(h).alias("normal"), P.discard_reason(h).alias("reason"))


def _label_sql(x: str) -> str:
    edge = lambda c: f"regexp_replace({c}, '^[ \\-:/]+|[ \\-:/]+$', '', 'g')"
    fold = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    flat = fold("regexp_replace(replace(replace(raw, chr(13), ' '), chr(10), ' / '), '[*`_]+', '', 'g')")
    parts = f"[p FOR p IN [{edge('y')} FOR y IN string_split_regex(flat, '[\\\\/]+')] IF p <> '']"
    named = edge(fold(f"CASE WHEN len({parts}) > 0 THEN array_to_string({parts}, ' > ') ELSE flat END"))
    general = "raw = '' OR contains(lower(raw), 'intentionally omitted') OR contains(lower(raw), '==> picture')"
    return f"([([CASE WHEN {general} OR {named} = '' THEN '{C.GENERAL_SECTION}' ELSE {named} END FOR flat IN [{flat}]])[1] FOR raw IN [trim(coalesce({x}, ''))]])[1]"


@query(f"""WITH raw AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN '[CONTEXT: from before]' || chr(10) || chr(10) ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '## **' || source || '** / ' || lang || chr(10) END || coalesce(text, '') AS text,
        'Book of ' || source AS source_label, CASE WHEN doc_id % 4 = 0 THEN '/' ELSE '/' || source || '/_' || lang || '_' END AS header_path FROM documents),
    f AS (SELECT *, coalesce([trim(x) FOR x IN string_split_regex(text, '\\r?\\n') IF trim(x) <> '' AND NOT starts_with(trim(x), '[CONTEXT:')][1], '') AS line,
        CASE WHEN regexp_matches(text, '(?s)^\\[CONTEXT:[^\\n]*\\n.*\\S') THEN regexp_replace(text, '^\\[CONTEXT:[^\\n]*\\n\\s*', '') ELSE text END AS original FROM raw),
    t AS (SELECT *, CASE WHEN header_path = '/' THEN substr({_label_sql("regexp_replace(line, '^#+\\s*', '')")}, 1, 120) ELSE {_label_sql("header_path")} END AS section_title FROM f),
    c AS (SELECT *, 'This passage is from ' || source_label || CASE WHEN section_title <> '' AND section_title <> '{C.GENERAL_SECTION}' THEN ' and focuses on ' || section_title || ' in a mental health reference.' ELSE ' and provides mental health reference context.' END AS context_tag, {_label_sql("section_title")} AS cited FROM t)
    SELECT chunk_id, section_title, context_tag, CASE WHEN cited = '{C.GENERAL_SECTION}' THEN source_label ELSE source_label || ' — ' || cited END AS citation, md5('[CONTEXT: ' || context_tag || ']' || chr(10) || chr(10) || original) AS text_md5 FROM c""")
def chunks_enriched(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    before = F.when(n % 3 == 0, "[CONTEXT: from before]\n\n").otherwise("")
    head = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("## **"), "source", F.lit("** / "), "lang", F.lit("\n")))
    path = F.when(n % 4 == 0, "/").otherwise(F.concat(F.lit("/"), "source", F.lit("/_"), "lang", F.lit("_")))
    chunks = table(spark, d, "documents").select(n.alias("chunk_id"), F.concat(before, head, F.coalesce("text", F.lit(""))).alias("text"), F.concat(F.lit("Book of "), "source").alias("source_label"), path.alias("header_path"))
    return X.enrich(chunks).select("chunk_id", "section_title", "context_tag", "citation", F.md5("text").alias("text_md5"))


@query(f"""WITH {STAR_SQL}, t AS (SELECT subject, CASE relation WHEN 'IN_REGION' THEN 'HAS_PREVALENCE' WHEN 'SUPPLIES' THEN 'HAS_RISK_FACTOR' ELSE relation END AS relation, target, CASE WHEN ord % 2 = 0 THEN ' told of ' || target ELSE '' END AS told, CASE WHEN ord % 3 = 0 THEN 0 ELSE strength END AS strength FROM rels)
    SELECT subject, relation, target, '- ' || CASE WHEN relation = 'HAS_PREVALENCE' AND told <> '' THEN trim(told) WHEN relation = 'HAS_RISK_FACTOR' AND told <> '' THEN target || ': ' || trim(told) ELSE target END || CASE WHEN strength <> 0 THEN ' (strength ' || strength || ')' ELSE '' END AS line FROM t""")
def relation_lines(spark: SparkSession, d: str) -> DataFrame:
    relation = F.when(F.col("relation") == "IN_REGION", "HAS_PREVALENCE").when(F.col("relation") == "SUPPLIES", "HAS_RISK_FACTOR").otherwise(F.col("relation"))
    told = F.when(F.col("ord") % 2 == 0, F.concat(F.lit(" told of "), "target")).otherwise("")
    strength = F.when(F.col("ord") % 3 == 0, 0).otherwise(F.col("strength"))
    return star_graph(spark, d)[1].select("subject", relation.alias("relation"), "target", T.relation_line(relation, F.col("target"), told, strength).alias("line"))


@query(f"""WITH {STAR_SQL}, r AS (SELECT subject AS qid, CASE ord % 3 WHEN 0 THEN 'HAS_SYMPTOM' WHEN 1 THEN 'HAS_PREVALENCE' ELSE 'DIFFERENTIAL_DIAGNOSIS' END AS relation, CASE WHEN ord % 5 = 0 THEN {_pick_sql(C.LOW_SIGNAL_SYMPTOMS, "ord // 5")} ELSE target END AS neighbor,
        CASE WHEN ord % 4 = 0 THEN 'PREVALENCE_STATEMENT' ELSE 'CONDITION' END AS label, CASE WHEN ord % 7 < 3 THEN 'They often Co-Occur' ELSE 'told' END AS description FROM rels),
    w AS (SELECT *, CASE relation WHEN 'HAS_PREVALENCE' THEN label = 'PREVALENCE_STATEMENT' WHEN 'DIFFERENTIAL_DIAGNOSIS' THEN NOT contains(lower(description), 'co-occur') ELSE true END AS wanted FROM r WHERE NOT (relation = 'HAS_SYMPTOM' AND neighbor IN ({_list(C.LOW_SIGNAL_SYMPTOMS)})))
    SELECT qid, relation, neighbor, label, description FROM w QUALIFY wanted OR NOT bool_or(wanted) OVER (PARTITION BY qid, relation)""")
def display_filter(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("ord")
    rows = star_graph(spark, d)[1].select(
        F.col("subject").alias("qid"), F.when(o % 3 == 0, "HAS_SYMPTOM").when(o % 3 == 1, "HAS_PREVALENCE").otherwise("DIFFERENTIAL_DIAGNOSIS").alias("relation"),
        F.when(o % 5 == 0, _pick(C.LOW_SIGNAL_SYMPTOMS, F.expr("ord div 5"))).otherwise(F.col("target")).alias("neighbor"), F.when(o % 4 == 0, "PREVALENCE_STATEMENT").otherwise("CONDITION").alias("label"),
        F.when(o % 7 < 3, "They often Co-Occur").otherwise("told").alias("description"),
    )
    return Q.display_filter(rows)


@query(rf"""WITH {_TFIDF}, c AS (SELECT qid, rank, d.source || '/' || d.doc_id AS citation, trim(regexp_replace(d.text, '\s+', ' ', 'g')) AS t FROM hits JOIN documents d ON d.doc_id = chunk_id)
    SELECT qid, string_agg('[' || citation || ']' || chr(10) || CASE WHEN length(t) <= 700 THEN t ELSE rtrim(substr(t, 1, 697)) || '...' END, chr(10) || chr(10) ORDER BY rank) AS contexts FROM c GROUP BY qid""")
def search_contexts(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return R.contexts(R.lexical_search(_bench(spark, d), docs), docs).select("qid", F.array_join("contexts", "\n\n").alias("contexts"))


# --- sources and saved work ----------------------------------------------------------------------------------

_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_REGISTRY = f"""src AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '--' ELSE 'Doc ' || doc_id END AS id, upper(source) AS authority, lang AS condition, 'A Title: ' || doc_id AS source_title, text FROM documents),
    named AS (SELECT *, concat_ws('__', nullif({_SLUG.format("authority")}, ''), nullif({_SLUG.format("condition")}, ''), coalesce(nullif({_SLUG.format("id")}, ''), {_SLUG.format("source_title")})) || '.md' AS output FROM src)"""


@query(f"""WITH {_REGISTRY}, told AS (SELECT output, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE length(text) END AS n, CASE WHEN doc_id % 11 = 0 THEN 'broken' END AS error, doc_id % 3 = 0 AS there FROM named)
    SELECT doc_id AS ord, output, n AS markdown_char_count, CASE WHEN there THEN 'skipped_existing' WHEN error IS NOT NULL THEN 'failed' WHEN n > 0 THEN 'converted' WHEN n = 0 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN n = 0 AND error IS NULL THEN 'empty' ELSE error END AS error
    FROM named JOIN told USING (output) WHERE condition IN ('en', 'fr')""")
def registry_manifest(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    sources = table(spark, d, "documents").select(
        n.alias("ord"), F.when(n % 5 == 0, "--").otherwise(F.concat(F.lit("Doc "), n.cast("string"))).alias("id"), F.upper("source").alias("authority"), F.col("lang").alias("condition"), F.concat(F.lit("A Title: "), n.cast("string")).alias("source_title"), "text"
    )
    named = sources.withColumn("output", S.output_name())
    wanted = S.with_status(S.filter_sources(sources.drop("text"), conditions=["EN", "Fr"]), named.where("ord % 3 = 0"))
    converted = named.select("output", F.when(F.col("ord") % 7 == 0, "").otherwise(F.col("text")).alias("markdown"), F.when(F.col("ord") % 11 == 0, "broken").alias("error"))
    return S.manifest_entries(wanted, converted).select("ord", "output", F.col("markdown_char_count").cast("bigint").alias("markdown_char_count"), "status", "error")


@query(r"""WITH p AS (SELECT DISTINCT unnest([regexp_replace(url, '^[a-z]+://', '') || '.pdf', replace(regexp_replace(url, '^[a-z]+://', ''), '/', '__') || '.PDF']) AS path FROM pages WHERE url IS NOT NULL),
    s AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(path, '(?i)\.pdf$', ''), '[/\\]+', '__', 'g'), '[^A-Za-z0-9._\-]+', '_', 'g') AS stem FROM p)
    SELECT path, stem || CASE WHEN row_number() OVER (PARTITION BY stem ORDER BY path) > 1 THEN '--' || substr(sha1(path), 1, 8) ELSE '' END || '.md' AS output FROM s""")
def output_paths(spark: SparkSession, d: str) -> DataFrame:
    """A page without an url is no file."""
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    both = F.array(F.concat(bare, F.lit(".pdf")), F.concat(F.replace(bare, F.lit("/"), F.lit("__")), F.lit(".PDF")))
    return S.output_paths(table(spark, d, "pages").select(F.explode(both).alias("path")).where("path is not null"))


@query(r"""WITH m AS (SELECT doc_id // 4 AS doc, doc_id % 4 AS page, regexp_replace(text, '^\s+|\s+$', '', 'g') AS m FROM documents) SELECT doc, md5(string_agg(m, chr(10) || chr(10) ORDER BY page) || chr(10)) AS markdown_md5, CAST(count(*) AS BIGINT) AS pages FROM m WHERE m <> '' GROUP BY doc""")
def pages_joined(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select(F.expr("doc_id div 4").alias("doc"), (F.col("doc_id") % 4).alias("page"), F.col("text").alias("markdown"))
    n = pages.where(F.col("markdown").rlike(r"\S")).groupBy("doc").agg(F.count("*").alias("pages"))
    return S.join_pages(pages).join(n, "doc").select("doc", F.md5("markdown").alias("markdown_md5"), "pages")


@query("""WITH c AS (SELECT doc_id AS chunk_id, '/data/' || source || '/' || doc_id % 40 || '.md' AS file_path, doc_id % 60 || '.md' AS file_name FROM documents),
    m AS (SELECT CASE WHEN doc_id % 2 = 0 THEN '/DATA/' || source || '/' || doc_id % 40 || '.md' ELSE 'far/' || doc_id % 50 || '.MD' END AS output_markdown, 'Told ' || doc_id AS title, doc_id AS ord FROM documents),
    k AS (SELECT DISTINCT unnest([lower(output_markdown), regexp_extract(lower(output_markdown), '([^/]*)$', 1)]) AS key, output_markdown, title, ord FROM m),
    f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1),
    w AS (SELECT chunk_id, unnest([lower(file_path), lower(file_name), regexp_extract(lower(file_path), '([^/]*)$', 1)]) AS key, unnest([0, 1, 2]) AS pref FROM c),
    b AS (SELECT * FROM w JOIN f USING (key) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY pref) = 1)
    SELECT chunk_id, b.output_markdown AS source_output_markdown, b.title AS source_title, b.ord AS source_ord FROM c LEFT JOIN b USING (chunk_id)""")
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs, n, text = table(spark, d, "documents"), F.col("doc_id"), lambda c: c.cast("string")
    chunks = docs.select(n.alias("chunk_id"), F.concat(F.lit("/data/"), "source", F.lit("/"), text(n % 40), F.lit(".md")).alias("file_path"), F.concat(text(n % 60), F.lit(".md")).alias("file_name"))
    out = F.when(n % 2 == 0, F.concat(F.lit("/DATA/"), "source", F.lit("/"), text(n % 40), F.lit(".md"))).otherwise(F.concat(F.lit("far/"), text(n % 50), F.lit(".MD")))
    manifest = docs.select(out.alias("output_markdown"), F.concat(F.lit("Told "), text(n)).alias("title"), n.alias("ord"))
    return S.attach_metadata(chunks, manifest).select("chunk_id", "source_output_markdown", "source_title", "source_ord")


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def chunks_to_do(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("quality").cast("string").alias("model"), F.col("toxic").cast("string").alias("version"))
    return S.unprocessed(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id")), done, model="1", version="0")


@query(f"WITH {STAR_SQL} SELECT subject, relation, target, CASE WHEN ord % 5 = 0 THEN 5 ELSE strength END AS strength, CASE WHEN ord % 5 = 0 THEN '' ELSE 'told' END AS description, sources FROM rels")
def graph_reloaded(spark: SparkSession, d: str) -> DataFrame:
    """The graph as it comes back from its files, with gaps that loading fills."""
    e, r = star_graph(spark, d)
    gaps = r.withColumn("strength", F.when(F.col("ord") % 5 != 0, F.col("strength"))).withColumn("description", F.when(F.col("ord") % 5 != 0, "told"))
    path = staging.folder(spark, f"graph-{uuid.uuid4().hex}")
    S.save_graph({"entities": e, "relations": gaps, "chunk_payloads": spark.createDataFrame([], "chunk_id string, citation string, text string")}, path)
    return S.load_graph(spark, path)["relations"].select("subject", "relation", "target", "strength", "description", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {STAR_SQL} SELECT subject, relation, target FROM rels WHERE NOT (relation = 'SUPPLIES' AND subject IN (SELECT 'SUPPLIER ' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0))")
def families_removed(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("SUPPLIER "), "s_suppkey").alias("subject"), F.lit("SUPPLIES").alias("relation"))
    return G.remove_families(star_graph(spark, d)[1], gone).select("subject", "relation", "target")


@query(f"""WITH {STAR_SQL} SELECT subject, relation, target, CASE WHEN rels.ord % 3 <> 2 THEN strength ELSE greatest(strength - 1, 1) END AS strength FROM rels JOIN ents ON name = target
    WHERE NOT (relation = 'HAS_BRAND' AND rels.ord % 3 = 2 AND ents.ord % 3 = 2)""")
def upsert_relations(spark: SparkSession, d: str) -> DataFrame:
    """The second part into the first: what calls a brand a type is legal only where the first part knows better."""
    return G.upsert(*_halves(spark, d), STAR)[1].select("subject", "relation", "target", "strength")
