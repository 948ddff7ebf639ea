"""Every operator of the library as a query over the driver tables, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import config as C
from quillgraph.functions import predicates as P
from quillgraph.functions import text as T
from quillgraph.operators import communities as CM
from quillgraph.operators import graph as G
from quillgraph.operators import linking as L
from quillgraph.operators import lookup as Q
from quillgraph.operators import retrieval as R
from quillgraph.plans.router import answer_parts, answer_questions
from quillgraph.plans.star import STAR, STAR_SQL, star_graph, table
from quillgraph.sources import tables as S
from quillgraph.sources.staging import LONG_ROWS, spread, stage
from quillgraph.streaming.sessions import session_context

#: Payloads, of some 70 KB each, that a task makes and parses.
CHUNKS = 1_000
#: Documents of a task that judges them, whatever the row groups of their files.
TEXTS = 1_250

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _esc(text: str) -> str:
    return text.replace("'", "''")


def _list(values) -> str:
    return ", ".join(f"'{_esc(v)}'" for v in values)


# --- the graph -----------------------------------------------------------------------------------------------


@query(f"WITH {STAR_SQL} SELECT name, label, description, ord FROM ents")
def graph_entities(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d)[0].select("name", "label", "description", "ord")


@query(f"WITH {STAR_SQL} SELECT subject, relation, target, strength, ord, sources FROM rels")
def graph_relations(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d)[1].select("subject", "relation", "target", "strength", "ord", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {STAR_SQL} SELECT 'entity' AS kind, label AS key, count(*) AS n FROM ents GROUP BY label UNION ALL SELECT 'relation', relation, count(*) FROM rels GROUP BY relation")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.graph_stats(*star_graph(spark, d))


@query(f"""WITH {STAR_SQL}, both_ AS (SELECT subject AS name, 'outgoing' AS direction, relation, target AS neighbor, strength FROM rels UNION ALL SELECT target, 'incoming', relation, subject, strength FROM rels)
    SELECT name, direction, relation, neighbor, strength FROM both_""")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return G.adjacency(*star_graph(spark, d)).select("name", "direction", "relation", "neighbor", "strength")


def _with_aliases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph with every part also under a variant of its name, and the variant's own brand relation, stronger by two."""
    e, r = star_graph(spark, d)
    variant = F.regexp_replace("name", "PART ", "PART-")
    e2 = e.where("label = 'PART'").withColumn("name", variant).withColumn("description", F.concat("description", F.lit(" more"))).withColumn("ord", F.col("ord") + 5_000_000)
    r2 = r.where("relation = 'HAS_BRAND'").withColumn("subject", F.regexp_replace("subject", "PART ", "PART-")).withColumn("strength", F.col("strength") + 2).withColumn("ord", F.col("ord") + 5_000_000)
    return e.unionByName(e2), r.unionByName(r2)


@query(f"WITH {STAR_SQL} SELECT name, label, CASE WHEN label = 'PART' THEN description || ' more' ELSE description END AS description FROM ents")
def alias_merge_entities(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_aliases(*_with_aliases(spark, d))[0].select("name", "label", "description")


@query(f"WITH {STAR_SQL} SELECT subject, relation, target, CASE WHEN relation = 'HAS_BRAND' THEN 7 ELSE strength END AS strength FROM rels")
def alias_merge_relations(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_aliases(*_with_aliases(spark, d))[1].select("subject", "relation", "target", "strength")


def _noisy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph with an illegal relation for each nation and an isolated entity for each region."""
    e, r = star_graph(spark, d)
    lone = e.where("label = 'REGION'").withColumn("name", F.concat(F.lit("LONELY "), "name"))
    bad = r.where("relation = 'IN_REGION'").withColumn("relation", F.lit("SUPPLIES"))
    return e.unionByName(lone), r.unionByName(bad)


@query(f"WITH {STAR_SQL}, used AS (SELECT subject AS name FROM rels UNION SELECT target FROM rels) SELECT name, label FROM ents WHERE name IN (SELECT name FROM used)")
def graph_clean_entities(spark: SparkSession, d: str) -> DataFrame:
    return G.clean_graph(*_noisy(spark, d), STAR)[0].select("name", "label")


@query(f"WITH {STAR_SQL} SELECT subject, relation, target, strength, sources FROM rels")
def graph_clean_relations(spark: SparkSession, d: str) -> DataFrame:
    return G.clean_graph(*_noisy(spark, d), STAR)[1].select("subject", "relation", "target", "strength", F.array_join("sources", ",").alias("sources"))


def _halves(spark: SparkSession, d: str):
    """Two overlapping parts of the graph; the second is weaker, and calls brands types."""
    e, r = star_graph(spark, d)
    first = (e.where("ord % 3 <> 2"), r.where("ord % 3 <> 2"))
    second = (e.where("ord % 3 <> 0").withColumn("label", F.when(F.col("label") == "BRAND", "PTYPE").otherwise(F.col("label"))), r.where("ord % 3 <> 0").withColumn("strength", F.greatest(F.col("strength") - 1, F.lit(1)).cast("int")))
    return first, second


_MERGED = """one AS (SELECT * FROM ents WHERE ord % 3 <> 2), two AS (SELECT name, CASE WHEN label = 'BRAND' THEN 'PTYPE' ELSE label END AS label FROM ents WHERE ord % 3 <> 0)"""


@query(f"WITH {STAR_SQL}, {_MERGED} SELECT coalesce(one.name, two.name) AS name, coalesce(one.label, two.label) AS label FROM one FULL JOIN two ON one.name = two.name")
def graph_merge_entities(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_graphs(*_halves(spark, d), STAR, clean=False)[0].select("name", "label")


@query(f"WITH {STAR_SQL} SELECT subject, relation, target, CASE WHEN ord % 3 <> 2 THEN strength ELSE greatest(strength - 1, 1) END AS strength FROM rels")
def graph_merge_relations(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_graphs(*_halves(spark, d), STAR, clean=False)[1].select("subject", "relation", "target", "strength")


@query(f"WITH {STAR_SQL}, {_MERGED} SELECT one.name, one.label AS kept_label, two.label AS other_label FROM one JOIN two ON one.name = two.name WHERE one.label <> two.label")
def graph_merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_graphs(*_halves(spark, d), STAR, clean=False)[2]


@query(f"""WITH {STAR_SQL}, c AS (SELECT 'subjects_exist' AS "check", count(*) = 0 AS passed FROM rels WHERE subject NOT IN (SELECT name FROM ents) UNION ALL SELECT 'targets_exist', count(*) = 0 FROM rels WHERE target NOT IN (SELECT name FROM ents)
    UNION ALL SELECT 'names_unique', count(*) = count(DISTINCT name) FROM ents UNION ALL SELECT 'triples_unique', count(*) = count(DISTINCT (subject, relation, target)) FROM rels
    UNION ALL SELECT 'strength_in_range', count(*) = 0 FROM rels WHERE strength NOT BETWEEN 1 AND 10 UNION ALL SELECT 'names_filled', count(*) = 0 FROM ents WHERE trim(name) = ''
    UNION ALL SELECT 'relation_names_valid', count(*) = 0 FROM rels WHERE NOT regexp_matches(relation, '^[A-Z][A-Z0-9_]*$') UNION ALL SELECT 'relations_sourced', count(*) = 0 FROM rels WHERE sources = '') SELECT * FROM c""")
def structural_checks(spark: SparkSession, d: str) -> DataFrame:
    e, r = star_graph(spark, d)
    return G.structural_checks(e, stage(r, "supplies"))  # lines are summed up once for all checks


def _payload_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's lines as an extraction payload: one chunk a supplier."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    # few bytes, but much work for each of them
    rows = spread(stage(rows, "supplied", LONG_ROWS), CHUNKS)
    me = F.concat(F.lit("SUPPLIER "), "l_suppkey")
    ent = lambda i, n, k: F.struct(i.alias("id"), n.alias("name"), F.lit(k).alias("type"), F.lit("").alias("description"))
    parts = F.transform("parts", lambda p: ent(F.concat(F.lit("p"), p.cast("string")), F.concat(F.lit("part/"), p.cast("string")), "PART"))
    links = F.transform("parts", lambda p: F.struct(F.lit("s").alias("source"), F.concat(F.lit("p"), p.cast("string")).alias("target"), F.lit("supplies").alias("relation"), F.lit("told").alias("description"), F.lit("high").alias("strength")))
    payload = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat(F.array(ent(F.lit("s"), me, "SUPPLIER")), parts).alias("entities"), links.alias("relations"))), F.lit("\n```"))
    chunks = rows.select(F.col("l_suppkey").alias("chunk_seq"), F.concat(F.lit("c"), "l_suppkey").alias("chunk_id"), payload.alias("payload"))
    return stage(chunks, "payloads", LONG_ROWS)


@query("""SELECT 'SUPPLIER ' || l_suppkey AS name, 'SUPPLIER' AS label, 1 AS n_sources FROM lineitem GROUP BY l_suppkey
    UNION ALL SELECT 'PART ' || l_partkey, 'PART', CAST(count(DISTINCT l_suppkey) AS INTEGER) FROM lineitem GROUP BY l_partkey""")
def fold_entities(spark: SparkSession, d: str) -> DataFrame:
    raw, _ = G.explode_payloads(_payload_chunks(spark, d))
    return G.fold_entities(stage(G.named_entities(raw)), STAR).select("name", "label", F.size("sources").alias("n_sources"))


@query("SELECT DISTINCT 'SUPPLIER ' || l_suppkey AS subject, 'SUPPLIES' AS relation, 'PART ' || l_partkey AS target, 8 AS strength, 'told' AS description FROM lineitem")
def fold_relations(spark: SparkSession, d: str) -> DataFrame:
    entities, relations = G.explode_payloads(_payload_chunks(spark, d))
    # names are worked out once, as every filter and join on them would do it again
    return G.fold_relations(stage(G.named_entities(entities)), relations, STAR).select("subject", "relation", "target", "strength", "description")


# --- lookups -------------------------------------------------------------------------------------------------


def _asks(spark: SparkSession, d: str) -> DataFrame:
    """One question for each nation, and each asks about the suppliers there."""
    return table(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("qid"), F.concat(F.lit("SUPPLIER "), "s_suppkey").alias("name"))


_ASKS = "asks AS (SELECT CAST(s_nationkey AS BIGINT) AS qid, 'SUPPLIER ' || s_suppkey AS name FROM supplier)"


@query(f"""WITH {STAR_SQL}, {_ASKS} SELECT qid, asks.name, relation, target AS neighbor, label, strength,
    CAST(row_number() OVER (PARTITION BY qid, asks.name, relation ORDER BY strength DESC, target) AS INTEGER) AS rank FROM asks JOIN rels ON asks.name = subject JOIN ents ON ents.name = target""")
def forward_lookup(spark: SparkSession, d: str) -> DataFrame:
    return Q.forward_lookup(_asks(spark, d), *star_graph(spark, d)).select("qid", "name", "relation", "neighbor", "label", "strength", "rank")


@query(f"""WITH {STAR_SQL}, both_ AS (SELECT subject AS s, relation, target AS t, 'outgoing' AS direction FROM rels UNION ALL SELECT target, relation, subject, 'incoming' FROM rels)
    SELECT asked.ord AS qid, asked.name, direction, relation, t AS neighbor FROM ents asked JOIN both_ ON asked.name = s JOIN ents ON ents.name = t""")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    e, r = star_graph(spark, d)
    return Q.neighbors(e.select(F.col("ord").alias("qid"), "name"), e, r).select("qid", "name", "direction", "relation", "neighbor")


@query(f"""WITH {STAR_SQL} SELECT asked.ord AS qid, asked.name, relation, target AS neighbor, strength, CAST(row_number() OVER (PARTITION BY asked.ord, asked.name, relation ORDER BY strength DESC, target) AS INTEGER) AS rank
    FROM ents asked JOIN rels ON subject = asked.name JOIN ents ON ents.name = target""")
def store_results(spark: SparkSession, d: str) -> DataFrame:
    e, r = star_graph(spark, d)
    found = Q.forward_lookup(e.select(F.col("ord").alias("qid"), "name"), e, r, drop_low_signal=False)
    return Q.result_filter(found).select("qid", "name", "relation", "neighbor", "strength", "rank")


@query(f"""WITH {STAR_SQL}, {_ASKS}, ids AS (SELECT DISTINCT qid, unnest(string_split(sources, ',')) AS chunk_id FROM asks JOIN rels ON subject = asks.name WHERE sources <> ''),
    c AS (SELECT DISTINCT qid, CASE WHEN CAST(chunk_id AS INTEGER) % 2 = 0 THEN 'Orders ending in ' || chunk_id ELSE chunk_id END AS citation FROM ids)
    SELECT qid, citation, CAST(row_number() OVER (PARTITION BY qid ORDER BY citation) AS INTEGER) AS rank FROM c QUALIFY rank <= 12""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return Q.citations(Q.forward_lookup(_asks(spark, d), *star_graph(spark, d)), _order_chunks(spark))


@query(f"""WITH {STAR_SQL}, {_ASKS}, ids AS (SELECT DISTINCT qid, unnest(string_split(sources, ',')) AS chunk_id FROM asks JOIN rels ON subject = asks.name WHERE sources <> '')
    SELECT qid, chunk_id, 'Orders ending in ' || chunk_id AS citation, 'text ' || chunk_id AS text, CAST(row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS INTEGER) AS rank FROM ids WHERE CAST(chunk_id AS INTEGER) % 2 = 0 QUALIFY rank <= 6""")
def source_chunks(spark: SparkSession, d: str) -> DataFrame:
    return Q.source_chunks(Q.forward_lookup(_asks(spark, d), *star_graph(spark, d)), _order_chunks(spark)).select("qid", "chunk_id", "citation", "text", "rank")


def _order_chunks(spark: SparkSession) -> DataFrame:
    """Payloads of the even ones among the supply relations' sources."""
    return spark.range(0, 10, 2).selectExpr("cast(id as string) as chunk_id", "concat('Orders ending in ', id) as citation", "concat('text ', id) as text")


@query(f"""WITH {STAR_SQL}, asks AS (SELECT p_partkey % 20 AS qid, 'PART ' || p_partkey AS name FROM part), hit AS (SELECT DISTINCT qid, subject, asks.name FROM asks JOIN rels ON target = asks.name AND relation = 'SUPPLIES'),
    g AS (SELECT qid, subject AS name, array_to_string(list_sort(list(name)), ',') AS matches, CAST(count(*) AS INTEGER) AS n_matches FROM hit GROUP BY qid, subject)
    SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY n_matches DESC, name) AS INTEGER) AS rank FROM g""")
def reverse_lookup(spark: SparkSession, d: str) -> DataFrame:
    asks = table(spark, d, "part").select((F.col("p_partkey") % 20).alias("qid"), F.concat(F.lit("PART "), "p_partkey").alias("name"))
    return Q.reverse_lookup(asks, *star_graph(spark, d), relation="SUPPLIES", label="SUPPLIER").withColumn("matches", F.array_join("matches", ","))


_PAIRS = "asks AS (SELECT s_suppkey // 2 AS qid, 'SUPPLIER ' || s_suppkey AS name FROM supplier)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.expr("s_suppkey div 2").alias("qid"), F.concat(F.lit("SUPPLIER "), "s_suppkey").alias("name"))


@query(f"""WITH {STAR_SQL}, {_PAIRS}, links AS (SELECT subject AS name, relation, target AS neighbor FROM rels UNION ALL SELECT target, '<-' || relation, subject FROM rels),
    n AS (SELECT qid, count(DISTINCT name) AS n FROM asks GROUP BY qid), held AS (SELECT asks.qid, relation, neighbor, count(DISTINCT asks.name) AS c, min(asks.name) AS name FROM asks JOIN links ON asks.name = links.name GROUP BY 1, 2, 3)
    SELECT qid, relation, neighbor, CASE WHEN c = n THEN 'shared' ELSE 'unique' END AS kind, CASE WHEN c = n THEN NULL ELSE name END AS name FROM held JOIN n USING (qid) WHERE c = n OR c = 1""")
def compare(spark: SparkSession, d: str) -> DataFrame:
    return Q.compare(_pairs(spark, d), star_graph(spark, d)[1])


@query(f"""WITH {STAR_SQL}, {_PAIRS}, mine AS (SELECT DISTINCT qid, asks.name, relation, target AS neighbor FROM asks JOIN rels ON asks.name = subject), n AS (SELECT qid, count(DISTINCT name) AS n FROM asks GROUP BY qid)
    SELECT qid, relation, neighbor, 'shared' AS kind, NULL AS name FROM mine JOIN n USING (qid) GROUP BY qid, relation, neighbor, n HAVING count(DISTINCT name) = n
    UNION ALL SELECT m.qid, relation, neighbor, 'unique', name FROM mine m JOIN n USING (qid) WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM mine o WHERE o.qid = m.qid AND o.neighbor = m.neighbor AND o.name <> m.name)""")
def compare_store(spark: SparkSession, d: str) -> DataFrame:
    return Q.compare_any_relation(_pairs(spark, d), star_graph(spark, d)[1])


QUESTIONS = [
    (1, "What is LITHIUM used for?"), (2, "What is the prevalence of generalized anxiety disorder?"), (3, "I feel tired and lost my appetite to eat. What could this possibly be ?"), (4, "what is depresion"), (5, "I want to kill myself"),
    (6, "What is suicidal behavior disorder?"), (7, "best pizza recipe"), (8, "What is depression?"), (9, "compare ptsd and panic disorder"), (10, "how do you distinguish ocd from autism today"), (11, "parts with steel and red finish"), (12, "which brands and nations"),
]
_QS = "questions(qid, question) AS (VALUES " + ", ".join(f"({i}, '{_esc(q)}')" for i, q in QUESTIONS) + ")"
_QB = _QS + ", searched AS (SELECT CAST(qid AS BIGINT) AS qid, question FROM questions UNION ALL SELECT 1000 + item_id, text FROM benchmark)"


def questions_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "qid int, question string")


@query(f"""WITH {STAR_SQL}, {_QB}, terms AS (SELECT qid, unnest(list_distinct([t FOR t IN regexp_extract_all(lower(question), '[a-z0-9]+') IF len(t) > 2 AND t NOT IN ({_list(C.QUERY_STOPWORDS)})])) AS term FROM searched),
    hit AS (SELECT qid, name, label, count(*) AS score FROM ents JOIN terms ON contains(lower(name || ' ' || description), term) GROUP BY 1, 2, 3)
    SELECT qid, name, label, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, name) AS INTEGER) AS rank FROM hit QUALIFY rank <= 10""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return Q.keyword_search(_searched(spark, d), star_graph(spark, d)[0])


def _searched(spark: SparkSession, d: str) -> DataFrame:
    """The fixed questions and the benchmark's."""
    return questions_df(spark).select(F.col("qid").cast("bigint").alias("qid"), "question").unionByName(table(spark, d, "benchmark").select((F.col("item_id") + 1000).alias("qid"), F.col("text").alias("question")))


@query(f"""WITH {STAR_SQL}, {_QB}, terms AS (SELECT qid, unnest(list_distinct([t FOR t IN regexp_extract_all(lower(question), '[a-z0-9]+') IF len(t) > 2 AND t NOT IN ({_list(C.KEYWORD_STOPWORDS)})])) AS term FROM searched),
    hit AS (SELECT qid, name, label, count(*) AS score FROM ents JOIN terms ON contains(lower(name), term) OR contains(lower(description), term) GROUP BY 1, 2, 3)
    SELECT qid, name, label, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, name) AS INTEGER) AS rank FROM hit QUALIFY rank <= 10""")
def store_text_search(spark: SparkSession, d: str) -> DataFrame:
    return Q.store_text_search(_searched(spark, d), star_graph(spark, d)[0])


@query(f"""WITH {_QB}, summaries AS (SELECT p_partkey AS community_id, 'Part ' || p_name || ' of type ' || p_type || ' by ' || p_brand AS summary FROM part),
    terms AS (SELECT qid, unnest(list_distinct([t FOR t IN regexp_extract_all(lower(question), '[a-z0-9]+') IF t NOT IN ({_list(C.QUERY_STOPWORDS)})])) AS term FROM searched),
    hit AS (SELECT qid, community_id, count(*) AS score FROM summaries JOIN terms ON contains(lower(summary), term) GROUP BY 1, 2)
    SELECT qid, community_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, community_id) AS INTEGER) AS rank FROM hit QUALIFY rank <= 3""")
def global_search(spark: SparkSession, d: str) -> DataFrame:
    told = F.concat(F.lit("Part "), "p_name", F.lit(" of type "), "p_type", F.lit(" by "), "p_brand")
    return Q.summary_search(_searched(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("community_id"), told.alias("summary")))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("citation"))


def _bench(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


_TOK = "[t FOR t IN regexp_extract_all(lower({}), '[a-z0-9]+') IF len(t) > 2 AND t NOT IN (" + _list(C.TOKEN_STOPWORDS) + ")]"
_TFIDF = f"""asked AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({_TOK.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
    idx AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT doc_id AS chunk_id, unnest({_TOK.format("text")}) AS term FROM documents) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM idx GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
    scored AS (SELECT qid, chunk_id, round(sum((1 + ln(1 + tf)) * times * (ln((n + 1) / (df + 1)) + 1)), 6) AS score FROM asked JOIN df USING (term) JOIN idx USING (term), n GROUP BY 1, 2),
    hits AS (SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 8)"""


@query(f"WITH {_TFIDF} SELECT * FROM hits")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_search(_bench(spark, d), _docs(spark, d))


@query(f"""WITH {_TFIDF}, re AS (SELECT qid, chunk_id, round(len(list_intersect(list_distinct({_TOK.format("b.text")}), list_distinct({_TOK.format("d.text")}))) + score, 6) AS score
    FROM hits JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = chunk_id)
    SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM re QUALIFY rank <= 5""")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(_bench(spark, d), R.lexical_search(_bench(spark, d), _docs(spark, d)), _docs(spark, d))


@query("""WITH s AS (SELECT q.vec_id AS qid, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)
    SELECT qid, vec_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 8""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return R.dense_search(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), v)


_E = "list_distinct([t FOR t IN regexp_extract_all(lower({}), '[a-z0-9]+') IF len(t) > 2])"
_SHARE = "CASE WHEN len({y}) > 0 THEN len(list_intersect({x}, {y})) / len({y}) ELSE 0.0 END"


@query(f"""WITH {_TFIDF}, t AS (SELECT qid, {_E.format("any_value(b.text)")} AS g, {_E.format("string_agg(d.text, ' ' ORDER BY rank)")} AS c, {_E.format("arg_min(d.text, rank)")} AS a
        FROM hits JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = chunk_id GROUP BY qid),
    m AS (SELECT {_SHARE.format(x="g", y="a")} AS p, {_SHARE.format(x="a", y="g")} AS r, {_SHARE.format(x="g", y="c")} AS cp, {_SHARE.format(x="c", y="g")} AS cr, {_SHARE.format(x="c", y="a")} AS fa FROM t)
    SELECT 'vector_baseline' AS system, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS answer_relevancy, round(avg(cp), 6) AS context_precision, round(avg(cr), 6) AS context_recall, round(avg(fa), 6) AS faithfulness FROM m""")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    hits = R.lexical_search(_bench(spark, d), _docs(spark, d)).join(_docs(spark, d).select("chunk_id", "text"), "chunk_id")
    told = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    rows = told.join(_bench(spark, d), "qid").select(F.lit("vector_baseline").alias("system"), F.col("contexts")[0].alias("answer"), F.col("question").alias("ground_truth"), "contexts")
    return R.answer_metrics(rows)


# --- rules on text -------------------------------------------------------------------------------------------


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The fixed questions and what users said in conversations, English and plain ASCII alike."""
    said = table(spark, d, "conversations").where("role = 'user'").select(((F.col("conv_id") + 1) * 100000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))
    return questions_df(spark).select(F.col("qid").cast("bigint").alias("qid"), "question").unionByName(said)


_ASKED = f"{_QS}, asked AS (SELECT CAST(qid AS BIGINT) AS qid, question FROM questions UNION ALL SELECT (conv_id + 1) * 100000 + turn, text FROM conversations WHERE role = 'user')"


def _re(patterns) -> str:
    # a word border of ASCII and Latin letters, as the engine has it
    return _esc("(?i)" + "|".join(f"(?:{p})" for p in patterns))


@query(f"""WITH {_ASKED}, f AS (SELECT qid, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS q FROM asked),
    m AS (SELECT qid, {", ".join(f"regexp_matches(q, '{_re(p)}') AS {k}" for k, p in C.CRISIS_SIGNALS.items())}, regexp_matches(q, '{_re(C.INFORMATIONAL)}') AND NOT regexp_matches(q, '{_re(C.FIRST_PERSON)}') AS asking FROM f)
    SELECT qid, array_to_string([x FOR x IN [{", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in C.CRISIS_SIGNALS)}] IF x IS NOT NULL], ',') AS indicators,
    (explicit_self_harm_intent OR imminence_or_plan OR severe_distress) AND NOT (asking AND NOT imminence_or_plan AND NOT severe_distress) AS crisis FROM m""")
def safety_gate(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("qid", F.array_join(P.crisis_indicators(F.col("question")), ",").alias("indicators"), P.is_crisis(F.col("question")).alias("crisis"))


_INTENT = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(question), '{_esc(h)}')''' for h in hints)} THEN '{name}'" for name, hints, _ in C.INTENTS) + " ELSE 'general' END"


@query(f"WITH {_ASKED} SELECT qid, {_INTENT} AS intent FROM asked")
def relation_intent(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("qid", P.relation_intent(F.col("question")).alias("intent"))


_KEYWORDS = f"[t FOR t IN regexp_extract_all(lower(question), '[a-z0-9]+') IF t IN ({_list(C.DOMAIN_KEYWORDS)})]"
_ANY = lambda parts: "(" + " OR ".join(f"contains(lower(question), '{_esc(x)}')" for x in parts) + ")"


@query(f"""WITH {_ASKED}, f AS (SELECT qid, question, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS q FROM asked),
    m AS (SELECT qid, question, {", ".join(f"regexp_matches(q, '{_re(p)}') AS {k}" for k, p in C.CRISIS_SIGNALS.items())}, regexp_matches(q, '{_re(C.INFORMATIONAL)}') AND NOT regexp_matches(q, '{_re(C.FIRST_PERSON)}') AS asking,
        {_ANY(C.SYMPTOM_PATTERNS + C.FOLLOW_UPS)} AND len([t FOR t IN regexp_extract_all(lower(question), '[a-z0-9]+') IF t IN ({_list(C.CUE_WORDS)})]) > 0 AS symptoms FROM f)
    SELECT qid, CASE WHEN (explicit_self_harm_intent OR imminence_or_plan OR severe_distress) AND NOT (asking AND NOT imminence_or_plan AND NOT severe_distress) THEN 'CRISIS'
        WHEN len({_KEYWORDS}) > 0 OR symptoms OR {_INTENT} <> 'general' THEN 'IN_SCOPE' ELSE 'OUT_OF_SCOPE' END AS scope, symptoms, {_ANY(C.COMPARISON_PARTS)} AS comparison FROM m""")
def scope_class(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("qid", P.scope(F.col("question"), F.lit(False)).alias("scope"), P.is_natural_symptom_question(F.col("question")).alias("symptoms"), P.is_comparison(F.col("question")).alias("comparison"))


@query("""WITH u AS (SELECT conv_id AS session_id, turn, text AS question FROM conversations WHERE role = 'user')
    SELECT session_id, turn, question, trim(coalesce(string_agg(question, ' ') OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') || ' ' || question) AS analysis_text FROM u""")
def session_memory(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("question"))
    return session_context(said)


_NORM = "trim(regexp_replace(upper({}), '[^A-Z0-9]+', ' ', 'g'))"


@query(f"SELECT p_partkey, {_NORM.format('p_name')} AS normal, replace({_NORM.format('p_name')}, ' ', '') AS compact FROM part")
def names_normal(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", T.normalize_name(n).alias("normal"), T.compact_name(n).alias("compact"))


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) <= 420 THEN t ELSE rtrim(substr(t, 1, 417)) || '...' END AS excerpt FROM c""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query(r"SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_extract(url, '([^/\\]*)[/\\]*$', 1) AS base FROM pages")
def source_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), T.basename(F.col("url")).alias("base"))


@query("""SELECT doc_id, 'Archive: ' || upper(substr(source, 1, 1)) || lower(substr(source, 2)) AS label, 'Archive: ' || upper(substr(source, 1, 1)) || lower(substr(source, 2)) || ' — Part > ' || doc_id AS citation FROM documents""")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    label = T.source_label(F.lit(None).cast("string"), F.concat(F.lit("archive__"), "source", F.lit("__x.md")), F.lit(None).cast("string"))
    return table(spark, d, "documents").select("doc_id", label.alias("label"), T.citation_label(label, F.concat(F.lit("**Part** / "), F.col("doc_id").cast("string"))).alias("citation"))


_CLEAN = r"""lines AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r\n|\r|\n')) AS x, generate_subscripts(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), 1) AS i FROM documents),
    flat AS (SELECT doc_id, i, x, trim(x) AS f, trim(regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', ' ', 'g'), '[*_`~]+', '', 'g'), '[™®]', ' ', 'g'), '[‐-―]', '-', 'g'), '\s+', ' ', 'g'))), '[^a-z0-9]+', ' ', 'g')) AS h FROM lines),
    kept AS (SELECT doc_id, i, CASE WHEN f = '' THEN '' ELSE x END AS x FROM flat WHERE f = '' OR NOT (regexp_matches(f, '(?i)^\*\*(?:==> picture .* omitted <==|----- (?:Start|End) of picture text -----)\*\*(?:<br>)?$') OR regexp_matches(h, '(?i)^(?:page\s+)?(?:\d+|[ivxlcdm]+|[a-z]?\d+)$') OR regexp_matches(h, '(?i)^[ivxlcdm]+$'))),
    clean AS (SELECT d.doc_id, coalesce(regexp_replace(regexp_replace(string_agg(x, chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '') AS t FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id),
    parts AS (SELECT doc_id, t, [x FOR x IN string_split(t, chr(10)) IF trim(x) <> ''] AS ls FROM clean)"""
_HITS = f"list_sort([s FOR s IN [{_list(C.CLINICAL_SIGNALS)}] IF contains(lower(chr(10) || t), s)])"
_QUALITY = f"""quality AS (SELECT doc_id, CAST(length(t) AS INTEGER) AS char_count, CAST(len([w FOR w IN string_split_regex(t, '\\s+') IF w <> '']) AS INTEGER) AS word_count, CAST(len(ls) AS INTEGER) AS line_count,
    len([x FOR x IN ls IF regexp_matches(x, '^\\s*(?:[-*•]|\\d+\\.|[A-Z]\\.|[a-z]\\)|\\([a-z]\\))\\s+')]) / greatest(len(ls), 1) AS list_ratio, len([x FOR x IN ls IF contains(x, '|')]) / greatest(len(ls), 1) AS table_ratio,
    length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / greatest(length(regexp_replace(t, '\\s', '', 'g')), 1) AS alpha_ratio, CAST(len(regexp_extract_all(t, '[.!?]+')) AS INTEGER) AS sentence_count,
    CAST(len(regexp_extract_all(t, '\\b[A-TV-Z][0-9][0-9AB](?:\\.[A-Z0-9]{{1,4}})?\\b')) AS INTEGER) AS icd_code_count, {_HITS} AS hits FROM parts)"""


@query(f"""WITH {_CLEAN}, {_QUALITY} SELECT doc_id, char_count, word_count, line_count, round(list_ratio, 6) AS list_ratio, round(table_ratio, 6) AS table_ratio, round(alpha_ratio, 6) AS alpha_ratio, sentence_count, icd_code_count, array_to_string(hits, ',') AS hits FROM quality""")
def chunk_quality(spark: SparkSession, d: str) -> DataFrame:
    q = spread(table(spark, d, "documents").select("doc_id", "text"), TEXTS).select("doc_id", P.chunk_quality(F.col("text"), F.lit("")).alias("q"))
    ratio = lambda c: F.round(f"q.{c}", 6).alias(c)
    return q.select("doc_id", "q.char_count", "q.word_count", "q.line_count", ratio("list_ratio"), ratio("table_ratio"), ratio("alpha_ratio"), "q.sentence_count", "q.icd_code_count", F.array_join("q.clinical_hits", ",").alias("hits"))


@query(f"""WITH {_CLEAN}, {_QUALITY}, r AS (SELECT CASE WHEN char_count < 150 THEN 'too_short' WHEN table_ratio > 0.30 AND len(hits) = 0 THEN 'table_heavy' WHEN list_ratio > 0.70 AND char_count < 600 AND len(hits) = 0 THEN 'list_heavy'
    WHEN icd_code_count >= 3 AND char_count < 1000 AND len(hits) = 0 THEN 'code_heavy' WHEN alpha_ratio < 0.50 THEN 'low_alpha_ratio' WHEN len(hits) = 0 THEN 'no_clinical_signal' ELSE 'ok' END AS reason FROM quality) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def chunk_keep_reasons(spark: SparkSession, d: str) -> DataFrame:
    q = spread(table(spark, d, "documents").select("text"), TEXTS).select(P.chunk_quality(F.col("text"), F.lit("")).alias("q"))
    return q.select(F.split(P.keep_reason(F.col("q")), ":")[0].alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query()
def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.operators.sections import split_sections

    pages = S.html_to_markdown(table(spark, d, "pages")).withColumnRenamed("page_id", "doc_id")
    return split_sections(pages, "markdown").select("doc_id", "idx", "level", "header", "header_path", F.length("content").alias("chars"))


@query("""WITH a AS (SELECT doc_id AS chunk_id, CASE WHEN source = lang THEN source ELSE '1' END AS v FROM documents), b AS (SELECT doc_id AS chunk_id, CAST(max(quality) AS VARCHAR) AS v FROM labels GROUP BY doc_id)
    SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(b.v, a.v) AS value, coalesce(a.v <> b.v, false) AS collides FROM a FULL JOIN b ON a.chunk_id = b.chunk_id""")
def chunk_map_merge(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("source") == F.col("lang"), F.col("source")).otherwise("1").alias("value"))
    return G.merge_chunk_maps(first, table(spark, d, "labels").groupBy(F.col("doc_id").alias("chunk_id")).agg(F.max("quality").cast("string").alias("value")))


@query("""WITH n AS (SELECT CAST(doc_id % 700 AS VARCHAR) AS id, lang AS grp, doc_id AS ord, source FROM documents)
    SELECT id, grp, ord, source FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY grp, ord) = 1""")
def dedupe_nodes(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.operators.sections import dedupe_nodes as first_of

    return first_of(table(spark, d, "documents").select((F.col("doc_id") % 700).cast("string").alias("id"), F.col("lang").alias("grp"), F.col("doc_id").alias("ord"), "source"))


@query("""WITH n AS (SELECT count(DISTINCT (l_suppkey, l_partkey)) AS pairs, count(DISTINCT l_suppkey) AS chunks FROM lineitem)
    SELECT 'json_parse_errors' AS counter, count(*) FILTER (s % 10 = 0) AS n FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem) UNION ALL SELECT 'type_conflicts', 0 UNION ALL SELECT 'garbage_rejected', 0 UNION ALL SELECT 'semantic_rejected', 0
    UNION ALL SELECT 'skipped_triplets', count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem WHERE l_suppkey % 10 = 1""")
def extraction_stats(spark: SparkSession, d: str) -> DataFrame:
    chunks = _payload_chunks(spark, d)
    broken = F.when(F.col("chunk_seq") % 10 == 0, "{broken").when(F.col("chunk_seq") % 10 == 1, F.replace(F.col("payload"), F.lit('"supplies"'), F.lit('"unheard_of"'))).otherwise(F.col("payload"))
    return G.extraction_stats(chunks.withColumn("payload", broken), STAR)


@query(f"""WITH RECURSIVE {STAR_SQL}, edges AS MATERIALIZED (SELECT subject AS a, target AS b FROM rels UNION SELECT target, subject FROM rels),
    lab(name, component) USING KEY (name) AS (SELECT DISTINCT a, a FROM edges UNION SELECT e.b, min(l.component) FROM lab l JOIN edges e ON e.a = l.name JOIN recurring.lab cur ON cur.name = e.b WHERE l.component < cur.component GROUP BY e.b)
    SELECT name, component FROM lab""")
def components(spark: SparkSession, d: str) -> DataFrame:
    return CM.connected_components(CM.undirected(star_graph(spark, d)[1]))


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    return CM.communities(star_graph(spark, d)[1])


@query()
def community_summaries(spark: SparkSession, d: str) -> DataFrame:
    e, r = star_graph(spark, d)
    r = stage(r, "supplies")
    return CM.summaries(CM.communities(r), e, r)


@query()
def fuzzy_link(spark: SparkSession, d: str) -> DataFrame:
    e = star_graph(spark, d)[0]
    typos = e.select(F.col("ord").alias("qid"), F.concat(F.lit("where is "), F.regexp_replace(F.lower("name"), "^(..).", "$1"), F.lit(" then")).alias("question"))
    return L.link_fuzzy(typos, e)


@query(f"""WITH {STAR_SQL}, n AS (SELECT name, label, ord, trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')) AS k FROM ents), q AS (SELECT ord AS qid, ' AND WHAT OF ' || k || ' PLEASE ' AS asked FROM n)
    SELECT DISTINCT qid, name, label FROM q JOIN n ON contains(asked, ' ' || k || ' ')""")
def exact_link(spark: SparkSession, d: str) -> DataFrame:
    e = star_graph(spark, d)[0]
    return L.link_exact(e.select(F.col("ord").alias("qid"), F.concat(F.lit("and what of "), F.lower("name"), F.lit(", please?")).alias("question")), e)


_N = "trim(regexp_replace(upper(replace({}, 'ß', 'SS')), '[^A-Z0-9]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT *, replace(whole, ' ', '') AS compact FROM (SELECT doc_id AS chunk_seq, {_N.format("source")} AS section, {_N.format("lang")} AS context, {_N.format("substr(text, 1, 220)")} AS lead,
        {_N.format("concat_ws(' ', nullif(source, ''), nullif(lang, ''), nullif(text, ''))")} AS whole FROM documents)),
    w AS (SELECT item_id, string_split({_N.format("text")}, ' ') AS w FROM benchmark),
    g AS (SELECT target, alias, replace(alias, ' ', '') AS squeezed, hint FROM (SELECT 'B' || item_id || ' ' || k AS target, w[k] || ' ' || w[k + 1] AS alias, w[k + 2] || ' ' || w[k + 3] AS hint FROM w, unnest(range(1, len(w) - 2)) r(k))),
    s AS (SELECT target, chunk_seq, CASE WHEN contains(context, alias) THEN 20 ELSE 0 END + CASE WHEN contains(whole, alias) THEN 18 ELSE 0 END + CASE WHEN contains(compact, squeezed) THEN 12 ELSE 0 END
        + CASE WHEN contains(section, hint) THEN 12 WHEN contains(whole, hint) THEN 5 ELSE 0 END AS score, contains(context, alias) OR starts_with(section, alias) OR contains(lead, alias) AS anchor FROM t, g),
    f AS (SELECT *, CASE WHEN chunk_seq - lag(chunk_seq) OVER w > 4 THEN 1 ELSE 0 END AS fresh FROM s WHERE anchor WINDOW w AS (PARTITION BY target ORDER BY chunk_seq)),
    i AS (SELECT target, chunk_seq, sum(fresh) OVER (PARTITION BY target ORDER BY chunk_seq) AS island FROM f), z AS (SELECT target, island, count(*) AS n, min(chunk_seq) AS a, max(chunk_seq) AS b FROM i GROUP BY 1, 2),
    best AS (SELECT target, a, b FROM z QUALIFY row_number() OVER (PARTITION BY target ORDER BY n DESC, a) = 1),
    far AS (SELECT s.*, best.a, CASE WHEN chunk_seq < best.a THEN best.a - chunk_seq WHEN chunk_seq > best.b THEN chunk_seq - best.b ELSE 0 END AS far FROM s LEFT JOIN best USING (target)),
    p AS (SELECT target, chunk_seq, CAST(score + CASE WHEN a IS NULL THEN 0 WHEN far <= 1 THEN 18 WHEN far <= 3 THEN 10 WHEN far <= 6 THEN 4 ELSE 0 END AS INTEGER) AS score FROM far WHERE NOT (a IS NOT NULL AND far > 6 AND score < 28))
    SELECT target, chunk_seq, score, CAST(row_number() OVER (PARTITION BY target ORDER BY score DESC, chunk_seq) AS INTEGER) AS rank FROM p WHERE score >= 18 QUALIFY rank <= 6""")
def repair_select(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_seq"), F.col("source").alias("section"), F.col("lang").alias("context"), "text")
    return G.select_repair_chunks(stage(G.repair_scores(chunks, _repair_targets(spark, d)), "repair_scores"), chunks=chunks)


def _repair_targets(spark: SparkSession, d: str) -> DataFrame:
    """Each two words of a benchmark's text as a target, with the two that follow as its hint."""
    words = table(spark, d, "benchmark").select("item_id", F.split(T.normalize_name(F.col("text")), " ").alias("w"))
    each = words.where("size(w) > 3").select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 3)).alias("k"))
    two = lambda at: F.array(F.concat(F.element_at("w", F.col("k") + at), F.lit(" "), F.element_at("w", F.col("k") + at + 1)))
    return each.select(F.concat(F.lit("B"), F.col("item_id").cast("string"), F.lit(" "), F.col("k").cast("string")).alias("target"), two(0).alias("aliases"), two(2).alias("hints"))


def _whole(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of the tables with the one for questions in prose beside it, and payloads for both."""
    from quillgraph.plans.demo import demo_graph

    (e, r, c), (se, sr) = demo_graph(spark), star_graph(spark, d)
    # many lookups read them
    return stage(e.unionByName(se), "whole_entities"), stage(r.unionByName(sr), "whole_relations"), c.unionByName(_order_chunks(spark))


@query()
def hybrid_answers(spark: SparkSession, d: str) -> DataFrame:
    e, r, c = _whole(spark, d)
    asked = _asked(spark, d).unionByName(table(spark, d, "nation").select((-1 - F.col("n_nationkey")).cast("bigint").alias("qid"), F.concat(F.lit("what about "), F.lower("n_name")).alias("question")))
    return answer_questions(asked, e, r, c, CM.summaries(CM.communities(r), e, r))


@query()
def eval_systems(spark: SparkSession, d: str) -> DataFrame:
    e, r, c = _whole(spark, d)
    cases = _bench(spark, d).withColumn("ground_truth", F.col("question"))
    graph = R.graph_contexts(answer_parts(cases.select("qid", "question"), e, r, c), c)
    return R.answer_metrics(R.run_systems(cases, _docs(spark, d), graph))
