"""One thin query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quillgraph.llm.bpe import bpe_decode, bpe_encode
from quillgraph.llm.embed_dedup import near_vectors
from quillgraph.llm.media import UNIT, read_media, store_media
from quillgraph.llm.near_dedup import near_duplicates
from quillgraph.llm.packing import pack, token_pieces
from quillgraph.llm.secrets import scan_secrets
from quillgraph.llm.sharding import SHARDS, shard_by_bytes
from quillgraph.llm.spelling import group_spellings
from quillgraph.llm.token_counts import count_tokens
from quillgraph.llm.toxicity import fit, held_out, toxicity_scores
from quillgraph.llm.url_filter import judge_urls
from quillgraph.llm.vector_codes import coded
from quillgraph.llm.warc import resolve_revisits

#: The contract's rules.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, similarity=0.85)


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    """The public vocabulary that a contract names; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(store_media(_table(spark, sf_dir, "documents")))
    size = (F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / UNIT)) * UNIT).cast("bigint")
    payload = F.expr(f"substring(thumbnail, 1, cast(greatest(1, ceil(n_bytes / {UNIT})) * {UNIT} as int))")
    return read.withColumn("payload", payload).select(
        "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat_ws("-", F.concat_ws("x", "width", "height"), "thumbnail_hash").alias("feature"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(_table(spark, sf_dir, "documents"), vocabulary_file())
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def page_captures(pages: DataFrame) -> DataFrame:
    """A crawl log over all pages: each is fetched in full at a time of its own and revisited twice; every seventh has changed by the second visit."""
    visit = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("visit")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    changed = (F.col("visit") == 2) & (F.col("page_id") % 7 == 0)
    when = F.timestamp_seconds(1_700_000_000 + F.col("page_id") * 60 + F.col("visit") * 86_400)
    headers = F.when(F.col("visit") == 0, F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), when.cast("string"))).otherwise(
        F.create_map(F.lit("etag"), F.when(changed, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag)), F.lit("Date"), when.cast("string"), F.lit("X-Cache"), F.lit("HIT"))
    )
    return pages.select("page_id", "url", "html", visit).select(
        (F.col("page_id") * 3 + F.col("visit")).alias("record_id"), "url", when.alias("warc_date"), F.when(F.col("visit") == 0, "response").otherwise("revisit").alias("kind"), headers.alias("headers"),
        F.when(F.col("visit") == 0, F.sha2(F.coalesce("html", F.lit("")), 256)).alias("payload_digest"),
    )


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_captures(_table(spark, sf_dir, "pages")))
    return out.select("record_id", "url_key", "status", F.col("refers_to").cast("string").alias("refers_to"), "payload_digest", F.to_json(F.array_sort(F.map_entries("headers"))).alias("headers"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity_scores(docs, fit(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = bpe_decode(bpe_encode(_table(spark, sf_dir, "documents"), vocabulary_file()), vocabulary_file())
    return read.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(_table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_media": op2_media,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_embed_dedup": op5_embed_dedup,
    "op6_sharding": op6_sharding,
    "op7_url_filter": op7_url_filter,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_spelling": op11_spelling,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_counts": op13_token_counts,
}



def _codes_sql(parts: int = 4, own: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """op12: each round's assignments and codebooks as tables of their own; distance and index are one number, so the least has the lowest index."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, CAST(min((xx - 2 * list_inner_product(x, c) + cc) * 256 + entry) AS BIGINT) AS k FROM p JOIN b{r} USING (part) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""n{r} AS (SELECT part, entry, list(m ORDER BY i) AS c FROM (SELECT part, k % 256 AS entry, i, floor(sum(x[i]) / count(*)) AS m FROM a{r} JOIN p USING (vec_id, part), range(1, {own + 1}) t(i) GROUP BY ALL) GROUP BY part, entry),
            b{r + 1} AS MATERIALIZED (SELECT part, entry, c, list_inner_product(c, c) AS cc FROM (SELECT part, entry, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN n{r} n USING (part, entry)))""")
    return f"""
        WITH v AS (
            SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS MATERIALIZED (SELECT vec_id, part, x, list_inner_product(x, x) AS xx FROM (SELECT vec_id, part, q[{own} * part + 1:{own} * part + {own}] AS x FROM v, range({parts}) t(part))),
        b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c, xx AS cc FROM p QUALIFY entry < {entries}),
        {", ".join(steps)},
        told AS (SELECT vec_id, string_agg(printf('%02x', k % 256), '' ORDER BY part) AS code, CAST(sum(k // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
        book AS (SELECT sha256(string_agg(array_to_string([CAST(CAST(y AS BIGINT) AS VARCHAR) FOR y IN c], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM told JOIN v USING (vec_id), book
    """


def _crc_table() -> list[int]:
    """The table of the common 32-bit cyclic redundancy check."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ 0xEDB88320 * (b & 1)
        out.append(b)
    return out


#: op11: the digest goes byte by byte; near words share what is left without one letter.
_SPELLING_SQL = f"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL
    ), h AS (
        SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1 FOR i IN range(len(x) // 2)]),
            lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]::BIGINT))) AS h FROM (SELECT run, k, hex(doc_id || ':' || run) AS x FROM runs)
    ), n AS (
        SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
    ), d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM n)),
    near AS (
        SELECT DISTINCT * FROM (SELECT d.word, n.word AS other FROM d JOIN n ON d.rest = n.word UNION ALL SELECT n.word, d.word FROM d JOIN n ON d.rest = n.word UNION ALL SELECT a.word, b.word FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word)
    ), best AS (SELECT near.word, count(*) OVER (PARTITION BY near.word) AS n_near, other, o.n AS other_n FROM near JOIN n o ON o.word = other QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) = 1),
    f AS MATERIALIZED (SELECT word, CASE WHEN other_n >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM n LEFT JOIN best USING (word)),
    up AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
    last AS (SELECT up.word, up.root FROM up JOIN f ON f.word = up.root AND f.form IS NULL)
    SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN last USING (word)
"""

_FITS = {r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')" for _, r in URL_RULES}
_BY_LENGTH = sorted(URL_RULES, key=lambda x: (-len(x[1]), x[1]))
#: op7: rules, then both ranks walked for so many steps that what is left of the start is far below any difference of theirs.
_URL_SQL = rf"""
    WITH RECURSIVE u AS (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages
    ), j AS (SELECT *, CASE {" ".join(f"WHEN {_FITS[r]} THEN '{r}'" for _, r in _BY_LENGTH)} END AS rule, CASE {" ".join(f"WHEN {_FITS[r]} THEN '{v}'" for v, r in _BY_LENGTH)} END AS told FROM u),
    a AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) AS t FROM j),
    l AS (SELECT src, dst, count(*) AS n FROM (SELECT src, translate(regexp_extract(t, '^(?s:.*?)//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM a) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
    h AS (SELECT host, max(allow) AS allow, max(block) AS block FROM (SELECT host, count(*) FILTER (told = 'allow') AS allow, count(*) FILTER (told = 'block') AS block FROM j GROUP BY host UNION ALL SELECT unnest([src, dst]), 0, 0 FROM l) GROUP BY host),
    s AS (SELECT 't' AS kind, host, coalesce(allow / nullif(sum(allow) OVER (), 0), 0) AS seed FROM h UNION ALL SELECT 'd', host, coalesce(block / nullif(sum(block) OVER (), 0), 0) FROM h),
    e AS MATERIALIZED (
        SELECT x.kind, x.src, x.dst, x.share, s.seed FROM (SELECT 't' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM l UNION ALL SELECT 'd', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM l UNION ALL SELECT kind, host, host, 0 FROM s) x JOIN s ON s.kind = x.kind AND s.host = x.dst
    ), walk AS (
        SELECT 0 AS i, kind, host, CAST(seed AS DOUBLE) AS rank FROM s
        UNION ALL SELECT i + 1, kind, host, came + (1 - sum(came) OVER (PARTITION BY kind)) * seed FROM (SELECT i, w.kind, e.dst AS host, e.seed, 0.85 * sum(rank * share) AS came FROM walk w JOIN e ON e.kind = w.kind AND e.src = w.host WHERE i < 150 GROUP BY i, w.kind, e.dst, e.seed)
    ), v AS (SELECT host, CASE WHEN max(rank) FILTER (kind = 'd') - max(rank) FILTER (kind = 't') > 0 THEN 'block' ELSE 'allow' END AS verdict FROM walk WHERE i = 150 GROUP BY host)
    SELECT page_id, j.host, path, rule, coalesce(told, v.verdict, 'allow') AS verdict FROM j LEFT JOIN v USING (host)
"""

ORACLES = {
    "op7_url_filter": _URL_SQL,
    "op11_spelling": _SPELLING_SQL,
    "op12_vector_codes": _codes_sql(),
    "op5_embed_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), good AS (
            SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
        n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
        reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.seen = link.a),
        comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON node = vec_id LEFT JOIN n ON a = vec_id
    """,
    "op8_warc_revisits": r"""
        WITH u AS (
            SELECT page_id, url, coalesce(html, '') AS html, lower(regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)) AS host,
                regexp_extract(url, '://(?:[^/?#@]*@)?(?:\[[^\]/?#]*\]|[^/?#:]*):(\d+)', 1) AS port, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '://[^?#]*\?([^#]*)', 1) AS query FROM pages
        ), k AS (
            SELECT page_id, html, CASE WHEN scheme <> '' AND host <> '' THEN scheme || '://' || regexp_replace(host, '\.$', '') || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
                || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END END AS url_key
            FROM (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[a-z]+|fbclid|gclid)='))) AS ps FROM u)
        ), c AS (
            SELECT page_id * 3 + visit AS record_id, url_key, visit, 1700000000 + page_id * 60 + visit * 86400 AS told_at, md5(html) AS tag, sha256(html) AS digest, visit = 2 AND page_id % 7 = 0 AS changed FROM k, (VALUES (0), (1), (2)) v(visit)
        ), f AS (SELECT * FROM c WHERE visit = 0),
        o AS (
            SELECT r.record_id, max_by(struct_pack(id := f.record_id, tag := f.tag, digest := f.digest), struct_pack(a := f.told_at, id := f.record_id)) AS o FROM c r JOIN f ON f.url_key = r.url_key AND (f.told_at < r.told_at OR (f.told_at = r.told_at AND f.record_id < r.record_id)) WHERE r.visit > 0 GROUP BY r.record_id
        ), j AS (
            SELECT c.*, o.o, CASE WHEN visit = 0 THEN 'full' WHEN o.o IS NULL OR url_key IS NULL THEN 'orphan' WHEN NOT changed AND o.o.tag = c.tag THEN 'resolved' ELSE 'mismatch' END AS status,
                '"' || replace(CASE WHEN visit = 0 THEN '"' || tag || '"' WHEN changed THEN '"changed"' ELSE 'W/"' || tag || '"' END, '"', '\"') || '"' AS etag, '"' || strftime(make_timestamp(told_at * 1000000), '%Y-%m-%d %H:%M:%S') || '"' AS told FROM c LEFT JOIN o USING (record_id)
        )
        SELECT record_id, url_key, status, CASE WHEN status = 'resolved' THEN CAST(o.id AS VARCHAR) END AS refers_to, CASE WHEN status = 'full' THEN digest WHEN status = 'resolved' THEN o.digest END AS payload_digest,
            '[' || CASE WHEN status IN ('full', 'resolved') THEN '{"key":"content-type","value":"text/html"},' ELSE '' END || '{"key":"date","value":' || told || '},{"key":"etag","value":' || etag || '}' || CASE WHEN status IN ('full', 'resolved') THEN '' ELSE ',{"key":"x-cache","value":"HIT"}' END || ']' AS headers FROM j
    """,
    "op1_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_distinct([array_to_string(words[i:i + 2], ' ') FOR i IN range(1, len(words) - 1)]) END AS shingles FROM w
        ), flat AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_, any_value(x.n) AS nx, any_value(y.n) AS ny FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM pairs WHERE 100 * both_ >= 85 * (nx + ny - both_)),
        reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.seen = link.a),
        comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
        SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN comp ON comp.node = s.doc_id
    """,
}
