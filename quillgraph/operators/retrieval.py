"""Ranked retrieval: TF-IDF over an inverted index, dense vectors, reranking, contexts and answer metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T

#: Bytes of queries that may go to every task, vectors of a block, queries that are multiplied with it at once.
QUERY_BYTES, BLOCK, QUERIES_AT_ONCE = 32_000_000, 32_768, 64

def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(chunk_id, term, tf). One shuffle, combined on the map side."""
    return chunks.select("chunk_id", F.explode(T.search_tokens(F.col(text))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def lexical_search(questions: DataFrame, chunks: DataFrame, top: int = 8) -> DataFrame:
    """(qid, chunk_id, score, rank): sum over the question's tokens, repeats included, of (1 + ln(1 + tf)) * idf.

    Only postings of asked terms are kept before the counts by term; scores are rounded before ranking.
    """
    asked = questions.select("qid", F.explode(T.search_tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    index = postings(chunks).join(asked.select("term").distinct(), "term", "left_semi")
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    n = chunks.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    weighted = asked.join(df, "term").join(F.broadcast(n)).select("qid", "term", (F.col("times") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("weight"))
    scored = index.join(weighted, "term").groupBy("qid", "chunk_id").agg(F.round(F.sum((1 + F.log(1 + F.col("tf"))) * F.col("weight")), 6).alias("score"))
    return scored.where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= top)


def _unit_rows(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of that many finite components and some length, those rows scaled to length 1), in double precision."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten()
    ends, whole = np.cumsum(sizes), sizes == width
    rows = (whole & vectors.is_valid().to_numpy(zero_copy_only=False)).nonzero()[0]
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)[(ends[rows] - width)[:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    most = np.abs(x).max(1, initial=0)
    good = np.isfinite(most) & (most > 0)
    x = x[good] / most[good, None]
    return rows[good], x / np.sqrt((x * x).sum(1))[:, None]


def _best_of_block(queries: np.ndarray, vectors: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place of the vector, score) of each query's best vectors; of equal scores, rounded to six places, the first place holds."""
    out, n = [], len(vectors)
    for begin in range(0, len(queries), QUERIES_AT_ONCE):
        scores = np.round(queries[begin : begin + QUERIES_AT_ONCE] @ vectors.T, 6)
        # one whole number for score and place, so that ties have an order too
        keys = np.rint(scores * 1e6).astype(np.int64) * n - np.arange(n)
        k = min(top, n)
        best = np.argpartition(-keys, k - 1, axis=1)[:, :k]
        q = np.repeat(np.arange(len(scores)), k)
        out.append((q + begin, best.ravel(), scores[q, best.ravel()]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int),) * 3


def _best_of(asked: dict, batch: pa.Table, top: int) -> Iterator[pa.RecordBatch]:
    """Best vectors of a block (vec_id, embedding) for every query, by width of the queries; ids are in order for ties."""
    batch = batch.take(pc.sort_indices(batch, [("vec_id", "ascending")])).combine_chunks()
    column = batch.column("embedding")
    column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    for width, (ids, queries) in asked.items():
        rows, unit = _unit_rows(column, width)
        if len(rows) and len(queries):
            q, at, score = _best_of_block(queries, unit, top)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), batch.column("vec_id").combine_chunks().take(pa.array(rows[at])), pa.array(score)], ["qid", "vec_id", "score"])


def _queries_by_width(table: pa.Table) -> dict:
    """{width: (ids, unit rows)} of queries (qid, query); those that are null, zero or not finite are in none."""
    table = table.combine_chunks()
    if not table.num_rows:
        return {}
    column, ids = table.column("query").chunk(0), table.column("qid").chunk(0)
    out = {}
    for width in np.unique(np.diff(column.offsets.to_numpy())).tolist():
        rows, unit = _unit_rows(column, width) if width else (np.zeros(0, int), None)
        if len(rows):
            out[width] = (ids.take(pa.array(rows)), unit)
    return out


def dense_search(queries: DataFrame, vectors: DataFrame, top: int = 8, most_bytes: int = QUERY_BYTES, block: int = BLOCK) -> DataFrame:
    """(qid, vec_id, score, rank) by cosine of every query (qid, query) with every vector (vec_id, embedding).

    Blocks of vectors are multiplied with blocks of queries, and only the best ``top`` of a block leave its task, a row
    for each query and place; the best of all blocks are merged by query. Queries whose measured size is at most
    ``most_bytes`` go to every task, and vectors aren't shuffled; more of them are dealt into cells of a block of queries
    and one of vectors. Vectors and queries that are null, empty, zero or not finite meet nothing, nor do different widths.
    """
    told = queries.select("qid", F.col("query").cast("array<double>").alias("query"))
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"
    size = told.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("query").cast("bigint")), F.lit(0)).alias("values")).first()
    total = 16 * size.n + 8 * max(size["values"], 0)
    if total <= most_bytes:
        asked = _queries_by_width(told.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= block:
                    yield from _best_of(asked, pa.Table.from_batches(held), top)
                    held, n = [], 0
            if n:
                yield from _best_of(asked, pa.Table.from_batches(held), top)

        scored = own.mapInArrow(run, schema)
    else:
        rows = -(-total // most_bytes)
        columns = max(1, -(-own.count() // block))
        side = lambda df, id_, n, m, first: df.withColumn("i" if first else "j", F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")).withColumn("j" if first else "i", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        left, right = side(told, "qid", rows, columns, True), side(own, "vec_id", columns, rows, False)

        def cell(asked: pa.Table, there: pa.Table) -> pa.Table:
            out = list(_best_of(_queries_by_width(asked.select(["qid", "query"])), there.select(["vec_id", "embedding"]), top)) if asked.num_rows and there.num_rows else []
            empty = pa.schema([("qid", asked.schema.field("qid").type), ("vec_id", there.schema.field("vec_id").type), ("score", pa.float64())])
            return pa.Table.from_batches(out, schema=None if out else empty)

        scored = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, schema)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top)


def rerank(questions: DataFrame, hits: DataFrame, chunks: DataFrame, top: int = 5) -> DataFrame:
    """(qid, chunk_id, score, rank): distinct tokens shared with the question, plus the score so far."""
    asked = questions.select("qid", F.array_distinct(T.search_tokens(F.col("question"))).alias("asked"))
    own = hits.select("qid", "chunk_id", F.col("score").alias("prior")).join(asked, "qid").join(chunks.select("chunk_id", "text"), "chunk_id")
    scored = own.select("qid", "chunk_id", F.round(F.size(F.array_intersect("asked", F.array_distinct(T.search_tokens(F.col("text"))))) + F.col("prior"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= top)


def contexts(hits: DataFrame, chunks: DataFrame, limit: int = 700) -> DataFrame:
    """(qid, contexts): an array of citation and excerpt by rank."""
    shown = hits.join(chunks.select("chunk_id", "citation", "text"), "chunk_id").select("qid", "rank", F.concat(F.lit("["), "citation", F.lit("]\n"), T.excerpt(F.col("text"), limit)).alias("c"))
    return shown.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"]).alias("contexts"))


def answer_metrics(predictions: DataFrame) -> DataFrame:
    """(system, answer_relevancy, context_precision, context_recall, faithfulness) from token overlaps of (system, answer, ground_truth, contexts)."""
    share = lambda x, y: F.when(F.size(y) > 0, F.size(F.array_intersect(x, y)) / F.size(y)).otherwise(0.0)
    t = predictions.select("system", T.eval_tokens(F.col("answer")).alias("a"), T.eval_tokens(F.col("ground_truth")).alias("g"), T.eval_tokens(F.array_join("contexts", " ")).alias("c"))
    p, r = share(F.col("g"), F.col("a")), share(F.col("a"), F.col("g"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    rows = t.select("system", f1.alias("f1"), share(F.col("g"), F.col("c")).alias("cp"), share(F.col("c"), F.col("g")).alias("cr"), share(F.col("c"), F.col("a")).alias("fa"))
    return rows.groupBy("system").agg(*(F.round(F.avg(c), 6).alias(n) for c, n in (("f1", "answer_relevancy"), ("cp", "context_precision"), ("cr", "context_recall"), ("fa", "faithfulness"))))


def model_rerank(questions: DataFrame, hits: DataFrame, chunks: DataFrame, model: Callable[[list[tuple[str, str]]], list[float]], top: int = 5) -> DataFrame:
    """(qid, chunk_id, score, rank) by a provider's scores of (question, text) pairs, which take the place of the scores so far."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["qid", "chunk_id"]].assign(score=[float(x) for x in model(list(zip(b.question, b.text)))])

    pairs = hits.select("qid", "chunk_id").join(questions.select("qid", "question"), "qid").join(chunks.select("chunk_id", "text"), "chunk_id")
    kinds = f"qid {pairs.schema['qid'].dataType.simpleString()}, chunk_id {pairs.schema['chunk_id'].dataType.simpleString()}, score double"
    scored = pairs.mapInPandas(run, kinds)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= top)


def graph_contexts(parts: dict[str, DataFrame], payloads: DataFrame) -> DataFrame:
    """(qid, answer, contexts) of the graph system: what the graph says, keyword rows, communities, source chunks and citations, in this order."""
    rows = parts["lines"].groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "key", "rank", "line"))), lambda x: x["line"]), "\n").alias("c")).select("qid", F.lit(0).alias("part"), F.lit(0).alias("rank"), "c")
    local = F.concat("name", F.lit(" ["), "label", F.lit("]: "), F.coalesce("description", F.lit("")))
    rows = rows.unionByName(parts["local"].groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", local.alias("l")))), lambda x: x["l"]), "\n").alias("c")).select("qid", F.lit(1).alias("part"), F.lit(0).alias("rank"), "c"))
    if parts["context"] is not None:
        rows = rows.unionByName(parts["context"].select("qid", F.lit(2).alias("part"), "rank", F.col("summary").alias("c")))
    chunks = parts["chunks"].where("trim(coalesce(text, '')) <> ''")
    rows = rows.unionByName(chunks.select("qid", F.lit(3).alias("part"), "rank", F.concat(F.lit("["), F.coalesce("citation", F.lit("Unknown source")), F.lit("]\n"), F.trim("text")).alias("c")))
    cited = parts["citations"].groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "citation"))), lambda x: F.concat(F.lit("- "), x["citation"])), "\n").alias("c"))
    rows = rows.unionByName(cited.select("qid", F.lit(4).alias("part"), F.lit(0).alias("rank"), F.concat(F.lit("Citations:\n"), "c").alias("c")))
    told = rows.where("c <> ''").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "rank", "c"))), lambda x: x["c"]).alias("contexts"))
    return told.select("qid", F.col("contexts")[0].alias("answer"), "contexts")


def run_systems(cases: DataFrame, chunks: DataFrame, graph: DataFrame, top: int = 8, best: int = 5) -> DataFrame:
    """(qid, system, answer, ground_truth, contexts) of three systems for every case (qid, question, ground_truth): lexical, reranked, graph.

    ``graph`` (qid, answer, contexts) is what ``graph_contexts`` gives. The first system is cut to as many texts as the second.
    """
    found = lexical_search(cases, chunks, top)
    told = lambda hits, name: contexts(hits, chunks).select("qid", F.lit(name).alias("system"), F.col("contexts")[0].alias("answer"), "contexts")
    rows = told(found.where(F.col("rank") <= best), "vector_baseline").unionByName(told(rerank(cases, found, chunks, best), "vector_reranked"))
    # a question that the graph says nothing on is a case all the same
    said = cases.select("qid").join(graph, "qid", "left")
    rows = rows.unionByName(said.select("qid", F.lit("graph_rag").alias("system"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts")))
    return cases.select("qid", "ground_truth").join(rows, "qid")


def judged_metrics(predictions: DataFrame, judge: Callable[[pd.DataFrame], list[dict[str, float]] | dict[str, float]] | None = None) -> DataFrame:
    """Metrics by system, and ``kind``: ``judge`` from a provider, ``overlap`` from token overlaps where there is none.

    The provider scores batches of predictions (system, answer, ground_truth, contexts), a dict for each row or one for
    all; means go by system, so no system's predictions meet in one task. A judge that fails does so for its rows alone: a system
    with such rows has the metrics of token overlaps, and says so.
    """
    names = ["answer_relevancy", "context_precision", "context_recall", "faithfulness"]
    plain = answer_metrics(predictions)
    if judge is None:
        return plain.withColumn("kind", F.lit("overlap"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                told = judge(b)
                told = [told] * len(b) if isinstance(told, dict) else told
                rows = [[float(t[n]) for n in names] for t in told]
                if len(rows) != len(b):
                    raise ValueError("a judge gives a score for each row")
            except Exception:  # a provider may fail in any way; the rows say that it did
                rows = [[None] * len(names) for _ in range(len(b))]
            yield pd.DataFrame(rows, columns=names, dtype=float).assign(system=b.system.to_numpy())[["system", *names]]

    scored = predictions.mapInPandas(score, "system string, " + ", ".join(f"{n} double" for n in names))
    failed = F.isnull(names[0]) | F.isnan(names[0])
    by_system = scored.groupBy("system").agg(F.count_if(failed).alias("failed"), *(F.round(F.avg(F.when(~failed, F.col(n))), 6).alias(f"j_{n}") for n in names))
    good = F.col("failed") == 0
    return plain.join(by_system, "system").select("system", *(F.when(good, F.col(f"j_{n}")).otherwise(F.col(n)).alias(n) for n in names), F.when(good, "judge").otherwise("overlap").alias("kind"))
