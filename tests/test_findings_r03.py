"""What the findings of round 3 would have shown."""

import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.operators import graph as G
from quillgraph.operators import linking as L
from quillgraph.operators import lookup as Q
from quillgraph.sources.staging import stage


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ngrams_of_questions_are_never_broadcast(spark):
    asked = spark.createDataFrame([(1, "i feel worthless, and what of panic disorder"), (2, None)], "qid bigint, question string")
    names = spark.createDataFrame([("PANIC DISORDER", "CONDITION")], "name string, label string")
    exact = L.link_exact(asked, names)
    assert "leftHint=(strategy=merge)" in optimized(exact) and [(r.qid, r.name) for r in exact.collect()] == [(1, "PANIC DISORDER")]


def test_phrases_go_to_the_ngrams_of_questions(spark):
    asked = spark.createDataFrame([(1, "what of it"), (2, None)], "qid bigint, question string")
    names = spark.createDataFrame([("FATIGUE", "SYMPTOM")], "name string, label string")
    assert "rightHint=(strategy=broadcast)" in optimized(L.link_aliases(asked, names))


def test_long_rows_are_staged_in_small_groups(spark):
    long = spark.range(400).select("id", F.concat(*[F.sha2(F.concat("id", F.lit(str(i))), 512) for i in range(80)]).alias("text")).coalesce(1)
    folder = stage(long, "long", 1 << 20)._stage_path.removeprefix("file:")
    (file,) = [p for p in __import__("pathlib").Path(folder).glob("*.parquet")]
    assert pq.ParquetFile(file).metadata.num_row_groups > 2


def test_payloads_are_parsed_once(spark):
    rows = [(1, "a", '{"entities": [{"id": "x", "name": "N", "type": "T"}], "relations": [{"source": "x", "target": "x", "relation": "R"}]}'), (2, "b", "{broken"), (3, "c", " ")]
    entities, relations = G.explode_payloads(spark.createDataFrame(rows, "chunk_seq bigint, chunk_id string, payload string"))
    assert [r.id for r in entities.collect()] == ["x"] and [r.relation for r in relations.collect()] == ["R"]
    assert not any("from_json" in optimized(df) for df in (entities, relations))


def test_hays_are_never_broadcast(spark):
    asked = spark.createDataFrame([(1, "steel in red"), (2, None)], "qid bigint, question string")
    parts = spark.createDataFrame([(7, "Red steel bin"), (8, None), (9, "tin")], "community_id bigint, summary string")
    found = Q.summary_search(asked, parts)
    assert "strategy=merge" in optimized(found) and sorted((r.community_id, r.score) for r in found.collect()) == [(7, 2)]
    names = parts.select(F.concat(F.lit("PART "), "community_id").alias("name"), F.lit("PART").alias("label"), F.col("summary").alias("description"))
    for search in (Q.keyword_search, Q.store_text_search):
        found = search(asked, names)
        assert "strategy=merge" in optimized(found) and [(r.name, r.score) for r in found.collect()] == [("PART 7", 2)]


def test_quality_looks_at_a_chunk_once(spark):
    lines = ["Page 12", "page  xiv", "**IV**", "a 1", "one two three", "[Page](of a far page) 3", "<b x y z> 12", "**----- Start of picture text -----**<br>", "**==> picture one two three omitted <==**", "i v x", "-- page -- 9 --", "", "  ", "| a | b |", "- item one two"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "id int, text string")
    got = {r.id: r.c for r in df.select("id", P.clean_chunk(F.col("text")).alias("c")).collect()}

    def kept(line):
        head = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", line)
        head = re.sub("[^a-z0-9]+", " ", re.sub(r"[*_`~]+", "", re.sub(r"<[^>]+>", " ", head)).lower()).strip()
        return not line.strip() or not ("picture" in line or re.match(r"^(?:page\s+)?(?:\d+|[ivxlcdm]+|[a-z]?\d+)$", head))

    assert got == {1: re.sub("\n{3,}", "\n\n", "\n".join(x if x.strip() else "" for x in lines if kept(x))).strip(), 2: ""}
    assert "contains(lower(" not in optimized(df.select(P.chunk_quality(F.col("text"), F.lit("")).alias("q"))).lower()
