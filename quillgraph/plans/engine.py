"""The service surface: build a graph, keep it, ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import config as C
from quillgraph.operators import graph as G
from quillgraph.operators import communities as CM
from quillgraph.operators.sections import enrich, filter_chunks, split_sections
from quillgraph.plans.router import answer_questions
from quillgraph.sources import tables as S
from quillgraph.sources.staging import stage
from quillgraph.streaming.sessions import session_context


def build(documents: DataFrame, extract: Callable[[DataFrame], DataFrame], ontology: C.Ontology = C.CLINICAL, keep_all: bool = False) -> dict[str, DataFrame]:
    """Tables of a graph from Markdown (doc_id, text, source_label): sections, quality, context, extraction, fold, cleaning.

    ``extract`` is the provider: chunks (chunk_seq, chunk_id, text) to payloads (chunk_seq, chunk_id, payload).
    """
    parts = split_sections(documents).join(documents.select("doc_id", "source_label"), "doc_id")
    head = F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "header"))
    chunks = filter_chunks(parts.withColumn("text", F.concat_ws("\n\n", head, "content")).drop("content"))
    chunks = chunks if keep_all else chunks.where("keep")
    chunks = stage(enrich(chunks.select((F.shiftleft(F.col("doc_id").cast("bigint"), 31) + F.col("idx")).alias("chunk_seq"), F.concat_ws("-", "doc_id", "idx").alias("chunk_id"), "text", "source_label", "header_path")))
    entities, relations = G.explode_payloads(extract(chunks.select("chunk_seq", "chunk_id", "text")))
    named = stage(G.named_entities(entities))
    e, r = G.clean_graph(G.numbered_order(G.fold_entities(named, ontology)), G.numbered_order(G.fold_relations(named, relations, ontology)), ontology)
    return {"entities": e, "relations": r, "chunk_payloads": chunks.select("chunk_id", "citation", "text", "section_title", "context_tag", "source_label", "header_path")}


class Engine:
    """A saved graph and the questions one can put to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.tables, self._summaries = path, S.load_graph(spark, path), None

    def health(self) -> DataFrame:
        return G.structural_checks(self.tables["entities"], self.tables["relations"])

    def meta(self) -> DataFrame:
        return S.graph_stats(self.tables["entities"], self.tables["relations"])

    def safety_resources(self) -> list[tuple[str, str, str]]:
        return list(C.CRISIS_RESOURCES)

    def summaries(self) -> DataFrame:
        """Summaries of the graph's communities, found when first asked for."""
        if self._summaries is None:
            e, r = self.tables["entities"], self.tables["relations"]
            self._summaries = stage(CM.summaries(CM.communities(r), e, r), "summaries")
        return self._summaries

    def query(self, questions: DataFrame) -> DataFrame:
        """Answers to (qid, question) and, if given, analysis: the question with what was said before."""
        return answer_questions(questions, self.tables["entities"], self.tables["relations"], self.tables["chunk_payloads"], self.summaries())

    def converse(self, questions: DataFrame) -> DataFrame:
        """Answers to (session_id, turn, question); what the six questions before it name counts too, but a crisis in the question at hand always wins.

        qid is session_id * 1000000 + turn.
        """
        told = session_context(questions).select((F.col("session_id") * 1_000_000 + F.col("turn")).alias("qid"), "question", F.col("analysis_text").alias("analysis"))
        return self.query(told)
