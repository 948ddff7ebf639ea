"""Markdown sections: split at headers, header paths, section windows, filters and rebuilding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import text as T


def split_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, idx, level, header, header_path, content): one row per header outside fenced code, a preamble before the first.

    header_path joins the parents' headers by "/" and is "/" at the top. A text without headers is one ``__document__``.
    """
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    # a header within a fence is shielded while splitting
    shielded = F.array_join(F.transform(F.split(plain, "(?m)^```"), lambda part, i: F.when(i % 2 == 1, F.regexp_replace(part, "(?m)^#", "\u0001#")).otherwise(part)), "```")
    parts = docs.select("doc_id", F.posexplode(F.split(shielded, r"(?m)(?=^#{1,6}[ \t]+\S)")).alias("pos", "part"))
    marks = F.regexp_extract("part", r"^(#{1,6})[ \t]+(.+?)[ \t]*(?:\n|$)", 1)
    level = F.length(marks)
    header = F.regexp_extract("part", r"^(#{1,6})[ \t]+(.+?)[ \t]*(?:\n|$)", 2)
    body = F.when(level > 0, F.regexp_replace("part", r"^#{1,6}[ \t]+.+?[ \t]*(?:\n|$)", "")).otherwise(F.col("part"))
    content = F.regexp_replace(F.replace(body, F.lit("\u0001#"), F.lit("#")), r"^\s+|\s+$", "")
    rows = parts.select("doc_id", "pos", level.alias("level"), header.alias("header"), content.alias("content")).where("level > 0 or content <> ''")
    whole = Window.partitionBy("doc_id")
    order = whole.orderBy("pos")
    rows = rows.withColumn("any", F.max("level").over(whole)).withColumn("header", F.when(F.col("level") > 0, F.col("header")).when(F.col("any") > 0, "__preamble__").otherwise("__document__"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # the parent at each level is the last header there, unless a higher one came after it
    for k in range(1, 6):
        last = F.last(F.when(F.col("level") == k, F.struct("pos", "header")), ignorenulls=True).over(before)
        higher = F.last(F.when((F.col("level") < k) & (F.col("level") > 0), F.col("pos")), ignorenulls=True).over(before)
        rows = rows.withColumn(f"p{k}", F.when((F.col("level") > k) & (last["pos"] > F.coalesce(higher, F.lit(-1))), last["header"]))
    path = F.concat(F.lit("/"), F.concat_ws("/", *(f"p{k}" for k in range(1, 6))))
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("idx"), "level", "header", path.alias("header_path"), "content")


def filter_sections(sections: DataFrame, restrict: bool = True) -> DataFrame:
    """Sections with ``keep`` and ``discard_reason``: outside the window of section II, or with a header that goes."""
    n = T.normalize_header(F.col("header"))
    whole = Window.partitionBy("doc_id")
    marked = sections.withColumn("n", n)
    exact, named = F.min(F.when(F.col("n") == "section ii", F.col("idx"))).over(whole), F.min(F.when(F.col("n") == "section ii diagnostic criteria and codes", F.col("idx"))).over(whole)
    marked = marked.withColumn("exact", exact).withColumn("first", F.coalesce(exact, named))
    plain = F.min(F.when((F.col("n") == "section iii") & (F.col("idx") > F.col("exact")), F.col("idx"))).over(whole)
    loose = F.min(F.when(P.contains_any(F.col("n"), ["section iii", "emerging measures and models"]) & (F.col("idx") > F.col("first")), F.col("idx"))).over(whole)
    marked = marked.withColumn("end", F.coalesce(plain, loose))
    outside = F.when(F.lit(restrict) & (F.col("idx") < F.col("first")), "outside_section_ii_before_start").when(F.lit(restrict) & (F.col("idx") >= F.col("end")), "outside_section_ii_after_end")
    reason = F.coalesce(outside, P.discard_reason(F.col("header")))
    return marked.select(*sections.columns, reason.isNull().alias("keep"), reason.alias("discard_reason"))


def rebuild(sections: DataFrame) -> DataFrame:
    """(doc_id, markdown) of the kept sections in order."""
    head = F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "header"))
    part = F.concat_ws("\n\n", head, F.when(F.trim("content") != "", F.col("content")))
    joined = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("idx", part.alias("p")))), lambda x: x["p"]), lambda p: F.trim(p) != ""), "\n\n")
    return sections.where("keep").groupBy("doc_id").agg(F.concat(joined, F.lit("\n")).alias("markdown"))


def filter_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (text, header_path, ...) with quality, keep and reason."""
    out = chunks.withColumn("quality", P.chunk_quality(F.col("text"), F.col("header_path"))).withColumn("reason", P.keep_reason(F.col("quality")))
    return out.withColumn("keep", F.col("reason") == "ok")


def enrich(chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_id, text, source_label, header_path) with section title, citation and a context line before the text.

    The context is the deterministic one; a provider's answers can be joined on (source_label, section_title) instead.
    """
    title = F.when(F.coalesce("header_path", F.lit("/")) == "/", T.section_title(F.col("text"))).otherwise(T.section_label(F.col("header_path")))
    out = chunks.withColumn("original_text", T.strip_context(F.col("text"))).withColumn("section_title", title)
    ended = lambda tag: F.when(tag.rlike("[.!?]$"), tag).otherwise(F.concat(tag, F.lit(".")))
    out = out.withColumn("context_tag", T.let(T.fallback_context(F.col("source_label"), F.col("section_title")), ended))
    return out.withColumn("citation", T.citation_label(F.col("source_label"), F.col("section_title"))).withColumn("text", F.concat(F.lit("[CONTEXT: "), "context_tag", F.lit("]\n\n"), "original_text"))


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (id, grp, ord, ...) without empty ids, of equal ids the first in order of group and place: one combined row a task and id."""
    rest = [c for c in nodes.columns if c != "id"]
    kept = nodes.where("trim(coalesce(id, '')) <> ''").groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("grp", "ord")).alias("n"))
    return kept.select(*(F.col("id") if c == "id" else F.col(f"n.{c}") for c in nodes.columns))


def section_summary(sections: DataFrame) -> DataFrame:
    """(discard_reason, n, chars) of sections that ``filter_sections`` judged; ``kept`` for those that stay."""
    reason = F.split(F.coalesce("discard_reason", F.lit("kept")), ":")[0].alias("discard_reason")
    return sections.groupBy(reason).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
