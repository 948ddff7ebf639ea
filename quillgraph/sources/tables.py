"""Sources and sinks: registries, manifests, Markdown folders, pages, graph checkpoints, evaluation files."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.sources import fingerprints as D

SOURCE = "id string, authority string, condition string, source_title string, format string, url string"


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a JSON file, ``{"sources": [...]}`` or a bare list, with their order; ValueError if there are none."""
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<sources:array<struct<{', '.join(c.replace(' ', ':') for c in SOURCE.split(', ')).replace(', ', ',')}>>>")["sources"]
    bare = F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':') for c in SOURCE.split(', ')).replace(', ', ',')}>>")
    listed = F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)
    out = raw.select(F.posexplode(listed).alias("ord", "s")).select("ord", "s.*")
    if out.isEmpty():
        raise ValueError("the registry lists no sources")
    return out


def filter_sources(sources: DataFrame, authorities: list[str] | None = None, conditions: list[str] | None = None, limit: int | None = None) -> DataFrame:
    for column, wanted in (("authority", authorities), ("condition", conditions)):
        if wanted:
            sources = sources.where(F.lower(column).isin([w.lower() for w in wanted]))
    return sources.orderBy("ord").limit(limit) if limit else sources


def output_name() -> Column:
    """``authority__condition__id.md`` in slugs, with the id, title or "source" at the end."""
    last = F.coalesce(*(F.nullif(T.slug(F.col(c)), F.lit("")) for c in ("id", "source_title")), F.lit("source"))
    return F.concat(F.concat_ws("__", F.nullif(T.slug(F.col("authority")), F.lit("")), F.nullif(T.slug(F.col("condition")), F.lit("")), last), F.lit(".md"))


def with_status(sources: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Each source's output and status: ``skipped_existing`` where ``existing`` (output) has it, else ``pending``."""
    named = sources.withColumn("output", output_name())
    there = existing.select("output").distinct().withColumn("there", F.lit(True))
    return named.join(there, "output", "left").withColumn("status", F.when(F.col("there") & F.lit(not force), "skipped_existing").otherwise("pending")).drop("there")


def write_manifest(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def output_paths(files: DataFrame) -> DataFrame:
    """(path, output): segments of each relative path made safe and joined; of equal names all but the first get a hash."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"(?i)\.pdf$", ""), r"[/\\]+", "__"), r"[^A-Za-z0-9._\-]+", "_")
    named = files.select("path").distinct().withColumn("stem", safe)
    n = F.row_number().over(Window.partitionBy("stem").orderBy("path"))
    return named.select("path", F.concat("stem", F.when(n > 1, F.concat(F.lit("--"), F.substring(F.sha1("path"), 1, 8))).otherwise(""), F.lit(".md")).alias("output"))


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc, markdown) of (doc, page, markdown): pages stripped, empty ones dropped, blank lines between."""
    kept = pages.select("doc", "page", F.regexp_replace("markdown", r"^\s+|\s+$", "").alias("m")).where("m <> ''")
    return kept.groupBy("doc").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "m"))), lambda x: x["m"]), "\n\n"), F.lit("\n")).alias("markdown"))


def convert_binaries(files: DataFrame, convert: Callable[[bytes], str]) -> DataFrame:
    """(path, markdown, error) of binaryFile rows (path, content) by a provider; a failure is a row's error, not the job's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content):
                try:
                    rows.append((path, convert(bytes(content)), None))
                except Exception as e:  # a provider may fail in any way; the row says how
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, markdown string, error string")


def read_markdown(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(file_path, file_name, text, size) of the folder's Markdown files."""
    raw = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower()).text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"))


def source_state(files: DataFrame) -> DataFrame:
    """One fingerprint of names, sizes and texts, whatever the order of rows."""
    return D.root(D.digest_tree(D.named_digests(files, "file_name", "size", "text")), "state")


def nodes_hash(chunks: DataFrame) -> DataFrame:
    """One fingerprint that depends on the order of chunks (chunk_seq, text), and on id, file, header path and section where there are such columns."""
    return D.root(D.digest_tree(D.chunk_digests(chunks)), "nodes_hash")


def attach_metadata(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks with the manifest's columns: the entry of their path, else of their file name; the first of several entries holds."""
    keyed = manifest.withColumn("keys", F.array_distinct(F.array(F.lower("output_markdown"), F.lower(T.basename(F.col("output_markdown")))))).select("*", F.explode("keys").alias("key")).drop("keys")
    first = keyed.groupBy("key").agg(F.min_by(F.struct(*[c for c in manifest.columns]), "ord").alias("m"))
    keys = F.array_distinct(F.array(F.lower("file_path"), F.lower(T.basename(F.col("file_name"))), F.lower(T.basename(F.col("file_path")))))
    cand = chunks.select("chunk_id", F.posexplode(keys).alias("pref", "key")).join(first, "key").groupBy("chunk_id").agg(F.min_by("m", "pref").alias("m"))
    return chunks.join(cand, "chunk_id", "left").select(chunks["*"], *(F.col(f"m.{c}").alias(f"source_{c}") for c in manifest.columns))


class _Text(HTMLParser):
    """Main content as Markdown: headings, list items and paragraphs; scripts, styles, navigation and advertisements go."""

    SKIP = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}
    VOID = {"br", "img", "meta", "link", "input", "hr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.stack = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            if tag == "br":
                self.out.append("\n")
            return
        bad = tag in self.SKIP or any(k in ("class", "id") and v and {"ad", "ads", "advert", "banner"} & set(v.lower().split()) for k, v in attrs)
        self.stack.append((tag, bad))
        self.skip += bad
        if not self.skip:
            self.out.append("\n\n" + "#" * int(tag[1]) + " " if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else "\n- " if tag == "li" else "\n\n" if tag in ("p", "div", "article", "section", "main", "ul", "ol", "table", "tr", "title") else "")

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, bad = self.stack.pop()
                self.skip -= bad
                if t == tag:
                    break
            if not self.skip:
                self.out.append("\n\n" if tag in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "title") else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, markdown) of raw pages; null html is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for html in b.html:
                parser = _Text()
                parser.feed(html or "")
                out.append(re.sub(r"\n\s*\n\s*", "\n\n", re.sub(r"[ \t]+", " ", "".join(parser.out))).strip())
            yield pd.DataFrame({"page_id": b.page_id, "markdown": out})

    return pages.select("page_id", "html").mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, markdown string")


GRAPH_TABLES = ("entities", "relations", "chunk_payloads")


def save_graph(tables: dict[str, DataFrame], path: str, meta: dict | None = None) -> None:
    """One Parquet folder per table, relations partitioned by relation, and a table of meta values with the lineage."""
    names = tables["relations"].select("relation").distinct().where(~F.col("relation").rlike("^[A-Z][A-Z0-9_]*$"))
    if not names.isEmpty():
        raise ValueError("a relation's name is not of the form A-Z, 0-9, _")
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("relation") if name == "relations" else writer).parquet(f"{path}/{name}")
    told = {"version": 1, "written": datetime.now(timezone.utc).isoformat(), **(meta or {})}
    spark = tables["relations"].sparkSession
    spark.createDataFrame([(k, json.dumps(v)) for k, v in told.items()], "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/build_meta")


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a saved graph, gaps filled: no label is UNKNOWN, no strength is 5, sources sorted and distinct."""
    sources = F.array_sort(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>")))).alias("sources")
    e, r = spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations")
    filled = F.when(F.coalesce("strength", F.lit(0)) == 0, 5).otherwise(F.col("strength")).alias("strength")
    return {
        "entities": e.select("name", F.coalesce("label", F.lit("UNKNOWN")).alias("label"), F.coalesce("description", F.lit("")).alias("description"), sources, "ord"),
        "relations": r.select("subject", "relation", "target", F.coalesce("description", F.lit("")).alias("description"), filled, sources, "ord"),
        "chunk_payloads": spark.read.parquet(f"{path}/chunk_payloads"),
    }


def graph_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, key, n): entities by label and relations by name."""
    a = entities.groupBy(F.col("label").alias("key")).agg(F.count("*").alias("n")).select(F.lit("entity").alias("kind"), "key", "n")
    return a.unionByName(relations.groupBy(F.col("relation").alias("key")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("kind"), "key", "n"))


def unprocessed(chunks: DataFrame, done: DataFrame, **guard: str) -> DataFrame:
    """Chunks that an earlier run (chunk_id and the columns of ``guard``) has not done; a run counts only if version, nodes_hash, model and the like all agree."""
    for column, wanted in guard.items():
        done = done.where(F.col(column) == wanted)
    return chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")


def append_progress(rows: DataFrame, path: str) -> None:
    """What a run has done, as further JSON lines."""
    rows.write.mode("append").json(path)


def save_communities(members: DataFrame, summaries: DataFrame, path: str) -> None:
    members.write.mode("overwrite").parquet(f"{path}/communities")
    summaries.write.mode("overwrite").parquet(f"{path}/community_summaries")


def load_or_build_communities(spark: SparkSession, path: str, build: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(members, summaries) as saved; built and saved where there are none. Rows whose id is no number are passed over."""
    try:
        members = spark.read.parquet(f"{path}/communities").where(F.expr("try_cast(community_id as bigint)").isNotNull())
        if not members.isEmpty():
            return members, spark.read.parquet(f"{path}/community_summaries")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    save_communities(*build(), path)
    return spark.read.parquet(f"{path}/communities"), spark.read.parquet(f"{path}/community_summaries")


def with_retries(call: Callable[[], object], tries: int = 4, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; after an error it is made again, each time after twice the wait, and the last error is raised."""
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n == tries - 1:
                raise
            sleep(wait * 2**n)


def manifest_fingerprint(files: DataFrame) -> DataFrame:
    """One fingerprint of files (path, size, modified), whatever the order of rows."""
    return D.root(D.digest_tree(D.named_digests(files, "path", "size", "modified")), "fingerprint")


def discover_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, size, modified) of the files below a folder, each once."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).distinct()


def manifest_entries(sources: DataFrame, converted: DataFrame) -> DataFrame:
    """Entries of sources (with output and status) after conversion (output, markdown, error): ``converted`` or ``failed`` where tried, else the status so far."""
    told = converted.select("output", F.length("markdown").alias("markdown_char_count"), "error")
    done = sources.join(told, "output", "left")
    status = F.when(F.col("status") == "skipped_existing", F.col("status")).when(F.col("error").isNotNull(), "failed").when(F.col("markdown_char_count") > 0, "converted").when(F.col("markdown_char_count") == 0, "failed").otherwise(F.col("status"))
    return done.withColumn("status", status).withColumn("error", F.when((F.col("markdown_char_count") == 0) & F.col("error").isNull(), "empty").otherwise(F.col("error")))


def require_same_nodes(graph_hash: str, chunks_hash: str) -> None:
    """ValueError unless a graph was built from these chunks."""
    if graph_hash != chunks_hash:
        raise ValueError("the graph was built from other chunks: their hashes differ")


def save_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(path)


def summary_markdown(metrics: DataFrame) -> DataFrame:
    """(markdown): a table of the metrics by system, to four places."""
    names = [c for c in metrics.columns if c != "system"]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "system", *(F.format_string("%.4f", F.col(c)) for c in names)), F.lit(" |"))
    head = f"| system | {' | '.join(names)} |\n|{'-|' * (len(names) + 1)}\n"
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("system", line.alias("line")))), lambda x: x["line"]), "\n")  # a row for each system
    return metrics.agg(F.concat(F.lit(head), rows, F.lit("\n")).alias("markdown"))


def load_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """(question, ground_truth) of JSON lines; ValueError if there are none."""
    out = spark.read.schema("question string, ground_truth string").json(path).where("question is not null")
    if out.isEmpty():
        raise ValueError("no evaluation cases")
    return out
