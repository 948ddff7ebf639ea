"""Graph lookups for whole sets of questions at once: ``asks`` (qid, name) name the entities that questions ask about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import config as C
from quillgraph.functions import text as T
from quillgraph.sources.staging import spread, stage, tasks

#: Hays of a task, each with dozens of letter runs and hits of many questions.
HAYS = 10_000


def _ranked(rows: DataFrame, by: list[str], order: list[Column], most: int | None = None) -> DataFrame:
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where(F.col("rank") <= most) if most else out


def forward_lookup(asks: DataFrame, entities: DataFrame, relations: DataFrame, only: list[str] | None = None, drop_low_signal: bool = True) -> DataFrame:
    """(qid, name, relation, neighbor, label, description, strength, sources, rank): one hop out, ranked within each relation."""
    rel = relations.where(F.col("relation").isin(sorted({r.upper() for r in only}))) if only else relations
    ends = entities.select(F.col("name").alias("neighbor"), "label")
    out = asks.join(rel.select(F.col("subject").alias("name"), "relation", F.col("target").alias("neighbor"), "description", "strength", "sources"), "name").join(ends, "neighbor")
    if drop_low_signal:
        out = out.where(~T.is_low_signal(F.col("neighbor"), F.col("label")))
    return _ranked(out, ["qid", "name", "relation"], [F.desc("strength"), F.col("neighbor")]).select("qid", "name", "relation", "neighbor", "label", "description", "strength", "sources", "rank")


def neighbors(asks: DataFrame, entities: DataFrame, relations: DataFrame, only: list[str] | None = None) -> DataFrame:
    """One hop in both directions, with the direction."""
    turned = relations.select(F.col("target").alias("subject"), "relation", F.col("subject").alias("target"), "description", "strength", "sources")
    out = forward_lookup(asks, entities, relations, only, False).withColumn("direction", F.lit("outgoing"))
    return out.unionByName(forward_lookup(asks, entities, turned, only, False).withColumn("direction", F.lit("incoming")))


def reverse_lookup(asks: DataFrame, entities: DataFrame, relations: DataFrame, relation: str = "HAS_SYMPTOM", label: str = "CONDITION") -> DataFrame:
    """(qid, name, matches, n_matches, rank): subjects of ``label`` by how many of the asked entities they lead to."""
    heads = entities.where(F.col("label") == label).select(F.col("name").alias("subject"))
    hit = asks.distinct().join(relations.where(F.col("relation") == relation).select("subject", F.col("target").alias("name")), "name").join(heads, "subject", "left_semi")
    grouped = hit.groupBy("qid", F.col("subject").alias("found")).agg(F.array_sort(F.collect_set("name")).alias("matches")).withColumn("n_matches", F.size("matches"))
    return _ranked(grouped, ["qid"], [F.desc("n_matches"), F.col("found")]).select("qid", F.col("found").alias("name"), "matches", "n_matches", "rank")


def compare(asks: DataFrame, relations: DataFrame, both_ways: bool = True) -> DataFrame:
    """(qid, relation, neighbor, kind, name): neighbors that all asked entities share, and those that only one has, by relation."""
    links = relations.select(F.col("subject").alias("name"), "relation", F.col("target").alias("neighbor"))
    if both_ways:
        links = links.union(relations.select("target", F.concat(F.lit("<-"), "relation"), "subject"))
    n = asks.groupBy("qid").agg(F.countDistinct("name").alias("n"))
    held = asks.distinct().join(links, "name").groupBy("qid", "relation", "neighbor").agg(F.array_sort(F.collect_set("name")).alias("names")).join(n, "qid")
    kind = F.when(F.size("names") == F.col("n"), "shared").when(F.size("names") == 1, "unique")
    return held.withColumn("kind", kind).where("kind is not null").select("qid", "relation", "neighbor", "kind", F.when(F.col("kind") == "unique", F.col("names")[0]).alias("name"))


def compare_any_relation(asks: DataFrame, relations: DataFrame) -> DataFrame:
    """The other dialect: outgoing only; unique means that no other asked entity has the neighbor by any relation."""
    links = relations.select(F.col("subject").alias("name"), "relation", F.col("target").alias("neighbor"))
    mine = asks.distinct().join(links, "name")
    n = asks.groupBy("qid").agg(F.countDistinct("name").alias("n"))
    shared = mine.groupBy("qid", "relation", "neighbor").agg(F.countDistinct("name").alias("c")).join(n, "qid").where("c = n").select("qid", "relation", "neighbor", F.lit("shared").alias("kind"), F.lit(None).cast("string").alias("name"))
    holders = mine.groupBy("qid", "neighbor").agg(F.countDistinct("name").alias("holders"))
    unique = mine.join(holders.where("holders = 1"), ["qid", "neighbor"]).join(n.where("n > 1"), "qid").select("qid", "relation", "neighbor", F.lit("unique").alias("kind"), "name")
    return shared.unionByName(unique)


def _grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct runs of so many letters of a text."""

    def of(letters: Column) -> Column:
        def runs(n: int) -> Column:
            each = F.transform(F.sequence(F.lit(1), F.size(letters) - (n - 1)), lambda i: F.array_join(F.slice(letters, i, n), ""))
            return F.when(F.size(letters) >= n, each).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.concat(*(runs(n) for n in sizes)))

    return T.let(F.split(text, ""), of)


def substring_hits(terms: DataFrame, hays: DataFrame, ids: list[str], shortest: int = 1) -> DataFrame:
    """(term, ``ids``): the hays (ids, hay) that hold a term, for distinct ``terms`` (term) of at least ``shortest`` letters.

    An index of letter runs: a term of three letters or more meets hays by its rarest trigram and is looked for in those
    alone; a shorter term is a run itself, so there the index is the answer. Only runs that terms ask for are kept of
    the index; how often each stands is counted before anything is joined by it.
    """
    sizes = tuple(n for n in (1, 2, 3) if n >= min(shortest, 3))
    terms = stage(terms.select("term").where(F.length("term") >= shortest).distinct(), "terms")
    own = F.when(F.length("term") < 3, F.array("term")).otherwise(_grams(F.col("term"), (3,)))
    asked = stage(terms.select("term", F.explode(own).alias("run")), "term_runs")
    index = stage(spread(hays, HAYS).select(*ids, F.explode(_grams(F.col("hay"), sizes)).alias("run")).join(asked.select("run").distinct(), "run", "left_semi"), "run_index")
    often = index.groupBy("run").agg(F.count("*").alias("often"))
    # a run that no hay holds leaves its term without a hit
    rarest = stage(asked.join(often, "run", "left").groupBy("term").agg(F.min_by("run", F.struct(F.coalesce("often", F.lit(0)).alias("n"), "run")).alias("run")), "rarest_runs")
    # staged, hays look far smaller than they are in memory: they are never broadcast
    hays = hays.hint("merge")
    met = index.join(rarest, "run").select("term", *ids)
    short = met.where(F.length("term") < 3)
    if shortest < 3:
        return short.unionByName(met.where(F.length("term") >= 3).join(hays, ids).where(F.col("hay").contains(F.col("term"))).select("term", *ids))
    return met.join(hays, ids).where(F.col("hay").contains(F.col("term"))).select("term", *ids)


def _scored(asked: DataFrame, hays: DataFrame, ids: list[str], shortest: int = 1) -> DataFrame:
    """(qid, ``ids``, score): how many of a question's terms (qid, term) hit; each term is looked for once, whoever asks it.

    Hits are dealt by hay before they meet the questions that ask, so that pairs of both are counted where they arise.
    """
    hits = substring_hits(asked, hays, ids, shortest).repartition(tasks(hays, HAYS), *ids)
    return asked.join(hits, "term").groupBy("qid", *ids).agg(F.count("*").alias("score"))


def keyword_search(questions: DataFrame, entities: DataFrame, top: int = 10) -> DataFrame:
    """(qid, name, label, score, rank): by how many of the question's terms are substrings of name and description."""
    terms = F.array_distinct(F.filter(T.tokens(F.col("question")), lambda t: (F.length(t) > 2) & ~t.isin(C.QUERY_STOPWORDS)))
    asked = stage(questions.select("qid", F.explode(terms).alias("term")), "asked_terms")
    hays = stage(entities.select("name", F.lower(F.concat_ws(" ", "name", F.coalesce("description", F.lit("")))).alias("hay")), "hays")
    hits = _ranked(_scored(asked, hays, ["name"], 3), ["qid"], [F.desc("score"), F.col("name")], top)
    return hits.join(entities.select("name", "label").hint("merge"), "name").select("qid", "name", "label", "score", "rank")


def summary_search(questions: DataFrame, summaries: DataFrame, top: int = 3) -> DataFrame:
    """(qid, community_id, score, rank): community summaries by substring terms, of any length, without stop words."""
    terms = F.array_distinct(F.filter(T.tokens(F.col("question")), lambda t: ~t.isin(C.QUERY_STOPWORDS)))
    asked = stage(questions.select("qid", F.explode(terms).alias("term")), "asked_terms")
    hays = stage(summaries.select("community_id", F.lower("summary").alias("hay")), "hays")
    hits = _scored(asked, hays, ["community_id"])
    return _ranked(hits, ["qid"], [F.desc("score"), F.col("community_id")], top)


def citations(results: DataFrame, payloads: DataFrame, top: int = 12) -> DataFrame:
    """(qid, citation, rank): distinct citations of the results' sources, in order; unknown chunks by their id."""
    ids = results.select("qid", F.explode("sources").alias("chunk_id")).distinct()
    named = ids.join(payloads.select("chunk_id", "citation"), "chunk_id", "left").select("qid", F.coalesce("citation", "chunk_id").alias("citation")).distinct()
    return _ranked(named, ["qid"], [F.col("citation")], top)


def source_chunks(results: DataFrame, payloads: DataFrame, top: int = 6) -> DataFrame:
    """(qid, chunk_id, citation, text, rank): payloads of the sources, one for each citation and text."""
    ids = results.select("qid", F.explode("sources").alias("chunk_id")).distinct()
    found = ids.join(payloads.select("chunk_id", "citation", "text"), "chunk_id")
    one = _ranked(found, ["qid", "citation", "text"], [F.col("chunk_id")], 1).drop("rank")
    return _ranked(one, ["qid"], [F.col("citation"), F.col("chunk_id")], top)


def display_filter(results: DataFrame) -> DataFrame:
    """Per question and relation: weak symptoms go; statements and comorbid targets are sifted where something stays."""
    w = Window.partitionBy("qid", "relation")
    low = F.lower(F.coalesce("description", F.lit("")))
    together = low.contains("co-occur") | low.contains("comorbid")
    wanted = F.when(F.col("relation") == "HAS_PREVALENCE", F.col("label") == "PREVALENCE_STATEMENT").when(F.col("relation") == "DIFFERENTIAL_DIAGNOSIS", ~together).otherwise(F.lit(True))
    marked = results.where(~((F.col("relation") == "HAS_SYMPTOM") & F.col("neighbor").isin(C.LOW_SIGNAL_SYMPTOMS))).withColumn("wanted", wanted)
    return marked.withColumn("some", F.max("wanted").over(w)).where("wanted or not some").drop("wanted", "some")


def relation_lines(results: DataFrame, part: int, most: int = 10, titled: bool = False) -> DataFrame:
    """(qid, part, key, rank, line): ranked lines of each relation under its name, which is told if there are several or ``titled``."""
    shown = results.where(F.col("rank") <= most)
    lines = shown.select("qid", F.col("relation").alias("key"), "rank", T.relation_line(F.col("relation"), F.col("neighbor"), F.col("description"), F.col("strength")).alias("line"))
    heads = shown.select("qid", F.col("relation").alias("key")).distinct()
    if not titled:
        several = heads.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1").select("qid")
        heads = heads.join(several, "qid", "left_semi")
    heads = heads.select("qid", "key", F.lit(0).alias("rank"), F.concat("key", F.lit(":")).alias("line"))
    return lines.unionByName(heads).withColumn("part", F.lit(part))


def joined_lines(lines: DataFrame, out: str) -> DataFrame:
    """(qid, ``out``): lines in order of part, key and rank."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "key", "rank", "line")))
    return lines.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(out))


def result_filter(results: DataFrame) -> DataFrame:
    """Lookup results of a store without low-signal neighbours, ranked anew within each relation."""
    kept = results.where(~T.is_low_signal(F.col("neighbor"), F.col("label"))).drop("rank")
    return _ranked(kept, ["qid", "name", "relation"], [F.desc("strength"), F.col("neighbor")])


def store_text_search(questions: DataFrame, entities: DataFrame, top: int = 10) -> DataFrame:
    """(qid, name, label, score, rank): the store's way without a full-text index, by terms of its own list that name or description hold."""
    asked = stage(questions.select("qid", F.explode(T.keyword_tokens(F.col("question"))).alias("term")), "asked_terms")
    # a term has only letters and digits, so none reaches from the name over the line's end into the description
    hays = stage(entities.select("name", F.lower(F.concat_ws("\n", "name", F.coalesce("description", F.lit("")))).alias("hay")), "hays")
    hits = _ranked(_scored(asked, hays, ["name"], 3), ["qid"], [F.desc("score"), F.col("name")], top)
    return hits.join(entities.select("name", "label").hint("merge"), "name").select("qid", "name", "label", "score", "rank")
