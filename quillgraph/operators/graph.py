"""Graph construction as folds over DataFrames: entities (name, label, description, sources, ord) and relations
(subject, relation, target, description, strength, sources, ord). Order is explicit, so no result depends on partitions."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import CLINICAL, Ontology
from quillgraph.functions import text as T
from quillgraph.sources.staging import LONG_ROWS, stage

#: Repair targets, or curated facts, that one pass may have; they go to every task.
MOST_TARGETS = 10_000
#: Chunks that are looked through before their hits leave.
AT_A_TIME = 64
PAYLOAD = "struct<entities:array<struct<id:string,name:string,type:string,description:string>>,relations:array<struct<source:string,target:string,relation:string,description:string,strength:string>>>"


def triples(df: DataFrame, ontology: Ontology) -> DataFrame:
    """The legal triples, a table as small as the ontology."""
    return df.sparkSession.createDataFrame(ontology.triples, "s_label string, relation string, t_label string")


def _union_sources(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias("sources")


def parsed_payloads(chunks: DataFrame, payload: str = "payload") -> DataFrame:
    """(chunk_seq, chunk_id, p, blank) of chunks (chunk_seq, chunk_id, payload JSON), each parsed once for all that is asked of it; ``p`` is null where a payload does not parse."""
    blank = F.trim(F.coalesce(F.col(payload), F.lit(""))) == ""
    return stage(chunks.select("chunk_seq", "chunk_id", T.json_payload(F.col(payload), PAYLOAD).alias("p"), blank.alias("blank")), "parsed", LONG_ROWS)


def explode_payloads(chunks: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(raw entities, raw relations) of chunks (chunk_seq, chunk_id, payload JSON), one row per element with its position."""
    return exploded(parsed_payloads(chunks, payload))


def exploded(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw entities, raw relations) of parsed payloads."""
    entities = parsed.select("chunk_seq", "chunk_id", F.posexplode("p.entities").alias("pos", "e")).select("chunk_seq", "chunk_id", "pos", "e.*").withColumnRenamed("type", "kind")
    relations = parsed.select("chunk_seq", "chunk_id", F.posexplode("p.relations").alias("pos", "r")).select("chunk_seq", "chunk_id", "pos", "r.*")
    return entities, relations


def named_entities(raw: DataFrame) -> DataFrame:
    """Raw entities with their derived name; rows without id, name or type go."""
    filled = raw.where("trim(coalesce(id, '')) <> '' and trim(coalesce(name, '')) <> '' and trim(coalesce(kind, '')) <> ''").withColumn("kind", F.upper(F.trim("kind")))
    return filled.withColumn("canon", T.derived_name(F.col("name"), F.col("kind"), F.col("description"))).withColumn("description", F.trim(F.coalesce("description", F.lit(""))))


def fold_entities(named: DataFrame, ontology: Ontology = CLINICAL) -> DataFrame:
    """One row per name: label of the highest priority, the longest description (the first of equal ones), sources, order."""
    good = accepted(named, ontology)
    seq = F.struct("chunk_seq", "pos")
    return good.groupBy(F.col("canon").alias("name")).agg(
        F.max_by("kind", T.priority(F.col("kind"), ontology.priority)).alias("label"), F.max_by("description", F.struct(F.length("description"), -F.col("chunk_seq"), -F.col("pos"))).alias("description"),
        F.array_sort(F.collect_set("chunk_id")).alias("sources"), F.min(seq).alias("ord"),
    )


def accepted(named: DataFrame, ontology: Ontology = CLINICAL) -> DataFrame:
    return named.where(F.col("kind").isin(list(ontology.priority)) & ~T.is_garbage(F.col("canon")) & ~F.col("canon").isin(ontology.forbidden))


def fold_relations(named: DataFrame, raw_relations: DataFrame, ontology: Ontology = CLINICAL, per_row: bool = False) -> DataFrame:
    """Relations whose ends are known and legal as of their chunk: highest strength, first description, all sources; ``per_row``: before they are folded."""
    ids = named.groupBy("chunk_id", "id").agg(F.max_by("canon", "pos").alias("canon"))
    # a name has one row with the chunks at which each priority first stood, however many chunks mention it
    first = accepted(named, ontology).groupBy("canon", T.priority(F.col("kind"), ontology.priority).alias("p")).agg(F.min("chunk_seq").alias("since"))
    steps = first.groupBy("canon").agg(F.collect_list(F.struct("p", "since")).alias("steps"))
    of = {v: k for k, v in ontology.priority.items()}
    label = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
    ends = raw_relations.where("source is not null and target is not null and relation is not null").withColumn("relation", F.upper(F.trim("relation")))
    for end, name, kind in (("source", "subject", "s_label"), ("target", "object", "t_label")):
        side = ids.select("chunk_id", F.col("id").alias(end), F.col("canon").alias(name))
        known = steps.select(F.col("canon").alias(name), "steps")
        so_far = F.array_max(F.transform(F.filter("steps", lambda s: s["since"] <= F.col("chunk_seq")), lambda s: s["p"]))
        ends = ends.join(side, ["chunk_id", end]).join(known, name).withColumn(kind, label[so_far]).where(F.col(kind).isNotNull()).drop("steps")
    legal = ends.join(F.broadcast(triples(ends, ontology)), ["s_label", "relation", "t_label"], "left_semi")
    if per_row:
        return legal
    seq = F.struct("chunk_seq", "pos")
    return legal.groupBy(F.col("subject"), "relation", F.col("object").alias("target")).agg(
        F.min_by(F.trim(F.coalesce("description", F.lit(""))), seq).alias("description"), F.max(T.strength_of(F.col("strength"))).alias("strength"), F.array_sort(F.collect_set("chunk_id")).alias("sources"), F.min(seq).alias("ord"),
    )


def numbered_order(df: DataFrame) -> DataFrame:
    """``ord`` (chunk_seq, pos) as one number in which places never run into the next chunk's."""
    return df.withColumn("ord", F.col("ord.chunk_seq").cast("decimal(27,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("ord.pos").cast("decimal(10,0)"))


def adjacency(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(name, direction, relation, neighbor, description, strength, sources) in both directions; dangling ends go."""
    names = entities.select("name")
    whole = relations.join(names.withColumnRenamed("name", "subject"), "subject", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")
    rest = ["relation", "description", "strength", "sources"]
    out = whole.select(F.col("subject").alias("name"), F.lit("outgoing").alias("direction"), F.col("target").alias("neighbor"), *rest)
    return out.unionByName(whole.select(F.col("target").alias("name"), F.lit("incoming").alias("direction"), F.col("subject").alias("neighbor"), *rest))


def _one_after_another(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of two tables; ``ord`` goes on in the second where the first one ends, whatever its values."""
    last = first.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("last")).join(second.agg(F.coalesce(F.min("ord"), F.lit(0)).alias("least")))
    later = second.select(*columns, "ord").join(F.broadcast(last)).withColumn("ord", F.col("ord") - F.col("least") + F.col("last") + 1).select(*columns, "ord")
    return first.select(*columns, "ord").unionByName(later)


def _folded(relations: DataFrame) -> DataFrame:
    """Relations of one triple as one: the highest strength, the longest description (the first of equal ones), all sources."""
    return relations.groupBy("subject", "relation", "target").agg(
        F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), (-F.col("ord")).alias("o"))).alias("description"), F.max("strength").alias("strength"), _union_sources("sources"), F.min("ord").alias("ord")
    )


def merge_aliases(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of one label and compact name become one, and relations follow; loops stay."""
    keyed = entities.withColumn("compact", T.compact_name(F.col("name"))).withColumn("compact", F.when(F.col("compact") == "", F.col("name")).otherwise(F.col("compact")))
    merged = keyed.groupBy("label", "compact").agg(
        F.max_by("name", T.preferred(F.col("name"))).alias("keep"), F.max_by("description", F.struct(F.length("description"), (-F.col("ord")).alias("o"))).alias("description"), _union_sources("sources"), F.min("ord").alias("ord")
    )
    alias = keyed.join(merged.select("label", "compact", "keep"), ["label", "compact"]).select("name", "keep")
    moved = relations.join(alias.select(F.col("name").alias("subject"), F.col("keep").alias("s")), "subject", "left").join(alias.select(F.col("name").alias("target"), F.col("keep").alias("t")), "target", "left")
    moved = moved.withColumn("subject", F.coalesce("s", "subject")).withColumn("target", F.coalesce("t", "target"))
    return merged.select(F.col("keep").alias("name"), "label", "description", "sources", "ord"), _folded(moved)


def clean_graph(entities: DataFrame, relations: DataFrame, ontology: Ontology = CLINICAL) -> tuple[DataFrame, DataFrame]:
    """Aliases merged; placeholder and low-signal entities, illegal relations and then isolated entities go."""
    entities, relations = merge_aliases(entities, relations)
    # names are judged once, though three joins read them
    kept = stage(entities.where(~T.is_placeholder(F.col("name"), F.col("label")) & ~T.is_low_signal(F.col("name"), F.col("label"))), "kept_entities")
    ends = kept.select(F.col("name").alias("subject"), F.col("label").alias("s_label"))
    good = relations.join(ends, "subject").join(ends.select(F.col("subject").alias("target"), F.col("s_label").alias("t_label")), "target")
    good = good.join(F.broadcast(triples(good, ontology)), ["s_label", "relation", "t_label"], "left_semi").select("subject", "relation", "target", "description", "strength", "sources", "ord")
    used = good.select(F.explode(F.array("subject", "target")).alias("name")).distinct()
    return kept.join(used, "name", "left_semi"), good


def clean_report(entities: DataFrame, relations: DataFrame, cleaned: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row of counts before and after."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(entities, "entities_before").join(n(relations, "relations_before")).join(n(cleaned[0], "entities_after")).join(n(cleaned[1], "relations_after"))


def merge_graphs(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], ontology: Ontology = CLINICAL, clean: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, conflicts): the first graph's labels hold; where they differ its description is only filled if empty."""
    a, b = (g[0].select("name", *(F.col(c).alias(f"{c}_{k}") for c in ("label", "description", "sources", "ord"))) for k, g in zip("ab", (first, second)))
    both = a.join(b, "name", "full")
    differ = F.col("label_a").isNotNull() & F.col("label_b").isNotNull() & (F.col("label_a") != F.col("label_b"))
    da, db = F.coalesce("description_a", F.lit("")), F.coalesce("description_b", F.lit(""))
    description = F.when(differ, F.when(da == "", db).otherwise(da)).when(F.length(db) > F.length(da), db).otherwise(da)
    none = F.array().cast("array<string>")
    sources = F.array_sort(F.array_union(F.coalesce("sources_a", none), F.coalesce("sources_b", none)))
    entities = both.select("name", F.coalesce("label_a", "label_b").alias("label"), description.alias("description"), sources.alias("sources"), F.coalesce("ord_a", "ord_b").alias("ord"))
    conflicts = both.where(differ).select("name", F.col("label_a").alias("kept_label"), F.col("label_b").alias("other_label"))
    relations = _folded(_one_after_another(first[1], second[1], ["subject", "relation", "target", "description", "strength", "sources"]))
    if clean:
        entities, relations = clean_graph(entities, relations, ontology)
    return entities, relations, conflicts


def upsert(state: tuple[DataFrame, DataFrame], incoming: tuple[DataFrame, DataFrame], ontology: Ontology = CLINICAL) -> tuple[DataFrame, DataFrame]:
    """Incoming entities and relations folded into a graph: highest label, longest description, highest strength, all sources."""
    rows = _one_after_another(state[0], incoming[0], ["name", "label", "description", "sources"])
    entities = rows.groupBy("name").agg(
        F.max_by("label", T.priority(F.col("label"), ontology.priority)).alias("label"), F.max_by("description", F.struct(F.length("description"), (-F.col("ord")).alias("o"))).alias("description"), _union_sources("sources"), F.min("ord").alias("ord")
    )
    legal = incoming[1].join(entities.select(F.col("name").alias("subject"), F.col("label").alias("s_label")), "subject").join(entities.select(F.col("name").alias("target"), F.col("label").alias("t_label")), "target")
    legal = legal.join(F.broadcast(triples(legal, ontology)), ["s_label", "relation", "t_label"], "left_semi")
    return entities, _folded(_one_after_another(state[1], legal, ["subject", "relation", "target", "description", "strength", "sources"]))


def remove_families(relations: DataFrame, families: DataFrame) -> DataFrame:
    """Without the relations of the given (subject, relation) pairs."""
    return relations.join(families.select("subject", "relation"), ["subject", "relation"], "left_anti")


def merge_chunk_maps(first: DataFrame, second: DataFrame) -> DataFrame:
    """(chunk_id, value, collides): the second's value holds; it collides where both have one and they differ."""
    both = first.select("chunk_id", F.col("value").alias("a")).join(second.select("chunk_id", F.col("value").alias("b")), "chunk_id", "full")
    return both.select("chunk_id", F.coalesce("b", "a").alias("value"), F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("collides"))


def _automaton(patterns: dict[str, list[int]]) -> ahocorasick.Automaton | None:
    """An automaton that gives (number, length, targets) of each pattern."""
    if not patterns:
        return None
    automaton = ahocorasick.Automaton()
    for i, (pattern, who) in enumerate(sorted(patterns.items())):
        automaton.add_word(pattern, (i, len(pattern), who))
    automaton.make_automaton()
    return automaton


def _scored_chunks(forms: DataFrame, targets: list, kind: str) -> DataFrame:
    """Scores of a few targets in chunks (chunk_seq and normalised context, section, lead and whole text), hits alone.

    What a chunk holds is gathered in vectors over the targets; rows leave some at a time, so memory is bounded by
    ``AT_A_TIME`` chunks and rows.
    """
    names = pa.array([t.target for t in targets], pa.string())

    def told(column: str, squeeze: bool = False) -> dict[str, np.ndarray]:
        out: dict[str, set[int]] = {}
        for i, t in enumerate(targets):
            for p in t[column] or ():
                if p := (p or "").replace(" ", "" if squeeze else " "):
                    out.setdefault(p, set()).add(i)
        return {p: np.array(sorted(who), np.int32) for p, who in out.items()}

    aliases, compacts, hints = told("aliases"), told("aliases", True), told("hints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_alias, by_compact, by_hint = map(_automaton, (aliases, compacts, hints))

        def met(automaton, text: str) -> dict[int, tuple[int, np.ndarray, int]]:
            """{pattern: (its length, its targets, where it first ends)}."""
            found: dict = {}
            if automaton is not None:
                for end, (p, length, who) in automaton.iter(text):
                    if p not in found:
                        found[p] = (length, who, end + 1)
            return found

        def of(found: dict, near=None) -> np.ndarray:
            who = np.zeros(len(targets), bool)
            picked = [w for length, w, end in found.values() if near is None or near(length, end)]
            if picked:
                who[np.concatenate(picked)] = True
            return who

        def scored(context: str, section: str, lead: str, whole: str) -> tuple[np.ndarray, np.ndarray]:
            in_context, heads, everywhere = met(by_alias, context), met(by_hint, section), met(by_hint, whole)
            score = 20 * of(in_context) + 18 * of(met(by_alias, whole)) + 12 * of(met(by_compact, whole.replace(" ", "")))
            for p, (_, who, _) in (heads | everywhere).items():
                score[who] += 12 if p in heads else 5
            anchors = of(in_context, lambda n, end: end <= max(n + 20, 80)) | of(met(by_alias, section), lambda n, end: end == n) | of(met(by_alias, lead))
            return score, anchors

        def rows(seqs: list, found: list) -> pa.RecordBatch:
            at = [s.nonzero()[0] for s, _ in found]
            which = np.concatenate(at)
            times = np.repeat(np.arange(len(seqs)), [len(x) for x in at])
            score, anchor = (np.concatenate([f[k][x] for f, x in zip(found, at)]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([names.take(pa.array(which)), pa.array(seqs, seq_type).take(pa.array(times)), pa.array(score, pa.int32()), pa.array(anchor)], ["target", "chunk_seq", "score", "anchor"])

        for batch in batches:
            seq_type = batch.schema.field(0).type
            for begin in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(begin, AT_A_TIME)
                texts = zip(*(c.to_pylist() for c in part.columns[1:]))
                yield rows(part.column(0).to_pylist(), [scored(*t) for t in texts])

    return forms.mapInArrow(run, f"target string, chunk_seq {kind}, score int, anchor boolean")


def repair_scores(chunks: DataFrame, targets: DataFrame, at_once: int = MOST_TARGETS) -> DataFrame:
    """(target, chunk_seq, score, anchor) of the chunks (chunk_seq, section, context, text) that hold something of a target (target, aliases, hints).

    An alias counts 20 in the context, 18 anywhere, 12 anywhere with all marks left out; each hint counts 12 in the
    section, else 5 anywhere. A chunk is an anchor if an alias begins its context or section, or stands early in its
    context or text. One automaton over all aliases and hints reads each form of a text once, whatever the number of
    targets, and only hits leave: a chunk without any has no row. ``at_once`` targets go into an automaton; more of
    them take a pass each.
    """
    part = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    whole, norm = F.concat_ws(" ", part("section"), part("context"), part("text")), lambda c: T.normalize_name(F.coalesce(c, F.lit("")))
    forms = chunks.select("chunk_seq", norm(F.col("context")).alias("context"), norm(F.col("section")).alias("section"), norm(F.substring("text", 1, 220)).alias("lead"), norm(whole).alias("whole"))
    kind, out = chunks.schema["chunk_seq"].dataType.simpleString(), None
    own = targets.select("target", "aliases", F.transform("hints", lambda h: T.normalize_name(h)).alias("hints"))
    n = own.count()
    if n <= at_once:
        return _scored_chunks(forms, own.collect(), kind)
    passes = -(-2 * n // at_once)
    dealt = stage(own.withColumn("pass", F.pmod(F.xxhash64("target"), F.lit(passes))), "repair_targets")
    for r in range(passes):
        scored = _scored_chunks(forms, dealt.where(F.col("pass") == r).drop("pass").collect(), kind)
        out = scored if out is None else out.unionByName(scored)
    return out


def select_repair_chunks(scores: DataFrame, top: int = 6, gap: int = 4, least: int = 18, preferred: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """(target, chunk_seq, score, rank): the best chunks of each target by ``scores`` (target, chunk_seq, score, anchor).

    Anchors within ``gap`` form clusters; the largest (earliest) one lends chunks up to 6 away a bonus. Chunks of ``chunks``
    (chunk_seq) within it or beside it that hold nothing of the target count by the bonus alone: the cluster's numbers are laid
    out, at most ``gap`` times its anchors, and met by equality. A target with ``preferred`` chunks (target, chunk_seq) gets
    the first of those, without a score.
    """
    order = Window.partitionBy("target").orderBy("chunk_seq")
    islands = scores.where("anchor").withColumn("new", F.coalesce((F.col("chunk_seq") - F.lag("chunk_seq").over(order) > gap).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(order))
    sizes = islands.groupBy("target", "island").agg(F.count("*").alias("n"), F.min("chunk_seq").alias("first"), F.max("chunk_seq").alias("last"))
    best = sizes.groupBy("target").agg(F.min_by(F.struct("first", "last"), F.struct((-F.col("n")).alias("n"), "first")).alias("b")).select("target", "b.first", "b.last")
    rows = scores.select("target", "chunk_seq", "score")
    if chunks is not None:
        there = chunks.select("chunk_seq").distinct()
        beside = best.select("target", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("chunk_seq")).join(there, "chunk_seq", "left_semi")
        rows = rows.unionByName(beside.join(rows, ["target", "chunk_seq"], "left_anti").select("target", "chunk_seq", F.lit(0).alias("score")))
    near = rows.join(best, "target", "left")
    far = F.when(F.col("chunk_seq") < F.col("first"), F.col("first") - F.col("chunk_seq")).when(F.col("chunk_seq") > F.col("last"), F.col("chunk_seq") - F.col("last")).otherwise(0)
    bonus = F.when(F.col("first").isNull(), 0).when(far <= 1, 18).when(far <= 3, 10).when(far <= 6, 4).otherwise(0)
    dropped = F.col("first").isNotNull() & (far > 6) & (F.col("score") < least + 10)
    ranked = near.where(~dropped).withColumn("score", F.col("score") + bonus).where(F.col("score") >= least)
    pick = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(*by))).where(F.col("rank") <= top).select("target", "chunk_seq", "score", "rank")
    if preferred is None:
        return pick(ranked, F.desc("score"), "chunk_seq")
    own = preferred.select("target", "chunk_seq").distinct()
    own = own.join(chunks.select("chunk_seq").distinct(), "chunk_seq", "left_semi") if chunks is not None else own
    first = pick(own.withColumn("score", F.lit(None).cast("int")), "chunk_seq")
    return pick(ranked.join(own, "target", "left_anti"), F.desc("score"), "chunk_seq").unionByName(first)


def structural_checks(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(check, passed): what must hold in any graph."""
    names = entities.select("name")
    zero = lambda df, label: df.agg((F.count("*") == 0).alias("passed")).select(F.lit(label).alias("check"), "passed")
    out = zero(relations.join(names.withColumnRenamed("name", "subject"), "subject", "left_anti"), "subjects_exist")
    for df, label in (
        (relations.join(names.withColumnRenamed("name", "target"), "target", "left_anti"), "targets_exist"), (names.groupBy("name").count().where("count > 1"), "names_unique"),
        (relations.groupBy("subject", "relation", "target").count().where("count > 1"), "triples_unique"), (relations.where("strength not between 1 and 10"), "strength_in_range"),
        (entities.where("trim(name) = ''"), "names_filled"), (relations.where(~F.col("relation").rlike("^[A-Z][A-Z0-9_]*$")), "relation_names_valid"), (relations.where("size(sources) = 0"), "relations_sourced"),
    ):
        out = out.unionByName(zero(df, label))
    return out


def condition_aliases(entities: DataFrame) -> DataFrame:
    """(target, aliases): the normalised names by which each condition may stand in a text: its own and those of all conditions
    with the same compact name, and the abbreviations of either. Compact forms are these without spaces."""
    from quillgraph.config import ABBREVIATIONS

    own = entities.where("label = 'CONDITION'").select(F.col("name").alias("target"), T.compact_name(F.col("name")).alias("compact"))
    short = entities.sparkSession.createDataFrame(list(ABBREVIATIONS.items()), "alias string, told string").withColumn("compact", T.compact_name(F.col("told")))
    names = own.select("compact", T.normalize_name(F.col("target")).alias("alias"))
    names = names.unionByName(short.select("compact", F.explode(F.array(T.normalize_name(F.col("alias")), T.normalize_name(F.col("told")))).alias("alias")))
    by_compact = names.where("alias <> ''").groupBy("compact").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return own.join(by_compact, "compact").select("target", "aliases")


def repair_graph(state: tuple[DataFrame, DataFrame], chunks: DataFrame, targets: list[dict], extract, ontology: Ontology = CLINICAL) -> tuple[DataFrame, DataFrame]:
    """The graph after its repair targets, one after another, since each builds on the last; then cleaned.

    A target has ``condition``, ``relations`` and ``hints``; ``extract`` turns its best chunks (chunk_seq, chunk_id, text)
    into payloads (chunk_seq, chunk_id, payload). Only relations from the condition that the target asks for are taken.
    """
    spark = chunks.sparkSession
    for target in targets:
        aliases = [r.aliases for r in condition_aliases(state[0]).where(F.col("target") == target["condition"]).collect()] or [[target["condition"]]]
        table = spark.createDataFrame([(target["condition"], aliases[0], target["hints"])], "target string, aliases array<string>, hints array<string>")
        best = select_repair_chunks(stage(repair_scores(chunks, table)), chunks=chunks)
        raw_entities, raw_relations = explode_payloads(extract(chunks.join(best.select("chunk_seq"), "chunk_seq", "left_semi")))
        named = stage(named_entities(raw_entities))
        order = numbered_order
        wanted = stage(fold_relations(named, raw_relations, ontology)).where((F.col("subject") == target["condition"]) & F.col("relation").isin(target["relations"]))
        entities, relations = upsert(state, (order(stage(fold_entities(named, ontology))), order(wanted)), ontology)
        state = stage(entities), stage(relations)
    return clean_graph(*state, ontology)


def extraction_stats(chunks: DataFrame, ontology: Ontology = CLINICAL, payload: str = "payload") -> DataFrame:
    """(counter, n) over chunks (chunk_seq, chunk_id, payload): payloads that do not parse, entities and relations that are rejected, and by what."""
    parsed = parsed_payloads(chunks, payload)
    unread = parsed.where(F.col("p").isNull() & ~F.col("blank")).agg(F.count("*").alias("n")).select(F.lit("json_parse_errors").alias("counter"), "n")
    raw, relations = exploded(parsed)
    named = stage(named_entities(raw))
    typed, name = F.col("kind").isin(list(ontology.priority)), F.col("canon")
    judged = named.select(
        F.count_if(~typed).alias("type_conflicts"), F.count_if(typed & T.is_garbage(name)).alias("garbage_rejected"), F.count_if(typed & ~T.is_garbage(name) & name.isin(ontology.forbidden)).alias("semantic_rejected")
    ).selectExpr("stack(3, 'type_conflicts', type_conflicts, 'garbage_rejected', garbage_rejected, 'semantic_rejected', semantic_rejected) as (counter, n)")
    kept = fold_relations(named, relations.withColumn("row", F.struct("chunk_seq", "pos")), ontology, per_row=True)
    skipped = relations.agg(F.count("*").alias("all")).join(kept.agg(F.count("*").alias("good"))).select(F.lit("skipped_triplets").alias("counter"), (F.col("all") - F.col("good")).alias("n"))
    return unread.unionByName(judged).unionByName(skipped)


def curated_repair(state: tuple[DataFrame, DataFrame], chunks: DataFrame, specs: DataFrame, reset: DataFrame, ontology: Ontology = CLINICAL) -> tuple[DataFrame, DataFrame]:
    """A graph with curated facts in place of the families ``reset`` (subject, relation), then cleaned.

    ``specs`` (spec, hints array, payload) holds the facts; a spec's sources are the chunks (chunk_seq, chunk_id, text) whose
    text holds one of its hints. Specs, at most ``MOST_TARGETS``, meet chunks by hint, so a spec without a chunk keeps its own name as source.
    """
    if specs.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} curated facts at once")
    hints = F.broadcast(specs.select("spec", F.explode("hints").alias("hint")))
    found = chunks.select("chunk_id", F.lower("text").alias("low")).join(hints, F.col("low").contains(F.lower("hint"))).groupBy("spec").agg(F.array_sort(F.collect_set("chunk_id")).alias("found"))
    facts = specs.join(found, "spec", "left").select(F.dense_rank().over(Window.orderBy("spec")).cast("bigint").alias("chunk_seq"), F.col("spec").alias("chunk_id"), "payload", F.coalesce("found", F.array("spec")).alias("found"))
    raw, relations = explode_payloads(facts)
    named = stage(named_entities(raw))
    sourced = lambda df: numbered_order(df).join(facts.select(F.array("chunk_id").alias("of"), "found"), F.arrays_overlap("sources", "of")).groupBy(*[c for c in df.columns if c not in ("sources", "ord")]).agg(_union_sources("found"), F.min("ord").alias("ord"))
    entities, triples_ = sourced(fold_entities(named, ontology)), sourced(fold_relations(named, relations, ontology))
    kept = (state[0], remove_families(state[1], reset))
    return clean_graph(*upsert(kept, (entities, triples_), ontology), ontology)


def with_lineage(meta: dict, step: dict) -> dict:
    """``meta`` with ``step`` at the end of its lineage, unless the last step has the same directory."""
    lineage = list(meta.get("lineage", []))
    if not lineage or lineage[-1].get("directory") != step.get("directory"):
        lineage.append(step)
    return {**meta, "lineage": lineage}
