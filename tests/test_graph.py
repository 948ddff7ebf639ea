"""Graph folds, merges and lookups, against sequential versions and small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.config import CLINICAL, TRIPLES, TYPE_PRIORITY
from quillgraph.operators import communities as CM
from quillgraph.operators import graph as G
from quillgraph.operators import lookup as Q
from quillgraph.operators.sections import filter_sections, rebuild, split_sections
from quillgraph.plans.demo import demo_graph
from quillgraph.plans.router import answer_questions
from quillgraph.sources import tables as S
from quillgraph.streaming.sessions import session_context

E = "name string, label string, description string, sources array<string>, ord bigint"
R = "subject string, relation string, target string, description string, strength int, sources array<string>, ord bigint"


def test_fold_equals_a_sequential_one(spark):
    rng = random.Random(4)
    types, rels = ["CONDITION", "SYMPTOM", "TREATMENT", "NONSENSE"], ["HAS_SYMPTOM", "TREATED_BY"]
    chunks = []
    for seq in range(40):
        ents = [{"id": f"e{rng.randint(0, 3)}", "name": rng.choice(["alpha", "beta", "gamma", "delta"]), "type": rng.choice(types), "description": "d" * rng.randint(0, 4)} for _ in range(4)]
        links = [{"source": f"e{rng.randint(0, 4)}", "target": f"e{rng.randint(0, 4)}", "relation": rng.choice(rels), "description": f"x{seq}", "strength": rng.choice([3, "high", 7.5, True])} for _ in range(3)]
        chunks.append((seq, f"c{seq}", json.dumps({"entities": ents, "relations": links})))
    entities, relations = {}, {}
    for _, cid, payload in chunks:
        p, ids = json.loads(payload), {}
        for e in p["entities"]:
            name = e["name"].upper()
            ids[e["id"]] = name
            if e["type"] not in TYPE_PRIORITY:
                continue
            old = entities.setdefault(name, [e["type"], e["description"], set()])
            if TYPE_PRIORITY[e["type"]] > TYPE_PRIORITY[old[0]]:
                old[0] = e["type"]
            if len(e["description"]) > len(old[1]):
                old[1] = e["description"]
            old[2].add(cid)
        for r in p["relations"]:
            s, t = ids.get(r["source"]), ids.get(r["target"])
            if s in entities and t in entities and (entities[s][0], r["relation"], entities[t][0]) in TRIPLES:
                strength = {3: 3, "high": 8, 7.5: 8, True: 5}[r["strength"]] if r["strength"] is not True else 5
                old = relations.setdefault((s, r["relation"], t), [r["description"], strength, set()])
                old[1] = max(old[1], strength)
                old[2].add(cid)
    for parts in (1, 5):
        df = spark.createDataFrame(chunks, "chunk_seq bigint, chunk_id string, payload string").repartition(parts)
        raw_e, raw_r = G.explode_payloads(df)
        named = G.named_entities(raw_e)
        got_e = {r.name: [r.label, r.description, set(r.sources)] for r in G.fold_entities(named).collect()}
        got_r = {(r.subject, r.relation, r.target): [r.description, r.strength, set(r.sources)] for r in G.fold_relations(named, raw_r).collect()}
        assert got_e == entities
        assert got_r == relations


def test_payloads_in_fences_and_prose(spark):
    body = '{"entities": [{"id": "1", "name": "Panic", "type": "condition", "description": ""}], "relations": []}'
    rows = [(0, "a", f"```json\n{body}\n```"), (1, "b", f"Here it is: {body} Done."), (2, "c", "not json"), (3, "d", ""), (4, "e", None)]
    raw, _ = G.explode_payloads(spark.createDataFrame(rows, "chunk_seq bigint, chunk_id string, payload string"))
    assert sorted(r.chunk_id for r in raw.collect()) == ["a", "b"]


def test_merge_of_two_graphs(spark):
    ptsd, nm = "POST TRAUMATIC STRESS DISORDER", "NIGHTMARE"
    first = (
        spark.createDataFrame([(ptsd, "CONDITION", "Primary PTSD description.", ["p-1"], 0), (nm, "SYMPTOM", "Primary symptom description.", ["p-1"], 1)], E),
        spark.createDataFrame([(ptsd, "HAS_SYMPTOM", nm, "Primary symptom edge.", 5, ["p-1"], 0)], R),
    )
    second = (
        spark.createDataFrame([(ptsd, "CONDITION", "Secondary PTSD description.", ["s-1"], 0), (nm, "CONDITION", "Secondary nightmare condition.", ["s-1"], 1), ("TRAUMA", "RISK_FACTOR", "Risk factor from secondary graph.", ["s-1"], 2), ("PANIC DISORDER", "CONDITION", "Differential diagnosis.", ["s-1"], 3)], E),
        spark.createDataFrame([(ptsd, "HAS_SYMPTOM", nm, "e", 9, ["s-1"], 0), (nm, "HAS_RISK_FACTOR", "TRAUMA", "e", 7, ["s-1"], 1), (ptsd, "DIFFERENTIAL_DIAGNOSIS", "PANIC DISORDER", "e", 8, ["s-1"], 2)], R),
    )
    e, r, conflicts = G.merge_graphs(first, second)
    assert {x.name: x.label for x in e.collect()} == {ptsd: "CONDITION", nm: "SYMPTOM", "PANIC DISORDER": "CONDITION"}
    got = {(x.subject, x.relation, x.target): (x.strength, x.sources) for x in r.collect()}
    assert got == {(ptsd, "HAS_SYMPTOM", nm): (9, ["p-1", "s-1"]), (ptsd, "DIFFERENTIAL_DIAGNOSIS", "PANIC DISORDER"): (8, ["s-1"])}
    assert [tuple(c) for c in conflicts.collect()] == [(nm, "SYMPTOM", "CONDITION")]


def test_cleaning_twice_changes_nothing(spark):
    e, r, _ = demo_graph(spark)
    e = e.union(spark.createDataFrame([("Mood disorder", "CONDITION", "", ["c"], 50), ("PANIC-DISORDER", "CONDITION", "longer one", ["z"], 51)], E))
    once = G.clean_graph(e, r)
    twice = G.clean_graph(*once)
    assert sorted(map(str, once[0].collect())) == sorted(map(str, twice[0].collect()))
    assert sorted(map(str, once[1].collect())) == sorted(map(str, twice[1].collect()))
    assert "PANIC DISORDER" in {x.name for x in once[0].collect()} or "PANIC-DISORDER" in {x.name for x in once[0].collect()}


def test_questions(spark):
    asked = [(1, "What is LITHIUM used for?"), (2, "I feel tired and lost my appetite to eat. What could this possibly be ?"), (3, "what is depresion"), (4, "I want to kill myself"), (5, "compare ptsd and panic disorder"), (6, "best pizza recipe"), (7, "What are the symptoms of depression?")]
    got = {r.qid: r for r in answer_questions(spark.createDataFrame(asked, "qid bigint, question string"), *demo_graph(spark)).collect()}
    assert (got[1].query_class, got[1].query_type) == ("IN_SCOPE", "treatment") and "BIPOLAR DISORDER" in got[1].answer
    assert got[2].query_type == "reverse_symptom" and "DEPRESSION" in got[2].answer
    assert got[3].query_type == "forward_lookup" and got[3].entities == "DEPRESSION"
    assert got[4].query_class == "CRISIS" and "988" in got[4].answer
    assert got[5].query_type == "comparison" and "shared all, TREATED_BY: COGNITIVE BEHAVIORAL THERAPY" in got[5].answer
    assert got[6].query_class == "OUT_OF_SCOPE"
    assert got[7].query_type == "symptoms" and "FATIGUE: " not in got[7].answer and "- FATIGUE (strength 9)" in got[7].answer and "Guide 0" in got[7].citations


def test_checkpoint_round_trip(spark, tmp_path):
    e, r, c = demo_graph(spark)
    S.save_graph({"entities": e, "relations": r, "chunk_payloads": c}, str(tmp_path), {"model": "none"})
    back = S.load_graph(spark, str(tmp_path))
    assert back["entities"].count() == e.count() and sorted(map(str, back["relations"].select("subject", "relation", "target", "strength").collect())) == sorted(map(str, r.select("subject", "relation", "target", "strength").collect()))


def test_sections(spark):
    text = "intro\n# A\none\n## B\ntwo\n```\n# not a header\n```\n# C\nthree"
    rows = split_sections(spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id bigint, text string")).orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.header, r.header_path) for r in rows] == [(1, "__preamble__", "/"), (1, "A", "/"), (1, "B", "/A"), (1, "C", "/"), (2, "__document__", "/")]
    assert "# not a header" in rows[2].content
    window = "# Preface\nx\n# Section II\na\n# Symptoms\nb\n# Section III\nc"
    kept = filter_sections(split_sections(spark.createDataFrame([(1, window)], "doc_id bigint, text string")))
    assert [r.header for r in kept.where("keep").orderBy("idx").collect()] == ["Section II", "Symptoms"]
    assert rebuild(kept).collect()[0].markdown == "# Section II\n\na\n\n# Symptoms\n\nb\n"


def test_session_memory(spark):
    rows = [(1, i, f"q{i}") for i in range(9)]
    got = {r.turn: r.analysis_text for r in session_context(spark.createDataFrame(rows, "session_id bigint, turn bigint, question string")).collect()}
    assert got[0] == "q0" and got[8] == "q2 q3 q4 q5 q6 q7 q8"


def test_sessions_gate_and_link(spark, tmp_path):
    from quillgraph.plans.engine import Engine

    e, r, c = demo_graph(spark)
    S.save_graph({"entities": e, "relations": r, "chunk_payloads": c}, str(tmp_path / "g"))
    said = [(1, 1, "What is anxiety?"), (1, 2, "suicide"), (2, 1, "I feel tired all the time."), (2, 2, "and I lost my appetite to eat lately."), (3, 1, "I want to kill myself"), (3, 2, "What is depression?"), (4, 1, "is a differential diagnosis known for depression and panic disorder")]
    got = {r.qid: r for r in Engine(spark, str(tmp_path / "g")).converse(spark.createDataFrame(said, "session_id bigint, turn bigint, question string")).collect()}
    assert got[1_000_002].query_class == "CRISIS" and "988" in got[1_000_002].answer and got[3_000_001].query_class == "CRISIS"
    assert got[2_000_002].query_type == "reverse_symptom" and "FATIGUE" in got[2_000_002].entities and "DEPRESSION" in got[2_000_002].answer
    assert got[4_000_001].query_type == "differential_diagnosis" and got[2_000_002].source_chunks


def test_fuzzy_links_equal_plain_ones(spark):
    import random
    from difflib import SequenceMatcher

    from quillgraph.operators import linking as L

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ABCDE") for _ in range(rng.randint(2, 14)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(150)} | {"A" * 40 + "BCDEABC"})
    asked = [(1000, "A" * 40 + "BCDEABCDEABCDEAB")]
    for i in range(80):
        letters = list(rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(letters))
            letters[at : at + 1] = rng.choice(["", rng.choice("ABCDE"), letters[at] + "B"])
        asked.append((i, "".join(letters)))
    want = set()
    for qid, q in asked:
        w = q.split()
        grams = {" ".join(w[a : a + n]) for n in range(1, 6) for a in range(len(w) - n + 1)}
        for name in names:
            least = 0.91 if " " in name else 0.88
            for g in grams:
                if len(name) >= 5 and len(g) >= 4 and g != name and abs(len(g.split()) - len(name.split())) <= 1 and abs(len(g) - len(name)) <= max(4, len(name) // 3) and SequenceMatcher(None, g, name).ratio() >= least:
                    want.add((qid, name))
    entities = spark.createDataFrame([(n, "CONDITION") for n in names], "name string, label string")
    got = {(r.qid, r.name) for r in L.link_fuzzy(spark.createDataFrame(asked, "qid bigint, question string"), entities, 10_000).collect()}
    assert got == want and len(want) > 30 and (1000, "A" * 40 + "BCDEABC") in want


def test_labels_of_a_hub_change_once(spark):
    named = spark.createDataFrame([(i, f"k{i}", 0, "HUB", kind, "") for i, kind in enumerate(["DEMOGRAPHIC"] * 3 + ["SYMPTOM"] * 3 + ["CONDITION"] + ["SYMPTOM"] * 20)] + [(i, f"k{i}", 1, "GLOOM", "SYMPTOM", "") for i in range(27)], "chunk_seq bigint, chunk_id string, pos int, canon string, kind string, description string").withColumn("id", F.lower("canon"))
    told = spark.createDataFrame([(i, f"k{i}", 0, "hub", "gloom", "has_symptom", "", "5") for i in range(27)], "chunk_seq bigint, chunk_id string, pos int, source string, target string, relation string, description string, strength string")
    (row,) = G.fold_relations(named, told).collect()
    assert row.sources == sorted(f"k{i}" for i in range(6, 27))


def test_communities_beat_labels_alone(spark):
    import random

    rng = random.Random(8)
    edges = {(f"n{g}{a:02d}", f"n{g}{b:02d}") for g in "abcd" for a in range(12) for b in range(a) if rng.random() < 0.6} | {("na00", "nb00"), ("nb01", "nc01"), ("nc02", "nd02")}
    r = spark.createDataFrame([(a, "R", b, "", 5, [], i) for i, (a, b) in enumerate(sorted(edges))], R)
    got = {x.name: x.community_id for x in CM.communities(r.repartition(3)).collect()}
    m = len(edges)
    degree = {n: sum(n in e for e in edges) for n in got}
    modularity = lambda of: sum((of[a] == of[b]) / m for a, b in edges) - sum((sum(degree[n] for n in of if of[n] == c) / (2 * m)) ** 2 for c in set(of.values()))
    assert modularity(got) >= 0.95 * modularity({n: n[1] for n in got}) and sorted(set(got.values())) == list(range(len(set(got.values()))))
    assert got == {x.name: x.community_id for x in CM.communities(r).collect()}


def test_communities_are_connected_and_complete(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), ("x", "y")]
    r = spark.createDataFrame([(a, "R", b, "", 5, [], i) for i, (a, b) in enumerate(edges)], R)
    got = {x.name: x.community_id for x in CM.communities(r).collect()}
    assert set(got) == set("abcdefxy") and got["x"] == got["y"] and got["a"] == got["b"] == got["c"] != got["d"] == got["e"] == got["f"]
    assert {x.name: x.component for x in CM.connected_components(CM.undirected(r)).collect()} == {**dict.fromkeys("abcdef", "a"), "x": "x", "y": "x"}


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"sources": [{"id": "Doc 1", "authority": "WHO", "condition": "Panic", "source_title": "t", "format": "pdf", "url": "u"}, {"id": "", "authority": "nimh", "condition": "", "source_title": "", "format": "html", "url": "v"}]}))
    src = S.load_registry(spark, str(tmp_path / "r.json"))
    out = S.with_status(S.filter_sources(src), spark.createDataFrame([("who__panic__doc-1.md",)], "output string"))
    assert sorted((r.output, r.status) for r in out.collect()) == [("nimh__source.md", "pending"), ("who__panic__doc-1.md", "skipped_existing")]
    pages = spark.createDataFrame([(1, "<html><nav>menu</nav><h1>Head</h1><div class='ad'>buy</div><p>Some <b>text</b></p><script>x</script></html>"), (2, None)], "page_id bigint, html string")
    got = {r.page_id: r.markdown for r in S.html_to_markdown(pages).collect()}
    assert got[1].startswith("# Head") and "Some text" in got[1] and "buy" not in got[1] and "menu" not in got[1] and got[2] == ""


def test_build_save_and_ask(spark, tmp_path):
    from quillgraph.plans.engine import Engine, build

    text = "# Depression\n" + "Depression is a clinical condition with low energy. " * 5
    docs = spark.createDataFrame([(1, text, "WHO: Depression")], "doc_id bigint, text string, source_label string")
    told = json.dumps({"entities": [{"id": "a", "name": "depression", "type": "CONDITION", "description": ""}, {"id": "b", "name": "fatigue", "type": "SYMPTOM", "description": ""}], "relations": [{"source": "a", "target": "b", "relation": "HAS_SYMPTOM", "description": "tired", "strength": "high"}]})
    tables = build(docs, lambda chunks: chunks.select("chunk_seq", "chunk_id", F.lit(told).alias("payload")))
    S.save_graph(tables, str(tmp_path / "g"))
    engine = Engine(spark, str(tmp_path / "g"))
    (answer,) = engine.query(spark.createDataFrame([(1, "What are the symptoms of depression?")], "qid bigint, question string")).collect()
    assert "- FATIGUE (strength 8)" in answer.answer and answer.citations == "WHO: Depression — Depression"
    assert all(r.passed for r in engine.health().collect())


def test_repair(spark):
    e, r, _ = demo_graph(spark)
    chunks = spark.createDataFrame([(0, "k0", "Panic disorder: prevalence", "", "The prevalence of panic disorder is three in a hundred."), (9, "k9", "other", "", "nothing here")], "chunk_seq bigint, chunk_id string, section string, context string, text string")
    told = json.dumps({"entities": [{"id": "a", "name": "panic disorder", "type": "CONDITION", "description": ""}, {"id": "b", "name": "prevalence", "type": "PREVALENCE_STATEMENT", "description": "Three in a hundred."}], "relations": [{"source": "a", "target": "b", "relation": "HAS_PREVALENCE", "description": "x", "strength": 7}]})
    _, relations = G.repair_graph((e, r), chunks, [{"condition": "PANIC DISORDER", "relations": ["HAS_PREVALENCE"], "hints": ["prevalence"]}], lambda c: c.select("chunk_seq", "chunk_id", F.lit(told).alias("payload")))
    assert [(x.target, x.strength, x.sources) for x in relations.where("subject = 'PANIC DISORDER' and relation = 'HAS_PREVALENCE'").collect()] == [("THREE IN A HUNDRED", 7, ["k0"])]


def test_extraction_counts_and_curated_facts(spark):
    told = {"entities": [{"id": "a", "name": "panic disorder", "type": "CONDITION"}, {"id": "b", "name": "support", "type": "SYMPTOM"}, {"id": "c", "name": "thing", "type": "NOTHING"}, {"id": "d", "name": "behavior", "type": "SYMPTOM"}, {"id": "e", "name": "trembling", "type": "SYMPTOM"}],
            "relations": [{"source": "a", "target": "e", "relation": "HAS_SYMPTOM"}, {"source": "a", "target": "c", "relation": "HAS_SYMPTOM"}, {"source": "e", "target": "a", "relation": "HAS_SYMPTOM"}]}
    chunks = spark.createDataFrame([(0, "k0", json.dumps(told)), (1, "k1", "{broken"), (2, "k2", ""), (3, "k3", None)], "chunk_seq bigint, chunk_id string, payload string")
    assert {r.counter: r.n for r in G.extraction_stats(chunks).collect()} == {"json_parse_errors": 1, "type_conflicts": 1, "garbage_rejected": 1, "semantic_rejected": 1, "skipped_triplets": 2}
    e, r, _ = demo_graph(spark)
    texts = spark.createDataFrame([(0, "t0", "They tremble in panic."), (1, "t1", "Nothing here.")], "chunk_seq bigint, chunk_id string, text string")
    specs = spark.createDataFrame([("s1", ["TREMBLE"], json.dumps(told)), ("s2", ["never"], json.dumps({"entities": [{"id": "a", "name": "panic disorder", "type": "CONDITION"}, {"id": "f", "name": "dread", "type": "SYMPTOM"}], "relations": [{"source": "a", "target": "f", "relation": "HAS_SYMPTOM"}]}))], "spec string, hints array<string>, payload string")
    reset = spark.createDataFrame([("PANIC DISORDER", "TREATED_BY")], "subject string, relation string")
    _, rels = G.curated_repair((e, r), texts, specs, reset)
    assert {(x.relation, x.target): x.sources for x in rels.where("subject = 'PANIC DISORDER'").collect()} == {("HAS_SYMPTOM", "TREMBLING"): ["t0"], ("HAS_SYMPTOM", "DREAD"): ["s2"]}
    meta = G.with_lineage(G.with_lineage({}, {"directory": "x"}), {"directory": "x", "n": 2})
    assert meta == {"lineage": [{"directory": "x"}]} and len(G.with_lineage(meta, {"directory": "y"})["lineage"]) == 2


def test_three_systems_and_providers(spark):
    from quillgraph.operators import retrieval as R
    from quillgraph.plans.router import answer_parts

    e, r, c = demo_graph(spark)
    cases = spark.createDataFrame([(1, "What are the symptoms of depression?", "fatigue and loss of appetite"), (2, "best pizza recipe", "flour water salt")], "qid bigint, question string, ground_truth string")
    chunks = spark.createDataFrame([(1, "depression symptoms fatigue", "A"), (2, "pizza flour recipe", "B")], "chunk_id bigint, text string, citation string")
    rows = R.run_systems(cases, chunks, R.graph_contexts(answer_parts(cases.select("qid", "question"), e, r, c), c))
    got = {(x.qid, x.system): x for x in rows.collect()}
    assert len(got) == 6 and "FATIGUE" in got[1, "graph_rag"].answer and got[2, "graph_rag"].contexts == [] and "Citations:" in got[1, "graph_rag"].contexts[-1]
    metrics = R.answer_metrics(rows)
    assert {x.system for x in metrics.collect()} == {"vector_baseline", "vector_reranked", "graph_rag"} and metrics.collect()[0].faithfulness >= 0
    assert S.summary_markdown(metrics).first().markdown.count("|\n") == 5

    def fails(group):
        raise OSError("no judge")

    assert R.judged_metrics(rows, fails).count() == 3
    assert {x.faithfulness for x in R.judged_metrics(rows, lambda g: dict.fromkeys(["answer_relevancy", "context_precision", "context_recall", "faithfulness"], 0.5)).collect()} == {0.5}
    hits = R.lexical_search(cases, chunks)
    best = R.model_rerank(cases, hits, chunks, lambda pairs: [float(len(t)) for _, t in pairs], 1).collect()
    assert {(x.qid, x.chunk_id, x.score, x.rank) for x in best} == {(1, 1, 27.0, 1), (2, 2, 18.0, 1)}


def test_stores_and_guards(spark, tmp_path):
    members, told = spark.createDataFrame([(0, "A"), (0, "B")], "community_id bigint, name string"), spark.createDataFrame([(0, 2, "s")], "community_id bigint, size bigint, summary string")
    built = []
    build = lambda: built.append(1) or (members, told)
    for _ in range(2):
        m, t = S.load_or_build_communities(spark, str(tmp_path / "c"), build)
        assert m.count() == 2 and t.first().summary == "s" and built == [1]
    chunks, done = spark.createDataFrame([("a",), ("b",), ("c",)], "chunk_id string"), spark.createDataFrame([("a", "1", "h"), ("b", "1", "other")], "chunk_id string, version string, nodes_hash string")
    assert sorted(x.chunk_id for x in S.unprocessed(chunks, done, version="1", nodes_hash="h").collect()) == ["b", "c"]
    for n in range(2):
        S.append_progress(chunks, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 6
    waits, tries = [], iter([OSError(), OSError(), "done"])

    def call():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert S.with_retries(call, sleep=waits.append) == "done" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        S.require_same_nodes("a", "b")
    sources = spark.createDataFrame([("o1", "pending"), ("o2", "pending"), ("o3", "skipped_existing"), ("o4", "pending")], "output string, status string")
    done = spark.createDataFrame([("o1", "text", None), ("o2", None, "OSError: x"), ("o4", "", None)], "output string, markdown string, error string")
    assert {x.output: x.status for x in S.manifest_entries(sources, done).collect()} == {"o1": "converted", "o2": "failed", "o3": "skipped_existing", "o4": "failed"}
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.pdf").write_bytes(b"1")
    (tmp_path / "d" / "e" / "b.pdf").write_bytes(b"22")
    files = S.discover_files(spark, str(tmp_path / "d"))
    one = S.manifest_fingerprint(files).first().fingerprint
    assert sorted(x.size for x in files.collect()) == [1, 2] and one == S.manifest_fingerprint(files.repartition(2)).first().fingerprint != S.manifest_fingerprint(files.where("size = 1")).first().fingerprint
