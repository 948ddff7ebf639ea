"""Searches, dense retrieval and repair scores in the forms made for scale, against plain versions."""

import random

import numpy as np
import pytest

from quillgraph.operators import graph as G
from quillgraph.operators import lookup as Q
from quillgraph.operators import retrieval as R


def test_substrings_are_found_by_runs(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc1") for _ in range(n))
    hays = [(i, " ".join(word(rng.randint(1, 7)) for _ in range(rng.randint(0, 6)))) for i in range(150)] + [(900, ""), (901, "éa😀b"), (902, None)]
    terms = sorted({word(rng.randint(1, 6)) for _ in range(120)} | {"zzz", "z", "éa", "a😀b"})
    df = spark.createDataFrame(hays, "id bigint, hay string")
    for shortest in (1, 2, 3):
        asked = spark.createDataFrame([(t,) for t in terms] * 2, "term string")
        got = Q.substring_hits(asked, df, ["id"], shortest).collect()
        assert sorted((r.term, r.id) for r in got) == sorted((t, i) for t in terms if len(t) >= shortest for i, h in hays if t in (h or ""))


def test_searches_have_no_nested_loop(spark):
    questions = spark.createDataFrame([(1, "abc of part 12"), (2, "abc")], "qid int, question string")
    entities = spark.createDataFrame([("PART 12", "P", "abc"), ("PART 13", "P", None)], "name string, label string, description string")
    for found in (Q.keyword_search(questions, entities), Q.store_text_search(questions, entities), Q.summary_search(questions, entities.selectExpr("1L as community_id", "name as summary"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.qid, r.name): r.score for r in Q.keyword_search(questions, entities).collect()}
    assert got == {(1, "PART 12"): 2, (1, "PART 13"): 1, (2, "PART 12"): 1}


def plain_top(queries, vectors, top):
    out = []
    for qid, q in queries:
        scored = []
        for vid, v in vectors:
            if q and v and len(q) == len(v) and all(x is not None and np.isfinite(x) for x in [*q, *v]) and any(q) and any(v):
                a, b = np.array(q, float), np.array(v, float)
                scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), vid))
        out += [(qid, vid, -s, i + 1) for i, (s, vid) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("most_bytes,block", [(1 << 20, 32768), (1 << 20, 37), (900, 50)])
def test_dense_search_in_blocks(spark, most_bytes, block):
    rng = np.random.default_rng(5)
    f = lambda x: [float(np.float32(v)) for v in x]
    vectors = [(i, f(rng.normal(size=6))) for i in range(200)]
    vectors += [(1000 + i, vectors[i][1]) for i in range(20)] + [(2000, None), (2001, [0.0] * 6), (2002, [float("nan")] * 6), (2003, [None] * 6), (2004, []), (2005, f(rng.normal(size=4))), (2006, f(rng.normal(size=4)))]
    queries = [(i, v) for i, v in vectors if i % 10 == 0] + [(3000, None), (3001, [1.0, 2.0, 0.5, 0.1]), (3002, [])]
    got = R.dense_search(spark.createDataFrame(queries, "qid bigint, query array<float>").repartition(3), spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(4), 5, most_bytes, block).collect()
    assert sorted((r.qid, r.vec_id, r.score, r["rank"]) for r in got) == plain_top(queries, vectors, 5)


def test_dense_search_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert R.dense_search(none.selectExpr("vec_id as qid", "embedding as query"), none).count() == 0


def norm(text):
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").upper()).split())


def plain_repair(chunks, targets, top=6, least=18):
    """The best chunks of each target, every chunk looked at for every target."""
    out = []
    for target, aliases, hints in targets:
        scores, anchors = {}, []
        for seq, section, context, text in chunks:
            whole = norm(" ".join(x for x in (section, context, text) if x))
            c, s, lead = norm(context), norm(section), norm((text or "")[:220])
            score = 20 * any(a in c for a in aliases) + 18 * any(a in whole for a in aliases) + 12 * any(a.replace(" ", "") in whole.replace(" ", "") for a in aliases)
            for h in {norm(h) for h in hints}:
                score += 12 if h in s else 5 if h in whole else 0
            scores[seq] = score
            if any(a in c[: max(len(a) + 20, 80)] or s.startswith(a) or a in lead for a in aliases):
                anchors.append(seq)
        clusters = []
        for seq in sorted(anchors):
            if clusters and seq - clusters[-1][-1] <= 4:
                clusters[-1].append(seq)
            else:
                clusters.append([seq])
        best = max(clusters, key=lambda c: (len(c), -c[0]), default=None)
        kept = []
        for seq, score in scores.items():
            if best:
                far = max(best[0] - seq, seq - best[-1], 0)
                if far > 6 and score < least + 10:
                    continue
                score += 18 if far <= 1 else 10 if far <= 3 else 4 if far <= 6 else 0
            if score >= least:
                kept.append((-score, seq))
        out += [(target, seq, -s, i + 1) for i, (s, seq) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("at_once", [10_000, 7])
def test_repair_scores_by_one_automaton(spark, at_once):
    rng = random.Random(4)
    words = ["panic", "disorder", "mood", "manic", "sleep", "of", "the", "fear", "Criteria", "course-", "x", "a"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    chunks = [(i, text(rng.randint(0, 2)), text(rng.randint(0, 3)) if rng.random() < 0.3 else None, text(rng.randint(0, 40)) if rng.random() < 0.6 else "zzz") for i in range(0, 130) if i % 11]
    targets = [(f"T{k}", sorted({norm(text(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))}), [text(rng.randint(1, 2)) for _ in range(rng.randint(0, 3))]) for k in range(30)] + [("NONE", ["QQQ"], []), ("LATE", ["SLEEP FEAR"], ["criteria"])]
    df = spark.createDataFrame(chunks, "chunk_seq bigint, section string, context string, text string")
    scores = G.repair_scores(df, spark.createDataFrame(targets, "target string, aliases array<string>, hints array<string>"), at_once)
    got = sorted(map(tuple, G.select_repair_chunks(scores, chunks=df).collect()))
    assert got == plain_repair(chunks, targets) and len(got) > 60
    wanted = spark.createDataFrame([("T1", 5), ("T1", 3), ("T1", 999999)], "target string, chunk_seq bigint")
    got = G.select_repair_chunks(scores, chunks=df, preferred=wanted).collect()
    assert [(r.chunk_seq, r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r.target == "T1"] == [(3, 1), (5, 2)] and {r.target for r in got} == {t for t, *_ in plain_repair(chunks, targets)} | {"T1"}


def test_aliases_of_conditions(spark):
    rows = [("Post-Traumatic Stress Disorder", "CONDITION"), ("POST TRAUMATIC STRESS DISORDER", "CONDITION"), ("PANIC", "CONDITION"), ("FATIGUE", "SYMPTOM")]
    got = {r.target: r.aliases for r in G.condition_aliases(spark.createDataFrame(rows, "name string, label string")).collect()}
    assert got == {"Post-Traumatic Stress Disorder": ["POST TRAUMATIC STRESS DISORDER"], "POST TRAUMATIC STRESS DISORDER": ["POST TRAUMATIC STRESS DISORDER"], "PANIC": ["PANIC"]}


def test_a_repeated_qid_is_an_error(spark):
    from quillgraph.plans.demo import demo_graph
    from quillgraph.plans.router import answer_questions

    with pytest.raises(ValueError):
        answer_questions(spark.createDataFrame([(1, "what is depression"), (1, "and ptsd")], "qid bigint, question string"), *demo_graph(spark))
