"""Versions of a store, increments of a fold, digest trees."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.sources import fingerprints as D
from quillgraph.sources import store
from quillgraph.sources import tables as S
from quillgraph.streaming import increments as I

E_COLUMNS = "name string, label string, description string, sources array<string>, ord bigint"
R_COLUMNS = "subject string, relation string, target string, description string, strength int, sources array<string>, ord bigint"


def files_of(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect())


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path)
    names = [(f"C{i}", "CONDITION", "", [], i) for i in range(60)] + [(f"S{i}", "SYMPTOM", "d", ["a"], 100 + i) for i in range(60)]
    links = [(f"C{i}", "HAS_SYMPTOM", f"S{j}", "", 3, ["a"], i * 60 + j) for i in range(60) for j in range(0, 60, 7)]
    e, r = spark.createDataFrame(names, E_COLUMNS), spark.createDataFrame(links, R_COLUMNS)
    assert store.latest(spark, path) == 0
    store.commit(spark, path, {"entities": (e, ["name"]), "relations": (r, ["subject"])}, buckets=16)
    first = files_of(path)
    new_e = spark.createDataFrame([("S1", "SYMPTOM", "longer", ["b"], 0), ("NEW", "SYMPTOM", "", ["b"], 1)], E_COLUMNS)
    new_r = spark.createDataFrame([("C5", "HAS_SYMPTOM", "NEW", "x", 9, ["b"], 0), ("C5", "HAS_SYMPTOM", "S0", "y", 9, ["b"], 1), ("C5", "HAS_SYMPTOM", "NOWHERE", "", 1, [], 2)], R_COLUMNS)
    assert store.upsert_graph(spark, path, new_e, new_r) == 2
    want_e, want_r = G.upsert((e, r), (new_e, new_r))
    assert rows(store.read(spark, path, "entities")) == rows(want_e) and rows(store.read(spark, path, "relations")) == rows(want_r)
    assert rows(store.read(spark, path, "entities", 1)) == rows(e)
    second = files_of(path)
    assert all(second[f] == at for f, at in first.items())
    kept = {r_.folder for r_ in store.listing(spark, path, 1)} & {r_.folder for r_ in store.listing(spark, path, 2)} - {""}
    assert len(kept) >= 16 + 16 - 3  # one bucket of relations and two of entities at most are new


def test_a_killed_write_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "k bigint, v string")
    store.commit(spark, path, {"t": (df, ["k"])}, buckets=4)
    # a write that dies before its version's table is whole
    changed = df.withColumn("v", F.lit("new"))
    changed.write.parquet(f"{path}/data/t/dead")
    os.makedirs(f"{path}/versions/2/_temporary")
    assert store.latest(spark, path) == 1 and rows(store.read(spark, path, "t")) == rows(df)
    with pytest.raises(Exception):
        store.commit(spark, path, {"t": (changed, ["k"])})
    store.recover(spark, path)
    assert store.commit(spark, path, {"t": (changed, ["k"])}, values={"x": 1}) == 2 and store.meta(spark, path) == {"x": 1}
    assert rows(store.read(spark, path, "t")) == rows(changed) and rows(store.read(spark, path, "t", 1)) == rows(df)
    assert store.commit(spark, path, {"none": (df.where("false"), ["k"])}) == 3 and store.read(spark, path, "none").count() == 0 and store.read(spark, path, "no") is None and rows(store.read(spark, path, "t")) == rows(changed)


def payloads(n=45, seed=3):
    rng = random.Random(seed)
    kinds = ["CONDITION", "SYMPTOM", "RISK_FACTOR", "TREATMENT", "DEMOGRAPHIC"]
    names = ["gloom", "fatigue", "fear", "worry", "insomnia", "panic", "exercise therapy", "adults", "grief"]
    out = []
    for i in range(n):
        entities = [{"id": f"e{k}", "name": rng.choice(names), "type": rng.choice(kinds[: rng.choice([2, 5])]), "description": "x" * rng.randint(0, 4) + str(i)} for k in range(rng.randint(0, 5))]
        relations = [{"source": f"e{rng.randint(0, 5)}", "target": f"e{rng.randint(0, 5)}", "relation": rng.choice(["has_symptom", "HAS_RISK_FACTOR", "TREATED_BY"]), "description": rng.choice(["", f"d{i}"]), "strength": rng.choice(["3", "8/10", "high"])} for _ in range(rng.randint(0, 30))]
        out.append((i * 3, f"k{i}", json.dumps({"entities": entities, "relations": relations}) if i % 9 else rng.choice(["", "{broken", None])))
    return out


def whole_build(spark, chunks):
    entities, relations = G.explode_payloads(spark.createDataFrame(chunks, I.CHUNKS))
    named = G.named_entities(entities)
    return G.fold_entities(named), G.fold_relations(named, relations)


def test_three_increments_equal_one_build(spark, tmp_path):
    path, chunks = str(tmp_path), payloads()
    want = [rows(df) for df in whole_build(spark, chunks)]
    assert len(want[1]) > 10
    for number, (a, b) in enumerate([(0, 14), (14, 30), (30, 45)]):
        part = spark.createDataFrame(chunks[a:b], I.CHUNKS)
        version = I.fold_increment(spark, path, part, number, buckets=8)
        assert version == number + 1 == I.fold_increment(spark, path, part, number)  # a repeated increment changes nothing
    e, r = I.folded_graph(spark, path)
    assert rows(e.select("name", "label", "description", "sources", "ord")) == want[0] and rows(r) == want[1]
    with pytest.raises(ValueError):
        I.fold_increment(spark, path, spark.createDataFrame(chunks[:1], I.CHUNKS), 7)
    before = {r_.folder for r_ in store.listing(spark, path)}
    one = [(9000, "k9", json.dumps({"entities": [{"id": "a", "name": "something new", "type": "SYMPTOM", "description": ""}], "relations": []}))]
    I.fold_increment(spark, path, spark.createDataFrame(one, I.CHUNKS), 8)
    assert len(before - {r_.folder for r_ in store.listing(spark, path)}) <= 1  # only the new name's bucket


def test_a_stream_of_files_folds_them_once(spark, tmp_path):
    chunks = payloads(20, 5)
    os.makedirs(tmp_path / "in")
    write = lambda k, part: (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(dict(zip(("chunk_seq", "chunk_id", "payload"), c))) + "\n" for c in part))
    run = lambda: I.fold_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    write("a", chunks[:12])
    run()
    write("b", chunks[12:])
    run()
    run()
    e, r = I.folded_graph(spark, str(tmp_path / "store"))
    want = whole_build(spark, chunks)
    assert rows(e.select("name", "label", "description", "sources", "ord")) == rows(want[0]) and rows(r) == rows(want[1]) and store.latest(spark, str(tmp_path / "store")) == 2


def test_digest_trees_find_and_place_changes(spark):
    chunks = [(i, f"text {i}") for i in range(700)]
    df = lambda xs: spark.createDataFrame(xs, "chunk_seq bigint, text string")
    tree = lambda xs: D.digest_tree(D.chunk_digests(df(xs)))
    base = tree(chunks)
    assert sorted((r.level, r.range, r.n_rows) for r in base.collect()) == [(1, 0, 256), (1, 1, 256), (1, 2, 188), (2, 0, 700)]
    hash_of = lambda xs: S.nodes_hash(df(xs)).first().nodes_hash
    own = hash_of(chunks)
    assert own == S.nodes_hash(df(chunks[::-1]).repartition(5)).first().nodes_hash
    swapped = [*chunks]
    swapped[10], swapped[300] = (10, chunks[300][1]), (300, chunks[10][1])
    one_byte = [(i, t + "." if i == 600 else t) for i, t in chunks]
    for changed, places in ((swapped, {0, 1}), (one_byte, {2}), (chunks[:-1], {2}), ([*chunks, chunks[5]], {0}), ([*chunks, (5000, None)], {19})):
        assert hash_of(changed) != own and {r.range for r in D.changed_ranges(base, tree(changed)).collect()} == places
    assert hash_of([]) == hash_of([]) != own and D.changed_ranges(base, tree(chunks)).count() == 0


def test_fingerprints_of_files_have_no_order(spark):
    files = [(f"f{i}", i, f"t{i}") for i in range(40)]
    df = lambda xs: spark.createDataFrame(xs, "file_name string, size bigint, text string")
    state = lambda xs: S.source_state(df(xs)).first().state
    assert state(files) == state(files[::-1]) and len({state(files), state(files[1:]), state([*files, files[0]]), state([("f0", 0, "t1"), *files[1:]]), state([])}) == 5
