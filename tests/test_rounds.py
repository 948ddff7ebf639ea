"""Rounds and memory of what the larger tables of round 3 asked for."""

import random

from pyspark.sql import functions as F

from quillgraph.operators import communities as CM


def test_moves_take_few_rounds_and_none_is_taken_back(spark, monkeypatch):
    rng, staged, stage = random.Random(5), [], CM.stage
    edges = sorted({(f"s{rng.randrange(40):02d}", f"p{i:03d}") for i in range(80) for _ in range(6)})
    levels, shares = [], []

    def counted(df, name="table", *rest):
        out = stage(df, name, *rest)
        staged.append(name)
        if name == "graph_edges":
            levels.append(out)
        if name == "graph_moves":
            of = out.select("name", "community")
            inside = levels[-1].join(of.select(F.col("name").alias("a"), F.col("community").alias("ca")), "a").join(of.select(F.col("name").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n")).first().n
            total = out.first().total
            shares.append((len(levels), inside * total - sum(r.d**2 for r in out.groupBy("community").agg(F.sum("degree").alias("d")).collect())))
        return out

    monkeypatch.setattr(CM, "stage", counted)
    CM.communities(spark.createDataFrame(edges, "subject string, target string")).collect()
    # random halves of the nodes that gain took 34 rounds
    assert staged.count("graph_moves") <= 20
    assert len(shares) > 5 and all(y[1] > x[1] for x, y in zip(shares, shares[1:]) if x[0] == y[0])


def test_texts_are_cut_only_where_their_shapes_meet(spark, monkeypatch):
    from quillgraph.operators import linking as L

    def run(n):
        staged, stage = {}, L.stage

        def counted(df, name="table", *rest):
            out = stage(df, name, *rest)
            staged[name] = staged.get(name, 0) + out.count()
            return out

        with monkeypatch.context() as m:
            m.setattr(L, "stage", counted)
            names = spark.range(1000, 1000 + n).select(F.concat(F.lit("PART "), "id").alias("name"), F.lit("PART").alias("label"))
            asked = spark.range(1000, 1000 + n).select(F.col("id").alias("qid"), F.concat(F.lit("where is pat "), "id", F.lit(" then")).alias("question"))
            found = L.link_fuzzy(asked, names)
            assert {(r.qid, r.name) for r in found.where("rank = 1").collect()} == {(k, f"PART {k}") for k in range(1000, 1000 + n)}
        return staged["fuzzy_cuts"], staged["fuzzy_rests"]

    assert run(20) == run(200)


def test_sources_of_supplies_are_bits_until_summed_up(spark, tmp_path):
    from quillgraph.plans.star import star_graph

    tables = {
        "region": ([(0, "asia")], "r_regionkey int, r_name string"), "nation": ([(0, "japan", 0)], "n_nationkey int, n_name string, n_regionkey int"), "supplier": ([(1, "s", 0)], "s_suppkey bigint, s_name string, s_nationkey int"),
        "part": ([(7, "p", "b", "t"), (8, "q", "b", "t")], "p_partkey bigint, p_name string, p_brand string, p_type string"),
        "lineitem": ([(1, 7, k) for k in (21, 1, 10, -3, -21, 9, 19, None)] + [(1, 8, None), (1, None, 4)], "l_suppkey bigint, l_partkey bigint, l_orderkey bigint"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    supplies = star_graph(spark, str(tmp_path))[1].where("relation = 'SUPPLIES'")
    assert {(r.target, tuple(r.sources), r.strength, r.ord) for r in supplies.collect()} == {("PART 7", ("-1", "-3", "0", "1", "9"), 8, -21), ("PART 8", (), 1, None), (None, ("4",), 1, 4)}
    assert "ObjectHashAggregate" not in supplies._jdf.queryExecution().executedPlan().toString()


def test_names_are_judged_and_supplies_summed_up_once(spark, monkeypatch):
    from quillgraph.operators import graph as G
    from quillgraph.plans import queries as PQ
    from quillgraph.plans.star import STAR, star_graph

    staged = []

    def counted(of):
        return lambda df, name="table", *rest: (staged.append(name), of(df, name, *rest))[1]

    for module in (G, PQ):
        monkeypatch.setattr(module, "stage", counted(module.stage))
    G.clean_graph(*star_graph(spark, "/root/testdata/sf0.001"), STAR)
    PQ.structural_checks(spark, "/root/testdata/sf0.001")
    assert staged == ["kept_entities", "supplies"]


def test_links_are_read_in_one_round_and_contracted(spark, monkeypatch):
    from quillgraph.operators import components as CO

    staged = []
    monkeypatch.setattr(CO, "stage", lambda df, name="table", of=CO.stage: (staged.append((name, of(df, name))), staged[-1][1])[1])
    # a sorted path, and a hub whose leaves are all smaller than it
    links = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(70)] + [(f"m{k}", "z") for k in range(5)] + [("x", "x"), (None, "y")]
    sizes = []
    monkeypatch.setattr(CO, "discard", lambda *dfs, of=CO.discard: (sizes.extend(df.count() for df in dfs if "c_edges" in df._stage_path), of(*dfs))[1])
    out = {r.node: r.component for r in CO.components(spark.createDataFrame(links, "a string, b string"), "c").collect()}
    assert out == {**{f"n{k:03d}": "n000" for k in range(71)}, **{f"m{k}": "m0" for k in range(5)}, "z": "m0"}
    assert sizes == [75, 4, 0]


def test_lines_are_dealt_before_they_are_summed_up(spark):
    from quillgraph.plans.star import star_graph

    plan = star_graph(spark, "/root/testdata/sf0.001")[1].where("relation = 'SUPPLIES'")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_lookups_read_only_relations_of_named_entities(spark):
    from quillgraph.plans.router import _touched

    relations = spark.createDataFrame([("a", "R", "b", ["1"]), ("c", "R", "a", ["2"]), ("a", "R", "a", []), ("c", "R", "d", ["3"]), (None, "R", "d", ["4"])], "subject string, relation string, target string, sources array<string>")
    linked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "none")], "qid int, name string")
    out = _touched(relations, linked)
    assert out.columns == relations.columns and sorted((r.subject, r.target) for r in out.collect()) == [("a", "a"), ("a", "b"), ("c", "a")]


def test_neighbours_move_at_once_where_lost_links_cost_less_than_is_gained(spark):
    from quillgraph.operators import communities as CM

    both = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "a bigint, b bigint, w bigint")
    for more, moved in ((5_000, {1: 20, 2: 30}), (900, {1: 20})):
        plan = spark.createDataFrame([(1, 1, 1_000, 10, 0, 20, 1 << 20), (2, 1, 1_000, 20, 0, 30, more)], "name bigint, degree bigint, total bigint, community bigint, round int, best bigint, more bigint")
        assert {r.name: r.to for r in CM._turns(both, plan, False).collect()} == moved
