"""The driver tables as a property graph: the same operators under another ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.config import Ontology
from quillgraph.sources.staging import tasks

#: Lines of a task that sums them up, whatever the splits of their files.
LINES = 500_000

STAR = Ontology(
    priority={"SUPPLIER": 6, "PART": 5, "BRAND": 4, "PTYPE": 3, "NATION": 2, "REGION": 1},
    triples=[("NATION", "IN_REGION", "REGION"), ("SUPPLIER", "IN_NATION", "NATION"), ("PART", "HAS_BRAND", "BRAND"), ("PART", "HAS_TYPE", "PTYPE"), ("SUPPLIER", "SUPPLIES", "PART")],
    forbidden=[],
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations). A supply's strength is its number of lines up to 10; its sources are the orders' last digits."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.array().cast("array<string>").alias("sources")

    def ents(df: DataFrame, name, label: str, description, ord_) -> DataFrame:
        return df.select(name.alias("name"), F.lit(label).alias("label"), description.alias("description"), none, ord_.cast("bigint").alias("ord"))

    supplier, part = F.concat(F.lit("SUPPLIER "), F.col("s_suppkey")), F.concat(F.lit("PART "), F.col("p_partkey"))
    kinds = lambda c: t("part").groupBy(c).agg(F.min("p_partkey").alias("ord"))
    entities = (
        ents(t("region"), F.upper("r_name"), "REGION", F.lit(""), F.col("r_regionkey"))
        .unionByName(ents(t("nation"), F.upper("n_name"), "NATION", F.lit(""), F.col("n_nationkey") + 100))
        .unionByName(ents(t("supplier"), supplier, "SUPPLIER", F.col("s_name"), F.col("s_suppkey") + 1000))
        .unionByName(ents(t("part"), part, "PART", F.col("p_name"), F.col("p_partkey") + 10_000_000))
        .unionByName(ents(kinds("p_brand"), F.upper("p_brand"), "BRAND", F.lit(""), F.col("ord") + 20_000_000))
        .unionByName(ents(kinds("p_type"), F.upper("p_type"), "PTYPE", F.lit(""), F.col("ord") + 30_000_000))
    )

    def rels(df: DataFrame, subject, relation: str, target, strength, sources, ord_) -> DataFrame:
        return df.select(subject.alias("subject"), F.lit(relation).alias("relation"), target.alias("target"), F.lit("").alias("description"), strength.cast("int").alias("strength"), sources.alias("sources"), ord_.cast("bigint").alias("ord"))

    empty, five = F.array().cast("array<string>"), F.lit(5)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    home = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    # nearly every line is a supply of its own: dealt first, no task holds the sums of a whole split before it deals them
    dealt = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey").repartition(tasks(t("lineitem"), LINES), "l_suppkey", "l_partkey")
    lines = dealt.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("l_orderkey") % 10 + 9).cast("int"))).alias("digits"), F.min("l_orderkey").alias("ord"))
    # the last digits are bits of one number until the supplies are summed up: no sets grow in memory, and nothing is sorted for them
    held = F.array(*[F.when(F.col("digits").bitwiseAND(F.lit(1 << (k + 9))) != 0, F.lit(str(k))) for k in sorted(range(-9, 10), key=str)])
    lines = lines.withColumn("chunks", F.array_compact(held))
    relations = (
        rels(nation, F.upper("n_name"), "IN_REGION", F.upper("r_name"), five, empty, F.col("n_nationkey"))
        .unionByName(rels(home, supplier, "IN_NATION", F.upper("n_name"), five, empty, F.col("s_suppkey")))
        .unionByName(rels(t("part"), part, "HAS_BRAND", F.upper("p_brand"), five, empty, F.col("p_partkey")))
        .unionByName(rels(t("part"), part, "HAS_TYPE", F.upper("p_type"), five, empty, F.col("p_partkey")))
        .unionByName(rels(lines, F.concat(F.lit("SUPPLIER "), F.col("l_suppkey")), "SUPPLIES", F.concat(F.lit("PART "), F.col("l_partkey")), F.least(F.lit(10), F.col("n")), F.col("chunks"), F.col("ord")))
    )
    return entities, relations


#: The same graph in SQL.
STAR_SQL = """
    ents AS (
        SELECT upper(r_name) AS name, 'REGION' AS label, '' AS description, CAST(r_regionkey AS BIGINT) AS ord FROM region UNION ALL
        SELECT upper(n_name), 'NATION', '', n_nationkey + 100 FROM nation UNION ALL
        SELECT 'SUPPLIER ' || s_suppkey, 'SUPPLIER', s_name, s_suppkey + 1000 FROM supplier UNION ALL
        SELECT 'PART ' || p_partkey, 'PART', p_name, p_partkey + 10000000 FROM part UNION ALL
        SELECT upper(p_brand), 'BRAND', '', min(p_partkey) + 20000000 FROM part GROUP BY p_brand UNION ALL
        SELECT upper(p_type), 'PTYPE', '', min(p_partkey) + 30000000 FROM part GROUP BY p_type
    ), rels AS (
        SELECT upper(n_name) AS subject, 'IN_REGION' AS relation, upper(r_name) AS target, 5 AS strength, CAST(n_nationkey AS BIGINT) AS ord, '' AS sources FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
        SELECT 'SUPPLIER ' || s_suppkey, 'IN_NATION', upper(n_name), 5, s_suppkey, '' FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL
        SELECT 'PART ' || p_partkey, 'HAS_BRAND', upper(p_brand), 5, p_partkey, '' FROM part UNION ALL
        SELECT 'PART ' || p_partkey, 'HAS_TYPE', upper(p_type), 5, p_partkey, '' FROM part UNION ALL
        SELECT 'SUPPLIER ' || l_suppkey, 'SUPPLIES', 'PART ' || l_partkey, CAST(least(10, count(*)) AS INTEGER), min(l_orderkey), array_to_string(list_sort(list_distinct(list(CAST(l_orderkey % 10 AS VARCHAR)))), ',')
        FROM lineitem GROUP BY l_suppkey, l_partkey
    )"""
