"""Fingerprints as digest trees: a digest for each row, one for each range of rows, one for each range of ranges, up to one.

Digests are SHA-256 of what lies below, in order, so no two states share one by the arithmetic of sums; two trees tell
which ranges differ without a look at the rows. A node has ``FAN`` children at most, besides rows that share a position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.staging import stage

FAN = 256


def row_digest(*columns: Column) -> Column:
    """SHA-256 of the columns, each led by its length in bytes, so that no two rows read alike; null is told from empty."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(",", *told), 256)


def _joined() -> Column:
    """Digests below a node, in order of position, then of digest; equal ones with how often they stand."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest", "n"))), lambda x: F.concat(x["digest"], F.lit("*"), x["n"].cast("string"))), ","), 256)


def digest_tree(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """(level, range, digest, n_rows) of rows (pos, digest): level 1 covers ``fan`` positions a range, each further level ``fan`` ranges, the last one everything."""
    level, below = 1, rows.groupBy("pos", "digest").agg(F.count("*").alias("n")).withColumn("rows", F.col("n"))
    out = None
    while True:
        node = below.groupBy(F.floor(F.col("pos") / F.lit(fan)).cast("bigint").alias("range")).agg(_joined().alias("digest"), F.sum("rows").alias("n_rows"))
        node = stage(node.select(F.lit(level).alias("level"), "range", "digest", "n_rows"), "digests")
        out = node if out is None else out.unionByName(node)
        if node.limit(2).count() < 2:
            return out
        level, below = level + 1, node.select(F.col("range").alias("pos"), "digest", F.lit(1).cast("bigint").alias("n"), F.col("n_rows").alias("rows"))


def root(tree: DataFrame, name: str) -> DataFrame:
    """One row: the digest of everything; that of no rows is the digest of the empty text."""
    return tree.agg(F.coalesce(F.max_by("digest", "level"), F.sha2(F.lit(""), 256)).alias(name))


def changed_ranges(before: DataFrame, after: DataFrame, level: int = 1) -> DataFrame:
    """(range): the ranges of a level that differ between two trees, those that only one has among them."""
    own = lambda tree, name: tree.where(F.col("level") == level).select("range", F.col("digest").alias(name))
    return own(before, "a").join(own(after, "b"), "range", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("range")


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """(pos, digest) of chunks (chunk_seq, text): the original text and, where there are such columns, id, file, header path and section."""
    told = [F.col(c) for c in ("chunk_id", "file_path", "header_path", "section_title") if c in chunks.columns]
    text = F.col("original_text" if "original_text" in chunks.columns else "text")
    return chunks.select(F.col("chunk_seq").cast("bigint").alias("pos"), row_digest(F.col("chunk_seq"), text, *told).alias("digest"))


def named_digests(files: DataFrame, key: str, *columns: str) -> DataFrame:
    """(pos, digest) of rows without an order: the position is a hash of the key, so that equal states have equal trees however many rows there are."""
    return files.select(F.conv(F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, 10), 16, 10).cast("bigint").alias("pos"), row_digest(F.col(key), *(F.col(c) for c in columns)).alias("digest"))
