"""Exact duplicates by a heavy-hitter split.

A Misra-Gries summary of the digests (Spark's ``freqItems``) names every digest that can hold more than ``SUPPORT`` of the rows, and at most 1/SUPPORT
digests in all. An exact count over all rows verifies them; the verified ones, with their winners, are broadcast and
settle their rows on the map side. The rows that remain have no such digest and are settled by an ordinary shuffle.

Null text counts as empty text. Of rows with equal texts that with the largest doc_id wins (a null doc_id is smallest);
of repeated rows with that doc_id, exactly one. Very long texts are digested whole, an empty table gives no rows, and helper columns take names that the table does
not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoopline.llm.common import free_name, read_table, saved

SUPPORT = 0.001


def heavy_groups(keyed: DataFrame, key: str, rank: Column) -> DataFrame:
    """Verified heavy values of ``key`` with their row count ``_n`` and largest ``rank`` as ``_best``; below 1/SUPPORT rows.

    Written, so that every reader sees the same values however often its tasks run.
    """
    names = keyed.select(F.col(key).alias("_key")).freqItems(["_key"], SUPPORT).select(F.explode("_key_freqItems").alias(key))
    rows = keyed.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = keyed.join(F.broadcast(names), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(rank).alias("_best"))
    return saved(counted.filter(F.col("_n") > rows * SUPPORT), "heavy")


def best_of_group(keyed: DataFrame, key: str, rank: Column) -> DataFrame:
    """``keyed`` with ``_n`` and ``_best`` of each row's group; ``keyed`` must be a written table."""
    heavy = F.broadcast(heavy_groups(keyed, key, rank))
    group = Window.partitionBy(key)
    rest = keyed.join(heavy, key, "left_anti").withColumns({"_n": F.count(F.lit(1)).over(group), "_best": F.max(rank).over(group)})
    return keyed.join(heavy, key).unionByName(rest)


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def keep_one_copy(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the copies, all columns as they were."""
    digest, rank = free_name(docs, "digest"), free_name(docs, "rank")
    with_digest = docs.withColumn(digest, text_digest(F.col(text_column)))
    keyed = saved(with_digest.select(F.col(digest).alias("_digest"), F.col(id_column).alias("_id")), "digests")
    heavy = F.broadcast(heavy_groups(keyed, "_digest", F.struct("_id")).select("_digest", F.col("_best._id").alias("_id")))
    same = with_digest[digest] == heavy["_digest"]
    winners = with_digest.join(heavy, same & with_digest[id_column].eqNullSafe(heavy["_id"]), "left_semi")
    rest = with_digest.join(heavy, same, "left_anti")
    # Winners are few (one row of each heavy digest, or repeated rows of it) and all other groups are small: one shuffle.
    order = Window.partitionBy(digest).orderBy(F.col(id_column).desc_nulls_last())
    return winners.unionByName(rest).withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(*docs.columns)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the id that stays for its text, the size of its group and the digest of its text."""
    keyed = saved(
        read_table(spark, sf_dir, "documents").select("doc_id", F.monotonically_increasing_id().alias("row_no"), text_digest(F.col("text")).alias("text_sha256")),
        "digests",
    )
    return best_of_group(keyed, "text_sha256", F.struct("doc_id", "row_no")).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_best.row_no") == F.col("row_no")).alias("kept"),
        "text_sha256",
    )
