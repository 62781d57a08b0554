"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopline.session import scratch_path

#: Words of the shingle and language-model contracts: anything but ASCII white space.
SPACE_WORD = "[^\\x20\\x09-\\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written below the shared scratch folder, with the writer's ``options``, and read back, which cuts its lineage and fixes its rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes empty. ``lower`` is faster and the same where no other letter has an upper case."""
    text = F.coalesce(text, F.lit(""))
    other_upper = text.rlike("[\\p{IsUppercase}\\p{Lt}&&[^A-Z]]")
    return F.when(other_upper, F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())).otherwise(F.lower(text))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % modulus


def hash_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """About ``n`` rows of ``df``, all if it has no more: those whose hash of ``keys`` is lowest.

    The bound on the hash comes from a count, so rows go nowhere to be compared; the sample misses ``n`` by a few times its root.
    Repeated rows fall on one hash, so twice ``n`` is a hard bound.
    """
    rows = df.count()
    u = F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))
    return df.filter(u < F.lit(n / max(rows, 1))).limit(2 * n)


def skewed_lookup(rows: DataFrame, values: DataFrame, key: str, support: float = 0.001) -> DataFrame:
    """Left join of ``rows`` with the narrow ``values`` (one row per key), both written tables, where a key may hold most rows.

    Values of the keys that can hold more than ``support`` of the rows, at most 1/support, are broadcast; the other keys
    are shuffled.
    """
    names = saved(rows.select(F.col(key).alias("_k")).freqItems(["_k"], support).select(F.explode("_k_freqItems").alias(key)), "hot_keys")
    hot = F.broadcast(values.join(F.broadcast(names), key, "left_semi"))
    rest = rows.join(F.broadcast(names), key, "left_anti").join(values, key, "left")
    return rows.join(F.broadcast(names), key, "left_semi").join(hot, key, "left").unionByName(rest)
