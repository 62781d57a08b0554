"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, ranges, overfull ranges split again.

Records are put in the order (key, tie). Splitters drawn from a size-weighted sample cut that order into many more
ranges than shards; a range that came out overfull is cut again by splitters sampled inside it, so a key that holds a
third of the rows is spread over as many ranges as its bytes ask for (the tie column separates its rows). Exact running
sizes inside each range, added to the sizes of the ranges before, then place every record: shard k takes the bytes from
k/shards to (k+1)/shards of the total, so shards differ by less than one record at each end.

What is kept whole in one place is the splitters and one row of totals per range: at most ``MAX_RANGES`` before the second cut,
and about twice that after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoopline.llm.common import saved

MAX_RANGES = 65_536
ROWS_PER_RANGE = 50_000
RANGES_PER_SHARD = 64
SAMPLE_PER_RANGE = 32


def _drawn(records: DataFrame, target: float, seed: int) -> DataFrame:
    """Rows drawn with a chance in proportion to their size; the draw is a hash, so a repeated task draws the same."""
    u = F.shiftrightunsigned(F.xxhash64("_key", "_tie", F.lit(seed)), 11) / F.lit(float(1 << 53))
    return records.filter(u < F.col("_size") * F.lit(SAMPLE_PER_RANGE / target))


def _splitters(sample: DataFrame) -> DataFrame:
    """One row: every SAMPLE_PER_RANGE-th (key, tie) of the sorted sample."""
    whole = F.array_sort(F.collect_list(F.struct("_key", "_tie")))
    return sample.agg(F.filter(whole, lambda x, i: i % SAMPLE_PER_RANGE == SAMPLE_PER_RANGE - 1).alias("s"))


def _constant(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _range_of(splitters: list) -> Column:
    """How many splitters are at or below the row's (key, tie): a binary search, one step for each bit of their number."""
    keys, ties = _constant([x["_key"] for x in splitters]), _constant([x["_tie"] for x in splitters])

    def step(at, bit):
        next_at = at + F.call_function("shiftleft", F.lit(1), bit)
        k = F.get(keys, next_at - 1)
        below = (k < F.col("_key")) | ((k == F.col("_key")) & (F.get(ties, next_at - 1) <= F.col("_tie")))
        return F.when((next_at <= len(splitters)) & below, next_at).otherwise(at)

    bits = F.array(*[F.lit(b) for b in reversed(range(max(1, len(splitters).bit_length())))])
    return F.aggregate(bits, F.lit(0), step)


def range_shards(records: DataFrame, key: str, tie: str, size: str, shards: int) -> DataFrame:
    """``records`` (narrow, written once) with ``shard`` and ``slot``; near equal sums of ``size``.

    ``key`` is a long, ``tie`` a long that tells rows of one key apart (nulls come first), ``size`` a positive long. No rows in, no
    rows out. Rows equal in key and tie stay in one range in no set order. Column names starting with an underscore are taken.
    """
    base = records.withColumns({"_key": F.col(key), "_tie": F.coalesce(F.col(tie), F.lit(-(1 << 63))), "_size": F.col(size)})
    total, rows = base.agg(F.sum("_size"), F.count(F.lit(1))).first()
    ranges = min(MAX_RANGES, max(RANGES_PER_SHARD * shards, -(-rows // ROWS_PER_RANGE)))
    target = max(1.0, (total or 0) / ranges)

    first = _splitters(_drawn(base, target, 1)).first()["s"]
    ranged = base.withColumn("_range", _range_of(first))
    overfull = ranged.groupBy("_range").agg(F.sum("_size").alias("_bytes")).filter(F.col("_bytes") > 2 * target)
    # At most ranges / 2 rows: each holds more than two targets of the total.
    inside = _drawn(ranged, target, 2).join(F.broadcast(overfull), "_range", "left_semi")
    second = _splitters(inside).first()["s"]
    ranged = base.withColumn("_range", _range_of(sorted({*first, *second})))

    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("_range")
        .agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        .select(
            "_range",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        )
    )
    inner = Window.partitionBy("_range").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    middle = 2 * (F.col("_bytes_before") + F.sum("_size").over(inner)) - F.col("_size")
    place = F.col("_rows_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_key", "_tie")) - 1
    placed = saved(
        ranged.join(F.broadcast(totals), "_range").select(
            *records.columns,
            F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * (total or 1))).cast("int")).alias("shard"),
            place.alias("_place"),
        ),
        "placed",
    )
    starts = placed.groupBy("shard").agg(F.min("_place").alias("_start"))  # one row per shard
    return placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("_place") - F.col("_start")).drop("_place", "_start")


def op3_sharding(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in ``shards`` shards of near equal bytes, in the order of a digest of the text, then doc_id.

    Equal texts lie side by side, so a group of copies is in one shard or in neighbouring ones. Null text counts as empty, with size 16; very long texts count whole.
    """
    from hoopline.llm.common import read_table

    text = F.coalesce("text", F.lit(""))
    records = saved(
        read_table(spark, sf_dir, "documents").select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("text_key"),
        ),
        "keyed",
    )
    return range_shards(records, "text_key", "doc_id", "size", shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
