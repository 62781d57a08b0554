"""Benchmark decontamination by a prefix-filtered set join.

An item window is ten consecutive item words (an item of fewer words is one window). A window's tokens are its shingles
of ``q`` words, q being 4, 2 or 1, the largest that fits. All tokens are ordered by how often the documents hold them;
a window that must be contained whole needs all its tokens, so its rarest one is a sufficient prefix. Document shingles
are joined with these prefix tokens only; the token's place in the window gives the one start it allows (position),
which must leave room for the whole window (length), and the words are then compared one by one.

Documents are read once, for the places of window tokens, each with the few words that a window around it can span. The
tokens are broadcast in blocks of at most ``BLOCK_BYTES``; a larger benchmark takes more passes over the documents.

Null text or text without words has no words and no hits. Repeated items share windows and are all reported. Documents
are told apart by id and text; repeated rows of both get the same result, once for each row. Column names starting with
an underscore are taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopline.llm.common import lower_ascii, read_table, saved

WINDOW = 10
SIZES = (4, 2, 1)
BLOCK_BYTES = 32 << 20
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def _shingles(words: Column, q: int) -> Column:
    """Digests of the ``q`` words (1, 2 or 4) from each position on that has as many."""
    s, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < q:
        s = F.zip_with(s, F.slice(s, F.lit(step + 1), F.greatest(F.size(s), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        step *= 2
    return F.slice(s, F.lit(1), F.greatest(F.size(words) - (q - 1), F.lit(0)))


def item_windows(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Distinct windows with the sorted ids of the items that hold them, and their shingle size ``_q``."""
    words = items.select(F.col(id_column).cast("string").alias("_item"), words_of(F.col(text_column)).alias("_w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (WINDOW - 1), F.lit(1)))
    windows = words.filter(F.size("_w") > 0).select("_item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, WINDOW))).alias("_window"))
    n = F.size("_window")
    q = reduce(lambda rest, size: F.when(n >= size, size).otherwise(rest), reversed(SIZES[:-1]), F.lit(1))
    return windows.groupBy("_window").agg(F.collect_set("_item").alias("_items")).withColumn("_q", q)


def _window_tokens(windows: DataFrame) -> DataFrame:
    by_size = reduce(lambda rest, q: F.when(F.col("_q") == q, _shingles(F.col("_window"), q)).otherwise(rest), SIZES[:-1], _shingles(F.col("_window"), 1))
    return windows.select("*", F.posexplode(by_size).alias("_offset", "_token"))


def _document_tokens(words: DataFrame, sizes: list[int]) -> DataFrame:
    """Shingles with ``_pos`` from 1; in front of them, each row has one token 0 at ``_pos`` 0 that stands for the row."""
    own = F.array(F.lit(0).cast("long"))
    if len(sizes) == 1:
        return words.select("*", F.posexplode(F.concat(own, _shingles(F.col("_w"), sizes[0]))).alias("_pos", "_token"), F.lit(sizes[0]).alias("_size"))
    each = F.array(*[F.struct(F.lit(q).alias("q"), _shingles(F.col("_w"), q).alias("s")) for q in sizes])
    split = words.select("*", F.explode(each).alias("_e"))
    rows = split.select(*words.columns, F.col("_e.q").alias("_size"), F.posexplode(F.concat(own, "_e.s")).alias("_pos", "_token"))
    return rows.filter((F.col("_pos") > 0) | (F.col("_size") == sizes[0]))


def window_hits(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document row: id, ``_text_hash``, n_words, n_hit, ``items`` (sorted texts of item ids)."""
    windows = saved(item_windows(items), "windows")
    sizes = sorted((r["_q"] for r in windows.select("_q").distinct().collect()), reverse=True) or [SIZES[0]]  # three at most
    text = F.col(text_column)
    words = docs.select(
        F.col(id_column).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_text_hash"), words_of(text).alias("_w")
    )

    # One pass over the documents: the places of all window tokens, with the words around them for the check.
    tokens = saved(_window_tokens(windows), "window_tokens")
    distinct = saved(tokens.select("_token", F.col("_q").alias("_size")).distinct(), "distinct_tokens")
    row_mark = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("_token"), F.lit(sizes[0]).alias("_size"), F.lit(True).alias("_row"))
    first_word = F.greatest(F.col("_pos") - (WINDOW - 1), F.lit(1))
    places = []
    for k, block in enumerate(_blocks(distinct, F.lit(24), F.col("_token"))):
        block = block.withColumn("_row", F.lit(False))
        block = block.unionByName(row_mark) if k == 0 else block
        found = _document_tokens(words, sizes).join(F.broadcast(block), ["_token", "_size"]).filter(F.col("_row") == (F.col("_pos") == 0))
        around = F.when(~F.col("_row"), F.slice("_w", first_word, 2 * WINDOW - 1))
        places.append(found.select("_id", "_text_hash", F.size("_w").alias("_n"), "_row", "_token", "_size", "_pos", first_word.alias("_from"), around.alias("_around")))
    places = saved(reduce(DataFrame.unionByName, places), "token_places")

    # The rarest token of each window by its count in all documents; a window with a token that none holds occurs nowhere.
    rarity = places.filter("NOT _row").groupBy("_token", "_size").agg(F.count(F.lit(1)).alias("_seen"))
    ranked = tokens.withColumnRenamed("_q", "_size").join(rarity, ["_token", "_size"], "left").fillna(0, ["_seen"])
    prefix = saved(
        ranked.groupBy("_window", "_items", "_size")
        .agg(F.min(F.struct("_seen", "_token", "_offset")).alias("_rarest"))
        .filter("_rarest._seen > 0")
        .select("_window", "_items", "_size", "_rarest._token", "_rarest._offset"),
        "prefix",
    )
    weight = 64 + F.aggregate("_window", F.lit(0), lambda a, w: a + 8 + F.octet_length(w)) + F.aggregate("_items", F.lit(0), lambda a, w: a + 8 + F.octet_length(w))
    small = (prefix.agg(F.sum(weight)).first()[0] or 0) <= BLOCK_BYTES
    start, n = F.col("_pos") - 1 - F.col("_offset"), F.size("_window")
    fits = (start >= 0) & (start + n <= F.col("_n"))
    same = F.slice("_around", F.greatest(start + 2 - F.col("_from"), F.lit(1)), n) == F.col("_window")
    occurring = places.filter("NOT _row").join(F.broadcast(prefix) if small else prefix, ["_token", "_size"]).filter(fits & same)
    parts = [
        places.filter("_row").select("_id", "_text_hash", "_n", F.lit(1).alias("_rows"), F.lit(None).cast("struct<a:int,b:int>").alias("_span"), F.lit(None).cast("array<string>").alias("_items")),
        occurring.select("_id", "_text_hash", "_n", F.lit(0).alias("_rows"), F.struct(start.alias("a"), (start + n).alias("b")).alias("_span"), "_items"),
    ]
    spans = F.array_sort(F.collect_set("_span"))
    # A document has at most as many spans as words times the window sizes in use.
    grouped = reduce(DataFrame.unionByName, parts).groupBy("_id", "_text_hash").agg(
        F.sum("_rows").alias("_rows"), F.max("_n").alias("n_words"), spans.alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items")
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate(
        "_spans", zero, lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0), s.b - F.greatest(s.a, acc.reach))).alias("n"), F.greatest(acc.reach, s.b).alias("reach")), lambda acc: acc.n
    )
    once = grouped.select(F.col("_id").alias(id_column), "_text_hash", F.col("n_words").cast("long"), covered.cast("long").alias("n_hit"), "items", "_rows")
    return once.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("_rows", "_row")


def _blocks(table: DataFrame, weight: Column, key: Column) -> list[DataFrame]:
    """``table`` in blocks of about BLOCK_BYTES at most."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    n = 1 + total // BLOCK_BYTES * 2
    return [table] if n == 1 else [table.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n)) == k) for k in range(n)]


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without those in which an item window occurs."""
    hit = saved(window_hits(docs, items, id_column, text_column).filter("n_hit > 0").select(F.col(id_column).alias("_id"), "_text_hash").distinct(), "contaminated")
    here = F.xxhash64(F.coalesce(docs[text_column], F.lit("")))
    return docs.join(hit, docs[id_column].eqNullSafe(hit["_id"]) & (here == hit["_text_hash"]), "left_anti")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Per document: words, words inside an occurring item window, and the items behind them."""
    hits = window_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
