"""I-Match fingerprints: a document's mid-frequency terms, sorted and hashed once for each of several random lexicons.

Terms are the distinct lower-cased words (runs of letters and digits) of a text. The lexicon holds the terms whose inverse document frequency
lies in a band: in at least ``LOWEST`` documents and one of ``RARE``, and in at most one of ``COMMON``. It has at most RARE times the mean number of terms of a
document as members, however many documents there are; up to ``BROADCAST_ROWS`` it is broadcast, beyond that it is shuffled.

A term's digest puts it into one of ``LEXICONS`` random subsets of the lexicon. A fingerprint has one signature for each subset in which the document
has a term: the hash of its sorted terms there. So that a signature covers few terms in documents of all lengths, subsets have levels: each level
halves them at random, and a document of up to ``TERMS`` * 2^k distinct terms is on level k. A fingerprint holds the signatures of its level and of
the following ones, ``LEVELS`` in all, so two fingerprints whose levels differ by less can be compared, on the higher of the two. Their
likeness is the share of common signatures among all that either has there: 1 for equal fingerprints, 0 if no level is common.

Documents with fewer than ``FEW`` sampled terms in the band (short ones, mostly) use all their sampled terms.

Null text counts as empty. A text without words has the empty fingerprint, which is like itself only. Equal texts have equal fingerprints, in whatever
rows. Very long texts are read whole; what is kept of each is the signatures. An empty table gives no rows. Names of other columns don't matter:
only the id and the text are read.

The next document (for the edited texts) is found in blocks of neighbouring ids, each with the first document of the block after it.
Documents of one id follow each other in the order of a hash of their text; rows equal in both lie in one block, which spills. A null id is the smallest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoopline.llm.common import read_table, saved
from hoopline.llm.decontaminate import words_of
from hoopline.llm.sharding import _drawn, _range_of, _splitters

LOWEST, RARE, COMMON = 2, 1000, 10
LEXICONS, TERMS, FEW = 128, 64, 8
LEVELS = 4
#: Hexadecimal digits of a signature.
DIGITS = 8
BROADCAST_ROWS = 1_000_000
BLOCK_BYTES, MAX_BLOCKS = 256 << 10, 16_384


def terms_of(text: Column) -> Column:
    return F.array_distinct(words_of(text))


def lexicon(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The terms (``_term``) within the band, counted over all rows; written."""
    rows = docs.count()
    counted = docs.select(F.explode(terms_of(F.col(text_column))).alias("_term")).groupBy("_term").agg(F.count(F.lit(1)).alias("_n"))
    band = (F.col("_n") >= LOWEST) & (F.col("_n") * RARE >= rows) & (F.col("_n") * COMMON <= rows)
    return saved(counted.filter(band).select("_term"), "lexicon")


def _bound(level: Column) -> Column:
    """Digits 3 to 10 of the md5 of a term in the lexicons of ``level`` are below this: 2^(32 - level), or above all digits on level 0."""
    power = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(32) - level).cast("int"))
    return F.when(level == 0, "g").otherwise(F.lpad(F.hex(power), 8, "0"))


def _signatures(terms: Column) -> Column:
    """Of a sorted array of (subset, term, ..): one signature for each subset that occurs, joined."""

    def signature(k: Column) -> Column:
        return F.substring(F.md5(F.concat_ws(" ", F.transform(F.filter(terms, lambda t: t["subset"] == k), lambda t: t["term"]))), 1, DIGITS)

    return F.concat_ws(".", F.transform(F.array_distinct(F.transform(terms, lambda t: t["subset"])), signature))


def fingerprints(rows: DataFrame, keys: list[str], words: DataFrame, text_column: str = "text", name: str = "fingerprint") -> DataFrame:
    """``keys`` (which tell the rows apart) and their fingerprint under the lexicon ``words``, a written table.

    Keys by which ``rows`` are already dealt out save the shuffle of the sampled terms.
    """
    many = words.count() > BROADCAST_ROWS
    words = words.withColumn("_known", F.lit(True))
    found = rows.select(*keys, terms_of(F.col(text_column)).alias("_terms"))
    n = F.size("_terms")
    blocks = F.floor((n - 1) / TERMS).cast("long")  # exact: n is below 2^31
    found = found.withColumn("_level", F.when(n <= TERMS, 0).otherwise(F.length(F.bin(blocks))))
    # Bounds are worked out once for a document, not for each term.
    bounds = [f"_bound_{k}" for k in range(LEVELS)]
    found = found.withColumns({b: _bound(F.col("_level") + k) for k, b in enumerate(bounds)})
    digests = F.transform("_terms", lambda t: F.struct(t.alias("t"), F.md5(t).alias("h")))
    drawn = F.filter(digests, lambda x: F.substring(x["h"], 3, 8) < F.col(bounds[0]))
    sampled = found.select(*keys, "_level", *bounds[1:], F.explode_outer(drawn).alias("_x"))
    sampled = sampled.select(*keys, "_level", *bounds[1:], F.col("_x.t").alias("_term"), F.col("_x.h").alias("_h"))
    known = sampled.join(words if many else F.broadcast(words), "_term", "left")
    subset = (F.conv(F.substring("_h", 1, 2), 16, 10).cast("int") % LEXICONS).alias("subset")
    deep = reduce(lambda x, y: x + y, [(F.substring("_h", 3, 8) < F.col(b)).cast("int") for b in bounds[1:]])
    entry = F.struct(subset, F.col("_term").alias("term"), deep.alias("deep"), F.coalesce("_known", F.lit(False)).alias("known"))
    gathered = known.groupBy(*keys, "_level").agg(F.sort_array(F.collect_list(F.when(F.col("_term").isNotNull(), entry))).alias("_all"))
    in_band = F.filter("_all", lambda t: t["known"])
    chosen = gathered.withColumn("_own", F.when(F.size(in_band) >= FEW, in_band).otherwise(F.col("_all")))
    surviving = lambda k: F.filter("_own", lambda t: t["deep"] >= k)
    levels = [_signatures(surviving(k)) for k in range(LEVELS)]
    text = F.concat_ws(":", F.col("_level").cast("string"), *levels)
    return chosen.select(*keys, F.when(F.size("_own") > 0, text).otherwise("").alias(name))


def likeness(one: Column, other: Column) -> Column:
    """Share of common signatures among all of two fingerprints, on the lowest level that both have; 1 if they are equal."""
    parts = lambda f: F.split(f, ":")
    level = lambda f: F.get(parts(f), F.lit(0)).cast("int")
    at = F.greatest(level(one), level(other))
    on = lambda f: F.split(F.get(parts(f), at - level(f) + 1), "\\.")
    either = F.size(F.array_remove(F.array_union(on(one), on(other)), ""))
    share = F.size(F.array_remove(F.array_intersect(on(one), on(other)), "")) / either
    comparable = (one != "") & (other != "") & (F.abs(level(one) - level(other)) < LEVELS)
    return F.when(one == other, 1.0).when(comparable & (either > 0), share).otherwise(0.0)


def i_match(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``text_hash`` and fingerprint."""
    words = lexicon(docs, text_column)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("_row"), text.alias("_text"))
    return fingerprints(rows, ["id", "text_hash", "_row"], words, "_text").select(F.col("id").alias(id_column), "text_hash", "fingerprint")


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, Window]:
    """``_block``, ``_ghost``, ``_id``, ``_tie`` and ``_text`` of all rows, and the window in which the next row is the next document.

    Ghosts are copies of the first row of the following block (after the last block: of the first) and stand last.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = docs.select(F.col(id_column).alias("_id"), F.xxhash64(text).alias("_tie"), text.alias("_text"))
    base = base.withColumn("_key", F.coalesce(F.col("_id").cast("long"), F.lit(-(1 << 63))))
    sizes = base.withColumn("_size", F.octet_length("_text").cast("long") + 16)
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    blocks = max(1, min(MAX_BLOCKS, total // BLOCK_BYTES))
    # On average SAMPLE_PER_RANGE rows of each block are drawn, and sorted in one row.
    splitters = _splitters(_drawn(sizes, max(1.0, total / blocks), 11)).first()["s"]
    placed = base.withColumn("_block", _range_of(splitters))
    first = F.min(F.struct(F.col("_id").isNotNull().alias("named"), "_id", "_tie")).alias("_first")
    firsts = saved(placed.groupBy("_block").agg(first), "block_firsts")
    # One row for each block, at most about MAX_BLOCKS: small enough for one task and for a broadcast.
    order = Window.orderBy("_block")
    last = F.max("_block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ghosts = firsts.select(F.col("_first._id").alias("_gid"), F.col("_first._tie").alias("_gtie"), F.coalesce(F.lag("_block").over(order), last).alias("_before"))
    here = placed["_id"].eqNullSafe(ghosts["_gid"]) & (placed["_tie"] == ghosts["_gtie"])
    # Splitters differ, so a key lies in one block and is the first of one at most; a repeated row leaves ghosts that are all alike.
    copy = F.when(F.col("_before").isNotNull(), F.array(F.struct(F.lit(True).alias("g"), F.col("_before").alias("b"))))
    own = F.array(F.struct(F.lit(False).alias("g"), F.col("_block").alias("b")))
    seats = F.explode(F.when(copy.isNull(), own).otherwise(F.concat(own, copy))).alias("_seat")
    seated = placed.join(F.broadcast(ghosts), here, "left").select("_id", "_tie", "_text", seats)
    rows = seated.select(F.col("_seat.b").alias("_block"), F.col("_seat.g").alias("_ghost"), "_id", "_tie", "_text")
    return rows, Window.partitionBy("_block").orderBy("_ghost", F.col("_id").asc_nulls_first(), "_tie")


def op11_imatch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how like they are to the edited and to the next one."""
    docs = read_table(spark, sf_dir, "documents")
    words = lexicon(docs)
    rows, order = with_next(docs)
    n = F.char_length("_text")
    quarter = F.floor(n / 4).cast("int")
    head = F.left(F.lead("_text").over(order), quarter)
    rows = rows.select("_block", "_ghost", "_id", n.cast("long").alias("_n"), F.row_number().over(order).alias("_row"), "_text", F.concat(F.left(F.col("_text"), n - quarter), F.coalesce(head, F.lit(""))).alias("_edited"))
    digest = F.sha2("_edited", 256).alias("_sha")
    versions = F.array(F.struct(F.lit(0).alias("v"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("_edited").alias("t")))
    keys = ["_block", "_row", "_ghost", "_id", "_n", "_sha", "_version"]
    both = rows.select("_block", "_row", "_ghost", "_id", "_n", digest, F.explode(versions).alias("_v")).select(*keys[:-1], F.col("_v.v").alias("_version"), F.col("_v.t").alias("_t"))
    prints = fingerprints(both, keys, words, "_t", "_print")
    of = lambda v: F.max(F.when(F.col("_version") == v, F.col("_print")))
    paired = prints.groupBy(*keys[:-1]).agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"))
    following = F.lead("fingerprint").over(Window.partitionBy("_block").orderBy("_row"))
    return paired.withColumn("_next", following).filter("NOT _ghost").select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_chars"), F.col("_sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )
