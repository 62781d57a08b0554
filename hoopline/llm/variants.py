"""Spelling variants by a trie-node pair dictionary.

The words are held in two tries, one of the words and one of the reversed words, whose nodes have whole numbers: a prefix of a word is one number, a suffix
another. A word with the letter at place i skipped is the pair (node of the first i letters, node of the letters after place i); a word with a letter
to be inserted at place i is the pair (node of the first i letters, node of the rest). Two words differ by a replaced letter exactly if
they share a skipped pair, and by an inserted or deleted letter exactly if a skipped pair of one is a whole pair of the other. So a join on
pairs of whole numbers finds all neighbours, with nothing left to verify.

A pair is shared by one whole word at most and by as many words with a skipped letter as there are letters (90 in the words of the query). No pairs of words are made:
each pair of nodes passes on its best members and how many it has. Of a run of equal letters only the first counts as skipped
when words are counted, so each near word counts once.

Numbering: sampled splitters cut the sorted words into blocks. A prefix in more than one block is a prefix of a splitter and is numbered on the
driver (at most ``MAX_BLOCKS`` splitters of ``SPLITTER`` letters); all others are numbered inside their block, in one pass over its sorted
words that holds one path. Reversed words likewise.

A word's form is its near word of largest n (ties: smallest in code-point order) if that is at least ``FACTOR`` times its own; forms are followed by pointer
doubling, and as n grows by ``FACTOR`` with each step, chains are short.

Null and empty texts have no words; a null id counts as the text 'null'. Repeated rows count as often as they stand there. An empty table gives no words. Very
long texts are read whole, and words may be of any length. Only the id and the text are read, so names of other columns don't matter; in ``spelling_variants`` likewise
``word`` and ``n``, where rows without a word or of repeated words must be summed up beforehand, as ``word_counts`` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopline.llm.common import lower_ascii, read_table, saved

RUN = "[A-Za-zÀ-ÿ]+"
#: One in so many runs, by its crc32, loses a letter before the words are counted.
MISSPELT = 199
LETTERS, OCCURRENCES, FACTOR = 6, 5, 5
WORDS_PER_BLOCK, MAX_BLOCKS, SPLITTER = 20_000, 4096, 64
#: Numbers of nodes and words: the block above these bits, the place in the block below.
BLOCK_BITS = 40


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word``, ``n``: the words of at least LETTERS letters and OCCURRENCES occurrences, one run in MISSPELT with a letter left out."""
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text_column)), F.lit(RUN), F.lit(0))).alias("run"))
    size = F.char_length("run")
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    place = (h % size).cast("int")
    cut = F.concat(F.left("run", place), F.substring("run", place + 2, size))
    words = runs.filter(size >= LETTERS).select(F.when(h % MISSPELT == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OCCURRENCES)


def _splitters(words: DataFrame, column: str, blocks: int, rows: int) -> list[str]:
    """Beginnings of sampled words that cut the sorted words into about ``blocks`` blocks; the sample has about 16 words a block."""
    if blocks <= 1:
        return []
    u = F.shiftrightunsigned(F.xxhash64(column), 11) / F.lit(float(1 << 53))
    drawn = words.filter(u < 16 * blocks / rows).select(F.left(column, F.lit(SPLITTER)).alias("s"))
    return sorted({r["s"] for r in drawn.agg(F.filter(F.sort_array(F.collect_list("s")), lambda s, i: i % 16 == 15).alias("s")).select(F.explode("s").alias("s")).collect()})


def _shared_nodes(splitters: list[str]) -> dict[str, int]:
    """All prefixes of the splitters, numbered from 0 (the root)."""
    return {x: k for k, x in enumerate(sorted({s[:i] for s in ["", *splitters] for i in range(len(s) + 1)}))}


class Trie:
    """Numbers the nodes of sorted words, block by block; holds the path of the last word."""

    def __init__(self, shared: dict[str, int]):
        self.shared, self.block, self.nodes, self.words, self.last, self.path = shared, None, 0, 0, "", [0]

    def add(self, block: int, word: str) -> tuple[int, np.ndarray]:
        """Number of the word and those of its prefixes, from the empty one on."""
        if block != self.block:
            self.block, self.nodes, self.words, self.last, self.path = block, 0, 0, "", [0]
        same = 0
        for a, b in zip(self.last, word, strict=False):
            if a != b:
                break
            same += 1
        del self.path[same + 1 :]
        first = (block + 1) << BLOCK_BITS
        for i in range(same + 1, len(word) + 1):
            # Prefixes of shared nodes are shared, so beyond the first that is not, none is.
            known = self.shared.get(word[:i]) if self.path[-1] < 1 << BLOCK_BITS and i <= SPLITTER else None
            if known is None:
                known = first + self.nodes
                self.nodes += 1
            self.path.append(known)
        self.last = word
        self.words += 1
        return first + self.words - 1, np.array(self.path, np.int64)


def _in_blocks(words: DataFrame, column: str, splitters: list[str]) -> DataFrame:
    """``words`` with ``block``, each block in one partition and sorted by ``column``."""
    bounds = F.split(F.lit("\n".join(splitters)), "\n") if splitters else F.array().cast("array<string>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, len(splitters).bit_length())))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(splitters)) & (F.get(bounds, at + step - 1) <= F.col(column)), at + step).otherwise(at))
    return words.withColumn("block", found).repartition("block").sortWithinPartitions("block", column)


def trie_pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbered words (``word``, ``n``, ``wid``: in code-point order) and their pairs of nodes (``p``, ``s``, ``skips``, ``counts``, ``n``, ``wid``), both written.

    ``words`` (``word`` of letters, ``n``) is a written table. ``skips``: a letter lies between prefix and suffix. ``counts``: it is the first of its run.
    """
    rows = words.count()
    blocks = min(MAX_BLOCKS, -(-rows // WORDS_PER_BLOCK))
    both = words.select("word", "n", F.reverse("word").alias("back"))
    ahead, behind = _splitters(both, "word", blocks, rows), _splitters(both, "back", blocks, rows)
    shared_ahead, shared_behind = _shared_nodes(ahead), _shared_nodes(behind)

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared_ahead)
        for batch in batches:
            added = [trie.add(b, w) for b, w in zip(batch["block"].tolist(), batch["word"], strict=True)]
            yield pd.DataFrame({"word": batch["word"], "n": batch["n"], "wid": [a[0] for a in added], "path": [a[1] for a in added]})

    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared_behind)
        for batch in batches:
            for at in range(0, len(batch), 5000):
                part = batch.iloc[at : at + 5000]
                columns = [[], [], [], [], []]
                for block, back, path in zip(part["block"].tolist(), part["back"], part["path"], strict=True):
                    suffix = trie.add(block, back)[1][::-1]  # of the letters from place 0, 1, .. on
                    letters = np.frombuffer(back[::-1].encode("utf-32-le", "surrogatepass"), "<u4")
                    n = len(letters)
                    columns[0] += [path[:-1], path]
                    columns[1] += [suffix[1:], suffix]
                    columns[2] += [np.ones(n, bool), np.zeros(n + 1, bool)]
                    columns[3] += [np.concatenate([[True], letters[1:] != letters[:-1]]), np.zeros(n + 1, bool)]
                    columns[4].append(2 * n + 1)
                joined = [np.concatenate(c) for c in columns[:4]]
                yield pd.DataFrame({**dict(zip(("p", "s", "skips", "counts"), joined, strict=True)), "n": np.repeat(part["n"].to_numpy(), columns[4]), "wid": np.repeat(part["wid"].to_numpy(), columns[4])})

    numbered = saved(_in_blocks(words, "word", ahead).mapInPandas(forward, "word string, n long, wid long, path array<long>"), "numbered_words")
    turned = _in_blocks(numbered.withColumn("back", F.reverse("word")), "back", behind)
    pairs = saved(turned.mapInPandas(backward, "p long, s long, skips boolean, counts boolean, n long, wid long"), "trie_pairs")
    return numbered.drop("path"), pairs


def near_words(pairs: DataFrame) -> DataFrame:
    """Per word that has near words: ``wid``, ``n``, ``n_near``, ``best_n`` and ``best`` (number of the near word of largest n, ties the smallest)."""
    member = F.struct("skips", "n", (-F.col("wid")).alias("order"), "counts")
    # As many members as there are letters, at most, and one.
    groups = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list(member), asc=False).alias("m")).filter((F.size("m") > 1))
    groups = groups.withColumn("skipping", F.filter("m", lambda x: x["skips"]))
    groups = groups.withColumn("whole", F.get(F.filter("m", lambda x: ~x["skips"]), F.lit(0))).withColumn("counted", F.size(F.filter("skipping", lambda x: x["counts"])))
    value = lambda x: F.when(x["order"].isNotNull(), F.struct(x["n"].alias("n"), x["order"].alias("order")))

    def passed(x: Column) -> Column:
        first, second = F.get("skipping", F.lit(0)), F.get("skipping", F.lit(1))
        other = F.when(~x["skips"] | (first["order"] != x["order"]), value(first)).otherwise(value(second))
        best = F.when(x["skips"], F.greatest(F.struct(F.coalesce(other["n"], F.lit(-1)).alias("n"), F.coalesce(other["order"], F.lit(0)).alias("order")), F.struct(F.coalesce(F.col("whole.n"), F.lit(-1)).alias("n"), F.coalesce(F.col("whole.order"), F.lit(0)).alias("order"))))
        best = best.otherwise(F.struct(other["n"].alias("n"), other["order"].alias("order")))
        n_near = F.when(x["skips"], F.size("skipping") - 1 + F.when(x["counts"] & F.col("whole").isNotNull(), 1).otherwise(0)).otherwise(F.col("counted"))
        return F.struct((-x["order"]).alias("wid"), x["n"].alias("n"), best.alias("best"), n_near.cast("long").alias("n_near"))

    each = groups.select(F.explode(F.transform("m", passed)).alias("x")).select("x.*")
    summed = each.groupBy("wid").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
    return summed.select("wid", "n", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.order")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``wid``, ``root``: where following ``form`` ends; the steps taken double with each round."""
    up = saved(forms.select("wid", F.col("form").alias("root")), "forms")
    while True:
        further = up.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        up = saved(up.join(further, "root", "left").select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if up.filter("moved").isEmpty():
            return up.select("wid", "root")


def spelling_variants(words: DataFrame) -> DataFrame:
    """Per distinct word of ``words`` (``word``, ``n``): word, form, root, n, n_near, form_n."""
    numbered, pairs = trie_pairs(saved(words.select("word", "n"), "words"))
    near = saved(near_words(pairs), "near_words")
    forms = near.filter(F.col("best_n") >= FACTOR * F.col("n")).select("wid", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
    roots = _roots(forms)
    names = lambda number, name: numbered.select(F.col("wid").alias(number), F.col("word").alias(name))
    linked = saved(forms.join(roots, "wid").join(names("form", "form_word"), "form").join(names("root", "root_word"), "root").select("wid", "form_word", "form_n", "root_word"), "linked_words")
    found = numbered.join(near.select("wid", "n_near"), "wid", "left").join(linked, "wid", "left")
    return found.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_variants(spark, sf_dir: str) -> DataFrame:
    """All words of the documents with their spelling forms."""
    return spelling_variants(word_counts(read_table(spark, sf_dir, "documents")))
