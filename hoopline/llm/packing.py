"""Vector bin packing by the dot-product heuristic.

Examples have three sizes: tokens, segments and loss-bearing tokens. A sequence has a limit for each. The open sequence
takes the example that fits and has the largest dot product with the room left, each dimension weighted by its average
demand; when nothing fits, the next sequence opens. Examples are dealt over groups of about ``GROUP_ROWS`` by a hash of
their own columns, and groups are packed independently, so no task holds more than a group.

Inside a group, examples of equal sizes are one kind with a count; the work is one vector step per placed example.

Null text counts as empty and is one closing id. Pieces are numbered before they are dealt, so rows that are equal in all else, however many, are spread over all groups. Very long texts
are cut into pieces, an empty table gives no rows. Only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopline.llm.common import read_table, saved

MAX_TOKENS = 1024
MAX_SEGMENTS = 64
GROUP_ROWS = 2048
TOKENIZER = "byte_bpe_50k.json"


def pack_sizes(sizes: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and place in it for each row of ``sizes`` (n by dimensions, whole numbers of 0 or more).

    A row over a limit gets a sequence of its own. Equal rows are placed in their order.
    """
    n = len(sizes)
    sequence, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return sequence, place
    kinds, kind_of, counts = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    kind_of = kind_of.reshape(-1)
    rows = np.argsort(kind_of, kind="stable")
    at = np.concatenate([[0], np.cumsum(counts)])[:-1]
    full = np.array(limits, np.int64)
    share = kinds / np.maximum(full, 1)
    weighted = share * (share * counts[:, None]).sum(0) / n
    over = (kinds > full).any(1)
    now = 0
    for kind in np.flatnonzero(over):
        own = rows[at[kind] : at[kind] + counts[kind]]
        sequence[own] = np.arange(now, now + len(own))
        now += len(own)
    left = np.where(over, 0, counts)
    todo = int(left.sum())
    while todo:
        room, held = full.copy(), 0
        while True:
            fits = (left > 0) & (kinds <= room).all(1)
            if not fits.any():
                break
            kind = int(np.where(fits, weighted @ (room / np.maximum(full, 1)), -1.0).argmax())
            row = rows[at[kind] + counts[kind] - left[kind]]
            sequence[row], place[row] = now, held
            held += 1
            left[kind] -= 1
            todo -= 1
            room -= kinds[kind]
        now += 1
    return sequence, place


def pack(examples: DataFrame, keys: list[str], limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_TOKENS)) -> DataFrame:
    """``examples`` (a written table with whole numbers n_tokens, n_segments, n_loss) with sequence_id, place and offset.

    ``keys`` tell examples apart; rows equal in them go to one group, so they should not repeat without bound. Null
    sizes count as 0. No rows in, no rows out.
    """
    groups = max(1, -(-examples.count() // GROUP_ROWS))
    schema = examples.withColumns({"_group": F.lit(0).cast("long"), "sequence_id": F.lit(0).cast("long"), "place": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", *keys], kind="stable", ignore_index=True)
        sizes = group[["n_tokens", "n_segments", "n_loss"]].fillna(0).to_numpy(np.int64)
        sequence, place = pack_sizes(sizes, limits)
        order = np.lexsort((place, sequence))
        before = np.cumsum(sizes[order, 0]) - sizes[order, 0]
        first = np.concatenate([[True], np.diff(sequence[order]) != 0])
        offset = np.empty(len(group), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        return group.assign(sequence_id=group["_group"].to_numpy() * (1 << 32) + sequence, place=place, offset=offset)

    dealt = examples.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("long"))
    return dealt.groupBy("_group").applyInPandas(packed, schema).drop("_group")


class TextTokenizer:
    """Ids of texts by a byte-level BPE file of ``tokenizers``.

    The ids come from ``tiktoken`` with the same vocabulary as ranks, which is several times faster and gives the same
    ids; a text that holds the string of a special token goes to ``tokenizers`` itself.
    """

    def __init__(self, name: str = TOKENIZER):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(public_tokenizers.path(name))
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self._special):
            return self._whole.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


def token_pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = MAX_TOKENS, tokenizer: str = TOKENIZER) -> DataFrame:
    """Each document's ids and a closing id 0, in pieces of ``most`` ids and a rest; all ids bear loss."""
    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer_ = TextTokenizer(tokenizer)
        for batch in batches:
            keys, texts = batch.iloc[:, 0], batch.iloc[:, 1].fillna("").tolist()
            for first in range(0, len(texts), 1000):
                rows = []
                for k, text in enumerate(texts[first : first + 1000], first):
                    whole = np.array([*tokenizer_.encode(text), 0], "<u4")
                    rows += [(k, s, min(most, len(whole) - s), zlib.crc32(whole[s : s + most].tobytes()), len(whole)) for s in range(0, len(whole), most)]
                k, *columns = zip(*rows, strict=True)
                yield pd.DataFrame({id_column: keys.iloc[list(k)].array, **dict(zip(("start", "length", "ids_crc32", "doc_tokens"), columns, strict=True))})

    return docs.select(id_column, text_column).mapInPandas(cut, schema)


def pack_documents(docs: DataFrame, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_TOKENS)) -> DataFrame:
    """All ids of ``docs`` (doc_id, text; null text: empty, so one closing id) in sequences; one row per piece."""
    pieces = token_pieces(docs, most=min(limits[0], limits[2])).withColumns({"n_tokens": F.col("length"), "n_segments": F.lit(1).cast("long"), "n_loss": F.col("length")})
    numbered = saved(pieces.withColumn("piece_no", F.monotonically_increasing_id()), "pieces")
    packed = pack(numbered, ["doc_id", "start", "ids_crc32", "piece_no"], limits)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
