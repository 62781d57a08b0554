"""Conversation structure repair by an integer-minimum DAG.

The rows of a conversation, by turn, are kept, given the role of user or assistant, deleted, or preceded by inserted rows without text, so that the
initials of the roles are ``(s?(ua)+)?``, at the least cost; of equally cheap edits those whose initials (D, I, K, R) are least in ASCII count.

The DAG has a node for each row and phase: nothing so far, after a system, a user or an assistant row. A path's weight is one whole number: the cost in its high
digits, below them one digit of ``BITS`` bits for each edit, in order, the first one highest, and zeros after the last. So the least number is
the least cost, then the least initials, where a shorter text counts as smaller; nothing else is compared. Nodes are taken from
the last row to the first: an edit put in front moves the letters down by one place. Two paths between the same nodes never have equal cost and one
the initials of the other with more after them (those would all be inserts, which cost), so the least rest is always part of the least whole.

A conversation of any length is cut into chunks of ``CHUNK`` rows. Each chunk finds its least paths from each phase to each phase, on its own; one pass over a conversation's chunks,
last to first, then picks one path for each, from costs and ranks alone: inserts stand before rows, so no chunk's path is the beginning of another of that chunk, and ranks
decide what the numbers would. Chunks then edit their rows, each on its own. Rows come into order by a range partitioning over (conversation, turn, role,
text), so a conversation may lie in many partitions; a row is a repetition if an equal role and text has a lower place in that order. Only the digest over a whole
conversation reads it in one task, as a stream.

Nulls in role and text count as one space, a null turn comes first, rows of a null conversation id are one conversation. Rows of one turn are taken in the order of role and text; equal rows are
interchangeable. Empty texts are blank, very long ones are read whole. A conversation without rows has no edits; an empty table gives no rows. The four columns are named by parameters, others
are not read, whatever their names. Texts are told apart by role and md5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopline.llm.common import read_table, saved

SPACES = " \t\n\x0b\x0c\r"
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
LETTERS = "DIKR"
BITS = 3
CHUNK_BITS = 9
CHUNK = 1 << CHUNK_BITS
#: Phases: nothing so far, after system, after user, after assistant. Where a kept role or an insert leads; there is no entry where it is not allowed.
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
NEXT = (2, 2, 3, 2)
#: Inserts that end a conversation in each phase.
TAIL = (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}
FAULTS = "bdt"


def damaged(rows: DataFrame) -> DataFrame:
    """The query's damage: by crc32 of ``conv_id:turn`` modulo 20, rows are dropped, emptied, stripped of ends, repeated or given to the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1)))
    return rows.filter(fate != 0).select("conv_id", "turn", F.when(fate == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _key(conversation: Column) -> Column:
    """The id as text, so that null is a value like others."""
    return F.coalesce(F.concat(F.lit("="), conversation.cast("string")), F.lit(""))


def in_order(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Written: ``key``, ``chunk``, ``ord``, ``turn``, ``role``, ``text``, ``kind`` (initial, then b, d, t or blank for the fault); ``ord`` follows the order."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(_key(F.col(conversation)).alias("key"), F.col(turn).cast("long").alias("turn"), value(role).alias("role"), value(text).alias("text"))
    order = ["key", "turn", "role", "text"]
    placed = plain.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())
    placed = saved(placed.withColumn("chunk", F.shiftright("ord", CHUNK_BITS)), "conversation_rows")
    firsts = placed.groupBy("key", "role", F.md5("text").alias("digest")).agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(bare == "", "b").when(F.col("first").isNull(), "d").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise(" ")
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return placed.join(firsts, "ord", "left").select("key", "chunk", "ord", "turn", "role", "text", F.concat(initial, fault).alias("kind"))


def _put_in_front(weight: int, letter: str, cost: int, length: int) -> int:
    """The weight of a path with one edit more, in front of the others."""
    low = BITS * length
    digits = (weight & ((1 << low) - 1)) >> BITS | (LETTERS.index(letter) + 1) << low - BITS
    return ((weight >> low) + cost) << low | digits


def _least(weights: list[int | None]) -> int | None:
    return min((w for w in weights if w is not None), default=None)


@lru_cache(4096)
def least_paths(kinds: tuple[str, ...]) -> tuple[tuple[int, str] | None, ...]:
    """Cost and initials of the least path through rows of these kinds, from each phase to each (at 4 * from + to)."""
    length = 3 * len(kinds)  # an edit and at most two inserts for each row
    found: list[tuple[int, str] | None] = [None] * 16
    for end in range(4):
        rest: list[int | None] = [0 if p == end else None for p in range(4)]
        for kind in reversed(kinds):
            role, fault = kind
            extra = TRUNCATED_COST if fault == "t" else 0
            here = []
            for p in range(4):
                ways = [("D", COST["D"], p)]
                if fault not in "bd":
                    if (role, p) in KEPT:
                        ways.append(("K", COST["K"] + extra, KEPT[role, p]))
                    ways.append(("R", COST["R"] + extra, NEXT[p]))
                here.append(_least([_put_in_front(rest[q], letter, cost, length) for letter, cost, q in ways if rest[q] is not None]))
            for _ in range(2):
                here = [_least([here[p], None if here[NEXT[p]] is None else _put_in_front(here[NEXT[p]], "I", COST["I"], length)]) for p in range(4)]
            rest = here
        for p, weight in enumerate(rest):
            if weight is not None:
                low = BITS * length
                digits = [(weight >> low - BITS * (k + 1)) & ((1 << BITS) - 1) for k in range(length)]
                found[4 * p + end] = (weight >> low, "".join(LETTERS[d - 1] for d in digits if d))
    return tuple(found)


def _groups(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows equal in ``names``, across batches, as columns of one or several pieces."""
    held, pieces = None, []
    for batch in batches:
        if not len(batch):
            continue
        values = [batch[n].to_numpy() for n in names]
        changes = np.zeros(len(batch), bool)
        for v in values:
            changes[1:] |= v[1:] != v[:-1]
        bounds = [0, *np.flatnonzero(changes).tolist(), len(batch)]
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            here = tuple(v[i] for v in values)
            if here != held and pieces:
                yield held, pieces
                pieces = []
            held = here
            pieces.append({c: v[i:j] for c, v in columns.items()})
    if pieces:
        yield held, pieces


def _joined(pieces: list[dict], name: str) -> np.ndarray:
    return pieces[0][name] if len(pieces) == 1 else np.concatenate([p[name] for p in pieces])


CHUNK_COLUMNS = (
    "key string, chunk long, first_kind string, last_kind string, blank long, duplicate long, truncated long, illegal long, "
    "turns long, low long, high long, costs array<long>, ranks array<int>, audits array<string>"
)


def chunk_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each chunk from rows sorted by (key, chunk, ord): counts, and the least path for each pair of phases."""
    names = [c.split()[0] for c in CHUNK_COLUMNS.split(", ")]
    out: list[tuple] = []
    for (key, chunk), pieces in _groups(batches, ["key", "chunk"]):
        kinds = tuple(_joined(pieces, "kind").tolist())
        turns = sorted({int(t) for t in _joined(pieces, "turn") if not pd.isna(t)})
        paths = least_paths(kinds)
        order = {a: k for k, a in enumerate(sorted({p[1] for p in paths if p}))}
        out.append(
            (
                key, chunk, kinds[0], kinds[-1], *(sum(k[1] == f for k in kinds) for f in FAULTS), sum(a[0] + b[0] not in LEGAL for a, b in zip(kinds, kinds[1:], strict=False)),
                len(turns), turns[0] if turns else None, turns[-1] if turns else None,
                [p[0] if p else -1 for p in paths], [order[p[1]] if p else -1 for p in paths], [p[1] if p else "" for p in paths],
            )
        )
        if len(out) >= 5000:
            yield _frame(out, names)
            out = []
    if out:
        yield _frame(out, names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({c: "Int64" for c in ("low", "high") if c in names})


def chosen_paths(costs: np.ndarray, ranks: np.ndarray) -> tuple[int, list[int]]:
    """Cost of the least edits of a conversation, and the path (4 * from + to) of each chunk; one row of 16 for each chunk."""
    rest = [(COST["I"] * t, t) for t in TAIL]  # cost, and rank of the initials: more inserts are a longer text
    choices = []
    for cost, rank in zip(reversed(costs.tolist()), reversed(ranks.tolist()), strict=True):
        best = []
        for p in range(4):
            best.append(min((cost[4 * p + q] + rest[q][0], (rank[4 * p + q], rest[q][1]), q) for q in range(4) if cost[4 * p + q] >= 0))
        place = {w: k for k, w in enumerate(sorted({b[1] for b in best}))}
        rest = [(b[0], place[b[1]]) for b in best]
        choices.append([b[2] for b in best])
    phase, taken = 0, []
    for choice in reversed(choices):
        taken.append(4 * phase + choice[phase])
        phase = choice[phase]
    return rest[0][0], taken


SCAN_COLUMNS = "key string, chunk long, path int, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def scan_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For chunks sorted by (key, chunk): the path of each, and the conversation's counts and cost on its last chunk."""
    for (key,), pieces in _groups(batches, ["key"]):
        whole = {c: _joined(pieces, c) for c in pieces[0]}
        cost, taken = chosen_paths(np.array(whole["costs"].tolist()), np.array(whole["ranks"].tolist()))
        seen, last, lows, highs = 0, None, [], []
        for n, low, high in zip(whole["turns"], whole["low"], whole["high"], strict=True):
            if n:
                seen += int(n) - (last is not None and int(low) == last)
                last = int(high)
                lows.append(int(low))
                highs.append(last)
        between = sum(a[0] + b[0] not in LEGAL for a, b in zip(whole["last_kind"][:-1], whole["first_kind"][1:], strict=True))
        n = len(taken)
        counts = {f: int(whole[f].sum()) for f in ("blank", "duplicate", "truncated", "illegal")}
        counts["illegal"] += between
        gaps = max(highs) - min(lows) + 1 - seen if lows else 0
        yield pd.DataFrame({"key": key, "chunk": whole["chunk"], "path": taken, "final": [False] * (n - 1) + [True], "gaps": gaps, **counts, "cost": cost})


MESSAGE_COLUMNS = "key string, ord long, step int, edit string, role string, text string"


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of chunks, sorted by (key, chunk, ord) and each behind its chunk's path, as edits in order; a deleted row has no role."""
    names = [c.split()[0] for c in MESSAGE_COLUMNS.split(", ")]
    audit, at, phase, final = "", 0, 0, False
    for batch in batches:
        out: list[tuple] = []
        for key, order, role, text, kind, path, paths_end in batch[["key", "ord", "role", "text", "kind", "audit", "path"]].itertuples(index=False):
            if kind is None:
                audit, at, phase, final = path, 0, int(paths_end) // 8, bool(int(paths_end) % 2)
                continue
            step = 0
            while audit[at] == "I":
                phase = NEXT[phase]
                out.append((key, order, step, "I", "user" if phase == 2 else "assistant", ""))
                step, at = step + 1, at + 1
            edit, at = audit[at], at + 1
            if edit == "D":
                out.append((key, order, step, edit, None, None))
            elif edit == "K":
                phase = KEPT[kind[0], phase]
                out.append((key, order, step, edit, role, text))
            else:
                phase = NEXT[phase]
                out.append((key, order, step, edit, "user" if phase == 2 else "assistant", text))
            if final and at == len(audit):
                for k in range(TAIL[phase]):
                    phase = NEXT[phase]
                    out.append((key, order, step + 1 + k, "I", "user" if phase == 2 else "assistant", ""))
        yield pd.DataFrame(out, columns=names)


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counts of each conversation (``key``, gaps, blank, duplicate, truncated, illegal, cost), and its edits (``key``, ``ord``, ``step``, ``edit``, ``role``, ``text``), both written.

    The repaired conversation is the edits other than D, by (ord, step). ``key`` is '=' and the id as text, or empty for null.
    """
    ordered = saved(in_order(rows, conversation, turn, role, text), "ordered_rows")
    narrow = ordered.select("key", "chunk", "ord", "turn", "kind").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "ord")
    chunks = saved(narrow.mapInPandas(chunk_paths, CHUNK_COLUMNS), "chunks")
    scanned = saved(chunks.drop("audits").repartition("key").sortWithinPartitions("key", "chunk").mapInPandas(scan_chunks, SCAN_COLUMNS), "scanned")
    counts = scanned.filter("final").select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    # From phase, and whether the conversation ends here.
    code = (F.floor(F.col("path") / 4) * 8 + F.col("final").cast("int")).cast("int")
    paths = scanned.join(chunks.select("key", "chunk", "audits"), ["key", "chunk"]).select("key", "chunk", F.get("audits", F.col("path")).alias("audit"), code.alias("path"))
    none = lambda kind: F.lit(None).cast(kind)
    heads = paths.select("key", "chunk", F.lit(-1).cast("long").alias("ord"), none("string").alias("role"), none("string").alias("text"), none("string").alias("kind"), "audit", "path")
    bodies = ordered.select("key", "chunk", "ord", "role", "text", "kind", none("string").alias("audit"), none("int").alias("path"))
    together = heads.unionByName(bodies).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "ord")
    return counts, saved(together.mapInPandas(_edited, MESSAGE_COLUMNS), "edits")


def digests(edits: DataFrame) -> DataFrame:
    """``key``, ``audit``, ``repaired_sha256`` of each conversation; its rows pass through one task, one at a time."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, letters, sha, empty = None, [], hashlib.sha256(), True
        for batch in batches:
            out: list[tuple] = []
            for key, edit, role, text in batch[["key", "edit", "role", "text"]].itertuples(index=False):
                if key != held:
                    if held is not None:
                        out.append((held, "".join(letters), sha.hexdigest()))
                    held, letters, sha, empty = key, [], hashlib.sha256(), True
                letters.append(edit)
                if edit != "D":
                    sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                    empty = False
            yield pd.DataFrame(out, columns=["key", "audit", "repaired_sha256"])
        if held is not None:
            yield pd.DataFrame([(held, "".join(letters), sha.hexdigest())], columns=["key", "audit", "repaired_sha256"])

    return edits.repartition("key").sortWithinPartitions("key", "ord", "step").mapInPandas(digest, "key string, audit string, repaired_sha256 string")


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    """Faults, least cost and edits of every conversation after the query's damage."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    counts, edits = repair(damaged(rows))
    every = rows.select("conv_id", _key(F.col("conv_id")).alias("key")).distinct()
    found = every.join(counts, "key", "left").join(digests(edits), "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
