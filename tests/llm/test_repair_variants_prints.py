"""Conversation repair, spelling variants and I-Match fingerprints against plain Python."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import string
import zlib
from functools import lru_cache
from pathlib import Path

import duckdb
import pytest

from hoopline.llm import conversations as cv
from hoopline.llm import imatch, variants
from hoopline.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")
SPACE = " \t\n\x0b\x0c\r"


# --- 12: conversations ----------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def plain_repair(rows):
    """Counts, cost, audit and repaired text of one conversation's (turn, role, text), by trying all edits from the front."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, phase, inserted):
        """Least (cost, audit, repaired) from row i on in a phase, after so many inserts in a row."""
        found = [(0, "", ())] if i == len(rows) and phase in ("", "a") else []

        def go(cost, letter, i, phase, inserted, row):
            rest = best(i, phase, inserted)
            if rest:
                found.append((cost + rest[0], letter + rest[1], (*row, *rest[2])))

        place = {"": ("u", "user"), "s": ("u", "user"), "a": ("u", "user"), "u": ("a", "assistant")}[phase]
        if inserted < 3:
            go(2, "I", i, place[0], inserted + 1, [f"{place[1]}:"])
        if i < len(rows):
            _, role, text = rows[i]
            more = 1 if faults[i] == "truncated" else 0
            go(3, "D", i + 1, phase, 0, [])
            if faults[i] not in ("blank", "duplicate"):
                go(2 + more, "R", i + 1, place[0], 0, [f"{place[1]}:{text}"])
                if (phase, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    go(more, "K", i + 1, role[:1], 0, [f"{role}:{text}"])
        return min(found, default=None)

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for phase in ("", "s", "u", "a"):
            best(i, phase, 0)
    cost, audit, repaired = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())


def check_conversations(spark, rows, path):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "2 AS ord", "3 AS chunk", "4 AS kind").write.parquet(f"{path}/conversations.parquet")
    got = QUERIES["op12_conversations"](spark, path).collect()
    after = collections.defaultdict(list)
    for conv, turn, role, text in plain_damage(rows):
        after[conv].append((turn, role, text))
    assert collections.Counter(r.conv_id for r in got) == collections.Counter({r[0] for r in rows})
    for r in got:
        assert tuple(r)[1:] == plain_repair(after[r.conv_id]), r


def test_random_conversations(spark, tmp_path):
    rand = random.Random(5)
    rows = []
    for conv in [*range(300), None]:
        for turn in range(rand.randrange(9)):
            text = rand.choice(["Yes.", "No!", "Well", "", " \t", "Why? ", "one two", None, "Yes. \x0b", "Én…"])
            rows.append((conv, rand.choice((turn, turn, turn, 3, None)), rand.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "superuser"]), text))
    check_conversations(spark, rows, str(tmp_path))


def test_one_conversation_over_many_chunks(spark, tmp_path, monkeypatch):
    """Paths of chunks put together equal the path of the whole."""
    rand = random.Random(6)
    rows = [(1, t, rand.choice(["user", "assistant", "system"]), rand.choice(["Yes.", "No", "", f"t{t}.", f"t{t}!", f"u{t}"])) for t in range(120)] + [(2, 0, "user", "Hi.")]
    monkeypatch.setattr(cv, "CHUNK_BITS", 2)
    check_conversations(spark, rows, str(tmp_path))


@needs_tables
def test_given_conversations(spark, tmp_path):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SMALL}/conversations.parquet'").fetchall()
    check_conversations(spark, rows, str(tmp_path))


def test_repaired_messages(spark):
    rows = spark.createDataFrame([(7, 0, "user", "Hi."), (7, 1, "user", "Hello?"), (7, 2, "assistant", "Yes.")], "c int, t int, r string, x string")
    counts, edits = cv.repair(rows, "c", "t", "r", "x")
    assert [(e.edit, e.role, e.text) for e in edits.orderBy("ord", "step").collect()] == [("K", "user", "Hi."), ("I", "assistant", ""), ("K", "user", "Hello?"), ("K", "assistant", "Yes.")]
    assert counts.first().cost == 2


def test_no_conversations(spark, tmp_path):
    check_conversations(spark, [], str(tmp_path))


# --- 13: spelling variants ------------------------------------------------------------------


def plain_words(documents):
    counts = collections.Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in string.ascii_uppercase else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :]


def plain_variants(words):
    by_length = collections.defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    neighbours = {w: [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if near(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in neighbours.items() if vs}
    forms = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return {(w, forms.get(w), root(w), words[w], len(neighbours[w]), words[forms[w]] if w in forms else None) for w in words}


def test_variants_of_made_up_words(spark, tmp_path, monkeypatch):
    """Few letters, so that runs, several edits to the same word and long chains occur; and many blocks."""
    rand = random.Random(8)
    words = {"".join(rand.choice("abàÿ") for _ in range(rand.choice((6, 6, 7, 8)))): rand.choice((5, 6, 30, 150, 800)) for _ in range(1200)}
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "x" * 3000: 9, "x" * 3001: 90}
    monkeypatch.setattr(variants, "WORDS_PER_BLOCK", 40)
    got = variants.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {tuple(r) for r in got} == plain_variants(words) and len(got) == len(words)


def test_words_of_odd_documents(spark, tmp_path):
    docs = [(k, "Élève élève aaaaaaX aaaaaax été " + f"mot{'abcde'[k % 5]}rare ") for k in range(700)] + [(None, "Null null nullnull " * 9), (3, None), (4, ""), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS id").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_variants"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == plain_variants(plain_words(docs)) and any(r.form for r in got)


@needs_tables
def test_variants_of_given_documents(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    got = QUERIES["op13_variants"](spark, SMALL).collect()
    assert {tuple(r) for r in got} == plain_variants(plain_words(docs)) and len(got) > 100


def test_no_words(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op13_variants"](spark, str(tmp_path)).collect() == []
    assert QUERIES["op11_imatch"](spark, str(tmp_path)).collect() == []


# --- 11: fingerprints -----------------------------------------------------------------------


def test_odd_documents_and_their_next(spark, tmp_path):
    texts = {1: "Alpha beta gamma delta, epsilon", 2: None, 5: "", 7: "é" * 9, 8: "  \t", 9: "one two three", 12: "Alpha beta gamma delta, epsilon", 13: "w " * 50_000 + "end"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'x' AS fingerprint", "1 AS _id", "2 AS _block").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op11_imatch"](spark, str(tmp_path)).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for k, d in enumerate(ids):
        text, following = texts[d] or "", texts[ids[(k + 1) % len(ids)]] or ""
        q = len(text) // 4
        assert got[d].n_chars == len(text)
        assert got[d].edited_sha256 == hashlib.sha256((text[: len(text) - q] + following[:q]).encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[1].fingerprint == got[12].fingerprint != "" and got[2].fingerprint == got[5].fingerprint == got[8].fingerprint == ""
    assert got[2].near_next == 1.0 and got[2].near_edited == 1.0


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (3, "d e f"), (3, "d e f"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = imatch.i_match(docs).collect()
    assert len(prints) == 5 and len({r.fingerprint for r in prints}) == 3
    seated, order = imatch.with_next(docs)
    assert seated.filter("NOT _ghost").count() == 5 and seated.filter("_ghost").count() >= 1


@needs_tables
def test_edited_documents_are_nearer_than_the_next(spark):
    got = QUERIES["op11_imatch"](spark, SMALL).collect()
    assert sum(r.near_edited > r.near_next for r in got) >= 0.95 * len(got)
    assert sum(r.near_edited >= 0.3 for r in got) >= 0.85 * len(got)


@needs_tables
def test_neighbours_do_not_depend_on_blocks(spark, monkeypatch):
    whole = {tuple(r) for r in QUERIES["op11_imatch"](spark, SMALL).collect()}
    monkeypatch.setattr(imatch, "BLOCK_BYTES", 1 << 40)
    assert {tuple(r) for r in QUERIES["op11_imatch"](spark, SMALL).collect()} == whole
