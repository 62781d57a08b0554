"""Every operator on odd tables: nulls, empty and very long texts, ties, repeated rows, no rows, clashing names."""

from __future__ import annotations

import hashlib

import pytest

from hoopline.llm import context_mixing, decontaminate, exact_dedup, html_text, near_dedup, packing, quality_cnn, secrets, sharding, warc
from hoopline.llm.queries import QUERIES

LONG = " ".join(f"word{k % 977} other{k % 31}" for k in range(60_000))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta"), (2, "Alpha beta gamma delta epsilon zeta eta"), (3, None), (4, ""), (5, "  \t\n"), (6, "Éan ÉAN token = \"0123456789abcdef01\""),
    (7, LONG), (None, "no id here"), (8, "eight rows"), (8, "eight rows"), (9, "x"), (10, "<|endoftext|> special"), (11, "Spelling spelling SPELLING spellinG spelling spelling"),
]
CLASHING = ["rank", "digest", "quality_score", "cls", "comp", "sub", "node", "n", "word", "shard", "slot", "_key", "_id", "_text_hash", "score", "sig"]
TURNS = [(1, 0, "user", "Hi."), (1, 1, None, None), (1, None, "", ""), (2, 0, "assistant", LONG), (2, 0, "assistant", LONG), (None, None, None, None), (None, 3, "user", "x"), (None, 3, "user", "x"), (3, 0, "tool", " \t")]
PAGES = [(1, "u", "<p>" + "a" * 120), (2, "u", "<p>" + "a" * 120), (3, None, None), (None, "v\r\nx", ""), (4, "w", "<article>hi"), (4, "w", "<article>hi"), (5, "z", "<p>" + "b" * 100_000)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The odd rows, and the same tables without rows, as folders of Parquet files."""

    def write(name, rows, pages):
        path = str(tmp_path_factory.mktemp(name))
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS header").write.parquet(f"{path}/pages.parquet")
        items = [(1, "beta gamma"), (2, None), (3, ""), (4, "eight rows"), (4, "eight rows")] if rows else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        labels = [(1, 1, 0), (2, 0, 0), (4, None, 1), (9, 1, 0), (None, 1, 1)] if rows else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        turns = TURNS if rows else []
        spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS key", "1 AS ord", "2 AS kind").write.parquet(f"{path}/conversations.parquet")
        return path

    return write("odd", ROWS, PAGES), write("none", [], [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_row_has_a_result(spark, tables, name):
    odd, none = tables
    got = QUERIES[name](spark, odd).collect()
    if name == "op5_packing":
        assert sum(r["start"] == 0 for r in got) == len(ROWS)
    elif name == "op12_conversations":
        assert sorted(str(r["conv_id"]) for r in got) == sorted({str(t[0]) for t in TURNS})
    elif name == "op13_variants":
        assert {r["word"]: r["n"] for r in got} == {"spelling": 6}
    else:
        assert len(got) == (len(PAGES) if name.startswith(("op6", "op7")) else len(ROWS))
    assert QUERIES[name](spark, none).collect() == []


def test_pipeline_on_odd_tables(spark, tables):
    import corpus_pipeline

    odd, none = tables
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, odd)
        assert kept.columns == docs.columns
        kept.collect()
    assert corpus_pipeline.run(spark, none).collect() == []


def test_exact_results(spark, tables):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.op4_exact_dedup(spark, tables[0]).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[3, digest("")]["keep_id"] == 4 and got[3, digest("")]["group_size"] == 2 and not got[3, digest("")]["kept"]
    assert got[1, digest(ROWS[0][1])]["keep_id"] == 2 and got[None, digest("no id here")]["kept"]
    rows = [r for r in exact_dedup.op4_exact_dedup(spark, tables[0]).collect() if r["doc_id"] == 8]
    assert sorted(r["kept"] for r in rows) == [False, True]


def test_near_duplicates_of_odd_rows(spark, tables):
    got = near_dedup.op2_near_dedup(spark, tables[0]).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert all(by[k]["n_shingles"] == 0 and by[k]["component_id"] == k and by[k]["kept"] for k in (3, 4, 5))
    assert by[9]["n_shingles"] == by[8]["n_shingles"] == 1 and by[None]["component_id"] is None and by[None]["kept"]


def test_windows_of_odd_rows(spark, tables):
    got = {r["doc_id"]: r for r in decontaminate.op9_decontamination(spark, tables[0]).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (2, 1, True)
    assert (got[8]["n_hit"], got[8]["n_words"]) == (2, 2) and got[3]["n_words"] == 0 and not got[7]["contaminated"]


def test_other_odd_rows(spark, tables):
    odd = tables[0]
    scores = {r["doc_id"]: r for r in context_mixing.op1_lm_scores(spark, odd).collect()}
    assert scores[3]["n_tokens"] == scores[5]["n_tokens"] == 1 and scores[3]["score"] == scores[4]["score"] < 0
    found = {r["doc_id"]: r for r in secrets.op10_secrets(spark, odd).collect()}
    assert (found[6]["n_assign"], found[6]["n_hex"]) == (1, 1) and found[3]["spans"] == ""
    pages = warc.op6_warc(spark, odd).collect()
    assert [(r["record_type"], r["refers_to"]) for r in sorted(pages, key=lambda r: r["page_id"] or 0) if r["page_id"] in (1, 2)] == [("response", None), ("revisit", 1)]
    assert sum(r["payload_bytes"] == 0 for r in pages) == 2
    texts = {r["page_id"]: r["text"] for r in html_text.op7_html_text(spark, odd).collect()}
    assert texts[3] == "" and texts[None] == "" and texts[4] == "hi" and len(texts[5]) == 100_000
    assert all(0 <= r["score"] <= 1 for r in quality_cnn.op8_quality(spark, odd).collect())
    pieces = [r for r in packing.op5_packing(spark, odd).collect() if r["doc_id"] in (3, 4)]
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in pieces] == [(0, 1, 1)] * 2
    shards = sharding.op3_sharding(spark, odd).collect()
    assert {r["size"] for r in shards if r["doc_id"] in (3, 4)} == {16}
