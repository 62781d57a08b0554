"""The operators that SQL cannot express, against plain Python on the small tables; and those that it can, against DuckDB."""

from __future__ import annotations

import collections
import hashlib
import html
import math
import pickle
import random
import re
import string
import tracemalloc
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from checks.compare import compare, connect
from hoopline.llm import context_mixing, html_text, near_dedup, packing, quality_cnn, secrets, sharding, shingles, warc
from hoopline.llm.oracle import ORACLE
from hoopline.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SMALL}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, name):
    result = compare(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE[name])
    assert result.startswith("ok"), result


# --- 1: language-model scores ---------------------------------------------------------------


def test_base_scores(spark, documents):
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in t)), None] for d, t in documents.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in documents}
    known = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    below = sum(known.values()) + len(known) + 1
    got = QUERIES["op1_lm_scores"](spark, SMALL).collect()
    assert {r.doc_id for r in got} == set(documents)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(known[w] > 0 for w in ws), sum(known.values()))
        assert r.base_score == pytest.approx(sum(math.log10((known[w] + 1) / below) for w in ws))
        assert r.score < 0


def small_model():
    words = [b"alpha", b"beta", b"alphabet", context_mixing.END]
    counts = np.array([50, 30, 5, 20])
    code = context_mixing.Code(np.bincount(np.frombuffer(b"alphabetalphabet \n", np.uint8), minlength=256))
    used = context_mixing.whole_word_slots(words, code)
    table = np.zeros((context_mixing.SLOTS, 2), np.float32)
    context_mixing.add_counts(table, words, counts, code, used)
    model = context_mixing.Model(table, code)
    model.fit(table, [[b"alpha", b"beta", context_mixing.END]] * 5)
    return model


def test_probabilities_of_all_first_bytes_sum_to_one():
    """A prefix code over bytes: the probabilities of all one-byte continuations of the start are a distribution."""
    model = small_model()
    nodes = collections.defaultdict(float)
    slots, bits, per_word = context_mixing.slots_of([bytes([b]) for b in range(1, 256) if b not in (9, 10, 11, 12, 13, 32)], model.code)
    x = np.ones((len(bits), context_mixing.INPUTS), np.float32)
    for k in range(context_mixing.K):
        x[:, k] = model.odds[slots[k]] / context_mixing.ODDS_SCALE
    x[:, context_mixing.K : -1] = 0
    gate = model._gate(model.sure[slots[context_mixing.WHOLE]], model.sure[slots[context_mixing.THREE]])
    p_one = 1 / (1 + np.exp(-(x * model.weights[gate]).sum(1)))
    for (slot, g), p in zip(zip(slots[0], gate, strict=True), p_one, strict=True):
        nodes[slot, g] = p
    assert all(0 < p < 1 for p in nodes.values())


def test_scores_do_not_depend_on_the_batch():
    model = small_model()
    texts = [context_mixing.words_of(t) for t in ("alpha beta", "", "beta beta gamma " * 40, "alphabet")]
    together = model.scores(texts)
    alone = [model.scores([t])[0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-5)
    assert context_mixing.Model.of_state(model.state()).scores(texts) == pytest.approx(together)


def test_slots_are_sent_packed():
    """Empty slots take no room where executors keep what they are sent, and the slots arrive as they were."""
    model = small_model()
    table = np.zeros((context_mixing.SLOTS, 2), np.float32)
    table[5] = 3, 0.5
    sent = context_mixing._packed(model.state() | {"counts": table})
    assert len(pickle.dumps(sent)) < 2e6
    arrays = context_mixing._unpacked(sent)
    again = context_mixing.Model.of_state(arrays)
    assert (again.odds == model.odds).all() and (again.sure == model.sure).all() and (arrays["counts"] == table).all()
    assert (again.weights == model.weights).all() and (again.code.sizes == model.code.sizes).all()


def test_what_a_process_is_sent_is_unpacked_once():
    """All tasks of a process share the arrays, and the packed ones go."""
    table = np.arange(20, dtype=np.float32).reshape(10, 2)
    sent = pickle.loads(pickle.dumps(context_mixing.Sent({"counts": table, "byte_counts": np.ones(256)})))
    arrays = sent.arrays()
    assert (arrays["counts"] == table).all() and (arrays["byte_counts"] == 1).all() and not sent.packed
    assert sent.arrays()["counts"] is arrays["counts"]


def test_bits_are_expanded_a_few_at_a_time():
    """A lot of bits is not turned into doubles whole, and its sums are those of all bits."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300_000, context_mixing.INPUTS)).astype(np.float32)
    gate, bits = np.repeat([2, 7], 150_000), rng.integers(0, 2, 300_000)
    now = rng.normal(size=(context_mixing.GATES, context_mixing.INPUTS))
    tracemalloc.start()
    curve, pull = context_mixing._expanded(x, gate, bits, now)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6
    for g in (2, 7):
        own = x[gate == g].astype(float)
        p = 1 / (1 + np.exp(-np.clip(own @ now[g], -30, 30)))
        whole = (own.T * (p * (1 - p))) @ own
        assert curve[g] == pytest.approx(whole) and pull[g] == pytest.approx(whole @ now[g] - (p - bits[gate == g]) @ own)
    assert not curve[3].any() and not pull[3].any()


def test_units_are_read_a_few_at_a_time(spark):
    """A unit has two million characters, and readers hold all text of a row group."""
    rows = spark.range(0, 24, 1, 1).selectExpr("id AS doc_id", "false AS held_out", "array_join(transform(sequence(1, 16400), x -> sha2(concat(id, '.', x), 256)), ' ') AS text")
    units = context_mixing.in_slices(rows)
    groups = [m.row_group(k) for f in units.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:")).metadata] for k in range(m.num_row_groups)]
    assert units.count() == sum(g.num_rows for g in groups) >= 12 and max(g.num_rows for g in groups) <= 5


def test_the_model_learns_online():
    """A repeated line costs less the tenth time."""
    model = small_model()
    line = context_mixing.words_of("zyxw vuts rqpo nmlk jihg fedc " * 8)[:-1]
    once, ten = model.scores([line])[0], model.scores([line * 10])[0]
    assert ten > 10 * once * 0.6


# --- 2: near duplicates ---------------------------------------------------------------------


def true_components(documents):
    sets = {}
    for d, t in documents.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in t))
        sets[d] = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sets, {d: root(d) for d in sets}


def test_near_duplicates(spark, documents):
    sets, want = true_components(documents)
    got = {r.doc_id: r for r in QUERIES["op2_near_dedup"](spark, SMALL).collect()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), want[d], want[d] == d) for d in documents}


def near_copies(n, seed=3):
    """Copies of one text with up to a quarter of the words changed, some so that they hardly meet the bound."""
    rand = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    out = {}
    for d in range(n):
        words = list(base)
        for _ in range(rand.choice((0, 1, 1, 2, 3, 4, 6))):
            words[rand.randrange(len(words))] = f"x{rand.random()}"
        out[d] = " ".join(words)
    return out


@pytest.mark.parametrize("node", [256, 12, 5])
def test_a_large_group_of_near_copies(spark, monkeypatch, node):
    """With tiny nodes the hubs, the deeper levels and the blocks of what is left over all come into play."""
    monkeypatch.setattr(near_dedup, "NODE", node)
    docs = near_copies(80)
    _, want = true_components(docs)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame).collect()}
    assert got == want


def test_components_of_paths_and_stars(spark):
    rand = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 30)] + [(rand.randrange(200, 260), rand.randrange(200, 260)) for _ in range(50)]
    rand.shuffle(edges)
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.cls: r.comp for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_shingle_sets_equal_python_sets():
    text = "Ab c\td Éé f\n g  h ab C d éé F"
    ws = text.replace("A", "a").replace("C", "c").replace("F", "f").split()
    assert len(shingles.shingle_set(text)) == len({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)})
    assert len(shingles.shingle_set(" a  b ")) == 1 and len(shingles.shingle_set(None)) == 0
    assert (shingles.shingle_set("A b C d e") == shingles.shingle_set("a B c D E")).all()


# --- 3 and 5: shards and sequences ----------------------------------------------------------


def test_shards(spark, documents):
    got = QUERIES["op3_sharding"](spark, SMALL).collect()
    size = {d: len(t.encode()) + 16 for d, t in documents.items()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {d: (size[d], zlib.crc32(t.encode())) for d, t in documents.items()}
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append((r.slot, r["size"]))
    assert all(sorted(s for s, _ in rows) == list(range(len(rows))) for rows in per.values())
    sums = [sum(s for _, s in per[k]) for k in range(40)]
    assert max(abs(s - sum(sums) / 40) for s in sums) <= max(size.values())


def test_a_hot_key_is_spread(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 7L ELSE xxhash64(id) END AS k", "100L AS size")
    got = sharding.range_shards(rows, "k", "doc_id", "size", 10).groupBy("shard").count().collect()
    assert {r["count"] for r in got} == {300}


def test_sequences(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in documents.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in QUERIES["op5_packing"](spark, SMALL).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for group, whole in ((pieces, {d: len(x) for d, x in ids.items()}), (sequences, None)):
        for key, parts in group.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == whole[key] if whole else at <= 1024
    assert set(pieces) == set(documents)
    assert sum(map(len, ids.values())) > 0.97 * 1024 * len(sequences)


def test_packing_keeps_all_three_limits():
    rand = np.random.default_rng(1)
    sizes = np.stack([rand.integers(1, 900, 500), np.ones(500, int), rand.integers(0, 400, 500)], 1)
    sizes[7] = (5000, 1, 10)
    limits = (1024, 4, 600)
    sequence, place = packing.pack_sizes(sizes, limits)
    for k in set(sequence.tolist()):
        own = sequence == k
        assert (sizes[own].sum(0) <= limits).all() or own.sum() == 1
        assert sorted(place[own].tolist()) == list(range(own.sum()))
    least = max(sizes.sum(0)[0] / 1024, sizes.sum(0)[2] / 600, 500 / 4)
    assert len(set(sequence.tolist())) < 1.15 * least + 2


def test_ids_are_those_of_tokenizers():
    rand, own = random.Random(9), packing.TextTokenizer()
    parts = ["a", "B", " ", "  ", "\n", "\t", "\xa0", "é", "日", "12", "'s", "'LL", "!", "--", "\x1c", "<|endoftext|>", "\x00", "👍", "\r\n"]
    for _ in range(2000):
        text = "".join(rand.choices(parts, k=rand.randrange(20)))
        assert own.encode(text) == own._whole.encode(text, add_special_tokens=False).ids


# --- 6 and 7: pages -------------------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    pages = pages.unionByName(pages.limit(9).selectExpr("page_id + 900000 AS page_id", "url", "html")).unionByName(
        spark.createDataFrame([(1_000_000, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb" * 9), (1_000_001, None, None)], pages.schema)
    )
    path, target = str(tmp_path / "archive"), str(tmp_path / "warc")
    warc.write_archive(pages, path)
    want = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    number = lambda header: int(re.search(r"WARC-Record-ID: <urn:page:(\d+)>", header)[1])
    rebuilt = {number(r.header): (r.header, bytes(r.payload)) for r in warc.records(spark, path).collect()}
    assert spark.read.parquet(f"{path}/payloads").count() == len(set(want.values()))
    warc.export_warc(spark, path, target, file_bytes=50_000)
    assert len(list(Path(target).glob("part-*"))) > 5
    files = {number(r.header): (r.header, bytes(r.payload)) for r in warc.read_warc(spark, target).collect()}
    assert files == rebuilt and set(files) == set(want)
    told = {r.page_id: r for r in warc.read_records(spark, target).collect()}
    assert {p: (r.payload_bytes, r.payload_digest) for p, r in told.items()} == {p: (len(t), hashlib.sha256(t).hexdigest()) for p, t in want.items()}
    for page_id, (header, payload) in files.items():
        assert payload == (b"" if "WARC-Type: revisit" in header else want[page_id])
        assert hashlib.sha256(want[page_id]).hexdigest() in header


@pytest.mark.parametrize("damage, error", [(lambda t: t.replace(b"xxx", b"xyx", 1), "does not fit"), (lambda t: t.replace(b"xxx", b"xx", 1), "does not end"), (lambda t: t[t.index(b"WARC/1.1", 5) :], "missing")])
def test_a_damaged_record_fails_the_read(spark, tmp_path, damage, error):
    import gzip

    from pyspark.errors import PySparkException

    path, target = str(tmp_path / "archive"), tmp_path / "warc"
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "v", "x" * 200)], "page_id long, url string, html string").coalesce(1)
    warc.write_archive(pages, path)
    target.mkdir()
    whole = sorted(((r.header.encode() + bytes(r.payload) + b"\r\n\r\n") for r in warc.records(spark, path).collect()), key=lambda x: b"revisit" in x)
    (target / "part-0.gz").write_bytes(gzip.compress(damage(b"".join(whole))))
    with pytest.raises(PySparkException, match=error):
        warc.read_records(spark, str(target)).collect()


def test_a_damaged_payload_fails_the_read(spark, tmp_path):
    from pyspark.errors import PySparkException

    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string"), path)
    spark.createDataFrame([("0" * 64, b"other")], "payload_digest string, payload binary").write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(PySparkException, match="does not fit"):
        warc.read_archive(spark, path).collect()


def test_main_text_of_all_pages(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SMALL}/pages.parquet'").fetchall())
    for r in QUERIES["op7_html_text"](spark, SMALL).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|li|ul)>", " ", article))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


PAGES = {
    "<body><header>x y</header><nav><a>m</a></nav><article><h1>T &amp; U</h1><p>foo <b>b</b>ar &lt;i&gt;<form>hi there</form><p>end</article><aside>s</aside><footer>f</footer>": "T & U foo bar <i> end",
    "<article><p>one<div class='ad-slot'>buy buy buy buy buy buy buy buy buy buy buy</div><p>two</article><section id=comments><p>I think so too and more</section>": "one two",
    "<html><script>if (a < b) x = '</p>';</script><style>p{}</style><main><p>text</p><!-- no <p>word</p> --></main>": "text",
    "<div class='cookieNotice'>we use cookies</div><div id=content><p>Some plain words stand here.</p><p>More.</p></div><div class=comments>me too</div>": "Some plain words stand here. More.",
    "<p title='a > b'>x\n\t y&nbsp;z": "x y z",
    "<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>": "a b c d",
    "": "",
    "plain text": "plain text",
    "<nav>only menu</nav>": "",
}


def test_main_text_of_hand_made_pages():
    learned = html_text.learn_weights([r[0] for r in duckdb.sql(f"SELECT html FROM '{SMALL}/pages.parquet' LIMIT 60").fetchall()])
    for weights in ({}, learned):
        assert {page: html_text.main_text(page, weights) for page in PAGES} == PAGES


# --- 8: quality -----------------------------------------------------------------------------


def test_held_out_accuracy_of_quality(spark):
    """On documents that the network did not learn from, at the next larger size."""
    sf_dir = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    got = [r for r in QUERIES["op8_quality"](spark, sf_dir).collect() if r.doc_id in labels and r.held_out]
    assert len(got) > 60 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum(r.predicted == labels[r.doc_id] for r in got) / len(got) > 0.93
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_slopes_equal_differences():
    rand = np.random.default_rng(2)
    texts = ["".join(rand.choice(list("abc |#"), 700)) for _ in range(4)]
    model = quality_cnn.fit(texts, [1, 0, 1, 0], epochs=1)
    model = {k: v.astype(np.float64) for k, v in model.items()}
    docs = [quality_cnn.chunks(t) for t in texts]
    rows, sizes, y = np.concatenate(docs), np.array([len(d) for d in docs]), np.array([1.0, 0, 1, 0])

    def loss():
        hidden, _ = quality_cnn.pooled(model, rows)
        p = quality_cnn._combined(model, hidden, sizes)[1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    slopes = quality_cnn._slopes(model, rows, sizes, y, np.ones(4))
    for name, at in (("filters", (5, 3)), ("bias", (2,)), ("embed", (ord("a"), 1)), ("shift", (0,))):
        model[name][at] += 1e-5
        up = loss()
        model[name][at] -= 2e-5
        down = loss()
        model[name][at] += 1e-5
        assert slopes[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-2, abs=1e-5)


def test_every_byte_is_in_a_chunk():
    for n in (0, 1, 255, 256, 257, 479, 480, 481, 5000):
        text = "".join(chr(33 + k % 90) for k in range(n))
        rows = quality_cnn.chunks(text)
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        seen = np.zeros(len(rows) * step + quality_cnn.OVERLAP, np.uint8)
        for k, row in enumerate(rows):
            seen[k * step : k * step + quality_cnn.CHUNK] = row
        assert seen[:n].tobytes() == text.encode() and not seen[n:].any()


# --- 10: secrets ----------------------------------------------------------------------------


def plain_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = []
    for place, (kind, pattern, group, least) in enumerate((("assign", assign, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))):
        found += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if len(m[group]) >= least]
    return [shown for _, _, shown in sorted(found)]


def test_base_secrets(spark, documents):
    for r in QUERIES["op10_secrets"](spark, SMALL).collect():
        base = plain_base(documents[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_random_spans_by_plain_likelihoods(spark, documents):
    """Both models counted pair by pair over all documents, and every long token judged on its own."""
    alphabet = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_.=-"
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    random_pairs, ordinary_pairs, free = collections.Counter(), collections.Counter(), {}
    for d, text in documents.items():
        spans = []
        for pattern, group, least in ((assign, 2, 12), (re.compile("AKIA[A-Z0-9]+"), 0, 18), (re.compile("[0-9a-f]+"), 0, 16)):
            for m in pattern.finditer(text):
                if len(m[group]) >= least:
                    spans.append(m.span())
                    random_pairs.update(zip(["start", *m[group]], m[group]))  # noqa: B905
        outside = [m for m in re.finditer("[A-Za-z0-9+/_.=-]+", text) if not any(a < m.end() and m.start() < b for a, b in spans)]
        for m in outside:
            if len(m[0]) >= 4:
                ordinary_pairs.update(zip(["start", *m[0]], m[0]))  # noqa: B905
        free[d] = [m for m in outside if len(m[0]) >= 20]

    def log_of(pairs, uniform):
        totals = collections.Counter()
        for (a, _), n in pairs.items():
            totals[a] += n
        return lambda a, b: math.log((1 - uniform) * (pairs[a, b] + 1e-9) / (totals[a] + 1e-9 * len(alphabet)) + uniform / len(alphabet))

    random_log, ordinary_log = log_of(random_pairs, 0.5), log_of(ordinary_pairs, 0.02)
    wanted = {}
    for d, tokens in free.items():
        judged = [(m, sum(random_log(a, b) - ordinary_log(a, b) for a, b in zip(["start", *m[0]], m[0])) / len(m[0])) for m in tokens if len(set(m[0])) >= 8]  # noqa: B905
        wanted[d] = {f"random:{m.start()}:{m.end()}" for m, value in judged if value > 1.0}
    got = {r.doc_id: {s for s in r.spans.split(",") if s.startswith("random")} for r in QUERIES["op10_secrets"](spark, SMALL).collect()}
    assert got == wanted and sum(random_pairs.values()) > 100


def test_base_secrets_of_odd_texts():
    rand = random.Random(4)
    parts = ["token", "TOKEN", "api_key", "apikey", "secret", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH1234567890", "0123456789abcdef", "abcdefabcdefabcdef", "x", "é", "ſecret", ".", "\n", "password=short"]
    for _ in range(3000):
        text = "".join(rand.choices(parts, k=rand.randrange(12)))
        assert [f"{k}:{a}:{b}" for a, _, b, k in secrets.base_spans(text)] == plain_base(text)


def test_random_strings_are_told_from_identifiers():
    rand = random.Random(8)
    names = ["get_user_account_by_id", "internationalization_settings", "application_configuration", "request_handler_factory", "the_quick_brown_fox_jumps"]
    texts = [" ".join(rand.choices(names, k=30)) + f" token = \"{''.join(rand.choices('0123456789abcdef', k=40))}\"" for _ in range(80)]
    table = secrets.tables(sum(secrets.pair_counts(t) for t in texts))
    alphabets = (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/")
    hits = [secrets.all_spans("value " + "".join(rand.choices(a, k=36)) + " end", table)[1] for a in alphabets for _ in range(50)]
    assert sum(bool(h) for h in hits) / len(hits) > 0.9
    assert not any(secrets.all_spans(" ".join(rand.choices(names, k=5)), table)[1] for _ in range(50))
    assert not secrets.all_spans("-" * 60 + " " + "=" * 40, table)[1]


# --- The pipeline ---------------------------------------------------------------------------


def test_pipeline_stages(spark, documents):
    """Each stage against plain Python on what the stage before it kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, texts = {}, documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, SMALL), name)
        kept[name] = {r.doc_id: r.text or "" for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]

    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SMALL}/labels.parquet'").fetchall())
    clean = [d for d, q in labels.items() if q == 1 and d in texts]
    assert sum(d in kept["quality"] for d in clean) / len(clean) > 0.95

    last = {}
    for d, t in sorted(kept["quality"].items()):
        last[t] = d
    assert set(kept["exact_dedup"]) == set(last.values())

    _, component = true_components(kept["exact_dedup"])
    assert set(kept["near_dedup"]) == {d for d, c in component.items() if d == c}

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall("".join(c.lower() if c in string.ascii_uppercase else c for c in t))
    windows = set()
    for (t,) in duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall():
        ws = words(t or "")
        windows |= {tuple(ws[i : i + 10]) for i in range(max(1, len(ws) - 9))} if ws else set()
    sizes = {len(w) for w in windows}
    hit = {d for d, t in kept["near_dedup"].items() for ws in [words(t)] for n in sizes for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows}
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - hit

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in pieces} == set(kept["decontamination"])


# --- Contexts of the running text -----------------------------------------------------------


def test_pair_counts_equal_plain_counts(monkeypatch):
    """The counts of every bit below the words before it, with and without contexts kept in parts."""
    rand = random.Random(6)
    texts = [[*rand.choices([b"a", b"alpha", b"alp", b"beta", b"b", b"be"], k=rand.randrange(1, 30)), context_mixing.END] for _ in range(20)]
    code = context_mixing.Code(np.bincount(np.frombuffer(b"alphabetalphabet \n", np.uint8), minlength=256))
    tokens, words = context_mixing._numbered(texts)
    spelled = lambda w: "".join(str(b) for c in (w + b" " if w else b"\n") for b in code.bits[c, : code.sizes[c]])
    per_word = np.array([len(spelled(w)) for w in words])
    for hot in (set(), set(words), {b"alpha", b"b"}):
        pairs = context_mixing.Pairs(tokens, words, hot)
        rows = pairs.frame(np.ones(sum(map(len, texts)))).groupby(["pair", "key", "piece"], as_index=False)["n"].sum()
        table = context_mixing.bit_counts(rows, code)
        for order, (first, counts) in zip(context_mixing.ORDERS, pairs.counts(context_mixing._found(table), per_word), strict=True):
            plain = collections.Counter()
            where = [(tuple(t[max(0, k - order) : k]), spelled(w)) for t in texts for k, w in enumerate(t)]
            for context, bits in where:
                plain.update((context, bits[: k + 1]) for k in range(len(bits)))
            for (context, bits), at in zip(where, first.tolist(), strict=True):
                for k in range(len(bits)):
                    want = [plain[context, bits[:k] + b] for b in "01"]
                    assert counts[at + k] == pytest.approx(want, rel=0.1)


def test_what_units_ask_and_are_told():
    """Units that ask by bucket are told the counts that all of them have together, in less room than the pairs would take spelled out."""
    rand = random.Random(8)
    letters = "etaoinshr"
    known = ["".join(rand.choices(letters, k=rand.randrange(1, 7))).encode() for _ in range(300)]
    texts = [[*rand.choices(known, range(300, 0, -1), k=rand.randrange(1, 200)), context_mixing.END] for _ in range(90)]
    held_out = [k % 7 == 2 for k in range(90)]
    code = context_mixing.Code(np.bincount(np.frombuffer(b" ".join(known), np.uint8), minlength=256))
    for hot in (set(), set(known[:3]), {*known, context_mixing.END}):
        head = set(known[:50])
        units = [(texts[k : k + 30], held_out[k : k + 30]) for k in range(0, 90, 30)]
        asked = [context_mixing.Asked.of_texts(t, h, 4, code, hot, head) for t, h in units]
        packed = [dict(a.packed()) for a in asked]
        answers = [{} for _ in units]
        for bucket in range(4):
            given = [k for k, p in enumerate(packed) if bucket in p]
            for k, told in zip(given, context_mixing._bucket_answers([packed[k][bucket] for k in given], [True] * len(given), code), strict=True):
                answers[k][bucket] = told
        tokens, words = context_mixing._numbered(texts)
        counted = np.repeat([not h for h in held_out], [len(t) for t in tokens])
        rows = context_mixing.Pairs(tokens, words, hot, context_mixing.not_in(words, head)).frame(counted).groupby(["pair", "key", "piece"], as_index=False)["n"].sum()
        want = context_mixing._found(context_mixing.bit_counts(rows, code))
        plain = {int(name): want[3][a : a + n] for name, a, n in zip(*want[:3], strict=True)}
        for a, told in zip(asked, answers, strict=True):
            names, begin, bits, flat = a.found(told, code)
            for name, at, n in zip(names.tolist(), begin.tolist(), bits.tolist(), strict=True):
                assert (flat[at : at + n] == plain.get(name, 0)).all()
        moved = sum(len(p) for d in (*packed, *answers) for p in d.values())
        assert moved < 0.3 * sum(8 + 8 + len(p) + 8 + 2 * n for a in asked for p, n in zip((a.spellings.spelled[k] for k in a.number), a.found(answers[asked.index(a)], code)[2], strict=True))


def test_word_order_counts(spark, tmp_path):
    """A held-out text in the order of the training texts is likelier than its words in another order."""
    rand = random.Random(2)
    line = [f"w{k}" for k in range(40)]
    mixed_up = rand.sample(line, 40)
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = [(k, " ".join(line if k not in held[1:2] else mixed_up)) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in context_mixing.op1_lm_scores(spark, str(tmp_path)).collect()}
    assert got[held[0]] > got[held[1]] * 0.7


def test_rare_words_have_whole_word_counts(spark, monkeypatch, tmp_path):
    """With hardly any frequent words, the counts of a rare word are those of all training words that begin like it."""
    monkeypatch.setattr(context_mixing, "HEAD", 2)
    rows = [(k, "common common rare rarely zebra") for k in range(9)]
    docs = context_mixing.in_slices(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "doc_id = 8 AS held_out", "text"))
    model, _, head, pairs = context_mixing.train(docs)
    assert set(head) == {b"common", context_mixing.END}
    words = [b"rare", b"zebra", b"rarely"]
    per_word = context_mixing.slots_of(words, model.code)[2]
    alone = context_mixing.Pairs([], words, set(), np.arange(3))
    first, counts = alone.counts_alone(context_mixing._found(pairs.toPandas()), per_word)
    sums = [counts[a : a + n].sum(1) for a, n in zip(first.tolist(), per_word.tolist(), strict=True)]
    assert all(s[0] == pytest.approx(8 * 6, rel=0.1) for s in sums)
    stem = int(sum(model.code.sizes[c] for c in b"rare"))
    assert [sums[0][stem], sums[2][stem], sums[1][-1]] == pytest.approx([16, 16, 8], rel=0.1)


def test_weights_are_learned_from_all_training_documents(spark):
    """Long training documents, and more of them than any sample would hold, have their say in the starting weights."""
    short, long = "alpha beta alphabet gamma " * 4, "zyxw vuts rqpo nmlk jihg fedc " * 300
    weights = {}
    for case, texts in {"short": [short] * 40, "long": [short] * 40 + [long] * 40}.items():
        rows = [(k, False, text) for k, text in enumerate(texts)]
        docs = context_mixing.in_slices(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"))
        seen = []
        fitted = context_mixing._fitted
        try:
            context_mixing._fitted = lambda model, table, docs, *rest: seen.append(docs.count()) or fitted(model, table, docs, *rest)
            weights[case] = context_mixing.train(docs)[0].weights
        finally:
            context_mixing._fitted = fitted
        assert seen == [len(texts)]
    assert not np.allclose(weights["short"], weights["long"])


def test_sums_of_parts_add_up(monkeypatch):
    """Bits taken some at a time, and texts apart, lead to the weights of all at once."""
    rand = random.Random(5)
    texts = [[*rand.choices([b"a", b"alpha", b"alp", b"beta", b"b", b"be"], k=rand.randrange(1, 60)), context_mixing.END] for _ in range(60)]
    counts = collections.Counter(w for t in texts for w in t)
    code = context_mixing.Code(np.bincount(np.frombuffer(b"alphabetalphabet \n", np.uint8), minlength=256))
    table, words = np.zeros((context_mixing.SLOTS, 2), np.float32), list(counts)
    context_mixing.add_counts(table, words, np.array(list(counts.values())), code, context_mixing.whole_word_slots(words, code))
    whole = context_mixing.Model(table, code)
    halves = [whole.sums(table, part) for part in (texts[::2], texts[1::2])]
    parts = whole.settled(halves[0][0] + halves[1][0], halves[0][1] + halves[1][1])
    monkeypatch.setattr(context_mixing, "FIRST_FIT_BITS", 1 << 40)
    whole.fit(table, texts)
    assert abs(parts - whole.weights).max() < 0.1



def test_every_weight_is_refined_in_the_document():
    """From weights of zero, a text of less than 32 tokens gains by every single corpus context."""
    model = small_model()
    model.weights[:] = 0
    text = context_mixing.words_of("alpha beta " * 7)
    assert len(text) < 32
    still = model.scores([text], rate=0.0)[0]
    for k in range(context_mixing.K):
        single = context_mixing.Model.of_state({**model.state(), "odds": np.zeros_like(model.odds)})
        part = slice(context_mixing.OFFSETS[k], context_mixing.OFFSETS[k] + (1 << context_mixing.SLOT_BITS[k]))
        single.odds[part] = model.odds[part]
        none = context_mixing.Model.of_state({**model.state(), "odds": np.zeros_like(model.odds)})
        assert single.scores([text])[0] > none.scores([text])[0] > still - 1e-6


def test_pages_without_article_beside_marked_pages():
    """Stray words in the body of marked pages say nothing of pages whose content stands in the body."""
    marked = "<html><body><nav>menu</nav><p>by someone</p><article><p>" + "words of content " * 20 + "</p></article>stray caption</body></html>"
    bare = "by someone <article>words of content</article>"
    weights = html_text.learn_weights([marked] * 20 + [bare])
    assert html_text.main_text("<html><body><nav>menu</nav><div id=content><p>Some plain words.</p><p>More.</p></div><footer>f</footer></body></html>", weights) == "Some plain words. More."
    assert html_text.main_text("<body><article></article><section>Text stands here.</section></body>", weights) == "Text stands here."
    assert html_text.main_text("<div><p>No body tag.</p></div>", weights) == "No body tag."
    assert html_text.main_text(marked, weights) == " ".join(["words of content"] * 20)


def test_sparse_pairs_inside_a_shared_passage(spark, monkeypatch):
    """Pairs at the bound, linked with nothing else, whose shared shingles all stand in a passage that more than NODE other documents hold."""
    monkeypatch.setattr(near_dedup, "NODE", 3)
    docs, want = {}, {}
    for p in range(150):
        passage = [f"p{p}w{k}" for k in range(104)]
        for d in range(26):
            tail = 16 if d < 2 else 60
            docs[100 * p + d] = " ".join([*passage, *(f"t{p}.{d}.{k}" for k in range(tail))])
            want[100 * p + d] = 100 * p if d < 2 else 100 * p + d
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame).collect()}
    assert got == want


def test_classes_meet_their_values_once_for_all_their_groups(spark, monkeypatch):
    """A large group that shares a passage stands in a node of every tree; the joins by class still make at most one row of a class."""
    rand = random.Random(12)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(passage + [f"own{rand.random()}" for _ in range(30)])) for k in range(40)]
    rows += [(100 + k, " ".join([*passage, "copy", *(f"c{j}" for j in range(60)), f"x{k}"])) for k in range(12)]
    frame, made = spark.createDataFrame(rows, "doc_id long, text string"), []
    plain = type(frame).join

    def join(left, right, on=None, how=None):
        joined = plain(left, right, on, how)
        if on == "cls" and how is None:
            made.append((joined.count(), joined.select("cls").distinct().count()))
        return joined

    monkeypatch.setattr(near_dedup, "NODE", 8)
    monkeypatch.setattr(type(frame), "join", join)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame).collect()}
    assert got == {**{k: k for k in range(40)}, **{100 + k: 100 for k in range(12)}}
    assert len(made) >= 4 and all(n == classes for n, classes in made)
