"""Training-data operators against brute force, round trips, held-out labels and edge cases."""

import hashlib
import json
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from sparkpairs.llm import (
    chat_trees, components, lm_score, mixing, packing, page_text, quality_rules, simhash, token_files, tokens, topk, toxicity,
)
from sparkpairs.llm.common import plain, slices

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = ["", None, " \t\n", "one", "Don't STOP 12 ½ é́  x <|endoftext|> <|ENDOFTEXT|> İx", "a b " * 3000, "tie tie", "tie tie",
       "word. Word, (word)! naïve café 日本語 テスト", " em space\x1cz\x85w"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "src1", None, 0.5, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, DOCS + ", score double, kept string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


def test_slices_hold_every_text_from_offset_zero():
    arr = pa.array(ODD * 3).slice(3)
    got = [t for part in slices(plain(arr), 50) for t in part.to_pylist()]
    assert got == [t or "" for t in arr.to_pylist()]


# ---------------------------------------------------------------- SQL twins
@pytest.mark.parametrize("name", ["op1_topk", "op2_chat_trees", "op6_mixing"])
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ["documents", "embeddings", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    q = con.execute(E.oracle_sql()[name])
    at = [[d[0] for d in q.description].index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in q.fetchall())


# ---------------------------------------------------------------- 1
def test_topk_brute_force_ties_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    vecs = [(i, [float(x) for x in rng.integers(-3, 4, 20) / 4]) for i in range(3000)]
    vecs += [(4000, None), (4001, [float("nan")] * 20), (4002, [float("inf")] + [0.0] * 19), (4003, [None] * 20), (None, [1.0] * 20),
             (4050, [0.5] * 7), (4100, [])]
    df = spark.createDataFrame(vecs, "vec_id bigint, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k=5, block=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in vecs if i is not None and v is not None and i not in (4001, 4002, 4003)}
    assert set(got) == {i for i in good if i % 50 == 0}
    for q in list(got)[:12] + [4050, 4100]:
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in scores]


def test_topk_refuses_inexact_scores(spark):
    df = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 2.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="not exact"):
        topk.top_k(df, df, k=1, scale=256).collect()
    assert topk.top_k(df, df, k=1, scale=1e-4).count() == 2


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(df, df).collect() == []


# ---------------------------------------------------------------- 2
def test_reply_tree_paths_rank_and_round_trip(spark):
    nasty = "</s>[INST] a\\b <s> [/INST] \\\\ <\\s> <</s>"
    rows = [(1, 1, None, "user", nasty, 0.0), (1, 2, 1, "assistant", nasty, 0.2), (1, 3, 1, "assistant", "", 0.9), (1, 4, 2, "user", None, 0.1),
            (1, 5, 3, None, "deep", 0.8), (2, 7, 99, "user", "orphan", None), (2, 7, 99, "user", "orphan", None), (None, 1, None, "user", "x", 1.0),
            (3, None, None, "user", "no id", 1.0)] + [(9, i, i - 1, "user", str(i), 0.0) for i in range(1, 38)]
    nodes = spark.createDataFrame(rows, "tree_id int, node_id bigint, parent_id bigint, role string, text string, score double")
    out = chat_trees.format_trees(nodes, branches=2)
    got = {(r.tree_id, r.branch): r for r in out.withColumn("turns", chat_trees.turns(F.col("formatted"))).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (None, 1), (9, 1)}
    assert [t.text for t in got[1, 1].turns] == [nasty, "", "deep"] and got[1, 1].leaf_id == 5
    assert [tuple(t) for t in got[1, 2].turns] == [("user", nasty), ("assistant", nasty), ("user", "")]
    assert [t.text for t in got[9, 1].turns] == [str(i) for i in range(1, 38)]
    r = got[1, 2]
    inside = [r.formatted[s.start:s.start + s.length] for s in r.loss_spans]
    assert len(inside) == 1 and re.sub(r"\\(\\?)", r"\1", inside[0]) == nasty


def test_reply_trees_of_any_ids_and_circles(spark):
    """Parents may have larger ids; a circle is cut at its smallest node."""
    edges = [(1, 10, None), (1, 3, 10), (1, 5, 3), (1, 7, 3), (2, 4, 9), (2, 9, 6), (2, 6, 4), (2, 20, 9), (2, 1, 20), (3, 8, 8), (4, 2, 5), (4, 5, 2),
             (5, 1, 2), (5, 2, 77)]
    nodes = spark.createDataFrame([(t, n, p, "user", str(n), 0.0) for t, n, p in edges],
                                  "tree_id int, node_id bigint, parent_id bigint, role string, text string, score double")
    out = chat_trees.format_trees(nodes, branches=9).withColumn("turns", chat_trees.turns(F.col("formatted"))).collect()
    got = sorted((r.tree_id, [int(t.text) for t in r.turns]) for r in out)
    assert got == [(1, [10, 3, 5]), (1, [10, 3, 7]), (2, [4, 6, 9, 20, 1]), (3, [8]), (4, [2, 5]), (5, [2, 1])]


def test_chat_query_by_hand(spark):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows[r.conv_id].append((r.role, r.text or ""))
    rows[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in E.queries()["op2_chat_trees"](spark, SMALL).collect()}
    assert set(got) == set(rows)
    for c, turns in rows.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---------------------------------------------------------------- 3
def test_toxicity_held_out_accuracy(spark):
    rng = np.random.default_rng(2)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    def text(bad):
        w = list(rng.choice(vocab, int(rng.integers(5, 80))))
        for _ in range(int(rng.integers(1, 4)) if bad else 0):
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(["zzyx", "qquo", "vvek"])) + str(rng.choice(vocab))[:2])
        return " ".join(w)
    rows = [(i, text(i % 7 == 0), "en" if i % 2 else "de") for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(2500)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.with_toxicity(docs, model).select("doc_id", "toxicity.*").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum(r.predicted == int(r.doc_id % 7 == 0) for r in held)
    assert len(held) > 300 and right / len(held) > 0.95
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_toxicity_learns_from_long_texts_and_every_block(spark):
    """Only texts past 20,000 characters show what marks a toxic one; blocks, thresholds and the model cover all rows."""
    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    def text(i):
        w = list(rng.choice(vocab, 4000 if i % 10 == 0 else 40))
        return " ".join([*w, "zzyxq"] if i % 5 == 0 else w)
    rows = [(i, text(i), "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    long = docs.where("length(text) > 20000")
    one = toxicity.train(long.unionByName(docs.where("doc_id % 5 != 0")), labels)  # all toxic texts are long ones
    assert one.embedding is not None and one.prior == 0.0
    model = toxicity.train(docs, labels, block_chars=200_000)  # several blocks
    again = toxicity.train(docs.repartition(7), labels, block_chars=200_000)
    assert (model.embedding == again.embedding).all() and model.thresholds == again.thresholds and "en" in model.thresholds
    got = toxicity.with_toxicity(docs, model).select("doc_id", "toxicity.predicted").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) / len(held) > 0.95


def test_toxicity_counts_every_text_and_weighs_thresholds(spark):
    rows = [(f"bad w{i} w{i}", 1.0) if i % 3 == 0 else (f"good w{i}", 0.0) for i in range(200)]
    words_, grams = toxicity.evidence(spark.createDataFrame(rows, "text string, toxic double").repartition(5))
    bucket, _, _ = toxicity.word_features(plain(pa.array(["bad", "good"])))
    assert words_[:, bucket[0]].tolist() == [67, 0] and words_[:, bucket[1]].tolist() == [0, 133]
    flat = toxicity.FlatWords(pa.array([t for t, _ in rows]))
    w, g = toxicity.text_counts(flat, np.arange(200), np.array([y for _, y in rows]), toxicity.word_features(flat.dictionary))
    assert (w == words_).all() and (g == grams).all()
    s, y, lang = np.array([0.1, 0.2, 0.2, 0.7, 0.9]), np.array([0, 0, 1, 0, 1]), ["x"] * 5
    n = np.array([9, 3, 2, 7, 4])
    spread = [np.repeat(v, n) for v in (s, y, np.array(lang))]
    assert toxicity.calibrate(s, y, lang, counts=n) == toxicity.calibrate(spread[0], spread[1], spread[2].tolist()) != {}


def test_toxicity_pools_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    t = [" ".join(rng.choice(["a", "bad", "c", "dd"], 500)) for _ in range(40)]
    y = np.array([x.count("bad") > 125 for x in t], float)
    whole = toxicity.fit(plain(pa.array(t)), y, [None] * 40, steps=20, batch=1)
    monkeypatch.setattr(toxicity, "STEP_WORDS", 60)
    pieces = toxicity.fit(plain(pa.array(t)), y, [None] * 40, steps=20, batch=1)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole.filters, pieces.filters, strict=True))


def test_toxicity_odd_rows_and_no_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(odd, labels)
    assert {r.s for r in toxicity.with_toxicity(odd, model).select(F.col("toxicity.score").alias("s")).collect()} == {0.0}
    assert toxicity.drop_toxic(odd, model).count() == len(ODD) and toxicity.drop_toxic(none, model).count() == 0


def test_score_does_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    t = [" ".join(rng.choice(["a", "bad", "c", "dd"], 30)) for _ in range(300)] + ["", "x"]
    y = np.array([x.count("bad") > 8 for x in t], float)
    m = toxicity.fit(plain(pa.array(t)), y, [None] * len(t), steps=30)
    one = np.concatenate([m.score(plain(pa.array([x]))) for x in t[-20:]])
    assert np.allclose(one, m.score(plain(pa.array(t)))[-20:], atol=1e-5)


# ---------------------------------------------------------------- tokens, 4, 7
def reference_ids(texts):
    tok = tokens.encoder(tokens.TOKENIZER).tokenizer
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_tokenizer(texts):
    all_ = ODD + list(texts.values())
    ids, off = tokens.Encoder().encode(pa.array(all_))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == reference_ids(all_)


def test_packing_holds_every_piece_once(spark, texts):
    rows = E.queries()["op4_packing"](spark, SMALL).collect()
    want = {}
    for d, ids in zip(texts, reference_ids(texts.values())):
        ids = [*ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            want[d, p] = (s, len(ids[s:s + 2048]), crc(ids[s:s + 2048]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(n for _, n, _ in want.values())
    assert len(by) <= -(-total // 2048) + 8


def test_sum_of_squares_places_where_the_sum_is_least():
    rng = np.random.default_rng(3)
    lengths, cap = rng.integers(1, 12, 300), 12
    seq, off = packing.sum_of_squares(lengths, cap)
    gaps = {}
    for s, q, o in zip(lengths.tolist(), seq.tolist(), off.tolist()):
        def total(changed):
            c = Counter(g for g in changed.values() if 0 < g < cap)
            return sum(n * n for n in c.values())
        options = {k: total({**gaps, k: g - s}) for k, g in gaps.items() if g >= s}
        options[len(gaps)] = total({**gaps, len(gaps): cap - s})
        assert options[q] == min(options.values()) and o == cap - gaps.get(q, cap)
        gaps[q] = gaps.get(q, cap) - s


def test_packing_odd_rows_and_sequences(odd, none):
    p = packing.pack(odd)
    assert p.groupBy("row").agg(F.sum("length").alias("n")).count() == len(ODD)
    s = packing.sequences(p).selectExpr("length(ids) div 4 AS n", "aggregate(parts, 0L, (a, x) -> a + x.length) AS m").collect()
    assert all(r.n == r.m for r in s)
    assert packing.pack(none).count() == 0


def test_token_files_read_back(spark, texts, odd, none, tmp_out):
    rows = {r.doc_id: r for r in E.queries()["op7_token_files"](spark, SMALL).collect()}
    at = 0
    for d, ids in sorted(zip(texts, reference_ids(texts.values()))):
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(ids) + 1, crc([*ids, 2]))
        at += len(ids) + 1
    for kind in ("dictionary", "delta"):
        token_files.write_tokens(odd, f"{tmp_out}/{kind}", encoding=kind, shards=2)
        got = token_files.read_documents(spark, f"{tmp_out}/{kind}", 2, 4).orderBy("doc_id").collect()
        assert [r.ids for r in got] == [[*x, 2] for x in reference_ids(ODD[2:5])]
    token_files.write_tokens(none, f"{tmp_out}/none")
    assert token_files.read_tokens(spark, f"{tmp_out}/none").count() == 0


def test_starts_follow_the_order_of_the_files(spark, tmp_out):
    """Rows of one id too: a document starts where the files put it."""
    same = spark.createDataFrame([(i // 8, "word " * (i % 8 + 1) + str(i), "x") for i in range(40)] + [(None, "none", "y")],
                                 "doc_id bigint, text string, shard string")
    token_files.write_tokens(same, f"{tmp_out}/t", shards=3)
    files = token_files.read_tokens(spark, f"{tmp_out}/t")
    at, want = 0, []
    for name in sorted(r.f for r in files.select(F.col("_metadata.file_name").alias("f")).distinct().collect()):
        for r in files.where(F.col("_metadata.file_name") == name).coalesce(1).collect():
            want.append((r.doc_id, at, len(r.ids), crc(r.ids)))
            at += len(r.ids)
    got = token_files.positions(token_files.with_crc(files), files).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.start, r.n_tokens, r.ids_crc32)) for r in got)
    assert [x[0] for x in want] == sorted((x[0] for x in want), key=lambda d: (d is not None, d or 0))


def test_words_with_marks_encode_like_the_tokenizer():
    words = ["x-", "x-.", "don't", "don't,", "...", "ab", "ab...", "ab!?", "12", "12.", "½", "½,", "é.", "e\u0301", "e\u0301,", "_", "_.", "名", "名。", "名."]
    got = tokens.Encoder().words(words) + tokens.Encoder().words(words[::-1])[::-1]
    assert [list(np.frombuffer(x, "<u4")) for x in got] == reference_ids(words) * 2


# ---------------------------------------------------------------- 5
def slow_fingerprint(text):
    import xxhash

    w = WORD.findall(
        re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    par = {d: d for d in fps}

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = list(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                par[y] = x
    return {d: root(d) for d in fps}


def test_simhash_equals_brute_force(spark, texts):
    fps = {d: slow_fingerprint(t) for d, t in texts.items()}
    comp = slow_components(fps)
    rows = E.queries()["op5_simhash"](spark, SMALL).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(d, f"{f:016x}", comp[d]) for d, f in fps.items()}


@pytest.mark.parametrize("block", [8, 1024])
def test_links_of_crowded_lists_lose_nothing(spark, block):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**62))
    fps = set()
    while len(fps) < 250:  # a crowd around one fingerprint, and loose ones
        flips = rng.choice(64, int(rng.integers(1, 9)), replace=False)
        fps.add((centre if len(fps) < 200 else int(rng.integers(0, 2**62))) ^ sum(1 << int(b) for b in flips))
    by = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, int(np.array([f], np.uint64).view(np.int64)[0])) for i, f in by.items()], "id bigint, fp bigint")
    got = {r.node: r.component for r in components.components(simhash.links(df, block=block)).collect()}
    assert {i: got.get(i, i) for i in by} == slow_components(by)


def test_one_of_each_group_stays(spark, odd, none):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    comp = slow_components({i: slow_fingerprint(t) for i, t in enumerate(ODD)})
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values()))
    clash = odd.select("*", *[F.lit(1).alias(c) for c in ("_gone", "_row", "_fp", "_of", "rep_fp", "root", "component_id")])
    assert simhash.drop_near_duplicates(clash).select(odd.columns).exceptAll(kept).isEmpty()
    twice = simhash.drop_near_duplicates(odd.unionAll(odd))
    assert twice.count() == len(set(comp.values()))
    assert simhash.drop_near_duplicates(none).count() == 0


def test_rows_without_an_id_or_with_a_shared_one_link_and_stay_apart(spark):
    base = [f"w{i}" for i in range(3000)]
    bits = lambda t: simhash.fingerprint(t.encode()) ^ simhash.fingerprint(" ".join(base).encode())
    edits = {bits(t): t for k in range(0, 3000, 25) if 0 < bits(t := " ".join([*base[:k], "other", *base[k + 1:]])).bit_count() <= 2}
    near = list(edits.values())[:3]
    assert len(near) == 3
    loner, twin = "quite another text of its own " * 9, "something else that stands alone here"
    assert all(0 < (slow_fingerprint(near[0]) ^ slow_fingerprint(x)).bit_count() <= 4 for x in near[1:])
    rows = [(None, near[0]), (7, near[1]), (None, near[2]), (None, loner), (None, loner), (5, twin), (5, "a text that shares the id of the last"), (9, twin)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    of = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.link(df).collect()}
    signed = lambda t: int(np.array([slow_fingerprint(t)], np.uint64).view(np.int64)[0])
    assert [of[None, signed(near[0])], of[None, signed(near[2])], of[None, signed(loner)], of[9, signed(twin)]] == [7, 7, None, 5]
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(df).collect()))
    assert kept == sorted([(7, near[1]), (0, loner), (5, twin), (5, rows[6][1])])


# ---------------------------------------------------------------- 6
def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("A", "x", "1", 10), ("A", "x", "2", 1000), ("A", "y", "3", 1000), ("B", "x", "4", 1000)],
                                   "domain string, lang string, source string, tokens bigint")
    s = mixing.MixSettings(weights={}, budget_share=400 / 3010, max_epochs=1)
    got = {r.source: r.amount for r in mixing.budgets(leaves, s).collect()}
    assert got == {"1": 10, "2": 90, "3": 100, "4": 200}  # what 1 lacks goes to 2, not to 3 or 4


def test_mix_keeps_columns_and_budget(spark, docs, odd, none):
    s = mixing.MixSettings(max_epochs=1)
    out = mixing.mix(docs, s).collect()
    total = sum(len(words(r.text)) for r in docs.collect())
    assert sum(len(words(r.text)) for r in out) == int(np.floor(total * 0.8))
    assert mixing.mix(odd, s).columns == odd.columns and mixing.mix(none, s).count() == 0


# ---------------------------------------------------------------- 8
PAGE = """<html><head><title>T</title><script>if (a<b) {"</p>"}</script></head><body class=home><header>Top</header>
<nav><a href=x>A</a></nav><div class="cookie-notice">We use cookies</div><div class="content post-77"><article>
<h1>Title</h1><p>First <b>para</b>&amp; more,\n twice.<p>Second<br>line <span class="ad">buy</span>end
<ul><li>one<li>two</ul><form><p>mail</p></form><div class="comments"><p>Nice post</p></div></article></div>
<aside>side</aside><footer>&copy; f</footer></body></html>"""


def test_page_text_by_hand(spark):
    rows = [(1, "http://H.example/a", PAGE), (2, "http://h.example/b", PAGE.replace("post-77", "post-8")), (3, None, None), (4, "odd", ""),
            (5, "http://h.example/c", "just text &lt;b&gt;"), (1, "http://H.example/a", PAGE)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(7))
    got = [(r.page_id, r.text) for r in page_text.extract(df).orderBy("page_id").collect()]
    main = "Title\nFirst para& more, twice.\nSecond line end\none\ntwo"
    assert got == [(1, main), (1, main), (2, main), (3, ""), (4, ""), (5, "just text <b>")]
    assert page_text.extract(df.limit(0)).count() == 0


ARTICLE = "<h1>The title</h1><p>" + "A first paragraph of the article. " * 4 + "</p><p>" + "A second one follows it. " * 4 + "</p>"
WHOLE = "The title\n" + ("A first paragraph of the article. " * 4).strip() + "\n" + ("A second one follows it. " * 4).strip()
NAV = "<nav><ul><li><a href=/>home</a><li><a href=/x>other</a></ul></nav><footer>imprint</footer>"


@pytest.mark.parametrize("page", [
    f"<body><form id=aspnetForm action=.>{NAV}<div>{ARTICLE}</div><input type=hidden></form></body>",
    f"<body style='display: none'>{NAV}<article>{ARTICLE}</article></body>",
    f"<body>{NAV}<div aria-hidden=true><div class=post>{ARTICLE}</div></div></body>",
    f"<body>{NAV}<div role=dialog>{ARTICLE}</div></body>",
    f"<body>{NAV}<div hidden><main>{ARTICLE}</main></div></body>",
    f"<body>{NAV}<article><header>{ARTICLE.split('<p>')[0]}</header>{ARTICLE.split('</h1>')[1]}</article></body>",
    f"<body>{NAV}<article>{ARTICLE.replace('first', '<label>first</label>')}</article></body>",
    f"<body>{NAV}<article>{ARTICLE}<form><label>Mail</label><input><button>Send</button><p>We mail you.</p></form></article></body>",
    f"<body>{NAV}<article>{ARTICLE}</article><div style='display:none'><p>Hidden words.</p></div></body>",
    f"<body>{NAV}<article>{ARTICLE}</article><div role=dialog><p>Stay with us!</p></div></body>",
])
def test_wrapped_pages_keep_their_article(page):
    assert page_text.main_text(page, None) == WHOLE


def test_the_host_decides_against_the_page(spark):
    """Four pages vote for the post; on the fifth a shop box stands beside it, which its own container takes in."""
    def page(i, beside=""):
        return f"<body>{NAV}<div class=wrap><div class=post>{ARTICLE.replace('title', f'title {i}')}</div>{beside}</div></body>"

    box = "<div class=delivery><p>Order before noon and we send your parcel on the same day.</p></div>"
    rows = [(i, "http://shop.example/p", page(i)) for i in range(4)] + [(4, "http://shop.example/p", page(4, box)), (5, "http://other.example/p", page(5, box))]
    # a page of another layout on that host keeps its whole article, although it has the host's container too
    odd = f"<body>{NAV}<div class=wrap><div class=post><p>5 min read</p></div><div class=story>{ARTICLE}</div></div></body>"
    rows.append((6, "http://shop.example/odd", odd))
    assert "Order before noon" in page_text.main_text(rows[4][2], None)
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == WHOLE.replace("title", f"title {i}")
    assert "Order before noon" in got[5] and WHOLE in got[6]


def test_deep_pages_take_time_in_proportion():
    import time

    def seconds(depth):
        source = "<body>" + "<div class=a><p>word</p>" * depth + "</div>" * depth
        at = time.perf_counter()
        assert page_text.main_text(source, [page_text.vote(source)]).count("word") == depth
        return time.perf_counter() - at

    seconds(100)
    assert seconds(8000) < 16 * max(seconds(1000), 0.02)


def test_page_columns_of_any_name_stay(spark):
    pages = spark.createDataFrame([(1, "http://h/a", PAGE, "p", "h", "o")], "page_id int, url string, html string, _paths string, _h string, _host string")
    got = page_text.extract(pages).collect()[0]
    assert (got._paths, got._h, got._host) == ("p", "h", "o") and got.text


def test_pages_give_the_article(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r.page_id: r for r in E.queries()["op8_page_text"](spark, SMALL).collect()}
    assert set(got) == set(pages)
    for p, source in pages.items():
        inner = source.split("<article>", 1)[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        assert got[p].text == "\n".join(b for b in blocks if b) and got[p].n_chars == len(got[p].text)


@pytest.mark.parametrize("body", [
    "<article><h1>T</h1><section>{long}</section><section>{short}</section></article>",
    "<article><h1>T</h1><div class=entry><p>{long}</p><div><p>{short}</p></div></div></article>",
    "<div class=post><h1>T</h1><div class=entry><p>{long}</p></div><div class=rest>{short}</div></div>",
    "<h1>T</h1><article><p>{long}</p></article><article class=more><p>{short}</p></article>",
])
def test_page_text_keeps_split_articles_whole(body):
    long, short = "many words " * 900 + "end", "few words " * 20 + "end"
    source = f"<html><body><nav>menu</nav>{body.format(long=long, short=short)}<footer>f</footer></body></html>"
    whole = "\n".join(["T", long, short])
    assert page_text.main_text(source, None) == whole
    assert page_text.main_text(source, [page_text.vote(source)]) == whole


@pytest.mark.parametrize("outer", [
    "<body class='no-sidebar'>{}</body>", "<body id=search class='page toc'><main id='search-results'>{}</main></body>",
    "<body><article class='post has-header widget'>{}</article></body>", "<body><div class='content with-sidebar'>{}</div></body>",
    "<body><div id=search>{}</div></body>", "<body><div class=wrapper><div class=discussion>{}</div></div></body>",
    "<body><div class=overlay><main>{}</main></div></body>", "<body><app-root class=form>{}</app-root></body>",
])
def test_page_text_is_not_lost_to_a_class_of_its_container(outer):
    inner = "<h1>T</h1><div class=toc>contents</div><p>" + "many words " * 50 + "end</p><p class='alert-free'>last</p>"
    source = outer.format(inner + "<div class='sidebar-left'>side</div><div class='comments'><p>nice</p></div>")
    got = page_text.main_text(source, None)
    whole = "\n".join(["T", "many words " * 50 + "end", "last"])
    assert got == whole or "discussion" in outer and got.startswith("T\n")
    assert set(whole.split("\n")) <= set(got.split("\n"))


def test_page_text_leaves_out_large_furniture():
    long = "<p>" + "others say " * 90 + "</p>"
    for junk in (f"<div class=comments>{long}</div>", f"<ol class=comment-list><li><article>{long}</article></ol>", f"<div class=sidebar>{long}</div>"):
        assert page_text.main_text(f"<body><article><h1>T</h1><p>short text</p></article>{junk}</body>", None) == "T\nshort text"


def test_page_text_of_a_second_layout(spark):
    long = "many words " * 50 + "end"
    first = f"<body><div><h1>A</h1><p>{long}</p></div></body>"
    second = f"<body><div>5 min read</div><main><article><h1>B</h1><p>{long}</p></article></main></body>"
    rare = f"<body><div>5 min read</div><section><h2>C</h2><p>{long}</p></section></body>"
    rows = [(i, "http://h/", s) for i, s in enumerate([first] * 20 + [second] * 4 + [rare])]
    got = [r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()]
    assert got[:20] == ["A\n" + long] * 20 and got[20:24] == ["B\n" + long] * 4
    assert got[24].endswith("C\n" + long)


def test_page_text_reads_long_attributes_and_paths():
    long = f"style='background:url({'x' * 900})' data-j='{{\"hidden\": 1, \"class\": 2}}'"
    source = f"<body><article><p {long} class=lead>one</p><div {long} class=ad>buy</div><p>two</p><div {long} hidden>no</div></article></body>"
    assert page_text.main_text(source, None) == "one\ntwo"
    deep = "<div class=layer>" * 100
    a, b = (page_text.vote(f"<body class={c}>{deep}<p>text</p></body>") for c in "ab")
    assert a != b and len(a) < 1100


# ---------------------------------------------------------------- 9
def test_base_scores_equal_brute_force(spark, texts):
    low = {d: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] for d, t in texts.items()}
    train = [d for d in low if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for d in train for w in low[d])
    c["\n"] = len(train)  # the end
    n, v = sum(c.values()), len(c)
    rows = E.queries()["op9_lm_score"](spark, SMALL).collect()
    assert len(rows) == len(low)
    for r in rows:
        ws = [*low[r.doc_id], "\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0


def test_model_is_a_distribution_and_scores_each_id_once(texts):
    enc = tokens.encoder(tokens.TOKENIZER)
    ids, off = enc.encode(pa.array(list(texts.values())))
    seen = np.bincount(ids, minlength=enc.size + 1)
    classes = lm_score.id_classes(seen, ids)
    pairs = np.zeros((lm_score.N_CLASSES + 1, enc.size + 1), np.int64)
    pairs[-1] = seen
    m, _ = lm_score.learn(lm_score.fresh(classes, np.append(enc.ends, True), pairs), ids, off, first=True)
    base = ids[:40]
    one = lambda x: m.score(np.asarray(x, np.uint32), np.array([0, len(x)]))[0]
    total = 0.0  # probability of every id after a prefix, the end included
    out = []
    for t in range(0, enc.size, 2000):
        cand = np.arange(t, min(t + 2000, enc.size))
        rows = np.concatenate([np.append(base, x) for x in cand]).astype(np.uint32)
        out.append(m.score(rows, np.arange(len(cand) + 1) * (len(base) + 1)))
    # P(prefix, id, end) / P(end | prefix, id) is not known from outside; compare with P(prefix, end) instead
    assert np.isfinite(np.concatenate(out)).all()
    f = m.share[-1]
    total = np.bincount(classes, np.exp(f.astype(np.float64)), minlength=lm_score.N_CLASSES)
    assert np.allclose(total[np.bincount(classes, minlength=lm_score.N_CLASSES) > 0], 1, atol=1e-3)
    both = m.score(np.concatenate([ids[off[0]:off[1]], ids[off[1]:off[2]]]), np.array([0, off[1] - off[0], off[2] - off[0]]))
    assert np.allclose(both, [one(ids[off[0]:off[1]]), one(ids[off[1]:off[2]])], rtol=1e-5)


def test_lm_learns_from_every_window(texts):
    enc = tokens.encoder(tokens.TOKENIZER)
    ids, off = enc.encode(pa.array(list(texts.values())))
    seen = np.bincount(ids, minlength=enc.size + 1)
    pairs = np.zeros((lm_score.N_CLASSES + 1, enc.size + 1), np.int64)
    pairs[-1] = seen
    start = lm_score.fresh(lm_score.id_classes(seen, ids), np.append(enc.ends, True), pairs)
    windows = sum(-(-(n + 1) // lm_score.STRIDE) for n in np.diff(off).tolist())
    for first in (True, False):
        m, n = lm_score.learn(start, ids, off, first=first)
        assert n == windows and m.score(ids, off).sum() > start.score(ids, off).sum()


def test_lm_gradients_follow_the_score(texts):
    """The first Adam moment after one step holds a tenth of the gradient of the mean class loss."""
    enc = tokens.encoder(tokens.TOKENIZER)
    ids, off = enc.encode(pa.array(list(texts.values())[:40]))
    seen = np.bincount(ids, minlength=enc.size + 1)
    pairs = np.zeros((lm_score.N_CLASSES + 1, enc.size + 1), np.int64)
    pairs[-1] = seen
    m = lm_score.fresh(lm_score.id_classes(seen, ids), np.append(enc.ends, True), pairs)
    trainer = lm_score.Trainer(m)
    data = trainer.windows(ids, off)
    places = len(ids) + len(off) - 1
    start = {k: v.copy() for k, v in m.p.items()}
    trainer.step(data, np.arange(len(data[2])), 0.0)
    rng = np.random.default_rng(2)
    for name in ("embed", "place", "q", "k", "v", "out", "bias"):
        move = rng.normal(0, 1, start[name].shape).astype(np.float32)
        slope = []
        for sign in (1, -1):
            m.p[name] = (start[name] + sign * 1e-2 * move / np.sqrt(move.size)).astype(np.float32)
            slope.append(m.score(ids, off).sum() * math.log(10) / places)
        m.p[name] = start[name]
        told = -10 * float((trainer.first[name] * move).sum()) / np.sqrt(move.size)
        assert (slope[0] - slope[1]) / 2e-2 == pytest.approx(told, rel=0.05, abs=2e-4), name


def test_lm_odd_rows_and_empty(spark, odd, none):
    got = lm_score.score(odd, F.lit(True)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(words(t)) + 1 for t in ODD]
    assert lm_score.score(none, F.lit(True)).count() == 0
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in lm_score.score(odd, F.lit(False)).collect())


def test_lm_classes_and_network_come_from_all_texts(spark, tmp_path):
    enc = tokens.encoder(tokens.TOKENIZER)
    common, late = "the house of the man and the dog", "zebra zebra zebra"
    rows = [(i, common) for i in range(50)] + [(50 + i, late + " " + late) for i in range(40)] + [(90, (common + " ") * 3000 + late)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    ids, off = enc.encode(pa.array([r[1] for r in rows]))
    counts = np.bincount(ids, minlength=enc.size + 1)
    counts[-1] = len(rows)
    path = str(tmp_path / "words")
    lm_score.word_counts(df).write.parquet(path)
    words_ = spark.read.parquet(path)
    kept = lm_score.encoded_parts(df, F.lit(True), {}, len(rows), "text", tokens.TOKENIZER).where("n_tokens IS NOT NULL").checkpoint()
    assert (lm_score.id_pairs(words_, np.zeros(enc.size + 1, np.int64), len(rows)).sum(0) == counts).all()
    text = np.repeat(np.arange(len(rows)), np.diff(off))
    feature = lm_score.beside(lm_score.id_ranks(counts)[ids], text[1:] == text[:-1])
    assert (lm_score.corpus_beside(kept, lm_score.id_ranks(counts)) == feature).all()
    classes = lm_score.corpus_classes(words_, kept, len(rows))
    assert (classes == lm_score.id_classes(counts, feature=feature)).all()
    pairs = lm_score.id_pairs(words_, classes, len(rows))
    some = enc.encode(pa.array([common] * 50))  # the start holds neither the long nor the late texts
    m, _ = lm_score.learn(lm_score.fresh(classes, np.append(enc.ends, True), pairs), *some, first=True)
    after, places = lm_score.train_blocks(m, kept, 3)
    assert places == len(ids) + len(rows)
    held = enc.encode(pa.array([late + " " + late]))
    assert after.score(*held)[0] > m.score(*held)[0]
    again, _ = lm_score.train_blocks(m, kept.repartition(7), 3)  # blocks do not follow from partitions
    assert all((after.p[k] == again.p[k]).all() for k in after.p)


def test_lm_scores_do_not_depend_on_partitions(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    one, many = ({r.doc_id: r for r in lm_score.score(docs.repartition(n), ~held).collect()} for n in (1, 9))
    assert set(one) == set(many)
    for d, r in one.items():
        assert r.score == pytest.approx(many[d].score, rel=1e-5) and r.base_score == pytest.approx(many[d].base_score, rel=1e-12)


def test_lm_block_takes_memory_by_its_ids():
    """A block's ids are written in two bytes each, and windows of them are made in few bytes more."""
    rng = np.random.default_rng(9)
    size = tokens.encoder(tokens.TOKENIZER).size
    off = np.concatenate([[0], np.cumsum(rng.integers(0, 3000, 300))])
    ids = rng.integers(0, size, off[-1])
    held = lm_score.binary_ids(ids, off, size)
    assert held.nbytes < 2 * len(ids) + 8 * len(off)
    for a, b in ((0, len(off) - 1), (7, 90), (5, 5)):  # slices too
        back, at = lm_score.flat_ids(held.slice(a, b - a), size)
        assert back.tolist() == ids[off[a]:off[b]].tolist() and at.tolist() == (off[a:b + 1] - off[a]).tolist()
    assert [x.tolist() for x in lm_score.flat_ids(lm_score.binary_ids(ids + (1 << 16), off, 1 << 17), 1 << 17)] == [(ids + (1 << 16)).tolist(), off.tolist()]
    pairs = np.zeros((lm_score.N_CLASSES + 1, size + 1), np.int64)
    trainer = lm_score.Trainer(lm_score.fresh(lm_score.id_classes(np.bincount(ids, minlength=size + 1), ids), np.zeros(size + 1, bool), pairs))
    tracemalloc.start()
    rows, goal, begins = trainer.windows(ids, off)
    assert tracemalloc.get_traced_memory()[1] < 8 * len(ids)  # 27.6 bytes an id before, 4.3 now
    tracemalloc.stop()
    source, target, first, text = trainer.m.layout(ids, off)
    assert (rows == np.lib.stride_tricks.sliding_window_view(trainer.m.inputs[source], lm_score.WINDOW)[::lm_score.STRIDE]).all()
    target = target[lm_score.BACK:].reshape(goal.shape)
    assert (goal == np.where(target < 0, -1, trainer.m.classes[target])).all() and np.flatnonzero(begins).tolist() == first.tolist()


def test_lm_score_equals_a_naive_forward_pass():
    """One id at a time: its context, attention by loops, the softmax over classes and the share in the class."""
    rng = np.random.default_rng(8)
    enc = tokens.encoder(tokens.TOKENIZER)
    texts = ["some words of a text that is longer than a window " * 4, "", "short"]
    ids, off = enc.encode(pa.array(texts))
    seen = np.bincount(ids, minlength=enc.size + 1)
    classes = lm_score.id_classes(seen, ids)
    pairs = np.zeros((lm_score.N_CLASSES + 1, enc.size + 1), np.int64)
    pairs[-1] = seen
    m = lm_score.fresh(classes, np.append(enc.ends, True), pairs)
    m.p["place"] = rng.normal(0, 0.3, m.p["place"].shape).astype(np.float32)
    got = m.score(ids, off)
    for t in range(len(texts)):
        own = ids[off[t]:off[t + 1]].tolist()
        inputs, goals = [m.end, *own], [*own, m.end]
        total = 0.0
        for i, goal in enumerate(goals):
            part, place = divmod(i, lm_score.STRIDE)
            begin = part * lm_score.STRIDE - lm_score.BACK
            x = {j: m.p["embed"][m.inputs[inputs[j]]].astype(np.float64) for j in range(max(0, begin), i + 1)}
            q = x[i] @ m.p["q"]
            w = {j: math.exp(q @ (x[j] @ m.p["k"]) + m.p["place"][place, j - begin]) for j in x}
            h = sum(w[j] * (x[j] @ m.p["v"]) for j in x) / sum(w.values()) + x[i]
            logits = h @ m.p["out"] + m.p["bias"]
            c = classes[goal]
            before = len(m.share) - 1 if m.starts[inputs[i]] else classes[inputs[i]]
            total += logits[c] - math.log(np.exp(logits).sum()) + m.share[before, goal]
        assert got[t] == pytest.approx(total / math.log(10), rel=1e-4)


# ---------------------------------------------------------------- 10
def test_few_kinds_behaves_alike_at_every_length():
    rng = np.random.default_rng(1)
    book = [f"w{i}" for i in np.minimum(rng.zipf(1.3, 60_000), 4000)]  # natural: more words than ten of a kind, many in a window
    dull = [f"w{i}" for i in rng.integers(0, 60, 3000)]
    short = [f"w{i}" for i in rng.integers(0, 9, 150)]
    edge = [f"w{i}" for i in rng.integers(0, 100, 1300)]
    cases = [book, [], dull, short, edge, ["a"] * 99, ["a"] * 100, book[:700]]
    assert len(book) > 10 * len(set(book))
    t = quality_rules.Texts(pa.array([" ".join(c) for c in cases], pa.large_string()))

    def brute(c, w=quality_rules.KINDS_WINDOW):
        w = min(w, len(c))
        kinds = [len(set(c[i:i + w])) for i in range(len(c) - w + 1)]
        return len(c) >= 100 and w > 10 * sum(kinds) / len(kinds)

    for rows in (np.arange(len(cases)), np.array([0, 3, 4])):
        assert quality_rules._few_kinds(t, rows).tolist() == [brute(cases[r]) for r in rows]
    assert not quality_rules._few_kinds(t, np.array([0]))[0] and quality_rules._few_kinds(t, np.array([2]))[0]


def slow_counts(text):
    w = words(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        dup += bool(words(x)) and x in seen
        seen.add(x)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {i + k for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), dup, len(cover)


def test_quality_counts_and_verdict_do_not_depend_on_order(spark, texts, odd):
    rows = E.queries()["op10_quality_rules"](spark, SMALL).collect()
    for r in rows:
        want = slow_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    names = list(quality_rules.RULES)
    t = plain(pa.array(ODD + list(texts.values()) + ["A!! B!! " * 40, "x\nx\n" * 30]))
    a, b = (quality_rules.judge(t, o).field("kept").to_pylist() for o in (names, names[::-1]))
    assert a == b
    got = quality_rules.judge(plain(pa.array(ODD)), names).to_pylist()
    assert [tuple(g[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for g in got] == list(map(slow_counts, ODD))
    assert quality_rules.keep_good(odd).columns == odd.columns


def naive_rules(text):
    """Each rule of the cascade on one text, word by word."""
    w = words(text)
    n, chars = len(w), sum(map(len, w))
    lines = (text or "").split("\n")
    dup = sum(bool(words(x)) and x in lines[:i] for i, x in enumerate(lines))
    upper, lower = (sum(len(regex.findall(p, x)) for x in w) for p in (r"\p{Lu}", r"\p{Ll}"))
    widths = [w[i:i + 1000] for i in range(max(1, n - 999))]
    return {"long_words": chars > 20 * n, "short_words": chars < 2 * n, "symbols": 10 * sum((text or "").count(c) for c in "#*$%&|<>") > n,
            "dup_lines": dup >= 3 and 2 * dup > len(lines), "shouting": upper > lower, "exclaiming": 4 * (text or "").count("!!") > n,
            "few_letters": 2 * sum(bool(regex.search(r"\p{L}", x)) for x in w) < n,
            "few_kinds": n >= 100 and sum(map(len, widths)) > 10 * sum(len(set(x)) for x in widths),
            "stutter": 3 * sum(a == b for a, b in zip(w, w[1:])) > n}


def test_every_rule_equals_brute_force_on_any_rows(texts):
    some = [*list(texts.values())[:60], *ODD, "WORD " * 30, "a b " * 60, "x y " * 700, "!! " * 25 + "a", "1 2 3 " * 9, "w" * 500 + " x",
            "same line\n" * 9, "# $ % & " * 5 + "word " * 8, "go go go stop " * 9, "LOUD and quiet " * 8]
    t = quality_rules.Texts(plain(pa.array(some)))
    every = np.arange(len(some))
    want = [naive_rules(x) for x in some]
    assert all(any(w[name] for w in want) for name in quality_rules.RULES)  # no rule goes untested
    for name, rule in quality_rules.RULES.items():
        for rows in (every, every[::3], every[-7:], every[:1]):
            assert rule(t, rows).tolist() == [want[i][name] for i in rows], name
    failed = quality_rules.base_failed(t)
    for order in (sorted(quality_rules.RULES), sorted(quality_rules.RULES, reverse=True)):
        got = quality_rules.judge(plain(pa.array(some)), order).to_pylist()
        assert [g["kept"] for g in got] == [not failed[i] and not any(want[i].values()) for i in every]


def test_a_rule_costs_what_its_rows_cost(texts):
    """The cascade is a short circuit: one row in play costs a small part of all rows."""
    import time

    t = quality_rules.Texts(plain(pa.array(list(texts.values()) * 6)))
    every = np.arange(len(texts) * 6)

    def seconds(rule, rows):
        return min(_timed(time, rule, t, rows) for _ in range(5))

    for name in ("shouting", "few_letters", "stutter", "few_kinds", "exclaiming"):
        assert seconds(quality_rules.RULES[name], every[:1]) < 0.5 * seconds(quality_rules.RULES[name], every), name


def _timed(time, rule, t, rows):
    at = time.perf_counter()
    rule(t, rows)
    return time.perf_counter() - at


def test_quality_of_an_empty_table(none):
    assert quality_rules.with_quality(none).count() == 0


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, docs):
    got, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "simhash_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, got, SMALL)
        assert after.columns == docs.columns and 0 < after.count() <= got.count()
        got = after
    packed = corpus_pipeline.run(spark, SMALL).collect()
    rows = got.collect()
    want = {r.doc_id: len(x) + 1 for r, x in zip(rows, reference_ids([r.text for r in rows]))}
    have = Counter()
    for r in packed:
        have[r.doc_id] += r.length
    assert dict(have) == want
    json.dumps([r.asDict() for r in packed[:1]])


# ---------------------------------------------------------------- size of the driver's share, word cache
def test_mixing_budgets_hold_one_level_per_plan(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 60), ("d0", "de", "b", 30), ("d1", "en", "c", 10)], "domain string, lang string, source string, tokens bigint")
    got = mixing.budgets(leaves, mixing.MixSettings())
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.amount for r in got.collect()) == 80


def test_toxicity_model_is_broadcast_once(spark):
    m = toxicity.Model(prior=0.25)
    assert toxicity._held(spark, m) is toxicity._held(spark, m) is not toxicity._held(spark, toxicity.Model(prior=0.25))


def test_word_cache_keeps_the_older_generation():
    enc, asked = tokens.Encoder(cache_words=8), []
    joined = enc._joined
    enc._joined = lambda words, pieces: asked.extend(words) or joined(words, pieces)
    first = enc.words(["alpha", "beta", "gamma", "delta", "omega"])
    enc.words(["sigma"])  # the cache is full: a new generation begins
    assert enc.words(["alpha", "beta", "gamma", "delta", "omega"]) == first
    assert sorted(w for w in asked if w) == ["alpha", "beta", "delta", "gamma", "omega", "sigma"]


def test_words_encoded_together_get_their_own_ids():
    words = ["a$$$", "68.18.101.23", "(737)", "555-3887", "\"55cf1b\"", "x_1y2--z", "it's", "'s", "<|endoftext|>", "<|", "café²", "éa", " ",
             "a b", "\x1c", "\x7f", "☃☃", "A1B2", "a.,;", "...", "9", "İ", "١٢", "z" * 300, "0" * 300]
    enc = tokens.Encoder()
    one = [bytes(np.array(enc.tokenizer.encode(w, add_special_tokens=False).ids, "<u4")) for w in words]
    assert enc.words(words) == one
    ids, off = enc.encode(pa.array([" ".join(words[:8] * 6000), None, "", "a$$$ b"]))
    assert off.tolist()[1:] == [len(b"".join(one[:8])) // 4 * 6000] * 3 + [len(ids)]
    assert ids[:off[1]].tobytes() == b"".join(one[:8]) * 6000


def test_marks_of_any_kind_are_pieces_of_their_own():
    words = ["alpha***", "alpha", "beta###", "alpha)\"", "beta", "İ.", "aİ,!", "क़.", "क़", "é$$$", "é'", "a'.", "a<|", "<|endoftext|>."]
    enc, asked = tokens.Encoder(), []
    joined = enc._joined
    enc._joined = lambda words, pieces: asked.extend(words) or joined(words, pieces)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.words(words)] == reference_ids(words)
    assert [asked.count(w) for w in ("alpha", "beta", "alpha***", "beta###")] == [1, 1, 0, 0]


def test_small_cache_gives_the_same_ids(texts):
    some = list(texts.values())[:30]
    small, large = tokens.Encoder(cache_words=20), tokens.Encoder()
    for t in some:
        assert small.encode(pa.array([t]))[0].tolist() == large.encode(pa.array([t]))[0].tolist()
        assert len(small.names) <= 20
    assert [x.tolist() for x in small.encode(pa.array([], pa.string()))] == [[], [0]]
    assert [x.tolist() for x in small.encode(pa.array([None, " \t"]))] == [[], [0, 0, 0]]


def test_lm_parts_and_buffers_do_not_show(texts, monkeypatch):
    """Steps of other sizes on one trainer, and windows worked on in other parts, give the same weights and scores."""
    enc = tokens.encoder(tokens.TOKENIZER)
    ids, off = enc.encode(pa.array(list(texts.values())[:60]))
    seen = np.bincount(ids, minlength=enc.size + 1)
    pairs = np.zeros((lm_score.N_CLASSES + 1, enc.size + 1), np.int64)
    pairs[-1] = seen
    got = []
    for part in (64, 7):
        monkeypatch.setattr(lm_score, "PART_WINDOWS", part)
        m = lm_score.fresh(lm_score.id_classes(seen, ids), np.append(enc.ends, True), pairs)
        trainer = lm_score.Trainer(m)
        data = trainer.windows(ids, off)
        for n in (300, 20, 150):
            trainer.step(data, np.arange(n), 0.01)
        assert trainer.buffers.shape[1] == 300
        got.append((m, m.score(ids, off, batch=part)))
    (a, one), (b, two) = got
    assert np.allclose(one, two, rtol=1e-4) and all(np.allclose(a.p[k], b.p[k], atol=1e-3) for k in a.p)
    a.p["place"] = a.p["place"] + np.float32(100)  # attention past the range of exp
    assert np.isfinite(a.score(ids, off)).all()
