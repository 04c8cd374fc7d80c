"""Invariants of paragraph windows, sentence packing and the size draw."""

import math
from collections import Counter

from pyspark.sql import functions as F

from sparkpairs.functions.rand import digest, uniform
from sparkpairs.functions.text import sentences
from sparkpairs.operators import chunking

TEXT = "\n\n".join(f"Paragraph {i}. It has two sentences!" for i in range(23))


def windows(spark, texts, npara=5):
    df = spark.createDataFrame([(f"doc{i}", t) for i, t in enumerate(texts)], "chapter string, text string") \
        .withColumn("source", F.lit("s"))
    return chunking.chunk_windows(df, npara=npara).orderBy("chapter", "chunk_no").collect()


def test_windows_cover_and_overlap(spark):
    rows = windows(spark, [TEXT] * 5)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.chapter, []).append(r)
    for ws in by_doc.values():
        covered = set()
        for a, b in zip(ws, ws[1:]):
            assert b.start == a.start + max(1, a.size - 1)
        for w in ws:
            assert 1 <= w.size <= 5 and w.start < 23
            covered |= set(range(w.start, min(w.start + w.size, 23)))
            assert w.text == "\n\n".join(f"Paragraph {i}. It has two sentences!" for i in range(w.start, min(w.start + w.size, 23)))
        assert covered == set(range(23))


def test_blank_paragraphs_dropped(spark):
    rows = windows(spark, ["a\n\n\n\n  \n\nb"], npara=1)
    assert [r.text for r in rows] == ["a", "b"]


def test_empty_document_has_no_windows(spark):
    assert windows(spark, ["   "]) == []


def test_poisson_frequencies(spark):
    df = spark.range(20000)
    size = chunking.truncated_poisson(uniform(digest(1, "chunk", F.col("id"))), 5)
    got = Counter({r.s: r["count"] for r in df.groupBy(size.alias("s")).count().collect()})
    lam = 3
    w = [lam ** j / math.factorial(j) for j in range(1, 6)]
    for j, p in zip(range(1, 6), [x / sum(w) for x in w]):
        assert abs(got[j] / 20000 - p) < 0.015


def test_sentences_rejoin(spark):
    texts = ["One. Two!  Three?\n\"Four.\" Five", "no end", "", "Dr. Who went."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", F.array_join(sentences("t"), "").alias("j")).collect():
        assert r.j == r.t


def test_max_words_split(spark):
    text = " ".join(f"Sentence number {i} has five." for i in range(40))  # 5 words each
    df = spark.createDataFrame([(text,)], "t string")
    pieces = df.select(chunking.split_by_max_words("t", 12).alias("p")).first().p
    assert "".join(pieces) == text
    for p in pieces:
        assert len(p.split()) <= 12 or len([s for s in p.split(".") if s.strip()]) == 1
    assert df.select(chunking.split_by_max_words("t", 0).alias("p")).first().p == [text]


def test_chunk_corpus_schema(spark):
    df = spark.createDataFrame([("d", "s", TEXT)], "chapter string, source string, text string")
    out = chunking.chunk_corpus(df, max_words=6)
    assert out.columns == ["chapter", "source", "chunk_no", "sub_no", "text"]
    assert out.count() > 0


def test_user_sentence_splitter(spark):
    import re as _re

    def factory():
        pat = _re.compile(r"[^.]*\.\s*|[^.]+$")
        return lambda texts: [pat.findall(t) for t in texts]

    text = "One two. Three four five. Six seven."
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(sentences("t", factory).alias("s"), chunking.split_by_max_words("t", 3, factory).alias("p")).first()
    assert got.s == ["One two. ", "Three four five. ", "Six seven."]
    assert got.p == ["One two. ", "Three four five. ", "Six seven."]


def _brute_windows(key, n_par, npara=5, seed=42):
    import hashlib
    cdf = chunking.poisson_cdf(npara)
    out, i, k = [], 0, 0
    while i < n_par:
        h = hashlib.md5(f"{seed}:chunk:{key}:{k}".encode()).hexdigest()
        u = int(h[:8], 16) / 2 ** 32
        size = 1 + sum(u >= c for c in cdf)
        out.append((k, i, size))
        i += max(1, size - 1)
        k += 1
    return out


def test_windows_match_literal_walk(spark):
    counts = [1, 2, 7, 511, 512, 513, 1300, 3000]   # several prefix blocks
    rows = [(f"d{n}", "\n\n".join(f"p{i}" for i in range(n))) for n in counts]
    df = spark.createDataFrame(rows, "chapter string, text string")
    got = {}
    for r in chunking.chunk_windows(df, key_cols=["chapter"], keep_cols=["chapter"]).collect():
        got.setdefault(r.chapter, []).append((r.chunk_no, r.start, r.size))
    for name, n in zip([r[0] for r in rows], counts):
        assert sorted(got[name]) == _brute_windows(name, n), name
