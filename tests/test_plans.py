"""End-to-end flows on the smallest test tables."""

from pyspark.sql import functions as F

from sparkpairs.functions.constants import EXPORT_FALLBACK_PROMPT, PRODUCTION_ERROR_CONFIG
from sparkpairs.operators import pairs
from sparkpairs.operators.sampling import shuffle_key
from sparkpairs.plans import corpus, evaluate, profile
from sparkpairs.sources import datasets

SMALL = "/root/testdata/sf0.001"


def docs(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    return d.select("source", F.col("doc_id").cast("string").alias("chapter"), "text")


def test_build_corpus(spark, tmp_out):
    s = corpus.CorpusSettings(sep="\n", error_config=PRODUCTION_ERROR_CONFIG)
    out = corpus.build_corpus(spark, docs(spark), f"{tmp_out}/pairs", s)
    rows = out.collect()
    assert {r.split for r in rows} == {"train", "test"}
    n = len(rows)
    n_test = sum(r.split == "test" for r in rows)
    import math
    assert n_test == math.ceil(0.1 * n)
    assert out.columns == ["source", "original", "corrected", "split"]  # the order is in the files, not in a column
    train = datasets.read_in_order(spark, f"{tmp_out}/pairs", "train").orderBy("rank")
    assert [r["rank"] for r in train.collect()] == list(range(n - n_test))
    key = shuffle_key(train, s.seed, pairs.PAIR_COLS)
    digests = [r.d for r in train.select(key.alias("d")).collect()]
    assert digests == sorted(digests)
    assert any(r.original != r.corrected for r in rows)
    again = datasets.read_dataset(spark, f"{tmp_out}/pairs", "test")
    assert again.count() == n_test


def test_length_profile(spark):
    p = pairs.adapt_clean(docs(spark))
    rep = profile.length_profile(p, EXPORT_FALLBACK_PROMPT)
    s = rep["summary"].first()
    assert s.n == p.count() and s.min_length > 0
    assert rep["advice"].first().recommendation in {"keep", "change", "choose"}


def test_evaluate(spark):
    p = pairs.adapt_clean(docs(spark))

    def factory():
        return lambda texts: [t + " " if i % 2 else "nope" for i, t in enumerate(texts)]

    rep = evaluate.evaluate(p, factory, sources=["src1", "src2", "zzz"], n_samples=20)
    summ = rep["summary"].first()
    assert 0 < summ.total <= 20 and 0.0 <= summ.accuracy <= 1.0
    assert rep["records"].count() == summ.total
