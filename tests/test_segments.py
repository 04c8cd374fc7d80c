"""Sentences with learnt abbreviations: learnt from counts, cut by hand, two ways alike."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkpairs.functions.text import sentences
from sparkpairs.operators import chunking, segments


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    names, verbs = ["Smith", "Jones", "Miller", "Brown"], ["met", "saw", "called", "thanked"]
    rows = []
    for i in range(400):
        a, b = rng.choice(names), rng.choice(names)
        rows.append((i, f"Dr. {a} {rng.choice(verbs)} Mrs. {b} today. They ate fruit, e.g. apples, at home. Was it the end? It was the end. "
                        f"J. {b} went there. He said no! He stayed at home with fruit. Today there is fruit at home and the end is near us."))
    rows += [(400, None), (401, ""), (402, "no stop"), (403, "Dr. \n Smith."), (404, "x y")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_abbreviations_are_learnt_and_words_are_not(corpus):
    got = {r.word: r for r in segments.abbreviations(corpus).collect()}
    assert {"dr", "mrs", "e.g"} <= set(got) and not {"end", "home", "fruit", "today", "there", "smith", "he"} & set(got)
    assert got["dr"].n == got["dr"].n_stop == 401


def test_score_by_hand(spark):
    df = spark.createDataFrame([("ab. " * 9 + "ab cd ef gh. ij kl mn op qr st",)], "text string")
    n, stops, words = 10, 9, 19
    share = (stops + 1) / words
    ratio = -2 * ((stops * math.log(share) + math.log(1 - share)) - (stops * math.log(0.99) + math.log(1 - 0.99)))
    want = ratio * math.exp(-2) * 1 * 2 ** -1
    got = segments.abbreviations(df, threshold=-1e9).where("word = 'ab'").first()
    assert (got.n, got.n_stop) == (n, stops) and got.score == pytest.approx(want)


def test_sentences_go_on_after_abbreviations_and_initials(corpus, spark):
    learnt = segments.learn(corpus)
    text = "Dr. Smith met J. R. Brown. They ate, e.g. fruit. \"Was it?\" he said. Mrs. Jones left! The end. J."
    want = ["Dr. Smith met J. R. Brown. ", "They ate, e.g. fruit. ", "\"Was it?\" ", "he said. ", "Mrs. Jones left! ", "The end. ", "J."]
    one = spark.createDataFrame([(1, text), (1, text), (None, "a. b"), (3, None), (4, ""), (5, "Dr. x")], "k int, text string")
    got = one.where("k = 1").select(sentences("text", learnt).alias("s")).first().s
    assert got == want and len(one.where("k = 1").select(sentences("text").alias("s")).first().s) > len(want)
    rows = [(r.k, r.sent_no, r.sentence) for r in segments.sentence_rows(one, segments.abbreviations(corpus), ["k"]).collect()]
    assert sorted(rows, key=repr) == sorted([(1, i, s) for i, s in enumerate(want)] * 2 + [(None, 0, "a. "), (None, 1, "b"), (5, 0, "Dr. x")], key=repr)


def test_both_ways_cut_alike_and_lose_nothing(corpus):
    learnt, table = segments.learn(corpus), segments.abbreviations(corpus)
    inline = corpus.select("doc_id", F.posexplode(sentences("text", learnt)).alias("n", "s"))
    joined = segments.sentence_rows(corpus, table, ["doc_id"]).withColumnRenamed("sent_no", "n").withColumnRenamed("sentence", "s")
    assert inline.count() > 400 and inline.exceptAll(joined).isEmpty() and joined.exceptAll(inline).isEmpty()
    whole = inline.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "").alias("t"))
    assert whole.join(corpus, "doc_id").where("t <> text").isEmpty()


def test_bounded_pieces_use_the_learnt_sentences(corpus):
    pieces = corpus.where("doc_id = 7").select(chunking.split_by_max_words("text", 4, segments.learn(corpus)).alias("p")).first().p
    assert pieces[0].startswith("Dr. ") and pieces[0].endswith("today. ") and "".join(pieces) == corpus.where("doc_id = 7").first().text
    with pytest.raises(ValueError, match="abbreviations"):
        segments.learn(corpus, most=1)
    assert segments.learn(corpus.limit(0)).words == ()
