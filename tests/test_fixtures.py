"""The views standing in for the reference's inputs have the properties the
operators need, and none of them pairs rows within a group."""

from pyspark.sql import functions as F

from sparkpairs.operators import pairs
from sparkpairs.plans import fixtures as fx

SMALL = "/root/testdata/sf0.001"


def test_quoted_and_contracted(spark):
    docs = fx.table(spark, SMALL, "documents")
    q = fx.quoted(docs).select("text").collect()
    assert all(t.text.startswith('"') and t.text.endswith('"') for t in q)
    assert all(line.startswith('"') and line.endswith('"') for t in q for line in t.text.split("\n"))
    c = fx.contracted(docs).filter(F.col("text").contains("n't")).count()
    assert c > 0


def test_multi_reference_is_linear(spark):
    conv = fx.table(spark, SMALL, "conversations")
    multi = fx.multi_reference(conv)
    users = conv.filter(F.col("role") == "user").count()
    assistants = conv.filter(F.col("role") == "assistant").count()
    assert multi.count() == users
    n_corr = multi.select(F.sum(F.size("corrections"))).first()[0]
    assert n_corr <= 2 * users and n_corr <= 2 * assistants


def test_multi_reference_keeps_every_reply(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), *((1, t, "assistant", f"r{t}") for t in range(2, 7)), (1, 7, "user", "q2"),
            (1, 8, "user", "q3"), (1, 9, "assistant", None), (1, 10, "assistant", "late"), (1, 11, "system", "s"), (1, 12, "assistant", "none"),
            (2, 1, "assistant", "first"), (2, 2, "user", "alone"), (3, 1, "user", "long")]
    rows += [(3, t, "assistant", f"x{t}") for t in range(2, 70_000)]
    rows += [(None, 1, "user", "nobody"), (None, 2, "assistant", "n2"), (None, 3, "assistant", "n3")]
    multi = fx.multi_reference(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [(r.conv_id, r.turn, r.original, r.corrected) for r in pairs.adapt_multi(multi, "m", ["conv_id", "turn"]).collect()]
    want = [(1, 1, "q1", f"r{t}") for t in range(2, 7)] + [(1, 8, "q3", "late")] + [(3, 1, "long", f"x{t}") for t in range(2, 70_000)]
    want += [(None, 1, "nobody", "n2"), (None, 1, "nobody", "n3")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.sentence for r in multi.where(F.size("corrections") == 0).collect()} == {"q2", "alone"}


def test_tagged_and_io(spark):
    docs = fx.table(spark, SMALL, "documents")
    t = fx.tagged(docs, fx.table(spark, SMALL, "labels")).collect()
    assert {r.task for r in t} <= {"gec", "paraphrase"}
    assert any(r.src.startswith(fx.TAG_COMMAND) for r in t) and any(r.src == r.tgt for r in t)
    io = fx.io_pairs(fx.table(spark, SMALL, "benchmark")).collect()
    assert all("  " not in r.output and r.output == r.output.strip() for r in io)


def test_null_texts_pass_through(spark):
    from sparkpairs.functions import chat
    from sparkpairs.functions.constants import PRODUCTION_ERROR_CONFIG
    from sparkpairs.functions.text import token_count
    from sparkpairs.operators import chunking, errors

    df = spark.createDataFrame([(1, "s", None), (2, "s", "A short line. Another line here, and more words follow.")],
                               "doc_id long, source string, text string")
    cfg = dict(PRODUCTION_ERROR_CONFIG, preserve_ratio=0.0, min_chunk_length=0)
    out = {r.doc_id: (r.original, r.n_errors) for r in errors.insert_errors(df, "text", ["doc_id"], cfg).collect()}
    assert out[1] == (None, 0)
    w = chunking.chunk_windows(df, key_cols=["doc_id"], sep="\n", keep_cols=["doc_id"]).collect()
    assert {r.doc_id for r in w} == {2}
    rendered = df.select("doc_id", chat.render_chat(chat.to_messages(F.lit("sys"), F.col("text"), F.col("text"))).alias("t"),
                         token_count("text").alias("n")).collect()
    assert len(rendered) == 2
