"""Registered queries of the training-data operators: each applies its operator, with
production parameters, to the whole of its table and returns the full result."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkpairs.llm import (
    chat_trees, chosen_path, lm_score, merkle, mixing, packing, page_text, quality_rules, resample, simhash, token_files, topk, toxicity,
)
from sparkpairs.llm.common import crc_fold, table


def op1_topk(spark, d):
    e = table(spark, d, "embeddings")
    return topk.top_k(e, e.where("vec_id % 50 = 0"), k=5, scale=256)


def op2_chat_trees(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text "
                      "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    f = chat_trees.format_trees(chat_trees.threads(rows.unionByName(extra)))
    back = f.select(F.col("tree_id").alias("conv_id"), "formatted", chat_trees.turns(F.col("formatted")).alias("turns"), "loss_turns")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.zip_with("turns", "loss_turns", lambda t, on: F.when(on, t["text"]).otherwise("")), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length(under).cast("bigint").alias("loss_chars"), F.sha2(under, 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


def op3_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = toxicity.train(docs, table(spark, d, "labels"))
    t = toxicity.with_toxicity(docs, model)
    return t.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "toxicity.score", "toxicity.predicted",
                    "toxicity.flagged")


def op4_packing(spark, d):
    p = packing.pack(table(spark, d, "documents"))
    return p.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op5_simhash(spark, d):
    t = simhash.link(table(spark, d, "documents"))
    return t.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_mixing(spark, d):
    t = mixing.select(table(spark, d, "documents"))
    return t.select("d.doc_id", "domain", "lang", "source", "epoch", "take_tokens")


def op7_token_files(spark, d):
    path = token_files.scratch(spark)
    token_files.write_tokens(table(spark, d, "documents"), path)
    files = token_files.read_tokens(spark, path)
    t = token_files.positions(token_files.with_crc(files), files)
    return t.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_page_text(spark, d):
    t = page_text.extract(table(spark, d, "pages"))
    return t.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_lm_score(spark, d):
    held = crc_fold(F.col("doc_id"), 7) == 2
    t = lm_score.score(table(spark, d, "documents"), ~held)
    return t.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality_rules(spark, d):
    t = quality_rules.with_quality(table(spark, d, "documents").select("doc_id", "text"))
    return t.select("doc_id", "quality.*").drop("rule")  # which of several rules rejects first depends on their order


def op11_merkle(spark, d):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return merkle.proofs(table(spark, d, "documents"), {"text": text}).withColumnRenamed("id", "doc_id")


def op12_near_copies(spark, d):
    return chosen_path.link(table(spark, d, "documents"))


def op13_resample(spark, d):
    t = resample.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return t.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_topk": op1_topk,
    "op2_chat_trees": op2_chat_trees,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_token_files": op7_token_files,
    "op8_page_text": op8_page_text,
    "op9_lm_score": op9_lm_score,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle": op11_merkle,
    "op12_near_copies": op12_near_copies,
    "op13_resample": op13_resample,
}
