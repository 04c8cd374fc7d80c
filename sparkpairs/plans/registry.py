"""Registered queries: one per operator of the inventory, each reading the
shared test tables (or views Spark derives from them) in full.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the oracle SQL in ``oracle.py``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpairs.functions import chat
from sparkpairs.functions.constants import (
    DEFAULT_ERROR_CONFIG,
    DEFAULT_MAX_LENGTH,
    EVAL_FALLBACK_PROMPT,
    EXPORT_FALLBACK_PROMPT,
    PRODUCTION_ERROR_CONFIG,
)
from sparkpairs.functions.rand import digest, uniform
from sparkpairs.functions.text import WORD_RE, paragraphs, posexplode_rows, sentences, token_count, word_count
from sparkpairs.operators import chunking, errors, evaluation, lengths, pairs, profile, runs, sampling, segments
from sparkpairs.plans import corpus
from sparkpairs.plans import fixtures as fx
from sparkpairs.session import materialize, spread
from sparkpairs.sources.html import chapter_file_name, html_to_markdown, item_name_from_url
from sparkpairs.sources.html_parser import html_documents

SEED = 42
SYSTEM_PROMPT = EXPORT_FALLBACK_PROMPT
REQUESTED_SOURCES = ["src1", "src3", "tagged", "nope"]
UNKNOWN_ONLY = ["nope", "missing"]
LOSS_METRIC, ACC_METRIC = "error", "click"
SINGLE_OPS = {
    "quote_spaces": "quoted", "missing_quotes": "quoted", "punctuation_outside_quotes": "quoted",
    "dropped_letters": "documents", "swapped_letters": "documents", "dropped_words": "documents",
    "swapped_words": "documents", "spaces_around_punctuation": "documents", "missing_spaces": "documents",
    "homophones": "documents", "dropped_nt": "contracted", "keyboard_neighbors": "documents",
}


def r6(c: Column) -> Column:
    """Round to 6 decimals with plain IEEE arithmetic (same expression in the oracle)."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def docs(spark, d):
    """Documents, spread by key when the scan is narrow (text work is per row)."""
    return spread(fx.table(spark, d, "documents"), "doc_id")


# ---------------------------------------------------------------- sampling
def q_shuffle_rank(spark, d):
    ranked = sampling.shuffle_rank(docs(spark, d).select("source", "text"), SEED)
    return ranked.select("source", F.md5("text").alias("text_md5"), "rank")


def _split_docs(spark, d):
    return sampling.train_test_split(docs(spark, d).select("doc_id"), 0.1, SEED, ["doc_id"])


def q_train_test_split(spark, d):
    return _split_docs(spark, d).select("doc_id", "split")


def q_subsample_ceil(spark, d):
    split = _split_docs(spark, d).select("doc_id", "split")
    return sampling.subsample(split, 0.05, SEED, ["doc_id"], "split").select("doc_id", "split", "rank")


def q_sample_n(spark, d):
    return sampling.sample_n(docs(spark, d).select("doc_id", "source"), 100, SEED, ["doc_id"])


def q_pick_index(spark, d):
    return sampling.pick_position(docs(spark, d).select("doc_id"), 10, SEED, ["doc_id"])


# ---------------------------------------------------------------- chat
def _messages(spark, d):
    return docs(spark, d).select("doc_id", chat.to_messages(F.lit(SYSTEM_PROMPT), F.col("text"), F.col("text")).alias("messages"))


def _chat_text(spark, d):
    return _messages(spark, d).select("doc_id", chat.render_chat("messages").alias("text"))


def q_chat_messages(spark, d):
    m = _messages(spark, d).select("doc_id", F.posexplode("messages").alias("pos", "m"))
    return m.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("m.role").alias("role"),
                    F.col("m.content").alias("content"))


def q_chat_text(spark, d):
    return _chat_text(spark, d)


def q_chat_json(spark, d):
    return _messages(spark, d).select("doc_id", chat.chat_json("messages").alias("text"))


def q_inference_prompt(spark, d):
    """F10 inference variant (no assistant turn) rendered with the generation prompt."""
    msgs = chat.to_messages(F.lit(EVAL_FALLBACK_PROMPT), F.col("text"))
    return docs(spark, d).select("doc_id", chat.render_chat(msgs, add_generation_prompt=True).alias("text"))


def q_chat_text_own_turn(spark, d):
    """F11 with the system message rendered as its own user turn."""
    m = _messages(spark, d)
    return m.select("doc_id", chat.render_chat("messages", system_mode="own_turn").alias("text"))


def q_prompt_response_split(spark, d):
    t = _chat_text(spark, d)
    p, r = chat.prompt_part("text"), chat.response_part_text("text")
    return t.select("doc_id", F.length(p).cast("bigint").alias("prompt_chars"),
                    F.length(r).cast("bigint").alias("response_chars"),
                    r6(F.length(r) / F.length("text")).alias("supervised_share"))


def _lengths(spark, d):
    return _chat_text(spark, d).select("doc_id", token_count("text").alias("length"))


def _hist(spark, d):
    """The one pass over rows; every length report reads the materialised histogram."""
    return materialize(lengths.length_histogram(_lengths(spark, d)))


def q_chat_token_lengths(spark, d):
    return _lengths(spark, d)


def q_length_summary(spark, d):
    s = lengths.length_summary(_hist(spark, d))
    return s.select("n", r6(F.col("mean")).alias("mean"), r6(F.col("median")).alias("median"),
                    r6(F.col("std")).alias("std"), "min_length", "max_length",
                    r6(F.col("p95")).alias("p95"), r6(F.col("p99")).alias("p99"), "total_tokens")


def q_length_histogram(spark, d):
    b = lengths.length_bins(_hist(spark, d))
    return b.select("bin", r6(F.col("bin_lo")).alias("bin_lo"), r6(F.col("bin_hi")).alias("bin_hi"), "cnt")


def q_length_boxplot(spark, d):
    b = lengths.length_boxplot(_hist(spark, d))
    return b.select(r6(F.col("q1")).alias("q1"), r6(F.col("median")).alias("median"), r6(F.col("q3")).alias("q3"),
                    r6(F.col("iqr")).alias("iqr"), "whisker_lo", "whisker_hi", "n_outliers")


def q_truncation_curve(spark, d):
    c = lengths.truncation_curve(_hist(spark, d))
    return c.select("max_len", "truncated_tokens", "truncated_samples",
                    r6(F.col("truncation_percentage")).alias("truncation_percentage"),
                    r6(F.col("samples_affected_percentage")).alias("samples_affected_percentage"))


def q_optimal_max_length(spark, d):
    return lengths.optimal_max_length(lengths.truncation_curve(_hist(spark, d)))


def q_packing_efficiency(spark, d):
    p = lengths.packing_efficiency(_hist(spark, d), DEFAULT_MAX_LENGTH)
    return p.select(F.col("max_length").cast("bigint").alias("max_length"),
                    r6(F.col("without_packing")).alias("without_packing"),
                    r6(F.col("with_packing")).alias("with_packing"),
                    r6(F.col("improvement")).alias("improvement"),
                    "sequences_without_packing", "sequences_with_packing",
                    r6(F.col("memory_savings")).alias("memory_savings"))


def q_packing_report(spark, d):
    """Packing at the configured length and at those of 1 % and 5 % truncation."""
    p = lengths.packing_at_advised_lengths(_hist(spark, d), DEFAULT_MAX_LENGTH)
    return p.select("max_length", "is_configured", "is_1pct", "is_5pct", r6(F.col("without_packing")).alias("without_packing"),
                    r6(F.col("with_packing")).alias("with_packing"), r6(F.col("improvement")).alias("improvement"),
                    "sequences_without_packing", "sequences_with_packing", r6(F.col("memory_savings")).alias("memory_savings"))


def q_length_advice(spark, d):
    a = lengths.length_advice(_hist(spark, d), DEFAULT_MAX_LENGTH)
    return a.select(F.col("current_max_length").cast("bigint").alias("current_max_length"),
                    "conservative_max_length", "balanced_max_length", "recommendation",
                    F.col("recommended_max_length").cast("bigint").alias("recommended_max_length"),
                    r6(F.col("packing_improvement")).alias("packing_improvement"), "packing_recommended")


# ---------------------------------------------------------------- pairs
def _clean(spark, d):
    return pairs.adapt_clean(docs(spark, d).select("doc_id", "source", "text"), keep=["doc_id"])


def _tagged(spark, d):
    return pairs.adapt_tagged(fx.tagged(docs(spark, d), fx.table(spark, d, "labels"), SEED), fx.SOURCE_TAGGED, keep=["doc_id"])


def _multi(spark, d):
    return pairs.adapt_multi(fx.multi_reference(fx.table(spark, d, "conversations")), fx.SOURCE_MULTI,
                             keep=["conv_id", "turn"])


def _io(spark, d):
    return pairs.adapt_io(fx.io_pairs(fx.table(spark, d, "benchmark")), fx.SOURCE_IO, keep=["item_id"])


def _merged(spark, d):
    return pairs.merge_pairs([_clean(spark, d), _tagged(spark, d), _multi(spark, d), _io(spark, d)])


def q_adapt_clean(spark, d):
    return _clean(spark, d)


def q_adapt_tagged(spark, d):
    return _tagged(spark, d)


def q_adapt_multi(spark, d):
    return _multi(spark, d)


def q_adapt_io(spark, d):
    return _io(spark, d)


def q_merge_pairs(spark, d):
    return sampling.shuffle_rank(_merged(spark, d), SEED)


def q_counts_by_source(spark, d):
    return pairs.counts_by(_merged(spark, d), "source")


def q_source_filter(spark, d):
    return pairs.filter_by_source(_merged(spark, d), REQUESTED_SOURCES)


def q_source_filter_fallback(spark, d):
    return pairs.counts_by(pairs.filter_by_source(_merged(spark, d), UNKNOWN_ONLY), "source")


def q_unknown_sources(spark, d):
    return pairs.unknown_sources(_merged(spark, d), REQUESTED_SOURCES)


def q_distinct_sources(spark, d):
    return pairs.distinct_sources(_merged(spark, d))


def q_dataset_fingerprint(spark, d):
    return profile.dataset_fingerprint(_merged(spark, d), ["source"], ["original", "corrected"])


# ---------------------------------------------------------------- chunking
def q_paragraphs(spark, d):
    p = posexplode_rows(docs(spark, d), paragraphs("text", "\n"), ["doc_id"], "para_no", "paragraph")
    return p.select("doc_id", F.col("para_no").cast("bigint").alias("para_no"), "paragraph")


def _windows(spark, d):
    w = chunking.chunk_windows(docs(spark, d).select("doc_id", "source", "text"), key_cols=["doc_id"],
                               seed=SEED, sep="\n", keep_cols=["doc_id", "source"])
    return w.withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


def q_chunk_windows(spark, d):
    return _windows(spark, d)


def q_sentence_pieces(spark, d):
    s = posexplode_rows(docs(spark, d), sentences("text"), ["doc_id"], "sent_no", "sentence")
    return s.select("doc_id", F.col("sent_no").cast("bigint").alias("sent_no"), "sentence")


def q_abbreviations(spark, d):
    a = segments.abbreviations(docs(spark, d))
    return a.select("word", "n", "n_stop", r6(F.col("score")).alias("score"))


def q_learnt_sentences(spark, d):
    """Sentences with the abbreviations learnt from the same documents."""
    t = docs(spark, d).select("doc_id", "text")
    s = segments.sentence_rows(t, segments.abbreviations(t), ["doc_id"])
    return s.select("doc_id", F.col("sent_no").cast("bigint").alias("sent_no"), "sentence")


def q_word_counts(spark, d):
    return docs(spark, d).select("doc_id", word_count("text").cast("bigint").alias("n_words"))


def q_max_word_split(spark, d):
    s = posexplode_rows(docs(spark, d), chunking.split_by_max_words("text", 500), ["doc_id"], "sub_no", "text")
    return s.select("doc_id", F.col("sub_no").cast("bigint").alias("sub_no"),
                    F.regexp_count("text", F.lit(WORD_RE)).cast("bigint").alias("n_words"), "text")


def q_poisson_sizes(spark, d):
    size = chunking.truncated_poisson(uniform(digest(SEED, "chunk", F.col("doc_id"), F.lit(0))), 5)
    return docs(spark, d).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"))


def q_chunk_corpus(spark, d):
    c = chunking.chunk_corpus(docs(spark, d).select("doc_id", "source", "text"), key_cols=["doc_id"], seed=SEED,
                              sep="\n")
    return c.select("doc_id", "source", F.col("chunk_no").cast("bigint").alias("chunk_no"),
                    F.col("sub_no").cast("bigint").alias("sub_no"), "text")


# ---------------------------------------------------------------- errors
def error_source(spark, d, kind: str) -> DataFrame:
    t = docs(spark, d)
    if kind == "quoted":
        t = fx.quoted(t)
    elif kind == "contracted":
        t = fx.contracted(t)
    return t.select("doc_id", "text")


def make_single_error_query(op: str):
    def q(spark, d):
        out = errors.apply_error(error_source(spark, d, SINGLE_OPS[op]), op, "text", ["doc_id"], 1.0, SEED)
        return out.select("doc_id", "text", F.col("n_errors").cast("bigint").alias("n_errors"),
                          F.array_join("applied", ",").alias("applied"))
    q.__name__ = f"q_err_{op}"
    return q


def _injected(spark, d, cfg=PRODUCTION_ERROR_CONFIG):
    out = errors.insert_errors(docs(spark, d).select("doc_id", "source", "text"), "text", ["doc_id"], cfg, SEED)
    return out.select("doc_id", "source", "original", F.col("text").alias("corrected"),
                      F.col("n_errors").cast("bigint").alias("n_errors"), "applied")


def q_insert_errors(spark, d):
    return _injected(spark, d).withColumn("applied", F.array_join("applied", ","))


def q_insert_errors_default(spark, d):
    return _injected(spark, d, DEFAULT_ERROR_CONFIG).withColumn("applied", F.array_join("applied", ","))


def q_error_distribution(spark, d):
    return profile.error_distribution(_injected(spark, d))


def q_errors_per_row(spark, d):
    return profile.errors_per_row(_injected(spark, d))


CORPUS = corpus.CorpusSettings(seed=SEED, sep="\n", error_config=PRODUCTION_ERROR_CONFIG)
CHUNK_KEYS = ["doc_id", "chunk_no", "sub_no"]


def _clean_chunks(spark, d):
    return corpus.clean_chunks(docs(spark, d).select("doc_id", "source", "text"), CORPUS, ["doc_id"])


def _chunk_pairs(spark, d):
    return corpus.error_pairs(_clean_chunks(spark, d), CORPUS, CHUNK_KEYS)


def q_chunk_pairs(spark, d):
    """Windows -> pieces of bounded length -> exact 90/10 split -> error injection."""
    return _chunk_pairs(spark, d).select(
        "split", *CHUNK_KEYS, "source", "original", "corrected",
        F.col("n_errors").cast("bigint").alias("n_errors"), F.array_join("applied", ",").alias("applied"))


def _stored(spark, d):
    """Reads a derived corpus by name, with the split each row is stored in."""
    views = {
        fx.SOURCE_TAGGED: lambda: fx.tagged(docs(spark, d), fx.table(spark, d, "labels"), SEED),
        fx.SOURCE_MULTI: lambda: fx.multi_reference(fx.table(spark, d, "conversations")),
        fx.SOURCE_IO: lambda: fx.io_pairs(fx.table(spark, d, "benchmark")),
    }
    return lambda name: fx.stored_split(views[name](), name, SEED)


def q_corpora_by_name(spark, d):
    """Named corpora with their stored splits mapped to train and test."""
    return pairs.load_corpora(list(fx.CORPORA), fx.CORPORA, _stored(spark, d))


def q_corpus_pairs(spark, d):
    """Corpus build: windows -> bounded pieces -> split -> error injection -> union with the named corpora -> order per split."""
    s = replace(CORPUS, extra_sources=[q_corpora_by_name(spark, d)])
    return corpus.merged(_chunk_pairs(spark, d), s)


def q_split_counts(spark, d):
    """Rows per split and source of the whole corpus (neither errors nor order change them)."""
    rows = _clean_chunks(spark, d).select("split", "source").unionByName(q_corpora_by_name(spark, d).select("split", "source"))
    return pairs.counts_by(rows, "split", "source")


# ---------------------------------------------------------------- evaluation
def _matched(spark, d):
    return evaluation.score(fx.generated(_clean(spark, d)))


def _scored(spark, d):
    """Keys and outcomes of the scored rows in seeded order, without their texts."""
    return sampling.shuffle_rank(_matched(spark, d).select("doc_id", "source", "matches_expected"), SEED, ["doc_id"], rank_col="index")


def q_eval_results(spark, d):
    return evaluation.eval_records(sampling.shuffle_rank(_matched(spark, d), SEED, ["doc_id"], rank_col="index"))


def q_exact_match(spark, d):
    s = evaluation.accuracy_summary(_matched(spark, d))
    return s.select("total", F.col("matches").cast("bigint").alias("matches"), r6(F.col("accuracy")).alias("accuracy"))


def q_match_by_source(spark, d):
    s = evaluation.accuracy_by_source(_matched(spark, d))
    return s.select("source", "total", F.col("matches").cast("bigint").alias("matches"),
                    r6(F.col("accuracy")).alias("accuracy"))


def q_running_accuracy(spark, d):
    r = evaluation.running_accuracy(_scored(spark, d))
    return r.select("index", "matches_so_far", r6(F.col("running_accuracy")).alias("running_accuracy"))


def q_example_mix(spark, d):
    return evaluation.example_mix(_scored(spark, d), 3).select(F.col("index").cast("bigint").alias("index"),
                                                              "source", "matches_expected")


def _masked(spark, d):
    t = docs(spark, d)
    lens = F.transform(F.regexp_extract_all("text", F.lit(WORD_RE), 0), lambda w: F.length(w))
    t = t.select("doc_id", lens.alias("lens")).withColumn("_last", F.size("lens") - 1)  # lambdas see scalars only
    labels = F.transform("lens", lambda x, i: F.when(i < 3, F.lit(-100)).otherwise(x))
    bump = F.transform("lens", lambda x, i: F.when(i == F.col("_last"), x + 1).otherwise(x))
    u = uniform(digest(SEED, "pred", F.col("doc_id")))
    return t.select("doc_id", F.when(u < 0.5, bump).otherwise(F.col("lens")).alias("predictions"),
                    labels.alias("label_ids"))


def q_masked_accuracy(spark, d):
    m = evaluation.masked_exact_match(_masked(spark, d))
    return m.select("eval_total_predictions", F.col("eval_correct_predictions").cast("bigint").alias("eval_correct_predictions"),
                    r6(F.col("eval_accuracy")).alias("eval_accuracy"))


# ---------------------------------------------------------------- run logs
def _log(spark, d):
    return fx.metric_log(fx.table(spark, d, "events"))


def q_best_metric(spark, d):
    b = runs.best_metrics(_log(spark, d), LOSS_METRIC, ACC_METRIC)
    return b.select("run_id", "best_eval_loss", "best_eval_accuracy", "total_eval_steps",
                    r6(F.col("mean_eval_loss")).alias("mean_eval_loss"))


def q_metric_history(spark, d):
    return runs.metric_history(_log(spark, d))


def q_metric_history_arrays(spark, d):
    a = runs.metric_history_arrays(_log(spark, d), chunk=50)
    return a.withColumn("values", F.array_join(F.transform("values", lambda v: F.coalesce(r6(v).cast("decimal(38,6)").cast("string"), F.lit(""))), ","))


def q_early_stop(spark, d):
    return runs.early_stopping(_log(spark, d), LOSS_METRIC, patience=3, threshold=0.0)


def q_best_trial(spark, d):
    return runs.best_trial(runs.final_values(_log(spark, d), LOSS_METRIC))


def q_rung_survivors(spark, d):
    return runs.rung_survivors(_log(spark, d), LOSS_METRIC, 4, 18, 3)


# ---------------------------------------------------------------- pages
def q_html_to_markdown(spark, d):
    return html_documents(fx.table(spark, d, "pages").select("page_id", "html"), ["page_id"])


def q_html_rules(spark, d):
    """The one-column rule chain, which also runs on streams."""
    pages = spread(fx.table(spark, d, "pages"), "page_id")
    return pages.select("page_id", html_to_markdown("html").alias("markdown"))


def q_chapter_names(spark, d):
    return fx.table(spark, d, "pages").select("page_id", chapter_file_name(item_name_from_url("url")).alias("chapter"))


QUERIES = {
    "shuffle_rank": q_shuffle_rank,
    "train_test_split": q_train_test_split,
    "subsample_ceil": q_subsample_ceil,
    "sample_n": q_sample_n,
    "pick_index": q_pick_index,
    "chat_messages": q_chat_messages,
    "chat_text": q_chat_text,
    "chat_json": q_chat_json,
    "prompt_response_split": q_prompt_response_split,
    "inference_prompt": q_inference_prompt,
    "chat_text_own_turn": q_chat_text_own_turn,
    "chat_token_lengths": q_chat_token_lengths,
    "length_summary": q_length_summary,
    "length_histogram": q_length_histogram,
    "length_boxplot": q_length_boxplot,
    "truncation_curve": q_truncation_curve,
    "optimal_max_length": q_optimal_max_length,
    "packing_efficiency": q_packing_efficiency,
    "packing_report": q_packing_report,
    "length_advice": q_length_advice,
    "adapt_clean": q_adapt_clean,
    "adapt_tagged": q_adapt_tagged,
    "adapt_multi": q_adapt_multi,
    "adapt_io": q_adapt_io,
    "merge_pairs": q_merge_pairs,
    "counts_by_source": q_counts_by_source,
    "source_filter": q_source_filter,
    "source_filter_fallback": q_source_filter_fallback,
    "unknown_sources": q_unknown_sources,
    "distinct_sources": q_distinct_sources,
    "dataset_fingerprint": q_dataset_fingerprint,
    "paragraphs": q_paragraphs,
    "chunk_windows": q_chunk_windows,
    "max_word_split": q_max_word_split,
    "sentence_pieces": q_sentence_pieces,
    "abbreviations": q_abbreviations,
    "learnt_sentences": q_learnt_sentences,
    "word_counts": q_word_counts,
    "poisson_sizes": q_poisson_sizes,
    "chunk_corpus": q_chunk_corpus,
    **{f"err_{op}": make_single_error_query(op) for op in SINGLE_OPS},
    "insert_errors": q_insert_errors,
    "insert_errors_default": q_insert_errors_default,
    "error_distribution": q_error_distribution,
    "corpus_pairs": q_corpus_pairs,
    "chunk_pairs": q_chunk_pairs,
    "corpora_by_name": q_corpora_by_name,
    "errors_per_row": q_errors_per_row,
    "split_counts": q_split_counts,
    "eval_results": q_eval_results,
    "exact_match": q_exact_match,
    "match_by_source": q_match_by_source,
    "running_accuracy": q_running_accuracy,
    "example_mix": q_example_mix,
    "masked_accuracy": q_masked_accuracy,
    "best_metric": q_best_metric,
    "metric_history": q_metric_history,
    "metric_history_arrays": q_metric_history_arrays,
    "early_stop": q_early_stop,
    "best_trial": q_best_trial,
    "rung_survivors": q_rung_survivors,
    "html_to_markdown": q_html_to_markdown,
    "html_rules": q_html_rules,
    "chapter_names": q_chapter_names,
}
