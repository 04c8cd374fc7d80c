"""Legal-output tests for every error operator (one operator at rate 1.0,
many keys, every result must be one of the legal outputs), plus the gates,
the error budget and variety of the full chain."""

import re

import pytest
from pyspark.sql import functions as F

from sparkpairs.functions.constants import DEFAULT_ERROR_CONFIG, KEYBOARD_NEIGHBORS
from sparkpairs.operators.errors import ErrorConfig, apply_error, insert_errors, load_error_config

N_KEYS = 60


def run_op(spark, text, op, n=N_KEYS, seed=42):
    df = spark.createDataFrame([(i, text) for i in range(n)], "doc_id long, text string")
    out = apply_error(df, op, "text", ["doc_id"], 1.0, seed)
    return [(r.text, r.n_errors, list(r.applied)) for r in out.orderBy("doc_id").collect()]


def outputs(spark, text, op, n=N_KEYS):
    return {t for t, _, _ in run_op(spark, text, op, n)}


def test_quote_spaces(spark):
    assert outputs(spark, '"Hello world"', "quote_spaces") == {'" Hello world "'}


def test_quote_spaces_counts_without_match(spark):
    rows = run_op(spark, "no quotes here", "quote_spaces", 3)
    assert all(t == "no quotes here" and n == 1 and a == [] for t, n, a in rows)


def test_missing_quotes(spark):
    got = outputs(spark, '"Hello world"', "missing_quotes")
    assert got == {'Hello world"', '"Hello world', "Hello world"}


def test_missing_quotes_no_match_does_not_count(spark):
    rows = run_op(spark, "plain text", "missing_quotes", 3)
    assert all(n == 0 for _, n, _ in rows)


def test_punctuation_outside_quotes(spark):
    assert outputs(spark, '"Hello, world!"', "punctuation_outside_quotes") == {'"Hello, world"!'}


def test_dropped_letters(spark):
    assert outputs(spark, "Hello", "dropped_letters") == {"ello", "Hllo", "Helo", "Hell"}


def test_swapped_letters(spark):
    assert outputs(spark, "world", "swapped_letters") == {"owrld", "wrold", "wolrd", "wordl"}


def test_dropped_words_middle_only(spark):
    got = outputs(spark, "The quick brown fox jumps", "dropped_words")
    assert got == {"The brown fox jumps", "The quick fox jumps", "The quick brown jumps"}


def test_dropped_words_keeps_newlines(spark):
    got = outputs(spark, "One\ttwo\nthree", "dropped_words")
    assert got == {"One\t\nthree"}


def test_swapped_words(spark):
    got = outputs(spark, "The quick brown fox jumps", "swapped_words")
    legal = {"quick The brown fox jumps", "The brown quick fox jumps", "The quick fox brown jumps",
             "The quick brown jumps fox"}
    assert got <= legal and len(got) >= 3


def test_swapped_words_needs_more_than_three(spark):
    rows = run_op(spark, "one two three", "swapped_words", 5)
    assert all(t == "one two three" and n == 0 for t, n, _ in rows)


def test_spaces_around_punctuation(spark):
    assert outputs(spark, "Hello, world!", "spaces_around_punctuation") == {"Hello , world !"}


def test_missing_spaces(spark):
    assert outputs(spark, "Hello world", "missing_spaces") == {"Helloworld"}


def test_homophones(spark):
    got = outputs(spark, "There are books", "homophones")
    assert got <= {"Their are books", "They're are books", "There our books"}
    assert "Their are books" in got and "They're are books" in got


def test_homophones_capitalisation(spark):
    got = outputs(spark, "Their house", "homophones")
    assert got <= {"There house", "They're house"}


def test_dropped_nt(spark):
    assert outputs(spark, "I couldn't find it", "dropped_nt") == {"I could find it"}


def test_dropped_nt_cant(spark):
    assert outputs(spark, "I can't", "dropped_nt") == {"I ca"}


def _keyboard_legal(src, out):
    if len(src) != len(out):
        return False
    diffs = [(a, b) for a, b in zip(src, out) if a != b]
    if len(diffs) != 1:
        return False
    a, b = diffs[0]
    return b.lower() in KEYBOARD_NEIGHBORS[a.lower()] and a.isupper() == b.isupper() and b.isalpha()


@pytest.mark.parametrize("text", ["hello", "lest pest mest", "qest aest zest", "Hello hELLO HeLLo WORLD"])
def test_keyboard_neighbors(spark, text):
    got = outputs(spark, text, "keyboard_neighbors", 80)
    assert len(got) > 1
    assert all(_keyboard_legal(text, o) for o in got)


def test_keyboard_keeps_punctuation(spark):
    text = "Hello, world! How are you?"
    for o in outputs(spark, text, "keyboard_neighbors"):
        assert re.sub(r"[A-Za-z]", "", o) == re.sub(r"[A-Za-z]", "", text)


def chain(spark, texts, cfg, seed=42):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return insert_errors(df, "text", ["doc_id"], cfg, seed).orderBy("doc_id").collect()


def test_preserve_ratio(spark):
    cfg = {"error_rates": {"spacing": {"missing_spaces": 1.0}}, "preserve_ratio": 0.5, "min_chunk_length": 0}
    rows = chain(spark, ['"Hello world"'] * 100, cfg)
    kept = sum(r.original == r.text for r in rows)
    assert kept > 30 and 100 - kept > 30


def test_min_length(spark):
    cfg = {"error_rates": {"typography": {"dropped_letters": 1.0}}, "preserve_ratio": 0.0, "min_chunk_length": 50}
    assert all(r.original == "Hi" for r in chain(spark, ["Hi"] * 10, cfg))


def test_error_budget(spark):
    all_on = {fam: {k: 1.0 for k in rates} for fam, rates in DEFAULT_ERROR_CONFIG["error_rates"].items()}
    cfg = {"error_rates": all_on, "preserve_ratio": 0.0, "max_errors_per_chunk": 2, "min_chunk_length": 10}
    text = "There are their books over there and they're reading them."
    for r in chain(spark, [text] * 30, cfg):
        a, b = r.original.split(), text.split()
        changed = sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))
        assert changed <= 4
        # the budget is checked before each family; the first family may overshoot
        assert r.n_errors <= 2 + 3


def test_variety(spark):
    cfg = load_error_config(None)
    cfg.preserve_ratio = 0.0
    cfg.min_length = 0  # the sentence is shorter than the default minimum
    cfg.rates = {k: 0.5 for k in cfg.rates}
    rows = chain(spark, ['"There couldn\'t be any issues with this text!"'] * 20, cfg)
    assert len({r.original for r in rows}) > 1


def test_applied_lists_only_changes(spark):
    cfg = {"error_rates": {"punctuation": {"quote_spaces": 1.0}}, "preserve_ratio": 0.0, "min_chunk_length": 0}
    rows = chain(spark, ["no quotes at all in this line of text"] * 5, cfg)
    assert all(r.n_errors == 1 and list(r.applied) == [] for r in rows)


def test_missing_family_is_zero(spark):
    cfg = ErrorConfig.from_dict({"error_rates": {"typography": {"dropped_letters": 0.5}}})
    assert cfg.rate("keyboard_neighbors") == 0.0 and cfg.rate("dropped_letters") == 0.5


def test_config_file_merge(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("error_rates:\n  typography:\n    dropped_letters: 0.9\npreserve_ratio: 0.2\n")
    cfg = load_error_config(str(p), preserve_ratio=0.4)
    assert cfg.rate("dropped_letters") == 0.9
    assert cfg.rate("swapped_letters") == 0.0       # rates inside a given family are not merged
    assert cfg.rate("quote_spaces") == 0.05         # missing families come from the defaults
    assert cfg.preserve_ratio == 0.4


def test_filter_after_chain_plans(spark):
    cfg = {"error_rates": DEFAULT_ERROR_CONFIG["error_rates"], "preserve_ratio": 0.0, "min_chunk_length": 0}
    df = spark.createDataFrame([(i, "The quick brown fox jumps over the lazy dog.") for i in range(50)],
                               "doc_id long, text string")
    out = insert_errors(df, "text", ["doc_id"], cfg, 42)
    assert out.filter(F.col("n_errors") > 0).count() >= 0
    assert out.select(F.explode("applied")).count() >= 0


def test_filters_on_passing_columns_reach_the_scan(spark, tmp_out):
    """Behind the chain a filter on what it made stays, one on what passes goes down to the files."""
    df = spark.createDataFrame([(i, f"s{i % 3}", "The quick brown fox jumps over the lazy dog.") for i in range(60)], "doc_id long, source string, text string")
    df.write.parquet(f"{tmp_out}/d")
    cfg = dict(DEFAULT_ERROR_CONFIG, preserve_ratio=0.0, min_chunk_length=0)
    out = insert_errors(spark.read.parquet(f"{tmp_out}/d"), "text", ["doc_id"], cfg, 42)
    some = out.where("source = 's1' AND n_errors > 0 AND doc_id < 40")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,s1)" in plan and "LessThan(doc_id,40)" in plan and "n_errors" not in plan.split("PushedFilters")[1]
    want = [r for r in out.collect() if r.source == "s1" and r.n_errors > 0 and r.doc_id < 40]
    assert sorted(map(tuple, some.drop("applied").collect())) == sorted(tuple(x for x in r if not isinstance(x, list)) for r in want) and want
    one = apply_error(spark.read.parquet(f"{tmp_out}/d"), "dropped_letters", "text", ["doc_id"], 1.0, 7).where("source = 's2'")
    assert "EqualTo(source,s2)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 20


def test_statements_of_two_threads_leave_the_session_alone(spark):
    from concurrent.futures import ThreadPoolExecutor

    key = "spark.sql.analyzer.maxIterations"
    before = spark.conf.get(key)
    df = spark.createDataFrame([(i, "Some words, and more of them.") for i in range(5)], "doc_id long, text string")
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(lambda s: insert_errors(df, "text", ["doc_id"], None, s).count(), range(8))) == [5] * 8
    assert spark.conf.get(key) == before


def test_chain_partition_independent_and_corrected_untouched(spark):
    from sparkpairs.functions.constants import PRODUCTION_ERROR_CONFIG
    from sparkpairs.operators.errors import make_pairs
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "source", F.col("doc_id").cast("string").alias("chapter"), "text")
    clean = docs.withColumn("chunk_no", F.lit(0)).withColumn("sub_no", F.lit(0))
    one = {(r.chapter, r.original) for r in make_pairs(clean.coalesce(1), config=PRODUCTION_ERROR_CONFIG).collect()}
    eight = make_pairs(clean.repartition(8), config=PRODUCTION_ERROR_CONFIG).collect()
    assert {(r.chapter, r.original) for r in eight} == one
    texts = {r.chapter: r.text for r in docs.collect()}
    assert all(r.corrected == texts[r.chapter] for r in eight)
    assert any(r.original != r.corrected for r in eight)


def test_gate_frequency(spark):
    df = spark.createDataFrame([(i, '"x"') for i in range(3000)], "doc_id long, text string")
    out = apply_error(df, "quote_spaces", "text", ["doc_id"], 0.3, 7)
    fired = out.filter(F.col("n_errors") == 1).count() / 3000
    assert abs(fired - 0.3) < 0.03


def test_homophones_need_letters_in_any_case_and_one_set_lookup(spark):
    from sparkpairs.functions.constants import HOMOPHONES

    word = next(iter(HOMOPHONES))
    rows = [(0, f"x {word} y"), (1, f"x {word.upper()} y"), (2, f"x {word}1 y"), (3, "x qqq y"), (4, ""), (5, None)]
    out = apply_error(spark.createDataFrame(rows, "doc_id bigint, text string"), "homophones", key_cols=("doc_id",))
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].n_errors for i in range(6)] == [1, 1, 0, 0, 0, 0]
    assert got[0].text.split()[1] in HOMOPHONES[word] and got[1].text.split()[1][0].isupper()
    assert [got[i].text for i in (2, 3, 4, 5)] == [rows[i][1] for i in (2, 3, 4, 5)]
    assert "INSET" in out._jdf.queryExecution().optimizedPlan().toString()  # hashed, not compared word by word
