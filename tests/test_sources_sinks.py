"""Readers and writers: EPUB containers, markdown trees, HTML, dataset folders,
chat export, results, dataset card, lineage and trial export."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkpairs.sinks import writers
from sparkpairs.sources import datasets, epub, html


def make_epub(path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml",
                   '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container">'
                   '<rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/>'
                   '</rootfiles></container>')
        z.writestr("OEBPS/content.opf",
                   '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf"><manifest>'
                   '<item id="c1" href="text/ch1.xhtml" media-type="application/xhtml+xml"/>'
                   '<item id="c2" href="text/ch2.xhtml" media-type="application/xhtml+xml"/>'
                   '<item id="css" href="style.css" media-type="text/css"/></manifest></package>')
        z.writestr("OEBPS/text/ch1.xhtml", "<html><body><h1>One</h1><p>Hé said <b>hi</b>.</p></body></html>")
        z.writestr("OEBPS/text/ch2.xhtml", "<html><body><p>Second &amp; last.</p></body></html>")
        z.writestr("OEBPS/style.css", "p{}")
    with open(path, "wb") as f:
        f.write(buf.getvalue())


def test_read_epub(spark, tmp_out):
    os.makedirs(f"{tmp_out}/books")
    make_epub(f"{tmp_out}/books/a.epub")
    rows = epub.epub_to_markdown(spark, f"{tmp_out}/books").orderBy("chapter").collect()
    assert [r.chapter for r in rows] == ["text_ch1.xhtml.md", "text_ch2.xhtml.md"]
    assert rows[0].text == "# One\n\nHé said **hi**."
    assert rows[1].text == "Second & last."


def test_read_epub_encoded_names_and_bad_books(spark, tmp_out):
    os.makedirs(f"{tmp_out}/shelf")
    container = ('<?xml version="1.0"?><container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
    opf = ('<?xml version="1.0"?><package><manifest>'
           '<item href="ch%201.xhtml" media-type="application/xhtml+xml"/>'
           '<item href="gone.xhtml" media-type="application/xhtml+xml"/></manifest></package>')
    with zipfile.ZipFile(f"{tmp_out}/shelf/good.epub", "w") as z:
        z.writestr("META-INF/container.xml", container)
        z.writestr("O/c.opf", opf)
        z.writestr("O/ch 1.xhtml", "<html><body><p>Text.</p></body></html>")
    with open(f"{tmp_out}/shelf/bad.epub", "wb") as f:
        f.write(b"not a container")
    with zipfile.ZipFile(f"{tmp_out}/shelf/empty.epub", "w") as z:
        z.writestr("mimetype", "application/epub+zip")
    rows = epub.read_epub(spark, f"{tmp_out}/shelf").collect()
    assert sorted((os.path.basename(r.source), r.item_name, r.error is None) for r in rows if r.item_name) == [
        ("good.epub", "ch 1.xhtml", True), ("good.epub", "gone.xhtml", False)]
    assert sorted(os.path.basename(r.source) for r in rows if not r.item_name) == ["bad.epub", "empty.epub"]
    assert [r.text for r in epub.epub_to_markdown(spark, f"{tmp_out}/shelf").collect()] == ["Text."]


def test_html_rules(spark):
    src = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><!-- x -->'
           '<h2>Sub</h2><p>A <a href="/u">link</a> &lt;b&gt;<br>next</p><ul><li>one</li><li>two</li></ul>'
           '<script>var a="</p>";</script></body></html>')
    df = spark.createDataFrame([(src,)], "h string")
    md = df.select(html.html_to_markdown("h").alias("m")).first().m
    assert md == "## Sub\n\nA [link](/u) <b>\nnext\n\n- one\n- two"


def test_chapter_name(spark):
    df = spark.createDataFrame([("OEBPS/text/ch 1.xhtml",), ("a\\b",)], "n string")
    assert [r.c for r in df.select(html.chapter_file_name("n").alias("c")).collect()] == ["OEBPS_text_ch 1.xhtml.md", "a_b.md"]


def test_markdown_tree(spark, tmp_out):
    os.makedirs(f"{tmp_out}/md/sub")
    open(f"{tmp_out}/md/a.md", "w").write("Para one.\n\nPara two.")
    open(f"{tmp_out}/md/sub/b.md", "w").write("Deep.")
    open(f"{tmp_out}/md/skip.txt", "w").write("no")
    rows = datasets.read_markdown_tree(spark, [f"{tmp_out}/md"]).orderBy("chapter").collect()
    assert [(r.chapter, r.text) for r in rows] == [("a.md", "Para one.\n\nPara two."), ("sub/b.md", "Deep.")]
    assert {r.source for r in rows} == {f"{tmp_out}/md"}


def test_source_list(spark, tmp_out):
    p = f"{tmp_out}/list.txt"
    open(p, "w").write("first/set\n\n# comment\n  second  \n #not a comment\n")
    got = [r.name for r in datasets.read_source_list(spark, p).collect()]
    assert got == ["first/set", "second", "#not a comment"]


def test_prompt(tmp_out):
    p = f"{tmp_out}/prompt.txt"
    open(p, "w").write("  Be helpful.\n")
    assert datasets.load_prompt(p) == "Be helpful."
    import pytest
    with pytest.warns(UserWarning):
        assert datasets.load_prompt(f"{tmp_out}/missing.txt").startswith("You are")


def test_dataset_roundtrip_and_card(spark, tmp_out):
    df = spark.createDataFrame([("train", "s", "a", "a"), ("test", "s", "b", "b"), ("train", "t", "c", "c")],
                               "split string, source string, original string, corrected string")
    writers.write_dataset(df, f"{tmp_out}/ds")
    both = datasets.read_dataset(spark, f"{tmp_out}/ds")
    assert sorted((r.split, r.original) for r in both.collect()) == [("test", "b"), ("train", "a"), ("train", "c")]
    assert datasets.read_dataset(spark, f"{tmp_out}/ds", "train").count() == 2
    first = datasets.read_dataset(spark, f"{tmp_out}/ds", "train", limit=1, order_cols=["original"]).collect()
    assert [r.original for r in first] == ["a"]
    card = writers.write_dataset_card(df, f"{tmp_out}/ds", "Pairs", ["s", "t"], {"seed": 42})
    assert "| train | s | 1 |" in card and "seed: 42" in card
    assert writers.copy_dataset_card(spark, f"{tmp_out}/ds", f"{tmp_out}/small")
    assert os.path.exists(f"{tmp_out}/small/_README.md")


def test_chat_jsonl(spark, tmp_out):
    df = spark.createDataFrame([("train", '{"conversations": []}'), ("test", "{}")], "split string, text string")
    writers.write_chat_jsonl(df, f"{tmp_out}/chat_export")
    valid = spark.read.json(f"{tmp_out}/chat_export/valid.jsonl").collect()
    assert [r.text for r in valid] == ["{}"]
    assert spark.read.json(f"{tmp_out}/chat_export/train.jsonl").count() == 1


def test_chat_jsonl_loses_no_row(spark, tmp_out):
    rows = [("train", "a"), ("test", "b"), ("dev", "c"), (None, "d")]
    df = spark.createDataFrame(rows, "split string, text string")
    for bad, name in ((df, "dev|null"), (df.where("split IS NULL OR split = 'train'"), "null"), (df.where("split = 'dev'"), "dev")):
        with pytest.raises(Exception, match=f"no chat file for split .*({name})"):
            writers.write_chat_jsonl(bad, f"{tmp_out}/bad")
    writers.write_chat_jsonl(df.where("split IS NOT NULL"), f"{tmp_out}/x", files={"train": "t.jsonl", "test": "v.jsonl", "dev": "d.jsonl"})
    assert {f: [r.text for r in spark.read.json(f"{tmp_out}/x/{f}").collect()] for f in ("t.jsonl", "v.jsonl", "d.jsonl")} == \
        {"t.jsonl": ["a"], "v.jsonl": ["b"], "d.jsonl": ["c"]}
    assert sorted(os.listdir(f"{tmp_out}/x")) == ["d.jsonl", "t.jsonl", "v.jsonl"]
    writers.write_chat_jsonl(df.where("split = 'train'").select("split", F.col("text").alias("file")), f"{tmp_out}/y", text_col="file")
    assert [tuple(r) for r in spark.read.json(f"{tmp_out}/y/train.jsonl").collect()] == [("a",)]


def test_splits_are_kept_and_pruned(spark, tmp_out):
    """A null split stays null, names with special characters read back, and a filter opens one folder only."""
    names = ["train", "test", None, "a/b=c", "1"]
    df = spark.createDataFrame([(s, f"x{i}") for i, s in enumerate(names)], "split string, original string")
    writers.write_dataset(df, f"{tmp_out}/ds")
    both = datasets.read_dataset(spark, f"{tmp_out}/ds")
    assert sorted(map(tuple, both.select("split", "original").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert both.schema["split"].dataType.simpleString() == "string"
    one = both.where("split = 'test'")
    opened = {f.split("/")[-2] for f in one.inputFiles()}
    assert opened == {"split=test", "split=train", "split=1", "split=a%2Fb%3Dc", "split=__HIVE_DEFAULT_PARTITION__"} or opened == {"split=test"}
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan
    os.rename(f"{tmp_out}/ds/split=train", f"{tmp_out}/gone")  # nothing of another split is needed any more
    assert [r.original for r in one.collect()] == ["x1"]
    with pytest.raises(ValueError, match="no split 'dev'"):
        datasets.read_dataset(spark, f"{tmp_out}/ds", "dev")


def test_order_is_in_the_files(spark, tmp_out):
    from sparkpairs.operators.sampling import shuffle_rank

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"), "id", F.lit("r").alias("_at"))
    ranked = shuffle_rank(df, 4, ["id"], ["split"])
    want = {(r.split, r["rank"]): r.id for r in ranked.collect()}
    writers.write_ordered(ranked, f"{tmp_out}/o")
    assert sorted(spark.read.parquet(f"{tmp_out}/o").columns) == ["_at", "id", "split"]
    for split, n in (("train", 2000), ("test", 1000)):
        got = {r["rank"]: r.id for r in datasets.read_in_order(spark, f"{tmp_out}/o", split).collect()}
        assert got == {k: want[split, k] for k in range(n)}
        files = sorted(x for x in os.listdir(f"{tmp_out}/o/split={split}") if x.endswith(".parquet"))
        assert len(files) > 1
        one_by_one = [r.id for f in files for r in spark.read.parquet(f"{tmp_out}/o/split={split}/{f}").collect()]
        assert one_by_one == [got[k] for k in range(n)]
        first = datasets.read_dataset(spark, f"{tmp_out}/o", split, limit=7)
        assert sorted(r.id for r in first.collect()) == sorted(got[k] for k in range(7)) and first.columns == ["id", "_at"]
        few = datasets.read_in_order(spark, f"{tmp_out}/o", split, 7)
        assert len(few.inputFiles()) < len(files) + 1  # the manifest is one of them
    whole = shuffle_rank(df.drop("split"), 4, ["id"])
    writers.write_ordered(whole, f"{tmp_out}/w")
    assert {r["rank"] for r in datasets.read_in_order(spark, f"{tmp_out}/w").collect()} == set(range(3000))


def test_card_of_very_many_sources(spark, tmp_out):
    df = spark.range(5000).select(F.lit("train").alias("split"), F.concat(F.lit("s"), (F.col("id") % 1500).cast("string")).alias("source"))
    df = df.unionByName(spark.range(50).select(F.lit("test").alias("split"), F.lit("big").alias("source")))
    card = writers.write_dataset_card(df, f"{tmp_out}/many", "t", top=3)
    rows = [x for x in card.splitlines() if x.startswith("| ") and "---" not in x]
    assert rows == ["| split | source | rows |", "| test | big | 50 |", "| train | s0 | 4 |", "| train | s1 | 4 |", "| 1498 others |  | 4992 |"]
    whole = spark.read.parquet(f"{tmp_out}/many/_counts")
    assert whole.count() == 1501 and whole.agg(F.sum("n")).first()[0] == 5050


def test_results_and_lineage(spark, tmp_out):
    df = spark.createDataFrame([(0, "s", "ö", "ö", "ö", True)],
                               "index long, source string, original string, expected string, generated string, matches_expected boolean")
    writers.write_results_json(df, f"{tmp_out}/res")
    line = "".join(open(os.path.join(f"{tmp_out}/res", f), encoding="utf-8").read()
                   for f in os.listdir(f"{tmp_out}/res") if f.endswith(".json"))
    assert "ö" in line
    import pytest
    with pytest.raises(ValueError):
        writers.write_results_json(df, f"{tmp_out}/res2", fmt="csv")
    fp = writers.register_fingerprint(df, f"{tmp_out}/lineage", "run-1").first()
    assert fp.n == 1 and fp.run_id == "run-1"
    assert spark.read.parquet(f"{tmp_out}/lineage").count() == 1


def test_export_trials(spark, tmp_out):
    trials = writers.trials_from_json(spark, [{"trial": 0, "value": 2.0, "params": {"lr": 1e-4}},
                                              {"trial": 1, "value": 1.5, "params": {"lr": 2e-4}}])
    writers.export_trials(trials, f"{tmp_out}/study")
    rec = spark.read.json(f"{tmp_out}/study").first()
    assert rec.best_trial == 1 and rec.best_value == 1.5 and len(rec.all_trials) == 2


def test_reference_layout(spark, tmp_out):
    spark.createDataFrame([("s", "a", "a")], "source string, original string, corrected string") \
        .write.parquet(f"{tmp_out}/plain/train")
    spark.createDataFrame([("s", "b", "b"), ("s", "c", "c")], "source string, original string, corrected string") \
        .write.parquet(f"{tmp_out}/plain/test")
    both = datasets.read_dataset(spark, f"{tmp_out}/plain").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in both} == {"train": 1, "test": 2}
    assert datasets.read_dataset(spark, f"{tmp_out}/plain", "test").count() == 2


def test_spread(spark):
    from sparkpairs.session import spread
    narrow = spark.range(100).coalesce(1)
    assert spread(narrow, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism * 4
    wide = spark.range(100).repartition(spark.sparkContext.defaultParallelism * 4)
    assert spread(wide, "id") is wide
    # an input behind an exchange is not run to count its partitions
    seen = spark.sparkContext.accumulator(0)
    counted = spark.range(100).select(F.udf(lambda x: (seen.add(1), x)[1], "bigint")("id").alias("id")).groupBy("id").count()
    assert spread(counted, "id") is counted and seen.value == 0


def test_workers_get_the_package_outside_its_folder(tmp_out):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from sparkpairs.operators.lengths import token_lengths
from sparkpairs.operators.evaluation import batch_correct
from sparkpairs.session import get_session
spark = get_session("away", master="local[2]", shuffle_partitions=2)
df = spark.createDataFrame([("a b",)], "original string")
print("got", batch_correct(df, lambda: (lambda texts: texts)).first().generated)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_out, env=env, capture_output=True, text=True, timeout=300)
    assert "got a b" in run.stdout, run.stderr[-2000:]


def test_named_entities(spark):
    df = spark.createDataFrame([("<p>a &middot; b &copy; 2024 &amp;copy; &mdash; x</p>",)], "h string")
    assert df.select(html.html_to_markdown("h").alias("m")).first().m == "a · b © 2024 &copy; — x"


def test_corpus_folder_reads_back_with_card_and_null_splits(spark, tmp_out):
    from sparkpairs.operators.ordering import ordinal_within
    from sparkpairs.operators.sampling import shuffle_rank
    from sparkpairs.sinks import writers
    from sparkpairs.sources.datasets import read_dataset, read_source_list

    df = spark.createDataFrame([("train", "a", "x"), ("test", "b", "y"), ("train", "c", "z")], "split string, original string, corrected string")
    writers.write_dataset(df, f"{tmp_out}/c")
    writers.write_dataset_card(df, f"{tmp_out}/c", "t")
    back = read_dataset(spark, f"{tmp_out}/c")
    assert sorted(back.columns) == ["corrected", "original", "split"] and back.count() == 3
    assert spark.read.parquet(f"{tmp_out}/c").count() == 3
    with pytest.raises(ValueError):
        writers.write_chat_jsonl(df.drop("split"), f"{tmp_out}/j")
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "split string, k int")
    assert shuffle_rank(nulls, 1, ["k"], ["split"]).count() == 4
    assert ordinal_within(nulls, ["split"], ["k"]).count() == 4
    with open(f"{tmp_out}/list.txt", "w") as f:
        f.write("\t \n# no\n\tname \n")
    assert [r.name for r in read_source_list(spark, f"{tmp_out}/list.txt").collect()] == ["name"]


def test_missing_and_nan_values_never_win(spark, tmp_out):
    import json

    from sparkpairs.operators.runs import best_trial
    from sparkpairs.sinks.writers import export_trials

    t = spark.createDataFrame([(1, None, {"a": "1"}, {}), (2, float("nan"), {"a": "2"}, {}), (3, 0.2, {"a": "3"}, {}), (4, 0.5, {"a": "4"}, {})],
                              "trial int, value double, params map<string,string>, user_attrs map<string,string>")
    for direction, best in (("minimize", 3), ("maximize", 4)):
        assert best_trial(t, direction).first().best_trial == best
        export_trials(t, f"{tmp_out}/{direction}", direction)
        got = json.loads(spark.read.text(f"{tmp_out}/{direction}").first().value)
        assert (got["best_trial"], got["best_params"]) == (best, {"a": str(best)})
