"""HTML to markdown by tokens and depths: cases written by hand."""

import pytest
from pyspark.sql import functions as F

from sparkpairs.sources.html_parser import decode_references, html_documents

CASES = {
    "plain text": ("  just\n text ", "just text"),
    "null": (None, None),
    "empty": ("", ""),
    "no text": ("<p> </p><ul><li></ul><!-- x -->", ""),
    "headings": ("<h1>A  b</h1><h3>C</h3><p>d</p><h6><b>e</b></h6>", "# A b\n\n### C\n\nd\n\n###### **e**"),
    "empty heading": ("<h2></h2><p>x</p>", "x"),
    "dropped parts": ("<head><title>t</title></head><STYLE>p{}</STYLE>a<script>if (a<b) '<p>'</script>b<!-- <p>c</p> -->d<noscript>e</noscript>", "a bd"),
    "never closed script": ("a<script>var x = '<p>'", "a"),
    "references": ("<p>&amp;lt; &lt; &eacute; &#233; &#xE9; &#x1F600; &nbsp;| &bogus; AT&T &hellip;&rarr; &#0; &#150; &copy</p>",
                   "&lt; < é é é 😀  | &bogus; AT&T …→ � – &copy"),
    "references in attributes": ('<a href="?a=1&amp;b=&quot;">x</a>', '[x](?a=1&b=")'),
    "quotes of attributes": ("<a href='one'>1</a> <a href=two>2</a> <a title=\"a > b\" HREF = \"three\">3</a> <a data-href='no'>4</a> <a>5</a>",
                             "[1](one) [2](two) [3](three) 4 5"),
    "inline": ("<b>a</b> <strong>b</strong> <i>c</i> <em><b>d</b></em> <code>e  f</code> <b><strong>g</strong></b>",
               "**a** **b** *c* ***d*** `e f` **g**"),
    "unclosed inline ends with its block": ("<p>a <b>b <i>c</p><p>d</i> e</p><p><a href=u>f</p>", "a **b *c***\n\nd e\n\n[f](u)"),
    "mark over blocks": ("<b>a<p>b</p>c</b>", "**a**\n\nb\n\nc"),
    "breaks and rules": ("a<br>b <br/> c<hr>d", "a  \nb  \nc\n\n---\n\nd"),
    "image": ('<img alt="x &amp; y" src="i.png"><img alt="none">', "![x & y](i.png)"),
    "list": ("<ul><li>a</li>\n<li>b<li>c</ul><p>d</p>", "- a\n- b\n- c\n\nd"),
    "ordered list": ("<p>x</p><ol start='9'><li>a<li>b</ol><ol><li>c</ol><ol start=x><li>d</ol>", "x\n\n9. a\n10. b\n1. c\n1. d"),
    "nested lists": ("<ol><li>a<ul><li>b<ol><li>c</li></ol></li><li>d</li></ul></li><li>e</li></ol>f",
                     "1. a\n   - b\n     1. c\n   - d\n2. e\n\nf"),
    "blocks of an item": ("<ul><li><p>a</p><p>b</p><pre>c\n d</pre></li><li><h2>e</h2></li></ul>", "- a\n\n  b\n\n  ```\n  c\n   d\n  ```\n- ## e"),
    "quotes": ("<blockquote>a<p>b</p><blockquote><p>c</p></blockquote><ul><li>d</ul></blockquote>e", "> a\n>\n> b\n>\n> > c\n>\n> - d\n\ne"),
    "code": ('<pre><code class="x language-c++">\nif (a &lt; b)\n\t<b>x</b>;  \n</code></pre>', "```c++\nif (a < b)\n\tx;\n```"),
    "code with fences": ("<pre>```</pre>", "````\n```\n````"),
    "table": ("<table><caption>t</caption><tr><th>a|b</th><th>c</th></tr><tr><td><p>1</p><p>2</p><td><b>3</b><tr><td>4</table>after",
              "t\n\n| a\\|b | c |\n| --- | --- |\n| 1 2 | **3** |\n| 4 |\n\nafter"),
    "two tables": ("<table><tr><td>a</table><table><tr><td>b</table>", "| a |\n| --- |\n\n| b |\n| --- |"),
    "table in a table": ("<table><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr></table>", "| a b | c |\n| --- | --- |"),
    "closes without opens": ("</ul></b></blockquote><p>a</i></p></table></pre><ul><li>b</ul>", "a\n\n- b"),
    "less-than sign": ("a < b <3 c", "a < b <3 c"),
    "unclosed lists": ("<ul><li>a<ul><li>b", "- a\n  - b"),
    "break in a cell": ("<table><tr><td>a<br>b</table>", "| a b |\n| --- |"),
    "private use": ("ab", "ab"),
}


@pytest.fixture(scope="module")
def converted(spark):
    df = spark.createDataFrame([(k, h, "x") for k, (h, _) in CASES.items()], "name string, page string, pos string").repartition(3)
    return {r.name: r.md for r in html_documents(df, ["name"], "page", "md").collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_case(converted, name):
    assert converted[name] == CASES[name][1]


def test_sql_walks_to_the_same_texts():
    """The SQL, a walk over the tokens that has no tables and no preformatted text, gives the other cases too."""
    duckdb = pytest.importorskip("duckdb")
    from sparkpairs.plans.oracle_html import html_sql

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id VARCHAR, html VARCHAR)")
    rows = [(k, h) for k, (h, _) in CASES.items() if "<table" not in (h or "") and "pre>" not in (h or "")]
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    got = dict(con.execute(html_sql()).fetchall())
    assert got == {k: CASES[k][1] for k, _ in rows}


def test_long_pages_and_rows_of_one_key(spark):
    """Many tokens, long attributes, deep nesting; rows of one key are not mixed."""
    many = "".join(f"<p>{i} <b>x</b></p>" for i in range(20_000))
    deep = "<div>" * 3000 + "in" + "</div>" * 3000
    attr = f"<p style='{'a:b;' * 50_000}'>y</p>"
    df = spark.createDataFrame([(1, many), (1, deep), (1, attr), (None, "z"), (None, "z")], "k int, html string")
    out = html_documents(df, ["k"]).collect()
    assert sorted(len(r.markdown) for r in out) == sorted([len("\n\n".join(f"{i} **x**" for i in range(20_000))), 2, 1, 1, 1])
    assert sum(r.markdown == "z" and r.k is None for r in out) == 2


def test_references_of_a_column(spark):
    df = spark.createDataFrame([("&lt;&#x3c;&#60;&lt",), (None,), ("",)], "t string")
    assert [r.t for r in df.select(decode_references(F.col("t")).alias("t")).collect()] == ["<<<&lt", None, ""]


def test_partitions_grow_with_the_stored_pages(spark, tmp_path, monkeypatch):
    """A task's memory follows from its pages: twice the stored bytes come in more partitions, not in larger ones."""
    import random

    from sparkpairs.sources import html_parser

    draw = random.Random(3)
    rows = [(i, "<p>" + "".join(draw.choices("abcdefghij klmnop", k=2000)) + f"</p><ul><li>{i}</li></ul>") for i in range(300)]
    spark.createDataFrame(rows, "k bigint, html string").repartition(2).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    monkeypatch.setattr(html_parser, "PAGE_BYTES", 20_000)
    got = html_parser.html_documents(pages, ["k"])
    assert got.rdd.getNumPartitions() >= 8  # the session's shuffle partitions are 4
    assert {r.k: r.markdown for r in got.collect()} == {i: " ".join(h[3:h.index("</p>")].split()) + f"\n\n- {i}" for i, h in rows}
