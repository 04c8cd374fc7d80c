"""HTML -> markdown by tokens and element depths (S5), as windows over token rows.

A page becomes one row per token (tag, text, comment). What an element stack would hold is
computed per token by running sums in page order: depths of lists, quotes, tables and
preformatted text (a close without an open does not go below zero), the list that an item
belongs to and its number there, and the block that a token falls into. Inline marks pair up
inside their block: what is open at its end is closed there, a close without an open is dropped.
Tokens of a block are joined, then the blocks of a page. Everything is built-in functions; a
page's tokens meet in one task, pages are spread by their key over partitions that grow in number with the table.

Covered: headings, paragraphs and other block elements, line breaks and rules, nested ordered
(``start``) and unordered lists with several blocks per item, quotes, fenced code with its
language, inline code, bold, italic, links, images, tables with a header rule, attributes in
either or no quotes, named (Latin-1, symbols, Greek) and numeric character references. Head, scripts,
styles, templates and comments are dropped. Markdown's own characters in a text are left as they are; the two
private-use characters U+E000 and U+E001, which mark line breaks and cells on the way, are removed from it.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkpairs.functions.names import free_names
from sparkpairs.session import partitions_for

#: Elements whose content is no text of the page.
DROPPED = ("head", "script", "style", "template", "noscript", "iframe", "textarea", "svg")
#: Elements that begin and end a block.
BLOCKS = ("address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
          "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section",
          "summary", "table", "tr", "ul")
TOKEN = r"<!--[\s\S]*?-->|<[!?][^>]*>|</?[A-Za-z](?:[^'\">]+|\"[^\"]*\"|'[^']*')*>|[^<]+|<"
#: Bytes of stored pages whose tokens one task sorts: memory of a task does not grow with the table.
PAGE_BYTES = 512 << 10
BREAK, CELL = "\ue000", "\ue001"  # of the private use area: they stand for a line break and the start of a cell
WHITE = "[ \\t\\n\\r\\f]+"


def _attribute(token: Column, name: str) -> Column:
    found = rf"(?i)[\s'\"/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s'\">]+))"
    return F.concat(*[F.regexp_extract(token, found, i) for i in (1, 2, 3)])


def _table(values: dict[str, str]) -> Column:
    """A constant map, as one literal."""
    text = "\x02".join(f"{k}\x03{v}" for k, v in values.items())
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x03"))


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for what is none. Codes 128 to 159 are those of Windows-1252, as browsers read them."""
    old = _table({str(i): str(ord(c)) for i in range(128, 160) if (c := bytes([i]).decode("cp1252", "ignore"))})
    code = F.coalesce(F.try_element_at(old, code.cast("string")).cast("int"), code)
    bad = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | code.isNull()
    good = F.when(bad, F.lit(0xFFFD)).otherwise(code)
    return F.decode(F.unhex(F.lpad(F.hex(good), 8, "0")), "UTF-32")


def decode_references(text: Column) -> Column:
    """Character references of a text as characters; unknown names stay as they are."""
    named = _table({name: chr(code) for name, code in {**name2codepoint, "apos": 39}.items()})

    def one(piece: Column) -> Column:
        name = F.substring(piece, 2, 40)
        decimal, hexadecimal = F.regexp_extract(piece, "^&#([0-9]{1,7});?$", 1), F.regexp_extract(piece, "^&#[xX]([0-9A-Fa-f]{1,6});?$", 1)
        return (F.when(~piece.startswith("&"), piece).when(decimal != "", _character(decimal.cast("int")))
                .when(hexadecimal != "", _character(F.conv(hexadecimal, 16, 10).cast("int")))
                .otherwise(F.coalesce(F.try_element_at(named, F.regexp_replace(name, ";$", "")), piece)))

    pieces = F.regexp_extract_all(text, F.lit("&#?[A-Za-z0-9]{1,31};|&#[0-9]{1,7}|&|[^&]+"), F.lit(0))
    return F.when(F.instr(text, "&") == 0, text).otherwise(F.array_join(F.transform(pieces, one), ""))


def _clamped(total: str, w: Window) -> Column:
    """Depth of a running sum of opens and closes, in which closes at depth zero do not count."""
    return F.col(total) - F.least(F.lit(0), F.min(total).over(w))


def html_documents(pages: DataFrame, key_cols: list[str], html_col: str = "html", out: str = "markdown") -> DataFrame:
    """``key_cols`` and ``out`` of every row (null html: null; no text: empty). Rows of one key stay rows of their own."""
    row, null = free_names(pages, "row_id", "is_null", taken=(out,))
    keys = [*key_cols, row]
    text = F.translate(F.col(html_col), BREAK + CELL, "")
    for tag in DROPPED:
        text = F.regexp_replace(text, rf"(?is)<{tag}(?:\s[^>]*)?>.*?(?:</{tag}\s*>|$)", " ")
    rows = pages.select(*key_cols, F.monotonically_increasing_id().alias(row), F.col(html_col).isNull().alias(null),
                        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("tokens"))
    rows = rows.repartition(partitions_for(pages, PAGE_BYTES), *keys)  # before the tokens become rows; all windows keep it
    t = rows.select(*keys, null, F.posexplode_outer("tokens").alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", "^</?([A-Za-z][A-Za-z0-9]*)", 1))
    t = t.withColumn("tag", tag).withColumn("opens", F.col("tag") != "").withColumn("closes", F.col("token").startswith("</"))
    t = t.withColumn("opens", F.col("opens") & ~F.col("closes"))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def change(*tags: str, where: Column = F.lit(True)) -> Column:
        hit = F.col("tag").isin(*tags) & where
        return F.when(hit & F.col("opens"), 1).when(hit & F.col("closes"), -1).otherwise(0)

    def depths(df: DataFrame, **kinds: Column) -> DataFrame:
        df = df.withColumns({f"s_{k}": F.sum(c).over(w) for k, c in kinds.items()})
        return df.withColumns({k: _clamped(f"s_{k}", w) for k in kinds}).drop(*[f"s_{k}" for k in kinds])

    t = depths(t, table=change("table"), pre=change("pre"))
    # inside a table only its own rows make blocks, inside preformatted text nothing does
    row_edge = F.col("tag").isin("tr", "caption") & (F.col("table") == 1)
    table_edge = (F.col("tag") == "table") & (F.col("table") == F.when(F.col("opens"), 1).otherwise(0))
    pre_edge = (F.col("tag") == "pre") & (F.col("pre") == F.when(F.col("opens"), 1).otherwise(0)) & (F.col("table") == 0)
    free = (F.col("table") == 0) & (F.col("pre") == 0)
    edge = F.col("tag").isin(*BLOCKS) & (row_edge | table_edge | pre_edge | (free & ~F.col("tag").isin("pre", "tr")))
    behind_rule = F.lag("tag").over(Window.partitionBy(*keys).orderBy("pos")) == "hr"
    t = t.withColumn("edge", edge | (F.coalesce(behind_rule, F.lit(False)) & free))
    t = t.withColumns({"free": free, "block": F.sum(F.when(F.col("edge"), 1).otherwise(0)).over(w)})
    t = depths(t, ul=change("ul", where=F.col("free")), ol=change("ol", where=F.col("free")), quote=change("blockquote", where=F.col("free")))
    t = t.withColumn("depth", F.col("ul") + F.col("ol"))

    # the list of an item: the last one opened at its depth
    lists = Window.partitionBy(*keys, "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.col("opens") & F.col("tag").isin("ul", "ol") & F.col("free")
    start = F.coalesce(F.regexp_extract(_attribute(F.col("token"), "start"), "^-?[0-9]{1,9}$", 0).try_cast("int"), F.lit(1))
    t = t.withColumn("list", F.last(F.when(opened, F.struct("pos", "tag", start.alias("start"))), ignorenulls=True).over(lists))
    items = Window.partitionBy(*keys, "depth", "list.pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    item = F.col("opens") & (F.col("tag") == "li") & F.col("free")
    t = t.withColumn("number", F.sum(F.when(item, 1).otherwise(0)).over(items) - 1)
    marker = F.when(F.col("list.tag") == "ol", F.concat((F.col("list.start") + F.col("number")).cast("string"), F.lit(". "))).otherwise("- ")

    # inline marks pair up inside their block
    b = Window.partitionBy(*keys, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inline = {"bold": ("b", "strong"), "italic": ("i", "em"), "code": ("code", "tt", "kbd", "samp"), "link": ("a",)}
    signs = {"bold": "**", "italic": "*", "code": "`"}
    plain = F.col("pre") == 0
    address = F.when(F.col("tag") == "a", _attribute(F.col("token"), "href")).otherwise(_attribute(F.col("token"), "src"))
    t = t.withColumns({"words": F.when(F.col("tag") == "", decode_references(F.col("token"))),
                       "target": F.when(F.col("opens") & F.col("tag").isin("a", "img"), decode_references(address)),
                       "alt": F.when(F.col("opens") & (F.col("tag") == "img"), decode_references(_attribute(F.col("token"), "alt")))})
    is_link = (F.col("tag") != "a") | F.col("closes") | (F.regexp_count("token", F.lit(r"(?i)[\s'\"/]href\s*=")) > 0)
    t = t.withColumns({f"s_{k}": F.sum(change(*tags, where=plain & is_link)).over(b) for k, tags in inline.items()})
    t = t.withColumns({k: _clamped(f"s_{k}", b) for k in inline}).drop(*[f"s_{k}" for k in inline])
    before = Window.partitionBy(*keys, "block").orderBy("pos")
    t = t.withColumns({f"was_{k}": F.coalesce(F.lag(k).over(before), F.lit(0)) for k in inline})
    t = t.withColumn("href", F.last(F.when(F.col("opens") & (F.col("tag") == "a") & (F.col("link") > F.col("was_link")), F.col("target")), ignorenulls=True).over(b))
    close = F.concat(F.lit("]("), F.col("href"), F.lit(")"))
    white = F.when(plain, F.regexp_replace("words", WHITE, " ")).otherwise(F.col("words"))
    piece = F.when(F.col("token").isNull() | F.col("token").startswith("<!") | F.col("token").startswith("<?"), "")
    piece = piece.when(F.col("tag") == "", white)
    for k, sign in signs.items():  # marks nested in the same mark add nothing
        piece = piece.when(F.col("tag").isin(*inline[k]), F.when(((F.col(k) == 1) & (F.col(f"was_{k}") == 0)) | ((F.col(k) == 0) & (F.col(f"was_{k}") == 1)), sign).otherwise(""))
    piece = (piece.when(F.col("tag") == "a", F.when((F.col("link") == 1) & (F.col("was_link") == 0), "[").when((F.col("link") == 0) & (F.col("was_link") == 1), close).otherwise(""))
             .when(F.col("opens") & (F.col("tag") == "img") & (F.col("target") != ""), F.concat(F.lit("!["), "alt", F.lit("]("), "target", F.lit(")")))
             .when((F.col("tag") == "br") & F.col("opens"), F.when(plain, BREAK).otherwise("\n"))
             .when((F.col("tag") == "hr") & F.col("opens") & F.col("free"), "---")
             .when(F.col("tag").isin("td", "th") & F.col("opens") & (F.col("table") == 1), CELL)
             .when(F.col("tag").isin(*BLOCKS, "td", "th") & plain & (F.col("tag") != "pre"), " ").otherwise(""))
    t = t.withColumns({
        "piece": piece,
        "item": F.when(item, marker),
        "head": F.when(F.col("opens") & F.col("free") & F.col("tag").rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "))),
        "lang": F.when(F.col("opens") & (F.col("pre") > 0), F.regexp_extract(_attribute(F.col("token"), "class"), r"(?:^|\s)lang(?:uage)?-([A-Za-z0-9_+#.-]+)", 1)),
        "at": F.when(F.col("opens") & (F.col("tag") == "table") & (F.col("table") == 1), F.col("pos"))})

    # blocks
    last = lambda c: F.max_by(c, "pos")
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"]), "")
    k = t.groupBy(*keys, "block").agg(
        F.max(null).alias(null), pieces.alias("body"), F.max("quote").alias("quote"), F.max("ul").alias("ul"), F.max("ol").alias("ol"),
        F.max("pre").alias("pre"), F.max("table").alias("table"), last("bold").alias("bold"), last("italic").alias("italic"), last("code").alias("code"),
        last("link").alias("link"), last("href").alias("href"), F.max("item").alias("item"), F.max("head").alias("head"),
        F.max(F.nullif("lang", F.lit(""))).alias("lang"), F.max("at").alias("at"))
    body = F.concat("body", F.when(F.col("code") > 0, "`").otherwise(""), F.when(F.col("link") > 0, close).otherwise(""),
                    F.when(F.col("italic") > 0, "*").otherwise(""), F.when(F.col("bold") > 0, "**").otherwise(""))
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, WHITE, " "), f" *{BREAK} *", "  \n"), "^[ \n]+|[ \n]+$", "")
    cells = F.transform(F.slice(F.split(F.replace(flat, F.lit("  \n"), F.lit(" ")), CELL), F.lit(2), F.lit(1 << 20)), lambda c: F.replace(F.trim(c), F.lit("|"), F.lit("\\|")))
    is_row = (F.col("table") > 0) & F.contains("body", F.lit(CELL))
    raw = F.regexp_replace(F.regexp_replace("body", "^\r?\n", ""), r"\s+$", "")
    k = k.withColumns({"is_row": is_row, "is_code": (F.col("pre") > 0) & (F.col("table") == 0), "cells": F.when(is_row, cells)})
    k = k.withColumn("body", F.when(F.col("is_code"), raw).when(is_row, F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))).otherwise(flat))
    k = k.withColumn("full", F.col("body") != "")
    p = Window.partitionBy(*keys).orderBy("block")
    upto = p.rowsBetween(Window.unboundedPreceding, 0)
    # an item's mark goes to the first block with text from there on, unless its list has ended
    k = k.withColumns({"group": F.sum(F.col("full").cast("int")).over(upto) - F.col("full").cast("int"), "depth": F.col("ul") + F.col("ol"),
                       "at": F.last("at", ignorenulls=True).over(upto)})
    g = Window.partitionBy(*keys, "group").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    k = k.withColumn("item", F.last(F.when(F.col("item").isNotNull(), F.struct("item", "depth")), ignorenulls=True).over(g))
    k = k.withColumn("item", F.when((F.col("item.depth") <= F.col("depth")), F.col("item.item")))
    some = k.withColumn("nth", F.row_number().over(p)).where("full OR nth = 1")  # the first block keeps pages without text
    some = some.withColumns({"p_depth": F.lag("depth").over(p), "p_quote": F.lag("quote").over(p), "p_row": F.lag(F.when(F.col("is_row"), F.col("at"))).over(p),
                             "p_full": F.coalesce(F.max(F.col("full")).over(p.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))})
    first_row = F.col("is_row") & ~F.coalesce(F.col("p_row") == F.col("at"), F.lit(False))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size("cells")))
    quote = F.repeat(F.lit("> "), F.col("quote").cast("int"))
    deep = (2 * F.col("ul") + 3 * F.col("ol")).cast("int")
    indent = F.repeat(F.lit(" "), deep)
    short = F.repeat(F.lit(" "), F.greatest(F.lit(0), deep - F.when(F.col("item") == "- ", 2).otherwise(3)))
    fence = F.when(F.contains("body", F.lit("```")), "````").otherwise("```")
    shown = (F.when(F.col("is_code"), F.concat(fence, F.coalesce("lang", F.lit("")), F.lit("\n"), F.col("body"), F.lit("\n"), fence))
             .when(first_row, F.concat(F.col("body"), rule)).otherwise(F.col("body")))
    lead = F.concat(quote, F.when(F.col("item").isNotNull(), F.concat(short, F.col("item"))).otherwise(indent), F.coalesce("head", F.lit("")))
    tight = (F.col("is_row") & ~first_row) | (F.col("item").isNotNull() & (F.col("p_depth") > 0))
    blank = F.concat(F.lit("\n"), F.rtrim(F.repeat(F.lit("> "), F.least("quote", "p_quote").cast("int"))), F.lit("\n"))
    sep = F.when(~F.col("p_full"), "").when(tight, "\n").otherwise(blank)
    some = some.withColumn("shown", F.when(F.col("full"), F.concat(sep, lead, F.replace(shown, F.lit("\n"), F.concat(F.lit("\n"), quote, indent)))).otherwise(""))
    done = some.groupBy(*keys).agg(F.max(null).alias(null), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "shown"))), lambda x: x["shown"]), "").alias("all"))
    return done.select(*key_cols, F.when(~F.col(null), F.col("all")).alias(out))
