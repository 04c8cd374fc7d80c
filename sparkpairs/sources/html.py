"""HTML -> markdown as an ordered chain of regex rewrites (S5) and chapter
file names (S6). Pure Catalyst expressions; the same rules read identically
in Java and RE2 (no look-around, no back-references in patterns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkpairs.functions.text import col_, py_strip

# (pattern, replacement in Java syntax). Applied in order.
HTML_RULES: list[tuple[str, str]] = [
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<!DOCTYPE[^>]*>", ""),
    (r"(?is)<head[^>]*>.*?</head>", ""),
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?i)<h1[^>]*>", "\n\n# "),
    (r"(?i)<h2[^>]*>", "\n\n## "),
    (r"(?i)<h3[^>]*>", "\n\n### "),
    (r"(?i)<h4[^>]*>", "\n\n#### "),
    (r"(?i)<h5[^>]*>", "\n\n##### "),
    (r"(?i)<h6[^>]*>", "\n\n###### "),
    (r"(?i)</h[1-6]>", "\n\n"),
    (r"(?i)<br[^>]*>", "\n"),
    # an unclosed inline tag ends with its paragraph, as an HTML parser closes it
    (r"(?i)<(?:b|strong)>([^<]*)</p>", "**$1**</p>"),
    (r"(?i)<(?:i|em)>([^<]*)</p>", "*$1*</p>"),
    (r"(?i)</?p(?:\s[^>]*)?>", "\n\n"),
    (r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**"),
    (r"(?i)</?(?:i|em)(?:\s[^>]*)?>", "*"),
    (r"(?i)<li(?:\s[^>]*)?>", "\n- "),
    (r"(?is)<a\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)"),
    # block-level elements end a paragraph
    (r"(?i)</?(?:div|article|section|nav|ul|ol|header|footer|main|aside|table|tr|blockquote)(?:\s[^>]*)?>", "\n\n"),
    (r"(?s)<[^>]+>", ""),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&nbsp;", " "),
    # common named entities (standard HTML definitions); &amp; last so that
    # an escaped entity such as "&amp;copy;" is decoded only once
    (r"&middot;", "\u00b7"),
    (r"&copy;", "\u00a9"),
    (r"&reg;", "\u00ae"),
    (r"&trade;", "\u2122"),
    (r"&hellip;", "\u2026"),
    (r"&mdash;", "\u2014"),
    (r"&ndash;", "\u2013"),
    (r"&lsquo;", "\u2018"),
    (r"&rsquo;", "\u2019"),
    (r"&ldquo;", "\u201c"),
    (r"&rdquo;", "\u201d"),
    (r"&laquo;", "\u00ab"),
    (r"&raquo;", "\u00bb"),
    (r"&amp;", "&"),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
]


def html_to_markdown(html) -> Column:
    out = col_(html)
    for pat, rep in HTML_RULES:
        out = F.regexp_replace(out, F.lit(pat), F.lit(rep))
    return py_strip(out)


def item_name_from_url(url) -> Column:
    return F.regexp_extract(col_(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([^?#]*)", 1)


def chapter_file_name(item_name) -> Column:
    """S6: '/' and '\\' become '_', then '.md' is appended."""
    return F.concat(F.translate(col_(item_name), "/\\", "__"), F.lit(".md"))
