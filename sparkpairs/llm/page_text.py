"""Main text of web pages by consensus paths of each host (operator 8).

Each page is parsed into blocks of text and the containers that hold them, and
every container is scored: text of its blocks, less link text, half of it also
for the container around it. The best container only marks where the article is.
The vote goes to the generalised path (tags and class names from the root, digits
removed) of the lowest container that holds all of the article: the <main> around
the best container, else what holds all <article> elements (either with the <h1>,
if that stands outside), else what holds every text of the page that is neither
furniture nor mostly links. Votes are counted per
host in Spark; the paths that win at least ``LEAST_SHARE`` of a host's pages
are its consensus. Every page is then extracted again with the host's path of most
votes that it has around its best container, so that what a page holds beside it is
left out. Only a path that misses the page's article (``LEAST_HELD`` of the text of the
page's own container) is passed over, and a page without any such path is extracted
with its own container. All elements at the chosen path are extracted whole,
whatever they score.

Inside the chosen container menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out, by tag, role or class
name, and lists that consist of links. Blocks keep page order. A class name or id
marks furniture only as a whole: all its words are furniture words or words of
place, one at least the former ("cookie-notice", "sidebar-left", not "no-sidebar").
It never does on html, body, main and article, nor on an element around main, nor
(comments apart) on one with most of the page's unlinked text unless an article is
outside it; if all text were furniture by class name, none is. A form, a hidden element or
one with the role of a dialog or form is furniture unless it is around main or around most of the
page's unlinked headings and paragraphs (a page that a script shows, or wrapped in one form); a header
inside the article that holds its <h1> belongs to it; a <label> is furniture inside a form.

The table of winning paths is broadcast after its size was checked; beyond
``BROADCAST_ROWS`` hosts it is joined by host instead.

Time grows with the size of a page, at any depth; texts of any length are read whole.

Edge cases: null or empty html and pages without text give the empty text; a
null or odd url belongs to the empty host; unclosed or unknown tags are read the
way browsers do; repeated rows are extracted one by one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkpairs.llm.common import free_name, plain, slices
from sparkpairs.session import materialize

LEAST_SHARE = 0.1
LEAST_HELD = 0.5         # of the text of a page's own container, that the host's path holds
MOST_PATHS = 10          # paths of one host that reach LEAST_SHARE: ten at most
BROADCAST_ROWS = 50_000  # hosts; each row holds ten paths at most
PATH_CHARS = 1000        # longer paths are named by their innermost part and a digest of the whole
CACHED_CHARS = 500       # attributes beyond are read each time instead of kept in the cache

# HTML elements and the words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td
tfoot th thead tr ul""".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption ul ol dl summary address hgroup tr td th tbody thead tfoot".split())
SKIP_TAGS = frozenset("""head nav header footer aside button select option menu script style noscript template iframe
textarea title svg math canvas audio video object embed noembed noframes xmp label legend input""".split())
STATE_TAGS = frozenset("form fieldset dialog".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search alert menu menubar toolbar".split())
STATE_ROLES = frozenset("form dialog alertdialog".split())
SKIP_WORDS = frozenset("""ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion
nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc
header masthead topbar footer colophon copyright sidebar sidebars aside rail widget widgets related recommended recommendations
notice notices cookie cookies consent gdpr alert banner popup modal overlay disclaimer
comment comments commentlist disqus replies respond discussion
share sharing social newsletter subscribe subscription signup login search form toolbar skip""".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond discussion".split())
PLACE_WORDS = frozenset("site global left right top bottom area box slot bar list block wrapper container inner".split())
NEVER_BY_WORD = frozenset("html body main article".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th")}
CLOSES_WITHIN = frozenset("ul ol dl table select".split())

_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*+)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
_READ = frozenset("class id role hidden aria-hidden style".split())
_BLOCK_TAG = re.compile(r"</?(?:p|div|article|section|main|li|ul|ol|body|html|h[1-6])\b", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[a-z]+")


# What marks an element as page furniture; the last three are withdrawn where they would take the article.
NOT, FIRMLY, BY_COMMENT_WORD, BY_WORD, BY_STATE = range(5)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 article main blockquote pre li dd".split())


def by_word(names: str) -> int:
    """What the class names and ids of an element say."""
    out = NOT
    for name in names.split():
        words = set(_WORDS.findall(_HUMP.sub(" ", name).lower()))
        if words & SKIP_WORDS and words <= SKIP_WORDS | PLACE_WORDS:
            if not words & COMMENT_WORDS:
                return BY_WORD
            out = BY_COMMENT_WORD
    return out


def element(tag: str, attrs: str) -> tuple[str, int]:
    """Generalised name of an element and what marks it as page furniture."""
    found = {}
    for name, value in _ATTR.findall(attrs):
        if (name := name.lower()) in _READ:
            found.setdefault(name, value.strip("\"'"))
    names = found.get("class", "")
    style = found.get("style", "").replace(" ", "").lower()
    role = found.get("role", "").lower()
    state = (tag in STATE_TAGS or role in STATE_ROLES
             or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style)
    skip = (FIRMLY if tag in SKIP_TAGS or role in SKIP_ROLES else BY_STATE if state
            else NOT if tag in NEVER_BY_WORD else by_word(f"{names} {found.get('id', '')}"))
    classes = sorted({c for c in (re.sub(r"\d+", "", x) for x in names.lower().split()) if c})
    return ".".join([tag, *classes]), skip


cached_element = lru_cache(maxsize=20_000)(element)


class Page:
    """Blocks of text of a page, and the elements that hold them."""

    def __init__(self, source: str):
        self.tags, self.names, self.parents, self.skips = [""], [""], [-1], [NOT]
        self.texts: list[str] = []
        self.owners: list[int] = []   # element of each block
        self.linked: list[int] = []   # characters of the block inside links
        self.paths: list[str] = []
        self._parse(source)
        self._index()
        self._withdraw()
        self._count()

    def _parse(self, source: str) -> None:
        stack = [0]
        pieces: list[str] = []
        links = 0
        in_link = 0
        at = 0

        def flush() -> None:
            nonlocal links
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.texts.append(text)
                    self.owners.append(stack[-1])
                    self.linked.append(min(links, len(text)))
                pieces.clear()
            links = 0

        def text_to(end: int) -> None:
            nonlocal links
            if end > at:
                t = source[at:end]
                if "&" in t:
                    t = entities.unescape(t)
                pieces.append(t)
                if in_link:
                    links += len(t.strip())

        def pop_to(depth: int) -> None:
            nonlocal in_link
            flush()
            for e in stack[depth:]:
                in_link -= self.tags[e] == "a"
            del stack[depth:]

        size = len(source)
        while at < size:
            m = _TAG.search(source, at)
            if m is None:
                text_to(size)
                break
            text_to(m.start())
            at = m.end()
            closing, tag, attrs = m.group(1), m.group(2), m.group(3)
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                if tag in BLOCK:
                    flush()
                for depth in range(len(stack) - 1, 0, -1):
                    open_tag = self.tags[stack[depth]]
                    if open_tag == tag:
                        if tag in BLOCK:
                            pop_to(depth)
                        else:
                            self._leave(stack, depth)
                            in_link = sum(self.tags[e] == "a" for e in stack)
                        break
                    if tag not in BLOCK and open_tag in BLOCK:
                        break
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if tag in BLOCK:
                flush()
                for depth in range(len(stack) - 1, 0, -1):  # an open paragraph ends at the next block
                    if self.tags[stack[depth]] == "p":
                        pop_to(depth)
                        break
                    if self.tags[stack[depth]] in BLOCK:
                        break
                ends = CLOSES.get(tag)
                if ends:
                    for depth in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[depth]] in ends:
                            pop_to(depth)
                            if tag not in ("tr", "tbody"):
                                break
                        elif depth < len(stack) and self.tags[stack[depth]] in CLOSES_WITHIN:
                            break
            if tag in VOID:
                continue
            name, skip = (cached_element if len(attrs) < CACHED_CHARS else element)(tag, attrs)
            if tag in RAW:  # up to its end tag nothing is markup
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else size
                continue
            if attrs.rstrip().endswith("/") and tag in ("svg", "path"):
                continue
            if tag == "label" and skip == FIRMLY and not any(self.tags[e] == "form" for e in stack):
                skip = NOT
            if skip and tag not in BLOCK:
                # furniture inside a line: its text is kept apart from the block around it
                end = self._past(source, at, tag)
                if skip in (FIRMLY, BY_STATE) or not _BLOCK_TAG.search(source, at, end):
                    at = end
                    continue
            self.tags.append(tag)
            self.names.append(name)
            self.parents.append(stack[-1])
            self.skips.append(skip)
            stack.append(len(self.tags) - 1)
            in_link += tag == "a"
        flush()

    @staticmethod
    def _leave(stack: list[int], depth: int) -> None:
        """An inline element ends; inline elements opened inside it go on in browsers, here they end with it."""
        del stack[depth:]

    @staticmethod
    def _past(source: str, at: int, tag: str) -> int:
        """Position after the end of an inline element (nested ones of its tag counted)."""
        depth = 1
        for m in re.compile(rf"<(/?){re.escape(tag)}\b[^>]*>", re.I).finditer(source, at):
            depth += -1 if m.group(1) else 1
            if not depth:
                return m.end()
        nxt = _BLOCK_TAG.search(source, at)
        return nxt.start() if nxt else len(source)

    def _index(self) -> None:
        """Elements are numbered as they open, so those inside ``e`` are ``e`` to ``last[e]``."""
        n = len(self.tags)
        self.last = list(range(n))
        for e in range(n - 1, 0, -1):
            up = self.parents[e]
            self.last[up] = max(self.last[up], self.last[e])
        self.outermost: dict[str, list[int | None]] = {t: [None] * n for t in ("article", "main", "h1")}
        for tag, out in self.outermost.items():
            for e in range(1, n):
                out[e] = up if (up := out[self.parents[e]]) is not None else e if self.tags[e] == tag else None
        self.lists = self._link_lists()

    def _inside(self, per_element: list[float]) -> list[float]:
        """Sums over an element and all inside it."""
        out = list(per_element)
        for e in range(len(out) - 1, 0, -1):
            out[self.parents[e]] += out[e]
        return out

    def _count(self) -> None:
        """Furniture marks on the way from the root to each element."""
        self.marks = [0] * len(self.tags)
        for e in range(1, len(self.tags)):
            self.marks[e] = self.marks[self.parents[e]] + (bool(self.skips[e]) or e in self.lists)

    def _withdraw(self) -> None:
        """Class names and states do not make furniture of an element that holds the article."""
        n = len(self.tags)
        for e in range(1, n):  # the article's own header
            if self.tags[e] == "header" and self.skips[e] == FIRMLY and (self.outermost["article"][e] or self.outermost["main"][e]):
                if any(self.tags[x] == "h1" for x in range(e, self.last[e] + 1)):
                    self.skips[e] = NOT
        named = [e for e, skip in enumerate(self.skips) if skip > FIRMLY]
        if not named:
            return
        for e, tag in enumerate(self.tags):
            if tag == "main":
                while e > 0:
                    self.skips[e] = FIRMLY if self.skips[e] == FIRMLY else NOT
                    e = self.parents[e]
        firm, prose = [False] * n, [False] * n
        for e in range(1, n):
            firm[e] = firm[self.parents[e]] or self.skips[e] == FIRMLY or e in self.lists
            prose[e] = prose[self.parents[e]] or self.tags[e] in PROSE
        unlinked, article, told = [0] * n, [0] * n, [0] * n
        for text, owner, linked in zip(self.texts, self.owners, self.linked, strict=True):
            if not firm[owner]:
                size = len(text) - linked
                unlinked[owner] += size
                told[owner] += size * prose[owner]
                # an article in furniture (a reader's comment, a teaser) is no sign of the page's article elsewhere
                if self.outermost["article"][owner] is not None or self.outermost["main"][owner] is not None:
                    article[owner] += size
        unlinked, article, told = self._inside(unlinked), self._inside(article), self._inside(told)
        for e in named:
            most = 2 * (told if self.skips[e] == BY_STATE else unlinked)[e] > unlinked[0]
            if self.skips[e] in (BY_WORD, BY_STATE) and most and article[e] == article[0]:
                self.skips[e] = NOT
        self._count()
        if unlinked[0] and all(self.marks[o] for o in self.owners):
            for e in named:
                self.skips[e] = NOT if self.skips[e] in (BY_WORD, BY_COMMENT_WORD) else self.skips[e]

    # ------------------------------------------------------------ containers
    def path(self, e: int) -> str:
        """Generalised path of an element; a long one is named by a digest of its outer part and its last name."""
        while len(self.paths) <= e:
            x = len(self.paths)
            if not x or self.tags[x] == "html":
                self.paths.append("")
                continue
            up = self.paths[self.parents[x]]
            whole = f"{up}>{self.names[x]}" if up else self.names[x]
            if len(whole) > PATH_CHARS:
                whole = f"{hashlib.sha256(whole.encode('utf-8', 'surrogatepass')).hexdigest()} {self.names[x][-PATH_CHARS // 2:]}"
            self.paths.append(whole)
        return self.paths[e]

    def _block_parent(self, e: int) -> int:
        while e > 0 and (self.tags[e] not in BLOCK or self.tags[e] in LEAF):
            e = self.parents[e]
        return e

    def _link_lists(self) -> set[int]:
        """Lists whose text is links, nearly all of it."""
        n = len(self.tags)
        total, links, count = [0] * n, [0] * n, [0] * n
        for text, owner, linked in zip(self.texts, self.owners, self.linked, strict=True):
            total[owner] += len(text)
            links[owner] += linked
            count[owner] += linked > 0
        total, links, count = self._inside(total), self._inside(links), self._inside(count)
        return {e for e, tag in enumerate(self.tags) if tag in ("ul", "ol", "menu", "dl") and count[e] >= 2 and links[e] >= 0.8 * total[e]}

    def holds(self, top: int, e: int) -> bool:
        return top <= e <= self.last[top]

    def furniture(self, e: int, top: int) -> bool:
        """Whether something from ``e`` up to (not including) ``top`` is page furniture, or ``e`` is not inside ``top``."""
        return not self.holds(top, e) or self.marks[e] > self.marks[top]

    def scores(self) -> dict[int, float]:
        """Score of each container that holds text outside page furniture."""
        out: dict[int, float] = {}
        for text, owner, linked in zip(self.texts, self.owners, self.linked, strict=True):
            if self.marks[owner]:
                continue
            gain = len(text) - 2 * linked
            c = self._block_parent(owner)
            out[c] = out.get(c, 0.0) + gain
            if c > 0:
                up = self._block_parent(self.parents[c])
                out[up] = out.get(up, 0.0) + gain / 2
        return out

    def best(self) -> int | None:
        s = self.scores()
        return max(s, key=lambda e: (s[e], -e)) if s else None

    def prose(self) -> list[int]:
        """Elements of the blocks outside page furniture that are not mostly links (all such blocks are, if no other is there)."""
        kept = [(o, 2 * linked < len(t)) for t, o, linked in zip(self.texts, self.owners, self.linked, strict=True) if not self.marks[o]]
        return [o for o, good in kept if good] or [o for o, _ in kept]

    def _common(self, elements: Iterable[int]) -> int:
        """The lowest element around all of them."""
        first, final = min(elements), max(elements)
        while self.last[first] < final:
            first = self.parents[first]
        return first

    def container(self) -> int | None:
        """The lowest container that holds all of the article, None without text."""
        best = self.best()
        if best is None:
            return None
        prose = self.prose()
        articles = self.outermost["article"]
        top = self.outermost["main"][best]
        if top is None and articles[best] is not None:
            top = self._common({a for o in prose if (a := articles[o]) is not None} | {articles[best]})
        if top is None:
            return self._block_parent(self._common({best, *prose}))
        heads = [o for o in prose if self.outermost["h1"][o] is not None]
        if heads and not any(self.holds(top, o) for o in heads):
            top = self._common({top, heads[0]})
        return top

    def by_path(self) -> dict[str, list[int]]:
        """Containers around text outside page furniture, by path."""
        around: set[int] = set()
        for o in self.prose():
            while o >= 0 and o not in around:
                around.add(o)
                o = self.parents[o]
        out: dict[str, list[int]] = {}
        for e in sorted(around):
            if not e or self.tags[e] in BLOCK and self.tags[e] not in LEAF:
                out.setdefault(self.path(e), []).append(e)
        return out

    def held(self, tops: list[int], own: int) -> float:
        """Share of the own container's text, furniture and links apart, that ``tops`` hold."""
        whole = part = 0
        for text, o, linked in zip(self.texts, self.owners, self.linked, strict=True):
            if not self.furniture(o, own) and 2 * linked < len(text):
                whole += len(text)
                part += len(text) * any(self.holds(top, o) for top in tops)
        return part / whole if whole else 0.0

    def extract(self, tops: list[int]) -> str:
        return "\n".join(t for t, o in zip(self.texts, self.owners, strict=True) if any(not self.furniture(o, top) for top in tops))


def vote(source: str) -> str | None:
    """Path of the container of a page's article, None without text."""
    page = Page(source)
    top = page.container()
    return None if top is None else page.path(top)


def main_text(source: str, paths: list[str] | None) -> str:
    """Text of a page's containers at the first of ``paths`` (most votes first) that holds its article, else at the path of its own."""
    page = Page(source)
    own = page.container()
    if own is None:
        return ""
    by_path = page.by_path()
    best = page.best()
    for path in paths or ():
        tops = by_path.get(path)  # a text may be spread over several containers of one path
        if tops and any(page.holds(top, best) for top in tops) and page.held(tops, own) >= LEAST_HELD:
            return page.extract(tops)
    return page.extract(by_path.get(page.path(own), [own]))


# ---------------------------------------------------------------- Spark
def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``host, paths``: paths that win at least ``LEAST_SHARE`` of the host's pages, most votes first."""

    @F.arrow_udf("string")
    def votes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array([vote(x) for part in slices(plain(arr)) for x in part.to_pylist()], pa.string())

    counted = (pages.select(_host(F.col(url_col)).alias("host"), votes(F.col(html_col)).alias("path")).where("path IS NOT NULL")
               .groupBy("host", "path").agg(F.count("*").alias("n")))
    w = Window.partitionBy("host")
    ranked = (counted.withColumn("share", F.col("n") / F.sum("n").over(w))
              .withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), F.asc("path"))))
              .where((F.col("share") >= LEAST_SHARE) & (F.col("r") <= MOST_PATHS)))
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda p: p["path"]).alias("paths"))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each in ``out`` (a column of that name is replaced)."""
    winners = materialize(winning_paths(pages, html_col, url_col))
    few = winners.count() <= BROADCAST_ROWS
    h, host, chosen_paths = (free_name(pages, x) for x in ("_h", "_host", "_paths"))
    w = winners.select(F.col("host").alias(host), F.col("paths").alias(chosen_paths))

    @F.arrow_udf("string")
    def texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for source, paths in batches:
            chosen = iter(paths.to_pylist())
            yield pa.array([main_text(x, next(chosen)) for part in slices(plain(source)) for x in part.to_pylist()], pa.string())

    joined = pages.withColumn(h, _host(F.col(url_col))).join(F.broadcast(w) if few else w, F.col(h) == F.col(host), "left")
    return joined.withColumn(out, texts(F.col(html_col), F.col(chosen_paths))).drop(h, host, chosen_paths)
