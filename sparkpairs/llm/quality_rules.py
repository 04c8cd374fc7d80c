"""Quality rules as a short-circuit cascade (operator 10).

Five counts of each text are always computed (they are the result's columns).
The base rule (too short, or too repetitive) is final. The verdict of all other
texts comes from a cascade of rules: each rule's cost and rejection rate is
estimated on a sample, rules are ordered by rejection per cost, and a rule is
evaluated only on the texts that every earlier rule passed. The order changes
the work, never the verdict (a text is kept if no rule rejects it).

Texts are judged a slice at a time, each whole whatever its length.

Edge cases: a null or empty text has no words, counts zero, ``base_failed`` and
is not kept; repeated rows are judged one by one; an empty table gives an empty
result; extra columns are ignored (``quality``) or carried (``keep_good``).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpairs.llm.common import FlatWords, free_name, segment_sums, slices, with_struct

WINDOW = 8
MIN_WORDS = 20
KINDS_WINDOW = 1000  # words; the share of distinct words falls with the length of any text
SAMPLE_DOCS = 400  # documented bound of the sample that only sets the order of the rules
SAMPLE_CHARS = 20_000
SYMBOLS = "[#*$%&|<>]"
SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, rule string")


# ---------------------------------------------------------------- counts
def _window_repeats(flat: FlatWords, width: int = WINDOW) -> np.ndarray:
    """Per text: words covered by ``width``-word windows found at least twice in it."""
    codes, offsets = flat.codes.astype(np.int64), flat.offsets
    n = len(codes)
    if n < width:
        return np.zeros(len(offsets) - 1, np.int64)
    mix = np.random.default_rng(7).integers(1, 2**63, size=int(codes.max()) + 1, dtype=np.uint64)[codes]
    h = np.zeros(n - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mix[k:n - width + 1 + k]
    doc = flat.doc_of()
    at = np.flatnonzero(doc[: n - width + 1] == doc[width - 1:])  # windows inside one text
    with np.errstate(over="ignore"):
        key = h[at] ^ (doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    # first a cheap filter: only windows whose key occurs again are looked at exactly
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = key[1:] == key[:-1]
    if not same.any():
        return np.zeros(len(offsets) - 1, np.int64)
    again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    at, key = at[again], key[again]
    groups = np.concatenate([[True], key[1:] != key[:-1]])
    first = at[np.maximum.accumulate(np.where(groups, np.arange(len(at)), 0))]
    equal = doc[first] == doc[at]
    for k in range(width):
        equal &= codes[first + k] == codes[at + k]
    if equal.all():
        found = at
    else:  # two different windows share a key: compare the windows themselves
        rows = np.column_stack([doc[at], *(codes[at + k] for k in range(width))])
        _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        found = at[count[inverse.ravel()] > 1]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, found, 1)
    np.add.at(step, found + width, -1)
    return segment_sums((np.cumsum(step[:n]) > 0).astype(np.int64), offsets)


def _dup_lines(texts: pa.Array) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line of the text."""
    lists = pc.split_pattern(texts, "\n")
    enc = lists.flatten().dictionary_encode()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    codes = np.asarray(enc.indices).astype(np.int64)
    worded = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(enc.dictionary)))[codes] > 0 if len(codes) else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = doc * (int(codes.max(initial=0)) + 1) + codes
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return segment_sums((later & worded).astype(np.int64), offsets)


@dataclass
class Texts:
    """A slice of texts with its word arrays; statistics are computed when a rule asks."""

    texts: pa.Array

    def __post_init__(self):
        self.flat = FlatWords(self.texts)
        self.n_words = self.flat.counts()
        chars = np.asarray(pc.utf8_length(self.flat.dictionary)).astype(np.int64)
        self.word_chars = segment_sums(chars[self.flat.codes], self.flat.offsets)
        self.n_symbols = np.asarray(pc.count_substring_regex(self.texts, SYMBOLS)).astype(np.int64)
        self.n_dup_lines = _dup_lines(self.texts)
        self.n_repeat_words = _window_repeats(self.flat)

    def positions(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words of the chosen texts, and the texts' offsets among them."""
        lens = self.n_words[rows]
        ends = np.cumsum(lens)
        starts = self.flat.offsets[:-1][rows]
        at = np.repeat(starts - (ends - lens), lens) + np.arange(lens.sum())
        return self.flat.codes[at], np.concatenate([[0], ends])

    def per_word(self, rows: np.ndarray, value: Callable[[pa.Array], pa.Array]) -> np.ndarray:
        """Sum over the words of the chosen texts of a value of the distinct word."""
        codes, offsets = self.positions(rows)
        used, at = np.unique(codes, return_inverse=True)  # only the words of these texts are looked at
        return segment_sums(np.asarray(value(self.flat.dictionary.take(pa.array(used)))).astype(np.int64)[at], offsets)


# ---------------------------------------------------------------- rules
# Each rule gets the slice and the row numbers still in play and returns True where it rejects.
def _long_words(t: Texts, rows):
    return t.word_chars[rows] > 20 * t.n_words[rows]


def _short_words(t: Texts, rows):
    return t.word_chars[rows] < 2 * t.n_words[rows]


def _symbols(t: Texts, rows):
    return 10 * t.n_symbols[rows] > t.n_words[rows]


def _dup_line_share(t: Texts, rows):
    out = t.n_dup_lines[rows] >= 3
    some = rows[out]
    lines = np.asarray(pc.add(pc.count_substring(t.texts.take(pa.array(some)), "\n"), 1)).astype(np.int64)
    out[out] = 2 * t.n_dup_lines[some] > lines
    return out


def _shouting(t: Texts, rows):
    """More upper-case than lower-case letters."""
    upper = t.per_word(rows, lambda words: pc.count_substring_regex(words, r"\p{Lu}"))
    lower = t.per_word(rows, lambda words: pc.count_substring_regex(words, r"\p{Ll}"))
    return upper > lower


def _exclaiming(t: Texts, rows):
    texts = t.texts.take(pa.array(rows))
    return np.asarray(pc.count_substring(texts, "!!")).astype(np.int64) * 4 > t.n_words[rows]


def _few_letters(t: Texts, rows):
    """Fewer than half of the words hold a letter."""
    lettered = t.per_word(rows, lambda words: pc.match_substring_regex(words, r"\p{L}").cast(pa.int64()))
    return 2 * lettered < t.n_words[rows]


def _few_kinds(t: Texts, rows):
    """Each distinct word of a window of ``KINDS_WINDOW`` words (mean over all windows of the text; a shorter
    text is one window) stands for more than ten words, in texts of 100 words and more."""
    lens = t.n_words[rows]
    codes, offsets = t.positions(rows)
    key = np.repeat(np.arange(len(rows)), lens) * (len(t.flat.dictionary) + 1) + codes
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    start = np.repeat(offsets[:-1], lens)
    before = start - 1  # place of the word's last occurrence in its text
    before[order[1:][same]] = order[:-1][same]
    # a word is new in the windows that hold it and begin after its last occurrence
    at, width = np.arange(len(codes)), np.minimum(lens, KINDS_WINDOW)
    last = np.minimum(at, start + np.repeat(lens - width, lens))
    first = np.maximum(before + 1, at - np.repeat(width, lens) + 1)
    kinds = segment_sums(np.maximum(last - first + 1, 0), offsets)  # of all windows
    return (lens >= 100) & (width * (lens - width + 1) > 10 * kinds)


def _stutter(t: Texts, rows):
    """At least a third of the words repeat the word before them."""
    codes, offsets = t.positions(rows)
    same = np.concatenate([[False], codes[1:] == codes[:-1]])[: len(codes)]
    same[offsets[:-1][np.diff(offsets) > 0]] = False
    return 3 * segment_sums(same.astype(np.int64), offsets) > t.n_words[rows]


RULES: dict[str, Callable[[Texts, np.ndarray], np.ndarray]] = {
    "long_words": _long_words, "short_words": _short_words, "symbols": _symbols, "dup_lines": _dup_line_share,
    "shouting": _shouting, "exclaiming": _exclaiming, "few_letters": _few_letters, "few_kinds": _few_kinds,
    "stutter": _stutter,
}


def base_failed(t: Texts) -> np.ndarray:
    return (t.n_words < MIN_WORDS) | (100 * t.n_repeat_words > 30 * t.n_words)


# ---------------------------------------------------------------- order of the rules
def order_rules(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
                sample_chars: int = SAMPLE_CHARS) -> list[str]:
    """Rule names by rejections per second, estimated on at most ``sample_docs`` texts of at
    most ``sample_chars`` characters.

    The sample is a share of the texts by their hash, whatever the order of the table; it decides only
    in which order the rules run, never a verdict. Ties go by name.
    """
    share = -(-1_000_000 * sample_docs // max(1, docs.count()))
    text = F.col(text_col)
    head = (docs.where((F.length(text) <= sample_chars) & (F.pmod(F.xxhash64(text), F.lit(1_000_000)) < share))
            .select(text.alias("t")).limit(sample_docs).collect())
    rejected, seconds = dict.fromkeys(RULES, 0), dict.fromkeys(RULES, 1e-9)
    for part in slices(pa.array([r.t for r in head], pa.large_string())):
        t = Texts(part)
        rows = np.flatnonzero(~base_failed(t))
        for name, rule in RULES.items():
            t0 = time.perf_counter()
            rejected[name] += int(rule(t, rows).sum()) if len(rows) else 0
            seconds[name] += time.perf_counter() - t0
    return sorted(RULES, key=lambda n: (-rejected[n] / seconds[n], n))


# ---------------------------------------------------------------- operator
def judge(texts: pa.Array, order: list[str]) -> pa.StructArray:
    """Counts, base verdict and cascade verdict of a slice of texts.

    ``rule`` names a rule that rejected the text ("base" for the base rule, null if kept)."""
    t = Texts(texts)
    failed = base_failed(t)
    rule = np.where(failed, "base", None).astype(object)
    rows = np.flatnonzero(~failed)
    for name in order:
        if not len(rows):
            break
        hit = RULES[name](t, rows)
        rule[rows[hit]] = name
        rows = rows[~hit]
    kept = np.zeros(len(texts), bool)
    kept[rows] = True
    cols = {"n_words": t.n_words, "word_chars": t.word_chars, "n_symbols": t.n_symbols, "n_dup_lines": t.n_dup_lines,
            "n_repeat_words": t.n_repeat_words}
    arrays = [pa.array(v.astype(np.int64)) for v in cols.values()]
    return pa.StructArray.from_arrays([*arrays, pa.array(failed), pa.array(kept), pa.array(rule, pa.string())],
                                      names=[*cols, "base_failed", "kept", "rule"])


def with_quality(docs: DataFrame, text_col: str = "text", out: str = "quality",
                 order: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct column ``out`` (fields of ``SCHEMA``)."""
    order = order or order_rules(docs, text_col)
    return with_struct(docs, text_col, out, SCHEMA, lambda texts: judge(texts, order))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with exactly its columns."""
    out = free_name(docs, "_quality")
    return with_quality(docs, text_col, out).where(F.col(f"{out}.kept")).drop(out)
