"""Paragraph chunking.

W1 walks a document's paragraphs in windows of random size: a size is drawn
from Poisson(min(npara, 3)) conditioned on [1, npara], the window covers
``paragraphs[i : i + size]`` and the next start is ``i + max(1, size - 1)``
(neighbours overlap by one paragraph). Draw ``k`` of a document is keyed on
``(seed, 'chunk', key, k)``; at most P draws are needed (every step is >= 1),
so the walk is a fold over P keyed draws inside the row: no shuffle, no window.

F5 then packs each window's sentences greedily into pieces of at most
``max_words`` words (a sentence is never split; pieces concatenate back).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpairs.functions.constants import DEFAULT_MAX_WORDS, DEFAULT_NPARA, DEFAULT_SEED
from sparkpairs.functions.rand import digest, uniform
from sparkpairs.functions.text import WORD_RE, col_, paragraphs, posexplode_rows, sentences
from sparkpairs.session import plan_barrier



def poisson_cdf(npara: int) -> list[float]:
    """Cumulative probabilities of Poisson(min(npara, 3)) restricted to 1..npara."""
    lam = min(npara, 3)
    w = [lam ** j / math.factorial(j) for j in range(1, npara + 1)]
    total = sum(w)
    cdf, acc = [], 0.0
    for x in w[:-1]:
        acc += x / total
        cdf.append(acc)
    return cdf


def truncated_poisson(u: Column, npara: int = DEFAULT_NPARA) -> Column:
    """inverse-CDF draw in [1, npara]."""
    size = F.lit(1)
    for c in poisson_cdf(npara):
        size = size + (u >= F.lit(c)).cast("int")
    return size


PREFIX_BLOCK = 512   # block length of the in-row prefix sum (measured: larger blocks amortise per-block overhead)


def _exclusive_prefix(arr: Column) -> Column:
    """[a0, a1, ...] -> [0, a0, a0+a1, ...]; quadratic in the array length, so
    only applied to arrays of at most ``PREFIX_BLOCK`` elements."""
    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(arr, init,
                       lambda acc, x: F.struct((acc["pos"] + x).alias("pos"),
                                               F.concat(acc["out"], F.array(acc["pos"])).alias("out")),
                       lambda acc: acc["out"])


def window_sizes(n_par: Column, key_cols: list, npara: int, seed: int) -> Column:
    """Keyed size draws k = 0..P-1 (at most P windows, since every step is >= 1)."""
    ks = F.when(n_par > 0, F.sequence(F.lit(0), n_par - 1)).otherwise(F.array().cast("array<int>"))
    draws = F.transform(ks, lambda k: uniform(digest(seed, "chunk", *key_cols, k)))  # one digest per draw
    return F.transform(draws, lambda u: truncated_poisson(u, npara))


def chunk_windows(df: DataFrame, text_col: str = "text", key_cols: list[str] = ("source", "chapter"),
                  npara: int = DEFAULT_NPARA, seed: int = DEFAULT_SEED, sep: str = "\n\n",
                  join_sep: str = "\n\n", keep_cols: list[str] | None = None) -> DataFrame:
    """One row per window: keys, ``chunk_no``, ``start``, ``size``, ``text``.

    Window k starts at the sum of the previous steps ``max(1, size - 1)``. The
    prefix sum is computed inside the row in blocks of ``PREFIX_BLOCK`` draws
    (block totals, their prefix, then each block's local prefix plus its
    offset): O(P * block + (P / block)^2) work for P paragraphs, one pass, no
    shuffle, however long the document.
    """
    keep = list(keep_cols) if keep_cols is not None else [c for c in df.columns if c != text_col]
    keys = [F.col(c) for c in key_cols]
    B = PREFIX_BLOCK
    # The fence keeps the paragraph array a computed column: window lambdas read
    # it, and an inlined split would be re-run for every window.
    staged = plan_barrier(df.select(*keep, paragraphs(text_col, sep).alias("_paras")), "paragraphs")
    staged = staged.withColumn("_sizes", window_sizes(F.size("_paras"), keys, npara, seed))
    steps = F.transform("_sizes", lambda x: F.greatest(F.lit(1), x - 1))
    n = F.size("_sizes")
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / B).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    # Steps cut into blocks; from here every lambda sees only its own element.
    staged = staged.withColumn("_chunks", F.transform(blocks, lambda b: F.slice(steps, b * B + 1, B)))
    staged = staged.withColumn("_boff", _exclusive_prefix(
        F.transform("_chunks", lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))))
    staged = staged.withColumn("_starts", F.flatten(F.transform(
        F.arrays_zip(F.col("_chunks").alias("c"), F.col("_boff").alias("o")),
        lambda z: F.transform(_exclusive_prefix(z["c"]), lambda x: x + z["o"]))))
    # Windows are the draws that start inside the document (a prefix of the draws).
    # Their texts are cut inside the row, so exploded rows carry only their own
    # text (exploding next to the paragraph array would copy it once per window).
    wins = F.filter(F.arrays_zip(F.col("_starts").alias("start"), F.col("_sizes").alias("size")),
                    lambda w: w["start"] < F.size("_paras"))
    cut = F.transform(wins, lambda w: F.struct(
        w["start"].alias("start"), w["size"].alias("size"),
        F.array_join(F.slice(F.col("_paras"), w["start"] + 1, w["size"]), join_sep).alias("text")))
    staged = staged.select(*keep, cut.alias("_cut"))
    exploded = posexplode_rows(staged, F.col("_cut"), keep, "chunk_no", "_w")
    return exploded.select(*keep, "chunk_no", F.col("_w.start").alias("start"), F.col("_w.size").alias("size"),
                           F.col("_w.text").alias(text_col))


def split_by_max_words(text, max_words: int = DEFAULT_MAX_WORDS, splitter_factory=None) -> Column:
    """greedy sentence packing; pieces concatenate back to the text."""
    t = col_(text)
    if max_words <= 0:
        return F.array(t)
    sents = sentences(t, splitter_factory)
    counted = F.transform(sents, lambda s: F.struct(s.alias("s"), F.regexp_count(s, F.lit(WORD_RE)).alias("w")))
    init = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(acc, x):
        cut = F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), x["s"].alias("cur"), x["w"].alias("n"))
        grow = F.struct(acc["done"].alias("done"), F.concat(acc["cur"], x["s"]).alias("cur"), (acc["n"] + x["w"]).alias("n"))
        return F.when((acc["n"] + x["w"] > max_words) & (acc["n"] > 0), cut).otherwise(grow)

    def finish(acc):
        return F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])

    return F.aggregate(counted, init, step, finish)


def chunk_corpus(df: DataFrame, text_col: str = "text", key_cols: list[str] = ("source", "chapter"),
                 npara: int = DEFAULT_NPARA, max_words: int = DEFAULT_MAX_WORDS, seed: int = DEFAULT_SEED,
                 sep: str = "\n\n", join_sep: str = "\n\n", splitter_factory=None) -> DataFrame:
    """W1 then F5: ``source, chapter, chunk_no, sub_no, text`` (the ``clean`` table)."""
    windows = chunk_windows(df, text_col, key_cols, npara, seed, sep, join_sep,
                            keep_cols=[c for c in df.columns if c != text_col])
    keep = [c for c in windows.columns if c not in (text_col, "start", "size")]
    return posexplode_rows(windows, split_by_max_words(text_col, max_words, splitter_factory), keep, "sub_no", text_col)
