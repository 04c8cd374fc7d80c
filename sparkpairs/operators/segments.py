"""Sentence segmentation with abbreviations learnt from the corpus.

How often a word stands before a full stop, and how often without one, is counted over the whole corpus. A word
that nearly always has one is an abbreviation: the score is the log likelihood ratio of that against the full stops
of words in general (Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection", 2006), lowered for
long words and for every occurrence without a full stop, raised for full stops inside. A full stop after an
abbreviation or after an initial (one capital letter) does not end a sentence; ``!`` and ``?`` always do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpairs.functions.constants import WS_CLASS
from sparkpairs.functions.names import free_names
from sparkpairs.functions.text import SENTENCE_RE, col_
from sparkpairs.session import materialize

#: A word of letters, with full stops inside, and the one after it.
DOTTED_RE = r"\p{L}+(?:\.\p{L}+)*\.?"
#: The word before the full stop that ends a piece.
LAST_RE = r"(?:^|[^\p{L}.])(\p{L}+(?:\.\p{L}+)*)\.[" + WS_CLASS + r"]*$"
THRESHOLD = 0.3
MOST_LITERALS = 2000  # abbreviations that become part of an expression; a larger table is joined
_CUT = "\ue002"        # of the private use area; stands where a sentence ends


def abbreviations(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``word, n, n_stop, score`` of the words that are abbreviations (lower case, without the last full stop).

    One pass over the texts and one shuffle of word counts; texts without words and null texts add nothing."""
    words = docs.select(F.explode(F.regexp_extract_all(col_(text_col), F.lit(DOTTED_RE), F.lit(0))).alias("w"))
    stop = F.endswith("w", F.lit("."))
    counts = words.groupBy(F.lower(F.rtrim("w", F.lit("."))).alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(stop, F.lit(1))).alias("n_stop"))
    counts = materialize(counts)  # the corpus is read once
    share = counts.select(F.sum("n_stop") / F.sum("n")).scalar()
    n, d = F.col("n"), F.col("n_stop")
    bare = n - d

    def likelihood(p: Column) -> Column:
        return d * F.log(p) + bare * F.log(1 - p)

    ratio = -2 * (likelihood(share) - likelihood(F.lit(0.99)))
    inside = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inside
    score = ratio * F.exp(-letters.cast("double")) * (inside + 1) * F.pow(letters.cast("double"), -bare.cast("double"))
    return counts.select("word", "n", "n_stop", score.alias("score")).where((d > 0) & (F.col("score") >= threshold))


def _cut(pieces: Column, goes_on: Column) -> Column:
    """Pieces joined where ``goes_on`` holds (a flag per piece)."""
    marked = F.zip_with(pieces, goes_on, lambda p, on: F.when(on, p).otherwise(F.concat(p, F.lit(_CUT))))
    return F.filter(F.split(F.array_join(marked, ""), _CUT), lambda s: s != "")


def _last(piece: Column) -> Column:
    return F.regexp_extract(piece, LAST_RE, 1)


@dataclass(frozen=True)
class Abbreviations:
    """Abbreviations as part of an expression; goes wherever a sentence splitter goes (``chunking.split_by_max_words``)."""

    words: tuple[str, ...]

    def sentences(self, text: Column) -> Column:
        """Sentence pieces; ``array_join(pieces, '') == text``. A text that holds the private-use character
        U+E002 is cut by the plain rule."""
        plain = F.regexp_extract_all(text, F.lit(SENTENCE_RE), 0)
        known = F.array(*[F.lit(w) for w in self.words]).cast("array<string>")

        def goes_on(piece: Column) -> Column:
            last = _last(piece)
            return (last != "") & (last.rlike(r"^\p{Lu}$") | F.array_contains(known, F.lower(last)))

        return F.when(F.contains(text, F.lit(_CUT)), plain).otherwise(_cut(plain, F.transform(plain, goes_on)))


def learn(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, most: int = MOST_LITERALS) -> Abbreviations:
    """The corpus' abbreviations for use in expressions; ``most`` of them at most reach the driver."""
    found = [r["word"] for r in abbreviations(docs, text_col, threshold).select("word").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} abbreviations: raise the threshold, or join the table with sentence_rows")
    return Abbreviations(tuple(sorted(found)))


def sentence_rows(df: DataFrame, table: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """``key_cols, sent_no, sentence`` with the abbreviations of ``table`` (``word``), however many: the last words of
    the pieces are joined with it (adaptive execution broadcasts a small table). Rows of one key stay apart."""
    row, pieces, piece, at, word = free_names(df, "_row", "_pieces", "_piece", "_at", "_word", taken=("sent_no", "sentence"))
    split = materialize(df.select(*key_cols, F.monotonically_increasing_id().alias(row),
                                  F.regexp_extract_all(col_(text_col), F.lit(SENTENCE_RE), 0).alias(pieces)))
    last = _last(F.col(piece))
    rows = split.select(row, F.posexplode(pieces).alias(at, piece)).select(row, at, last.alias(word)).where(F.col(word) != "")
    initial = rows.where(F.col(word).rlike(r"^\p{Lu}$")).select(row, at)
    known = rows.join(table.select(F.col("word").alias("known")).distinct(), F.lower(word) == F.col("known"), "left_semi").select(row, at)
    held = known.unionByName(initial).groupBy(row).agg(F.collect_set(at).alias("on")).withColumnRenamed(row, "of")
    joined = split.join(held, F.col(row) == F.col("of"), "left")
    flags = F.transform(pieces, lambda p, i: F.coalesce(F.array_contains("on", i), F.lit(False)))
    return joined.select(*key_cols, F.posexplode(_cut(F.col(pieces), flags)).alias("sent_no", "sentence"))
