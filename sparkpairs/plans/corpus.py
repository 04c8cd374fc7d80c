"""Corpus build (L1): sources -> clean chunks -> split -> error pairs -> merge
with other corpora -> seeded permutation -> dataset folders.

Stage boundaries are materialised (reliable checkpoint in the shared
checkpoint folder, or the written dataset itself), as the stages of the
original flow hand over files: later stages plan against a short lineage,
and a lost executor recomputes from the last boundary only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpairs.functions.constants import (
    DEFAULT_MAX_WORDS,
    DEFAULT_NPARA,
    DEFAULT_SEED,
    DEFAULT_TEST_SIZE,
)
from sparkpairs.operators import chunking, errors, pairs, sampling, segments
from sparkpairs.session import materialize, spread
from sparkpairs.sinks import writers

CLEAN_KEYS = ["source", "chapter", "chunk_no", "sub_no"]


@dataclass
class CorpusSettings:
    npara: int = DEFAULT_NPARA
    max_words: int = DEFAULT_MAX_WORDS
    test_size: float = DEFAULT_TEST_SIZE
    seed: int = DEFAULT_SEED
    sep: str = "\n\n"
    error_config: dict | errors.ErrorConfig | None = None
    subsample: float | None = None
    extra_sources: list[DataFrame] = field(default_factory=list)  # adapted (source, original, corrected, split)
    sentence_splitter: object = None  # optional: segments.Abbreviations, or a factory for a user sentence segmenter
    learn_abbreviations: bool = False  # learn them from the documents of the build


def clean_chunks(docs: DataFrame, s: CorpusSettings, key_cols=("source", "chapter")) -> DataFrame:
    """Stage 2: ``source, chapter, chunk_no, sub_no, text`` plus an exact split.

    The chunks are materialised, as the split counts their keys before it marks them."""
    splitter = segments.learn(docs) if s.learn_abbreviations and s.sentence_splitter is None else s.sentence_splitter
    docs = spread(docs, list(key_cols))
    chunks = chunking.chunk_corpus(docs, "text", list(key_cols), s.npara, s.max_words, s.seed, s.sep, splitter_factory=splitter)
    chunks = materialize(chunks.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_no", "sub_no")}))
    return sampling.train_test_split(chunks, s.test_size, s.seed, [*key_cols, "chunk_no", "sub_no"])


def error_pairs(clean: DataFrame, s: CorpusSettings, key_cols=CLEAN_KEYS) -> DataFrame:
    """Stage 3: ``split, source, original, corrected`` (+ keys, n_errors, applied)."""
    return errors.make_pairs(clean, list(key_cols), s.error_config, s.seed, keep_meta=True)


def merged(pairs_df: DataFrame, s: CorpusSettings) -> DataFrame:
    """Stage 4: union with adapted corpora per split, then the seeded permutation. The pairs are computed once, by its
    checkpoint, and come out in order."""
    frames = [pairs_df.select("split", *pairs.PAIR_COLS)] + [f.select("split", *pairs.PAIR_COLS) for f in s.extra_sources]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return sampling.shuffle_rank(out, s.seed, pairs.PAIR_COLS, ["split"])


def build_corpus(spark: SparkSession, docs: DataFrame, out_dir: str, s: CorpusSettings | None = None) -> DataFrame:
    """Run the whole build and write ``out_dir`` (one folder per split, files in the shuffled order, a manifest and a card).

    With ``subsample`` that share of each split is also written to ``<out_dir>-subset``, with a card."""
    s = s or CorpusSettings()
    final = merged(error_pairs(clean_chunks(docs, s), s), s)
    writers.write_ordered(final, out_dir)
    written = spark.read.parquet(out_dir)
    writers.write_dataset_card(written, out_dir, "Text-correction pairs",
                               params={"npara": s.npara, "max_words": s.max_words, "test_size": s.test_size,
                                       "seed": s.seed, "subsample": s.subsample})
    if s.subsample:
        subset = f"{out_dir.rstrip('/')}-subset"
        writers.write_ordered(sampling.subsample(written, s.subsample, s.seed, pairs.PAIR_COLS, "split"), subset)
        writers.copy_dataset_card(spark, out_dir, subset)
    return written
