"""Training-text preparation and length profile (L2).

pairs -> messages -> rendered chat text -> token lengths -> histogram ->
summary / bins / box plot / truncation curve / optimal lengths / packing /
advice. Only the histogram pass touches rows; it is materialised once and
every report reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpairs.functions import chat
from sparkpairs.functions.constants import DEFAULT_MAX_LENGTH
from sparkpairs.operators import lengths, sampling
from sparkpairs.session import materialize


def chat_texts(pairs_df: DataFrame, system_prompt: str, system_mode: str = "fold") -> DataFrame:
    msgs = chat.to_messages(F.lit(system_prompt), F.col("original"), F.col("corrected"))
    return pairs_df.withColumn("messages", msgs).withColumn("text", chat.render_chat("messages", False, system_mode))


def length_profile(pairs_df: DataFrame, system_prompt: str, max_length: int = DEFAULT_MAX_LENGTH,
                   sample: int | None = None, seed: int = 42, tokenizer_factory=None) -> dict[str, DataFrame]:
    texts = chat_texts(pairs_df, system_prompt)
    if sample:
        texts = sampling.sample_n(texts.select("text"), sample, seed)
    hist = materialize(lengths.length_histogram(lengths.token_lengths(texts.select("text"), "text", tokenizer_factory)))
    grid = lengths.max_length_grid(hist, max_length)
    curve = lengths.truncation_curve(hist, grid)
    return {
        "histogram": hist,
        "summary": lengths.length_summary(hist),
        "bins": lengths.length_bins(hist),
        "boxplot": lengths.length_boxplot(hist),
        "truncation": curve,
        "optimal": lengths.optimal_max_length(curve),
        "packing": lengths.packing_efficiency(hist, max_length),
        "advice": lengths.length_advice(hist, max_length),
    }
