"""Record types and parameters with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ARTICLE = T.StructType(
    [
        T.StructField("article_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("published_at", T.StringType()),
        T.StructField("retrieved_at", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("access", T.StringType()),
        T.StructField("retrieval", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("raw_metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass(frozen=True)
class Params:
    """Defaults that results depend on."""

    # near-duplicates
    permutations: int = 128
    dedup_threshold: float = 0.85
    dedup_shingle: int = 5
    # boilerplate
    boilerplate_df: int = 25
    boilerplate_sentence_words: int = 6
    boilerplate_content_words: int = 50
    # furniture
    running_line_words: int = 6
    running_line_repeats: int = 3
    reference_tail: float = 0.6
    # chunks
    chunk_tokens: int = 512
    chunk_overlap: int = 64
    # volume
    smooth_days: int = 7
    mass_alpha: float = 0.05
    floor_articles: int = 42
    min_r2: float = 0.3
    anchors: int = 10
    min_span_days: int = 30
    min_weekly_blocks: int = 10
    contamination: float = 0.90
    # stages
    trend_alpha: float = 0.05
    recent_weeks: int = 4
    dormant_fraction: float = 0.25
    stale_weeks: int = 16
    # heating
    heat_recent: int = 16
    heat_base: int = 52
    heat_sigma: float = 2.0
    heat_articles: int = 3
    press_since: int = 2017
    forming_weeks: int = 16
    forming_articles: int = 3
    emerging_weeks: int = 4
    # overlays
    granger_lags: int = 4
    granger_alpha: float = 0.05
    granger_obs_per_lag: int = 5
    calendar_half_window: int = 3
    # neighbours
    panel_k: int = 5
    edge_k: int = 3
    terms: int = 10
    # incremental
    merge_similarity: float = 0.7
    buffer_days: int = 14
    seed: int = 42


PARAMS = Params()
