"""Schemas of the engine's tables. Nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

UNIVERSE = "ticker string, yahoo_symbol string, sector string"
PRICES = "symbol string, date date, open double, high double, low double, close double, adj_close double, volume bigint, source string, download_timestamp timestamp"
PRICE_NAMES = tuple(c.split()[0] for c in PRICES.split(", "))
#: The layouts of the fundamentals and context files.
REQUIRED_FUNDAMENTALS = ("ticker", "period_end", "period_type", "disclosure_timestamp", "download_timestamp", "source")
NUMERIC_FUNDAMENTALS = (
    "revenue", "gross_profit", "operating_profit", "net_income", "net_interest_income", "total_assets", "total_liabilities", "total_equity", "total_debt",
    "cash_and_equivalents", "operating_cash_flow", "free_cash_flow",
)
FUNDAMENTALS = (
    "ticker", "yahoo_symbol", "sector", "metric_profile", "period_end", "period_type", "disclosure_timestamp", "download_timestamp", "source", "currency",
    *NUMERIC_FUNDAMENTALS,
)
REQUIRED_CONTEXT = ("context_id", "context_type", "scope", "observed_period_start", "observed_period_end", "publication_timestamp", "download_timestamp", "source", "source_access")
CONTEXT = (
    "context_id", "context_type", "scope", "ticker", "sector", "indicator", "value", "unit", "observed_period_start", "observed_period_end",
    "publication_timestamp", "download_timestamp", "source", "source_url", "source_access", "title", "claim", "video_timestamp", "notes",
)
CONTEXT_TYPES = ("macro", "news", "video")
SOURCE_ACCESS = ("public", "licensed", "instructor_approved")
MACRO_INDICATORS = ("usd_try", "eur_try", "tcmb_policy_rate", "tuik_inflation", "fed_policy_rate")
PERIOD_TYPES = ("quarterly", "annual")
#: The layouts of the news, context, alias and question files.
NEWS = "source_id string, title string, url string, summary string, published_timestamp timestamp, fetched_timestamp timestamp, language string, category string, source_access string, raw_source_url string, content_hash string"
NEWS_CONTEXT = "entity_type string, entity_id string, decision_timestamp string, lookback_days int, news_count bigint, source_count bigint, latest_news_timestamp string, evidence_urls string, matched_terms string"
MATCHED_NEWS = NEWS + ", linked_entities array<string>, matched_terms array<string>"
ALIASES = "entity_type string, entity_id string, alias string"
QUESTIONS = "question_id string, requires_numbers string, requires_tools string, requires_state_enforcement string, requires_evidence string, requires_quality_gate string, requires_replay string, requires_human_review string, description string"
SIGNALS = "signal_id string, symbol string, known_at string, direction string, horizon int, source string"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
