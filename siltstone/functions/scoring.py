"""Scores of event candidates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that an analysis must not use.
TRADING_WORDS = ("buy", "sell", "hold", "target price", "position sizing", "rebalance")
MOCK_RATIONALE = "Deterministic mock; human-reviewed impact analysis is required."


def _parts(official: Column, sources: Column, entities: Column, priority: Column) -> list[tuple[str, Column]]:
    zero = F.lit(0).cast("long")
    return [
        ("source_diversity", F.least(F.lit(20).cast("long"), F.greatest(zero, sources - 1) * 10)),
        ("corroboration", F.when(sources > 1, F.lit(15).cast("long")).otherwise(zero)),
        ("entity_relevance", F.least(F.lit(15).cast("long"), entities * 5)),
        ("source_priority", F.least(F.lit(10).cast("long"), F.greatest(zero, F.coalesce(priority.cast("long"), zero)))),
    ]


def importance(evidence: Column, official: Column, sources: Column, entities: Column, priority: Column) -> Column:
    """0 to 100: base 10, official 30, diversity 20, corroboration 15, entities 15, priority 10; 0 without evidence."""
    total = F.lit(10).cast("long") + F.when(official, F.lit(30).cast("long")).otherwise(F.lit(0).cast("long"))
    for _, part in _parts(official, sources, entities, priority):
        total = total + part
    return F.when(evidence == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), total.cast("double")))


def importance_reasons(evidence: Column, official: Column, sources: Column, entities: Column, priority: Column) -> Column:
    """The components as ``name:points`` in their order."""
    said = [F.lit("base:10"), F.when(official, F.lit("official_source:30"))]
    said += [F.concat(F.lit(name + ":"), part.cast("string")) for name, part in _parts(official, sources, entities, priority)]
    return F.when(evidence == 0, F.array(F.lit("no_active_evidence:0"))).otherwise(F.array_compact(F.array(*said)))


def confidence(evidence: Column, official: Column, sources: Column) -> Column:
    more = F.least(F.lit(0.3), F.greatest(F.lit(0), sources - 1) * 0.15)
    return F.when(evidence == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.lit(0.45) + F.when(official, F.lit(0.2)).otherwise(F.lit(0.0)) + more))


def mock_impact_confidence(sources: Column) -> Column:
    return F.when(sources > 1, F.lit(0.5)).otherwise(F.lit(0.25))


def mock_impact(sources: Column, companies: Column, assets: Column, sectors: Column, uncertainty: Column) -> Column:
    """A whole analysis that says nothing: constants, what it was asked about, and a confidence by the number of sources."""
    return F.struct(
        companies.alias("affected_companies"), assets.alias("affected_assets"), sectors.alias("affected_sectors"), F.lit("uncertain").alias("impact_direction"), F.lit("short_term").alias("impact_horizon"),
        F.array(F.lit("information")).alias("impact_channels"), mock_impact_confidence(sources).alias("confidence"), F.lit(MOCK_RATIONALE).alias("rationale_summary"), uncertainty.alias("uncertainty"),
        F.lit(True).alias("required_market_validation"), F.lit(1).alias("analysis_version"))


def analysis_errors(confidence_: Column, version: Column, rationale: Column) -> Column:
    """Codes of what is wrong with an analysis, in the order of the checks."""
    low, trading = F.lower(rationale), F.lit(False)
    for word in TRADING_WORDS:
        trading = trading | F.contains(low, F.lit(word))
    return F.array_compact(F.array(
        F.when(~confidence_.between(0, 1), F.lit("confidence_out_of_range")),
        F.when(version < 1, F.lit("analysis_version_invalid")),
        F.when(F.trim(rationale) == "", F.lit("rationale_summary_required")),
        F.when(trading, F.lit("trading_action_language_forbidden")),
    ))
