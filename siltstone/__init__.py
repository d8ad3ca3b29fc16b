"""A Spark-native engine for market evidence: normalising, deduplicating, resolving, scoring and delivering items."""
