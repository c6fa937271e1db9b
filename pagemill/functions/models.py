"""Model names: providers, prices and availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Provider, whether it needs a key, whether it runs locally.
PROVIDERS = (("ollama", False, True), ("openrouter", True, False), ("opencode", True, False), ("lmstudio", False, True), ("llamacpp", False, True))
DEFAULT_PROVIDER = "ollama"


def provider(model: Column) -> Column:
    """the part before the first slash if it is a provider, else the default."""
    front = F.substring_index(model, "/", 1)
    return F.when(model.contains("/") & front.isin([p for p, _, _ in PROVIDERS]), front).otherwise(DEFAULT_PROVIDER)


def is_free(model: Column, provider_: Column) -> Column:
    """F25."""
    local = [p for p, _, here in PROVIDERS if here]
    return F.when(provider_.isin(local), True).when(provider_ == "openrouter", model.contains(":free")).when(provider_ == "opencode", F.lower(model).contains("free")).otherwise(False)


def missing_models(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """wanted(model) of which available(name) has neither the name nor any tag of it; nothing if nothing is available."""
    base = F.substring_index(F.col("model"), ":", 1)
    hits = available.select("name", F.substring_index("name", ":", 1).alias("base"), F.contains("name", F.lit(":")).alias("tagged"))
    found = wanted.join(hits, F.col("model") == F.col("name"), "left_anti").join(hits.filter("tagged").select("base").distinct(), base == F.col("base"), "left_anti")
    return found.join(F.broadcast(available.limit(1).select(F.lit(True).alias("any"))), F.lit(True), "left_semi")
