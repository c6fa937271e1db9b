"""Job states and provider listings as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import models
from pagemill.operators.jobs import STATE_FIELDS

SCHEMA = "job_id string, request map<string,string>, completed_urls array<string>, failed_urls array<string>, pending_urls array<string>"


def save_state(state: DataFrame, path: str) -> None:
    """K4: one JSON row; the writer's commit makes it appear whole."""
    state.select(*STATE_FIELDS).coalesce(1).write.mode("overwrite").json(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """A saved state; a state that lacks a field or is no JSON raises ValueError that names the fields."""
    found = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").json(path)
    row = found.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in STATE_FIELDS), F.count("*").alias("n")).first()
    lacking = [c for c in STATE_FIELDS if row[c]]
    if lacking or not row["n"]:
        raise ValueError(f"state without {', '.join(lacking) or 'any row'}: {path}")
    return found


LISTING = "data array<struct<id:string,name:string,description:string,pricing:struct<prompt:string>>>"


def listed_models(reply: Column, provider: str) -> Column:
    """The models of a provider's JSON reply, an empty array if it is none; a price of 0 or a free name is free."""
    data = F.coalesce(F.from_json(reply, LISTING)["data"], F.from_json(F.lit('{"data":[]}'), LISTING)["data"])
    price = lambda m: F.coalesce(m["pricing"]["prompt"].try_cast("double"), F.lit(0.0))
    named = lambda m: F.lower(F.concat_ws(" ", m["name"], m["description"])).contains("free") | m["id"].contains(":free")
    free = (lambda m: (price(m) == 0) | named(m)) if provider == "openrouter" else (lambda m: models.is_free(m["id"], F.lit(provider)))
    return F.transform(data, lambda m: F.struct(m["id"].alias("name"), F.lit(None).cast("long").alias("size"), F.lit(provider).alias("provider"), free(m).alias("is_free")))
