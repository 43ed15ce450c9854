"""Which records are about the same person."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components


def identity_keys(hints: DataFrame) -> DataFrame:
    """(record_id, key): e-mail addresses and handles; the name only for records that have neither."""
    text = "array<string>"
    strong = F.concat(
        F.transform("emails", lambda e: F.concat(F.lit("email:"), e)),
        F.when(F.coalesce("github", F.lit("")) != "", F.array(F.concat(F.lit("github:"), F.col("github")))).otherwise(F.array().cast(text)),
        F.when(F.coalesce("linkedin", F.lit("")) != "", F.array(F.concat(F.lit("linkedin:"), F.col("linkedin")))).otherwise(F.array().cast(text)),
    )
    weak = F.when(F.coalesce("name", F.lit("")) != "", F.array(F.concat(F.lit("name:"), F.col("name")))).otherwise(F.array().cast(text))
    keys = F.when(F.size(strong) > 0, strong).otherwise(weak)
    return hints.select("record_id", F.explode(F.array_distinct(keys)).alias("key"))


def resolve_identities(hints: DataFrame) -> DataFrame:
    """(record_id, component): records that share a key, directly or through others, share a component, its smallest record_id.

    Records and keys make a two-sided graph, so a key that many records share is a star
    and never a set of pairs. Only keys of two records or more enter it.
    """
    keys = identity_keys(hints)
    shared = keys.groupBy("key").agg(F.min("record_id").alias("first"), F.max("record_id").alias("last")).where("first < last")
    edges = keys.join(shared.select("key", "first"), "key").select(F.col("record_id").alias("src"), F.col("first").alias("dst"))
    found = connected_components(edges)
    return hints.select("record_id").join(found.withColumnRenamed("node", "record_id"), "record_id", "left").select("record_id", F.coalesce("component", "record_id").alias("component"))
