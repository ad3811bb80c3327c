"""Look-ups against the editable system alias table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.columns import UNKNOWN


def normalize_system(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace system names by their canonical names.

    Missing, empty and ``nan`` names become Unknown; an exact canonical name stays; else
    the first table entry whose alias matches without regard to case; else unchanged.
    Both look-ups are one equi-join on the lower-cased name: a row of the lookup side
    carries the canonical spellings to keep and the name its alias stands for.
    """
    entries = aliases.select(
        F.lower("alias").alias("name_lc"), F.struct("ord", "canonical").alias("hit"), F.lit(None).cast("string").alias("own")
    ).where(F.col("name_lc").isNotNull())
    names = aliases.select(
        F.lower("canonical").alias("name_lc"), F.lit(None).cast("struct<ord:int,canonical:string>").alias("hit"), F.col("canonical").alias("own")
    )
    lookup = (
        entries.unionByName(names)
        .groupBy("name_lc")
        .agg(F.min("hit")["canonical"].alias("target"), F.collect_set("own").alias("spellings"))
    )
    name = F.col("system")
    missing = name.isNull() | (name == "") | (F.upper(name) == "NAN")
    resolved = (
        F.when(missing, UNKNOWN)
        .when(F.array_contains("spellings", name), name)
        .otherwise(F.coalesce("target", name))
    )
    joined = df.withColumn("name_lc", F.lower(name)).join(lookup, "name_lc", "left")
    return joined.withColumn("system", resolved).drop("name_lc", "target", "spellings")


def aliases_of(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """``(canonical, alias, ord)`` of the canonical names in the one-column frame."""
    return aliases.where("alias is not null").join(names.toDF("canonical"), "canonical").select("canonical", "alias", "ord")


def system_aliases(aliases: DataFrame, canonical: str) -> DataFrame:
    """Aliases of one canonical name, in table order."""
    hit = (F.col("canonical") == canonical) & F.col("alias").isNotNull()
    return aliases.where(hit).orderBy("ord").select("alias")
