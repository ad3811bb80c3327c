"""Ingest flow: raw lines -> processed fact, views, summary, validation, files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallycast.config import EngineConfig
from tallycast.operators import cleaning, quality, rollups
from tallycast.sources import sinks

VIEW_DIMENSIONS = ("country", "system", "factory", "cell")


@dataclass(frozen=True)
class Processed:
    """Lazy results of one ingest run."""

    data: DataFrame
    views: dict[str, DataFrame]
    summary: DataFrame
    validation: DataFrame


def process(
    raw: DataFrame,
    flags: DataFrame,
    aliases: DataFrame | None = None,
    cfg: EngineConfig = EngineConfig(),
    described: DataFrame | None = None,
) -> DataFrame:
    """Processed fact: cleaned, splits merged, described, classified, dated, with derived metrics.

    Everything that depends on the merge keys is added after the merge, to fewer rows. Description
    and category of the items are put into one table first, so the fact meets items in one join. One shuffle, by item and
    deal, serves the merge and this join. ``described``: the same raw lines with fewer columns (item, date,
    description), where reading these is cheaper.
    """
    merged = cleaning.merge_splits(cleaning.dealt_lines(cleaning.clean_lines(raw, cfg, aliases)))
    texts = cleaning.clean_lines(raw if described is None else described, cfg, columns=["sku", "description"])
    items = cleaning.classify_items(cleaning.item_descriptions(texts), flags)
    fact = merged.join(cleaning.dealt_items(items), ["sku", "deal"], "left").drop("deal")
    return cleaning.derived_metrics(cleaning.with_calendar(fact))


def views_of(data: DataFrame) -> dict[str, DataFrame]:
    """The five dimensional views."""
    views = {"monthly_sku": rollups.monthly_sku_view(data)}
    return views | {dim: rollups.dimension_view(data, dim) for dim in VIEW_DIMENSIONS}


def run(
    raw: DataFrame, flags: DataFrame, aliases: DataFrame | None = None, cfg: EngineConfig = EngineConfig()
) -> Processed:
    """All results of an ingest, as lazy frames."""
    data = process(raw, flags, aliases, cfg)
    checks = quality.validation(raw, flags, cfg)
    return Processed(data, views_of(data), rollups.summary(data), checks)


def save(raw: DataFrame, result: Processed, folder: str, mode: str = "errorifexists") -> dict[str, str]:
    """Write the fact once and derive views and summary from the written table.

    Reading the fact back cuts the lineage: losing an executor while a view is written
    does not repeat the ingest.
    """
    spark = raw.sparkSession
    paths = {k: f"{folder}/{k}" for k in ("processed_data", "summary", "validation", "fingerprint")}
    sinks.write_processed(result.data, paths["processed_data"], mode)
    data = spark.read.parquet(paths["processed_data"])
    views = views_of(data)
    sinks.write_views(views, folder, mode)
    sinks.write_json(rollups.summary(data), paths["summary"], mode)
    sinks.write_json(result.validation, paths["validation"], mode)
    sinks.write_json(quality.fingerprint(raw), paths["fingerprint"], mode)
    return paths | {f"view_{name}": f"{folder}/view_{name}" for name in views}
