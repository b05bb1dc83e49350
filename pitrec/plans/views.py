"""The SQL front door: the model's frames as temporary views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pitrec.sources import adapters

VIEWS = {
    "interactions": adapters.interactions,
    "interactions_clean": adapters.clean,
    "interactions_events": adapters.interactions_ev,
    "catalog": adapters.catalog,
    "item_embeddings": adapters.item_embeddings,
}


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Creates the views for ad-hoc SQL; their plans are read only when asked for."""
    for name, make in VIEWS.items():
        make(spark, sf_dir).createOrReplaceTempView(name)
    return list(VIEWS)
