"""Named queries over the driver's tables, each with a checking SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from flowsieve.session import prepare

_MODULES = (
    "source_queries",
    "quality_queries",
    "routing_queries",
    "window_queries",
    "refine_queries",
    "feature_queries",
    "leakage_queries",
    "sampling_queries",
    "report_queries",
    "selection_queries",
    "training_queries",
    "evaluation_queries",
    "history_queries",
    "stream_queries",
)


@dataclass(frozen=True)
class Query:
    """``run(spark, sf_dir)`` builds the frame; ``sql`` is its equivalent, if expressible."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def load_catalogue() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in _MODULES:
        for query in import_module(f"{__name__}.{module}").QUERIES:
            if query.name in out:
                raise ValueError(f"duplicate query name {query.name}")
            out[query.name] = query
    return out


def runnable(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query.run(prepare(spark), sf_dir)

    run.__name__ = query.name
    return run
