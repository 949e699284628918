"""Names, plans and oracles of the registered queries.

An operator is a function of Tables that returns a lazy DataFrame; @query registers it
under a name, with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.tables import DOMAIN_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "jn01_director_contracts"

MODULES = ("operators.patterns", "operators.detectors", "operators.graph", "operators.network", "operators.neighbourhood", "operators.resolution", "operators.library", "operators.loaders", "operators.forensics", "operators.investigate", "operators.case_memory", "operators.evidence", "functions.text", "functions.scripts", "operators.search", "operators.stored_index", "sources.extract", "streaming.windows")


def query(name: str, oracle: str | None = None):
    """Registers f(tables) as a query; `oracle` continues the domain's common table expressions."""

    def register(f: Callable[[Tables], DataFrame]):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[name] = run
        if oracle:
            text = oracle.strip()
            ORACLES[name] = DOMAIN_SQL + (text if text.startswith(",") else text)
        return f

    return register


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"plumbline.{name}")
