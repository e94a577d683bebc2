"""Queries by name, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.sources import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{WS}", WS)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[tuple[str, str, str], object] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[Callable[[str, DataFrame], DataFrame]], object]):
    """An index over the tables of a folder: built by the first query of a session that needs it, in the shared folder,
    and read by those after it. build gets a function that writes a table under a name and reads it back."""
    at = spark.sparkContext.applicationId, sf_dir, name
    if at not in _kept:
        _kept[at] = build(lambda part, df: scratch.save(df, f"{name}-{part}"))
    return _kept[at]


def strip(x: str) -> str:
    """SQL text for ``text.strip``."""
    return rf"regexp_replace(regexp_replace({x}, '\A{WS}+', ''), '{WS}+\z', '')"


def words(x: str) -> str:
    """SQL text for ``text.words``."""
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"
