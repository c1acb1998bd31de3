"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronotext.plans import aligned, annotating, auditing, folding, hearing, placing, scans, sheetwork, tagged, texts, timed

FLAGSHIP = "passage_containment"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return texts.QUERIES | timed.QUERIES | aligned.QUERIES | placing.QUERIES | sheetwork.QUERIES | scans.QUERIES | tagged.QUERIES | folding.QUERIES | auditing.QUERIES | annotating.QUERIES | hearing.QUERIES


def oracle_sql() -> dict[str, str]:
    return texts.SQL | timed.SQL | aligned.SQL | placing.SQL | sheetwork.SQL | scans.SQL | tagged.SQL | folding.SQL | auditing.SQL | annotating.SQL | hearing.SQL
