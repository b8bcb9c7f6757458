"""Every registered query of the survey engine, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seabright.plans import catalogue_views, image_views, layer_views, plan_views, source_views, survey_views  # noqa: F401 - the others register their queries with the last

FLAGSHIP = "band_summary"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**survey_views.QUERIES}
ORACLE_SQL: dict[str, str] = {**survey_views.ORACLE_SQL}
