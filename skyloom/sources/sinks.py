"""Writers: tables, and whole datasets as a folder of tables with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..labels import NUMBERS

VERSION = 1


def output_path(path: str, suffix: str) -> str:
    return path if path.endswith(suffix) else path + suffix


def to_parquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(output_path(path, ".parquet"))


def to_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").csv(output_path(path, ".csv"), header=True)


def save(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """Each table as parquet under ``path``, and a manifest with names and version."""
    mode = "overwrite" if overwrite else "errorifexists"
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps({"version": VERSION, "tables": sorted(tables)}),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/_manifest")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    manifest = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
    if manifest["version"] != VERSION:
        raise ArgumentError(f"written by version {manifest['version']}, this is {VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}


def stacked(obs: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Observations, their labels as numbers and model values in one long table (name, obstype, datetime, kind, value)."""
    number = F.element_at(F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv]), F.col("label")).cast("double")
    rows = F.explode(F.array(F.struct(F.lit("obs").alias("kind"), F.col("value").alias("value")), F.struct(F.lit("label").alias("kind"), number.alias("value"))))
    out = obs.select("name", "obstype", "datetime", rows.alias("x")).select("name", "obstype", "datetime", "x.*")
    return out if model is None else out.unionByName(model.select("name", "obstype", "datetime", F.lit("model").alias("kind"), "value"))


def stacked_attributes(spark: SparkSession, checks: dict[str, dict[str, dict]], fills: dict[str, dict[str, dict]] | None = None) -> DataFrame:
    """The settings that go with a stacked export: rows (obstype, kind, applied, setting, value) of checks and fills by kind of observation."""
    rows = []
    for kind, settings in (("QC", checks), ("GF", fills or {})):
        for obstype, applied in settings.items():
            for name, values in applied.items():
                rows += [(obstype, kind, name, k, str(v)) for k, v in values.items()] or [(obstype, kind, name, None, None)]
    return spark.createDataFrame(rows, "obstype string, kind string, applied string, setting string, value string")
