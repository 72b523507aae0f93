"""Writers of results: CSV and parquet sets, JSON bundles and Markdown reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(tables: dict[str, DataFrame], folder: str, prefix: str = "") -> list[str]:
    """One CSV folder a table."""
    paths = []
    for name, df in tables.items():
        df.write.mode("overwrite").csv(path := f"{folder}/{prefix}{name}.csv", header=True)
        paths.append(path)
    return paths


def write_parquet(tables: dict[str, DataFrame], folder: str, params: dict | None = None) -> None:
    """A bundle: one parquet folder a table, and the parameters as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(params or {}, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/params.json")


def _figures(df: DataFrame) -> list:
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("checksum")]


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of a bundle, or nothing where there is none."""
    try:
        lines = spark.read.text(f"{folder}/{_MANIFEST}").collect()  # one line
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return json.loads(lines[0][0]) if lines else None


_MANIFEST = "manifest.json"


def write_bundle(tables: dict[str, DataFrame], folder: str, metadata: dict | None = None) -> dict:
    """A folder of parquet tables and a manifest of their columns, rows and checksums, with the metadata; gives the manifest.

    Rows and checksums are those of the table as it stands in the folder.  The manifest appears last, so a folder without one is no whole bundle;
    a folder that has one is not written again.
    """
    if not tables:
        raise ValueError("a bundle needs a table")
    spark, entries = next(iter(tables.values())).sparkSession, {}
    if _manifest(spark, folder) is not None:
        raise ValueError(f"{folder} holds a bundle")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        seen = spark.read.schema(df.schema).parquet(f"{folder}/{name}").agg(*_figures(df)).first()  # an Observation would leave sessions unable to run models
        entries[name] = {"columns": {f.name: f.dataType.simpleString() for f in df.schema}, "rows": seen.rows, "checksum": str(seen.checksum or 0)}
    manifest = {"tables": entries, "metadata": metadata or {}}
    spark.createDataFrame([(json.dumps(manifest, default=str),)], "value string").coalesce(1).write.text(f"{folder}/{_MANIFEST}")
    return manifest


def read_bundle(spark: SparkSession, folder: str, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """The tables and metadata of a bundle; raises where the manifest is missing or a table is not as it says."""
    manifest = _manifest(spark, folder)
    if manifest is None:
        raise ValueError(f"{folder} is no whole bundle: it has no manifest")
    tables = {}
    for name, entry in manifest["tables"].items():
        df = spark.read.parquet(f"{folder}/{name}").select(*[f"`{c}`" for c in entry["columns"]])
        if verify:
            found = df.agg(*_figures(df)).first()
            if found.rows != entry["rows"] or str(found.checksum or 0) != entry["checksum"]:
                raise ValueError(f"table {name} of {folder} is not as its manifest says")
        tables[name] = df
    return tables, manifest["metadata"]


def write_json(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}.json")


def stars(p: str = "p_value"):
    """Conventional significance marks."""
    x = F.col(p)
    return F.when(x < 0.01, "***").when(x < 0.05, "**").when(x < 0.1, "*").otherwise("")


def summary_table(effects: DataFrame, digits: int = 3) -> DataFrame:
    """Effects rounded, with marks and the interval as text."""
    number = lambda c: F.format_string(f"%.{digits}f", F.round(c, digits))
    return effects.select("outcome", F.round("treatment_effect", digits).alias("effect"), F.round("std_error", digits).alias("std_error"), F.round("p_value", digits).alias("p_value"), stars().alias("stars"), F.concat(F.lit("["), number("conf_lower"), F.lit(", "), number("conf_upper"), F.lit("]")).alias("interval"))


def rounded_table(table: DataFrame, digits: int = 3, labels: dict[str, str] | None = None, names: str = "variable") -> DataFrame:
    """A balance, robustness or descriptive table for print: numbers with so many digits, and labels for the values of its naming column."""
    doubles = {f.name for f in table.schema if f.dataType.simpleString() in ("double", "float")}
    out = table.select(*[F.round(f"`{c}`", digits).alias(c) if c in doubles else F.col(f"`{c}`") for c in table.columns])
    if labels and names in table.columns:
        named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        out = out.withColumn(names, F.coalesce(F.try_element_at(named, F.col(names)), F.col(names)))
    return out


_INTROS = {
    "academic": "Estimates with standard errors and intervals.",
    "policy": "What changed, for whom, and by how much.",
    "technical": "Estimates, diagnostics and settings.",
    "executive": "The main results.",
}


def report(tables: dict[str, DataFrame], path: str, title: str, style: str = "technical", rows: int = 50) -> str:
    """A Markdown report on the driver with the first rows of each small result table."""
    lines = [f"# {title}", "", _INTROS[style], ""]
    for name, df in tables.items():
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect()] + [""]
    text = "\n".join(lines)
    Path(path).write_text(text)
    return text
