"""Sources and sinks."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegauge.schema import nan_to_null


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: dict | None = None,
               fmt: str | None = None, nrows: int | None = None, order_col: str | None = None) -> DataFrame:
    """A1: a probe / result / seed table from Parquet or CSV (explicit schema, quoted multi-line
    fields), NaN -> null; ``columns`` maps source names to our names (projection is pushed to
    the scan); ``nrows`` keeps the first rows by ``order_col``."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        df = (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)
    else:
        df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    if columns:
        df = df.select(*[F.col(k).alias(v) for k, v in columns.items()])
    df = nan_to_null(df)
    if nrows is not None:
        df = df.orderBy(order_col).limit(nrows)
    return df


def describe_dataset(name: str, version: str | None = None, split: str | None = None) -> str:
    """A2: provenance label ``Dataset: name[/version][/split]``."""
    label = f"Dataset: {name}"
    if version:
        label += f"/{version}"
    if split:
        label += f"/{split}"
    return label


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, asked of the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end (the writer leaves ``_SUCCESS`` last)."""
    return exists(spark, os.path.join(path, "_SUCCESS"))


def write_dataset(df: DataFrame, base: str, name: str, version: str, split: str) -> None:
    """A2: one version and split of a dataset, a folder ``version=.../split=...`` of its table; others are left alone."""
    df.write.mode("overwrite").parquet(os.path.join(base, f"{name}.parquet", f"version={version}", f"split={split}"))


def read_dataset(spark: SparkSession, base: str, name: str, version: str | None = None, split: str | None = None) -> DataFrame | None:
    """A2: a dataset by name, and by version and split where they are asked for; None if there is no such one.

    Version and split are partition columns, kept as text (``1.10`` is not ``1.1``): the filter prunes
    folders before anything is read.  A table without such folders has no versions."""
    path = os.path.join(base, f"{name}.parquet")
    if not exists(spark, path):
        return None
    df = spark.read.parquet(path)
    wanted = {c: v for c, v in (("version", version), ("split", split)) if v is not None}
    if not wanted:
        return df
    if not set(wanted) <= set(df.columns):
        return None
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("version", "split") else f for f in df.schema.fields])
    df = spark.read.schema(schema).parquet(path)
    for c, v in wanted.items():
        df = df.filter(F.col(c) == v)
    return None if df.isEmpty() else df


def collect_datasets(spark: SparkSession, base: str, configs: list[dict], reload: list[str] | None = None,
                     checkpoint_dir: str | None = None) -> DataFrame:
    """A3: process every configured dataset and union them by name with a ``source`` label.

    With ``checkpoint_dir`` each processed dataset is written once as Parquet and reused unless
    its name is in ``reload`` (the per-dataset phase checkpoint of the original); a dataset
    whose table, version or split does not exist is skipped; any other failure is raised, and so is finding none."""
    from tonegauge.operators.seed import process_dataset
    parts = []
    for cfg in configs:
        name = cfg["name"]
        label = describe_dataset(name, cfg.get("version"), cfg.get("split"))
        kept = "_".join(x for x in (name, cfg.get("version"), cfg.get("split")) if x).replace("/", "_")
        target = os.path.join(checkpoint_dir, f"_intermediate_{kept}") if checkpoint_dir else None
        done = target and name not in (reload or []) and written(spark, target)
        table = None if done else read_dataset(spark, base, name, cfg.get("version"), cfg.get("split"))
        if not done and table is None:
            print(f"skipping dataset {name}: there is no {label} under {base}")
            continue

        def compute(table=table, cfg=cfg, label=label):
            part = process_dataset(table, cfg["feature_col"], cfg.get("filters"), **cfg.get("kwargs", {}))
            return part.withColumn("source", F.lit(label))

        part = phase(spark, target, compute, redo=not done) if target else compute()
        parts.append(part.select("text", "source"))
    if not parts:
        raise ValueError(f"none of the configured datasets exists under {base}")
    return reduce(DataFrame.unionByName, parts)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A4: table sink (parent folders are created by the writer)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.parquet(path)


def write_summary(summary_doc: DataFrame, path: str) -> None:
    """A5: the one-row summary document as JSON."""
    summary_doc.coalesce(1).write.mode("overwrite").json(path)


def read_llm_cache(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated cache (fingerprint, JSON payload) -> response text."""
    raw = spark.read.option("sep", "\t").option("header", False).option("quote", "").csv(path)
    return raw.select(F.col("_c0").alias("fingerprint"),
                      F.get_json_object(F.col("_c1"), "$.choices[0].message.content").alias("response"))


def read_instruction_db(spark: SparkSession, path: str) -> DataFrame:
    """Instruction database (``delta_<g>`` columns + ``edit_instruction`` array) from Parquet."""
    return spark.read.parquet(path)


def result_catalogue(spark: SparkSession, paths: list[str]) -> DataFrame:
    """List result tables (file name) and the goals each one carries (``delta_`` columns)."""
    rows = []
    for p in paths:
        cols = spark.read.parquet(p).columns
        rows.append((os.path.basename(p.rstrip("/")), [c[len("delta_"):] for c in cols if c.startswith("delta_")]))
    return spark.createDataFrame(rows, "table STRING, goals ARRAY<STRING>")


def phase(spark: SparkSession, path: str, compute, redo: bool = False) -> DataFrame:
    """A10: reuse a phase's output when it was written whole, else compute and write it (resume)."""
    if not redo and written(spark, path):
        return spark.read.parquet(path)
    df = compute()
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
