"""Strict readers of reports, predictions, metrics, notebooks and detections, and create-only sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from attestra.functions import names as N


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as text; a blank or repeated header, or a ragged row, is an error."""
    header = spark.read.csv(path, sep=separator, header=False).first()
    names = [] if header is None else [(x or "").lstrip("﻿").strip() for x in header]
    if not names or "" in names or len(set(names)) != len(names):
        raise ValueError(f"{path}: the header is missing, blank in places or repeats a name")
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.csv(path, sep=separator, header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def read_predictions(spark: SparkSession, path: str, scores: bool = False) -> DataFrame:
    """(y_true, y_pred[, y_score]); other columns are left out."""
    df = read_csv(spark, path)
    wanted = ["y_true", "y_pred", *(["y_score"] if scores else [])]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {missing}")
    return df.select(*[F.col(c).cast("double").alias(c) if c == "y_score" else F.col(c) for c in wanted])


def read_metrics_csv(spark: SparkSession, path: str, selector: tuple[str, str] | None = None) -> DataFrame:
    """(name, value) from a long table (metric, value), or from the one row of a wide one that the selector (column, value) picks."""
    df = read_csv(spark, path)
    if set(df.columns) >= {"metric", "value"}:
        return df.select(F.col("metric").alias("name"), "value")
    keys = [selector[0]] if selector else []
    rows = df.filter(F.col(selector[0]) == selector[1]) if selector else df
    if len(rows.take(2)) != 1:
        raise ValueError(f"{path}: the selector must pick one row")
    return rows.unpivot([], [c for c in df.columns if c not in keys], "name", "value")


def flatten_metrics(payload: object, path: tuple = ()) -> list[tuple[str, str]]:
    """(scoped name, number as text) of the numeric leaves of JSON below a metric's name, depth first."""
    if isinstance(payload, dict):
        return [x for k, v in payload.items() for x in flatten_metrics(v, (*path, k))]
    if isinstance(payload, list):
        return [x for i, v in enumerate(payload) for x in flatten_metrics(v, (*path, i))]
    name = N.scoped(list(path))
    number = isinstance(payload, (int, float)) and not isinstance(payload, bool)
    return [(name, repr(payload) if number else payload)] if name and (number or isinstance(payload, str)) else []


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, value) of every metrics file under the path."""

    @F.udf(ArrayType(StructType([StructField("name", StringType()), StructField("value", StringType())])))
    def items(text):
        return flatten_metrics(json.loads(text))

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.explode(items("value")).alias("x")).select("path", "x.name", "x.value")


def select_json(column: Column, selector: str) -> Column:
    """The value at a dotted path, integers as list positions; a miss is an error of the job."""
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in selector.split("."))
    found = F.get_json_object(column, path)
    return F.when(found.isNull(), F.raise_error(F.lit(f"nothing at {selector}"))).otherwise(found)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of plain-text and Markdown files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


_CELLS = "struct<cells:array<struct<cell_type:string,source:variant,outputs:array<struct<text:variant>>>>>"


def notebook_text(column: Column) -> Column:
    """Markdown cells and printed outputs of a notebook's JSON, line by line, blank ones left out."""
    text = lambda v: F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), ""), F.try_variant_get(v, "$", "string"))
    cells = F.from_json(column, _CELLS)["cells"]
    lines = F.transform(cells, lambda c: F.concat(F.array(F.when(c["cell_type"] == "markdown", text(c["source"]))), F.coalesce(F.transform(c["outputs"], lambda o: text(o["text"])), F.array().cast("array<string>"))))
    return F.array_join(F.filter(F.flatten(lines), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n")


_BOX = [StructField("class_id", StringType()), StructField("bbox", ArrayType(DoubleType()))]
_DETECTIONS = StructType([StructField("images", ArrayType(StructType([StructField("id", StringType()), StructField("ground_truth", ArrayType(StructType(_BOX))), StructField("predictions", ArrayType(StructType([*_BOX, StructField("confidence", DoubleType())])))])))])


def read_detections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(truth, predictions) for operators.detection; boxes without a positive size, or confidences outside [0, 1], are errors of the job."""
    images = spark.read.json(path, schema=_DETECTIONS, multiLine=True).select(F.explode("images").alias("i")).select(F.trim("i.id").alias("image"), "i.ground_truth", "i.predictions")

    def boxes(column: str, confidence: bool) -> DataFrame:
        rows = images.select("image", F.posexplode(column).alias("box_id", "b"))
        x = [F.get(F.col("b.bbox"), F.lit(i)) for i in range(4)]
        fine = (F.size("b.bbox") == 4) & (x[2] > x[0]) & (x[3] > x[1])
        if confidence:
            fine = fine & F.col("b.confidence").between(0.0, 1.0)
        first = F.when(F.coalesce(fine, F.lit(False)), x[0]).otherwise(F.raise_error(F.lit("a box is malformed")).cast("double"))
        return rows.select("image", F.col("b.class_id").alias("class_id"), F.col("box_id").cast(IntegerType()).alias("box_id"), *([F.col("b.confidence").alias("confidence")] if confidence else []), first.alias("x1"), x[1].alias("y1"), x[2].alias("x2"), x[3].alias("y2"))

    return boxes("ground_truth", False), boxes("predictions", True)


def write_once(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write a result that must not exist yet; the write is atomic by the commit protocol."""
    df.write.mode("errorifexists").format(kind).save(path)


def scorecard(result: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A flat projection of nested results, dots as underscores."""
    return result.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields])
