"""JSON of color-balancing models and of field mappings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_model(model: dict, path: str) -> None:
    """A model as JSON: its plain values as one line, its gains and cells as lines of tables."""
    tables = {k: v for k, v in model.items() if isinstance(v, DataFrame)}
    plain = json.dumps({k: v for k, v in model.items() if k not in tables})
    for name, table in tables.items():
        table.write.json(f"{path}/{name}")
    table.sparkSession.createDataFrame([(plain,)], "value string").write.text(f"{path}/model")


def read_model(spark: SparkSession, path: str, methods: tuple[str, ...] = ("GlobalToLocal",)) -> dict:
    model = json.loads(spark.read.text(f"{path}/model").first()[0])
    if model.get("method") not in methods:
        raise ValueError(f"unknown method {model.get('method')}")
    bands = list(model["max_mean"])
    gains = "raster_id int, " + ", ".join(f"{k}_{b} double" for b in bands for k in "ao")
    cells = "raster_id int, gr long, gc long, " + ", ".join(f"{k}_{b} array<double>" for b in bands for k in "rg")
    return model | {"gains": spark.read.schema(gains).json(f"{path}/gains"), "cells": spark.read.schema(cells).json(f"{path}/cells")}


def renamed(df: DataFrame, mapping: str) -> DataFrame:
    """Columns chosen and renamed by JSON pairs [[source, target], ...]."""
    pairs = json.loads(mapping)
    missing = [s for s, _ in pairs if s not in df.columns]
    if missing:
        raise ValueError(f"no such fields: {missing}")
    return df.select(*[F.col(s).alias(t) for s, t in pairs])
