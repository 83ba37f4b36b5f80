"""A persisted table of unit vectors with their ids (B12), and its load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import as_double, finite, normalise
from ..scratch import path_exists


def store_name(model: str | None = None, layer: int | None = None) -> str:
    """Name of a store of the vectors that the filters leave."""
    return "-".join(["vectors", *([model.replace("/", "_")] if model else []), *([f"layer{layer}"] if layer is not None else [])])


def write_vectors(df: DataFrame, place: str, key: str, vec: str, model: str | None = None, layer: int | None = None, mode: str = "overwrite") -> str:
    """Write ``id, vec``: unit vectors in order of id, one row for each id, in files of one range of ids each, so that a
    look-up by id reads one. Rows of other models or layers, with a null id or with a value that isn't finite are left out. Returns
    the store's path; a store without vectors isn't written, and gives an empty path."""
    for column, value in (("model_name", model), ("layer_index", layer)):
        if value is not None:
            df = df.where(F.col(column) == value)
    v = as_double(vec)
    rows = df.where(F.col(key).isNotNull() & finite(v)).select(F.col(key).cast("bigint").alias("id"), normalise(v).cast("array<float>").alias("vec")).dropDuplicates(["id"])
    if rows.isEmpty():
        return ""
    path = f"{place.rstrip('/')}/{store_name(model, layer)}"
    rows.repartitionByRange("id").sortWithinPartitions("id").write.mode(mode).parquet(path)
    return path


def load_vectors(spark: SparkSession, place: str, model: str | None = None, layer: int | None = None) -> DataFrame:
    """``id, vec`` of a store; an error if there is none of that name."""
    path = f"{place.rstrip('/')}/{store_name(model, layer)}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(f"no vectors at {path}: write_vectors first")
    return spark.read.schema("id bigint, vec array<float>").parquet(path)
