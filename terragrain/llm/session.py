"""Session settings that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    A cluster names it in ``spark.checkpoint.dir``.  Where neither that nor a
    context's own folder is set, one is made for a local master, as in tests;
    on a cluster a folder of the driver's disk would not be shared, so that is
    an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return named or have.get()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = named or tempfile.mkdtemp(prefix="terragrain-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, as files in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Partitions of a shuffle, as the session has them, ``least`` or more."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shards_of(docs: DataFrame, text: str, bytes_each: int) -> int:
    """Shards for work that holds a slice of all of a text column's content: as many as its counted bytes need, or the session's partitions."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return partitions(docs.sparkSession, -(-int(total) // bytes_each))


def row_key(*columns: str):
    """A 64-bit key of a row's identity and content; null columns count too."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in columns])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    out = f"__{name}"
    while out.lower() in {c.lower() for c in df.columns}:
        out += "_"
    return out


def carried(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """``docs`` as c0, c1, .. for the ``keep`` columns and the text, and the DDL of the former: no name clashes."""
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col("text").alias("text"))
    return rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])


def restored(df: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns by their names again, and the columns after them."""
    return df.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], *df.columns[len(keep) :])
