"""What the corpus operators share: word rules, written intermediate tables, shared folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import shared_dir, ship_code

__all__ = ["drop_paths", "drop_written", "documents", "fresh", "shared_dir", "ship_code", "words", "written"]

#: Words are runs of anything but these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
#: Paths of the tables that this process has written and not dropped.
MADE: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage, survives executors.

    Shuffle files of the writing job are dropped with it where Spark offers that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foldcast/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._foldcast_path = path
    MADE.append(path)
    return out


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table that :func:`written` made and nothing reads any more."""
    path = getattr(df, "_foldcast_path", None)
    if path:
        drop_paths(df.sparkSession, [path])


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in [p for p in paths if p in MADE]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        MADE.remove(path)


def words(text: Column) -> Column:
    """Words of a text, in order; none for null or blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have (any case): longer by underscores."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
