"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limber.session import delete_path, own_folder

#: White space between words, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"


#: Where this process has written tables, in order.
_paths: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it as read back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    Files stay under one folder per application; see :func:`clear_written`.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """A mark for :func:`settled`."""
    return len(_paths)


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """:func:`written`, after which all tables written since the mark are deleted: nothing reads them any more."""
    out = written(df, name)
    for path in _paths[since:-1]:
        delete_path(df.sparkSession, path)
    del _paths[since:-1]
    return out


def clear_written(spark: SparkSession) -> None:
    """Delete what :func:`written` left for this application."""
    delete_path(spark, own_folder(spark))
    _paths.clear()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet; Spark's names do not heed case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str) -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters that are not white space, in order."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
