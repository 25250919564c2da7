"""Helpers that several operators share: words, keys of rows, written tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from batchloom.session import materialized

# A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words in a text as a long; null counts as empty."""
    # Every word but one at the very end is followed by a gap.
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def row_key(*columns: str) -> Column:
    """A 128-bit key made of the named columns; nulls differ from empty texts.

    Rows that are equal in all of them share a key, so results that depend on
    these columns alone can be joined back even if ids repeat or are null.
    """
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns]
    lengths = [F.length(p).cast("string") for p in parts]
    return F.unhex(F.md5(F.concat_ws(":", *lengths, *parts).cast("binary")))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder; later steps all see these rows."""
    return materialized(df, name)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application.

    Tasks can then import it wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="code-"), f"{os.path.basename(package)}-{app}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def map_batches(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)
