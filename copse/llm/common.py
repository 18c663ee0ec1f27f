"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.sources.shared import temporary

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z only.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing.

    The table is deleted by discard(), or else when the application ends.
    """
    path = temporary(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._copse_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of materialise() that nothing reads any more."""
    path = getattr(df, "_copse_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


#: Most keys that without() broadcasts.
FEW = 1 << 20


def without(docs: DataFrame, key: Column, losers: DataFrame) -> DataFrame:
    """docs whose key is not in the only column of the stored table losers; null equals null.

    Up to FEW keys are broadcast, so no document travels; more meet the documents in a shuffle.
    """
    few = losers.count() <= FEW
    return docs.join(F.broadcast(losers) if few else losers, key.eqNullSafe(F.col(losers.columns[0])), "left_anti")


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, with underscores added until no column has that name, in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


_shipped: dict[str, bool] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application; their Python then imports it by name and keeps its caches."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="copse-ship-"))
    path = folder / "copse_ship.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped[app] = True
