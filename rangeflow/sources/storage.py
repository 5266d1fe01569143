"""Tables at rest, and units of a copy that count only once they are committed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; a temporary one only for a local master without the setting."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="rangeflow-work-")
    return f"{at}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows read back from a table in the shared folder, for what is used several times; names are any."""
    at = work_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _at(spark: SparkSession, path: str) -> tuple:
    """A path and the store that it is in, whatever Spark reads it from."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under a path; none if it is not there."""
    at, store = _at(spark, path)
    return [f.getPath().getName() for f in store.listStatus(at) if f.isDirectory()] if store.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, store = _at(spark, path)
    store.delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Puts a folder in the place of another."""
    (a, store), (b, _) = _at(spark, source), _at(spark, target)
    store.delete(b, True)
    store.mkdirs(b.getParent())
    if not store.rename(a, b):
        raise OSError(f"{source} could not be moved to {target}")


def table_stream(spark: SparkSession, folder: str, name: str, files: int = 64) -> DataFrame:
    """A table of a folder as a stream of its files, whether it is one file or a folder of them."""
    at = f"{folder}/{name}.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    is_folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    stream = spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", files)
    return stream.parquet(at) if is_folder else stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


class ChangeLogMissing(ValueError):
    pass


def change_log(spark: SparkSession, path: str) -> DataFrame:
    """A table's change log; without one nothing is captured, so its absence is an error."""
    if not exists(spark, path):
        raise ChangeLogMissing(f"no change log at {path}")
    return spark.read.parquet(path)


def write_units(rows: DataFrame, path: str) -> dict[int, tuple[int, int | None]]:
    """Writes rows as a folder a unit under ``path`` and gives, from what was written, each unit's rows and last token.

    ``path`` is new for every attempt, so writing again replaces nothing.  The
    rows are dealt out by unit and a salt from the token: no task gets a whole
    large unit.
    """
    salt = F.pmod(F.xxhash64("_tok"), F.lit(8))
    rows.repartition("unit", salt).write.mode("errorifexists").partitionBy("unit").parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path)
    found = written.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.max("_tok").alias("last")).collect()  # one row a unit
    return {r.unit: (r.n, r.last) for r in found}


def read_units(spark: SparkSession, outputs: list[str], schema) -> DataFrame:
    """The rows of committed units; attempts that were not committed are never read."""
    if not outputs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*outputs)
