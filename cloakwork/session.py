"""Session builders. The library itself takes any session; these are for tests, benches and scripts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder; on a cluster without it this raises.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="cloakwork-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back.

    A lost executor then costs a reread, not a recomputation, and later plans see the true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cloakwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The intermediate tables of one computation, in a folder of their own that is emptied as they are used up."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths, self.n = spark, f"{shared_dir(spark)}/cloakwork/{name}-{uuid.uuid4().hex}", {}, 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As ``written``; a later table of the same name leaves the earlier one in place until ``drop``."""
        self.n += 1
        path = f"{self.folder}/{self.n}-{name}"
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes all tables of these names; without names, the whole folder."""
        for path in [p for n in names for p in self.paths.pop(n, [])] if names else [self.folder]:
            remove(self.spark, path)

    def keep(self, *names: str) -> None:
        """Deletes all tables but those of these names."""
        self.drop(*[n for n in self.paths if n not in names] or ["-"])


def spread(df: DataFrame) -> DataFrame:
    """df over about as many partitions as there are cores, or more.

    A table of many partitions comes back as it is; so does one of at least half as many files as cores. One of few files is
    dealt out evenly: its partitions may be pieces of one row group, of which all but one are empty, and then few cores
    do all of the work on its rows. Partitions are that small only where a core's share is less than a full one, so what is dealt out is bounded by that.
    """
    cores, partitions = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if partitions > 2 * cores:
        return df
    return df if 2 * (len(df.inputFiles()) or partitions) >= cores and 2 * partitions >= cores else df.repartition(cores)


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "8g", app: str = "cloakwork") -> SparkSession:
    """A local session with adaptive execution, UTC timestamps and as many shuffle partitions as cores."""
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
