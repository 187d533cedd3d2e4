"""Session and plan helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a row group of intermediate tables: a task reads whole ones.
ROW_GROUP = 8 << 20
#: Bytes of input for each partition of a shuffle, and the most partitions that are asked for on that account.
PARTITION_BYTES, MOST_PARTITIONS = 32 << 20, 100_000
#: Parts that rows of one key are spread over where a join has to shuffle.
SPREAD = 16
#: How the shared folder of an application begins.
_OWN = "tideline-"


def local_session(cores: int = 8, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tideline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tideline_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tideline-")) / "tideline_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._tideline_shipped = True


def input_bytes(*dfs: DataFrame) -> int:
    """Bytes of the files and local rows that DataFrames read, as far as Spark knows them without a job."""
    total = 0
    for df in dfs:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        # Of what is not known Spark says that it is very large.
        total += sum(x for x in sizes if x < 1 << 60)
    return total


def shuffle_partitions(spark: SparkSession, *reads: DataFrame) -> int:
    """Partitions of a shuffle: as many as the session says, and more where PARTITION_BYTES of what is read for each would not do."""
    asked = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, asked, min(MOST_PARTITIONS, -(-input_bytes(*reads) // PARTITION_BYTES)))


def _shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or one of this machine if Spark runs on it alone."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_tideline_shared", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors can reach")
        # That setting cannot be changed in a running session, so it is kept here.
        base = sc._tideline_shared = "file://" + tempfile.mkdtemp(prefix="tideline-")
    return base.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors can reach, below spark.checkpoint.dir.

    Only where that setting is absent and Spark runs on this machine alone
    (tests) is a temporary folder of it used. On a cluster without the setting
    executors would write to their own disks: ValueError.
    """
    return f"{_shared(spark)}/{_OWN}{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def sweep(spark: SparkSession, older: float = 7 * 86400.0) -> list[str]:
    """Delete the shared folders of other applications that have not added to them for so many seconds; their names."""
    from tideline.plans.commits import Folder, vacuum

    folder = Folder(spark, _shared(spark))
    return vacuum(folder, lambda name: not name.startswith(_OWN) or name == f"{_OWN}{spark.sparkContext.applicationId}", older)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there.

    The files outlive executors, unlike a cache, and are columnar, so later
    passes read only the columns they use. Their row groups are small enough
    for a pass to have as many tasks as its size asks for.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work in Python that a small file would leave to one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def bounded_join(left: DataFrame, right: DataFrame, on: Column, how: str, rows: int, spread: Column | None = None) -> DataFrame:
    """Join with right broadcast when it is proven to have at most `rows` rows.

    Beyond that both sides are shuffled and merged. spread: a column of left by
    which the rows of a key are spread over SPREAD parts, each of which meets a
    copy of right, so that a key with a third of all rows is no hot spot.
    """
    if fits(right, rows):
        return left.join(F.broadcast(right), on, how)
    if spread is None:
        return left.hint("merge").join(right, on, how)
    own, other = unused([*left.columns, *right.columns], "__part", "__copy")
    parts = left.withColumn(own, F.pmod(F.xxhash64(spread), F.lit(SPREAD)).cast("int"))
    copies = right.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return parts.hint("merge").join(copies, on & (F.col(own) == F.col(other)), how).drop(own, other)


def unused(taken: list[str], *names: str) -> list[str]:
    """Column names for internal use that are not taken."""
    have, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that df does not have."""
    return unused(df.columns, *names)
