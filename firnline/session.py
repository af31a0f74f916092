"""Where intermediate tables go, and how long lineages are cut."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would vanish with its executor.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="firnline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def unfit_to_send(table: DataFrame) -> DataFrame:
    """``table``, which is read from files, marked as not to be broadcast if its rows are too large for that.

    Spark takes the bytes of files for the size, and few bytes can hold many
    rows: dictionaries and runs shrink repetitive columns a hundred times.
    Rows are counted (in the footers) only where files are small enough to be
    broadcast and not so small that their rows are small as well.
    """
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    plan = table._jdf.queryExecution().optimizedPlan()
    seen = int(plan.stats().sizeInBytes())
    if not limit / 500 < seen <= limit:
        return table
    width = 8 + sum(a.dataType().defaultSize() for a in (plan.output().apply(i) for i in range(plan.output().size())))
    return table.hint("merge") if table.count() * width > limit else table


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan behind it is gone, it survives the loss of executors, and Spark
    does not estimate its size. (A checkpoint would keep the size Spark had
    estimated, and estimates of repeated joins multiply.)
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return unfit_to_send(df.sparkSession.read.schema(df.schema).parquet(path))


class Scratch:
    """Intermediate tables in the shared folder, each deleted when it is given up, all of them at the end of the block.

    What is to outlive the block has to be written by ``cut_lineage``.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._held: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        """As ``cut_lineage``."""
        path = scratch_path(self._spark, "cut")
        df.write.parquet(path)
        back = unfit_to_send(self._spark.read.schema(df.schema).parquet(path))
        self._held[id(back)] = back, path
        return back

    def free(self, *tables: DataFrame) -> None:
        """Delete tables that everything built on them has been written of; others than those of ``cut`` are left."""
        for table in tables:
            if id(table) in self._held:
                path = self._spark._jvm.org.apache.hadoop.fs.Path(self._held.pop(id(table))[1])
                path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.free(*[table for table, _ in self._held.values()])


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let batches that go to Python hold this many bytes and a row at most, from now on in this session.

    By themselves they hold 10,000 rows, which is 30 MB of usual documents and
    many times that of long ones, in the JVM and in Python, for each task.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ship_package(spark: SparkSession) -> None:
    """Give the executors of a cluster this package, once in a session; their Python may not have it installed."""
    sc = spark.sparkContext
    if (sc.master.startswith("local") and not sc.master.startswith("local-cluster")) or getattr(sc, "_firnline_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="firnline-"), "firnline"), "zip", os.path.dirname(home),
                                  os.path.basename(home))
    sc.addPyFile(archive)
    sc._firnline_shipped = True
