"""A data source that opens the files of a manifest and no others.

A manifest is a table (path, ID, size): the listing of a folder, joined with
whatever says which files are wanted. Small files are packed into partitions by
their sizes, and each line comes with the id and the path of its file. The
files have to be in a store that pyarrow opens (a mount, HDFS, S3).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from firnline.session import scratch_path

#: Bytes of files that a partition reads, and bytes of a file that are held at a time.
PARTITION_BYTES, CHUNK = 32 << 20, 1 << 20
#: What opening a file counts for in bytes.
OPEN_BYTES = 1 << 16
LINES = "ID string, path string, value string"
_LINES = pa.schema([("ID", pa.string()), ("path", pa.string()), ("value", pa.string())])


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is one of this machine's mounts."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


@dataclass
class FileGroup(InputPartition):
    files: list[tuple[str, str]]


def packed(files: list[tuple[str, str, int]], most: int) -> list[FileGroup]:
    """Groups of files (path, ID, size) of about ``most`` bytes, in path order; at least one group."""
    groups, size = [FileGroup([])], 0
    for path, name, n in sorted(files):
        if size and size + n + OPEN_BYTES > most:
            groups.append(FileGroup([]))
            size = 0
        groups[-1].files.append((path, name))
        size += n + OPEN_BYTES
    return groups


def lines_of(path: str) -> Iterator[list[str]]:
    """The lines of a file, some at a time; none if it is gone."""
    files, name = open_store(path)
    try:
        source = files.open_input_stream(name)
    except FileNotFoundError:
        return
    with source:
        rest = b""
        while chunk := source.read(CHUNK):
            *whole, rest = (rest + chunk).split(b"\n")
            if whole:
                yield [line.rstrip(b"\r").decode("utf-8", "replace") for line in whole]
        if rest:
            yield [rest.rstrip(b"\r").decode("utf-8", "replace")]


class ManifestReader(DataSourceReader):
    def __init__(self, options):
        self.table, self.most = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[FileGroup]:
        files, root = open_store(self.table)
        table = ds.dataset(root, filesystem=files, format="parquet").to_table(columns=["path", "ID", "size"])
        return packed(list(zip(*(table.column(c).to_pylist() for c in ("path", "ID", "size")))), self.most)

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        for path, name in partition.files:
            for lines in lines_of(path):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array([path] * len(lines)), pa.array(lines, pa.string())], schema=_LINES)


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "manifest"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> ManifestReader:
        return ManifestReader(self.options)


def list_files(spark: SparkSession, source: str, pattern: str, glob: str = "*") -> DataFrame:
    """(path, ID, size) of the files of ``source`` whose path matches; ID is the first group of ``pattern``. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(source)
    return found.select("path", F.regexp_extract("path", pattern, 1).alias("ID"), F.col("length").alias("size")).where(F.col("path").rlike(pattern))


def read_files(files: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(ID, path, value): the lines of the files of a manifest ``files(path, ID, size)``, which is written to the shared folder first."""
    spark = files.sparkSession
    table = scratch_path(spark, "manifest")
    files.select("path", F.col("ID").cast("string").alias("ID"), F.col("size").cast("long").alias("size")).write.parquet(table)
    spark.dataSource.register(ManifestSource)
    return spark.read.format("manifest").option("partitionBytes", partition_bytes).load(table)
