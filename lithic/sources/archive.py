"""Python data source for source files in tar archives: an index pass on the driver, random access by executors."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Members(InputPartition):
    def __init__(self, members: list[tuple[str, int, int]]):
        self.members = members


def safe(name: str) -> bool:
    """No absolute member and none that climbs out of the archive."""
    return not name.startswith("/") and ".." not in name.split("/")


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".py")
        self.prefixes = tuple(p for p in options.get("prefixes", "").split(",") if p)
        self.size = int(options.get("members", "500"))

    def partitions(self) -> list[Members]:
        with tarfile.open(self.path) as tar:
            index = sorted((m.name, m.offset_data, m.size) for m in tar if m.isfile() and safe(m.name) and m.name.endswith(self.suffix) and (not self.prefixes or m.name.startswith(self.prefixes)))
        return [Members(index[i : i + self.size]) for i in range(0, len(index), self.size)] or [Members([])]

    def read(self, partition: Members) -> Iterator[tuple[str, str]]:
        if partition.members:
            with open(self.path, "rb") as f:
                for name, offset, size in partition.members:
                    f.seek(offset)
                    yield name, f.read(size).decode("utf-8", "replace")


class TarSource(DataSource):
    """spark.read.format("tar_sources").option("prefixes", "a/,b/").load(path): (path, code) of an uncompressed archive.

    The archive must be readable at the same path by driver and executors.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_sources"

    def schema(self) -> str:
        return "path string, code string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TarReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarSource)
