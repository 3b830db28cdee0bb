"""A Spark data source for the members of zip archives."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Members(InputPartition):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names


class ZipReader(DataSourceReader):
    """A partition is a run of members; archives must lie where executors can open them."""

    def __init__(self, options: dict):
        self.path, self.prefix = options["path"], options.get("prefix", "")
        self.per_task = int(options.get("members_per_task", 1000))

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as z:
            names = sorted(n for n in z.namelist() if n.startswith(self.prefix) and not n.endswith("/"))
        return [_Members(self.path, names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)]

    def read(self, partition: _Members) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.path) as z:
            for name in partition.names:
                yield name, z.read(name)


class ZipSource(DataSource):
    """``spark.read.format("zip_members").option("path", …)``: ``name, content``.

    Register with ``spark.dataSource.register(ZipSource)``.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)
