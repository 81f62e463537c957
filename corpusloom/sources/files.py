"""Files as a Spark source: a folder is listed and read by the tasks, empty files included.

``spark.read.format("folder_files")`` has one partition per subfolder of the first level (and one for the files beside them), so a
tree of very many files is walked in parallel and no list of files passes through the driver but that of the first level.
Folders are paths or URIs that pyarrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTED = "path string, name string, size long, modified timestamp"
WITH_CONTENT = LISTED + ", content binary"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, options: dict, content: bool):
        self.root, self.glob = options["path"], options.get("glob", "*")
        self.recursive, self.content = options.get("recursive", "true").lower() == "true", content

    def partitions(self) -> list[InputPartition]:
        fs, base = opened(self.root)
        own: list[InputPartition] = [Folder(base, False)]
        if self.recursive:
            own += [Folder(f.path, True) for f in fs.get_file_info(pafs.FileSelector(base)) if f.type == pafs.FileType.Directory]
        return own

    def read(self, partition: Folder) -> Iterator[tuple]:
        fs, _ = opened(self.root)
        for f in fs.get_file_info(pafs.FileSelector(partition.path, recursive=partition.deep)):
            if f.type == pafs.FileType.File and fnmatch(f.base_name, self.glob):
                row = (f.path, f.base_name, f.size, f.mtime)
                if self.content:
                    with fs.open_input_stream(f.path) as stream:
                        row += (stream.read(),)
                yield row


class FolderFiles(DataSource):
    """Options: path, glob, recursive (true). The schema with ``content`` reads the files as well."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options, "content" in schema.fieldNames())


def _load(spark: SparkSession, path: str, glob: str, recursive: bool, schema: str) -> DataFrame:
    spark.dataSource.register(FolderFiles)
    return spark.read.format("folder_files").schema(schema).option("glob", glob).option("recursive", str(recursive).lower()).load(path)


def list_folder(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, size, modified) of all files, empty ones too; contents are not read."""
    return _load(spark, path, glob, recursive, LISTED)


def read_folder(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """The same with the content of every file."""
    return _load(spark, path, glob, recursive, WITH_CONTENT)
