"""Files as rows, listed by name: also empty ones, which Spark's own file sources leave out.

A Python data source: the driver lists names and sizes (as any file source does), in batches of a
bounded number of files and bytes; executors read each batch's files.
"""

from __future__ import annotations

import fnmatch
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES, BYTES, BATCH_BYTES = 256, 1 << 26, 1 << 23


def open_folder(path: str):
    """The file system of a path (plain, ``file:`` or of an object store) and the path in it."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = re.sub(r"^file:/*", "file:///", path)
    return fs.FileSystem.from_uri(path)


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class FilesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def _listed(self) -> list:
        from pyarrow import fs

        head = re.split(r"[*?\[]", self.path, maxsplit=1)[0]
        glob = head != self.path
        folder = head.rsplit("/", 1)[0] if glob else self.path
        files, at = open_folder(folder)
        info = files.get_file_info(fs.FileSelector(at, recursive=glob))
        found = [f for f in info if f.type == fs.FileType.File and f.base_name.endswith(self.suffix) and not f.base_name.startswith((".", "_"))]
        if glob:  # a pattern's * stays within one folder, as in Spark's paths
            steps = self.path[len(folder) + 1 :].split("/")

            def fits(f) -> bool:
                own = f.path[len(at.rstrip("/")) + 1 :].split("/")
                return len(own) in (len(steps), len(steps) + 1) and all(fnmatch.fnmatchcase(a, b) for a, b in zip(own, steps))

            found = [f for f in found if fits(f)]
        return sorted(found, key=lambda f: f.path)

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for f in self._listed():
            if len(out[-1].paths) >= FILES or size >= BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files):
        files, _ = open_folder(re.split(r"[*?\[]", self.path, maxsplit=1)[0].rsplit("/", 1)[0] or "/")
        rows, size = [], 0
        for i, path in enumerate(partition.paths):
            with files.open_input_file(path) as f:
                rows.append((path, path.rsplit("/", 1)[-1], f.read()))
            size += len(rows[-1][2])
            if size >= BATCH_BYTES or i == len(partition.paths) - 1:
                paths, names, contents = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(paths), pa.array(names), pa.array([len(c) for c in contents], pa.int64()), pa.array(contents, pa.binary())],
                    names=["path", "name", "length", "content"],
                )
                rows, size = [], 0


class ListedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listed_files"

    def schema(self) -> str:
        return "path string, name string, length bigint, content binary"

    def reader(self, schema) -> FilesReader:
        return FilesReader(dict(self.options))


def read_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, name, length and content of every file of a folder (or glob) whose name ends in ``suffix``;
    hidden names (``.``, ``_``) are left out. A missing folder is an error."""
    spark.dataSource.register(ListedFiles)
    return spark.read.format("listed_files").option("path", path).option("suffix", suffix).load()
