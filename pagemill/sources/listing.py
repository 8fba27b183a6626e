"""Names and sizes of stored files, empty ones included.

The driver reads one level of folders; what is below them is listed by tasks, a folder
each, so no listing of all files is held anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 10_000


def is_data(path: str) -> bool:
    """Names that start with a dot or an underscore are no data, as in Spark's own sources."""
    return not path.rsplit("/", 1)[-1].startswith((".", "_"))


class Folder(InputPartition):
    """A folder to list, with all below it or only its own files."""

    def __init__(self, path: str, deep: bool):
        super().__init__((path, deep))
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"

    def _storage(self):
        # file:/x, as Spark writes it, and file:///x are the same.
        from pyarrow import fs

        uri = "file:///" + self.uri[len("file:") :].lstrip("/") if self.uri.startswith("file:") else self.uri
        return fs.FileSystem.from_uri(uri)

    def _list(self, path: str):
        from pyarrow import fs

        return self._storage()[0].get_file_info(fs.FileSelector(path))

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        root = self._storage()[1]
        below = [x.path for x in self._list(root) if x.type == fs.FileType.Directory and is_data(x.path)]
        return [Folder(root, False), *(Folder(p, True) for p in sorted(below))]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        scheme = self.uri.split(":", 1)[0]
        paths: list[str] = []
        sizes: list[int] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])

        todo = [partition.path]
        while todo:
            for found in self._list(todo.pop()):
                if not is_data(found.path):
                    continue
                if found.type == fs.FileType.Directory:
                    if partition.deep:
                        todo.append(found.path)
                elif found.type == fs.FileType.File:
                    paths.append(f"{scheme}:{found.path}")
                    sizes.append(found.size)
                    if len(paths) == ROWS:
                        yield batch()
                        paths, sizes = [], []
        yield batch()


class FileListing(DataSource):
    """`spark.read.format("file_listing").load(folder)`: (path, length) of every file below a folder."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"])
