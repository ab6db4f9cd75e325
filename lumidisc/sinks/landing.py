"""Files as a Spark sink: tasks write them, the driver only renames.

``df.write.format("landing").option("path", root).mode("append").save()`` with columns path (below the root) and content. A task's files go
into a staging folder of their own below the root. When all tasks are done, the job is committed: files are moved to their places, where each
replaces what was there at once. A job that fails is aborted and leaves nothing; of a task that ran twice only one attempt's files are moved.
Any file system that the workers' Arrow can open serves (a plain path, file:, hdfs:, s3:, gs:); no mounted folder is needed.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lumidisc.session import ship


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def below(path: str | None) -> str:
    """The path, if it names a place below the root."""
    clean = posixpath.normpath(path or "")
    if not path or clean.startswith(("/", "../")) or clean in (".", ".."):
        raise ValueError(f"{path!r} is no path below the root")
    return clean


@dataclass
class Staged(WriterCommitMessage):
    """Where an attempt wrote, and its files."""

    folder: str = ""
    files: list[str] = field(default_factory=list)


class LandingWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.staging = root.rstrip("/"), f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = opened(self.root)
        folder, files = f"{self.staging}/{uuid.uuid4().hex}", []
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                path = below(path)
                place = posixpath.join(root, folder, path)
                system.create_dir(posixpath.dirname(place))
                with system.open_output_stream(place) as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                files.append(path)
        return Staged(folder, files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = opened(self.root)
        made = set()
        for m in messages:
            for path in m.files if m else ():
                place = posixpath.join(root, path)
                if (parent := posixpath.dirname(place)) not in made:
                    system.create_dir(parent)
                    made.add(parent)
                system.move(posixpath.join(root, m.folder, path), place)
        self._clean(system, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean(*opened(self.root))

    def _clean(self, system: fs.FileSystem, root: str) -> None:
        place = posixpath.join(root, self.staging)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class Landing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> LandingWriter:
        return LandingWriter(self.options["path"])


def land_files(files: DataFrame, root: str) -> None:
    """files: path (below the root) and content."""
    spark = ship(files.sparkSession)
    spark.dataSource.register(Landing)
    files.select("path", "content").write.format("landing").option("path", root).mode("append").save()
