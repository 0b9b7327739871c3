"""Many small text files per task, as a data source with a commit step.

A task writes its files into a folder of its own below ``_staging``; when all tasks are done, each
folder is moved to its place, one move per task, and what failed or repeated tasks left goes with the
staging folder. A reader of the path never sees an unfinished file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class _Written(WriterCommitMessage):
    staged: str  # empty: the task had no rows
    final: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"_staging/{uuid.uuid4().hex}"

    def _opened(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, root.rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        system, root = self._opened()
        task = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        folder, seen = f"{root}/{self.staging}/{task}", set()
        try:
            for batch in batches:
                if not seen and len(batch):
                    system.create_dir(folder)
                for name, text in zip(batch.column("name"), batch.column("text")):
                    name = name.as_py()
                    if name in seen or "/" in name:
                        raise ValueError(f"{name!r} is no name of one file")
                    seen.add(name)
                    with system.open_output_stream(f"{folder}/{name}.log") as out:
                        out.write(text.as_py().encode() + b"\n")
        except BaseException:
            if system.get_file_info(folder).type == fs.FileType.Directory:
                system.delete_dir(folder)
            raise
        return _Written(folder if seen else "", f"{root}/{task}")

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = self._opened()
        system.create_dir(root)
        before = system.get_file_info(fs.FileSelector(root)) if self.overwrite else []
        for entry in before:
            if entry.type == fs.FileType.Directory and entry.base_name.startswith("part-"):
                system.delete_dir(entry.path)
        for message in messages:
            if message is not None and message.staged:
                system.move(message.staged, message.final)
        self.abort([])

    def abort(self, messages: list[_Written | None]) -> None:
        system, root = self._opened()
        for folder in (f"{root}/{self.staging}", f"{root}/_staging"):
            found = system.get_file_info(folder).type == fs.FileType.Directory
            if found and (folder.endswith(self.staging) or not system.get_file_info(fs.FileSelector(folder))):
                system.delete_dir(folder)


class LogFiles(DataSource):
    """Write only: rows of (name, text) become files ``name.log``."""

    @classmethod
    def name(cls) -> str:
        return "log_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)
