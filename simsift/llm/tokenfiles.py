"""Token files: flat unsigned integers with 64-bit document offsets.

A folder holds the ids of all documents in ascending order of doc_id, as one stream cut
into parts. Each part is three flat little-endian files that can be mapped into memory:

* ``<part>.ids``: the ids, two bytes each where the vocabulary has at most 65,536 of them, else four;
* ``<part>.offsets``: for n documents n + 1 signed 64-bit numbers, where in the part each begins and the last ends;
* ``<part>.docs``: n signed 64-bit doc_ids.

``manifest.json`` names the parts in order with their counts and bases: the ids and documents
of all parts before, as prefix sums. A document's place in the stream is its part's base plus
its offset. The manifest is written last, when all parts are there: files of failed or repeated
tasks are not named in it, and without a manifest there is no result.

Rows are range-partitioned and sorted by (doc_id, text hash, place in the scan), so that equal
doc_ids, however many, spread over parts; rows that tie on doc_id and text are equal. Null doc_ids
come first (a part's manifest entry counts them) and are read back as null. A null or empty text has the end
token alone. Other columns are ignored. An empty table gives no part, and an empty table back.
A text is encoded whole, whatever its length. Special-token strings in a text count as the
library's plain call takes them: as special tokens.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .vocabulary import blocks, encoder

FORMAT = "token_files"
FULL = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>"
_MANIFEST = "manifest.json"
#: Ids a reading task holds at once, but for a longer document.
READ_IDS = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    """One part's files and counts, as a task reports them."""

    order: int
    name: str
    n_docs: int
    n_null: int
    n_ids: int


@dataclass
class Stretch(InputPartition):
    """One part, its base in ids and where its documents with a doc_id begin."""

    name: str
    n_null: int
    first_id: int


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


def _mapped(system: fs.FileSystem, path: str) -> pa.NativeFile:
    """A file mapped into memory, or opened for reading at a place where the store is no file system."""
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, vocabulary: str, end_id: int, overwrite: bool):
        self.folder, self.vocabulary, self.end_id, self.overwrite = folder, vocabulary, end_id, overwrite
        system, path = _opened(folder)
        if not overwrite and system.get_file_info(f"{path}/{_MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{folder} holds token files already; their order leaves no place for more")

    def _width(self) -> np.dtype:
        size = max(encoder(self.vocabulary).size, self.end_id + 1)
        return np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        system, path = _opened(self.folder)
        order, coder, width = TaskContext.get().partitionId(), encoder(self.vocabulary), self._width()
        part = Part(order, f"part-{order:06d}-{uuid.uuid4().hex}", 0, 0, 0)
        system.create_dir(path)
        try:
            with (
                system.open_output_stream(f"{path}/{part.name}.ids") as ids_file,
                system.open_output_stream(f"{path}/{part.name}.offsets") as offsets_file,
                system.open_output_stream(f"{path}/{part.name}.docs") as docs_file,
            ):
                offsets_file.write(np.zeros(1, "<i8").tobytes())
                for batch in batches:
                    for rows, texts in blocks(batch, 1):
                        flat, bounds = coder.ids(texts)
                        flat = np.insert(flat.astype(width), bounds[1:], self.end_id)
                        ends = bounds[1:] + np.arange(1, len(bounds)) + part.n_ids
                        keys = rows.column(0)
                        ids_file.write(flat.tobytes())
                        offsets_file.write(ends.astype("<i8").tobytes())
                        docs_file.write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                        part.n_docs += len(texts)
                        part.n_null += keys.null_count
                        part.n_ids += len(flat)
        except BaseException:
            self._remove([part.name])
            raise
        return part

    def _remove(self, names: list[str]) -> None:
        system, path = _opened(self.folder)
        for name in names:
            for kind in ("ids", "offsets", "docs"):
                if system.get_file_info(f"{path}/{name}.{kind}").type == fs.FileType.File:
                    system.delete_file(f"{path}/{name}.{kind}")

    def commit(self, messages: list[Part | None]) -> None:
        """Bases by prefix sums over the parts' counts, then the manifest; parts of an earlier one go."""
        system, path = _opened(self.folder)
        system.create_dir(path)
        before = _manifest(self.folder) if self.overwrite else None
        parts, first_id, first_doc = [], 0, 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.order):
            parts.append({"name": m.name, "n_docs": m.n_docs, "n_null": m.n_null, "n_ids": m.n_ids,
                          "first_doc": first_doc, "first_id": first_id})
            first_id, first_doc = first_id + m.n_ids, first_doc + m.n_docs
        about = {"width": self._width().itemsize, "end_id": self.end_id, "n_docs": first_doc, "n_ids": first_id, "parts": parts}
        with system.open_output_stream(f"{path}/{_MANIFEST}.new") as out:
            out.write(json.dumps(about).encode())
        system.move(f"{path}/{_MANIFEST}.new", f"{path}/{_MANIFEST}")
        self._remove([p["name"] for p in (before or {"parts": []})["parts"]])

    def abort(self, messages: list[Part | None]) -> None:
        self._remove([m.name for m in messages if m is not None])


def _manifest(folder: str) -> dict | None:
    system, path = _opened(folder)
    if system.get_file_info(f"{path}/{_MANIFEST}").type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{path}/{_MANIFEST}") as file:
        return json.loads(file.read())


class _Reader(DataSourceReader):
    """Documents from the files; only the columns of the wanted schema are made."""

    def __init__(self, folder: str, schema: StructType):
        self.folder, self.columns = folder, schema.fieldNames()
        manifest = _manifest(folder)
        if manifest is None:
            raise ValueError(f"{folder} holds no finished token files")
        self.width = manifest["width"]
        self.parts = [Stretch(p["name"], p["n_null"], p["first_id"]) for p in manifest["parts"] if p["n_docs"]]

    def partitions(self) -> list[InputPartition]:
        return self.parts or [Stretch("", 0, 0)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        system, path = _opened(self.folder)
        at = f"{path}/{part.name}"
        with _mapped(system, f"{at}.ids") as ids_file, _mapped(system, f"{at}.offsets") as o, _mapped(system, f"{at}.docs") as d:
            offsets, docs = (np.frombuffer(f.read_buffer(), dtype="<i8") for f in (o, d))
            a = 0
            while a < len(docs):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + READ_IDS, "right")) - 1)
                ids_file.seek(int(offsets[a]) * self.width)
                raw = ids_file.read_buffer(int(offsets[b] - offsets[a]) * self.width)
                ids = np.frombuffer(raw, dtype=f"<u{self.width}").astype("<u4")
                yield self._batch(part, a, docs[a:b], offsets[a : b + 1], ids)
                a = b

    def _batch(self, part: Stretch, first: int, docs: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        inside = offsets - offsets[0]
        made = {
            "doc_id": lambda: pa.array(docs, mask=np.arange(first, first + len(docs)) < part.n_null),
            "start": lambda: pa.array(offsets[:-1] + part.first_id),
            "n_tokens": lambda: pa.array(np.diff(offsets)),
            "ids_crc32": lambda: pa.array(crc32s(ids, inside), pa.int64()),
            "ids": lambda: pa.ListArray.from_arrays(pa.array(inside, pa.int32()), pa.array(ids, pa.int64())),
        }
        return pa.RecordBatch.from_arrays([made[c]() for c in self.columns], names=self.columns)


def crc32s(ids: np.ndarray, bounds: np.ndarray) -> list[int]:
    """crc32 of each stretch of 32-bit ids."""
    raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    at = (4 * bounds).tolist()
    return [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:])]


class TokenFiles(DataSource):
    """Spark's way to the files: options ``path``, and for writing ``vocabulary`` and ``end_id``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FULL

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["vocabulary"], int(self.options.get("end_id", "0")), overwrite)


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
    overwrite: bool = False,
) -> None:
    """Encode every text and write the files of the whole table to ``folder``.

    The texts move once, by range of doc_id, and are encoded where they are written.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keys = ["doc_id", F.xxhash64("text"), "_scan"]
    ordered = rows.withColumn("_scan", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("doc_id", "text").write.format(FORMAT).mode("overwrite" if overwrite else "append").option(
        "vocabulary", vocabulary
    ).option("end_id", str(end_id)).save(folder)


def read_tokens(spark: SparkSession, folder: str, columns: str = FULL) -> DataFrame:
    """One row per document; ``columns`` are some of FULL, only these are made."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(FORMAT).schema(columns).load(folder)
