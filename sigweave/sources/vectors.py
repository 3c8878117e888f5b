"""Matrix files (`.npy`) with row-aligned metadata as a Spark data source, in and out.

`spark.dataSource.register(VectorFiles)`, then `spark.read.format("vector_files")` and `df.write.format("vector_files")`.

A folder holds parts: `NAME.npy` (a C-ordered matrix of float32 or float64), `NAME.jsonl` (one JSON object per row, in the
same order) and `NAME.lines.npy` (where each line begins). The header of a matrix says where each row lies, so a part is planned as
ranges of `rows` rows, and a task reads its range by offset: nothing is read whole. A single `.npy` file without
metadata is read as well. Columns are `row` (number in the part), `part`, the vector and the metadata's.

A write makes one part per task (parts of a failed attempt are deleted), and `_SUCCESS` last. Paths go through Arrow's file systems, so `file:`, `hdfs:` or
`s3:` work where Arrow has them.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

MAGIC = b"\x93NUMPY"
KINDS = {"<f4": np.float32, "<f8": np.float64}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Header:
    """What a matrix file says about itself."""

    kind: str
    rows: int
    width: int
    begin: int


def read_header(fs: pafs.FileSystem, name: str) -> Header:
    """The header of a `.npy` file; only two-dimensional C-ordered float matrices whose size agrees are taken."""
    with fs.open_input_file(name) as f:
        if f.read(6) != MAGIC:
            raise ValueError(f"{name}: not a matrix file")
        major, _ = f.read(1)[0], f.read(1)
        size = struct.unpack("<H", f.read(2))[0] if major == 1 else struct.unpack("<I", f.read(4))[0]
        said = _literal(f.read(size).decode("latin1" if major < 3 else "utf-8"))
        begin, total = f.tell(), f.size()
    shape, kind = said["shape"], said["descr"]
    if kind not in KINDS or said["fortran_order"] or len(shape) != 2:
        raise ValueError(f"{name}: a C-ordered matrix of {sorted(KINDS)} is needed, not {kind} {shape}")
    if begin + shape[0] * shape[1] * np.dtype(kind).itemsize != total:
        raise ValueError(f"{name}: {total} bytes are no {shape[0]} x {shape[1]} matrix")
    return Header(kind, *shape, begin)


def _literal(text: str) -> dict:
    import ast

    return ast.literal_eval(text.strip())


def header_bytes(kind: str, rows: int, width: int) -> bytes:
    """A version 1 header of fixed length, so that the count of rows can be written last."""
    text = f"{{'descr': '{kind}', 'fortran_order': False, 'shape': ({rows}, {width}), }}"
    room = 118
    return MAGIC + b"\x01\x00" + struct.pack("<H", room) + text.ljust(room - 1).encode() + b"\n"


@dataclass
class RowRange(InputPartition):
    name: str
    first: int
    last: int
    head: Header

    def __post_init__(self):
        self.value = None


class RangeReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, vector: str, rows: int):
        self.path, self.schema, self.vector, self.rows = path, schema, vector, rows

    def partitions(self) -> list[RowRange]:
        fs, at = file_system(self.path)
        names = [at] if at.endswith(".npy") else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".npy") and not f.path.endswith(".lines.npy"))
        out = []
        for name in names:
            head = read_header(fs, name)
            out += [RowRange(name, i, min(head.rows, i + self.rows), head) for i in range(0, head.rows, self.rows)]
        return out or [RowRange("", 0, 0, Header("<f4", 0, 0, 0))]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if part.first >= part.last:
            return
        fs, _ = file_system(self.path)
        n, head = part.last - part.first, part.head
        cell = np.dtype(head.kind).itemsize
        with fs.open_input_file(part.name) as f:
            flat = np.frombuffer(f.read_at(n * head.width * cell, head.begin + part.first * head.width * cell), head.kind)
        fields = {f.name: f.dataType for f in self.schema}
        wanted = to_arrow_schema(self.schema)
        item = wanted.field(self.vector).type.value_type if self.vector in fields else pa.float32()
        have = {
            "row": pa.array(range(part.first, part.last), pa.int64()),
            "part": pa.array([part.name.rsplit("/", 1)[-1].removesuffix(".npy")] * n),
            self.vector: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * head.width, pa.int32()), pa.array(flat).cast(item)),
        }
        meta = [f.name for f in self.schema if f.name not in have]
        if meta:
            rows = self._lines(fs, part)
            for name in meta:
                have[name] = pa.array([r.get(name) for r in rows], wanted.field(name).type)
        yield pa.RecordBatch.from_arrays([have[f.name].cast(wanted.field(f.name).type) for f in self.schema], schema=wanted)

    def _lines(self, fs: pafs.FileSystem, part: RowRange) -> list[dict]:
        base = part.name.removesuffix(".npy")
        with fs.open_input_file(f"{base}.lines.npy") as f:
            if f.size() != 128 + 8 * (part.head.rows + 1):
                raise ValueError(f"{base}: metadata is not aligned with the matrix")
            at = np.frombuffer(f.read_at(8 * (part.last - part.first + 1), 128 + 8 * part.first), "<i8")
        with fs.open_input_file(f"{base}.jsonl") as f:
            text = f.read_at(int(at[-1] - at[0]), int(at[0]))
        return [json.loads(text[a - at[0] : z - at[0]]) for a, z in zip(at[:-1], at[1:], strict=True)]


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class PartWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, vector: str, overwrite: bool):
        self.path, self.schema, self.vector, self.overwrite = path, schema, vector, overwrite
        if not isinstance(schema[vector].dataType, T.ArrayType) or not isinstance(schema[vector].dataType.elementType, T.FloatType | T.DoubleType):
            raise ValueError(f"{vector} must be an array of floats or doubles")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        fs, at = file_system(self.path)
        fs.create_dir(at, recursive=True)
        task = TaskContext.get()
        name = f"{at}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        kind = "<f4" if isinstance(self.schema[self.vector].dataType.elementType, T.FloatType) else "<f8"
        meta = [f.name for f in self.schema if f.name != self.vector]
        rows, width, lines = 0, None, [0]
        with fs.open_output_stream(f"{name}.body") as body, fs.open_output_stream(f"{name}.jsonl") as text:
            for b in batches:
                v = b.column(b.schema.names.index(self.vector))
                sizes = set(np.diff(v.offsets.to_numpy()).tolist())
                width = sizes.pop() if width is None and sizes else width
                if v.null_count or v.flatten().null_count or sizes - {width}:
                    raise ValueError(f"{self.vector}: vectors must have one length and no nulls")
                body.write(v.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes())
                for r in b.select(meta).to_pylist():
                    line = json.dumps(r, ensure_ascii=False, default=str).encode() + b"\n"
                    text.write(line)
                    lines.append(lines[-1] + len(line))
                rows += b.num_rows
        if rows:
            with fs.open_output_stream(f"{name}.npy") as out:
                out.write(header_bytes(kind, rows, width))
                with fs.open_input_stream(f"{name}.body") as body:
                    while chunk := body.read(1 << 22):
                        out.write(chunk)
            with fs.open_output_stream(f"{name}.lines.npy") as out:
                text = f"{{'descr': '<i8', 'fortran_order': False, 'shape': ({len(lines)},), }}"
                out.write(MAGIC + b"\x01\x00" + struct.pack("<H", 118) + text.ljust(117).encode() + b"\n" + np.array(lines, "<i8").tobytes())
        else:
            fs.delete_file(f"{name}.jsonl")
        fs.delete_file(f"{name}.body")
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        """Only the parts of successful attempts stay (and, unless overwritten, those of earlier writes)."""
        fs, at = file_system(self.path)
        fs.create_dir(at, recursive=True)
        done = {m.name for m in messages if m is not None}
        before = set()
        if not self.overwrite and fs.get_file_info(f"{at}/_SUCCESS").type == pafs.FileType.File:
            with fs.open_input_stream(f"{at}/_SUCCESS") as f:
                before = {f"{at}/{n}" for n in json.loads(f.read())}
        for f in fs.get_file_info(pafs.FileSelector(at)):
            if f.base_name.startswith("part-") and f.path.split(".")[0] not in done | before:
                fs.delete_file(f.path)
        with fs.open_output_stream(f"{at}/_SUCCESS") as f:
            f.write(json.dumps(sorted(n.rsplit("/", 1)[-1] for n in done | before)).encode())

    def abort(self, messages: list[Part | None]) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            for end in (".npy", ".jsonl", ".lines.npy"):
                if m is not None and fs.get_file_info(m.name + end).type == pafs.FileType.File:
                    fs.delete_file(m.name + end)


class VectorFiles(DataSource):
    """Options: `vector` (name of the vector column, `embedding`), `rows` (rows of a range, 65536)."""

    @classmethod
    def name(cls) -> str:
        return "vector_files"

    def schema(self) -> str:
        return f"row bigint, part string, {self.options.get('vector', 'embedding')} array<float>"

    def reader(self, schema: T.StructType) -> RangeReader:
        return RangeReader(self.options["path"], schema, self.options.get("vector", "embedding"), int(self.options.get("rows", 1 << 16)))

    def writer(self, schema: T.StructType, overwrite: bool) -> PartWriter:
        return PartWriter(self.options["path"], schema, self.options.get("vector", "embedding"), overwrite)
