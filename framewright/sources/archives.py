"""Feature archives as a data source (A4): ``spark.dataSource.register(ArchiveSource)``, then ``spark.read.format("npz").load(folder)``.

An archive is a ZIP file of NumPy members. Its directory stands at its end, so
members are found without reading them, and each becomes a partition of its
own; a member that is stored without compression becomes several, of
``SPLIT_BYTES`` each. A task seeks to the bytes of its part and reads nothing
else. The option ``names`` leaves members out before any of them is opened, and
with the option ``filters`` so does a filter on ``name``, which needs the
session's ``spark.sql.python.filterPushdown.enabled``.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Bytes of a stored member that one task reads.
SPLIT_BYTES = 64 << 20
#: Rows that are sent to Spark together, and directories that are read at a time.
BATCH_ROWS, AT_A_TIME = 4096, 16
#: Bytes that hold the header of a member.
HEADER = 4096

#: What is read: ``shapes`` looks at the members' headers alone, ``vectors`` has a row for each vector of the innermost axis, with its place before.
SCHEMAS = {"shapes": "path string, name string, dtype string, shape array<bigint>, bytes bigint", "vectors": "path string, name string, index array<bigint>, vec array<float>"}


def open_file(path: str):
    """A file for random access, on any file system that Arrow knows."""
    from pyarrow.fs import FileSystem

    system, inner = FileSystem.from_uri(path)
    return system.open_input_file(inner)


def list_files(root: str, suffix: str = ".npz") -> list[str]:
    """The files below a folder, or the file itself, in order; hidden names are left out."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    system, inner = FileSystem.from_uri(root)
    info = system.get_file_info(inner)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(root)
    found = [info] if info.type == FileType.File else system.get_file_info(FileSelector(inner, recursive=True))
    scheme = root[: len(root) - len(inner)] if root.endswith(inner) else ""
    return sorted(scheme + f.path for f in found if f.type == FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith("."))


@dataclass
class Part(InputPartition):
    """Rows of a member: where its values begin (None: it is compressed and read whole), their type and shape."""

    path: str
    name: str
    dtype: str
    shape: tuple[int, ...]
    size: int
    start: int | None = None
    rows: tuple[int, int] | None = None

    @property
    def vectors(self) -> int:
        return int(np.prod(self.shape[:-1], dtype=np.int64)) if self.shape else 0


def _header(f) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether columns come first, type, and length of a member's header."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return (*read(f), f.tell())


def members(path: str, names: set[str] | None) -> list[Part]:
    """The members of an archive, from its directory and their headers."""
    found = []
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        for info in z.infolist():
            name = info.filename.removesuffix(".npy")
            if names is not None and name not in names:
                continue
            if info.compress_type != zipfile.ZIP_STORED:
                with z.open(info) as member:
                    shape, _, dtype, _ = _header(io.BytesIO(member.read(HEADER)))
                found.append(Part(path, name, str(dtype), shape, info.file_size))
                continue
            f.seek(info.header_offset)
            local = f.read(30)
            start = info.header_offset + 30 + sum(struct.unpack("<HH", local[26:30]))
            f.seek(start)
            shape, by_column, dtype, length = _header(io.BytesIO(f.read(min(HEADER, info.file_size))))
            plain = not by_column and not dtype.hasobject and len(shape) > 0
            found.append(Part(path, name, str(dtype), shape, info.file_size, start + length if plain else None))
    return found


def values(part: Part) -> np.ndarray:
    """The vectors of a part as rows, 16-bit brain floats (members whose names end in ``_bf16``) widened."""
    dtype, low, high = np.dtype(part.dtype), *(part.rows or (0, part.vectors))
    with open_file(part.path) as f:
        if part.start is None:
            with zipfile.ZipFile(f) as z, z.open(f"{part.name}.npy") as member:
                a = np.load(io.BytesIO(member.read()), allow_pickle=False).reshape(-1, part.shape[-1])[low:high]
        else:
            row = part.shape[-1] * dtype.itemsize
            f.seek(part.start + low * row)
            a = np.frombuffer(f.read((high - low) * row), dtype).reshape(-1, part.shape[-1])
    if dtype == np.uint16 and part.name.endswith("_bf16"):
        return (a.astype(np.uint32) << 16).view(np.float32)
    return a.astype(np.float32)


class ArchiveSource(DataSource):
    """Options: ``content`` (``shapes`` or ``vectors``), ``names`` (members to read, by comma), ``filters`` (true: filters are pushed down)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("content", "vectors")]

    def reader(self, schema) -> ArchiveReader:
        return (FilteredReader if self.options.get("filters") == "true" else ArchiveReader)(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.content = options["path"], options.get("content", "vectors")
        names = options.get("names")
        self.names = None if names is None else {n.strip() for n in names.split(",")}

    def partitions(self) -> list[Part]:
        """A part for each member, and for each ``SPLIT_BYTES`` of a stored one; only directories and headers are read."""
        with ThreadPoolExecutor(AT_A_TIME) as pool:
            found = [p for parts in pool.map(lambda path: members(path, self.names), list_files(self.root)) for p in parts]
        if self.content == "shapes":
            return found
        parts = []
        for p in found:
            if np.dtype(p.dtype).kind not in "fiub" or not p.vectors:
                continue
            step = p.vectors if p.start is None else max(1, SPLIT_BYTES // max(1, p.shape[-1] * np.dtype(p.dtype).itemsize))
            parts += [Part(p.path, p.name, p.dtype, p.shape, p.size, p.start, (k, min(p.vectors, k + step))) for k in range(0, p.vectors, step)]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        if self.content == "shapes":
            yield pa.RecordBatch.from_pylist([{"path": part.path, "name": part.name, "dtype": part.dtype, "shape": list(part.shape), "bytes": part.size}], _ARROW["shapes"])
            return
        rows = values(part)
        for k in range(0, len(rows), BATCH_ROWS):
            some = rows[k : k + BATCH_ROWS]
            places = np.stack(np.unravel_index(part.rows[0] + k + np.arange(len(some)), part.shape[:-1]), 1) if len(part.shape) > 1 else np.zeros((len(some), 0), np.int64)
            ends = lambda n, size: pa.array((np.arange(n + 1) * size).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends(len(some), places.shape[1]), pa.array(places.reshape(-1))), pa.ListArray.from_arrays(ends(len(some), some.shape[1]), pa.array(some.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(some)), pa.array([part.name] * len(some)), *lists], schema=_ARROW["vectors"])


class FilteredReader(ArchiveReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes names that are asked for; Spark judges the rows once more."""
        for one in filters:
            if isinstance(one, EqualTo | In) and one.attribute == ("name",):
                asked = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.names = asked if self.names is None else self.names & asked
            yield one


_ARROW = {
    "shapes": pa.schema([("path", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("bytes", pa.int64())]),
    "vectors": pa.schema([("path", pa.string()), ("name", pa.string()), ("index", pa.list_(pa.int64())), ("vec", pa.list_(pa.float32()))]),
}
