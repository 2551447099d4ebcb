"""Archives as a data source: members, parts, and which bytes are read."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.sources import archives


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    tensors = {"big": rng.normal(size=(50, 20, 8)).astype(np.float32), "half": rng.normal(size=(3, 4)).astype(np.float16), "w_bf16": np.array([[0x3F80, 0x4000]], np.uint16), "flat": np.arange(5), "text": np.array("héllo"), "none": np.zeros((0, 3)), "turned": np.asfortranarray(np.arange(6.0).reshape(2, 3))}
    (tmp_path / "a").mkdir()
    np.savez(tmp_path / "a" / "stored.npz", **tensors)
    np.savez_compressed(tmp_path / "packed.npz", **tensors)
    (tmp_path / ".hidden.npz").write_bytes(b"x")
    return tmp_path, tensors


def widened(name, a):
    return (a.astype(np.uint32) << 16).view(np.float32) if name.endswith("_bf16") else a.astype(np.float32)


def test_vectors_and_shapes(spark, folder, monkeypatch):
    root, tensors = folder
    spark.dataSource.register(archives.ArchiveSource)
    got = {}
    for r in spark.read.format("npz").load(str(root)).collect():
        got[r.path.rsplit("/", 1)[1], r["name"], tuple(r["index"])] = list(r.vec)
    want = {(f, n, tuple(map(int, i))): widened(n, a)[i].tolist() for f in ("stored.npz", "packed.npz") for n, a in tensors.items() if a.dtype.kind in "fiu" and a.ndim for i in np.ndindex(a.shape[:-1])}
    assert got == want
    shapes = spark.read.format("npz").option("content", "shapes").load(str(root)).collect()
    assert {(r["name"], tuple(r["shape"]), r["dtype"]) for r in shapes} == {(n, a.shape, str(a.dtype)) for n, a in tensors.items()} and len(shapes) == 2 * len(tensors)


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_names_are_pushed_down(spark, folder, pushed):
    spark.dataSource.register(archives.ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    try:
        df = spark.read.format("npz").option("filters", pushed).load(str(folder[0])).filter(F.col("name").isin("half", "flat"))
        assert df.count() == 8 and {r[0] for r in df.select("name").distinct().collect()} == {"half", "flat"}
        assert (df.rdd.getNumPartitions() == 4) == (pushed == "true")
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


class Watched(io.FileIO):
    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        Watched.read_bytes += len(data)
        return data


def test_only_the_asked_bytes_are_read(folder, monkeypatch):
    root, tensors = folder
    monkeypatch.setattr(archives, "open_file", Watched)
    monkeypatch.setattr(archives, "SPLIT_BYTES", 4000)
    reader = archives.ArchiveReader({"path": str(root / "a"), "names": "big"})
    Watched.read_bytes = 0
    parts = reader.partitions()
    planned = Watched.read_bytes
    assert len(parts) == 8 and planned < 8000  # the directory and one header
    sizes = []
    for part in parts:
        Watched.read_bytes = 0
        batches = list(reader.read(part))
        sizes.append(Watched.read_bytes)
        assert sum(b.num_rows for b in batches) == part.rows[1] - part.rows[0]
    assert sum(sizes) == tensors["big"].nbytes and max(sizes) <= 4000


def test_missing_folder(tmp_path):
    with pytest.raises(FileNotFoundError):
        archives.list_files(str(tmp_path / "none"))
    assert archives.list_files(str(tmp_path)) == []
