import struct

import numpy as np
import pytest

from tensorloom.operators.dense import Matrix
from tensorloom.sources import binary, files
from tensorloom.tensor import SparseTensor

ROWS = [(0, 1, 2, 1.5), (1, 1, 0, -0.25), (2, 0, 0, 2.0)]


def test_bytes_are_those_of_the_format(spark, tmp_path):
    x = SparseTensor(spark.createDataFrame(ROWS, "i0 long, i1 long, i2 long, v double").coalesce(1), 3)
    files.write_bin(x, str(tmp_path / "a.bin"))
    arrays = struct.pack("<9Q", 0, 1, 2, 1, 1, 0, 2, 0, 0) + struct.pack("<3d", 1.5, -0.25, 2.0)
    assert (tmp_path / "a.bin").read_bytes() == struct.pack("<iQQ", 0x5350, 8, 8) + struct.pack("<5Q", 3, 3, 2, 3, 3) + arrays
    files.write_bin(x, f"file://{tmp_path}/sub/b.bin", header=False)
    assert (tmp_path / "sub" / "b.bin").read_bytes() == struct.pack("<5Q", 3, 3, 2, 3, 3) + arrays
    files.write_bin(x, str(tmp_path / "c.bin"), index_bytes=4, value_bytes=4)
    narrow = struct.pack("<iQQ", 0x5350, 4, 4) + struct.pack("<5I", 3, 3, 2, 3, 3) + struct.pack("<9I", 0, 1, 2, 1, 1, 0, 2, 0, 0) + struct.pack("<3f", 1.5, -0.25, 2.0)
    assert (tmp_path / "c.bin").read_bytes() == narrow
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(("a.bin.", "c.bin."))] == []


@pytest.mark.parametrize("widths", [(8, 8), (4, 4), (4, 8), (8, 4)])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch, widths):
    rng = np.random.default_rng(1)
    n = 5000
    rows = [(int(a), int(b), float(v)) for a, b, v in zip(rng.integers(0, 700, n), rng.integers(0, 90, n), rng.integers(-50, 50, n) / 4)]
    x = SparseTensor(spark.createDataFrame(rows, "i0 long, i1 long, v double").repartition(6), 2, (700, 90))
    files.write_bin(x, path := str(tmp_path / "t.bin"), index_bytes=widths[0], value_bytes=widths[1])
    back = files.read_bin(spark, path, entries=300)
    assert back.dims == (700, 90)
    assert back.df.rdd.getNumPartitions() == 17
    assert sorted(map(tuple, back.df.collect())) == sorted(rows)
    # A task reads its own places of each array, whatever lies before them: 3 GB of index arrays, never allocated.
    layout = binary.Layout((10, 10), 200_000_000, "<u8", "<f8", 60)
    assert layout.place(1, 5) == 60 + 8 * 200_000_000 + 40 and layout.place(2, 7) == 60 + 16 * 200_000_000 + 56


def test_a_sparse_file_over_two_gigabytes(spark, tmp_path):
    """Zeros but for the last entry; the file system stores the holes as such."""
    n = 110_000_000
    path = tmp_path / "large.bin"
    with open(path, "wb") as f:
        f.write(struct.pack("<4Q", 2, 9, 8, n))
        for m, last in enumerate((8, 7)):
            f.seek(32 + 8 * n * (m + 1) - 8)
            f.write(struct.pack("<Q", last))
        f.seek(32 + 24 * n - 8)
        f.write(struct.pack("<d", 2.5))
    assert path.stat().st_size > 1 << 31
    reader = binary.CoordinateReader({"path": str(path), "header": "false", "entries": "100000"})
    parts = reader.partitions()
    assert len(parts) == 1100
    rows = [r for batch in reader.read(parts[-1]) for r in batch.to_pylist()]
    assert len(rows) == 100_000 and rows[-1] == {"i0": 8, "i1": 7, "v": 2.5} and rows[0] == {"i0": 0, "i1": 0, "v": 0.0}


def test_folders_empty_tensors_and_errors(spark, tmp_path):
    x = SparseTensor(spark.createDataFrame(ROWS, "i0 long, i1 long, i2 long, v double"), 3)
    files.write_bin(x, f"{tmp_path}/many/1.bin")
    files.write_bin(SparseTensor(x.df, 3, (9, 9, 9)), f"{tmp_path}/many/2.bin")
    both = files.read_bin(spark, f"{tmp_path}/many")
    assert both.dims == (9, 9, 9) and sorted(map(tuple, both.df.collect())) == sorted(ROWS * 2)
    empty = SparseTensor(x.df.where("false"), 3, (3, 2, 3))
    files.write_bin(empty, f"{tmp_path}/empty.bin")
    assert files.read_bin(spark, f"{tmp_path}/empty.bin").df.count() == 0
    (tmp_path / "short.bin").write_bytes((tmp_path / "many/1.bin").read_bytes()[:-3])
    with pytest.raises(ValueError, match="bytes of"):
        files.read_bin(spark, f"{tmp_path}/short.bin")
    data = bytearray((tmp_path / "many/1.bin").read_bytes())
    data[20 + 8 : 20 + 16] = struct.pack("<Q", 1)  # a dimension that its indices exceed
    (tmp_path / "wrong.bin").write_bytes(data)
    with pytest.raises(Exception, match="index of mode 0 is not below 1"):
        files.read_bin(spark, f"{tmp_path}/wrong.bin").df.collect()
    with pytest.raises(ValueError, match="fit in 4 bytes"):
        files.write_bin(SparseTensor(x.df, 3, (1 << 40, 2, 3)), f"{tmp_path}/n.bin", index_bytes=4)
    with pytest.raises(ValueError, match="8 bytes"):
        files.write_bin(x, f"{tmp_path}/n.bin", header=False, index_bytes=4)


def test_matrix_files_are_written_in_pieces(spark, tmp_path):
    rows = [(i, i * 0.1, -i / 3) for i in range(0, 4000, 2)]
    a = Matrix(spark.createDataFrame(rows, "row long, c0 double, c1 double").repartition(7), 4001, 2)
    files.write_matrix(a, str(tmp_path / "m.out"))
    full = np.zeros((4001, 2))
    for i, *cells in rows:
        full[i] = cells
    want = "matrix\n2\n4001 2\n" + "".join(f"{v:.20f}\n" for v in full.T.ravel())
    assert (tmp_path / "m.out").read_text() == want
    cells = files.read_cells(spark, str(tmp_path / "m.out")).collect()
    assert len(cells) == 8002 and all(r.v == full[r.row, r.col] for r in cells)


def test_large_tensors_are_folders_of_bounded_files(spark, tmp_path):
    rows = [(k % 70, k % 11, k / 4) for k in range(4000)]
    x = SparseTensor(spark.createDataFrame(rows, "i0 long, i1 long, v double").repartition(8), 2, (70, 11))
    for header in (True, False):
        files.write_bin(x, path := f"{tmp_path}/t{header}", header=header, file_bytes=24 * 1100)
        found = sorted((tmp_path / f"t{header}").iterdir())
        assert [p.suffix for p in found] == [".bin"] * 4
        assert all(p.stat().st_size <= 24 * 1100 + 100 for p in found)
        back = files.read_bin(spark, path, header=header)
        assert back.dims == (70, 11) and sorted(map(tuple, back.df.collect())) == sorted(rows)
