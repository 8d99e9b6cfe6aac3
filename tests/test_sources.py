import hashlib

import numpy as np
from pyspark.sql import functions as F

from framewright.sources import binary as N
from framewright.sources import inputs as I


def test_read_raw_matrix(spark, tmp_path):
    want = {}
    for name, rows in (("a", 3), ("b", 1), ("empty", 0)):
        want[name] = (np.arange(rows * 4).reshape(rows, 4) / 8).astype(">f4")
        (tmp_path / f"{name}.f0").write_bytes(want[name].tobytes() + (b"xx" if name == "b" else b""))
    (tmp_path / "other.txt").write_text("no matrix")
    got = I.read_raw_matrix(spark, str(tmp_path), 4, endian="big", pattern="*.f0").collect()
    assert len(got) == 4
    for r in got:
        assert r["values"] == want[r["utt"]][r["frame"]].tolist()


def test_matrix_ranges_of_large_and_small_files(spark, tmp_path):
    """A large file is dealt to several tasks and small ones share one; torn rows and empty files give nothing."""
    rng = np.random.default_rng(1)
    want = {"large": rng.random((50_000, 8)).astype("<f8"), "one": rng.random((1, 8)).astype("<f8"), "none": np.zeros((0, 8))}
    for name, rows in want.items():
        (tmp_path / f"{name}.raw").write_bytes(rows.tobytes() + b"torn")
    (tmp_path / ".hidden.raw").write_bytes(b"x" * 640)
    df = N.read_matrix_ranges(spark, str(tmp_path), 8, dtype="f8", pattern="*.raw", split_bytes=1 << 19)
    assert df.rdd.getNumPartitions() == 8
    got = {r["utt"]: r for r in df.groupBy("utt").agg(F.count("frame").alias("n"), F.max("frame").alias("last"), F.sum(F.col("values")[3] * F.col("frame")).alias("s")).collect()}
    assert set(got) == {"large", "one"} and got["large"]["n"] == 50_000 and got["large"]["last"] == 49_999
    assert abs(got["large"]["s"] - (want["large"][:, 3] * np.arange(50_000)).sum()) < 1e-3
    assert df.filter("utt = 'one'").first()["values"] == want["one"][0].tolist()


def test_a_huge_matrix_is_planned_by_ranges(tmp_path):
    """3 GB without its contents: 24 tasks, and one of them reads only its chunks."""
    with open(tmp_path / "huge.f0", "wb") as file:
        file.truncate(3 << 30)
        file.seek((3 << 30) - 16)
        file.write(np.array([1, 2, 3, 4], "<f4").tobytes())
    reader = N.RawMatrix({"path": f"file:{tmp_path}", "cols": "4"}).reader(None)
    parts = reader.partitions()
    assert len(parts) == 24 and sum(n for p in parts for *_, n in p.pieces) == (3 << 30) // 16
    path, first, n = parts[-1].pieces[0]
    last = list(reader.read(N.Ranges([(path, first + n - 3, 3)])))
    assert last[0].column("values").to_pylist()[-1] == [1.0, 2.0, 3.0, 4.0] and last[0].column("frame").to_pylist()[-1] == (3 << 30) // 16 - 1
    reader.wanted = {"other"}
    assert not reader.partitions()[0].pieces


def test_filters_on_recordings_reach_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = N.RawMatrix({"path": "/tmp", "cols": "4"}).reader(None)
    left = list(reader.pushFilters([EqualTo(("utt",), "a"), In(("utt",), ("a", "b")), GreaterThan(("frame",), 3)]))
    assert left == [GreaterThan(("frame",), 3)] and reader.wanted == {"a"}


def test_matrices_written_and_read_again_and_digests(spark, tmp_path):
    rows = spark.createDataFrame([(u, i, [float(u), float(i)]) for u in range(5) for i in range(20)], "utt_id int, frame int, values array<double>").repartition(7)
    files = N.write_raw_matrices(rows, str(tmp_path / "out"), suffix=".f0").collect()
    assert sorted((r["utt_id"], r["n_frames"]) for r in files) == [(str(u), 20) for u in range(5)]
    back = N.read_matrix_ranges(spark, str(tmp_path / "out"), 2, split_bytes=64)
    assert sorted((int(r["utt"]), r["frame"], r["values"]) for r in back.collect()) == [(u, i, [float(u), float(i)]) for u in range(5) for i in range(20)]
    for method in ("sha256", "md5"):
        got = N.digest_files(spark, str(tmp_path / "out"), method=method).collect()
        assert len(got) == 5 and all(r["digest"] == hashlib.new(method, open(r["path"], "rb").read()).hexdigest() and r["length"] == 160 for r in got)
    found = N.digest_files(spark, str(tmp_path / "out"))
    sums = found.select("path", F.when(F.col("path").endswith("3.f0"), "0").otherwise(F.col("digest")).alias("digest")).union(
        spark.createDataFrame([("gone", "1")], "path string, digest string"))
    status = {r["path"].rsplit("/", 1)[-1]: r["status"] for r in I.verify_checksums(found, sums).collect()}
    assert status == {"0.f0": "ok", "1.f0": "ok", "2.f0": "ok", "3.f0": "mismatch", "4.f0": "ok", "gone": "missing"}
