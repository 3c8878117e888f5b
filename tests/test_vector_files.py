"""Matrix files: ranges, alignment, refusals, failed attempts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.sources import vectors
from sigweave.sources.vectors import VectorFiles


@pytest.fixture(autouse=True)
def registered(spark):
    spark.dataSource.register(VectorFiles)


def test_a_plain_matrix_file_is_read_by_ranges(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(1000, 7))
    np.save(tmp_path / "m.npy", x)
    d = spark.read.format("vector_files").option("rows", 90).schema("row bigint, embedding array<double>").load(str(tmp_path / "m.npy"))
    assert d.rdd.getNumPartitions() == 12
    got = {r.row: r.embedding for r in d.collect()}
    assert len(got) == 1000 and all(got[i] == x[i].tolist() for i in range(1000))
    assert spark.read.format("vector_files").load(str(tmp_path / "m.npy")).filter("row = 999").first().embedding == pytest.approx(x[999].tolist(), rel=1e-6)


def test_round_trip_with_metadata(spark, tmp_path):
    rows = [(i, f"é\n{i}", [float(i), i / 3], {"a": i} if i % 2 else None) for i in range(250)]
    d = spark.createDataFrame(rows, "id long, text string, v array<double>, m map<string,int>")
    out = str(tmp_path / "out")
    d.repartition(4).write.format("vector_files").option("vector", "v").mode("overwrite").save(out)
    back = spark.read.format("vector_files").option("vector", "v").option("rows", 17).schema("id long, v array<double>, text string").load(out)
    assert {(r.id, r.text, tuple(r.v)) for r in back.collect()} == {(i, t, tuple(v)) for i, t, v, _ in rows}
    one = next((tmp_path / "out").glob("part-*[0-9].npy"))  # any reader of such files can read them
    assert np.load(one).dtype == np.float64 and len(np.load(one)) == len(one.with_suffix(".jsonl").read_text().splitlines())
    d.limit(3).write.format("vector_files").option("vector", "v").mode("append").save(out)
    assert spark.read.format("vector_files").option("vector", "v").schema("id long, v array<double>").load(out).count() == 253
    (tmp_path / "out" / "part-00000-99999.npy").write_bytes(one.read_bytes())  # left by an attempt that died
    d.limit(5).write.format("vector_files").option("vector", "v").mode("overwrite").save(out)
    assert spark.read.format("vector_files").option("vector", "v").schema("id long, v array<double>").load(out).count() == 5
    d.limit(0).write.format("vector_files").option("vector", "v").mode("overwrite").save(out)
    assert spark.read.format("vector_files").option("vector", "v").schema("id long, v array<double>").load(out).count() == 0
    assert json.loads((tmp_path / "out" / "_SUCCESS").read_text()) is not None


@pytest.mark.parametrize("made", [lambda p: np.save(p, np.zeros(5)), lambda p: np.save(p, np.zeros((2, 2), np.int32)), lambda p: np.save(p, np.asfortranarray(np.zeros((3, 2)))), lambda p: open(p, "wb").write(b"text")])
def test_other_shapes_and_types_are_refused(tmp_path, made):
    made(str(tmp_path / "x.npy"))
    fs, at = vectors.file_system(str(tmp_path / "x.npy"))
    with pytest.raises(ValueError):
        vectors.read_header(fs, at)


def test_truncated_files_and_ragged_vectors_are_refused(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.zeros((4, 3)))
    data = (tmp_path / "x.npy").read_bytes()
    (tmp_path / "x.npy").write_bytes(data[:-1])
    with pytest.raises(ValueError):
        vectors.read_header(*vectors.file_system(str(tmp_path / "x.npy")))
    for bad in ([(1, [1.0, 2.0]), (2, [1.0])], [(1, None)], [(1, [None, 1.0])]):
        with pytest.raises(Exception, match="one length"):
            spark.createDataFrame(bad, "id int, embedding array<double>").coalesce(1).write.format("vector_files").mode("overwrite").save(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="array of floats"):
        spark.range(1).select("id", F.lit("x").alias("embedding")).write.format("vector_files").mode("overwrite").save(str(tmp_path / "bad"))
