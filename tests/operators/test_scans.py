import json

import numpy as np
import pytest

from lodestone.sources import files


def test_lines_have_their_numbers_over_splits(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    texts = {"a.jsonl": [json.dumps({"n": k, "pad": "x" * (k % 50)}) for k in range(3000)], "b.jsonl": ["", '{"n": 1}', "[1, 2]", "  ", '"text"', '{"n": 2}', "null"]}
    for name, lines in texts.items():
        (folder / name).write_text("\n".join(lines) + ("\n" if name < "b" else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4096", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = files.numbered_lines(spark, str(folder))
            assert size != "4096" or read.rdd.getNumPartitions() > 4
            assert {(r["file"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in read.collect()} == {(f, k, x) for f, lines in texts.items() for k, x in enumerate(lines, 1)}
            got = files.json_lines(spark, str(folder), "n long").collect()
            assert {(r["file"].rsplit("/", 1)[1], r["line_no"], r["n"]) for r in got} == {("a.jsonl", k + 1, k) for k in range(3000)} | {("b.jsonl", 2, 1), ("b.jsonl", 6, 2)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert files.json_lines(spark, str(tmp_path / "none.jsonl"), "n long").count() == 0


def test_a_bad_line_is_named(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"n": 1}\n\n{"n": 2\n{"n": 3}')
    with pytest.raises(Exception, match=r"x\.jsonl at line 3"):
        files.json_lines(spark, str(tmp_path / "x.jsonl"), "n long").collect()
    with pytest.raises(Exception, match=r"x\.jsonl at line 3"):
        files.json_lines(spark, str(tmp_path / "x.jsonl"), "n long").count()
    kinds = {r["line_no"]: r["kind"] for r in files.parsed_lines(spark, str(tmp_path / "x.jsonl")).collect()}
    assert kinds == {1: "object", 3: "invalid", 4: "object"}


@pytest.mark.parametrize("kind", ["<f4", "<f8", ">f4", "<i4"])
def test_arrays_are_read_as_they_are(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    want = {"a.npy": (rng.standard_normal((9000, 3)) * 100).astype(kind), "b.npy": np.asfortranarray((rng.standard_normal((5, 4)) * 9).astype(kind)), "c.npy": np.zeros((0, 7), kind)}
    for name, array in want.items():
        np.save(tmp_path / name, array)
    found = spark.read.format("binaryFile").load(f"{tmp_path}/*.npy")
    read = files.npy_rows(found)
    assert read.schema["embedding"].dataType.elementType.simpleString() == {"f4": "float", "f8": "double", "i4": "int"}[kind[1:]]
    got = {}
    for r in read.orderBy("path", "row_idx").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append(r["embedding"])
    assert all(np.array_equal(np.array(got[n], kind), want[n]) for n in ("a.npy", "b.npy")) and "c.npy" not in got


def test_what_is_no_matrix(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.zeros(3))
    with pytest.raises(Exception, match="no matrix"):
        files.npy_rows(spark.read.format("binaryFile").load(f"{tmp_path}/x.npy")).collect()
    np.save(tmp_path / "y.npy", np.zeros((3, 3), np.float32))
    with pytest.raises(ValueError, match="different types"):
        files.npy_rows(spark.read.format("binaryFile").load(f"{tmp_path}/*.npy"))


def test_images_and_diagrams(spark):
    pages = [[], [{"x0": 1, "top": 2, "x1": 301, "bottom": 202, "width": 300, "height": 200, "name": "fig"}, {"width": "50", "height": "bad"}], [{"width": 2000.0, "height": 100}]]
    rows = spark.createDataFrame([("a", json.dumps(pages).encode()), ("none", None), ("empty", b"[]")], "path string, content binary")
    boxes = files.image_boxes(rows, lambda content: json.loads(content))
    got = sorted(map(tuple, boxes.collect()))
    assert got == [("a", 2, 1, "fig", 1.0, 2.0, 301.0, 202.0, 300.0, 200.0, 60000.0), ("a", 2, 2, "img_2_2", 0.0, 0.0, 0.0, 0.0, 50.0, 0.0, 0.0), ("a", 3, 1, "img_3_1", 0.0, 0.0, 0.0, 0.0, 2000.0, 100.0, 200000.0)]
    assert [r["name"] for r in files.diagrams(boxes).collect()] == ["fig"]
    with pytest.raises(ValueError):
        files.diagrams(boxes, 0)
