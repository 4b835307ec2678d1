"""Sinks and included files."""

import pytest

from lodestack.sources import files


def test_text_files(spark, tmp_path):
    lines = spark.createDataFrame([("a", 1, "é", None), ("a", 0, "x", None), ("b", 0, None, "bad")], "path string, line_no int, line string, error string")
    images = files.text_image(lines)
    assert {r.path: (bytes(r.content), r.has_error) for r in images.collect()} == {"a": (b"x\r\n\xe9\r\n", False), "b": (b"\r\n", True)}
    wrote = files.write_files(images.withColumnRenamed("path", "file"), str(tmp_path / "out")).collect()
    assert {r.file: r.length for r in wrote} == {"a": 6, "b": 2}
    assert (tmp_path / "out/a").read_bytes() == b"x\r\n\xe9\r\n" and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b"]


def test_names_stay_below_the_folder(spark, tmp_path):
    rows = spark.createDataFrame([("../x", "t")], "file string, content string")
    with pytest.raises(Exception, match="outside the folder"):
        files.write_files(rows, str(tmp_path / "out")).collect()
    assert files.write_files(rows.limit(0), str(tmp_path / "out")).count() == 0


def test_includes(spark):
    lines = spark.createDataFrame(
        [("/d/m.bas", 0, "' $INCLUDE: 'b.bi'"), ("/d/m.bas", 1, "PRINT 1"), ("/d/m.bas", 2, "REM $include:'A.BI'"), ("/d/m.bas", 3, "'$INCLUDE:'B.BI'"), ("/e/m.bas", 0, "'$INCLUDE: 'gone.bi'"), ("/e/m.bas", 1, None)],
        "path string, line_no int, line string",
    )
    texts = spark.createDataFrame([("/d/B.BI", 0, "X = 1"), ("/d/B.BI", 1, "Y = 2"), ("/d/a.bi", 0, "Z = 3")], "path string, line_no int, line string")
    rows = {(r.path, r.line_no, r.which, r.included_no, r.line, r.error) for r in files.include_resolve(lines, texts).collect()}
    assert rows == {
        ("/d/m.bas", 0, 1, 0, "X = 1", None), ("/d/m.bas", 0, 1, 1, "Y = 2", None), ("/d/m.bas", 2, 2, 0, "Z = 3", None), ("/d/m.bas", 3, 1, 0, "X = 1", None),
        ("/d/m.bas", 3, 1, 1, "Y = 2", None), ("/e/m.bas", 0, 1, None, None, "include file not found: gone.bi"),
    }
