"""Rows by owner, replaced in the folders of these owners only."""

import pytest

from poolwright.sources import tables


def files_of(path):
    return {f"{f.parent.name}/{f.name}" for f in path.glob("_bucket=*/*.parquet")}


def test_replacing_rewrites_the_folders_of_the_owners_only(spark, tmp_path):
    path = tmp_path / "owned"
    schema = "owner string, turn int, text string, _bucket_of string"
    base = [(f"o{k}", t, f"{k}-{t}", "x") for k in range(40) for t in range(3)]
    tables.write_owned(spark.createDataFrame(base, schema), str(path), 8)
    before = files_of(path)
    new = spark.createDataFrame([("o1", 0, "new", None), ("o2", 0, "not asked for", None), ("fresh", 0, "first", None)], schema)
    owners = spark.createDataFrame([("o1",), ("o3",), ("o3",), ("fresh",)], "owner string")
    for _ in range(2):  # a second run changes nothing
        tables.replace_owned(spark, str(path), new, owners, 8)
        got = sorted(tuple(r) for r in tables.read_owned(spark, str(path)).select("owner", "turn", "text").collect())
        want = [r[:3] for r in base if r[0] not in ("o1", "o3")] + [("o1", 0, "new"), ("fresh", 0, "first")]
        assert got == sorted(want)
    touched = {f.split("/")[0] for f in before - files_of(path)}
    assert 1 <= len(touched) <= 3
    assert {f for f in before if f.split("/")[0] not in touched} <= files_of(path)


def test_a_folder_that_gets_empty_is_cleared(spark, tmp_path):
    path = str(tmp_path / "owned")
    rows = spark.createDataFrame([("a", 0, "x")], "owner string, turn int, text string")
    tables.write_owned(rows, path, 4)
    tables.replace_owned(spark, path, rows.limit(0), rows.select("owner"), 4)
    assert tables.read_owned(spark, path).count() == 0
    with pytest.raises(ValueError, match="5 buckets"):
        tables.replace_owned(spark, path, rows, rows.select("owner"), 5)
