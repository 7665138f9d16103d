"""Streams over a table of several files, which are in no order of time."""

import os

import compare
import pyarrow.parquet as pq

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_no_file_of_a_table_comes_too_late(spark, tmp_path):
    for name in compare.TABLES:
        if name != "events":
            os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    rows = pq.read_table(f"{SF}/events.parquet").sort_by([("ts", "descending")])
    (tmp_path / "events.parquet").mkdir()
    for i in range(3):
        path = tmp_path / "events.parquet" / f"part-{i}.parquet"
        pq.write_table(rows.slice(i * (rows.num_rows // 3), rows.num_rows // 3 if i < 2 else None), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    query = "st3_pairwise"
    assert compare.same(entry.queries()[query](spark, str(tmp_path)), compare.connect(str(tmp_path)), entry.oracle_sql()[query]) == ""
