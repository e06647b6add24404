from __future__ import annotations

import os

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F
from test_sources import TREE, put

from codetrials.sources import files, folders


@pytest.mark.parametrize("layout", sorted(TREE))
def test_same_files_as_the_other_scan(spark, tmp_path, layout):
    names, impls, suites = TREE[layout]
    root = tmp_path / "build corpus"
    for name in names:
        put(root, name, f"text of {name}\n")
    found = folders.scan_impls(spark, str(root), layout)
    assert rows(found.select("task_id", "impl")) == impls
    assert rows(found) == rows(files.scan_impl_files(spark, str(root), layout).select(*found.columns))
    assert rows(folders.scan_tests(spark, str(root), layout).select("task_id")) == [(s,) for s in suites]


def test_hidden_names_come_with_their_content(spark, tmp_path):
    for name in ("7/m.py", "7/_helper.py", "7/__init__.py", "7/.b.py", "8/test.py"):
        put(tmp_path, f"py/{name}", f"# {name}")
    put(tmp_path, "jav/3/code/sub/_A.java", "class A {}")
    put(tmp_path, "jav/3/code/_sub/B.java", "class B {}")
    found = folders.scan_impls(spark, str(tmp_path / "py"), "python")
    assert rows(found.select("path", "content")) == [(f"7/{n}.py", f"# 7/{n}.py") for n in (".b", "__init__", "_helper", "m")]
    java = folders.scan_impls(spark, str(tmp_path / "jav"), "java")
    assert rows(java.select("path", "content")) == [("3/code/_sub/B.java", "class B {}"), ("3/code/sub/_A.java", "class A {}")]


def test_tasks_reach_the_listing(spark, tmp_path):
    """Folders that the filter leaves out are not opened: one of them cannot be."""
    for k in range(6):
        put(tmp_path, f"{k}/m.py", f"# {k}")
    for wanted in (["1", "4", "none", "..", "a/b"], F.col("task_id").isin("1", "4"), (F.col("task_id") == "1") | (F.col("task_id") == "4")):
        found = folders.scan_impls(spark, str(tmp_path), "python", wanted)
        assert rows(found.select("task_id", "content")) == [("1", "# 1"), ("4", "# 4")]
    assert found.rdd.getNumPartitions() == 1
    assert rows(folders.scan_impls(spark, str(tmp_path), "python", F.col("task_id") == "3").select("path")) == [("3/m.py",)]


def test_folders_are_partitions(spark, tmp_path, monkeypatch):
    for k in range(10):
        put(tmp_path, f"t{k}/m.py", "x")
    monkeypatch.setattr(folders, "FOLDERS", 3)
    found = folders.scan_impls(spark, str(tmp_path), "python")
    assert found.rdd.getNumPartitions() == 4 and found.count() == 10
    assert "task_folders" in plan(found)


def test_odd_files(spark, tmp_path):
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "latin.py").write_bytes(b"\xe9")
    (tmp_path / "7" / "empty.py").write_bytes(b"")
    os.symlink(tmp_path / "nowhere", tmp_path / "7" / "broken.py")
    put(tmp_path, "file.py", "not in a folder")
    got = {r.impl: (r.content, r.reject_reason) for r in folders.scan_impls(spark, str(tmp_path), "python").collect()}
    assert got["latin"] == ("�", None) and got["empty"] == ("", None)
    assert "broken" not in got or got["broken"][1]
    assert folders.scan_impls(spark, str(tmp_path / "none"), "python").collect() == []


def test_files_are_written_under_their_names(spark, tmp_path):
    df = spark.createDataFrame([("a b/_x.py", "é\n"), ("a b/.y", ""), ("c/d/e.txt", None)], "path string, content string").repartition(3)
    for _ in range(2):
        folders.write_files(df, str(tmp_path / "out"))
    found = {str(p.relative_to(tmp_path / "out")): p.read_text(encoding="utf-8") for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"a b/_x.py": "é\n", "a b/.y": "", "c/d/e.txt": ""}
    for bad in ("../x", "/x", "a/../x", "", None):
        with pytest.raises(Exception, match="not a path below the root"):
            folders.write_files(spark.createDataFrame([(bad, "x")], "path string, content string"), str(tmp_path / "out"))
