import pytest
from pyspark.sql import functions as F

from tidemark.sources import commitlog as log
from tidemark.sources import files

BLOCK = """abc|p1 p2|Ann|a@x|Cee|1600000000|1600000100|KORV-12 fix x#7 and KORV-12
 create mode 100644 src/New.java
 delete mode 100644 src/Gone.java
 rename src/{a => b}/C.java (97%)
 copy base/D.java => base/E.java (100%)
3\t1\tsrc/New.java
0\t9\tsrc/Gone.java
1\t1\tsrc/{a => b}/C.java
2\t0\tbase/D.java => base/E.java
5\t4\tsrc/deep/er/M.java
-\t-\timg.png

diff --git a/src/New.java b/src/New.java
+x
"""


def test_log(spark, tmp_path):
    text = log.DELIMITER + BLOCK + log.DELIMITER + "bad|header\n" + log.DELIMITER + "d|| | | |x|2|m\n1\t1\tA.java\n" + log.DELIMITER + "e||n|m|c|1|2|only text\n1\t1\tx.txt\n" + log.DELIMITER + "f||n|m|c|1|2|\n7\t0\tA.java\n"
    (tmp_path / "log.txt").write_text(text)
    rows = {r["commit_id"]: r for r in log.parse_log(log.read_log(spark, str(tmp_path / "log.txt"))).collect()}
    assert set(rows) == {"abc", "f"}
    r = rows["abc"]
    assert r["parents"] == ["p1", "p2"] and rows["f"]["parents"] == []
    assert r["files_added_list"] == ["src/New.java"] and r["files_deleted_list"] == ["src/Gone.java"]
    assert [tuple(x) for x in r["files_renamed_list"]] == [("src/a/C.java", "src/b/C.java")]
    assert r["files_copied_list"] == ["base/E.java"] and r["files_modified_list"] == ["src/deep/er/M.java"]
    assert (r["lines_added"], r["lines_deleted"], r["max_directory_depth"], r["files_changed_count"]) == (5, 4, 3, 5)
    assert r["linked_issues"] == ["#7", "KORV-12"] and r["diff"].startswith("diff --git") and r["authored_datetime"] == "2020-09-13T12:26:40+00:00"
    everything = log.parse_log(log.read_log(spark, str(tmp_path / "log.txt")), scope="all").where("commit_id = 'abc'").collect()[0]
    assert (everything["lines_added"], everything["lines_deleted"]) == (11, 15)


@pytest.mark.parametrize(
    "path,old,new",
    [("src/{a => b}/C.java", "src/a/C.java", "src/b/C.java"), ("x.java => y.java", "x.java", "y.java"), ("{ => d}/e.java", "/e.java", "d/e.java"), ("f.java", "f.java", "f.java")],
)
def test_rename_paths(spark, path, old, new):
    df = spark.createDataFrame([(path,)], "p string")
    assert tuple(df.select(log.old_path(F.col("p")), log.new_path(F.col("p"))).collect()[0]) == (old, new)


def test_status_lines(spark):
    df = spark.createDataFrame([("M\ta.java",), ("R097\told.java\tnew.java",), ("X\tq",)], "l string")
    got = [None if r[0] is None else [tuple(x) for x in r[0]] for r in df.select(log.status_lines(F.col("l"))).collect()]
    assert got == [[("M", "a.java")], [("D", "old.java"), ("A", "new.java")], None]


def test_label_csv(spark, tmp_path):
    head = "commit_id,project,buggy,fix,year,author_date,la,ent,extra"
    (tmp_path / "l.csv").write_text(head + "\nc1,p,True,False,2020,1600000000,3.0,0.5,z\nc2,p,False,,x,,,\n")
    r = {x["commit_id"]: x for x in files.typed_labels(files.read_labels(spark, str(tmp_path / "l.csv"))).collect()}
    assert (r["c1"]["buggy"], r["c1"]["la"], r["c1"]["ent"], r["c1"]["year"]) == (True, 3, 0.5, 2020)
    assert (r["c2"]["buggy"], r["c2"]["la"], r["c2"]["author_date"]) == (False, None, None)
    (tmp_path / "bad.csv").write_text("commit_id,project\nc,p\n")
    with pytest.raises(ValueError):
        files.read_labels(spark, str(tmp_path / "bad.csv"))


def test_files_and_snapshots(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/A.java").write_text("class A {}")
    (tmp_path / "src/B.java").write_text("x" * 700_000)
    (tmp_path / "src/c.txt").write_text("no")
    assert [r["text"] for r in files.read_blobs(spark, str(tmp_path / "src")).collect()] == ["class A {}"]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string")
    files.write_snapshot(df, str(tmp_path), "t", "1")
    files.write_snapshot(df.where("id = 1"), str(tmp_path), "t", "2")
    assert files.read_snapshot(spark, str(tmp_path), "t", "1").count() == 2
    assert {tuple(r) for r in files.read_snapshot(spark, str(tmp_path), "t").groupBy("version").count().collect()} == {(1, 2), (2, 1)}
    files.overwrite_partition(df, str(tmp_path / "parts"), ["p"])
    files.overwrite_partition(spark.createDataFrame([(9, "b")], "id int, p string"), str(tmp_path / "parts"), ["p"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "parts")).collect()} == {(1, "a"), (9, "b")}
    calls = []
    for _ in range(2):
        got = files.cached(spark, str(tmp_path / "cache"), lambda: calls.append(1) or df)
    assert got.count() == 2 and calls == [1]
    files.write_long_csv(df, str(tmp_path / "csv"))
    files.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_small_readers(spark):
    trees = spark.createDataFrame([("r1", "a.java"), ("r1", "b.txt"), ("r2", "c.md")], "ref string, path string")
    assert {tuple(r) for r in files.tree_count(trees).collect()} == {("r1", 1), ("r2", 0)}
    log_rows = spark.createDataFrame([(i, float(i)) for i in range(1, 201)], "i int, s double")
    r = files.tail_rate(log_rows, "i", "s", 100, 300).collect()[0]
    assert (r["mean_s"], r["done"], r["to_go_s"]) == (150.5, 200, 15050.0)
    blobs = spark.createDataFrame([("r", "p", "second", "S"), ("r", "p", "first", "F")], "ref string, path string, root string, text string")
    assert files.blobs_at(spark.createDataFrame([("r", "p"), ("r", "q")], "ref string, path string"), blobs, ["first", "second"]).orderBy("path").collect()[0]["text"] == "F"
    snaps = spark.createDataFrame([(1, 0), (2, 5), (3, 9)], "o int, n int")
    assert files.first_ready(snaps, "o", "n", 5, 3).collect()[0]["o"] == 2
