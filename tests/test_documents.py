"""Named files: round trips, documents over many tasks, failed tasks, interrupted moves."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from siteweave.sources import documents as DOC
from siteweave.sources import files


def read_tree(path):
    return {os.path.relpath(os.path.join(d, n), path): open(os.path.join(d, n), encoding="utf-8", newline="").read()
            for d, _, names in os.walk(path) for n in names if not n.startswith(("_", "."))}


def test_names():
    for name in ("a.com", "", ".x", "_y", "a/b\\c\n", "é 日本", "100%", "%2G"):
        s = DOC.segment(name)
        assert "/" not in s and s[0] not in "._" and DOC.original(s) == name
    long = "d" * 300 + "_comprehensive_summary.txt"
    assert DOC.segment(long).endswith("_comprehensive_summary.txt") and len(DOC.segment(long)) <= 200 and DOC.segment(long) != DOC.segment("e" + long)


def test_a_large_document_runs_over_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    rows = [("hot.com", "big.txt", i, f"line {i} é\n") for i in range(5000)] + [(f"s{i % 40}.com", "a.txt", i, f"{i};") for i in range(400)] + [("s1.com", "b.txt", 0, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "folder string, file_name string, at int, text string").repartition(7)
    out = str(tmp_path / "out")
    assert DOC.write_pieces(df, ["at"], out) == 42
    want = {}
    for folder, name, _, text in sorted(rows, key=lambda r: r[:3]):
        want[f"{folder}/{name}"] = want.get(f"{folder}/{name}", "") + (text or "")
    assert read_tree(out) == want
    assert not [n for n in os.listdir(out) if n.startswith("_temp")] and json.load(open(f"{out}/_SUCCESS")) == {"documents": 42}
    # the hot document was not written by one task
    DOC.register(spark)
    plan = df.repartitionByRange(4, "folder", "file_name", "at").where("folder = 'hot.com'").select(F.spark_partition_id()).distinct().count()
    assert plan > 1
    pieces = spark.read.format("site_documents").option("pieceBytes", "1001").load(out)
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.folder, r.file_name, r.piece)):
        assert len(r.text.encode()) <= 1004
        got[f"{r.folder}/{r.file_name}"] = got.get(f"{r.folder}/{r.file_name}", "") + r.text
    assert got == want


def test_reports_as_a_format(spark, tmp_path):
    rows = [("b.com", "b.com_summary.txt", "B\r\nx"), ("a.com", "a.com_summary.txt", "A é"), ("", "x_summary.txt", None), ("a.com", "other.md", "no")]
    df = spark.createDataFrame(rows, "folder string, file_name string, content string").coalesce(1).sortWithinPartitions("folder", "file_name")
    DOC.register(spark)
    out = str(tmp_path / "out")
    df.write.format("site_reports").mode("append").save(out)
    got = spark.read.format("site_reports").option("suffix", "_summary.txt").load(out).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, c or "") for a, b, c in rows if b.endswith(".txt"))
    df.where("folder = 'b.com'").withColumn("content", F.lit("new")).write.format("site_reports").mode("append").save(out)
    assert read_tree(out)["b.com/b.com_summary.txt"] == "new" and len(read_tree(out)) == 4


def test_pieces_out_of_order_are_refused(spark, tmp_path):
    DOC.register(spark)
    df = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("a", "x", "3")], "folder string, file_name string, content string").coalesce(1)
    with pytest.raises(Exception, match="sort the rows"):
        df.write.format("site_reports").mode("append").save(str(tmp_path / "out"))
    assert files.files(str(tmp_path / "out")) == [] and not list(tmp_path.glob("out/_temporary*"))


def test_failed_task_leaves_nothing(spark, tmp_path):
    df = spark.range(100).select(F.lit("a").alias("folder"), F.concat(F.lit("f"), "id").alias("file_name"), F.lit(1).alias("at"),
                                 F.when(F.col("id") == 77, F.raise_error(F.lit("stop here")).cast("string")).otherwise("t").alias("text"))
    with pytest.raises(Exception, match="stop here"):
        DOC.write_pieces(df, ["at"], str(tmp_path / "out"))
    assert files.files(str(tmp_path / "out")) == []


def test_an_interrupted_move_is_ended(spark, tmp_path):
    """Some steps were carried out before the job stopped: the next call does the others and loses nothing."""
    DOC.register(spark)
    out = str(tmp_path / "out")
    rows = [("hot", "big", i, f"{i} ") for i in range(3000)] + [(f"s{i}", "f", 0, str(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "folder string, file_name string, at int, text string").repartitionByRange(6, "folder", "file_name", "at")
    df = df.sortWithinPartitions("folder", "file_name", "at")
    df.select("folder", "file_name", F.lit(0).alias("piece"), "text").write.format("site_documents").mode("append").option("defer", "true").save(out)
    hidden = next(tmp_path.glob("out/_temporary-*"))
    assert files.files(out) == []
    todo = DOC.steps(json.load(open(hidden / DOC.MANIFEST))["attempts"])
    assert any("join" in s for s in todo)
    for step in todo[::2]:
        DOC.place(out, hidden.name.removeprefix("_temporary-"), step)
    (hidden / "000000-of-a-lost-attempt" / "s0").mkdir(parents=True)
    (hidden / "000000-of-a-lost-attempt" / "s0" / "f").write_text("wrong")
    DOC.place_all(spark, out)
    tree = read_tree(out)
    assert tree["hot/big"] == "".join(f"{i} " for i in range(3000)) and {k: v for k, v in tree.items() if k != "hot/big"} == {f"s{i}/f": str(i) for i in range(30)}
    assert DOC.place_all(spark, out) == 0
