import csv
import glob

import pytest
from pyspark.sql import functions as F

from folioroute import constants as K
from folioroute.operators import perfile, protect
from folioroute.sinks import writers as W
from folioroute.sources import tables
from folioroute.sources.rules import make_rules
from folioroute.sources.tables import LOG_SCHEMA, STATUS_SCHEMA


def read_csv(folder, encoding="utf-8-sig"):
    rows = []
    for part in sorted(glob.glob(f"{folder}/part-*.csv")):
        with open(part, encoding=encoding, newline="") as file:
            rows += list(csv.reader(file))
    return rows


def test_status_export(spark, tmp_path):
    frame = spark.createDataFrame(
        [("a,b", 2, 'say "hi"\\', 5, 1.0, 0.0), ("c", 9, "", None, None, None)], STATUS_SCHEMA
    ).coalesce(1)
    W.export_status(frame, f"{tmp_path}/s")
    assert read_csv(f"{tmp_path}/s") == [
        K.STATUS_EXPORT_HEADER,
        ["a,b", "已完成", 'say "hi"\\', "5", "1970-01-01 00:00:01", ""],
        ["c", "9", "", "", "", ""],
    ]
    assert read_csv(f"{tmp_path}/s", "utf-8")[0][0].startswith(K.BYTE_ORDER_MARK)


def test_log_export(spark, tmp_path):
    frame = spark.createDataFrame([("t", None, None, "m,n"), ("u", "错误", "w", None)], LOG_SCHEMA).coalesce(1)
    assert W.export_log(frame, f"{tmp_path}/l", byte_order_mark=False) is True
    assert read_csv(f"{tmp_path}/l") == [
        K.LOG_EXPORT_HEADER, ["t", "未知", "未知", "m,n"], ["u", "错误", "w", ""],
    ]
    assert W.export_log(frame.where("false"), f"{tmp_path}/none") is False
    assert glob.glob(f"{tmp_path}/none*") == []


def test_tables_are_read_back(spark, tmp_path):
    status = spark.createDataFrame([("a", 2, "m", 5, 1.0, None)], STATUS_SCHEMA)
    status.write.parquet(f"{tmp_path}/status")
    assert tables.read_status(spark, f"{tmp_path}/status").collect() == status.collect()
    log = spark.createDataFrame([("t", "错误", "w", "m")], LOG_SCHEMA)
    log.write.parquet(f"{tmp_path}/log")
    assert tables.read_log(spark, f"{tmp_path}/log").collect() == log.collect()


def test_sidecars(spark, tmp_path):
    texts = spark.createDataFrame([("/in/a.pdf", "A"), ("/in/b.c.pdf", "B"), ("/in/d.pdf", "")], "path string, text string")
    manifest = spark.createDataFrame([("/in/a.pdf", "/in/new_1.pdf"), ("/in/b.c.pdf", None)], "path string, target_path string")
    W.write_text_sidecars(texts, manifest, f"{tmp_path}/side")
    rows = spark.read.parquet(f"{tmp_path}/side").collect()
    assert sorted(tuple(r) for r in rows) == [("/in/b.c_ocr.txt", "B"), ("/in/new_1_ocr.txt", "A")]


def test_chunk_and_manifest_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("/in/a.pdf", 1, "x"), ("/in/b.pdf", 1, "y")], "path string, chunk int, text string")
    W.write_chunks(chunks, f"{tmp_path}/chunks", by_source=True)
    assert len(glob.glob(f"{tmp_path}/chunks/path=*")) == 2
    W.write_manifest(chunks, f"{tmp_path}/manifest")
    assert spark.read.parquet(f"{tmp_path}/manifest").count() == 2


def test_protected_content(spark):
    rules = make_rules(
        [dict(pattern="a", name="x", user_pass="user", owner_pass="owner"), dict(pattern="b", name="y"),
         dict(pattern="c", name="z", owner_pass="only-owner"), dict(pattern="d", name="u", user_pass="only-user")]
    )
    rows = spark.createDataFrame([(0, b"zero"), (1, b"one"), (2, b"two"), (3, b"three"), (None, b"none")], "rule_id int, content binary")
    stored = protect.protect_content(rows, rules)
    stored.write.format("noop").mode("overwrite").save()
    assert stored.columns == ["rule_id", "content", "owner_key", "protected"]
    raw = {r.rule_id: bytes(r.content) for r in stored.collect()}
    assert raw[1] == b"one" and raw[None] == b"none" and raw[0] != b"zero" and raw[2] != b"two"

    def opened(password, **how):
        frame = protect.open_content(stored, password, **how)
        return {r.rule_id: None if r.content is None else bytes(r.content) for r in frame.collect()}

    assert opened("user")[0] == b"zero" and opened("user")[2] is None
    assert opened("owner", owner=True)[0] == b"zero" and opened("owner")[0] is None
    assert opened("only-owner", owner=True)[2] == b"two" and opened("")[2] == b"two"
    assert opened("wrong") == {0: None, 1: b"one", 2: None, 3: None, None: b"none"}
    # Without an owner password nobody opens a file as its owner.
    assert opened("only-user")[3] == b"three" and opened("", owner=True)[3] is None


def test_function_per_file(spark):
    files = spark.createDataFrame([("a", 2), ("b", 0), ("c", 5)], "path string, n int").repartition(2)
    results = perfile.map_files(files, lambda row: 10 // row["n"], "int")
    got = {r.path: (r.ok, r.result) for r in results.collect()}
    assert got == {"a": (True, 5), "b": (False, None), "c": (True, 2)}
    assert results.where("path = 'b'").first().error == "integer division or modulo by zero"
    assert tuple(perfile.success_count(results).first()) == (2, 3)
    calls = spark.sparkContext.accumulator(0)

    def divide(row):
        calls.add(1)
        return 10 // row["n"]

    ended = {r.path: (r.status, r.message) for r in perfile.result_status(perfile.map_files(files, divide, "int")).collect()}
    assert calls.value == 3
    assert ended["a"] == (2, K.DONE_MESSAGE)
    assert ended["b"] == (3, K.FAILED_MESSAGE_PREFIX + "integer division or modulo by zero")


def test_function_built_once_per_task(spark):
    def setup():
        calls = []

        def call(row):
            calls.append(row["path"])
            return len(calls)

        return call

    files = spark.range(50).select(F.col("id").cast("string").alias("path")).coalesce(1)
    results = perfile.map_files(files, None, "int", setup=setup)
    assert max(r.result for r in results.collect()) == 50


@pytest.mark.parametrize("kind", ["string", "struct<a:int,b:string>"])
def test_result_types(spark, kind):
    files = spark.createDataFrame([("p",)], "path string")
    value = "text" if kind == "string" else {"a": 1, "b": "x"}
    row = perfile.map_files(files, lambda r: value, kind).first()
    assert (row.result if kind == "string" else row.result.asDict()) == value


def test_sidecar_files_are_whole_or_not_there(spark, tmp_path):
    """One marked file per text; a failed run leaves no halves, a repeated one the same files."""
    texts = spark.createDataFrame([("/in/a.pdf", "één"), ("/in/sub/b.pdf", "two\r\n"), ("/in/c.pdf", "")], "path string, text string")
    manifest = spark.createDataFrame([("/in/a.pdf", "/in/new.pdf"), ("/in/sub/b.pdf", None)], "path string, target_path string")
    for _ in range(2):
        W.write_sidecar_files(texts, manifest, str(tmp_path))
    found = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"in/new_ocr.txt": b"\xef\xbb\xbf" + "één".encode(), "in/sub/b_ocr.txt": b"\xef\xbb\xbftwo\r\n"}
    (tmp_path / "in" / "sub" / "d_ocr.txt").mkdir()  # nothing can be moved there
    more = spark.createDataFrame([("/in/sub/d.pdf", "x"), ("/in/sub/b.pdf", "new")], "path string, text string").coalesce(1)
    with pytest.raises(Exception, match="d_ocr.txt"):
        W.write_sidecar_files(more, manifest, str(tmp_path))
    assert not list(tmp_path.rglob("*.part"))
