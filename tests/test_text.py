import os

import pytest
from pyspark.sql import functions as F

from folioroute import constants as K
from folioroute.functions import labels as L
from folioroute.functions import text as X


def values(spark, column, inputs, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("v"))).collect()]


SPLIT_PIECES = [
    [("1頁", "\none\n\n"), ("12頁", "\n\n")],
    [(None, "no marker")],
    [("3頁", "3頁")],
    [("4頁", " a ")],
    [(None, "")],
]

PATHS = ["a.b.pdf", ".pdf", "..pdf", "...a.pdf", "a", "a.", "/in/x.y/a", "/in/a.PDF", "/a.pdf",
         "//a.pdf", "x//a.pdf", "/in/.a.pdf", "a.pdf/", "", "/", "文件.名.pdf"]


def test_path_parts_follow_the_operating_system_rules(spark):
    bases = [os.path.basename(p) for p in PATHS]
    assert values(spark, X.base_name, PATHS) == bases
    assert values(spark, X.dir_name, PATHS) == [os.path.dirname(p) for p in PATHS]
    assert values(spark, X.file_stem, PATHS) == [os.path.splitext(b)[0] for b in bases]
    assert values(spark, X.extension, PATHS) == [os.path.splitext(b)[1] for b in bases]


def test_backslashes_separate_too_and_legacy_stem_cuts_at_last_dot(spark):
    assert values(spark, X.file_stem, [r"C:\in\a.b.pdf"]) == ["a.b"]
    assert values(spark, X.dir_name, [r"C:\in\a.b.pdf"]) == ["C:/in"]
    assert values(spark, X.legacy_stem, [".pdf", "a.b.pdf", "a"]) == ["", "a.b", "a"]


def test_join_path(spark):
    dirs = ["", "/", "/in", "in/"]
    assert values(spark, lambda d: X.join_path(d, F.lit("x.pdf")), dirs) == [
        os.path.join(d, "x.pdf") for d in dirs
    ]


def test_short_name(spark):
    assert values(spark, X.short_name, ["abcdef.pdf", "abcdefg.pdf", "a.pdf"]) == [
        "abcdef.pdf", "abc...efg.pdf", "a.pdf",
    ]


def test_strip_knows_unicode_whitespace_and_strip_spaces_only_blanks(spark):
    inputs = ["　a b\x1f", "\u2003x\n", "  ", "\x85y", "\u200bz"]
    assert values(spark, X.strip, inputs) == [s.strip() for s in inputs]
    assert values(spark, X.strip_spaces, inputs) == [s.replace(" ", "") for s in inputs]


def test_metadata_keeps_order_and_skips_empties(spark):
    rows = [([("t", "A"), ("u", ""), ("v", None), ("w", "B")],), (None,), ([],)]
    frame = spark.createDataFrame(rows, "m array<struct<key:string,value:string>>")
    assert [r[0] for r in frame.select(X.concat_metadata("m")).collect()] == ["AB", "", ""]


def test_choice_of_text(spark):
    frame = spark.createDataFrame(
        [("a", "b", "o"), ("", "b", "o"), ("", None, "o"), ("", "", ""), ("a", "b", "")],
        "a string, b string, o string",
    )

    def run(**how):
        return [r[0] for r in frame.select(X.choose_text("a", "b", "o", **how)).collect()]

    assert run() == ["a", "b", "o", "", "a"]
    assert run(has_ocr=False) == ["a", "b", "", "", "a"]
    assert run(force_ocr=True) == ["o", "o", "o", "", ""]
    # Forced without a recognizer never reaches the second reader.
    assert run(force_ocr=True, has_ocr=False) == ["a", "", "", "", "a"]


def test_ocr_lines_to_text(spark):
    kind = "r array<array<struct<box:array<array<double>>,text:string,confidence:double>>>"
    item = lambda t: (None, t, 0.5)
    rows = [([[item("a b"), item(None)], None, [item("c")]],), ([],), (None,)]
    frame = spark.createDataFrame(rows, kind)
    assert [r[0] for r in frame.select(X.flatten_ocr("r")).collect()] == ["a b\nc\n", "", ""]
    assert frame.select(X.flatten_ocr("r", True)).first()[0] == "ab\nc\n"


def test_page_markers_there_and_back(spark):
    frame = spark.createDataFrame([(1, "one\n"), (12, "")], "n int, t string")
    marked = [r[0] for r in frame.select(X.page_marker("n", "t")).collect()]
    assert marked == ["===== 第1頁 =====\none\n\n", "===== 第12頁 =====\n\n"]

    inputs = ["".join(marked), "no marker", "x===== 第3頁", "===== 第4頁 ===== a ===== b", ""]
    got = values(spark, X.split_page_markers, inputs)
    assert [[(r.page, r.content) for r in pieces] for pieces in got] == SPLIT_PIECES


@pytest.mark.parametrize("limit", [500, 1000])
def test_preview_counts_characters(spark, limit):
    inputs = ["x" * limit, "字" * (limit + 1), ""]
    assert values(spark, lambda v: X.preview(v, limit), inputs) == [
        t if len(t) <= limit else t[:limit] + K.PREVIEW_SUFFIX for t in inputs
    ]


def test_labels(spark):
    assert values(spark, L.status_label, [0, 1, 2, 3, 9, None], "int") == [
        "等待處理", "處理中", "已完成", "失敗", "9", None,
    ]
    assert values(spark, L.level_label, [10, 20, 30, 40, 50, 25], "int") == [
        "調試", "信息", "警告", "错误", "嚴重", "信息",
    ]


def test_epoch_text(spark):
    assert values(spark, L.format_epoch, [0.0, None, 1700000000.9], "double") == [
        "", "", "2023-11-14 22:13:20",
    ]


def test_durations_round_like_the_binary_value(spark):
    inputs = [0.0, 0.125, 1.005, 59.999, 60.0, 61.5, 3600.0, 3661.235, 7325.005, 90061.0, 1e7 + 0.1]
    assert values(spark, L.format_duration, inputs, "double") == [
        "0.00秒", "0.12秒", "1.00秒", "60.00秒", "1分0.00秒", "1分1.50秒", "1小時0分0.00秒", "1小時1分1.24秒",
        "2小時2分5.01秒", "25小時1分1.00秒", "2777小時46分40.10秒",
    ]


def test_display_state_and_progress(spark):
    frame = spark.createDataFrame(
        [(0, None), (0, 5), (1, 5), (2, None), (3, 1), (7, 1)], "s int, t int"
    )
    assert [r[0] for r in frame.select(L.display_state("s", "t")).collect()] == [
        "pending", "queued", "processing", "completed", "failed", None,
    ]
    frame = spark.createDataFrame([(1, 3), (0, 0), (5, 5)], "d int, t int")
    assert [r[0] for r in frame.select(L.progress_text("d", "t")).collect()] == ["33.3%", None, "100.0%"]
