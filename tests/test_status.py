import random

from folioroute import constants as K
from folioroute.operators import status as S
from folioroute.sinks import status_table as stored
from folioroute.sources.tables import STATUS_SCHEMA

UPDATE = "path string, seq long, status int, message string, thread long, ts double"


# path, seq, status, message, thread, ts
WORKED = [
    ("a", 1, 0, "waiting", None, 5.0), ("a", 2, 1, None, 7, 6.0), ("a", 3, 1, "again", None, 8.0), ("a", 4, 2, "done", 7, 9.0),
    ("b", 1, 3, "bad", None, 4.0), ("b", 2, 1, None, 3, 5.0), ("b", 3, 3, "", 2, 6.0),
    ("c", 1, 9, None, None, 1.0),
    ("d", 1, 1, "x", None, 2.0), ("d", 2, 0, None, 4, 3.0),
    ("e", 1, 2, "early", 1, 1.5), ("e", 2, 2, None, None, 2.5),
]
# status, message, thread, start, end; 77 updates where no thread is given
FOLDED = {
    "a": (2, "done", 7, 6.0, 9.0),
    "b": (3, "", 2, 5.0, 6.0),
    "c": (9, "", 77, None, None),
    "d": (0, "x", 4, 2.0, None),
    "e": (2, "early", 77, None, 2.5),
}


def random_updates(seed, paths=20, number=400):
    rnd = random.Random(seed)
    return [
        (f"p{rnd.randint(0, paths)}", seq, rnd.choice([0, 1, 2, 3, 9]), rnd.choice([None, "m", "", f"x{seq}"]),
         rnd.choice([None, 1, 2]), float(rnd.randint(1, 10_000)))
        for seq in range(number)
    ]


def as_rows(frame):
    return {r.path: (r.status, r.message, r.thread, r.start_time, r.end_time) for r in frame.collect()}


def test_fold_of_worked_updates(spark):
    frame = spark.createDataFrame(WORKED, UPDATE)
    assert as_rows(S.latest_status(frame.repartition(5), 77)) == FOLDED
    assert as_rows(S.latest_status(frame, None))["c"] == (9, "", None, None, None)
    for cut in range(5):
        before = S.latest_status(frame.where(f"seq < {cut}"), 77)
        merged = S.merge_status(before, S.fold_updates(frame.where(f"seq >= {cut}"), 77))
        assert as_rows(merged) == FOLDED


def test_fold_does_not_depend_on_the_order_of_rows(spark):
    for seed in range(3):
        updates = random_updates(seed)
        first = as_rows(S.latest_status(spark.createDataFrame(updates, UPDATE), 77))
        random.Random(seed + 50).shuffle(updates)
        assert as_rows(S.latest_status(spark.createDataFrame(updates, UPDATE).repartition(5), 77)) == first


def test_hot_path(spark):
    updates = [("hot" if i % 3 else f"p{i % 9}", i, i % 4, None, i % 2 or None, float(i)) for i in range(3000)]
    frame = spark.createDataFrame(updates, UPDATE).repartition(8)
    assert as_rows(S.latest_status(frame)) == {
        "hot": (3, "", 1, 1.0, 2999.0), "p0": (1, "", 1, 9.0, 2979.0),
        "p3": (3, "", 1, 21.0, 2991.0), "p6": (2, "", 0, 33.0, 2994.0),
    }


def test_insert_missing_once(spark):
    table = spark.createDataFrame([("a", 2, "done", 1, 1.0, 2.0)], STATUS_SCHEMA)
    paths = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "path string")
    assert S.missing_rows(table, paths).count() == 2
    rows = as_rows(S.insert_missing(table, paths))
    assert rows == {
        "a": (2, "done", 1, 1.0, 2.0),
        "b": (0, K.WAITING_MESSAGE, None, None, None),
        "c": (0, K.WAITING_MESSAGE, None, None, None),
    }
    assert S.distinct_paths(paths).count() == 3


def table(spark, rows):
    return spark.createDataFrame([(p, s, f"m-{p}", t, 0.0, None) for p, s, t in rows], STATUS_SCHEMA)


def test_counts(spark):
    frame = table(spark, [("a", 0, None), ("b", 0, 1), ("c", 1, 1), ("d", 2, 1), ("e", 3, 1), ("f", 9, 1)])
    assert S.status_counts(frame).first().asDict() == dict(
        pending=1, queued=1, processing=1, completed=1, failed=1, total=5
    )
    assert S.simple_status_counts(frame).first().asDict() == dict(
        pending=2, processing=1, completed=1, failed=1, total=5
    )
    assert S.all_done(frame).first().finished is False
    assert S.all_done(frame.where("path = 'd'")).first().finished is True
    assert S.all_done(frame.where("false")).first().finished is False
    assert S.progress(frame).first().progress == "16.7%"
    assert S.progress(frame.where("false")).first().progress is None


def test_lookup_and_pending(spark):
    frame = table(spark, [("c", 0, None), ("a", 0, 1), ("b", 2, 1)])
    assert S.status_of(frame, "b").first().status == 2 and S.status_of(frame, "z").count() == 0
    assert [r.path for r in S.pending(frame, 1).collect()] == ["a"]
    assert {r.path for r in S.pending(frame).collect()} == {"a", "c"}


def test_sample_per_state(spark):
    frame = table(spark, [(f"/d/file-{i:04d}.pdf", 3 if i < 7 else 2, 1) for i in range(9)])
    rows = sorted((r.state, r.position, r.shown, r.more) for r in S.state_sample(frame, 3).collect())
    assert rows == [
        ("completed", 1, "fil...007.pdf", 0), ("completed", 2, "fil...008.pdf", 0),
        ("failed", 1, "fil...000.pdf", 4), ("failed", 2, "fil...001.pdf", 4),
        ("failed", 3, "fil...002.pdf", 4),
    ]


def test_recent_errors_are_of_the_error_level_only(spark):
    entries = [("2024-01-0%d" % d, level, "t", f"{level}{d}") for d in (1, 2, 3) for level in ("错误", "嚴重", "錯誤", "信息")]
    log = spark.createDataFrame(entries, "timestamp string, level string, thread string, message string")
    assert [r.message for r in S.recent_errors(log, 2).collect()] == ["错误3", "错误2"]
    tied = spark.createDataFrame([("t", "错误", str(i), i) for i in range(9)], "timestamp string, level string, message string, seq int")
    assert [r.seq for r in S.recent_errors(tied, 3, order="seq").collect()] == [0, 1, 2]


def test_run_summary(spark):
    frame = spark.createDataFrame(
        [(True, True, 10.0, 12.0), (True, False, 11.0, 75.5), (False, False, 12.0, 13.0)],
        "ok boolean, matched boolean, start_time double, end_time double",
    )
    row = S.run_summary(frame).first()
    assert (row.searched, row.succeeded, row.matched, row.elapsed) == (3, 2, 1, "1分5.50秒")


def test_export_rows(spark):
    frame = spark.createDataFrame(
        [("a", 2, "ok", 5, 1.0, 0.0), ("b", 9, None, None, None, None)], STATUS_SCHEMA
    )
    rows = S.export_rows(frame).collect()
    assert S.export_rows(frame).columns == K.STATUS_EXPORT_HEADER
    assert tuple(rows[0]) == ("a", "已完成", "ok", "5", "1970-01-01 00:00:01", "")
    assert tuple(rows[1]) == ("b", "9", None, None, "", "")


def test_stored_table_merges_only_touched_folders(spark, tmp_path):
    """Merges equal the join of whole tables; folders without changed paths keep their files; a merge repeats safely."""
    columns = "path string, status int, message string, thread long, start_time double, end_time double"
    old = [(f"p{i}", i % 4, f"m{i}", i % 3 or None, float(i) if i % 2 else None, None) for i in range(300)]
    new = [(f"p{i}", 3, None if i % 2 else "late", None, 7.0, 9.0) for i in range(0, 40, 10)] + [("q1", 1, None, 5, 1.0, None)]
    before, changes = spark.createDataFrame(old, columns), spark.createDataFrame(new, columns)
    table = f"{tmp_path}/table"
    stored.write_status_table(before, table, 32)
    files = lambda: {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.parquet") if p.is_file()}
    first = files()
    want = sorted(map(tuple, S.merge_status(before, changes).collect()))
    assert sorted(map(tuple, S.merge_small(before, changes).collect())) == want
    for _ in range(2):
        stored.merge_into_status_table(spark, table, changes, 32)
        assert sorted(map(tuple, stored.read_status_table(spark, table).collect())) == want
    kept = first & files()
    assert len(kept) >= 32 - len(new) and first - kept
    plan = stored.merged_buckets(spark, table, changes.hint("broadcast"), 32)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "Exchange hash" not in plan
