"""The plans the engine relies on at scale."""

import re

from pyspark.sql import functions as F

from folioroute.operators import legacy, matching, pages
from folioroute.operators import status as S
from folioroute.plans import catalogue as C
from folioroute.plans import routing
from folioroute.sources.rules import make_rules


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_routing_is_one_pass_without_shuffle_or_python(spark, sf001):
    text = plan(C.route_first_match(spark, sf001))
    assert "Exchange hash" not in text and "Python" not in text and "SortMergeJoin" not in text
    assert text.count("FileScan") == 1


def test_routing_by_many_rules_has_no_join_at_all(spark, sf001):
    text = plan(C.route_many_rules(spark, sf001))
    assert "Join" not in text and "Exchange" not in text and "from_json" not in text


def test_matches_are_counted_once_and_unfolded_without_the_text(spark, sf001):
    text = plan(C.match_matrix(spark, sf001))
    assert "Join" not in text and "Exchange" not in text
    generate = next(line for line in text.splitlines() if "Generate" in line)
    assert "text#" not in generate
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "regexp" not in scan


def test_columns_no_rule_needs_are_not_read(spark, sf001):
    files = C.files(spark, sf001)
    text = plan(routing.route(files, make_rules([dict(pattern="7", name="x", target="檔名")])))
    schema = re.search(r"ReadSchema: (\S+)", text)[1]
    assert "text" not in schema and "lang" not in schema


def test_no_text_in_any_shuffle_of_the_manifest(spark, sf001):
    frame = C.manifest(spark, sf001)
    text = plan(frame)
    exchanges = [i for i, line in enumerate(text.splitlines()) if "Exchange hash" in line]
    assert len(exchanges) == 2
    below = [text.splitlines()[i + 1] for i in exchanges]
    assert all("text#" not in line.split("AS", 1)[0] for line in below if "Project" in line)
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_no_cross_join_in_any_query(spark, sf001):
    for name in ("manifest_families", "name_exhausted", "legacy_claim", "state_sample", "match_matrix"):
        text = plan(C.QUERIES[name](spark, sf001))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_claims_are_combined_before_the_shuffle(spark, sf001):
    """What the rounds leave is one combined aggregation over slim rows, in no single task and without Python."""
    text = plan(C.legacy_claim(spark, sf001))
    assert "partial_min" in text and "SinglePartition" not in text
    assert "Window" not in text and "Python" not in text and "InPandas" not in text


def test_running_total_has_no_single_task_over_the_rows(spark, sf001):
    frame = spark.range(1000).select(F.col("id").cast("string").alias("path"), F.lit(1).alias("n"))
    text = plan(legacy.running_total(frame, F.col("n")))
    single = [i for i, line in enumerate(text.splitlines()) if "SinglePartition" in line]
    # Only the totals of the ranges meet in one place.
    assert len(single) == 1 and "HashAggregate" in text.splitlines()[single[0] + 1]


def test_status_folds_before_the_shuffle(spark, sf001):
    counts = plan(S.status_counts(C.status(spark, sf001)))
    assert "partial_max_by" in counts and "message" not in counts.split("FileScan")[0]
    assert plan(C.recent_errors(spark, sf001)).count("TakeOrderedAndProject") == 1
    assert "WindowGroupLimit" in plan(C.state_sample(spark, sf001))


def test_filters_reach_the_scan(spark, sf001):
    text = plan(pages.preview_pages(C.paged(spark, sf001), 1))
    assert "PushedFilters: [IsNotNull(turn)" in text or "DataFilters: [isnotnull(turn" in text
    text = plan(S.status_of(spark.read.schema("path string, status int").parquet(f"{sf001}/events.parquet"), "x"))
    assert "EqualTo(path,x)" in text


def test_large_rule_tables_stay_out_of_generated_code(spark):
    entries = [dict(pattern=f"w{i}", name=f"n{i}") for i in range(2000)]
    docs = spark.createDataFrame([("a", "- w77"), ("b", "")], "path string, text string")
    rows = matching.first_match(docs, make_rules(entries)).collect()
    assert [r.rule_id for r in rows] == [7, None]  # w77 contains w7


def test_building_a_plan_starts_no_job(spark, sf001):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job expected")
    for name in ("route_first_match", "route_many_rules", "manifest", "document_text", "page_markers", "status_counts",
                 "merge_status", "match_matrix", "map_files", "text_sidecars", "protect_roundtrip"):
        C.QUERIES[name](spark, sf001)
        assert not tracker.getJobIdsForGroup("building"), name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sidecars_are_recognized_once_and_read_by_tasks(spark, sf001, monkeypatch):
    written = []

    def write(docs, placed, home):
        written.append([plan(docs), plan(placed)])
        return real(docs, placed, home)

    real = C.writers.write_sidecar_files
    monkeypatch.setattr(C.writers, "write_sidecar_files", write)
    found = C.sidecar_files(spark, sf001)
    # Neither write goes back to the readers, and the driver lists no files.
    assert len(written) == 2 and not any("MapInPandas" in text or "MapInArrow" in text for pair in written for text in pair)
    assert "binaryFile" not in plan(found)
    lazy = plan(C.text_sidecars(spark, sf001))
    # Once for the texts, once for the rules; the listing needs no reader.
    assert lazy.split("Initial Plan")[0].count("MapIn") == 2
