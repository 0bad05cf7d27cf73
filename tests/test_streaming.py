import os
import random
import re
import shutil

import pytest

from pyspark.sql import functions as F

from folioroute.operators import status as S
from folioroute.plans import catalogue as C
from folioroute.plans import routing
from folioroute.sources import extract as E
from folioroute.sources import files as FS
from folioroute.sources.rules import make_rules
from folioroute.streaming import monitor, router

UPDATE = "path string, seq long, status int, message string, thread long, ts double"


def as_rows(frame):
    return {r.path: tuple(r)[1:] for r in frame.select(*S.STATUS_COLUMNS).collect()}


def test_monitor_follows_the_batch_fold(spark, tmp_path):
    updates = [(f"p{i % 7}", i, i % 4, None if i % 3 else f"m{i}", i % 5 or None, float(i)) for i in range(200)]
    source, log, checkpoint = f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/cp"
    for number, (start, stop) in enumerate([(0, 80), (80, 90), (90, 200)]):
        part = updates[start:stop]
        spark.createDataFrame(part, UPDATE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(UPDATE).parquet(source)
        monitor.monitor_status(stream, log, checkpoint, every=None, caller_thread=0, compact_every=2).awaitTermination()
        want = S.latest_status(spark.createDataFrame(updates[:stop], UPDATE), 0)
        assert as_rows(monitor.current_status(spark, log)) == as_rows(want)
    monitor.compact(spark, log, f"{tmp_path}/compact")
    assert as_rows(monitor.current_status(spark, f"{tmp_path}/compact")) == as_rows(want)
    assert S.status_counts(monitor.current_status(spark, log)).first().total == 7
    # Three batches: the snapshot of the first two and the third one's changes are read, nothing else.
    files = {re.search(r"/log/(\w+/[^/]+)", f)[1] for f in monitor.current_status(spark, log).inputFiles()}
    assert monitor.newest_snapshot(spark, log) == 1 and files == {"snapshots/upto=1", "changes/after=1"}
    # A repeated batch leaves the same table.
    for kind in ("commits/2", "commits/.2.crc"):
        (tmp_path / "cp" / kind).unlink(missing_ok=True)
    stream = spark.readStream.schema(UPDATE).parquet(source)
    monitor.monitor_status(stream, log, checkpoint, every=None, caller_thread=0, compact_every=2).awaitTermination()
    assert as_rows(monitor.current_status(spark, log)) == as_rows(want)


RULES = [dict(pattern="hit", name="x"), dict(pattern="other", name="y")]


def read_text(batch):
    found = E.extract(batch.select(FS.plain_path("path").alias("path"), "content"), [E.text_reader])
    return E.extracted_documents(found)


def test_folder_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(12):
        (folder / f"f{i:02d}.pdf").write_bytes(b"hit" if i % 3 else b"other")
    rules = make_rules(RULES)
    router.route_stream(
        router.stream_files(spark, str(folder)), rules, f"{tmp_path}/m", f"{tmp_path}/cp", prepare=read_text
    ).awaitTermination()
    got = router.read_manifest(spark, f"{tmp_path}/m").drop("batch_id")
    batch = routing.build_manifest(read_text(FS.scan_files(spark, str(folder))), rules)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_later_batches_respect_names_given_out(spark, tmp_path):
    source, manifest, checkpoint = f"{tmp_path}/in", f"{tmp_path}/m", f"{tmp_path}/cp"
    schema = "path string, text string"
    rules = make_rules(RULES)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        router.route_stream(stream, rules, manifest, checkpoint).awaitTermination()
        rows = router.read_manifest(spark, manifest).collect()
        return {r.path: r.target_path for r in rows}

    spark.createDataFrame([("/in/b.pdf", "hit"), ("/in/c.pdf", "hit")], schema).write.parquet(source)
    assert run() == {"/in/b.pdf": "/in/x.pdf", "/in/c.pdf": "/in/x_1.pdf"}
    # An earlier path that comes later gets what is left; a path seen before is left out.
    spark.createDataFrame([("/in/a.pdf", "hit"), ("/in/b.pdf", "hit")], schema).write.mode("append").parquet(source)
    assert run() == {"/in/b.pdf": "/in/x.pdf", "/in/c.pdf": "/in/x_1.pdf", "/in/a.pdf": "/in/x_2.pdf"}
    # A batch that is repeated replaces its own rows: the same manifest again.
    shutil.copytree(checkpoint, f"{tmp_path}/cp2")
    import os

    os.remove(f"{tmp_path}/cp2/commits/1")
    if os.path.exists(f"{tmp_path}/cp2/commits/.1.crc"):
        os.remove(f"{tmp_path}/cp2/commits/.1.crc")
    checkpoint = f"{tmp_path}/cp2"
    assert run() == {"/in/b.pdf": "/in/x.pdf", "/in/c.pdf": "/in/x_1.pdf", "/in/a.pdf": "/in/x_2.pdf"}


def test_stream_matching_is_stateless(spark, tmp_path):
    spark.createDataFrame([("p", "hit")], "path string, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, text string").parquet(f"{tmp_path}/in")
    routed = routing.route(stream, make_rules(RULES))
    assert routed.isStreaming
    query = routed.writeStream.format("memory").queryName("routed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("routed").select(F.col("rule_id")).first()[0] == 0


def names_in_turn(batches, names, existing):
    """A plain loop over batches of (path, name): target per path, None without one."""
    taken, given = set(existing), {}
    for batch in batches:
        fresh = {path: name for path, name in batch if path not in given}
        taken |= set(fresh)
        for path in sorted(fresh):
            home, name = path.rsplit("/", 1)[0], fresh[path]
            tries = [f"{home}/{name}_{k}.pdf" if k else f"{home}/{name}.pdf" for k in range(100)] if name else []
            given[path] = next((t for t in tries if t not in taken), None)
            taken.add(given[path])
    return given


@pytest.mark.parametrize("held", [3, 100_000])
def test_names_over_batches_and_restarts_equal_a_plain_loop(spark, tmp_path, monkeypatch, held):
    """Overlapping names, a name that most files want, seeded listing, files that stand on names; a restart per batch."""
    monkeypatch.setattr(router, "HELD_ROWS", held)
    rnd = random.Random(held)
    entries = [dict(pattern=f"<{n}>", name=n) for n in ("x", "x_1", "x_1_2", "y", "z")]
    rules = make_rules(entries)
    schema = "path string, text string"
    existing = ["/a/x.pdf", "/a/y_7.pdf", "/b/x_1.pdf", "/b/x_1_2.pdf", "/b/other.pdf", "/a/z_99.pdf"]
    listing = spark.createDataFrame([(p,) for p in existing], "path string")
    batches, number = [], 0
    for size in (40, 260, 5, 60):
        batch = []
        for _ in range(size):
            number += 1
            stem = rnd.choice(["x", "x_1", "x_3", "y_2", "z"]) if rnd.random() < 0.05 else f"f{rnd.random():.6f}-{number}"
            batch.append((f"/{rnd.choice('ab')}/{stem}.pdf", rnd.choice(["z"] * 8 + ["x", "x_1", "x_1_2", "y", None])))
        batches.append(list(dict(batch).items()))
    batches[2] += batches[0][:5]
    for rows in batches:
        text = [(p, "" if n is None else f"<{n}>") for p, n in rows]
        spark.createDataFrame(text, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        router.route_stream(stream, rules, f"{tmp_path}/m", f"{tmp_path}/cp", inventory=listing).awaitTermination()
    got = {r.path: r.target_path for r in router.read_manifest(spark, f"{tmp_path}/m").collect()}
    want = names_in_turn(batches, entries, existing)
    assert got == want
    assert sum(t is None for t in want.values()) > 30
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None


def test_a_batch_reads_no_earlier_manifest(spark, tmp_path):
    schema = "path string, text string"
    for i in range(2):
        spark.createDataFrame([(f"/in/{i}.pdf", "hit")], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = router.route_stream(stream, make_rules(RULES), f"{tmp_path}/m", f"{tmp_path}/cp")
        query.awaitTermination()
    plan = query._jsq.explainInternal(True)
    assert re.search(r"/in", plan) and f"{tmp_path}/m" not in plan
    rows = router.read_manifest(spark, f"{tmp_path}/m").collect()
    assert {r.batch_id: r.target_path for r in rows} == {0: "/in/x.pdf", 1: "/in/x_1.pdf"}


def test_slot_map_equals_a_set_of_files():
    rnd = random.Random(4)
    for _ in range(200):
        names = set(rnd.sample(["x", "x_1", "x_1_2", "x_12", "y", "y_0", "y_100"], 4))
        slots, files = router.SlotMap(names, {}), set()
        for _ in range(rnd.randrange(160)):
            name = rnd.choice(sorted(names))
            if rnd.random() < 0.2:
                k = rnd.randrange(100)
                slots.mark(name, k)
                files.add(f"{name}_{k}" if k else name)
            else:
                want = next((k for k in range(100) if (f"{name}_{k}" if k else name) not in files), None)
                assert slots.claim(name) == want
                if want is not None:
                    files.add(f"{name}_{want}" if want else name)


def delivered(spark, sf001, tmp_path, monkeypatch, query, table):
    """Runs a stream query over a table of six files; the files that arrived on the stream."""
    for name in ("documents", "events"):
        rows = spark.read.parquet(f"{sf001}/{name}.parquet")
        rows.repartition(6).write.parquet(f"{tmp_path}/sf/{name}.parquet")
    monkeypatch.setattr(C, "run_dir", lambda spark, purpose: f"{tmp_path}/home")
    result = C.QUERIES[query](spark, f"{tmp_path}/sf").collect()
    arrived = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/home/arriving")
    assert arrived.count() == spark.read.parquet(f"{tmp_path}/sf/{table}.parquet").count()
    return result, list((tmp_path / "home" / "arriving").rglob("part-*"))


def test_a_delivery_is_no_single_file_and_keeps_sources_together(spark, sf001, tmp_path, monkeypatch):
    rows, arrived = delivered(spark, sf001, tmp_path, monkeypatch, "stream_route", "documents")
    assert len(arrived) >= 4 * 3
    placed = router.read_manifest(spark, f"{tmp_path}/home/manifest").select("batch_id", F.substring_index("path", "/", 3).alias("dir"))
    assert sorted(r.batch_id for r in placed.select("batch_id").distinct().collect()) == [0, 1, 2, 3]
    assert placed.distinct().count() == placed.select("dir").distinct().count()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, C.manifest(spark, f"{tmp_path}/sf").collect()), key=str)


def test_a_status_delivery_is_read_by_several_tasks(spark, sf001, tmp_path, monkeypatch):
    rows, arrived = delivered(spark, sf001, tmp_path, monkeypatch, "stream_compacted", "events")
    assert len(arrived) >= 4 * 3
    assert rows == S.status_counts(C.status(spark, f"{tmp_path}/sf")).collect()
    assert len(os.listdir(tmp_path / "home" / "log" / "snapshots")) == 2
