import os
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioroute.functions import text as X
from folioroute.operators import pages as G
from folioroute.plans import routing
from folioroute.session import slices
from folioroute.sources import extract as E
from folioroute.sources import files as S
from folioroute.sources.rules import make_rules

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    for name, content in {
        "a.PDF": b"alpha\fpage two", "b.pdf": b"beta", ".pdf": b"dot", "a.b.pdf": b"\xff\xfe", "c.txt": b"text",
        "empty.pdf": b"", "sub/deep/er/d.Pdf": b"delta", "sub/empty.pdf": b"", "sub/x.pdf.bak": b"no",
        "_draft.pdf": b"draft", ".hid/in.pdf": b"hidden", "_tmp/empty.pdf": b"",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(root)


def walked(root, recursive=True):
    found = []
    for base, _, names in os.walk(root):
        found += [os.path.join(base, n) for n in names if n.lower().endswith(".pdf")]
        if not recursive:
            break
    return sorted(found)


@pytest.mark.parametrize("recursive", [True, False])
def test_listing_and_scan_find_what_a_walk_finds(spark, folder, recursive):
    listed = S.list_files(spark, folder, recursive).collect()
    assert sorted(r.path for r in listed) == walked(folder, recursive)
    assert {r.path: r.length for r in listed} == {p: os.path.getsize(p) for p in walked(folder, recursive)}
    scanned = S.scan_files(spark, folder, recursive).collect()
    assert sorted(r.path for r in scanned) == walked(folder, recursive)
    for row in scanned:
        with open(row.path, "rb") as file:
            assert bytes(row.content) == file.read()


@pytest.mark.parametrize("scheme", ["file://", "file:"])
def test_listing_with_a_scheme(spark, folder, scheme):
    listed = S.list_files(spark, scheme + folder + "/")
    assert sorted(r[0] for r in listed.select(S.plain_path("path")).collect()) == walked(folder)


def test_extraction_keeps_errors_with_their_file(spark, folder):
    rows = {r.path: r for r in E.extract(S.scan_files(spark, folder), [E.text_reader]).collect()}
    assert rows[f"{folder}/a.PDF"].pages == ["alpha", "page two"]
    assert rows[f"{folder}/a.b.pdf"].pages == [] and "decode" in rows[f"{folder}/a.b.pdf"].error
    assert rows[f"{folder}/b.pdf"].error is None and len(rows) == len(walked(folder))


def reader(pages, facts=None):
    return lambda: lambda content: (pages, facts or {})


def broken():
    def read(content):
        raise ValueError("unreadable")

    return read


@pytest.mark.parametrize(
    "readers, recognized, force, want, error",
    [
        ([reader(["a"]), reader(["b"])], ["o"], False, ["a"], None),
        ([reader([""]), reader(["b"])], ["o"], False, ["b"], None),
        ([broken, reader(["b"])], ["o"], False, ["b"], None),
        ([reader([""]), reader([""])], ["o"], False, ["o"], None),
        ([reader([""])], [""], False, [""], None),
        ([reader(["a"])], [""], True, [""], None),  # forced is final even if empty
        ([reader([""]), reader(["b"])], None, True, [""], None),  # forced without: first reader only
        ([broken], None, False, [], "unreadable"),
    ],
)
def test_reader_chain(spark, readers, recognized, force, want, error):
    frame = spark.createDataFrame([("p", b"x")], "path string, content binary")
    recognizer = None if recognized is None else lambda: lambda content: recognized
    row = E.extract(frame, readers, recognizer, force_ocr=force).first()
    assert (row.pages, row.error) == (want, error)


def test_metadata_order_and_pruning(spark):
    frame = spark.createDataFrame([("p", b"x")], "path string, content binary")
    facts = {"b": "1", "a": None, "c": 3}
    row = E.extract(frame, [reader(["t"], facts)]).select(X.concat_metadata("metadata")).first()
    assert row[0] == "13"
    assert E.extract(frame, [reader(["t"], facts)], want_metadata=False).first().metadata == []
    assert E.extract(frame, [reader(["t"], facts)], want_pages=False).first().pages == []


def test_recognized_text_has_page_headings(spark):
    frame = spark.createDataFrame([("p", b"x")], "path string, content binary")
    found = E.extract(frame, [reader([""])], lambda: lambda content: ["o n e\n", ""])
    assert found.first().recognized
    text = E.extracted_documents(found).first().text
    assert text == "===== 第1頁 =====\none\n\n===== 第2頁 =====\n\n"
    assert "o n e" in E.extracted_documents(found, remove_spaces=False).first().text
    assert G.number_pages(found).count() == 2
    read = E.extract(frame, [reader(["a b", "c"])], lambda: lambda content: ["o"])
    assert E.extracted_documents(read).first().text == "a bc"


def test_folder_to_manifest(spark, folder):
    rules = make_rules([dict(pattern="a", name="found"), dict(pattern=r"^\.", name="hidden", target="2")])
    rows = {r.path: r for r in routing.folder_manifest(spark, folder, rules, [E.text_reader]).collect()}
    assert rows[f"{folder}/_draft.pdf"].target_path == f"{folder}/found.pdf"
    assert rows[f"{folder}/a.PDF"].target_path == f"{folder}/found_1.pdf"
    assert rows[f"{folder}/b.pdf"].target_path == f"{folder}/found_2.pdf"
    assert rows[f"{folder}/sub/deep/er/d.Pdf"].target_path == f"{folder}/sub/deep/er/found.pdf"
    assert rows[f"{folder}/.pdf"].target_path == f"{folder}/hidden.pdf"
    assert rows[f"{folder}/empty.pdf"].outcome == "unmatched"
    assert rows[f"{folder}/a.b.pdf"].outcome == "error"


def test_files_are_not_opened_for_rules_on_names(spark, folder):
    rules = make_rules([dict(pattern="^a", name="named", target="2"), dict(pattern="(", name="broken")])

    def never():
        raise AssertionError("opened")

    docs = routing.folder_documents(spark, folder, rules, [never])
    assert docs.columns == ["path"] and docs.count() == len(walked(folder))
    rows = routing.folder_manifest(spark, folder, rules, [never], recursive=False).where("rule_id = 0").collect()
    assert {r.target_path.rsplit("/")[-1] for r in rows} == {"named.pdf", "named_1.pdf"}


def test_html(spark):
    html = "<html><title>T &amp; U</title><script>x<p></script><p>one<br>two</p></html>"
    frame = spark.createDataFrame([(html,)], "h string")
    row = frame.select(E.html_text("h"), E.html_title("h")).first()
    assert tuple(row) == ("onetwo", "T &amp; U")


def test_links_to_folders_are_not_followed(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("in/a.pdf", "in/deep/b.PDF"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "in" / "deep" / "loop").symlink_to(tmp_path / "in", target_is_directory=True)
    (tmp_path / "in" / "c.pdf").symlink_to(tmp_path / "in" / "a.pdf")
    found = listed_below(spark, f"{tmp_path}/in")
    assert found == ["/a.pdf", "/c.pdf", "/deep/b.PDF"]


def listed_below(spark, root):
    from folioroute.sources.files import list_files

    return sorted(r.path.removeprefix(root) for r in list_files(spark, root).collect())


def test_page_ranges_are_tasks_of_their_own(spark, tmp_path):
    """A long document is read by many tasks; errors stay with their file or range."""
    (tmp_path / "long.pdf").write_text("\f".join(f"page {i}" for i in range(1, 5001)))
    (tmp_path / "one.pdf").write_text("alone")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "broken.pdf").write_bytes(b"\xc3\x28")

    class Picky:
        def __init__(self, stream):
            self.pages_of = E.text_pages()(stream)

        def __len__(self):
            return len(self.pages_of)

        def pages(self, first, last):
            if first == 401:
                raise ValueError("no such pages")
            return self.pages_of.pages(first, last)

    files = S.list_files(spark, str(tmp_path))
    read = E.extract_page_ranges(files, lambda: Picky, pages=100)
    rows = read.withColumn("task", F.spark_partition_id()).collect()
    long = [r for r in rows if r.path.endswith("long.pdf")]
    assert len({r.task for r in long}) > 4
    assert {r.page_no: r.text for r in long if r.error is None} == {i: f"page {i}" for i in range(1, 5001) if not 401 <= i <= 500}
    assert [(r.page_no, r.error) for r in long if r.error] == [(401, "no such pages")]
    rest = {r.path.rsplit("/", 1)[1]: (r.page_no, r.text, r.error is None) for r in rows if not r.path.endswith("long.pdf")}
    assert rest == {"one.pdf": (1, "alone", True), "empty.pdf": (1, "", True), "broken.pdf": (None, None, False)}


def test_rescan_opens_new_and_changed_files_only(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.pdf").write_text(name)
    before = spark.createDataFrame(S.list_files(spark, str(tmp_path)).collect(), "path string, length long, modified timestamp")
    (tmp_path / "b.pdf").write_text("bb")
    (tmp_path / "d.pdf").write_text("d")
    lost = before.where("path like '%c.pdf'").withColumn("path", F.replace("path", F.lit("c.pdf"), F.lit("z.pdf")))
    found = S.rescan_files(spark, str(tmp_path), before.union(lost)).collect()
    got = {r.path.rsplit("/", 1)[1]: (r.state, r.content and bytes(r.content)) for r in found}
    assert got == {
        "a.pdf": ("same", None), "b.pdf": ("changed", b"bb"), "c.pdf": ("same", None), "d.pdf": ("new", b"d"), "z.pdf": ("gone", None),
    }


def test_listing_of_another_suffix(spark, tmp_path):
    for name in ("a_ocr.txt", "sub/B_OCR.TXT", "a.pdf", "sub/.1f.part", "ocr.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    rows = {r.path.removeprefix(str(tmp_path)): bytes(r.content) for r in S.scan_files(spark, str(tmp_path), suffix="_ocr.txt").collect()}
    assert rows == {"/a_ocr.txt": b"a_ocr.txt", "/sub/B_OCR.TXT": b"sub/B_OCR.TXT"}
    listed = S._spark_listing(spark, str(tmp_path), True, "_ocr.txt").collect()
    assert sorted(r.path.removeprefix(f"file:{tmp_path}") for r in listed) == sorted(rows)


def test_slices_are_bounded_and_whole():
    texts = ["x" * 5, None, "é" * 3, "", "y" * 30, "z", "w" * 9, "v" * 2]
    batch = pa.record_batch({"path": list("abcdefgh"), "text": texts})
    parts = list(slices(iter([batch.slice(0, 0), batch, batch.slice(4, 1)]), "text", 10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == [*texts, "y" * 30]
    for part in parts:
        sizes = [len((t or "").encode()) for t in part.column("text").to_pylist()]
        assert sum(sizes) - sizes[0] < 10
    assert len(parts) < 8


def test_a_worker_reads_a_large_batch_in_slices(spark):
    """Twenty contents of a megabyte handed over at once are never twenty pages at once."""

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = E.extract(Frame(), [E.text_reader])
    batch = pa.record_batch({"path": [f"p{i}" for i in range(20)], "content": [bytes([97 + i]) * 2**20 for i in range(20)]})
    found = list(run(iter([batch])))
    assert [r for b in found for r in b.column("pages").to_pylist()] == [[chr(97 + i) * 2**20] for i in range(20)]
    assert max(b.num_rows for b in found) <= 5
