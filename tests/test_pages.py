import random


from folioroute import constants as K
from folioroute.operators import pages as G


def paged(spark, counts):
    rows = [(f"/t/{d}.pdf", n + 1, f"<{d}.{n + 1}>") for d, count in counts.items() for n in range(count)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "path string, page_no int, text string").repartition(4)


def whole(doc, count):
    return "".join(f"<{doc}.{n + 1}>" for n in range(count))


def test_chunks(spark):
    chunks = G.chunk_pages(paged(spark, {"seven": 7, "six": 6, "one": 1}), 3).collect()
    got = sorted((r.chunk_name, r.first_page, r.last_page) for r in chunks)
    assert got == [
        ("one-1.pdf", 1, 1), ("seven-1.pdf", 1, 3), ("seven-2.pdf", 4, 6), ("seven-3.pdf", 7, 7),
        ("six-1.pdf", 1, 3), ("six-2.pdf", 4, 6),
    ]
    texts = {r.chunk_name: r.text for r in chunks}
    assert texts["seven-2.pdf"] == "<seven.4><seven.5><seven.6>"


def test_legacy_chunk_names_carry_the_last_page(spark):
    rows = G.chunk_names(paged(spark, {"seven": 7}), 3, legacy_names=True).collect()
    assert sorted(r.chunk_name for r in rows) == ["seven-3.pdf", "seven-6.pdf", "seven-7.pdf"]


def test_counts(spark):
    rows = G.chunk_counts(paged(spark, {"a": 7, "b": 6, "c": 1}), 3).collect()
    assert {r.path: (r.page_count, r.chunk_count) for r in rows} == {
        "/t/a.pdf": (7, 3), "/t/b.pdf": (6, 2), "/t/c.pdf": (1, 1),
    }


def test_long_documents_are_joined_in_blocks(spark):
    counts = {"short": 3, "block": 10, "long": 237, "one": 1}
    frame = paged(spark, counts)
    for block in (1, 10, 10_000):
        rows = G.concat_pages(frame, block_pages=block).collect()
        assert {r.path: r.text for r in rows} == {f"/t/{d}.pdf": whole(d, n) for d, n in counts.items()}


def test_markers(spark):
    text = G.concat_pages(paged(spark, {"d": 2}), markers=True).first().text
    assert text == "===== 第1頁 =====\n<d.1>\n===== 第2頁 =====\n<d.2>\n"


def test_numbering_pages_of_an_array(spark):
    docs = spark.createDataFrame([("p", ["a", "b"]), ("q", [])], "path string, pages array<string>")
    assert [tuple(r) for r in G.number_pages(docs).collect()] == [("p", 1, "a"), ("p", 2, "b")]


def test_previews(spark):
    frame = spark.createDataFrame(
        [("p", 1, "a b" + "x" * 600), ("p", 2, "short"), ("p", 3, None), ("o", 1, "first")],
        "path string, page_no int, text string",
    )
    rows = {(r.path, r.page_no): r.preview for r in G.preview_pages(frame, 2).collect()}
    assert set(rows) == {("p", 1), ("p", 2), ("o", 1)}
    assert rows["p", 1] == ("a b" + "x" * 497) + K.PREVIEW_SUFFIX
    stripped = {r.page_no: r.preview for r in G.preview_pages(frame, remove_spaces=True).where("path='p'").collect()}
    assert stripped[1].startswith("abx") and stripped[3] == ""
    assert [(r.path, r.preview) for r in G.preview_first(frame).collect()] == [("o", "first")]


def test_marked_preview_limits(spark):
    marked = "===== 第1頁 =====\n" + "y" * 600 + "\n===== 第2頁 =====\nz\n"
    docs = spark.createDataFrame([("m", marked), ("w", "v" * 1200)], "path string, text string")
    rows = {(r.path, r.position): r for r in G.preview_marked(docs).collect()}
    assert rows["m", 1].page == "1頁" and rows["m", 1].preview == "\n" + "y" * 499 + K.PREVIEW_SUFFIX
    assert rows["m", 2].preview == "\nz\n"
    assert rows["w", 1].page is None and rows["w", 1].preview == "v" * 1000 + K.PREVIEW_SUFFIX
    assert G.preview_marked(docs, first=1).count() == 2
