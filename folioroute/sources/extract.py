"""From file bytes or markup to pages and metadata.

A reader takes the bytes of a file and returns ``(pages, metadata)``: page
texts in order and a dict. Readers are plugged in; which PDF library is there
is a matter of the executors. Errors stay with their file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioroute.functions import text as X
from folioroute.session import arrow_rows, arrow_schema, slices
from folioroute.sources.files import open_filesystem

Reader = Callable[[bytes], tuple[list[str], dict]]
METADATA_TYPE = "array<struct<key:string,value:string>>"
_EXTRACTED = (
    f"path string, pages array<string>, recognized boolean, metadata {METADATA_TYPE}, error string"
)


def extract(
    files: DataFrame,
    readers: list[Callable[[], Reader]],
    recognizer: Callable[[], Callable[[bytes], list[str]]] | None = None,
    force_ocr: bool = False,
    want_pages: bool = True,
    want_metadata: bool = True,
) -> DataFrame:
    """``path, pages, recognized, metadata, error`` of files with ``path`` and
    ``content``.

    Each entry builds a reader once per task. The first reader that yields
    text wins, the recognizer comes last and only for files without text;
    forced, it is final. A file is read once, and what no rule needs
    (``want_...``) is not read.
    """

    schema = arrow_schema(_EXTRACTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = [build() for build in readers]
        recognize = recognizer() if recognizer is not None else None
        for part in slices(batches, "content"):
            rows = [
                (path, *_read_one(content, built, recognize, force_ocr, want_pages, want_metadata))
                for path, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist())
            ]
            yield arrow_rows(rows, schema)

    return files.select("path", "content").mapInArrow(run, _EXTRACTED)


def extract_page_ranges(files: DataFrame, opener: Callable[[], Callable], pages: int = 200) -> DataFrame:
    """``path, page_no, text, error`` of all pages of files with ``path``, by ranges of pages.

    ``opener`` builds, once per task, a function from a seekable stream to a
    document with ``len`` and ``pages(first, last)``, counted from 1. Each file is
    opened once to count its pages; its ranges are then dealt out as tasks of
    equal weight, each of which opens the file itself and reads its own pages.
    So a document of 50,000 pages is many tasks, and no row holds more than a page.
    A file, or a range, that cannot be read gives one row with its error and,
    for a range, its first page.
    """

    def opened(path: str):
        system, plain = open_filesystem(path)
        return system.open_input_file(plain)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = opener()
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    with opened(path) as stream:
                        rows.append((path, len(read(stream)), None))
                except Exception as problem:
                    rows.append((path, None, str(problem) or type(problem).__name__))
            yield pd.DataFrame(rows, columns=["path", "n", "error"]).astype({"n": "Int64"})

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = opener()
        columns = ["path", "page_no", "text", "error"]
        for batch in batches:
            for path, first, last, error in zip(batch["path"], batch["first"], batch["last"], batch["error"]):
                rows = [(path, None, None, error)]
                if error is None:
                    try:
                        with opened(path) as stream:
                            texts = read(stream).pages(int(first), int(last))
                        rows = [(path, first + i, text or "", None) for i, text in enumerate(texts)]
                    except Exception as problem:
                        rows = [(path, first, None, str(problem) or type(problem).__name__)]
                yield pd.DataFrame(rows, columns=columns).astype({"page_no": "Int64"})

    counted = files.select("path").mapInPandas(count, "path string, n long, error string")
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(pages).cast("long")))
    ranges = counted.where("error IS NOT NULL OR n > 0").select("path", "n", "error", F.explode_outer(starts).alias("first"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.select("path", "first", F.least("n", F.col("first") + (pages - 1)).alias("last"), "error").repartition(tasks, "path", "first")
    return dealt.mapInPandas(take, "path string, page_no int, text string, error string")


def _read_one(content, readers, recognize, force_ocr, want_pages, want_metadata):
    pages: list[str] = []
    metadata: list[dict] | None = None
    problems = []
    recognize_only = force_ocr and recognize is not None
    # Forced recognition without a recognizer leaves the first reader only.
    for number, reader in enumerate(readers[:1] if force_ocr else readers):
        if recognize_only and not (want_metadata and number == 0):
            break
        try:
            texts, facts = reader(content)
        except Exception as problem:
            problems.append(str(problem))
            continue
        if metadata is None and want_metadata:
            metadata = [
                {"key": str(k), "value": None if v is None else str(v)} for k, v in facts.items()
            ]
        if not recognize_only:
            pages = [t or "" for t in texts]
        if any(pages) or not want_pages:
            break
    recognized = False
    if recognize is not None and want_pages and (force_ocr or not any(pages)):
        try:
            found = recognize(content)
            # Recognized pages have headings, so any page makes a text.
            recognized = force_ocr or bool(found)
            pages = found if recognized else pages
        except Exception as problem:
            problems.append(str(problem))
    failed = bool(problems) and not any(pages) and metadata is None
    return (
        pages if want_pages else [],
        recognized,
        metadata if want_metadata else [],
        "; ".join(problems) if failed else None,
    )


def extracted_documents(extracted: DataFrame, remove_spaces: bool = True) -> DataFrame:
    """One row per file with its page texts joined: ``path, text, metadata,
    error, recognized``. Recognized pages get their headings, and lose their spaces unless
    those are to be kept."""
    clean = X.strip_spaces if remove_spaces else (lambda text: text)
    framed = F.transform("pages", lambda text, i: X.page_marker(i + 1, clean(text)))
    text = F.when(F.col("recognized"), F.array_join(framed, "")).otherwise(F.array_join("pages", ""))
    return extracted.select("path", F.coalesce(text, F.lit("")).alias("text"), "metadata", "error", "recognized")


# --- readers -------------------------------------------------------------------


class _FormFeedText:
    """A plain text document with a form feed between pages."""

    def __init__(self, stream):
        self.texts = stream.read().decode("utf-8").split("\f")

    def __len__(self) -> int:
        return len(self.texts)

    def pages(self, first: int, last: int) -> list[str]:
        return self.texts[first - 1 : last]


def text_pages():
    """Opener for ``extract_page_ranges``: plain UTF-8 text, a form feed between pages."""
    return _FormFeedText


def text_reader() -> Reader:
    """Plain UTF-8 text, a form feed between pages, no metadata."""

    def read(content: bytes):
        return content.decode("utf-8").split("\f"), {}

    return read


# --- markup in a table ----------------------------------------------------------


def html_text(html) -> Column:
    """Text of an HTML page: scripts, styles and tags go, nothing else changes."""
    bare = F.regexp_replace(
        X._col(html), r"(?is)<script.*?</script>|<style.*?</style>|<title>.*?</title>", ""
    )
    return F.regexp_replace(bare, r"(?s)<[^>]*>", "")


def html_title(html) -> Column:
    return F.regexp_extract(X._col(html), r"(?is)<title>(.*?)</title>", 1)


def metadata_entries(**values) -> Column:
    """Ordered metadata array from named columns."""
    return F.array(
        *[F.struct(F.lit(k).alias("key"), X._col(v).alias("value")) for k, v in values.items()]
    )
