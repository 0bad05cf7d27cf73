"""Paged documents: numbering, joining, chunking, previewing.

A page frame has ``path``, ``page_no`` (from 1) and ``text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioroute import constants as K
from folioroute.functions import text as X

# Pages of one document that are joined in one go.
BLOCK_PAGES = 10_000


def number_pages(docs: DataFrame, pages: str = "pages", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per entry of an array of page texts, numbered from 1."""
    return docs.select(*keep, F.posexplode(pages).alias("_pos", "text")).select(
        *keep, (F.col("_pos") + 1).alias("page_no"), "text"
    )


def page_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy("path").agg(F.count("*").alias("page_count"))


def ordered_text(order: str, value: Column) -> Column:
    """Aggregate: texts of a group in order, joined without a separator."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(order), value.alias("value"))))
    return F.array_join(F.transform(entries, lambda e: e["value"]), "")


def concat_pages(
    pages: DataFrame, markers: bool = False, block_pages: int = BLOCK_PAGES
) -> DataFrame:
    """``path, text``: all page texts in order, with headings if asked.

    Pages are joined block by block, then the blocks of a document, so the pages
    of a long document spread over many tasks; a usual document is one block.
    (The joined text is one value and bound to the 2 GB of a Spark value; beyond
    that, chunk the document.)
    """
    piece = X.page_marker("page_no", "text") if markers else F.coalesce("text", F.lit(""))
    return _join_by_block(pages, piece, block_pages)


def _join_by_block(pages: DataFrame, piece: Column, block_pages: int) -> DataFrame:
    block = F.floor((F.col("page_no") - 1) / block_pages).alias("_block")
    blocks = pages.groupBy("path", block).agg(ordered_text("page_no", piece).alias("text"))
    return blocks.groupBy("path").agg(ordered_text("_block", F.col("text")).alias("text"))


def chunk_pages(pages: DataFrame, pages_per_chunk: int, legacy_names: bool = False) -> DataFrame:
    """Cut documents into runs of N pages.

    ``path, chunk, chunk_name, first_page, last_page, text``. A group is one
    chunk, so a document of any length spreads over as many groups as it has
    chunks. Legacy names carry the last page number instead of the chunk's.
    """
    chunk = (F.floor((F.col("page_no") - 1) / pages_per_chunk) + 1).cast("int")
    cut = pages.groupBy("path", chunk.alias("chunk")).agg(
        F.min("page_no").alias("first_page"),
        F.max("page_no").alias("last_page"),
        ordered_text("page_no", F.coalesce("text", F.lit(""))).alias("text"),
    )
    return cut.select("path", "chunk", chunk_name_column(legacy_names), "first_page", "last_page", "text")


def chunk_names(pages: DataFrame, pages_per_chunk: int, legacy_names: bool = False) -> DataFrame:
    """The chunks without their text."""
    chunk = (F.floor((F.col("page_no") - 1) / pages_per_chunk) + 1).cast("int")
    cut = pages.groupBy("path", chunk.alias("chunk")).agg(
        F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page")
    )
    return cut.select("path", "chunk", chunk_name_column(legacy_names), "first_page", "last_page")


def chunk_name_column(legacy: bool) -> Column:
    if legacy:
        return X.chunk_name(X.legacy_stem("path"), "last_page").alias("chunk_name")
    return X.chunk_name(X.file_stem("path"), "chunk").alias("chunk_name")


def chunk_counts(pages: DataFrame, pages_per_chunk: int) -> DataFrame:
    return page_count(pages).select(
        "path", "page_count", X.chunk_count("page_count", pages_per_chunk).alias("chunk_count")
    )


def chunks_as_files(chunks: DataFrame, directory: str) -> DataFrame:
    """Chunks in the shape of files to route, in their output directory."""
    return chunks.select(
        X.join_path(F.lit(directory), F.col("chunk_name")).alias("path"), "text"
    )


def preview_pages(
    pages: DataFrame, first: int | None = None, remove_spaces: bool = False
) -> DataFrame:
    """First pages of every document in display form; all if not limited."""
    text = F.coalesce("text", F.lit(""))
    if remove_spaces:
        text = X.strip_spaces(text)
    shown = pages if first is None else pages.where(F.col("page_no") <= first)
    return shown.select("path", "page_no", X.preview(text).alias("preview"))


def preview_marked(docs: DataFrame, first: int | None = None) -> DataFrame:
    """Display form of texts with page headings, ``path, position, page, preview``.

    A text without headings is shown whole (position 1, no page) up to the
    longer limit.
    """
    pieces = docs.select("path", F.posexplode(X.split_page_markers("text")).alias("_pos", "_piece"))
    rows = pieces.select(
        "path",
        (F.col("_pos") + 1).alias("position"),
        "_piece.page",
        F.when(F.col("_piece.page").isNull(), X.preview("_piece.content", K.PREVIEW_WHOLE_CHARS))
        .otherwise(X.preview("_piece.content"))
        .alias("preview"),
    )
    return rows if first is None else rows.where(F.col("position") <= first)


def preview_first(pages: DataFrame, number: int = 1) -> DataFrame:
    """The first page of the first ``number`` documents in path order."""
    firsts = pages.where("page_no = 1").orderBy("path").limit(number)
    return firsts.select("path", "page_no", X.preview("text").alias("preview"))
