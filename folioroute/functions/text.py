"""Column functions on paths, texts and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioroute import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Whitespace of Unicode text, one character class for both strip and \\s.
WHITESPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def strip(text) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` only knows U+0020)."""
    return F.regexp_replace(_col(text), rf"\A[{WHITESPACE}]+|[{WHITESPACE}]+\z", "")


def base_name(path) -> Column:
    """Last component of a path, with either slash as separator."""
    return F.regexp_extract(_col(path), r"(?s)([^/\\]*)\z", 1)


def dir_name(path) -> Column:
    """Everything before the last component; '' for a bare name, '/' at the root."""
    slashed = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    return F.regexp_extract(slashed, r"(?s)\A(/+(?=[^/]*\z)|.*?(?=/+[^/]*\z)|)", 1)


def file_stem(path) -> Column:
    """Base name without its last extension; leading dots start no extension."""
    return F.regexp_replace(base_name(path), r"(?s)\A(\.*[^.].*)\.[^.]*\z", "$1")


def legacy_stem(path) -> Column:
    """Base name cut at its last dot, wherever that is."""
    return F.regexp_replace(base_name(path), r"(?s)\.[^.]*\z", "")


def extension(path) -> Column:
    """Extension with its dot, '' if there is none."""
    return F.regexp_extract(base_name(path), r"(?s)\A\.*[^.].*(\.[^.]*)\z", 1)


def join_path(directory, file) -> Column:
    return F.concat(F.regexp_replace(_col(directory), r"([^/])\z", "$1/"), _col(file))


def is_pdf(path) -> Column:
    return F.lower(_col(path)).endswith(".pdf")


def concat_metadata(entries) -> Column:
    """Values of an ordered array of (key, value) entries, empty ones left out."""
    values = F.transform(_col(entries), lambda entry: entry["value"])
    return F.coalesce(
        F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), ""), F.lit("")
    )


def first_text(*candidates) -> Column:
    """First non-empty text; '' if all are empty."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in candidates], F.lit(""))


def choose_text(primary, secondary, ocr, force_ocr=False, has_ocr=True) -> Column:
    """Text of a document from its readers.

    Normally the first reader with text wins and recognition comes last.
    Forced recognition is final even when it found nothing; forced without a
    recognizer leaves the first reader only.
    """
    if force_ocr and has_ocr:
        return F.coalesce(_col(ocr), F.lit(""))
    if force_ocr:
        return F.coalesce(_col(primary), F.lit(""))
    readers = [primary, secondary] + ([ocr] if has_ocr else [])
    return first_text(*readers)


def strip_spaces(text) -> Column:
    """Remove U+0020 and nothing else."""
    return F.replace(_col(text), F.lit(" "), F.lit(""))


def flatten_ocr(result, remove_spaces: bool = False) -> Column:
    """Recognized lines to page text, one line break after each item.

    ``result`` is an array of lines, a line an array of items with a ``text``
    field. Null lines and items without text are skipped.
    """
    items = F.flatten(F.filter(_col(result), lambda line: line.isNotNull()))
    kept = F.filter(items, lambda item: item["text"].isNotNull())
    clean = strip_spaces if remove_spaces else (lambda t: t)
    lines = F.transform(kept, lambda item: F.concat(clean(item["text"]), F.lit("\n")))
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def page_marker(page_no, text) -> Column:
    """A page text framed by its page heading."""
    return F.concat(
        F.lit(K.PAGE_MARKER_OPEN),
        _col(page_no).cast("string"),
        F.lit(K.PAGE_MARKER_CLOSE),
        F.coalesce(_col(text), F.lit("")),
        F.lit("\n"),
    )


def split_page_markers(text) -> Column:
    """Array of (page, content) from a text with page headings.

    A text without a heading comes back whole with a null page.
    """
    t = _col(text)
    parts = F.split(t, K.PAGE_MARKER_OPEN)

    def piece(part: Column) -> Column:
        fields = F.split(part, K.PAGE_MARKER_RULE)
        return F.struct(
            strip(F.split(part, " ")[0]).alias("page"),
            F.when(F.size(fields) > 1, F.get(fields, F.lit(1))).otherwise(part).alias("content"),
        )

    whole = F.array(F.struct(F.lit(None).cast("string").alias("page"), t.alias("content")))
    return F.when(
        F.size(parts) > 1, F.transform(F.slice(parts, 2, F.size(parts) - 1), piece)
    ).otherwise(whole)


def preview(text, limit: int = K.PREVIEW_PAGE_CHARS) -> Column:
    """Display form of a text: longer ones are cut and marked."""
    t = _col(text)
    return F.when(
        F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit(K.PREVIEW_SUFFIX))
    ).otherwise(t)


def short_name(file_name) -> Column:
    """File name for display: stems over six characters keep three at each end."""
    name = _col(file_name)
    stem = file_stem(name)
    return F.when(F.length(stem) <= 6, name).otherwise(
        F.concat(F.left(stem, F.lit(3)), F.lit("..."), F.right(stem, F.lit(3)), extension(name))
    )


def chunk_name(stem, number) -> Column:
    return F.concat(_col(stem), F.lit("-"), _col(number).cast("string"), F.lit(".pdf"))


def chunk_count(total, pages_per_chunk: int) -> Column:
    return (F.floor((_col(total) - 1) / F.lit(pages_per_chunk)) + 1).cast("long")
