"""Writing results. Every sink writes one file per partition into a folder;
nothing is gathered into a single file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioroute import constants as K
from folioroute.functions import text as X
from folioroute.operators import status as S
from folioroute.sinks.sidecars import SidecarFiles


def _write_csv(rows: DataFrame, path: str, byte_order_mark: bool, mode: str) -> None:
    first = rows.columns[0]
    if byte_order_mark:
        rows = rows.withColumnRenamed(first, K.BYTE_ORDER_MARK + first)
    (
        rows.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("encoding", "UTF-8")
        .csv(path)
    )


def export_status(
    status: DataFrame, path: str, byte_order_mark: bool = True, mode: str = "error"
) -> None:
    """Status table as CSV with labels and local times."""
    _write_csv(S.export_rows(status), path, byte_order_mark, mode)


def export_log(
    log: DataFrame, path: str, byte_order_mark: bool = True, mode: str = "error"
) -> bool:
    """Log as CSV; an empty log writes nothing and returns False."""
    if log.isEmpty():
        return False
    _write_csv(S.log_export_rows(log), path, byte_order_mark, mode)
    return True


def sidecar_path(path) -> Column:
    """Name of the text file beside a document."""
    p = X._col(path)
    return X.join_path(X.dir_name(p), F.concat(X.file_stem(p), F.lit(K.SIDECAR_SUFFIX)))


def text_sidecars(texts: DataFrame, manifest: DataFrame) -> DataFrame:
    """``sidecar_path, text``: recognized texts beside the new file, or beside
    the old one if it was not placed. Empty texts have none.

    Where the texts say whether they were ``recognized``, the others are left out
    before anything is moved."""
    targets = manifest.select("path", "target_path")
    if "recognized" in texts.columns:
        texts = texts.where("recognized")
    return (
        texts.where("text <> ''")
        .join(targets, "path", "left")
        .select(sidecar_path(F.coalesce("target_path", "path")).alias("sidecar_path"), "text")
    )


def write_text_sidecars(texts: DataFrame, manifest: DataFrame, path: str, mode: str = "error") -> None:
    text_sidecars(texts, manifest).write.mode(mode).parquet(path)


def write_sidecar_files(texts: DataFrame, manifest: DataFrame, root: str = "") -> None:
    """One text file with a byte order mark per recognized text, beside its document;
    ``root`` goes before all paths. A repeated run replaces its files."""
    spark = texts.sparkSession
    spark.dataSource.register(SidecarFiles)
    rows = text_sidecars(texts, manifest)
    rows.write.format(SidecarFiles.name()).mode("append").save(root)


def write_manifest(manifest: DataFrame, path: str, mode: str = "error") -> None:
    manifest.write.mode(mode).parquet(path)


def write_chunks(chunks: DataFrame, path: str, by_source: bool = False, mode: str = "error") -> None:
    """Chunk table; ``by_source`` lays it out in a folder per document, for few
    and large ones."""
    writer = chunks.write.mode(mode)
    (writer.partitionBy("path") if by_source else writer).parquet(path)
