"""End-to-end routing: documents to a manifest of target names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioroute import constants as K
from folioroute.functions import text as X
from folioroute.operators import matching, naming
from folioroute.session import spread
from folioroute.sources import files as files_source
from folioroute.sources.extract import extract, extracted_documents
from folioroute.sources.rules import RuleSet

MANIFEST_COLUMNS = [
    "path", "target_path", "action", "outcome", "rule_id", "encrypt", "ref_status",
]


def as_documents(
    files: DataFrame, rules: RuleSet | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Files with ``path`` and optionally ``text`` and ``metadata`` (array of
    key/value entries, or text) to the frame rules look at.

    With ``rules`` given, columns no live rule looks at are not computed.
    """
    wanted = {"text", "stem", "metadata"} if rules is None else matching.needed_columns(rules)
    columns: list[Column] = [F.col("path")]
    if "stem" in wanted:
        columns.append(X.file_stem("path").alias("stem"))
    for name in ("text", "metadata"):
        if name in wanted:
            columns.append(_document_column(files, name))
    return files.select(*columns, *keep)


def _document_column(files: DataFrame, name: str) -> Column:
    if name not in files.columns:
        return F.lit("").alias(name)
    if name == "metadata" and files.schema[name].dataType.typeName() == "array":
        return X.concat_metadata(name).alias(name)
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def route(files: DataFrame, rules: RuleSet) -> DataFrame:
    """``path`` and ``rule_id`` (null if no rule fits) of every file.

    One pass over the files; the text stays in the stage that reads it. Files
    that could not be read have an empty text and no metadata, and all rules are
    tried on them; their ``error`` is kept.
    """
    files = spread(files, "path")
    found = matching.first_match_column(rules).alias("rule_id")
    keep = ("error",) if "error" in files.columns else ()
    return as_documents(files, rules, keep=keep).select("path", found, *keep)


def outcome_column(error: Column | None = None) -> Column:
    """What became of a file, from its ``rule_id`` and ``slot``; a file that could
    not be read and that no rule fits is an error."""
    nothing = F.lit("unmatched") if error is None else F.when(error.isNull(), "unmatched").otherwise("error")
    return (
        F.when(F.col("rule_id").isNull(), nothing)
        .when(F.col("slot").isNull(), "name_exhausted")
        .otherwise("matched")
    )


def build_manifest(
    files: DataFrame,
    rules: RuleSet,
    inventory: DataFrame | None = None,
    copy_mode: bool = False,
    directory: Column | None = None,
) -> DataFrame:
    """The decision for every file: target path, action and outcome.

    ``inventory`` lists the files that exist (default: the routed files
    themselves). ``directory`` overrides the directory targets go to. Passwords
    are not part of the manifest; they stay with the rule. An ``error`` column
    of the files tells those that could not be read.
    """
    existing = files if inventory is None else inventory
    return manifest_of(route(files, rules), rules, existing, copy_mode, directory)


def manifest_of(
    routed: DataFrame,
    rules: RuleSet,
    inventory: DataFrame | None,
    copy_mode: bool = False,
    directory: Column | None = None,
) -> DataFrame:
    """Manifest of already routed files (``path``, ``rule_id``)."""
    home = X.dir_name("path") if directory is None else directory
    claims = matching.attach_rule(routed.withColumn("dir", home), rules, "name", "encrypt")
    existing = None if inventory is None else inventory.select("path")
    live = {r.name for r in matching.live_rules(rules)}
    named = naming.assign_names(claims, [n for n in rules.names() if n in live], existing)
    return placed_manifest(named, copy_mode)


def placed_manifest(named: DataFrame, copy_mode: bool = False) -> DataFrame:
    """Manifest rows of files with ``dir, name, slot, rule_id, encrypt`` and maybe ``error``."""
    error = F.col("error") if "error" in named.columns else None
    placed = F.col("slot").isNotNull()
    action = F.when(F.col("encrypt"), "encrypt").otherwise("copy" if copy_mode else "rename")
    return named.select(
        "path",
        F.when(placed, naming.target_path("dir", "name", "slot")).alias("target_path"),
        F.when(placed, action).alias("action"),
        outcome_column(error).alias("outcome"),
        "rule_id",
        F.coalesce("encrypt", F.lit(False)).alias("encrypt"),
        # A finished job counts as done whether or not the file found a name.
        F.lit(K.DONE).alias("ref_status"),
    )


def folder_documents(
    spark: SparkSession,
    root: str,
    rules: RuleSet,
    readers: list,
    recursive: bool = True,
    remove_spaces: bool = True,
    **how,
) -> DataFrame:
    """Documents of a folder for the given rules.

    Files are opened only if a live rule looks at their content or metadata.
    ``how`` goes to ``extract`` (recognizer, force_ocr).
    """
    wanted = matching.needed_columns(rules)
    if not wanted & {"text", "metadata"}:
        return files_source.list_files(spark, root, recursive).select(
            files_source.plain_path("path").alias("path")
        )
    found = extract(
        files_source.scan_files(spark, root, recursive),
        readers,
        want_pages="text" in wanted,
        want_metadata="metadata" in wanted,
        **how,
    )
    return extracted_documents(found, remove_spaces)


def folder_manifest(
    spark: SparkSession,
    root: str,
    rules: RuleSet,
    readers: list,
    recursive: bool = True,
    copy_mode: bool = False,
    **how,
) -> DataFrame:
    """Manifest of all PDF files of a folder, named against its listing."""
    docs = folder_documents(spark, root, rules, readers, recursive, **how)
    listing = files_source.list_files(spark, root, recursive)
    existing = listing.select(files_source.plain_path("path").alias("path"))
    return build_manifest(docs, rules, existing, copy_mode)
