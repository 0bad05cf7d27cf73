"""The engine's operators applied to the given tables, one query each.

Documents stand for files (directory = source), conversations for paged
documents (turn + 1 = page), pages for raw files, events for status updates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioroute import constants as K
from folioroute.functions import labels as L
from folioroute.functions import text as X
from folioroute.operators import legacy, matching, pages, perfile, protect
from folioroute.operators import status as S
from folioroute.plans import routing
from folioroute.session import reliable, run_dir, slices, spread
from folioroute.sinks import status_table as stored_status
from folioroute.sinks import writers
from folioroute.sources import extract as E
from folioroute.sources.files import list_files, open_filesystem, plain_path, rescan_files, scan_files
from folioroute.sources.tables import read_log, read_status
from folioroute.sources.rules import make_rules, normalize_rules, read_rules
from folioroute.streaming import monitor, router

# --- rule sets ---------------------------------------------------------------

RULES = [
    dict(pattern=r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", name="has_email", target="內容", occurrence=1),
    dict(pattern=r"(?i)licen[sc]e", name="licensed", target="內容", occurrence=2,
         user_pass="open-me", owner_pass="edit-me"),
    dict(pattern=r"[|]", name="table_like", target="內容", occurrence=20),
    dict(pattern=r"^ensrc1[0-9]*", name="en_src1x", target="元數據", occurrence=1),
    dict(pattern=r"7", name="lucky", target="檔名", occurrence=2),
    dict(pattern=r"the.*?and", name="english_like", target="內容", occurrence=3),
    dict(pattern=r"der ", name="german_like", target="內容", occurrence=2),
    dict(pattern=r"(", name="broken", target="內容", occurrence=1),
    dict(pattern=r" la ", name="romance", target="其他", occurrence=0),
]

# Names that exist in the listing as doc, doc_1, ... and names that overlap.
TAKEN_RULES = [
    dict(pattern=r"the.*?and", name="doc", target="內容", occurrence=1),
    dict(pattern=r" la ", name="paper", target="內容", occurrence=1),
]
FAMILY_RULES = [
    dict(pattern=r"7", name="doc_7", target="檔名", occurrence=1),
    dict(pattern=r"der ", name="doc", target="內容", occurrence=2),
    dict(pattern=r" la ", name="doc_7_1", target="內容", occurrence=1),
    dict(pattern=r"the", name="paper", target="內容", occurrence=1),
]

LEGACY_RULES = [
    dict(pattern=r"the", name="five", target="內容", occurrence=5),
    dict(pattern=r"der ", name="two", target="內容", occurrence=2),
    dict(pattern=r"[A-Za-z0-9._]+@", name="one", target="內容", occurrence=1),
    dict(pattern=r"src1", name="origin", target="中介", occurrence=1),
    dict(pattern=r"src2", name="never", target="元數據", occurrence=1),
    dict(pattern=r" la ", name="absent", target="內容", occurrence=0),
    dict(pattern=r"src", name="again", target="中介", occurrence=1),
]

# Constructs of the legacy dialect that Java or Python read differently.
LEGACY_DIALECT_RULES = [
    dict(pattern=r"[a-z-[aeiou]]{5}", name="consonants", target="內容", occurrence=1),
    dict(pattern=r"[a&&b]t", name="ampersand", target="內容", occurrence=3),
    dict(pattern=r"(?'n'th)e", name="named", target="內容", occurrence=4),
    dict(pattern=r"[[u]n", name="bracket", target="內容", occurrence=2),
    dict(pattern=r"a{,2}", name="braces", target="內容", occurrence=0),
]

# Constructs that Java reads differently from the rule dialect.
DIALECT_RULES = [
    dict(pattern=r"\d{3}-\d+", name="digits", occurrence=1),
    dict(pattern=r"(?P<who>\w+)@\w+\.", name="address", occurrence=2),
    dict(pattern=r"\s{2,}", name="gaps", occurrence=3),
    dict(pattern=r"(?i)É", name="accented", occurrence=60),
    dict(pattern=r"e{,2}nt[^\W\d]", name="bounded", occurrence=40),
    dict(pattern=r"\A\w", name="starts", occurrence=1),
]


def many_rules() -> list[dict]:
    """A long rule table: letter pairs, every fifth one regardless of case."""
    pairs = [a + b for a in "bcdfghjklmnpqrst" for b in "aehilnorstuvdcm"]
    return [
        dict(
            pattern=("(?i)" if i % 5 == 4 else "") + pair,
            name=f"pair_{pair}",
            target="內容",
            occurrence=40 + 7 * (i % 11),
        )
        for i, pair in enumerate(pairs)
    ]


# --- tables in the engine's shapes ---------------------------------------------


_SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "conversations": "conv_id long, turn long, role string, text string",
    "pages": "page_id long, url string, html string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(_table(spark, sf_dir, "documents"))


def as_files(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.concat(
            F.lit("/in/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")
        ).alias("path"),
        "text",
        E.metadata_entries(lang="lang", source="source").alias("metadata"),
    )


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations")
    return talks.select(
        F.concat(F.lit("/talks/"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("path"),
        (F.col("turn") + 1).cast("int").alias("page_no"),
        "text",
    )


def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = _table(spark, sf_dir, "pages")
    return web.select(
        F.concat(F.lit("/web/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        "url",
        "html",
    )


def updates_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("/jobs/file_"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", K.WAITING)
        .when(kind.isin("view", "click"), K.RUNNING)
        .when(kind == "purchase", K.DONE)
        .otherwise(K.FAILED)
        .alias("status"),
        F.when(kind == "signup", F.lit(K.WAITING_MESSAGE))
        .when(kind == "view", F.lit(K.RUNNING_MESSAGE))
        .when(kind == "purchase", F.lit(K.DONE_MESSAGE))
        .when(kind == "error", F.concat(F.lit(K.FAILED_MESSAGE_PREFIX), "props"))
        .alias("message"),
        F.when(kind != "signup", F.col("value").cast("long") + 1).alias("thread"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates_of(_table(spark, sf_dir, "events"))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_status(updates(spark, sf_dir))


def listed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status with files that were listed and not yet submitted: those whose
    updates never went past waiting have no thread."""
    return S.latest_status(updates(spark, sf_dir), caller_thread=None)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    number = (
        F.when(kind == "error", 40).when(kind == "purchase", 50).when(kind == "signup", 30)
        .when(kind == "view", 10).otherwise(25)
    )
    return _table(spark, sf_dir, "events").select(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(kind != "signup", L.level_label(number)).alias("level"),
        F.when(kind != "view", F.concat(F.lit("worker-"), F.col("user_id").cast("string"))).alias("thread"),
        F.col("props").alias("message"),
        F.col("event_id").alias("seq"),
    )


# --- routing ---------------------------------------------------------------------


def route_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = make_rules(RULES)
    routed = routing.route(files(spark, sf_dir), rules)
    return matching.attach_rule(routed, rules, "name")


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        route_first_match(spark, sf_dir)
        .groupBy(F.coalesce("name", F.lit("none")).alias("name"))
        .agg(F.count("*").alias("files"))
    )


def route_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(files(spark, sf_dir), make_rules(many_rules()))


def route_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(files(spark, sf_dir), make_rules(LEGACY_RULES, legacy=True))


def route_legacy_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(files(spark, sf_dir), make_rules(LEGACY_DIALECT_RULES, legacy=True))


def route_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which some hold broken bytes: their name still counts."""
    broken = F.substring_index(X.file_stem("path"), "_", -1).cast("long") % 3 == 0
    contents = files(spark, sf_dir).select(
        "path", F.when(broken, F.unhex(F.lit("C328"))).otherwise(F.col("text").cast("binary")).alias("content")
    )
    read = E.extracted_documents(E.extract(spread(contents, "path"), [E.text_reader]), remove_spaces=False)
    rules = make_rules([r for r in RULES if r["name"] in ("lucky", "english_like")])
    routed = routing.route(read, rules)
    return routed.select("path", "rule_id", F.col("error").isNotNull().alias("unreadable"))


def route_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(files(spark, sf_dir), "path")
    rules = make_rules(DIALECT_RULES)
    return matching.match_all(routing.as_documents(docs, rules), rules)


def match_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = make_rules(RULES)
    docs = spread(files(spark, sf_dir), "path")
    return matching.match_all(routing.as_documents(docs, rules), rules)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.build_manifest(files(spark, sf_dir), make_rules(RULES))


def manifest_copy_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files(spark, sf_dir)
    return routing.build_manifest(docs, make_rules(TAKEN_RULES), docs, copy_mode=True)


def manifest_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.build_manifest(files(spark, sf_dir), make_rules(FAMILY_RULES))


def name_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files(spark, sf_dir)
    return routing.build_manifest(docs, make_rules(RULES), directory=F.lit("/out"))


def legacy_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = make_rules(LEGACY_RULES, legacy=True)
    docs = routing.as_documents(spread(files(spark, sf_dir), "path"), rules)
    return legacy.claim_manifest(docs, rules, "/out")


def legacy_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run of the older dialect: metadata goes on from file to file."""
    rules = make_rules(LEGACY_RULES, legacy=True)
    docs = routing.as_documents(spread(files(spark, sf_dir), "path"), rules)
    return legacy.claim_manifest(docs, rules, "/out", matches=legacy.run_matches(docs, rules))


def running_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = web_files(spark, sf_dir)
    facts = E.metadata_entries(title=E.html_title("html"), url="url")
    described = web.select("path", X.concat_metadata(facts).alias("metadata"))
    return legacy.running_metadata_hits(described, "th", seed="the other")


def running_metadata_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that begin at the end of one file's metadata and end in the next one's."""
    web = web_files(spark, sf_dir)
    facts = E.metadata_entries(title=E.html_title("html"), url="url")
    described = web.select("path", X.concat_metadata(facts).alias("metadata"))
    return legacy.running_metadata_hits(described, "[0-9a-z][A-Z][a-z]+", seed="the other")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = status(spark, sf_dir).select(
        (F.col("status") != K.FAILED).alias("ok"),
        (F.col("status") == K.DONE).alias("matched"),
        "start_time",
        "end_time",
    )
    return S.run_summary(ended)


def _origin_rules(spark: SparkSession, sf_dir: str, target: str, header: bool) -> str:
    """Write a rule file with a rule for every language and source found."""
    origin = F.concat("lang", "source")
    found = _table(spark, sf_dir, "documents").select(origin.alias("pattern")).distinct()
    empty = F.lit(None).cast("string")
    pad = " " if header else ""  # legacy fields may be padded
    rows = found.select(
        F.concat(F.lit(pad), "pattern", F.lit(pad)).alias("pattern"),
        F.concat(F.lit(pad + "from "), "pattern").alias("name"),
        F.lit(target + pad).alias("target"), F.lit(pad + "1").alias("n"),
        empty.alias("user"), empty.alias("owner"),
    )
    out = run_dir(spark, "rules")
    # Several part files, in order by their names.
    parts = rows.repartitionByRange(3, "pattern").sortWithinPartitions("pattern")
    keep = dict(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    parts.write.options(header=header, **keep).csv(out)
    return out


def route_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = read_rules(spark, _origin_rules(spark, sf_dir, K.TARGET_METADATA, header=False))
    return matching.attach_rule(routing.route(files(spark, sf_dir), rules), rules, "name")


def route_legacy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _origin_rules(spark, sf_dir, K.LEGACY_TARGET_METADATA, header=True)
    rules = read_rules(spark, path, legacy=True, encrypt=True, default_user_pass="open")
    routed = routing.route(files(spark, sf_dir), rules)
    return matching.attach_rule(routed, rules, "name", "encrypt", "user_pass")


def _lay_out(docs: DataFrame, home: str) -> None:
    """Write each text to its path below a folder, from within the tasks."""

    def write(batches):
        for part in slices(batches, "text"):
            for path, text in zip(part.column("path").to_pylist(), part.column("text").to_pylist()):
                folder, name = (home + path).rsplit("/", 1)
                system, plain = open_filesystem(folder)
                system.create_dir(plain)
                with system.open_output_stream(f"{plain}/{name}") as stream:
                    stream.write(text.encode("utf-8"))
            yield part.select(["path"])

    spread(docs.select("path", "text"), "path").mapInArrow(write, "path string").count()


def _below(column: str, home: str):
    return F.replace(F.col(column), plain_path(F.lit(home)), F.lit("")).alias(column)


def _with_facts(docs: DataFrame) -> DataFrame:
    """``path, text``: metadata as ``key=value`` fields in a first line, then the text."""
    facts = F.transform("metadata", lambda entry: F.concat(entry["key"], F.lit("="), entry["value"]))
    return docs.select("path", F.concat(F.array_join(facts, "\t"), F.lit("\n"), "text").alias("text"))


def facts_reader():
    """Reads what ``_with_facts`` lays out."""

    def read(content: bytes):
        head, _, text = content.decode("utf-8").partition("\n")
        return [text], dict(field.split("=", 1) for field in head.split("\t"))

    return read


def route_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as files in a folder, then found, read and routed."""
    home = run_dir(spark, "folder")
    _lay_out(_with_facts(files(spark, sf_dir)), home)
    placed = routing.folder_manifest(spark, home, make_rules(RULES), [facts_reader])
    return placed.select(
        _below("path", home), _below("target_path", home), "action", "outcome", "rule_id", "encrypt", "ref_status"
    )


def rescan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder is listed, then files are changed and added, and some are gone; the
    second scan opens what is new or changed."""
    home = run_dir(spark, "rescan")
    docs = _table(spark, sf_dir, "documents")
    name = F.concat(F.lit("/"), F.pmod("doc_id", F.lit(5)).cast("string"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    late, gone, edited = (F.col("doc_id") % k == 0 for k in (11, 13, 7))
    docs = docs.select(name.alias("path"), "text", late.alias("late"), gone.alias("gone"), edited.alias("edited"))
    _lay_out(docs.where("not late and not gone"), home)
    # Files that have gone are known from the stored listing only.
    lost = docs.where("gone").select(F.concat(F.lit(home), "path").alias("path"), F.lit(1).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"))
    before = reliable(list_files(spark, home).select(plain_path("path").alias("path"), "length", "modified").unionByName(lost))
    _lay_out(docs.where("late and not gone"), home)
    _lay_out(docs.where("edited and not late and not gone").withColumn("text", F.concat("text", F.lit("!"))), home)
    found = rescan_files(spark, home, before)
    return found.select(_below("path", home), "state", F.col("content").cast("string").alias("text"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as files, read by ranges of three pages."""
    home = run_dir(spark, "ranges")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    whole = paged(spark, sf_dir).groupBy("path").agg(ordered.alias("pages"))
    text = F.array_join(F.transform("pages", lambda page: page["text"]), "\f")
    _lay_out(whole.select("path", text.alias("text")), home)
    read = E.extract_page_ranges(list_files(spark, home), E.text_pages, 3)
    return read.select(_below("path", home), "page_no", "text", F.col("error").isNotNull().alias("unreadable"))


def scan_top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out in two levels; only the upper one is listed."""
    home = run_dir(spark, "levels")
    docs = _table(spark, sf_dir, "documents")
    folder = F.when(F.col("lang") == "en", "/").otherwise(F.concat(F.lit("/"), "lang", F.lit("/")))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    _lay_out(docs.select(F.concat(folder, name, F.lit(".PDF")).alias("path"), "text"), home)
    found = scan_files(spark, home, recursive=False)
    return found.select(_below("path", home), "length", F.col("content").cast("string").alias("text"))


def split_then_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = pages.chunk_pages(paged(spark, sf_dir), 2)
    return routing.build_manifest(pages.chunks_as_files(chunks, "/split"), make_rules(RULES))


# --- pages -------------------------------------------------------------------------


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.concat_pages(paged(spark, sf_dir))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_count(paged(spark, sf_dir))


def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.chunk_pages(paged(spark, sf_dir), 3)


def chunk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.chunk_names(paged(spark, sf_dir), 3, legacy_names=True)


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.chunk_counts(paged(spark, sf_dir), 3)


def chunk_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_dir(spark, "chunks")
    writers.write_chunks(chunk_text(spark, sf_dir), out)
    return spark.read.parquet(out)


def page_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.concat_pages(paged(spark, sf_dir), markers=True)


def split_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.preview_marked(page_markers(spark, sf_dir))


def preview_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.preview_pages(paged(spark, sf_dir), first=3)


def preview_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.preview_pages(paged(spark, sf_dir), remove_spaces=True)


def preview_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.preview_first(paged(spark, sf_dir))


# --- names and texts -----------------------------------------------------------------


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_files(spark, sf_dir).select(
        "path",
        "url",
        X.base_name("url").alias("base"),
        X.dir_name("url").alias("dir"),
        X.file_stem("url").alias("stem"),
        X.legacy_stem("url").alias("legacy_stem"),
        X.extension("url").alias("ext"),
        X.short_name(X.base_name("url")).alias("shown"),
        X.is_pdf("path").alias("is_pdf"),
    )


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_files(spark, sf_dir).select("path", E.html_text("html").alias("text"))


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = E.metadata_entries(
        title=E.html_title("html"),
        ref=F.regexp_extract("url", r"[?&]ref=([^&#]*)", 1),
        page=F.nullif(F.regexp_extract("url", r"[?&]page=([^&#]*)", 1), F.lit("")),
        url="url",
    )
    return web_files(spark, sf_dir).select("path", X.concat_metadata(facts).alias("metadata"))


def text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract("html", r"<p>([^<]*%%%[^<]*)<br>", 1)
    given = F.regexp_extract("url", r"[?&]ref=([^&#]*)", 1)
    title = X.strip_spaces(F.regexp_extract("html", r"<title>([^<.]*)</title>", 1))
    return web_files(spark, sf_dir).select(
        "path",
        X.choose_text(found, given, title).alias("normal"),
        X.choose_text(found, given, title, force_ocr=True).alias("forced"),
        X.choose_text(found, given, title, force_ocr=True, has_ocr=False).alias("forced_without"),
        X.first_text(given, found).alias("first"),
    )


def ocr_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    def item(part):
        return F.struct(
            F.lit(None).cast("array<array<double>>").alias("box"),
            F.nullif(part, F.lit("")).alias("text"),
            F.lit(0.9).alias("confidence"),
        )

    result = F.transform(
        F.split("text", "\n"),
        lambda line: F.when(line != "", F.transform(F.split(line, ","), item)),
    )
    return paged(spark, sf_dir).select(
        "path",
        "page_no",
        X.flatten_ocr(result).alias("text"),
        X.flatten_ocr(result, remove_spaces=True).alias("dense"),
    )


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line_reader():
        return lambda content: (content.decode("utf-8").split("\n"), {"bytes": len(content)})

    contents = files(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content"))
    extracted = E.extract(spread(contents, "path"), [line_reader])
    return pages.number_pages(
        extracted.withColumn("metadata", X.concat_metadata("metadata")), keep=("path", "metadata")
    )


def map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(row):
        if "@" in row["text"]:
            raise ValueError("address found")
        return len(row["text"])

    docs = spread(files(spark, sf_dir).select("path", "text"), "path")
    return perfile.result_status(perfile.map_files(docs, measure, "long"))


def _recognized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents where texts of an odd size stand for scans: no reader finds text in
    them, though it finds the metadata."""

    def reader():
        read = facts_reader()

        def scan_or_text(content):
            (text,), facts = read(content)
            return ([] if len(text.encode("utf-8")) % 2 else [text]), facts

        return scan_or_text

    def recognizer():
        read = facts_reader()
        return lambda content: read(content)[0]

    laid_out = _with_facts(files(spark, sf_dir)).select("path", F.col("text").cast("binary").alias("content"))
    read = E.extract(spread(laid_out, "path"), [reader], recognizer)
    return E.extracted_documents(read, remove_spaces=False)


def _recognized_manifest(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Named against the table's paths, so nothing is read again for the listing."""
    return routing.build_manifest(docs, make_rules(RULES), files(spark, sf_dir))


def text_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _recognized(spark, sf_dir)
    return writers.text_sidecars(docs, _recognized_manifest(spark, sf_dir, docs))


def sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per recognized text, written twice over, listed and read again.

    What was recognized is stored, and so are the names: both writes use them."""
    home, texts = run_dir(spark, "sidecars"), run_dir(spark, "recognized")
    _recognized(spark, sf_dir).write.parquet(texts)
    docs = spark.read.parquet(texts)
    placed = reliable(_recognized_manifest(spark, sf_dir, docs))
    for _ in range(2):
        writers.write_sidecar_files(docs, placed, home)
    content = F.col("content").cast("string")
    return scan_files(spark, home, suffix=K.SIDECAR_SUFFIX).select(
        F.replace(F.col("path"), plain_path(F.lit(home)), F.lit("")).alias("sidecar_path"),
        F.startswith(content, F.lit(K.BYTE_ORDER_MARK)).alias("marked"),
        F.replace(content, F.lit(K.BYTE_ORDER_MARK), F.lit("")).alias("text"),
    )


def protect_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule sets both passwords, one the user's only: no owner opens that."""
    rules = make_rules([{**r, "user_pass": "open-me"} if r["name"] == "romance" else r for r in RULES])
    docs = routing.as_documents(spread(files(spark, sf_dir), "path"))
    matched = matching.first_match(docs, rules).select(
        "path", "rule_id", F.col("text").cast("binary").alias("content")
    )
    stored = protect.protect_content(matched, rules)
    opened = protect.open_content(stored, "open-me", into="user_text")
    opened = protect.open_content(opened, "edit-me", owner=True, into="owner_text")
    return opened.select(
        "path",
        "rule_id",
        "protected",
        F.col("owner_key").isNotNull().alias("has_owner"),
        F.col("user_text").cast("string").alias("user_text"),
        F.col("owner_text").cast("string").alias("owner_text"),
    )


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("　"), "event_type", F.lit(" ")).alias("pattern"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"),
        F.lit(" 內容").alias("target"),
        F.when(F.col("event_type") == "view", F.col("value").cast("string"))
        .when(F.col("event_type") == "click", F.lit(""))
        .otherwise(F.regexp_extract("props", "[0-9]+", 0))
        .alias("occurrence"),
        F.when(F.col("event_type") == "error", F.lit(r"b'p\x41\'s'")).otherwise("").alias("user_pass"),
        F.when(F.col("event_type") == "purchase", F.lit(" secret ")).otherwise("").alias("owner_pass"),
    )
    return normalize_rules(raw, default_owner_pass="owner")


# --- status --------------------------------------------------------------------------


def status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status(spark, sf_dir)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.status_counts(listed_status(spark, sf_dir))


def simple_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.simple_status_counts(status(spark, sf_dir))


def all_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.all_done(status(spark, sf_dir))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.progress(status(spark, sf_dir))


def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = updates(spark, sf_dir).where(F.col("status") == K.FAILED)
    everything = updates(spark, sf_dir).unionByName(
        files(spark, sf_dir).select("path"), allowMissingColumns=True
    )
    return S.insert_missing(S.latest_status(known), everything)


def merge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("status").isin(K.WAITING, K.RUNNING)
    before = S.latest_status(updates(spark, sf_dir).where(early))
    changes = S.fold_updates(updates(spark, sf_dir).where(~early))
    return S.merge_status(before, changes)


def merge_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stored table, merged in two parts of which one is repeated."""
    early = F.col("status").isin(K.WAITING, K.RUNNING)
    table = run_dir(spark, "status-table")
    stored_status.write_status_table(S.latest_status(updates(spark, sf_dir).where(early)), table, 16)
    changes = S.fold_updates(updates(spark, sf_dir).where(~early))
    part = F.pmod(F.xxhash64("path"), F.lit(16)) < 5
    for some in (part, ~part, part):
        stored_status.merge_into_status_table(spark, table, changes.where(some), 16)
    return stored_status.read_status_table(spark, table)


def status_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.status_of(status(spark, sf_dir), "/jobs/file_7.pdf")


def pending_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pending(status(spark, sf_dir), 20)


def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.recent_errors(log(spark, sf_dir), 5, order="seq")


def state_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.state_sample(status(spark, sf_dir), 3)


def display_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates(spark, sf_dir).select(
        "seq", L.display_state("status", "thread").alias("state"), L.status_label("status").alias("label")
    )


def status_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.export_rows(status(spark, sf_dir))


def _read_export(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    schema = ", ".join(f"`{name}` string" for name in header)
    return (
        spark.read.schema(schema).option("header", True).option("escape", '"')
        .option("enforceSchema", True).csv(path).na.fill("")
    )


def status_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_dir(spark, "status-csv")
    writers.export_status(status(spark, sf_dir), out)
    return _read_export(spark, out, K.STATUS_EXPORT_HEADER)


def status_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status written as a table, read back and counted."""
    out = run_dir(spark, "status")
    status(spark, sf_dir).write.parquet(out)
    return S.status_counts(read_status(spark, out))


def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as a table, read back and cut to its errors."""
    out = run_dir(spark, "log")
    log(spark, sf_dir).select("timestamp", "level", "thread", "message").write.parquet(out)
    return S.errors_only(read_log(spark, out))


def log_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_dir(spark, "log-csv")
    writers.export_log(log(spark, sf_dir), out)
    return _read_export(spark, out, K.LOG_EXPORT_HEADER)


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = updates(spark, sf_dir).groupBy("path").agg(
        (F.max("ts") - F.min("ts")).alias("whole"), F.count("*").alias("updates")
    )
    return spans.select(
        "path",
        L.format_duration("whole").alias("whole"),
        L.format_duration(F.col("whole") / (F.col("updates") * 50)).alias("short"),
        L.format_duration(F.col("whole") / (F.col("updates") * 3000)).alias("shortest"),
    )


# --- streams -------------------------------------------------------------------------


#: Deliveries in which a table arrives on a stream.
DELIVERIES = 4
# A batch begins as soon as there is something to do.
AT_ONCE = "0 seconds"


def _deliver(spark: SparkSession, sf_dir: str, name: str, home: str, by: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """A table that arrives in four deliveries, each of which a running stream handles
    as one batch; rows of one ``by`` arrive together.

    A delivery is as many files as the table has splits, so no task takes more of it
    than it reads of the table. Its folder is moved to its place when it is complete.
    """
    table = _table(spark, sf_dir, name)
    part = F.pmod(F.xxhash64(by), F.lit(DELIVERIES))
    system, arriving = open_filesystem(f"{home}/arriving")
    system.create_dir(arriving)
    source = spark.readStream.schema(_SCHEMAS[name]).option("recursiveFileLookup", True)
    query = start(source.parquet(f"{home}/arriving"))
    try:
        for number in range(DELIVERIES):
            table.where(part == number).write.parquet(f"{home}/sent-{number}")
            system.move(open_filesystem(f"{home}/sent-{number}")[1], f"{arriving}/{number}")
            query.processAllAvailable()
    finally:
        query.stop()


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = run_dir(spark, "monitor")

    def start(events: DataFrame) -> StreamingQuery:
        return monitor.monitor_status(updates_of(events), f"{home}/log", f"{home}/checkpoint", every=AT_ONCE, compact_every=3)

    _deliver(spark, sf_dir, "events", home, "event_id", start)
    return monitor.current_status(spark, f"{home}/log")


def stream_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per state after the log of a stream was compacted twice and moved to a fresh one."""
    home = run_dir(spark, "compacted")

    def start(events: DataFrame) -> StreamingQuery:
        return monitor.monitor_status(updates_of(events), f"{home}/log", f"{home}/checkpoint", every=AT_ONCE, compact_every=2)

    _deliver(spark, sf_dir, "events", home, "event_id", start)
    monitor.compact(spark, f"{home}/log", f"{home}/fresh")
    return S.status_counts(monitor.current_status(spark, f"{home}/fresh"))


def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = run_dir(spark, "router")

    def start(arriving: DataFrame) -> StreamingQuery:
        return router.route_stream(as_files(arriving), make_rules(RULES), f"{home}/manifest", f"{home}/checkpoint", AT_ONCE)

    _deliver(spark, sf_dir, "documents", home, "source", start)
    return router.read_manifest(spark, f"{home}/manifest").drop("batch_id")


def _in_utc(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Times in the tables are zone-less and shown as UTC. Expressions take the zone of
    the session when they are put together, so the session has its own again after."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        try:
            return query(spark, sf_dir)
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)

    return run


QUERIES = {
    query.__name__: _in_utc(query)
    for query in (
        route_first_match, route_counts, route_many_rules, route_exact, route_dialect, match_matrix,
        manifest, manifest_copy_mode, manifest_families, name_exhausted, legacy_claim, legacy_run,
        running_metadata, running_metadata_across, run_summary, route_legacy_dialect, route_unreadable,
        status_table, log_table, split_then_route, route_from_file, route_legacy_file, route_folder, rescan_folder, page_ranges,
        scan_top_level, document_text, page_counts, chunk_text,
        chunk_names, chunk_counts, chunk_sink, page_markers, split_markers, preview_pages,
        preview_stripped, preview_first, path_parts, page_text, page_meta, text_fallback,
        ocr_flatten, extract_pages, map_files, text_sidecars, sidecar_files, protect_roundtrip, rule_rows,
        status_latest, status_counts, simple_status_counts, all_done, progress, insert_missing,
        merge_status, merge_stored, status_lookup, pending_limit, recent_errors, state_sample,
        display_states, status_export, status_csv, log_csv, durations, stream_status, stream_compacted,
        stream_route,
    )
}
