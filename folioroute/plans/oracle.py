"""The catalogue's queries in plain SQL over the same tables, for DuckDB."""

from __future__ import annotations

from folioroute.plans.catalogue import many_rules

FILES = """files AS (
  SELECT '/in/' || source || '/doc_' || doc_id || '.pdf' AS path,
         '/in/' || source AS dir,
         'doc_' || doc_id AS stem,
         text,
         lang || source AS metadata
  FROM documents)"""

PAGED = """paged AS (
  SELECT '/talks/' || conv_id || '.pdf' AS path, conv_id, (turn + 1)::INTEGER AS page_no, text
  FROM conversations)"""

WEB = """web AS (SELECT '/web/' || page_id || '.html' AS path, url, html FROM pages)"""

# (rule_id, name, hits, wanted, encrypts)
CANONICAL = [
    (0, "has_email", r"len(regexp_extract_all(text, '(?s)[A-Za-z0-9._]+@[A-Za-z0-9.]+'))", 1, False),
    (1, "licensed", r"len(regexp_extract_all(text, '(?s)(?i)licen[sc]e'))", 2, True),
    (2, "table_like", r"len(regexp_extract_all(text, '(?s)[|]'))", 20, False),
    (3, "en_src1x", r"len(regexp_extract_all(metadata, '(?s)^ensrc1[0-9]*'))", 1, False),
    (4, "lucky", r"len(regexp_extract_all(stem, '(?s)7'))", 2, False),
    (5, "english_like", r"len(regexp_extract_all(text, '(?s)the.*?and'))", 3, False),
    (6, "german_like", r"len(regexp_extract_all(text, '(?s)der '))", 2, False),
    (8, "romance", r"len(regexp_extract_all(text, '(?s) la '))", 1, False),
]
TAKEN = [
    (0, "doc", r"len(regexp_extract_all(text, '(?s)the.*?and'))", 1, False),
    (1, "paper", r"len(regexp_extract_all(text, '(?s) la '))", 1, False),
]
FAMILY = [
    (0, "doc_7", r"len(regexp_extract_all(stem, '(?s)7'))", 1, False),
    (1, "doc", r"len(regexp_extract_all(text, '(?s)der '))", 2, False),
    (2, "doc_7_1", r"len(regexp_extract_all(text, '(?s) la '))", 1, False),
    (3, "paper", r"len(regexp_extract_all(text, '(?s)the'))", 1, False),
]
# (rule_id, name, hits, wanted) with exact counts; target 元數據 does not exist there
EXACT = [
    (0, "five", "len(regexp_extract_all(text, 'the'))", 5),
    (1, "two", "len(regexp_extract_all(text, 'der '))", 2),
    (2, "one", "len(regexp_extract_all(text, '[A-Za-z0-9._]+@'))", 1),
    (3, "origin", "len(regexp_extract_all(metadata, 'src1'))", 1),
    (5, "absent", "len(regexp_extract_all(text, ' la '))", 0),
    (6, "again", "len(regexp_extract_all(metadata, 'src'))", 1),
]


LEGACY_DIALECT = [
    (0, "consonants", "len(regexp_extract_all(text, '[b-df-hj-np-tv-z]{5}'))", 1),
    (1, "ampersand", "len(regexp_extract_all(text, '[a&b]t'))", 3),
    (2, "named", "len(regexp_extract_all(text, 'the'))", 4),
    (3, "bracket", r"len(regexp_extract_all(text, '[\[u]n'))", 2),
    (4, "braces", r"len(regexp_extract_all(text, 'a\{,2\}'))", 0),
]


def _case(rules, column: int, operator: str = ">=") -> str:
    def value(rule):
        v = rule[column]
        return f"'{v}'" if isinstance(v, str) else str(v)

    whens = " ".join(f"WHEN {r[2]} {operator} {r[3]} THEN {value(r)}" for r in rules)
    return f"CASE {whens} END"


def _named(rules) -> str:
    encrypting = [str(r[0]) for r in rules if r[4]] or ["-1"]
    names = " ".join(f"WHEN {r[0]} THEN '{r[1]}'" for r in rules)
    return f"""{FILES},
routed AS (SELECT path, dir, stem, {_case(rules, 0)}::INTEGER AS rule_id FROM files),
named AS (
  SELECT *, CASE rule_id {names} END AS name,
         coalesce(rule_id IN ({", ".join(encrypting)}), false) AS encrypt
  FROM routed)"""


def _manifest(rules, action: str = "rename", directory: str = "dir", source: str | None = None) -> str:
    head = source or _named(rules)
    return f"""WITH {head},
claims AS (SELECT * REPLACE ({directory} AS dir) FROM named),
taken AS (
  SELECT dir, name, list(DISTINCT slot) AS used FROM (
    SELECT dir, stem AS name, 0 AS slot FROM routed
    UNION ALL
    SELECT dir, regexp_extract(stem, '^(.*)_([1-9][0-9]?)$', 1),
           regexp_extract(stem, '^(.*)_([1-9][0-9]?)$', 2)::INTEGER
    FROM routed WHERE regexp_matches(stem, '^.*_[1-9][0-9]?$'))
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY path) AS rk FROM claims),
slots AS (
  SELECT r.*, CASE WHEN r.name IS NOT NULL THEN
    list_filter(range(0, 100), lambda k: NOT list_contains(coalesce(t.used, []), k))[r.rk] END AS slot
  FROM ranked r LEFT JOIN taken t ON t.dir = r.dir AND t.name = r.name)
SELECT path,
       CASE WHEN slot IS NOT NULL THEN
         dir || '/' || name || CASE WHEN slot > 0 THEN '_' || slot ELSE '' END || '.pdf' END AS target_path,
       CASE WHEN slot IS NULL THEN NULL WHEN encrypt THEN 'encrypt' ELSE '{action}' END AS action,
       CASE WHEN rule_id IS NULL THEN 'unmatched' WHEN slot IS NULL THEN 'name_exhausted'
            ELSE 'matched' END AS outcome,
       rule_id, encrypt, 2::INTEGER AS ref_status
FROM slots"""


def _families() -> str:
    return f"""WITH RECURSIVE {_named(FAMILY)},
claims AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY dir ORDER BY path) AS rn
  FROM named WHERE name IS NOT NULL),
step AS (
  SELECT dir, 0::BIGINT AS rn, list(stem) AS used, NULL::VARCHAR AS path, NULL::VARCHAR AS pick
  FROM routed GROUP BY dir
  UNION ALL
  SELECT dir, rn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, path, pick
  FROM (
    SELECT s.dir, c.rn, s.used, c.path,
           list_filter([c.name] || list_transform(range(1, 100), lambda k: c.name || '_' || k),
                       lambda f: NOT list_contains(s.used, f))[1] AS pick
    FROM step s JOIN claims c ON c.dir = s.dir AND c.rn = s.rn + 1))
SELECT n.path,
       n.dir || '/' || s.pick || '.pdf' AS target_path,
       CASE WHEN s.pick IS NULL THEN NULL WHEN n.encrypt THEN 'encrypt' ELSE 'rename' END AS action,
       CASE WHEN n.rule_id IS NULL THEN 'unmatched' WHEN s.pick IS NULL THEN 'name_exhausted'
            ELSE 'matched' END AS outcome,
       n.rule_id, n.encrypt, 2::INTEGER AS ref_status
FROM named n LEFT JOIN step s ON s.path = n.path"""


def _claim(running: bool = False) -> str:
    # In a whole run the metadata of a file follows that of all files before it.
    totals = {r[0]: f"sum({r[2]}) OVER (ORDER BY path)" for r in EXACT if running and "metadata" in r[2]}
    hits = {r[0]: f"total_{r[0]}" if r[0] in totals else r[2] for r in EXACT}
    columns = "".join(f", {t} AS total_{i}" for i, t in totals.items())
    fits = ", ".join(f"CASE WHEN {hits[r[0]]} = {r[3]} THEN {r[0]} END" for r in EXACT)
    names = " ".join(f"WHEN {r[0]} THEN '{r[1]}'" for r in EXACT)
    return f"""WITH RECURSIVE {FILES},
fits AS MATERIALIZED (
  SELECT path, list_filter([{fits}], lambda x: x IS NOT NULL) AS ids,
         row_number() OVER (ORDER BY path) AS rn
  FROM (SELECT *{columns} FROM files)),
step AS (
  SELECT 0::BIGINT AS rn, []::INTEGER[] AS taken, NULL::VARCHAR AS path, NULL::INTEGER AS pick
  UNION ALL
  SELECT rn, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, path, pick
  FROM (
    SELECT f.rn, s.taken, f.path,
           list_filter(f.ids, lambda i: NOT list_contains(s.taken, i))[1]::INTEGER AS pick
    FROM step s JOIN fits f ON f.rn = s.rn + 1))
SELECT path, pick AS rule_id, '/out/' || CASE pick {names} END || '.pdf' AS target_path
FROM step WHERE pick IS NOT NULL"""


def _many() -> str:
    rows = []
    for i, rule in enumerate(many_rules()):
        text = rule["pattern"].removeprefix("(?i)")
        rows.append(f"({i}, '{text}', {str(text != rule['pattern']).lower()}, {rule['occurrence']})")
    return f"""WITH {FILES},
rules(rule_id, pair, any_case, wanted) AS (VALUES {", ".join(rows)}),
hits AS (
  SELECT path, rule_id FROM (SELECT path, text, lower(text) AS low FROM files), rules
  WHERE (length(CASE WHEN any_case THEN low ELSE text END)
         - length(replace(CASE WHEN any_case THEN low ELSE text END, pair, ''))) / 2 >= wanted)
SELECT f.path, min(h.rule_id)::INTEGER AS rule_id
FROM files f LEFT JOIN hits h ON h.path = f.path GROUP BY f.path"""


def _matrix(rules) -> str:
    parts = " UNION ALL ".join(
        f"SELECT path, {r[0]}::INTEGER AS rule_id, {r[2]}::INTEGER AS hits FROM files WHERE {r[2]} >= {r[3]}"
        for r in rules
    )
    return f"WITH {FILES} {parts}"


DIALECT = [
    (0, "digits", r"len(regexp_extract_all(text, '(?s)\p{Nd}{3}-\p{Nd}+'))", 1),
    (1, "address",
     r"len(regexp_extract_all(text, '(?s)[\p{L}\p{N}_]+@[\p{L}\p{N}_]+\.'))", 2),
    (2, "gaps", r"len(regexp_extract_all(text, '(?s)[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{2,}'))", 3),
    (3, "accented", r"len(regexp_extract_all(text, '(?s)[éÉ]'))", 60),
    (4, "bounded", r"len(regexp_extract_all(text, '(?s)e{0,2}nt[\p{L}\p{No}\p{Nl}_]'))", 40),
    (5, "starts", r"len(regexp_extract_all(text, '(?s)\A[\p{L}\p{N}_]'))", 1),
]

# --- paths and pages -----------------------------------------------------------

_BASE = r"regexp_extract(url, '(?s)([^/\\]*)$', 1)"
_STEM = rf"regexp_replace({_BASE}, '(?s)^(\.*[^.].*)\.[^.]*$', '\1')"
_EXT = rf"regexp_extract({_BASE}, '(?s)^\.*[^.].*(\.[^.]*)$', 1)"


def _preview(text: str, limit: int) -> str:
    return (
        f"CASE WHEN length({text}) > {limit} THEN left({text}, {limit}) || '...（內容已截斷）' "
        f"ELSE {text} END"
    )


_CHUNKS = f"""{PAGED},
chunks AS (
  SELECT path, conv_id, (floor((page_no - 1) / 3) + 1)::INTEGER AS chunk,
         min(page_no) AS first_page, max(page_no) AS last_page,
         string_agg(text, '' ORDER BY page_no) AS text
  FROM paged GROUP BY ALL)"""
_CHUNK_TEXT = f"""WITH {_CHUNKS}
SELECT path, chunk, conv_id || '-' || chunk || '.pdf' AS chunk_name, first_page, last_page, text
FROM chunks"""
_MARKED = f"""{PAGED},
marked AS (
  SELECT path,
         string_agg('===== 第' || page_no || '頁 =====' || chr(10) || text || chr(10), ''
                    ORDER BY page_no) AS text
  FROM paged GROUP BY path)"""
_CHUNK_FILES = f"""{PAGED},
files AS (
  SELECT '/split/' || conv_id || '-' || chunk || '.pdf' AS path, '/split' AS dir,
         conv_id || '-' || chunk AS stem, text, '' AS metadata
  FROM (SELECT conv_id, (floor((page_no - 1) / 2) + 1)::INTEGER AS chunk,
               string_agg(text, '' ORDER BY page_no) AS text
        FROM paged GROUP BY ALL))"""

# --- status ----------------------------------------------------------------------

UPDATES = """updates AS (
  SELECT '/jobs/file_' || user_id || '.pdf' AS path, event_id AS seq, event_type, user_id,
         CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 1
              WHEN 'purchase' THEN 2 ELSE 3 END::INTEGER AS status,
         CASE event_type WHEN 'signup' THEN '等待處理' WHEN 'view' THEN '處理中'
              WHEN 'purchase' THEN '處理完成' WHEN 'error' THEN '處理文件時出錯: ' || props END AS message,
         CASE WHEN event_type <> 'signup' THEN trunc(value)::BIGINT + 1 END AS thread,
         epoch_us(ts) / 1e6 AS ts
  FROM events)"""


def _fold(where: str = "true", thread: str = "coalesce(thread, 0)", message: str = "coalesce({}, '')"):
    said = "arg_max(message, seq) FILTER (message IS NOT NULL)"
    return f"""SELECT path, arg_max(status, seq) AS status, {message.format(said)} AS message,
         arg_max_null({thread}, seq)::BIGINT AS thread,
         arg_min(ts, seq) FILTER (status = 1) AS start_time,
         arg_max(ts, seq) FILTER (status IN (2, 3)) AS end_time
  FROM updates WHERE {where} GROUP BY path"""


STATUS = f"{UPDATES},\nstatus AS ({_fold()})"
LISTED = f"{UPDATES},\nstatus AS ({_fold(thread='thread')})"
_STATE = """CASE WHEN status = 0 AND thread IS NOT NULL THEN 'queued' WHEN status = 0 THEN 'pending'
  WHEN status = 1 THEN 'processing' WHEN status = 2 THEN 'completed' WHEN status = 3 THEN 'failed' END"""
_LABEL = """CASE status WHEN 0 THEN '等待處理' WHEN 1 THEN '處理中' WHEN 2 THEN '已完成'
  WHEN 3 THEN '失敗' ELSE status::VARCHAR END"""


def _clock(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL OR {column} = 0 THEN '' ELSE "
        f"strftime(make_timestamp(floor({column})::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') END"
    )


def _duration(seconds: str) -> str:
    s = f"({seconds})"
    hours = f"floor({s} / 3600)::BIGINT"
    minutes = f"floor(({s} % 3600) / 60)::BIGINT"
    return f"""CASE WHEN {hours} > 0 THEN {hours} || '小時' ELSE '' END
      || CASE WHEN {hours} > 0 OR {minutes} > 0 THEN {minutes} || '分' ELSE '' END
      || printf('%.2f', ({s} % 3600) % 60) || '秒'"""


_EXPORT = f"""WITH {STATUS}
SELECT path AS "文件路徑", {_LABEL} AS "狀態", message AS "消息", thread::VARCHAR AS "線程ID",
       {_clock("start_time")} AS "開始時間", {_clock("end_time")} AS "結束時間"
FROM status"""
LOG = """log AS (
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
         CASE event_type WHEN 'error' THEN '错误' WHEN 'purchase' THEN '嚴重' WHEN 'view' THEN '調試'
              WHEN 'click' THEN '信息' END AS level,
         CASE WHEN event_type <> 'view' THEN 'worker-' || user_id END AS thread,
         props AS message, event_id AS seq
  FROM events)"""

# Every origin contains its own rule's text once; a shorter origin may come first.
_ORIGIN = f"""{FILES},
rules AS (
  SELECT pattern, row_number() OVER (ORDER BY pattern) - 1 AS rule_id
  FROM (SELECT DISTINCT lang || source AS pattern FROM documents)),
hits AS (
  SELECT m.metadata, min(r.rule_id)::INTEGER AS rule_id
  FROM (SELECT DISTINCT metadata FROM files) m JOIN rules r ON contains(m.metadata, r.pattern)
  GROUP BY m.metadata)"""

ORACLE = {
    "route_first_match": f"""WITH {FILES}
SELECT {_case(CANONICAL, 0)}::INTEGER AS rule_id, path, {_case(CANONICAL, 1)} AS name FROM files""",
    "route_counts": f"""WITH {FILES}
SELECT coalesce({_case(CANONICAL, 1)}, 'none') AS name, count(*) AS files FROM files GROUP BY 1""",
    "route_many_rules": _many(),
    "route_exact": f"""WITH {FILES}
SELECT path, {_case(EXACT, 0, "=")}::INTEGER AS rule_id FROM files""",
    "route_legacy_dialect": f"""WITH {FILES}
SELECT path, {_case(LEGACY_DIALECT, 0, "=")}::INTEGER AS rule_id FROM files""",
    "route_unreadable": f"""WITH {FILES},
read AS (SELECT *, regexp_extract(stem, '[0-9]+')::BIGINT % 3 = 0 AS unreadable FROM files)
SELECT path, unreadable,
       CASE WHEN len(regexp_extract_all(stem, '7')) >= 2 THEN 0
            WHEN NOT unreadable AND len(regexp_extract_all(text, '(?s)the.*?and')) >= 3 THEN 1 END::INTEGER AS rule_id
FROM read""",
    "status_table": f"""WITH {STATUS}
SELECT count(*) FILTER ({_STATE} = 'pending') AS pending, count(*) FILTER ({_STATE} = 'queued') AS queued,
       count(*) FILTER (status = 1) AS processing, count(*) FILTER (status = 2) AS completed,
       count(*) FILTER (status = 3) AS failed, count(*) AS total
FROM status""",
    "log_table": f"""WITH {LOG}
SELECT timestamp, level, thread, message FROM log WHERE level = '错误'""",
    "route_dialect": _matrix(DIALECT),
    "match_matrix": _matrix(CANONICAL),
    "manifest": _manifest(CANONICAL),
    "manifest_copy_mode": _manifest(TAKEN, action="copy"),
    "manifest_families": _families(),
    "name_exhausted": _manifest(CANONICAL, directory="'/out'"),
    "legacy_claim": _claim(),
    "legacy_run": _claim(running=True),
    "running_metadata": f"""WITH {WEB},
hits AS (
  SELECT path, len(regexp_extract_all(
           regexp_extract(html, '(?is)<title>(.*?)</title>', 1) || url, 'th'))::INTEGER AS hits
  FROM web)
SELECT path, hits, (2 + sum(hits) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING))::BIGINT AS running_hits
FROM hits""",
    "running_metadata_across": f"""WITH {WEB},
described AS (
  SELECT path, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) || url AS metadata FROM web),
joined AS (
  SELECT path, metadata, string_agg(metadata, '') OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS so_far
  FROM described)
SELECT path, len(regexp_extract_all(metadata, '[0-9a-z][A-Z][a-z]+'))::INTEGER AS hits,
       len(regexp_extract_all('the other' || so_far, '[0-9a-z][A-Z][a-z]+'))::BIGINT AS running_hits
FROM joined""",
    "run_summary": f"""WITH {STATUS},
total AS (
  SELECT count(*) AS searched, count(*) FILTER (status <> 3) AS succeeded,
         count(*) FILTER (status = 2) AS matched,
         max(end_time) - min(start_time) AS seconds FROM status)
SELECT *, {_duration("seconds")} AS elapsed FROM total""",
    "route_from_file": f"""WITH {_ORIGIN}
SELECT f.path, h.rule_id, 'from ' || r.pattern AS name
FROM files f LEFT JOIN hits h ON h.metadata = f.metadata LEFT JOIN rules r ON r.rule_id = h.rule_id""",
    "route_legacy_file": f"""WITH {_ORIGIN}
SELECT f.path, h.rule_id, 'from ' || r.pattern AS name, h.rule_id IS NOT NULL AS encrypt,
       CASE WHEN h.rule_id IS NOT NULL THEN 'open' END AS user_pass
FROM files f LEFT JOIN hits h ON h.metadata = f.metadata LEFT JOIN rules r ON r.rule_id = h.rule_id""",
    "scan_top_level": """SELECT '/doc_' || doc_id || '.PDF' AS path, strlen(text)::BIGINT AS length, text
FROM documents WHERE lang = 'en'""",
    "rescan_folder": """SELECT '/' || doc_id % 5 || '/doc_' || doc_id || '.pdf' AS path,
       CASE WHEN doc_id % 13 = 0 THEN 'gone' WHEN doc_id % 11 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS state,
       CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN text WHEN doc_id % 7 = 0 THEN text || '!' END AS text
FROM documents""",
    "page_ranges": f"WITH {PAGED} SELECT path, page_no, text, false AS unreadable FROM paged",
    "route_folder": _manifest(CANONICAL),
    "split_then_route": _manifest(CANONICAL, source=_named(CANONICAL).replace(FILES, _CHUNK_FILES)),
    "document_text": f"""WITH {PAGED}
SELECT path, string_agg(text, '' ORDER BY page_no) AS text FROM paged GROUP BY path""",
    "page_counts": f"WITH {PAGED} SELECT path, count(*) AS page_count FROM paged GROUP BY path",
    "chunk_text": _CHUNK_TEXT,
    "chunk_names": f"""WITH {_CHUNKS}
SELECT path, chunk, conv_id || '-' || last_page || '.pdf' AS chunk_name, first_page, last_page
FROM chunks""",
    "chunk_counts": f"""WITH {PAGED}
SELECT path, count(*) AS page_count, (floor((count(*) - 1) / 3) + 1)::BIGINT AS chunk_count
FROM paged GROUP BY path""",
    "chunk_sink": _CHUNK_TEXT,
    "page_markers": f"WITH {_MARKED} SELECT path, text FROM marked",
    "split_markers": f"""WITH {PAGED}
SELECT path, page_no AS position, page_no || '頁' AS page,
       {_preview("(chr(10) || text || chr(10))", 500)} AS preview
FROM paged""",
    "preview_pages": f"""WITH {PAGED}
SELECT path, page_no, {_preview("text", 500)} AS preview FROM paged WHERE page_no <= 3""",
    "preview_stripped": f"""WITH {PAGED}
SELECT path, page_no, {_preview("replace(text, ' ', '')", 500)} AS preview FROM paged""",
    "preview_first": f"""WITH {PAGED}
SELECT path, page_no, {_preview("text", 500)} AS preview
FROM paged WHERE page_no = 1 ORDER BY path LIMIT 1""",
    "path_parts": rf"""WITH {WEB}
SELECT path, url, {_BASE} AS base,
       regexp_extract(replace(url, '\', '/'), '(?s)^(.*[^/])/+[^/]*$', 1) AS dir,
       {_STEM} AS stem, regexp_replace({_BASE}, '(?s)\.[^.]*$', '') AS legacy_stem, {_EXT} AS ext,
       CASE WHEN length({_STEM}) <= 6 THEN {_BASE}
            ELSE left({_STEM}, 3) || '...' || right({_STEM}, 3) || {_EXT} END AS shown,
       path ILIKE '%.pdf' AS is_pdf
FROM web""",
    "page_text": f"""WITH {WEB}
SELECT path, regexp_replace(regexp_replace(html,
         '(?is)<script.*?</script>|<style.*?</style>|<title>.*?</title>', '', 'g'),
         '(?s)<[^>]*>', '', 'g') AS text
FROM web""",
    "page_meta": f"""WITH {WEB}
SELECT path, regexp_extract(html, '(?is)<title>(.*?)</title>', 1)
         || regexp_extract(url, '[?&]ref=([^&#]*)', 1)
         || regexp_extract(url, '[?&]page=([^&#]*)', 1) || url AS metadata
FROM web""",
    "text_fallback": f"""WITH {WEB},
parts AS (
  SELECT path, regexp_extract(html, '<p>([^<]*%%%[^<]*)<br>', 1) AS found,
         regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS given,
         replace(regexp_extract(html, '<title>([^<.]*)</title>', 1), ' ', '') AS title
  FROM web)
SELECT path,
       CASE WHEN found <> '' THEN found WHEN given <> '' THEN given ELSE title END AS normal,
       title AS forced, found AS forced_without,
       CASE WHEN given <> '' THEN given ELSE found END AS first
FROM parts""",
    "ocr_flatten": f"""WITH {PAGED},
items AS (
  SELECT path, page_no,
         list_filter(flatten(list_transform(string_split(text, chr(10)),
                                            lambda line: string_split(line, ','))),
                     lambda item: item <> '') AS found
  FROM paged)
SELECT path, page_no,
       CASE WHEN len(found) = 0 THEN '' ELSE array_to_string(found, chr(10)) || chr(10) END AS text,
       CASE WHEN len(found) = 0 THEN ''
            ELSE replace(array_to_string(found, chr(10)) || chr(10), ' ', '') END AS dense
FROM items""",
    "extract_pages": f"""WITH {FILES},
split AS (SELECT path, strlen(text)::VARCHAR AS metadata, string_split(text, chr(10)) AS lines FROM files)
SELECT path, metadata, unnest(range(1, len(lines) + 1))::INTEGER AS page_no, unnest(lines) AS text
FROM split""",
    "map_files": f"""WITH {FILES}
SELECT path, NOT contains(text, '@') AS ok,
       CASE WHEN NOT contains(text, '@') THEN length(text)::BIGINT END AS result,
       CASE WHEN contains(text, '@') THEN 'address found' END AS error,
       CASE WHEN contains(text, '@') THEN 3 ELSE 2 END::INTEGER AS status,
       CASE WHEN contains(text, '@') THEN '處理文件時出錯: address found' ELSE '處理完成' END AS message
FROM files""",
    "text_sidecars": f"""WITH placed AS ({_manifest(CANONICAL)}),
{FILES}
SELECT regexp_replace(coalesce(p.target_path, p.path), '\\.pdf$', '_ocr.txt') AS sidecar_path,
       '===== 第1頁 =====' || chr(10) || f.text || chr(10) AS text
FROM files f JOIN placed p ON p.path = f.path WHERE strlen(f.text) % 2 = 1""",
    "sidecar_files": f"""WITH placed AS ({_manifest(CANONICAL)}),
{FILES}
SELECT regexp_replace(coalesce(p.target_path, p.path), '\\.pdf$', '_ocr.txt') AS sidecar_path,
       '===== 第1頁 =====' || chr(10) || f.text || chr(10) AS text, true AS marked
FROM files f JOIN placed p ON p.path = f.path WHERE strlen(f.text) % 2 = 1""",
    "protect_roundtrip": f"""WITH {FILES},
routed AS (SELECT path, text, {_case(CANONICAL, 0)}::INTEGER AS rule_id FROM files)
SELECT path, rule_id, coalesce(rule_id IN (1, 8), false) AS protected, coalesce(rule_id = 1, false) AS has_owner,
       text AS user_text, CASE WHEN rule_id IS DISTINCT FROM 8 THEN text END AS owner_text
FROM routed""",
    "rule_rows": """WITH raw AS (
  SELECT *, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN ''
                 ELSE regexp_extract(props, '[0-9]+') END AS number
  FROM events)
SELECT event_id, event_type AS pattern, 'user ' || user_id AS name, '內容' AS target,
       CASE WHEN number <> '' THEN number::INTEGER ELSE 1 END AS min_hits,
       CASE WHEN event_type = 'error' THEN 'pA''s' ELSE '' END AS user_pass,
       CASE WHEN event_type = 'purchase' THEN 'secret' ELSE 'owner' END AS owner_pass,
       event_type IN ('error', 'purchase') AS encrypt
FROM raw""",
    "status_latest": f"WITH {STATUS} SELECT * FROM status",
    "status_counts": f"""WITH {LISTED}
SELECT count(*) FILTER ({_STATE} = 'pending') AS pending, count(*) FILTER ({_STATE} = 'queued') AS queued,
       count(*) FILTER (status = 1) AS processing, count(*) FILTER (status = 2) AS completed,
       count(*) FILTER (status = 3) AS failed, count(*) AS total
FROM status""",
    "simple_status_counts": f"""WITH {STATUS}
SELECT count(*) FILTER (status = 0) AS pending, count(*) FILTER (status = 1) AS processing,
       count(*) FILTER (status = 2) AS completed, count(*) FILTER (status = 3) AS failed,
       count(*) AS total
FROM status""",
    "all_done": f"""WITH {STATUS}
SELECT count(*) AS total, count(*) FILTER (status = 2) AS done,
       count(*) > 0 AND count(*) = count(*) FILTER (status = 2) AS finished
FROM status""",
    "progress": f"""WITH {STATUS}
SELECT count(*) FILTER (status = 2) AS done, count(*) AS total,
       printf('%.1f', 100.0::DOUBLE * (count(*) FILTER (status = 2) / count(*)::DOUBLE)) || '%' AS progress
FROM status""",
    "insert_missing": f"""WITH {UPDATES},
known AS ({_fold("status = 3")}),
{FILES},
wanted AS (SELECT path FROM updates UNION SELECT path FROM files)
SELECT * FROM known
UNION ALL
SELECT path, 0, '等待處理', NULL, NULL, NULL FROM wanted
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.path = wanted.path)""",
    "merge_status": f"""WITH {UPDATES},
o AS ({_fold("status IN (0, 1)")}),
n AS ({_fold("status IN (2, 3)", message="{}")})
SELECT coalesce(n.path, o.path) AS path, coalesce(n.status, o.status) AS status,
       coalesce(n.message, o.message, '') AS message, coalesce(n.thread, o.thread) AS thread,
       coalesce(o.start_time, n.start_time) AS start_time, coalesce(n.end_time, o.end_time) AS end_time
FROM o FULL JOIN n ON o.path = n.path""",
    "merge_stored": f"""WITH {UPDATES},
o AS ({_fold("status IN (0, 1)")}),
n AS ({_fold("status IN (2, 3)", message="{}")})
SELECT coalesce(n.path, o.path) AS path, coalesce(n.status, o.status) AS status,
       coalesce(n.message, o.message, '') AS message, coalesce(n.thread, o.thread) AS thread,
       coalesce(o.start_time, n.start_time) AS start_time, coalesce(n.end_time, o.end_time) AS end_time
FROM o FULL JOIN n ON o.path = n.path""",
    "status_lookup": f"WITH {STATUS} SELECT * FROM status WHERE path = '/jobs/file_7.pdf'",
    "pending_limit": f"""WITH {STATUS}
SELECT path FROM status WHERE status = 0 ORDER BY path LIMIT 20""",
    "recent_errors": f"""WITH {LOG}
SELECT * FROM log WHERE level = '错误' ORDER BY timestamp DESC, seq LIMIT 5""",
    "state_sample": f"""WITH {STATUS},
named AS (
  SELECT path, {_STATE} AS state, regexp_extract(path, 'file_[0-9]+') AS stem FROM status),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY path) AS position,
         count(*) OVER (PARTITION BY state) AS files
  FROM named)
SELECT state, position::INTEGER AS position, path,
       CASE WHEN length(stem) <= 6 THEN stem ELSE left(stem, 3) || '...' || right(stem, 3) END
         || '.pdf' AS shown,
       greatest(files - 3, 0) AS more
FROM ranked WHERE position <= 3""",
    "display_states": f"WITH {UPDATES} SELECT seq, {_STATE} AS state, {_LABEL} AS label FROM updates",
    "status_export": _EXPORT,
    "status_csv": _EXPORT,
    "log_csv": f"""WITH {LOG}
SELECT timestamp AS "時間戳", coalesce(level, '未知') AS "級別", coalesce(thread, '未知') AS "線程",
       message AS "消息"
FROM log""",
    "durations": f"""WITH {UPDATES},
spans AS (SELECT path, max(ts) - min(ts) AS whole, count(*) AS updates FROM updates GROUP BY path)
SELECT path, {_duration("whole")} AS whole, {_duration("whole / (updates * 50)")} AS short,
       {_duration("whole / (updates * 3000)")} AS shortest
FROM spans""",
    "stream_status": f"WITH {STATUS} SELECT * FROM status",
    "stream_compacted": f"""WITH {STATUS}
SELECT count(*) FILTER ({_STATE} = 'pending') AS pending, count(*) FILTER ({_STATE} = 'queued') AS queued,
       count(*) FILTER (status = 1) AS processing, count(*) FILTER (status = 2) AS completed,
       count(*) FILTER (status = 3) AS failed, count(*) AS total
FROM status""",
    "stream_route": _manifest(CANONICAL),
}
