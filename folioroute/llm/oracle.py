"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

_REACH = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT a AS id, a AS seen FROM both_ways
  UNION SELECT b.b, r.seen FROM reach r JOIN both_ways b ON b.a = r.id),
component AS (SELECT id, min(seen) AS least FROM reach GROUP BY id)"""

ORACLE: dict[str, str] = {
    "op3_embeddings": f"""WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND isfinite(list_sum(embedding::DOUBLE[])) AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y
  ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_REACH},
degree AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, vec_id) AS component_id,
       coalesce(least, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN degree d ON d.id = vec_id LEFT JOIN component c ON c.id = vec_id""",
    "op5_jaccard": f"""WITH RECURSIVE words AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN w[i:i + 4] ELSE w END AS g
  FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y
  ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
{_REACH}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN component c ON c.id = d.doc_id""",
    "op9_decontaminate": f"""WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, w[i:i + 9] AS win
  FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS k FROM windows),
spots AS (
  SELECT doc_id, i, k, w[i:i + k - 1] AS win
  FROM docs, sizes, unnest(generate_series(1, len(w) - k + 1)) AS t(i)),
hits AS (SELECT doc_id, i, k, item FROM spots JOIN windows USING (win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(generate_series(i, i + k - 1)) AS t(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id""",
}

# crc32 by its table, which follows from the polynomial (a fixed value); ``hex`` is the input's bytes in hexadecimal.
_CRC_TABLE = """crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) AS r(i)))"""


def _crc32(text: str) -> str:
    bits = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(f) for f in ('doc_id', 'source', 'lang', 'n_chars'))} || {_field(text)})"


def _tree(name: str, leaves: str) -> str:
    """Nodes of the trees ``grp`` over ``leaves`` (grp, i, h, n), and the children of each."""
    return f"""{name} AS (
  SELECT grp, 0 AS k, i, h, n FROM {leaves}
  UNION ALL
  SELECT grp, k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), max((n + 7) // 8) FROM {name} WHERE n > 1 GROUP BY grp, k, i // 8),
{name}_kids AS (SELECT grp, k, i // 8 AS p, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY grp, k, i // 8)"""


def _climb(name: str, start: str, kids: str) -> str:
    """From ``start`` (id, grp, i, cur, proof) up to the root of the tree."""
    return f"""{name} AS (
  SELECT id, grp, 0 AS k, i, cur, proof FROM {start}
  UNION ALL
  SELECT id, c.grp, c.k + 1, i // 8, sha256(array_to_string(list_concat(hs[1:i % 8], [cur], hs[i % 8 + 2:]), '')),
         proof || array_to_string(list_concat(hs[1:i % 8], hs[i % 8 + 2:]), '')
  FROM {name} c JOIN {kids} s ON s.grp = c.grp AND s.k = c.k AND s.p = c.i // 8),
{name}_end AS (SELECT id, arg_max(cur, k) AS cur, arg_max(proof, k) AS proof FROM {name} GROUP BY id)"""


ORACLE |= {
    "op12_merkle": f"""WITH RECURSIVE {_CRC_TABLE},
base AS (
  SELECT row_number() OVER () AS id, doc_id, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS grp, {_leaf("text")} AS h,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents, crc),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h, id) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM base),
{_tree("nodes", "leaves")},
roots AS (SELECT grp, h AS subroot FROM nodes WHERE n = 1),
upper AS (SELECT 0 AS grp, grp AS i, subroot AS h, (SELECT count(*) FROM roots) AS n FROM roots),
{_tree("top", "upper")},
start AS (SELECT id, grp, i, coalesce(other, h) AS cur, '' AS proof FROM leaves),
{_climb("path", "start", "nodes_kids")},
again AS (SELECT id, 0 AS grp, l.grp AS i, e.cur, e.proof FROM path_end e JOIN leaves l USING (id)),
{_climb("way", "again", "top_kids")}
SELECT doc_id, l.h AS leaf, subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.cur AS folded_root, w.cur = r.h AS verified
FROM leaves l JOIN roots USING (grp) JOIN way_end w USING (id) JOIN top r ON r.n = 1""",
    "op13_spelling": f"""WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc32("s")} AS h FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs), crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.rest),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS other_n
  FROM (SELECT near.word, other, n FROM near JOIN words ON words.word = other) GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
follow AS (
  SELECT word, word AS last, 0 AS step FROM formed
  UNION ALL SELECT f.word, x.form, step + 1 FROM follow f JOIN formed x ON x.word = f.last WHERE x.form IS NOT NULL),
root AS (SELECT word, arg_max(last, step) AS root FROM follow GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN root USING (word)""",
}
