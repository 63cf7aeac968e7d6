"""DuckDB statements of what SQL can express of the corpus operators."""

from __future__ import annotations

# The patterns as RE2 has them.  A host is any run of host characters, kept where it ends in one of the suffixes.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
IDENT = r"""(?i:user_?name|user_?id|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
OPAQUE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres|mysql|redis|mongodb|amqp)://[A-Za-z0-9.:@/_-]+|[a-z0-9.-]+"
PLACE = r"://|[a-z0-9-]\.(?:amazonaws\.com|internal|cloud)\.?$"
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _spans_sql(name: str, pattern: str, rank: int, least: int = 1, most: int = 2**31 - 1, group: int = 0, asked: tuple[str, ...] = (), only: str | None = None) -> str:
    """Matches with their starts: lengths of matches and of what lies between, added up in order."""
    test = "".join(f" AND regexp_matches(w, '{_q(x)}')" for x in asked)
    given = f" WHERE regexp_matches(text, '{_q(only)}')" if only else ""
    return f"""{name} AS (SELECT r, {rank} AS rank, s AS start, s + length(w) AS stop FROM (
  SELECT r, w, v, CAST(sum(length(b) + length(w)) OVER (PARTITION BY r ORDER BY i) - length(w) AS BIGINT) AS s FROM (
    SELECT r, unnest(w) AS w, unnest(v) AS v, unnest(b[1:len(w)]) AS b, unnest(range(1, len(w) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(text, '{_q(pattern)}', 0) AS w, regexp_extract_all(text, '{_q(pattern)}', {group}) AS v, string_split_regex(text, '{_q(pattern)}') AS b FROM d{given})))
  WHERE length(v) BETWEEN {least} AND {most}{test})"""


def secrets_sql(reach: int = 200) -> str:
    names = "CASE rank " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    listed = f"string_agg({names} || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"
    role = "CASE WHEN rank IN (1, 3) THEN 0 WHEN rank = 5 THEN 2 ELSE 1 END"
    kinds = [
        _spans_sql("a", ASSIGN, 0, 6, group=2),
        _spans_sql("k", ACCESS, 1, 20),
        _spans_sql("h", HEX, 2, 24),
        _spans_sql("i1", IDENT, 3),
        _spans_sql("o1", OPAQUE, 4, asked=("[0-9]", "[a-z]", "[A-Z]")),
        _spans_sql("o2", ASSIGN, 4, 1, 5, group=2),
        _spans_sql("e1", ENDPOINT, 5, asked=(PLACE,), only=r"://|\.(?:amazonaws\.com|internal|cloud)"),
    ]
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), {", ".join(kinds)},
base AS (SELECT * FROM a UNION ALL SELECT * FROM k UNION ALL SELECT * FROM h),
free AS (SELECT DISTINCT * FROM (SELECT * FROM i1 UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o2 UNION ALL SELECT * FROM e1) w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND w.start < b.stop AND b.start < w.stop)),
part AS (SELECT *, {role} AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM free)),
linked AS (SELECT DISTINCT l.r, l.rank, l.start, l.stop FROM part l JOIN part o ON l.r = o.r AND l.rank >= 3
  AND greatest(l.start, o.start) - least(l.stop, o.stop) <= {reach} AND (l.stop <= o.start OR o.stop <= l.start) AND (l.role = 1) <> (o.role = 1)),
b AS (SELECT r, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, {listed} AS t FROM base GROUP BY r),
s AS (SELECT r, {listed} AS t, count(*) FILTER (rank >= 3) AS n FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY r)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(b.t, '')) AS base_sha256, coalesce(s.t, '') AS spans, CAST(coalesce(s.n, 0) AS BIGINT) AS n_linked
FROM d LEFT JOIN b USING (r) LEFT JOIN s USING (r)"""


def embeddings_sql(limit: float = 0.9) -> str:
    """Cosines of all pairs; components by recursion."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {limit}),
rc(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.j, rc.c FROM rc JOIN p ON p.i = rc.id),
m AS (SELECT id, MIN(c) AS c FROM rc GROUP BY 1), n AS (SELECT i, COUNT(*) AS n FROM p GROUP BY 1)
SELECT CAST(id AS BIGINT) AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(c AS BIGINT) AS component_id, id = c AS kept FROM m LEFT JOIN n ON n.i = m.id"""


def near_duplicates_sql(percent: int = 85) -> str:
    """Three-word shingle sets, sizes of all intersections, components by recursion."""
    upper = "".join(chr(c) for c in range(65, 91))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN array_to_string(w[i:i+2], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS i, y.doc_id AS j, COUNT(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT i, j FROM b JOIN n a ON a.doc_id = i JOIN n c ON c.doc_id = j WHERE 100 * k >= {percent} * (a.n + c.n - k)),
rc(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.j, rc.c FROM rc JOIN p ON p.i = rc.id),
m AS (SELECT id, MIN(c) AS c FROM rc GROUP BY 1)
SELECT CAST(id AS BIGINT) AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(c AS BIGINT) AS component_id, id = c AS kept FROM m LEFT JOIN n ON n.doc_id = m.id"""


# crc32: the polynomial's remainders of all bytes, then a fold over the bytes of the text
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(n AS BIGINT))) AS crc_of"


def crc_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, next to a column crc_of."""
    octets = f"list_transform(range(CAST(octet_length(encode({text})) AS BIGINT)), lambda k: CAST(concat('0x', substr(hex(encode({text})), CAST(2 * k + 1 AS BIGINT), 2)) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


def resample_sql(percent: int = 10, least_words: int = 20, buckets: int = 10_000, seed: str = "2024") -> str:
    """Features of all texts, gains by bucket, scores and ranks; the crc32 of each distinct word is taken once."""
    upper = "".join(chr(c) for c in range(65, 91))
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    fresh = f"CAST(concat('0x', substr(sha256(concat('{seed}:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 8)) AS BIGINT)"
    return f"""WITH c AS ({CRC_TABLE}), d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
u AS MATERIALIZED (SELECT r, unnest(w) AS w FROM d), v AS MATERIALIZED (SELECT unnest({words}) AS w FROM benchmark),
k AS MATERIALIZED (SELECT w, {crc_sql('w')} % {buckets} AS b FROM (SELECT w FROM u UNION SELECT w FROM v), c),
s AS (SELECT b, count(*) AS n FROM u JOIN k USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM v JOIN k USING (w) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + CAST(1 AS DOUBLE)) * ((SELECT count(*) FROM u) + CAST({buckets} AS DOUBLE))
  / ((coalesce(s.n, 0) + CAST(1 AS DOUBLE)) * ((SELECT count(*) FROM v) + CAST({buckets} AS DOUBLE))))) AS BIGINT) AS gain FROM (SELECT DISTINCT b FROM k) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
m AS (SELECT r, CAST(sum(gain) AS BIGINT) AS total FROM u JOIN k USING (w) JOIN g USING (b) GROUP BY r),
f AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(floor(coalesce(total, 0) / greatest(1, len(w))) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln(({fresh} + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS luck FROM d LEFT JOIN m USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY weight + luck DESC, doc_id NULLS LAST, n_features) AS place,
  count(*) FILTER (n_features >= {least_words}) OVER () AS n FROM f)
SELECT CAST(doc_id AS BIGINT) AS doc_id, n_features, weight, weight + luck AS score, CASE WHEN n_features >= {least_words} AND place <= {percent} * n // 100 THEN CAST(place AS BIGINT) END AS rank FROM o"""


def repair_sql() -> str:
    """Damage, faults, and the cheapest edits row by row: for each state of the automaton the least (cost, audit), with up to two insertions before a row."""
    insert = "(VALUES (0, 0, 0, '', ''), (0, 2, 5, 'I', 'user:\n'), (0, 3, 10, 'II', 'user:\nassistant:\n'), (1, 1, 0, '', ''), (1, 2, 5, 'I', 'user:\n'), (1, 3, 10, 'II', 'user:\nassistant:\n'), (2, 2, 0, '', ''), (2, 3, 5, 'I', 'assistant:\n'), (3, 3, 0, '', ''), (3, 2, 5, 'I', 'user:\n')) AS n(q, p, cost, audit, line)"
    row = "(VALUES (0, 's', 1, 'K'), (0, 'u', 2, 'K'), (1, 'u', 2, 'K'), (3, 'u', 2, 'K'), (2, 'a', 3, 'K'), (0, NULL, 2, 'R'), (1, NULL, 2, 'R'), (3, NULL, 2, 'R'), (2, NULL, 3, 'R'), (0, NULL, 0, 'D'), (1, NULL, 1, 'D'), (2, NULL, 2, 'D'), (3, NULL, 3, 'D')) AS t(q, initial, p, letter)"
    return f"""WITH RECURSIVE c AS ({CRC_TABLE}),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
h AS MATERIALIZED (SELECT k.*, {crc_sql('key')} % 20 AS kind FROM k, c),
e AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0)),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM e),
g AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS wrong, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS after FROM f),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (wrong = 1) AS blank, count(*) FILTER (wrong = 2) AS duplicate, count(*) FILTER (wrong = 3) AS truncated,
  count(*) FILTER (after IS NOT NULL AND concat(initial, '-', after) NOT IN ('s-u', 'u-a', 'a-u')) AS illegal FROM g GROUP BY conv_id),
w(conv_id, i, q, best) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'told': ''}} FROM g
 UNION ALL SELECT w.conv_id, w.i + 1, t.p, min({{'cost': CAST(w.best.cost + n.cost + CASE t.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN t.letter <> 'D' AND g.wrong = 3 THEN 5 ELSE 0 END AS BIGINT),
   'audit': w.best.audit || n.audit || t.letter, 'told': w.best.told || n.line || CASE t.letter WHEN 'D' THEN '' ELSE concat(CASE WHEN t.letter = 'K' THEN g.role WHEN t.p = 2 THEN 'user' ELSE 'assistant' END, ':', g.text, chr(10)) END}})
 FROM w JOIN {insert} ON n.q = w.q JOIN {row} ON t.q = n.p JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1
 WHERE (t.letter <> 'K' OR t.initial = g.initial) AND (t.letter = 'D' OR g.wrong NOT IN (1, 2)) GROUP BY w.conv_id, w.i + 1, t.p),
z AS (SELECT w.conv_id, min({{'cost': w.best.cost + n.cost, 'audit': w.best.audit || n.audit, 'told': w.best.told || n.line}}) AS best
  FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i JOIN {insert} ON n.q = w.q WHERE n.p IN (0, 3) GROUP BY w.conv_id)
SELECT CAST(o.conv_id AS BIGINT) AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(z.best.cost, 0) AS BIGINT) AS cost, coalesce(z.best.audit, '') AS audit,
  sha256(coalesce(left(z.best.told, CAST(greatest(0, length(z.best.told) - 1) AS BIGINT)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id"""
