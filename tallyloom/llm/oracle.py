"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = r"[\x20\x09-\x0D]+"
WORDS = rf"list_filter(regexp_split_to_array(COALESCE(text, ''), '{SPACE}'), lambda x: x <> '')"
LINES = "SELECT doc_id, unnest(string_split(COALESCE(text, ''), chr(10))) AS line, generate_subscripts(string_split(COALESCE(text, ''), chr(10)), 1) AS pos FROM documents"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("COALESCE(text, '')")}, '{ALNUM}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER.format("COALESCE(text, '')")}, '{ALNUM}') AS w FROM benchmark),
iw AS (SELECT item, least(13, len(w)) AS m, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
ik AS (SELECT DISTINCT item, m, array_to_string(w[p : p + m - 1], ' ') AS k FROM iw),
dw AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT m FROM ik) WHERE len(w) >= m),
hit AS (SELECT doc_id, p, dk.m, item FROM (SELECT doc_id, p, m, array_to_string(w[p : p + m - 1], ' ') AS k FROM dw) dk JOIN ik ON dk.m = ik.m AND dk.k = ik.k),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP3 = f"""WITH l AS (SELECT *, {LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM ({LINES})),
f AS (SELECT k FROM (SELECT DISTINCT doc_id, k FROM l WHERE k <> '') GROUP BY k HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT *, k IN (SELECT k FROM f) AS gone FROM l) GROUP BY doc_id"""

OP7 = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
least_of AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM win JOIN least_of USING (k) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM d)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(gone.q) AS n_removed, sha256(COALESCE(string_agg(x, ' ' ORDER BY word.q) FILTER (gone.q IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN word ON d.doc_id = word.doc_id LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.q = word.q GROUP BY d.doc_id"""


def _count(chars: str) -> str:
    return f"CAST(length(regexp_replace(COALESCE(text, ''), '[^{chars}]', '', 'g')) AS BIGINT)"


OP9 = rf"""WITH d AS (SELECT doc_id, {WORDS} AS w, CAST(length(regexp_replace(COALESCE(text, ''), '{SPACE}', '', 'g')) AS BIGINT) AS word_chars, {_count("#*$%&|<>")} AS n_symbols, {_count("A-Z")} AS up, {_count("a-z")} AS low, {_count("!")} AS excl FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM ({LINES}) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
t AS (SELECT doc_id, p, array_to_string(w[p : p + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM t JOIN (SELECT doc_id, k FROM t GROUP BY ALL HAVING count(*) >= 2) USING (doc_id, k)) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, word_chars, n_symbols, COALESCE(dup, 0) AS n_dup_lines, COALESCE(r.n, 0) AS n_repeat_words, COALESCE(n_lines, 0) AS n_lines, up, low, excl FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR up > low OR 2 * excl > n_words OR 10 * n_dup_lines > 4 * n_lines OR word_chars < 3 * n_words OR word_chars > 12 * n_words) AS kept FROM s"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Codes and errors by exact inner products; a round is one CTE for the assignment and one for the means."""
    kept = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    ctes = [
        f"k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {kept})",
        f"p AS MATERIALIZED (SELECT r, part, v[1 + part * len(v) // {parts} : (part + 1) * len(v) // {parts}] AS x FROM k CROSS JOIN (SELECT unnest(range({parts})) AS part))",
        f"c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS y FROM p WHERE r <= {entries})",
    ]
    square = "list_inner_product({0}, {0})"
    for i in range(rounds + 1):
        near = f"{square.format('x')} - 2 * list_inner_product(x, y) + {square.format('y')}"
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, part, any_value(x) AS x, min(d) AS d, min_by(entry, (d, entry)) AS entry FROM (SELECT r, part, entry, x, {near} AS d FROM p JOIN c{i} USING (part)) GROUP BY r, part)")
        if i < rounds:
            parted = f"SELECT part, entry, pos, floor(sum(v) / count(*)) AS m FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY part, entry, pos"
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT part, entry, COALESCE(z, y) AS y FROM c{i} LEFT JOIN (SELECT part, entry, list(m ORDER BY pos) AS z FROM ({parted}) GROUP BY part, entry) USING (part, entry))")
    last = f"SELECT r, CAST(sum(d) AS BIGINT) AS error, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code FROM a{rounds} GROUP BY r"
    books = f"SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(y) AS v, generate_subscripts(y, 1) AS pos FROM c{rounds})"
    total = "CAST(sum(error) OVER (PARTITION BY label) AS BIGINT)"
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, {total} AS label_error, codebooks_sha256 FROM k JOIN ({last}) USING (r) CROSS JOIN ({books})"


def _levels(name: str, start: str, depth: int) -> tuple[list[str], str]:
    """CTEs name0 (key, pos, h, n), name1, ... of a tree with 16 children a node, and SQL of what remains for each key."""
    ctes = [f"{name}0 AS MATERIALIZED ({start})"]
    for i in range(1, depth + 1):
        ctes.append(
            f"{name}{i} AS MATERIALIZED (SELECT key, pos // 16 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, list(h ORDER BY pos) AS hs, any_value((n + 15) // 16) AS n FROM {name}{i - 1} WHERE n > 1 GROUP BY key, pos // 16)"
        )
    return ctes, " UNION ALL ".join(f"SELECT key, h FROM {name}{i} WHERE n = 1" for i in range(depth + 1))


def _climb(name: str, depth: int) -> tuple[str, str, str]:
    """Joins from a row t (key, pos) to its parents, its siblings, and its folded hash."""
    joins, around, node = [], [], "{0}"
    for i in range(1, depth + 1):
        slot = f"(t.pos // {16 ** (i - 1)}) % 16"
        left, right = f"array_to_string({name}{i}.hs[1 : {slot}], '')", f"array_to_string({name}{i}.hs[{slot} + 2 :], '')"
        joins.append(f"LEFT JOIN {name}{i} ON {name}{i}.key = t.key AND {name}{i}.pos = t.pos // {16**i}")
        around.append(f"COALESCE({left} || {right}, '')")
        node = f"CASE WHEN {name}{i}.key IS NULL THEN {node} ELSE sha256({left} || {node} || {right}) END"
    return " ".join(joins), " || ".join(around), node


def merkle(depth: int = 5, top: int = 3) -> str:
    """Trees of up to 16^depth documents a source and 16^top sources; a null source sorts first as the empty key."""
    leaf = "sha256(" + " || ".join(f"COALESCE(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
    tables = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT)))"
    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: xor(c >> 8, crc_table.t[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295)"
    lowered = LOWER.format("text")
    start = f"SELECT COALESCE('=' || source, '') AS key, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, {leaf.format('text')} AS h, count(*) OVER (PARTITION BY source) AS n, doc_id, CASE WHEN {crc} % 5 = 0 THEN {leaf.format(lowered)} END AS tampered FROM documents, crc_table"
    low, tops = _levels("l", start, depth)
    high, root = _levels("g", f"SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, h, count(*) OVER () AS n, key AS grp FROM ({tops})", top)
    joins, around, node = _climb("l", depth)
    up_joins, up_around, up_node = _climb("g", top)
    ctes = [f"crc_table AS MATERIALIZED (SELECT {tables} AS t)", *low, *high]
    ctes.append(f"inner_fold AS MATERIALIZED (SELECT t.key AS grp, t.doc_id, t.h AS leaf, {around} AS near, {node.format('COALESCE(t.tampered, t.h)')} AS folded FROM l0 t {joins})")
    outer = f"SELECT f.doc_id, f.leaf, t.h AS subroot, (SELECT h FROM ({root})) AS root, sha256(f.near || {up_around}) AS proof_sha256, {up_node.format('f.folded')} AS folded_root FROM inner_fold f JOIN g0 t ON t.grp = f.grp {up_joins}"
    return f"WITH {', '.join(ctes)} SELECT *, folded_root = root AS verified FROM ({outer})"
