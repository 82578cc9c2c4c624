"""DuckDB SQL for the operators that SQL can express."""

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM.format("text")} AS w FROM documents),
b AS (SELECT item_id, {ALNUM.format("text")} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, len(list_slice(w, i, i + least(10, len(w)) - 1)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM p),
o AS (SELECT r, i, k.n, array_to_string(list_slice(w, i, i + k.n - 1), ' ') AS s
      FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), k WHERE i + k.n - 1 <= len(w)),
m AS (SELECT o.r, o.i, o.n, p.item_id FROM o JOIN p ON o.n = p.n AND o.s = p.s),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

OP5 = """
WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT row_number() OVER () AS r, page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
f AS (SELECT u.r, arg_max(k.host || k.path, length(k.host || k.path)) AS rule, arg_max(k.verdict, length(k.host || k.path)) AS verdict
      FROM u JOIN rules k ON (u.host = k.host OR ends_with(u.host, '.' || k.host)) AND starts_with(u.path, k.path) GROUP BY u.r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (r)
"""

OP7 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM w
"""

OP2 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)
"""


def _crc32(text: str) -> str:
    """crc32 of an ASCII string, bit by bit."""
    step = "list_reduce(list_prepend(x, [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: {step.replace('x,', 'xor(a, b),', 1)}), 4294967295)"


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(parts)})"


def _tree(name: str, levels: int) -> str:
    """Runs and nodes of each level above {name}0 (t, i, h, n)."""
    out = []
    for k in range(levels):
        out.append(f"{name}r{k} AS (SELECT t, i // 16 AS p, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {name}{k} WHERE n > 1 GROUP BY t, i // 16)")
        out.append(f"{name}{k + 1} AS (SELECT t, p AS i, sha256(array_to_string(hs, '')) AS h, (n + 15) // 16 AS n FROM {name}r{k} UNION ALL SELECT * FROM {name}{k} WHERE n = 1)")
    return ",\n".join(out)


def _climb(name: str, start: str, levels: int) -> str:
    """From {start} (d, t, i, f, p): the fold f and the siblings p after each level."""
    out = []
    for k in range(levels):
        before = start if k == 0 else f"{name}c{k - 1}"
        left, right = "array_to_string(hs[1:i % 16], '')", "array_to_string(hs[i % 16 + 2:], '')"
        out.append(f"{name}c{k} AS (SELECT d, c.t, i // 16 AS i, CASE WHEN hs IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN hs IS NULL THEN c.p ELSE c.p || {left} || {right} END AS p FROM {before} c LEFT JOIN {name}r{k} r ON c.t = r.t AND c.i // 16 = r.p)")
    return ",\n".join(out)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11 = f"""
WITH l AS (SELECT doc_id, coalesce('s' || source, '') AS t, {_leaf("text")} AS leaf, CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(_LOWER)} END AS claim FROM documents),
m AS (SELECT *, row_number() OVER () AS d, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM l),
a0 AS (SELECT t, i, leaf AS h, n FROM m),
{_tree("a", 6)},
s AS (SELECT t AS of_t, h, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM a6),
b0 AS (SELECT '' AS t, i, h, n FROM s),
{_tree("b", 4)},
start AS (SELECT d, t, i, coalesce(claim, leaf) AS f, '' AS p FROM m),
{_climb("a", "start", 6)},
middle AS (SELECT d, '' AS t, s.i, f, p FROM ac5 c JOIN s ON c.t = s.of_t),
{_climb("b", "middle", 4)}
SELECT doc_id, leaf, s.h AS subroot, b4.h AS root, sha256(c.p) AS proof_sha256, c.f AS folded_root, c.f = b4.h AS verified
FROM m JOIN bc3 c USING (d) JOIN s ON m.t = s.of_t CROSS JOIN b4
"""
