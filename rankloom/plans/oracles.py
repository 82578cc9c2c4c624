"""DuckDB SQL for the reference queries. Common table expressions are pulled in by name."""

from __future__ import annotations

import re

from rankloom.functions.text import STOP_WORDS
from rankloom.plans import fixtures

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
LABELS = "(VALUES ('E', 0), ('S', 1), ('C', 2), ('I', 3))"
KS = "(VALUES (10), (20), (50))"


def _impact(name: str) -> str:
    k = "(1.5e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl))"
    c = "(tf / (1 - 0.75e0 + 0.75e0 * dl / avgdl))"
    return {
        "lucene": f"ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf / (tf + {k})",
        "robertson": f"ln(greatest(1.0e0, (n - df + 0.5e0) / (df + 0.5e0))) * tf / (tf + {k})",
        "atire": f"ln(n / df) * tf * 2.5e0 / (tf + {k})",
        "bm25l": f"ln((n + 1) / (df + 0.5e0)) * (2.5e0 * ({c} + 0.5e0) / (1.5e0 + {c} + 0.5e0) - 2.5e0 * 0.5e0 / 2.0e0)",
        "bm25plus": f"ln((n + 1) / df) * (2.5e0 * tf / ({k} + tf))",
    }[name]


def _scored(items: str, queries: str, weight: str, keys: str = "query_id, item_id") -> str:
    return f"SELECT {keys}, round(sum({weight}), 6) AS score FROM {items} JOIN {queries} USING (term) GROUP BY {keys}"


def _ranked(source: str, keys: str = "query_id", order: str = "score DESC, item_id", top: int | None = 100) -> str:
    sql = f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rank FROM {source}"
    return f"SELECT * FROM ({sql}) WHERE rank <= {top}" if top else sql


def _gain(label: str, table: dict) -> str:
    return f"CASE {label} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {'0.0e0' if isinstance(table['E'], str) else 0} END"


def _mean(c: str) -> str:
    """The mean of values of 6 decimals, in whole millionths."""
    return f"round(avg(CAST(round(({c}) * 1e6) AS BIGINT))) / 1e6"


POOL = {"E": "1.0e0", "S": "0.7e0", "C": "0.5e0", "I": "0.0e0"}
GRADED = {"E": 3, "S": 2, "C": 1, "I": 0}

CTE: dict[str, str] = {n: fixtures.inlined(n) for n in fixtures.SQL} | {
    "itok": rf"SELECT item_id, t AS term FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS t FROM fx_catalog) WHERE t NOT IN ({STOPS})",
    "qtok": rf"SELECT query_id, t AS term FROM (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(query, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS t FROM fx_queries) WHERE t NOT IN ({STOPS})",
    "itf": "SELECT item_id, term, count(*) AS tf FROM itok GROUP BY ALL",
    "qtf": "SELECT query_id, term, count(*) AS qtf FROM qtok GROUP BY ALL",
    "stat": "SELECT item_id, term, CAST(tf AS DOUBLE) AS tf, CAST(dl AS DOUBLE) AS dl, CAST(df AS DOUBLE) AS df, CAST(n AS DOUBLE) AS n, CAST(total AS DOUBLE) / n AS avgdl FROM itf JOIN (SELECT item_id, sum(tf) AS dl FROM itf GROUP BY 1) USING (item_id) JOIN (SELECT term, count(*) AS df FROM itf GROUP BY 1) USING (term), (SELECT count(*) AS n FROM fx_catalog), (SELECT sum(tf) AS total FROM itf)",
    "post": f"SELECT item_id, term, CAST(tf AS BIGINT) AS tf, {_impact('lucene')} AS impact FROM stat",
    "bscore": _scored("post", "qtf", "impact * qtf"),
    "bm25": _ranked("bscore"),
    "pairs": "SELECT query_id, item_id, label, split FROM fx_qrels",
    "bcand": "SELECT p.query_id, p.item_id, coalesce(score, 0.0e0) AS score FROM pairs p LEFT JOIN bscore USING (query_id, item_id)",
    "sitem": "SELECT item_id, term, round(ln(1 + tf), 6) AS weight FROM itf",
    "squery": "SELECT query_id, term, round(ln(1 + qtf), 6) AS qw FROM qtf",
    "sscore": _scored("sitem", "squery", "weight * qw"),
    "sparse": _ranked("sscore"),
    "scand": "SELECT p.query_id, p.item_id, coalesce(score, 0.0e0) AS score FROM pairs p LEFT JOIN sscore USING (query_id, item_id)",
    "dscore": "SELECT query_id, item_id, round(list_sum(list_transform(list_zip(q.vector, i.vector), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6) AS score FROM fx_vectors q, fx_items i",
    "dense": _ranked("dscore"),
    "dcand": "SELECT p.query_id, p.item_id, coalesce(score, 0.0e0) AS score FROM pairs p LEFT JOIN dscore USING (query_id, item_id)",
    "runs": "SELECT query_id, 'bm25' AS method, 0 AS method_ord, item_id, score, rank FROM bm25 UNION ALL SELECT query_id, 'sparse', 1, item_id, score, rank FROM sparse UNION ALL SELECT query_id, 'dense', 2, item_id, score, rank FROM dense",
    "rrf_run": "SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, r, item_id) AS rank FROM (SELECT query_id, item_id, round(sum(1 / (60.0e0 + rank)), 12) AS score, min(method_ord) AS o, arg_min(rank, method_ord) AS r FROM runs GROUP BY ALL)",
    "norms": "SELECT *, round(CASE WHEN hi - lo < 1e-10 THEN 0.5e0 ELSE (score - lo) / (hi - lo) END, 6) AS norm FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM runs WINDOW w AS (PARTITION BY query_id, method))",
    "cruns": "SELECT query_id, 'bm25' AS method, 0 AS method_ord, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM bcand UNION ALL SELECT query_id, 'sparse', 1, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) FROM scand UNION ALL SELECT query_id, 'dense', 2, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) FROM dcand",
    "cnorms": "SELECT *, round(CASE WHEN hi - lo < 1e-10 THEN 0.5e0 ELSE (score - lo) / (hi - lo) END, 6) AS norm FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM cruns WINDOW w AS (PARTITION BY query_id, method))",
    "pool": "SELECT DISTINCT item_id FROM fx_qrels JOIN (SELECT query_id FROM fx_queries WHERE split = 'test' ORDER BY md5(concat('42:', query_id)), query_id LIMIT 20) USING (query_id)",
    # Relevance
    "each": f"SELECT query_id, method, k FROM (SELECT DISTINCT query_id FROM fx_qrels), (VALUES ('bm25'), ('sparse'), ('dense')) m(method), {KS} v(k)",
    "jrun": f"SELECT r.*, q.label, k FROM runs r LEFT JOIN fx_qrels q USING (query_id, item_id), {KS} v(k) WHERE rank <= k",
    "have": "SELECT query_id, count(*) FILTER (label = 'E') AS all_e, count(*) FILTER (label IN ('E', 'S')) AS all_es FROM fx_qrels GROUP BY 1",
    "rec": "SELECT method, query_id, k, round(CASE WHEN all_e > 0 THEN coalesce(e, 0) / all_e ELSE 0 END, 6) AS recall_exact, round(CASE WHEN all_es > 0 THEN coalesce(es, 0) / all_es ELSE 0 END, 6) AS recall_exact_sub FROM each LEFT JOIN (SELECT method, query_id, k, count(*) FILTER (label = 'E') AS e, count(*) FILTER (label IN ('E', 'S')) AS es FROM jrun GROUP BY ALL) USING (method, query_id, k) JOIN have USING (query_id)",
    "shr": "SELECT method, query_id, k, " + ", ".join(f"round(coalesce(s{i}, 0), 6) AS share_{x}" for i, x in enumerate(["e", "s", "c", "i", "unlabeled"])) + " FROM each LEFT JOIN (SELECT method, query_id, k, " + ", ".join(f"avg(CASE WHEN coalesce(label, 'unlabeled') = '{x}' THEN 1.0e0 ELSE 0.0e0 END) AS s{i}" for i, x in enumerate(["E", "S", "C", "I", "unlabeled"])) + " FROM jrun GROUP BY ALL) USING (method, query_id, k)",
    "ideal": f"SELECT query_id, k, sum(g / log2(pos + 1)) AS idcg FROM (SELECT query_id, g, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, item_id) AS pos FROM (SELECT *, {_gain('label', POOL)} AS g FROM fx_qrels)), {KS} v(k) WHERE pos <= k GROUP BY ALL",
    "cur": f"SELECT method, k, count(*) AS num_queries, round(coalesce(avg(CASE WHEN dcg IS NOT NULL THEN CASE WHEN coalesce(idcg, 0) > 0 THEN dcg / idcg ELSE 0 END END), 0), 6) AS ndcg, round(coalesce(avg(mrr), 0), 6) AS mrr, round(coalesce(avg(prec), 0), 6) AS precision, coalesce({_mean('CASE WHEN dcg IS NOT NULL THEN recall_exact END')}, 0) AS recall_exact, coalesce({_mean('CASE WHEN dcg IS NOT NULL THEN recall_exact_sub END')}, 0) AS recall_exact_sub FROM each LEFT JOIN (SELECT method, query_id, k, sum(g / log2(rank + 1)) AS dcg, coalesce(1.0e0 / min(CASE WHEN g > 0 THEN rank END), 0) AS mrr, avg(CASE WHEN g > 0 THEN 1.0e0 ELSE 0 END) AS prec FROM (SELECT *, {_gain('label', POOL)} AS g FROM jrun) GROUP BY ALL) USING (method, query_id, k) LEFT JOIN ideal USING (query_id, k) JOIN rec USING (method, query_id, k) GROUP BY ALL",
    "scored": "SELECT c.query_id, c.method, c.item_id, c.score, p.label FROM cruns c JOIN pairs p USING (query_id, item_id)",
    "pos": f"SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, item_id) AS pos, row_number() OVER (PARTITION BY method, query_id ORDER BY gain DESC, item_id) AS ideal FROM (SELECT *, {_gain('label', GRADED)} AS gain FROM scored)",
    "cm": f"SELECT method, query_id, k, round(CASE WHEN b > 0 THEN a / b ELSE 0 END, 6) AS ndcg, round(coalesce(1.0e0 / fr, 0), 6) AS mrr, round(pr, 6) AS precision, round(e, 6) AS share_e, round(s, 6) AS share_s, round(c, 6) AS share_c, round(i, 6) AS share_i FROM (SELECT method, query_id, k, sum(CASE WHEN pos <= k THEN gain / log2(pos + 1) ELSE 0 END) AS a, sum(CASE WHEN ideal <= k THEN gain / log2(ideal + 1) ELSE 0 END) AS b, min(CASE WHEN pos <= k AND gain >= 1 THEN pos END) AS fr, avg(CASE WHEN pos <= k THEN CASE WHEN gain >= 1 THEN 1.0e0 ELSE 0 END END) AS pr, "
    + ", ".join(f"avg(CASE WHEN pos <= k THEN CASE WHEN label = '{x}' THEN 1.0e0 ELSE 0 END END) AS {x.lower()}" for x in "ESCI") + f" FROM pos, {KS} v(k) GROUP BY ALL)",
    "auc": "SELECT method, round(CASE WHEN p > 0 AND q > 0 THEN (r - p * (p + 1) / 2) / (p * q) ELSE 0 END, 6) AS auc FROM (SELECT method, sum(p * (below + (n + 1) / 2.0e0)) AS r, CAST(sum(p) AS DOUBLE) AS p, CAST(sum(n - p) AS DOUBLE) AS q FROM (SELECT *, sum(n) OVER (PARTITION BY method ORDER BY score) - n AS below FROM (SELECT method, score, count(*) AS n, count(*) FILTER (label IN ('E', 'S', 'C')) AS p FROM scored GROUP BY ALL)) GROUP BY 1)",
    "cs": "SELECT * FROM (SELECT method, k, count(*) AS num_queries, " + ", ".join(f"{_mean(c)} AS {c}" for c in ["ndcg", "mrr", "precision", "share_e", "share_s", "share_c", "share_i"]) + " FROM cm GROUP BY ALL) JOIN auc USING (method)",
    # Labels
    "fx_responses": """SELECT query_id, item_id, label AS gold,
       CASE WHEN (item_id * 11 + query_id * 5) % 20 < 13 THEN concat(' ', lower(label), ' ') WHEN (item_id * 11 + query_id * 5) % 20 < 16 THEN 'Substitute'
            WHEN (item_id * 11 + query_id * 5) % 20 < 18 THEN 'E' WHEN (item_id * 11 + query_id * 5) % 20 < 19 THEN 'unknown' ELSE '' END AS raw,
       (item_id * 37 + query_id * 101) % 1500 + 100 AS latency_ms, 300 + (item_id % 200) AS tokens_in, 1 + (item_id % 2) AS tokens_out FROM fx_qrels""",
    "fx_store": "SELECT CAST(query_id AS STRING) AS query_id, CAST(item_id AS STRING) AS item_id, label, TIMESTAMP '2024-01-01 00:00:00' AS labeled_at FROM fx_qrels WHERE (item_id + query_id) % 3 = 0",
    "fx_news": "SELECT CAST(query_id AS STRING) AS query_id, CAST(item_id AS STRING) AS item_id, 'I' AS label, TIMESTAMP '2024-02-01 00:00:00' AS labeled_at FROM fx_qrels WHERE (item_id + query_id) % 5 = 0",
    "ups": "SELECT query_id, item_id, label, labeled_at FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY labeled_at DESC, label DESC) AS r FROM (SELECT * FROM fx_store UNION ALL SELECT * FROM fx_news)) WHERE r = 1",
    "msets": "SELECT DISTINCT query_id, method, item_id FROM runs WHERE rank <= 50",
    "msize": "SELECT query_id, method, count(item_id) AS n FROM fx_queries CROSS JOIN (SELECT DISTINCT method FROM runs) LEFT JOIN msets USING (query_id, method) WHERE length(query) > 0 GROUP BY ALL",
    "dis": "SELECT q.query_id, round(coalesce(d, 0), 6) AS disagreement FROM fx_queries q LEFT JOIN (SELECT query_id, avg(CASE WHEN na + nb = 0 THEN 0 ELSE 1 - coalesce(c, 0) / (na + nb - coalesce(c, 0)) END) AS d FROM (SELECT a.query_id, a.method AS ma, b.method AS mb, a.n AS na, b.n AS nb FROM msize a JOIN msize b ON a.query_id = b.query_id AND a.method < b.method) LEFT JOIN (SELECT a.query_id, a.method AS ma, b.method AS mb, count(*) AS c FROM msets a JOIN msets b ON a.query_id = b.query_id AND a.item_id = b.item_id AND a.method < b.method GROUP BY ALL) USING (query_id, ma, mb) GROUP BY 1) d USING (query_id)",
    "pick": "SELECT * FROM (SELECT * FROM dis ORDER BY disagreement DESC, query_id LIMIT 12) UNION ALL SELECT * FROM (SELECT * FROM dis WHERE query_id NOT IN (SELECT query_id FROM (SELECT * FROM dis ORDER BY disagreement DESC, query_id LIMIT 12)) ORDER BY md5(concat('42:', query_id)), query_id LIMIT 8)",
    "lpairs": "SELECT DISTINCT CAST(query_id AS STRING) AS query_id, CAST(item_id AS STRING) AS item_id FROM runs ANTI JOIN (SELECT CAST(query_id AS BIGINT) AS query_id, CAST(item_id AS BIGINT) AS item_id FROM fx_store) USING (query_id, item_id)",
    "counts": "SELECT total, total - new AS already, new FROM (SELECT count(*) AS total FROM (SELECT DISTINCT query_id, item_id FROM runs)), (SELECT count(*) AS new FROM lpairs)",
    "augm": "SELECT query_id, item_id, coalesce(h.label, e.label) AS label FROM (SELECT query_id, item_id, label FROM fx_qrels WHERE item_id % 3 <> 0) h FULL JOIN (SELECT query_id, item_id, 'I' AS label FROM runs WHERE method = 'bm25' AND rank <= 20) e USING (query_id, item_id)",
    "resp": "SELECT *, CASE WHEN substr(upper(trim(raw)), 1, 1) IN ('E', 'S', 'C', 'I') THEN substr(upper(trim(raw)), 1, 1) ELSE '?' END AS pred FROM fx_responses",
    # Funnel
    "hist": "SELECT user_id, item_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, item_id) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS r FROM fx_interactions) WHERE r = 1",
    "train": "SELECT * FROM hist QUALIFY pos < max(pos) OVER (PARTITION BY user_id)",
    "target": "SELECT * FROM hist QUALIFY pos = max(pos) OVER (PARTITION BY user_id)",
    "popular": _ranked("(SELECT user_id, item_id, score FROM (SELECT DISTINCT user_id FROM hist) u, (SELECT item_id, count(*) AS score FROM train GROUP BY 1) c WHERE NOT EXISTS (FROM train t WHERE t.user_id = u.user_id AND t.item_id = c.item_id))", "user_id", top=10),
    "oslate": "SELECT t.user_id, CASE WHEN rank IS NULL OR (rank = max(rank) OVER w AND max(CASE WHEN p.item_id = t.item_id THEN 1 ELSE 0 END) OVER w = 0) THEN t.item_id ELSE p.item_id END AS item_id, coalesce(rank, 1) AS rank FROM target t LEFT JOIN popular p USING (user_id) WINDOW w AS (PARTITION BY t.user_id)",
    "uvec": "SELECT user_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM (SELECT user_id, list(x ORDER BY i) AS v FROM (SELECT user_id, i, round(avg(CAST(vector[i] AS DOUBLE)), 9) AS x FROM (SELECT DISTINCT user_id, item_id FROM train) JOIN fx_items USING (item_id), range(1, 65) r(i) GROUP BY ALL) GROUP BY 1)",
    "fx_outputs": """SELECT user_id, CASE user_id % 6 WHEN 0 THEN '[' || array_to_string(list_reverse(ids), ',') || ']' WHEN 1 THEN '[' || array_to_string(ids, ',') || ']'
        WHEN 2 THEN '[' || array_to_string(list_append(ids[:len(ids) - 1], ids[1]), ',') || ']' WHEN 3 THEN '[' || array_to_string(ids[:len(ids) - 1], ',') || ']'
        WHEN 4 THEN '[' || array_to_string(list_append(ids[:len(ids) - 1], 999999), ',') || ']' ELSE 'not json' END AS raw, ids AS incoming, user_id * 37 % 900 + 100 AS latency_ms, user_id % 50 + 20 AS tokens
        FROM (SELECT user_id, list(CAST(item_id AS BIGINT) ORDER BY rank) AS ids FROM popular GROUP BY 1)""",
    "outs": "SELECT user_id, incoming, latency_ms, tokens, CASE WHEN raw LIKE '[%' THEN CAST(CAST(raw AS JSON) AS BIGINT[]) END AS ids FROM fx_outputs",
    "variants": "SELECT 'a' AS model, query_id, item_id, score, rank FROM sparse WHERE rank <= 10 UNION ALL SELECT 'b', query_id, item_id, round(score, 6), rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT query_id, item_id, round(sum(tf * qtf), 6) AS score FROM itf JOIN qtf USING (term) GROUP BY ALL)) WHERE rank <= 10",
    "vruns": "SELECT query_id, method, method_ord, item_id, rank FROM runs WHERE method <> 'sparse' UNION ALL SELECT query_id, concat('sparse_', model), CASE model WHEN 'a' THEN 1 ELSE 3 END, item_id, rank FROM variants",
    "near": "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, item_id, round(list_sum(list_transform(list_zip(u.v, i.vector), lambda x: x[1] * CAST(x[2] AS DOUBLE))), 6) AS score FROM uvec u, fx_items i WHERE NOT EXISTS (FROM train t WHERE t.user_id = u.user_id AND t.item_id = i.item_id)) QUALIFY rank <= 10",
    "nslates": "SELECT * FROM (SELECT 'popularity' AS retriever, user_id, item_id, rank FROM popular UNION ALL SELECT 'history', user_id, item_id, rank FROM near UNION ALL SELECT 'user_vector', query_id, item_id, rank FROM dense WHERE rank <= 10) SEMI JOIN target USING (user_id)",
    "stack": """SELECT retriever, 'natural' AS mode, user_id, item_id, rank FROM nslates UNION ALL
        SELECT v.retriever, 'oracle', v.user_id, CASE WHEN rank IS NULL OR (rank = max(rank) OVER w AND max(CASE WHEN n.item_id = v.item_id THEN 1 ELSE 0 END) OVER w = 0) THEN v.item_id ELSE n.item_id END, coalesce(rank, 1)
        FROM (SELECT r.retriever, t.user_id, t.item_id FROM target t, (VALUES ('popularity'), ('history'), ('user_vector')) r(retriever)) v LEFT JOIN nslates n ON n.retriever = v.retriever AND n.user_id = v.user_id
        WINDOW w AS (PARTITION BY v.retriever, v.user_id)""",
    "made": """SELECT retriever, mode, user_id, CASE user_id % 6 WHEN 0 THEN list_reverse(ids) WHEN 1 THEN ids WHEN 2 THEN list_append(ids[1:len(ids) - 1], ids[1]) WHEN 3 THEN ids[1:len(ids) - 1] WHEN 4 THEN list_append(ids[1:len(ids) - 1], 999999) END AS ids
        FROM (SELECT retriever, mode, user_id, list(CAST(item_id AS BIGINT) ORDER BY rank) AS ids FROM stack GROUP BY ALL)""",
    "orders": """SELECT retriever, mode, 'incoming' AS ordering, user_id, item_id, rank FROM stack UNION ALL
        SELECT s.retriever, s.mode, 'permuted', s.user_id, s.item_id, row_number() OVER (PARTITION BY s.retriever, s.mode, s.user_id ORDER BY coalesce(nullif(list_position(m.ids, s.item_id), 0), 999999), s.rank)
        FROM stack s JOIN made m ON s.retriever = m.retriever AND s.mode = m.mode AND s.user_id = m.user_id""",
    "perm": "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(spot, 999999), was) AS rank FROM (SELECT p.user_id, p.item_id, p.rank AS was, nullif(list_position(o.ids, p.item_id), 0) AS spot FROM popular p JOIN outs o USING (user_id))",
}

#: The pool evaluation once more, over the augmented labels.
_AUGMENTED = ("each", "jrun", "have", "rec", "ideal", "cur")
CTE |= {f"{n}_a": re.sub(r"\b(" + "|".join(_AUGMENTED) + r")\b(?!\s*\()", r"\1_a", CTE[n].replace("fx_qrels", "augm")) for n in _AUGMENTED}


def with_ctes(final: str) -> str:
    """`final` with every common table expression that it needs, in order."""
    needed: list[str] = []

    def add(sql: str) -> None:
        for name in re.findall(r"\b[a-z_0-9]+\b", re.sub(r"'[^']*'", "", sql)):
            if name in CTE and name not in needed and re.search(rf"(FROM|JOIN|,|\()\s*{name}\b(?!\s*\.)", sql):
                add(CTE[name])
                if name not in needed:
                    needed.append(name)

    add(final)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in needed) + "\n" + final if needed else final


def slate_metrics(slate: str) -> str:
    return f"SELECT count(*) AS n_users, round(avg(CASE WHEN r IS NULL THEN 0.0e0 ELSE 1.0e0 END), 6) AS recall, round(avg(coalesce(1 / log2(r + 1), 0.0e0)), 6) AS ndcg, round(avg(coalesce(1.0e0 / r, 0.0e0)), 6) AS mrr FROM (SELECT t.user_id, min(rank) AS r FROM target t LEFT JOIN {slate} s USING (user_id, item_id) GROUP BY 1)"


def _kcore(k: int, rounds: int) -> str:
    steps = ["k0 AS (SELECT * FROM fx_purchases)"]
    for i in range(rounds):
        steps.append(f"k{i + 1} AS (SELECT * FROM k{i} WHERE user_id IN (SELECT user_id FROM k{i} GROUP BY 1 HAVING count(*) >= {k}) AND item_id IN (SELECT item_id FROM k{i} GROUP BY 1 HAVING count(*) >= {k}))")
    return f"WITH fx_purchases AS ({CTE['fx_purchases']}), {', '.join(steps)} SELECT * FROM k{rounds}"


#: The stand-in encoder's words and the number of each.
_WORDS = "(SELECT item_id, unnest(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+')) AS w FROM fx_catalog)"
_NUMBER = "CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 30522"
_RAW_COUNTS = "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT query_id, item_id, round(sum(tf * qtf), 6) AS score FROM itf JOIN qtf USING (term) GROUP BY ALL))"
#: All three methods' lists, as deep as they go.
_DEEP = "(SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, item_id) AS was FROM (SELECT query_id, 'bm25' AS method, item_id, score FROM bscore UNION ALL SELECT query_id, 'sparse', item_id, score FROM sscore UNION ALL SELECT query_id, 'dense', item_id, score FROM dscore))"
_TEXTS = "product_title product_bullet_point product_description product_brand product_color".split()
_TEXT = "trim(regexp_replace(concat(coalesce(product_title, ''), '. ', coalesce(product_bullet_point, ''), '. Brand: ', coalesce(product_brand, '')), '\\s+', ' ', 'g'))"
_COALESCED = ", ".join(f"coalesce({c}, '') AS {c}" for c in _TEXTS)
_PROMPT = "concat('Query: ', query, chr(10), 'Product: ', text, chr(10), 'Answer with one letter: E (exact), S (substitute), C (complement) or I (irrelevant).')"

_SLATES = "SELECT 'natural' AS slate, * FROM (" + slate_metrics("popular") + ") UNION ALL SELECT 'oracle', * FROM (" + slate_metrics("oslate") + ")"

FINAL = {
    "judgments_scan": "SELECT query_id, query, item_id, label FROM fx_qrels JOIN fx_queries USING (query_id) WHERE fx_qrels.split = 'test' AND item_id % 10 < 8",
    "catalog_scan": f"SELECT product_id, {_COALESCED} FROM fx_products WHERE product_locale = 'us'",
    "catalog_cap": f"SELECT product_id FROM (SELECT product_id FROM fx_products SEMI JOIN (SELECT DISTINCT CAST(item_id AS STRING) AS product_id FROM fx_qrels WHERE split = 'test') USING (product_id)) UNION ALL SELECT product_id FROM (SELECT product_id, row_number() OVER (ORDER BY md5(concat('42:', product_id)), product_id) AS r FROM fx_products ANTI JOIN (SELECT DISTINCT CAST(item_id AS STRING) AS product_id FROM fx_qrels WHERE split = 'test') USING (product_id)) WHERE r <= 1200 - (SELECT count(*) FROM fx_products SEMI JOIN (SELECT DISTINCT CAST(item_id AS STRING) AS product_id FROM fx_qrels WHERE split = 'test') USING (product_id))",
    "catalog_head": "SELECT product_id, product_title FROM fx_products ORDER BY product_id LIMIT 100",
    "item_text": f"SELECT product_id, {_TEXT} AS text FROM fx_products",
    "item_list": f"SELECT product_id, {_TEXT} AS text FROM fx_products ORDER BY product_id",
    "item_ordinal": "SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS ordinal FROM fx_products",
    "query_sample": "SELECT query_id, query FROM fx_queries ORDER BY md5(concat('42:', query_id)), query_id LIMIT 20",
    "query_candidates": f"SELECT query_id, query, item_id, label, CAST({_gain('label', GRADED)} AS INT) AS gain FROM fx_qrels JOIN fx_queries USING (query_id)",
    "eval_queries": "SELECT query_id, coalesce(string_agg(CASE WHEN label = 'E' THEN CAST(item_id AS VARCHAR) END, ',' ORDER BY item_id), '') AS exact_ids, coalesce(string_agg(CASE WHEN label IN ('E', 'S') THEN CAST(item_id AS VARCHAR) END, ',' ORDER BY item_id), '') AS exact_sub_ids, count(DISTINCT item_id) AS n_labeled FROM fx_qrels GROUP BY 1",
    "curated_pool": "SELECT item_id FROM pool",
    "label_distribution": f"SELECT l.label, coalesce(n, 0) AS n, round(100.0e0 * coalesce(n, 0) / (SELECT count(*) FROM fx_qrels), 6) AS pct FROM {LABELS} l(label, o) LEFT JOIN (SELECT label, count(*) AS n FROM fx_qrels GROUP BY 1) USING (label)",
    "query_length_stats": "SELECT round(avg(w), 6) AS mean, round(quantile_cont(w, 0.5), 6) AS median, round(quantile_cont(w, 0.05), 6) AS p5, round(quantile_cont(w, 0.95), 6) AS p95 FROM (SELECT CAST(len(regexp_split_to_array(trim(query), '\\s+')) AS DOUBLE) AS w FROM fx_queries)",
    "items_per_query_stats": "SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95 FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM fx_qrels GROUP BY query_id)",
    "metadata_coverage": " UNION ALL ".join(f"SELECT '{c}' AS field, round(100 * avg(CASE WHEN length({c}) > 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS pct FROM fx_products" for c in _TEXTS),
    "dataset_counts": "SELECT count(*) AS n_rows, count(DISTINCT query_id) AS n_queries, count(DISTINCT item_id) AS n_items FROM fx_qrels",
    "index_save_load": "SELECT 'lexical' AS kind, term AS key, count(*) AS n, round(sum(CAST(tf AS DOUBLE)), 6) AS total FROM post GROUP BY term UNION ALL SELECT 'sparse', term, count(*), round(sum(weight), 6) FROM sitem GROUP BY term UNION ALL SELECT 'dense', CAST(item_id AS VARCHAR), count(*), round(sum(CAST(vector[1] AS DOUBLE)), 6) FROM fx_items GROUP BY item_id",
    "results_json": "SELECT method, label, count(*) AS n, round(avg(score), 6) AS mean FROM scored GROUP BY ALL",
    "comparison_csv": "SELECT method, auc, " + ", ".join(f"max(CASE WHEN k = {k} THEN {c} END) AS {n}_{k}" for k in (10, 20, 50) for c, n in (("ndcg", "ndcg"), ("share_e", "e"))) + " FROM cs GROUP BY ALL",
    "tokenize": "SELECT item_id, term, tf AS n FROM itf",
    "bm25_index": "SELECT item_id, term, tf, round(impact, 6) AS impact FROM post",
    **{f"bm25_impact_{n}": f"SELECT item_id, term, round({_impact(n)}, 6) AS impact FROM stat" for n in ("lucene", "robertson", "atire", "bm25l", "bm25plus")},
    "bm25_topk": "SELECT query_id, item_id, score, rank FROM bm25",
    "bm25_score_candidates": "SELECT query_id, item_id, score FROM bcand",
    "vocab_size": "SELECT count(DISTINCT term) AS n_terms FROM post",
    "splade_pool": "SELECT * FROM (SELECT item_id, term_id, round(max(ln(1 + greatest(logit, 0.0e0)) * mask), 6) AS weight FROM fx_logits GROUP BY ALL) WHERE weight > 0",
    "sparse_normalise": "SELECT item_id, term_id, weight FROM (SELECT item_id, term_id, arg_max(logit, position * 1000000 + event_order) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY item_id, position ORDER BY term_id, logit, mask) AS event_order FROM fx_logits) GROUP BY ALL) WHERE weight <> 0 AND term_id < 40",
    "sparse_topk": "SELECT query_id, item_id, score, rank FROM sparse",
    "sparse_score_candidates": "SELECT query_id, item_id, score FROM scand",
    "term_expansion": "SELECT query_id, term, weight, rank, CASE WHEN o THEN 'ORIGINAL' ELSE 'EXPANDED' END AS kind, n_terms FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS rank, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (SELECT query_id, term, round(ln(1 + qtf), 6) AS weight, true AS o FROM qtf UNION ALL SELECT query_id, term || '_x', round(0.5e0 * ln(1 + qtf), 6), false FROM qtf)) WHERE rank <= 20",
    "sparse_stats": "SELECT n_rows, nnz, round(nnz / (n_rows * 30522.0e0), 12) AS density FROM (SELECT count(*) AS n_rows FROM fx_catalog), (SELECT count(*) AS nnz FROM sitem)",
    "sparse_index": "SELECT item_id, term, round(ln(1 + tf), 6) AS weight FROM itf",
    "sparse_variants": "SELECT * FROM variants",
    "encode_missing": "SELECT item_id FROM fx_catalog WHERE item_id NOT IN (SELECT item_id FROM fx_items)",
    "encode_batches": f"SELECT item_id, CAST({_NUMBER} AS INT) AS term_id, CAST(count(*) AS DOUBLE) AS weight FROM {_WORDS} GROUP BY ALL",
    "encode_dense": f"SELECT item_id, CAST({_NUMBER} % 16 AS INT) AS dim, CAST(count(*) AS DOUBLE) AS value FROM {_WORDS} GROUP BY ALL",
    "splade_pool_matrices": "SELECT item_id, CAST(term_id AS INT) AS term_id, weight FROM (SELECT item_id, term_id, round(max(ln(1 + greatest(logit, 0.0e0)) * mask), 6) AS weight FROM fx_logits GROUP BY ALL) WHERE weight > 0",
    "encode_resume": f"SELECT item_id, count(*) AS n_terms, CAST(sum(n) AS DOUBLE) AS weight, (SELECT count(DISTINCT item_id) FROM {_WORDS} WHERE item_id % 2 = 0) AS resumed_after FROM (SELECT item_id, {_NUMBER} AS t, count(*) AS n FROM {_WORDS} GROUP BY ALL) GROUP BY 1",
    "sparse_first_available": f"SELECT 'b' AS model, query_id, item_id, score, rank FROM {_RAW_COUNTS} WHERE rank <= 10",
    "l2_normalise": "SELECT item_id, round(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE))) / sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * x))), 6) AS total FROM fx_items",
    "dense_topk": "SELECT query_id, item_id, score, rank FROM dense",
    "dense_score_candidates": "SELECT query_id, item_id, score FROM dcand",
    "rrf": "SELECT query_id, item_id, score, rank FROM rrf_run WHERE rank <= 100",
    "minmax_normalise": "SELECT query_id, method, item_id, norm FROM norms",
    "weighted_fusion": "SELECT query_id, item_id, round(sum(norm * CASE method WHEN 'bm25' THEN 0.3e0 WHEN 'sparse' THEN 0.4e0 ELSE 0.3e0 END), 9) AS score FROM norms GROUP BY ALL",
    "pool_restrict": f"SELECT * FROM (SELECT query_id, method, item_id, row_number() OVER (PARTITION BY query_id, method ORDER BY was) AS rank FROM {_DEEP} WHERE was <= 250 AND item_id IN (SELECT item_id FROM pool)) WHERE rank <= 50",
    "bm25_rerank": f"SELECT r.query_id, r.method, r.item_id, row_number() OVER (PARTITION BY r.query_id, r.method ORDER BY coalesce(b.score, 0) DESC, r.was) AS rank FROM {_DEEP} r LEFT JOIN {_DEEP} b ON b.method = 'bm25' AND b.was <= 1000 AND b.query_id = r.query_id AND b.item_id = r.item_id WHERE r.method <> 'bm25' AND r.was <= 100",
    "rrf_candidates": "SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, r, item_id) AS rank FROM (SELECT query_id, item_id, round(sum(1 / (60.0e0 + rank)), 12) AS score, min(method_ord) AS o, arg_min(rank, method_ord) AS r FROM cruns GROUP BY ALL)",
    "weighted_candidates": "SELECT query_id, item_id, round(sum(norm * CASE method WHEN 'bm25' THEN 0.3e0 WHEN 'sparse' THEN 0.4e0 ELSE 0.3e0 END), 9) AS score FROM cnorms GROUP BY ALL",
    "method_runs": "SELECT query_id, method, method_ord, item_id, score, rank FROM runs",
    "rrf_retrieval": "SELECT query_id, item_id, score, rank FROM rrf_run WHERE rank <= 50",
    "side_by_side": "SELECT r.query_id, r.method, r.rank, r.item_id, coalesce(substr(c.text, 1, 100), '???') AS text FROM (SELECT query_id, method, item_id, rank FROM runs WHERE rank <= 10 UNION ALL SELECT query_id, 'rrf', item_id, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, r, item_id) AS rank FROM (SELECT query_id, item_id, round(sum(1 / (60.0e0 + rank)), 12) AS score, min(method_ord) AS o, arg_min(rank, method_ord) AS r FROM runs WHERE rank <= 10 GROUP BY ALL)) WHERE rank <= 10) r LEFT JOIN (SELECT * FROM fx_catalog WHERE item_id % 7 <> 0) c USING (item_id)",
    "merge_method_results": "SELECT method, ndcg_10, coalesce(auc, 0.0e0) AS auc, recall_10 FROM (SELECT method, ndcg AS ndcg_10, auc FROM cs WHERE k = 10 AND method <> 'dense') FULL JOIN (SELECT method, " + _mean("recall_exact") + " AS recall_10 FROM rec WHERE k = 10 GROUP BY 1) USING (method)",
    "recall_at_k": "SELECT method, query_id, k, recall_exact, recall_exact_sub FROM rec",
    "label_dist_at_k": "SELECT * FROM shr",
    "evaluate_retrieval": "SELECT method, k, count(*) AS num_queries, " + ", ".join(f"{_mean(c)} AS {c}" for c in ["recall_exact", "recall_exact_sub", *[f"share_{x}" for x in ("e", "s", "c", "i", "unlabeled")]]) + " FROM rec JOIN shr USING (method, query_id, k) GROUP BY ALL",
    "evaluate_curated_pool": "SELECT * FROM cur",
    "ndcg_graded": "SELECT method, query_id, k, ndcg FROM cm",
    "mrr_at_k": "SELECT method, query_id, k, mrr FROM cm",
    "precision_at_k": "SELECT method, query_id, k, precision FROM cm",
    "separability_auc": "SELECT * FROM auc",
    "evaluate_candidate_scoring": "SELECT * FROM cs",
    "per_label_score_stats": "SELECT method, label, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max FROM scored GROUP BY ALL",
    "method_comparison": "SELECT method, ndcg AS ndcg_10, mrr AS mrr_10, precision AS precision_10, round(100 * share_e, 4) AS e_pct_10, round(100 * share_i, 4) AS i_pct_10, auc FROM cs WHERE k = 10",
    "curated_table": "SELECT method, " + ", ".join(f"max(CASE WHEN k = {k} THEN ndcg END) AS ndcg_{k}" for k in (10, 20, 50)) + ", max(CASE WHEN k = 10 THEN mrr END) AS mrr_10, max(CASE WHEN k = 10 THEN num_queries END) AS num_queries FROM cur GROUP BY 1",
    "slate_metrics_stacked": "SELECT retriever, mode, ordering, n_users, round(sum(CASE WHEN o.item_id = t.item_id THEN 1.0e0 ELSE 0 END) / n_users, 6) AS recall, round(sum(CASE WHEN o.item_id = t.item_id THEN 1 / log2(rank + 1) ELSE 0 END) / n_users, 6) AS ndcg, round(sum(CASE WHEN o.item_id = t.item_id THEN 1.0e0 / rank ELSE 0 END) / n_users, 6) AS mrr FROM orders o JOIN target t USING (user_id), (SELECT count(*) AS n_users FROM target) GROUP BY retriever, mode, ordering, n_users",
    "score_points": "SELECT method, label, query_id, item_id, score FROM scored WHERE label IN ('E', 'S', 'C', 'I') QUALIFY row_number() OVER (PARTITION BY method, label ORDER BY md5(concat('42:', query_id, ':', item_id))) <= 1000",
    "interactions_jsonl": "SELECT user_id, item_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id FROM fx_interactions",
    "query_candidates_mean": "SELECT count(*) AS n_queries, round(sum(n) / count(*), 6) AS mean_candidates FROM (SELECT query_id, count(*) AS n FROM fx_qrels JOIN fx_queries USING (query_id) GROUP BY 1)",
    "eval_query_labels": "SELECT query_id, item_id, CASE WHEN item_id % 4 = 0 THEN 'C' ELSE label END AS label FROM fx_qrels",
    "eval_queries_mean": "SELECT count(*) AS n_queries, round(sum(n) / count(*), 6) AS mean_exact FROM (SELECT query_id, count(DISTINCT CASE WHEN label = 'E' THEN item_id END) AS n FROM fx_qrels GROUP BY 1)",
    "curated_pool_means": "SELECT count(*) AS n_queries, round(sum(n) / count(*), 6) AS mean_labeled FROM (SELECT query_id, count(DISTINCT item_id) AS n FROM fx_qrels JOIN (SELECT query_id FROM fx_queries WHERE split = 'test' ORDER BY md5(concat('42:', query_id)), query_id LIMIT 20) USING (query_id) GROUP BY 1)",
    "selected_query_data": "SELECT query_id, query, item_id, label FROM fx_qrels JOIN fx_queries USING (query_id) SEMI JOIN pick USING (query_id)",
    "labeling_dry_run_estimate": "SELECT new, round(new * ((400 * 0.10e0 + 2 * 0.40e0) / 1e6), 9) AS usd, round(new / 1.8e0 / 100.0e0 / 3600, 9) AS hours FROM (SELECT greatest(0, 60 * (SELECT count(DISTINCT query_id) FROM fx_queries) - (SELECT count(*) FROM fx_store)) AS new)",
    "label_store_buckets": "SELECT * FROM ups",
    "score_quantiles": "SELECT method, label, " + ", ".join(f"round(quantile_cont(score, {p}), 9) AS q{int(p * 100)}" for p in (0.0, 0.25, 0.5, 0.75, 1.0)) + " FROM scored GROUP BY ALL",
    "label_dist_bars": " UNION ALL ".join(f"SELECT method, k, '{x}' AS label, round(100 * share_{x.lower()}, 4) AS pct FROM cs" for x in "ESCI"),
    "method_report": " UNION ALL ".join(f"SELECT method, '{x}@' || k AS metric, {x} AS value FROM cs" for x in ("ndcg", "mrr", "precision")) + " UNION ALL SELECT method, 'auc', auc FROM auc",
    "label_store_upsert": "SELECT * FROM ups",
    "label_store_lookup": "SELECT CAST(p.query_id AS STRING) AS query_id, CAST(p.item_id AS STRING) AS item_id, s.label FROM fx_qrels p LEFT JOIN fx_store s ON CAST(p.query_id AS STRING) = s.query_id AND CAST(p.item_id AS STRING) = s.item_id",
    "label_store_stats": "SELECT label, count(*) AS n FROM fx_store GROUP BY 1",
    "method_sets": "SELECT * FROM msets",
    "query_disagreement": "SELECT * FROM dis",
    "disagreement_incremental": "SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 0.25e0 ELSE disagreement END AS disagreement FROM dis",
    "select_by_disagreement": "SELECT * FROM pick",
    "disagreement_stats": "SELECT * FROM (SELECT round(avg(disagreement), 6) AS mean_all FROM dis), (SELECT round(avg(disagreement), 6) AS mean_chosen, round(quantile_cont(disagreement, 0.5), 6) AS p50_chosen, round(quantile_cont(disagreement, 0.9), 6) AS p90_chosen FROM pick)",
    "retrieval_candidates": "SELECT query_id, method, item_id, rank FROM runs",
    "labeling_pairs": "SELECT * FROM lpairs",
    "labeling_pair_counts": "SELECT * FROM counts",
    "label_prompts": f"SELECT p.query_id, p.item_id, md5({_PROMPT}) AS digest FROM lpairs p JOIN fx_queries q ON p.query_id = CAST(q.query_id AS STRING) JOIN fx_catalog c ON p.item_id = CAST(c.item_id AS STRING) WHERE length(query) > 0 AND length(text) > 0",
    "label_batches": "SELECT p.query_id, p.item_id, CASE WHEN length(text) % 2 = 0 THEN 'E' ELSE 'S' END AS label FROM lpairs p JOIN fx_catalog c ON p.item_id = CAST(c.item_id AS STRING)",
    "labeling_run": "SELECT p.query_id, p.item_id, CASE WHEN length(text) % 2 = 0 THEN 'E' ELSE 'S' END AS label, CASE WHEN length(text) % 5 = 0 THEN '2024-01-02' ELSE '2024-01-01' END AS day FROM lpairs p JOIN fx_catalog c ON p.item_id = CAST(c.item_id AS STRING) JOIN fx_queries q ON p.query_id = CAST(q.query_id AS STRING) WHERE length(text) > 0 AND length(query) > 0",
    "parse_label": "SELECT query_id, item_id, pred AS label FROM resp",
    "labeling_cost": "SELECT count(*) AS calls, count(*) FILTER (pred = '?') AS errors, round((sum(tokens_in) * 0.10e0 + sum(tokens_out) * 0.40e0) / 1e6, 9) AS usd, round(count(*) / (sum(latency_ms) / 1000.0e0), 6) AS pairs_per_sec FROM resp",
    "labeling_dry_run": "SELECT new, round(new * ((400 * 0.10e0 + 2 * 0.40e0) / 1e6), 9) AS usd, round(new / 1.8e0 / 100.0e0 / 3600, 9) AS hours FROM counts",
    "label_agreement": "SELECT gold, n, correct, round(correct / n, 6) AS agreement FROM (SELECT coalesce(gold, 'all') AS gold, count(*) AS n, count(*) FILTER (pred = gold) AS correct FROM resp WHERE pred <> '?' GROUP BY ROLLUP (gold))",
    "label_confusions": "SELECT gold, pred, count(*) AS n FROM resp WHERE pred <> '?' AND pred <> gold GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 10",
    "label_latency": "SELECT round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.5), 6) AS p50_ms, round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.95), 6) AS p95_ms, round(sum(latency_ms) / 1000.0e0, 6) AS total_s, round(count(*) / (sum(latency_ms) / 1000.0e0), 6) AS pairs_per_sec FROM resp",
    "augmented_qrels": "SELECT query_id, item_id, label FROM augm",
    "evaluate_augmented": "SELECT * FROM cur_a",
    "kcore_filter": _kcore(20, 8),
    "interaction_stats": "SELECT *, round(n_interactions / n_users, 6) AS avg_length FROM (SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_interactions FROM fx_interactions)",
    "user_histories": "SELECT user_id, item_id, ts, pos FROM hist",
    "user_histories_capped": "SELECT user_id, item_id, ts, pos FROM hist WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM fx_interactions) ORDER BY md5(concat('42:', user_id)), user_id LIMIT 50)",
    "leave_last_out": "SELECT user_id, item_id, pos, 'train' AS part FROM train UNION ALL SELECT user_id, item_id, pos, 'target' FROM target",
    "leave_last_out_capped": "SELECT user_id, item_id, pos FROM target ORDER BY md5(concat('42:', user_id)), user_id LIMIT 30",
    "listwise_prompts": """SELECT user_id, '{"history":[' || h || '],"candidates":[' || c || ']}' AS prompt
        FROM (SELECT user_id, string_agg('{"item_id":' || item_id || coalesce(',"text":' || CAST(to_json(text) AS VARCHAR), '') || '}', ',' ORDER BY rank) AS c FROM popular LEFT JOIN fx_catalog USING (item_id) GROUP BY 1)
        JOIN (SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY pos) AS h FROM train GROUP BY 1) USING (user_id)""",
    "metrics_flatten": "SELECT 'popularity' AS retriever, slate, 'incoming_order' AS ordering, metric, value FROM (UNPIVOT (SELECT slate, recall, ndcg, mrr FROM (" + _SLATES + ")) ON recall, ndcg, mrr INTO NAME metric VALUE value)",
    "popularity_topk": "SELECT user_id, item_id, score, rank FROM popular",
    "history_embedding_topk": "SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, item_id, round(list_sum(list_transform(list_zip(u.v, i.vector), lambda x: x[1] * CAST(x[2] AS DOUBLE))), 6) AS score FROM uvec u, fx_items i WHERE NOT EXISTS (FROM train t WHERE t.user_id = u.user_id AND t.item_id = i.item_id)) QUALIFY rank <= 10",
    "user_item_dot_topk": "SELECT user_id, item_id, score, rank FROM (SELECT query_id AS user_id, item_id, score, rank FROM dense) WHERE rank <= 10",
    "natural_slate": "SELECT user_id, item_id, rank FROM popular WHERE rank <= 10",
    "oracle_slate": "SELECT * FROM oslate",
    "slate_metrics": _SLATES,
    "output_validity": "SELECT count(*) AS n, round(avg(latency_ms), 6) AS mean_latency_ms, round(avg(tokens), 6) AS mean_tokens, round(avg(CASE WHEN ids IS NOT NULL THEN 1.0e0 ELSE 0 END), 6) AS valid_json, round(avg(CASE WHEN ids IS NULL THEN 1.0e0 ELSE 0 END), 6) AS parse_failure, round(avg(CASE WHEN list_sort(ids) = list_sort(incoming) THEN 1.0e0 ELSE 0 END), 6) AS valid_permutation, round(avg(CASE WHEN len(list_distinct(ids)) < len(ids) THEN 1.0e0 ELSE 0 END), 6) AS duplicate, round(avg(CASE WHEN len(list_filter(incoming, lambda x: NOT list_contains(ids, x))) > 0 THEN 1.0e0 ELSE 0 END), 6) AS missing, round(avg(CASE WHEN len(list_filter(ids, lambda x: NOT list_contains(incoming, x))) > 0 THEN 1.0e0 ELSE 0 END), 6) AS out_of_candidate FROM outs",
    "apply_permutation": "SELECT * FROM perm",
    "identity_order_rate": "SELECT round(avg(CASE WHEN ids = incoming THEN 1.0e0 ELSE 0.0e0 END), 6) AS identity_rate FROM outs",
    "leakage_report": "SELECT (SELECT count(*) FROM train SEMI JOIN target USING (user_id, item_id)) AS target_in_history, (SELECT count(*) FROM train SEMI JOIN target USING (user_id, pos)) AS outside_prefix, (SELECT round(avg(later / total), 6) FROM (SELECT t.user_id, count(r.ts) AS later FROM target t LEFT JOIN train r ON r.ts > t.ts GROUP BY 1), (SELECT CAST(count(*) AS DOUBLE) AS total FROM train)) AS later_share",
}

FINAL["side_by_side_variants"] = re.sub(r"\bruns\b", "vruns", FINAL["side_by_side"])
FINAL["listwise_prompts_scored"] = FINAL["listwise_prompts"].replace("|| '}', ','", "|| ',\"score\":' || score || '}', ','")
ORACLES = {name: with_ctes(sql) if not sql.startswith("WITH") else sql for name, sql in FINAL.items()}
