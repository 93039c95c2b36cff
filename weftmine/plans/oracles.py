"""DuckDB SQL for the library's queries."""

from __future__ import annotations

import re

# Tables that queries share, by name.
SHARED = {
    "x": "SELECT DISTINCT l_orderkey AS pid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey",
    "s": "SELECT DISTINCT l_orderkey AS pid, s_nationkey AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "dose": "SELECT l_orderkey AS pid, p_brand AS item, sum(l_quantity) AS dose FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "cat": "SELECT DISTINCT p_brand AS item, p_type || ' ' || p_size AS category FROM part",
    "n": "SELECT count(DISTINCT pid) AS n FROM x",
    "h": "SELECT item, k, c / sum(c) OVER (PARTITION BY k) AS v FROM (SELECT p_brand AS item, p_type AS k, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)",
    "hs": "SELECT item, k, c / sum(c) OVER (PARTITION BY k) AS v FROM (SELECT s_nationkey AS item, p_type AS k, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)",
    "pairs": "SELECT a.pid, a.item AS i, b.item AS j FROM x a JOIN x b ON a.pid = b.pid AND a.item < b.item",
    "counts": "SELECT i, j, count(*) AS support FROM pairs GROUP BY ALL",
    "freq": "SELECT i, j, support FROM counts, n WHERE support >= floor(0.022::DOUBLE * n)",
    "freq3": "SELECT a.i, a.j, b.j AS k, count(*) AS support FROM pairs a JOIN pairs b ON a.pid = b.pid AND a.j = b.i GROUP BY ALL HAVING count(*) >= (SELECT floor(0.003::DOUBLE * n) FROM n)",
    "df": "SELECT item, count(*) AS df FROM x GROUP BY item",
    "pmi": "SELECT i, j, support, ln((support / n::DOUBLE + 1e-10) / greatest(a.df / n::DOUBLE * (b.df / n::DOUBLE), 1e-10)) AS pmi FROM counts JOIN df a ON i = a.item JOIN df b ON j = b.item, n",
    "idf": "SELECT item, df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0 AS idf FROM df, n",
    "w": "SELECT pid, item, idf / sqrt(sum(idf * idf) OVER (PARTITION BY pid)) AS val FROM x JOIN idf USING (item)",
    "ents": "SELECT pid, list(item ORDER BY item) AS members, count(*) AS size FROM x GROUP BY pid",
    "alike": """SELECT i, j, sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rn FROM (
        SELECT a.item AS i, b.item AS j, round(sum(a.u * b.u), 9) AS sim FROM unit a JOIN unit b ON a.attr = b.attr AND a.item <> b.item GROUP BY ALL)) WHERE rn <= 4""",
    "every": "SELECT a.item AS i, b.item AS j, round(sum(a.u * b.u), 9) AS sim FROM unit a JOIN unit b ON a.attr = b.attr AND a.item <> b.item GROUP BY ALL",
    "kinds": "SELECT category, item, count(*) OVER (PARTITION BY category) AS size FROM cat QUALIFY count(*) OVER (PARTITION BY category) >= 2",
    "unit": "SELECT item, attr, v / sqrt(sum(v * v) OVER (PARTITION BY item)) AS u FROM (SELECT p_brand AS item, p_type AS attr, avg(p_size) AS v FROM part GROUP BY ALL)",
    "loci": "SELECT DISTINCT p_brand AS item, p_size AS attr FROM part",
    "jac": """SELECT i, j, sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rn FROM (
        SELECT i, j, m / (a.n + b.n - m) AS sim FROM (SELECT a.item AS i, b.item AS j, count(*) AS m FROM loci a JOIN loci b ON a.attr = b.attr AND a.item <> b.item GROUP BY ALL)
        JOIN (SELECT item, count(*) AS n FROM loci GROUP BY item) a ON i = a.item JOIN (SELECT item, count(*) AS n FROM loci GROUP BY item) b ON j = b.item)) WHERE rn <= 4""",
    "g": "SELECT i, j, sum(sim) / 2 AS w FROM (SELECT i, j, sim FROM jac UNION ALL SELECT j, i, sim FROM jac) GROUP BY ALL",
    "catadj": "SELECT DISTINCT a.item AS i, b.item AS j, 1.0::DOUBLE AS w FROM cat a JOIN cat b ON a.category = b.category AND a.item <> b.item",
    "coadj": "SELECT i, j, count(*)::DOUBLE AS w FROM (SELECT i, j FROM freq UNION ALL SELECT j, i FROM freq) GROUP BY ALL",
    "nodes": "SELECT DISTINCT p_brand AS item FROM part",
    "bad": "SELECT a.item AS i, b.item AS j FROM nodes a JOIN nodes b ON a.item < b.item WHERE starts_with(md5(a.item || ':' || b.item), '0')",
    "bad2": "SELECT i, j, count(*)::DOUBLE AS w FROM (SELECT i, j FROM bad UNION ALL SELECT j, i FROM bad) GROUP BY ALL",
    "z": "SELECT pid, k, sum(v) AS v FROM s JOIN hs USING (item) GROUP BY ALL",
    "scores": "SELECT pid, h.item, round(sum(z.v * h.v), 9) AS score FROM z JOIN h USING (k) GROUP BY ALL",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, item DESC) AS rank FROM scores",
    "judged": "SELECT r.*, w.val, t.n_true FROM ranked r LEFT JOIN w ON r.pid = w.pid AND r.item = w.item JOIN (SELECT pid, count(*) AS n_true FROM w GROUP BY pid) t ON r.pid = t.pid",
    "ap": "SELECT pid, sum(CASE WHEN val IS NULL THEN 0 ELSE seen / rank END) / any_value(n_true) AS ap FROM (SELECT *, count(val) OVER (PARTITION BY pid ORDER BY rank) AS seen FROM judged) GROUP BY pid",
    "gx": "SELECT pid, k, sum(v) AS v FROM x JOIN h USING (item) GROUP BY ALL",
    "top8": "SELECT k, item FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(v, 9) DESC, item DESC) AS rn FROM h) WHERE rn <= 8",
    "top10": "SELECT k, item FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(v, 9) DESC, item DESC) AS rn FROM h) WHERE rn <= 10",
    "motif": """SELECT members, size, support, round(pmi, 9) AS pmi, round(ln(1.0::DOUBLE + support) + greatest(pmi, 0), 9) AS score, greatest(ln(1.0::DOUBLE + support) * greatest(pmi, 0), 1e-10) AS weight FROM (
        SELECT [f.i, f.j] AS members, 2 AS size, f.support, pmi FROM counts f JOIN pmi p ON f.i = p.i AND f.j = p.j, n WHERE f.support >= floor(0.003::DOUBLE * n)
        UNION ALL SELECT [f.i, f.j, f.k], 3, f.support, (p.pmi + q.pmi + r.pmi) / 3 FROM freq3 f JOIN pmi p ON f.i = p.i AND f.j = p.j JOIN pmi q ON f.i = q.i AND f.k = q.j JOIN pmi r ON f.j = r.i AND f.k = r.j)
        ORDER BY score DESC, members LIMIT 200""",
    "hyper": "SELECT pid AS edge, members, 1 / sqrt(size::DOUBLE) AS weight, size FROM ents WHERE size BETWEEN 2 AND 6",
    "inc": "SELECT edge, unnest(members) AS item, weight, size FROM hyper",
    "centred": "SELECT edge, inc.item, k, weight, size, v - sum(v) OVER (PARTITION BY edge, k) / size AS d FROM inc JOIN h ON inc.item = h.item",
    "res": "SELECT CAST(month(o_orderdate) AS INT) AS K, CAST(year(o_orderdate) AS INT) AS seed, o_orderpriority AS variant, round(avg(o_totalprice), 2) AS metric, count(*) AS size FROM orders WHERE o_totalprice IS NOT NULL GROUP BY ALL",
    "pd": "SELECT a.K, a.seed, a.metric AS x, b.metric AS y, a.metric - b.metric AS delta FROM res a JOIN res b USING (K, seed) WHERE a.variant = (SELECT min(o_orderpriority) FROM orders) AND b.variant = (SELECT max(o_orderpriority) FROM orders)",
    "srank": "SELECT *, rank() OVER (PARTITION BY seed ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY seed, abs(delta)) - 1) / 2 AS rk FROM pd WHERE delta <> 0",
    "effect": "SELECT seed, sum(sign(delta) * rk) / sum(rk) AS effect FROM srank GROUP BY seed",
    "alines": "SELECT r_regionkey AS no, r_name || ',' || string_agg(n_name, ' , ' ORDER BY n_name) || ', world' AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name",
    "lines": "SELECT c_mktsegment AS symptom, unnest(regexp_split_to_array(trim(n_name || ' ' || right(c_name, 2)), '\\s+')) AS token FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "names": "SELECT n_nationkey AS item, n_name AS name FROM nation WHERE n_regionkey <= 1",
    "als": "SELECT a.n_name AS alias, b.c AS canonical FROM nation a JOIN (SELECT n_regionkey AS r, min(n_name) AS c FROM nation WHERE n_regionkey <= 1 GROUP BY ALL) b ON a.n_regionkey - 2 = b.r",
    "found": "SELECT symptom, token, coalesce(a.item, b.item) AS item FROM lines LEFT JOIN names a ON token = a.name LEFT JOIN (SELECT alias, item FROM als JOIN names ON canonical = name) b ON token = alias",
}


def _needed(body: str) -> list[str]:
    found: list[str] = []

    def visit(text: str) -> None:
        for name in SHARED:
            if name not in found and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", text):
                visit(SHARED[name])
                if name not in found:
                    found.append(name)

    visit(body)
    return found


def sql(body: str) -> str:
    """body with the shared tables it reads."""
    names = _needed(body)
    own = re.match(r"WITH (RECURSIVE )?", body)  # a body's tables of its own come after the shared ones
    parts = [f"{n} AS ({SHARED[n]})" for n in names]
    if not own:
        return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
    return own[0] + ",\n".join([*parts, body[own.end() :]])


SHARED |= {
    "hh": "SELECT a.k, b.k AS l, sum(a.v * b.v) AS v FROM h a JOIN h b ON a.item = b.item GROUP BY ALL",
    "g0": "SELECT pid, k, 5 * v AS v FROM gx",
    "xh": "SELECT pid, k, sum(v) AS v FROM x JOIN h USING (item) GROUP BY ALL",
    "kk": "SELECT DISTINCT k FROM h",
    "hrows": "SELECT l AS k, list(v ORDER BY k) AS r FROM (SELECT a.k AS l, b.k, coalesce(hh.v, 0::DOUBLE) AS v FROM kk a CROSS JOIN kk b LEFT JOIN hh ON hh.k = b.k AND hh.l = a.k) GROUP BY l",
    "grows": "SELECT pid, list(v ORDER BY k) AS g FROM (SELECT p.pid, kk.k, coalesce(g0.v, 0::DOUBLE) AS v FROM (SELECT DISTINCT pid FROM g0) p CROSS JOIN kk LEFT JOIN g0 ON g0.pid = p.pid AND g0.k = kk.k) GROUP BY pid",
    "gd": "SELECT pid, k, list_dot_product(g, r) AS v FROM grows CROSS JOIN hrows",
    "g1": "SELECT g0.pid, g0.k, g0.v * xh.v / (gd.v + 1e-10) AS v FROM g0 JOIN xh ON g0.pid = xh.pid AND g0.k = xh.k JOIN gd ON g0.pid = gd.pid AND g0.k = gd.k",
    "g1g1": "SELECT a.k, b.k AS l, sum(a.v * b.v) AS v FROM g1 a JOIN g1 b ON a.pid = b.pid GROUP BY ALL",
    "theta": "SELECT pid, k, v / sum(v) OVER (PARTITION BY pid) AS t FROM (SELECT p.pid, t.k, coalesce(gx.v, 0) + 0.1 AS v FROM (SELECT DISTINCT pid FROM gx) p CROSS JOIN (SELECT DISTINCT k FROM h) t LEFT JOIN gx ON gx.pid = p.pid AND gx.k = t.k)",
    "tp": "SELECT x.pid, x.item, theta.k, t * h.v AS tv, sum(t * h.v) OVER (PARTITION BY x.pid, x.item) AS q FROM x JOIN theta ON x.pid = theta.pid JOIN h ON h.item = x.item AND h.k = theta.k",
}

_BODIES = {
    "mur_step_once": """SELECT h.item, h.k, round(h.v * u.v / (d.v + 1e-10), 6) AS v, round(s.v, 4) AS g_sum FROM h JOIN (SELECT item, k, sum(v) AS v FROM x JOIN g1 ON x.pid = g1.pid GROUP BY ALL) u ON h.item = u.item AND h.k = u.k
        JOIN (SELECT item, l AS k, sum(h.v * g1g1.v) AS v FROM h JOIN g1g1 ON h.k = g1g1.k GROUP BY ALL) d ON h.item = d.item AND h.k = d.k JOIN (SELECT k, sum(v) AS v FROM g1 GROUP BY k) s ON s.k = h.k""",
    "pgd_step_once": "SELECT g0.pid, g0.k, round(greatest(g0.v - 0.05 * (2 * (gd.v - coalesce(xh.v, 0)) + 0.1), 0), 6) AS v FROM g0 JOIN gd ON g0.pid = gd.pid AND g0.k = gd.k LEFT JOIN xh ON g0.pid = xh.pid AND g0.k = xh.k",
    "em_step_once": "SELECT item, k, round(r / sum(r) OVER (PARTITION BY k), 6) AS v FROM (SELECT item, k, sum(tv / q) AS r FROM tp WHERE q > 1e-10 GROUP BY ALL)",
    "em_fit_dot": """WITH th AS (SELECT pid, k, v / sum(v) OVER (PARTITION BY pid) AS t FROM (SELECT p.pid, t.k, coalesce(z.v, 0) + 0.1 AS v FROM (SELECT DISTINCT pid FROM z) p CROSS JOIN (SELECT DISTINCT k FROM hs) t LEFT JOIN z ON z.pid = p.pid AND z.k = t.k)),
        p0 AS (SELECT item, k, v FROM h),
        q1 AS (SELECT x.pid, x.item, k, t * v AS tv, sum(t * v) OVER (PARTITION BY x.pid, x.item) AS q FROM x JOIN th USING (pid) JOIN p0 USING (item, k)),
        p1 AS (SELECT item, k, r / sum(r) OVER (PARTITION BY k) AS v FROM (SELECT item, k, sum(tv / q) AS r FROM q1 WHERE q > 1e-10 GROUP BY ALL)),
        q2 AS (SELECT x.pid, x.item, k, t * v AS tv, sum(t * v) OVER (PARTITION BY x.pid, x.item) AS q FROM x JOIN th USING (pid) JOIN p1 USING (item, k)),
        p2 AS (SELECT item, k, r / sum(r) OVER (PARTITION BY k) AS v FROM (SELECT item, k, sum(tv / q) AS r FROM q2 WHERE q > 1e-10 GROUP BY ALL)),
        q3 AS (SELECT x.pid, x.item, k, t * v AS tv, sum(t * v) OVER (PARTITION BY x.pid, x.item) AS q FROM x JOIN th USING (pid) JOIN p2 USING (item, k)),
        p3 AS (SELECT item, k, r / sum(r) OVER (PARTITION BY k) AS v FROM (SELECT item, k, sum(tv / q) AS r FROM q3 WHERE q > 1e-10 GROUP BY ALL))
        SELECT item, k, round(v, 6) AS v FROM p3""",
    "joint_round": """WITH lo AS (SELECT 'ph' AS view, item, k, v FROM h UNION ALL SELECT 'ps', item::VARCHAR, k, v FROM hs),
        cells AS (SELECT 'ph' AS view, pid, item FROM x UNION ALL SELECT 'ps', pid, item::VARCHAR FROM s),
        wt AS (SELECT 'ph' AS view, 1.0::DOUBLE AS w UNION ALL SELECT 'ps', 0.25),
        up AS (SELECT pid, k, sum(w * v) AS v FROM cells JOIN lo USING (view, item) JOIN wt USING (view) GROUP BY ALL),
        kl AS (SELECT a.k, b.k AS l, sum(w * a.v * b.v) AS v FROM lo a JOIN lo b USING (view, item) JOIN wt USING (view) GROUP BY ALL),
        dn AS (SELECT pid, l AS k, sum(g.v * kl.v) AS v FROM g0 g JOIN kl USING (k) GROUP BY ALL),
        n1 AS (SELECT g.pid, g.k, g.v * up.v / (dn.v + 0.1 + 1e-10) AS v FROM g0 g JOIN up USING (pid, k) JOIN dn USING (pid, k)),
        sizes AS (SELECT a.k, b.k AS l, sum(a.v * b.v) AS v FROM n1 a JOIN n1 b USING (pid) GROUP BY ALL),
        xg AS (SELECT view, item, k, sum(v) AS v FROM cells JOIN n1 USING (pid) GROUP BY ALL),
        hg AS (SELECT view, item, l AS k, sum(lo.v * z.v) AS v FROM lo JOIN sizes z USING (k) GROUP BY ALL)
        SELECT view, item, k, round(lo.v * w * xg.v / (w * hg.v + 0.1 + 1e-10), 6) AS v FROM lo JOIN xg USING (view, item, k) JOIN hg USING (view, item, k) JOIN wt USING (view) WHERE lo.v * xg.v > 0""",
    "kl_round": """WITH lo AS (SELECT 'ph' AS view, item, k, v FROM h UNION ALL SELECT 'ps', item::VARCHAR, k, v FROM hs),
        cells AS (SELECT 'ph' AS view, pid, item FROM x UNION ALL SELECT 'ps', pid, item::VARCHAR FROM s),
        q0 AS (SELECT view, pid, item, sum(g.v * lo.v) + 1e-10 AS q FROM cells JOIN lo USING (view, item) JOIN g0 g USING (pid, k) GROUP BY ALL),
        up AS (SELECT pid, k, sum(v / q) AS v FROM q0 JOIN lo USING (view, item) GROUP BY ALL),
        dn AS (SELECT k, sum(v) AS v FROM lo GROUP BY k),
        n1 AS (SELECT g.pid, g.k, g.v * up.v / (dn.v + 1e-10) AS v FROM g0 g JOIN up USING (pid, k) JOIN dn USING (k)),
        q1 AS (SELECT view, pid, item, sum(n1.v * lo.v) + 1e-10 AS q FROM cells JOIN lo USING (view, item) JOIN n1 USING (pid, k) GROUP BY ALL),
        hu AS (SELECT view, item, k, sum(v / q) AS v FROM q1 JOIN n1 USING (pid) GROUP BY ALL),
        ns AS (SELECT k, sum(v) AS v FROM n1 GROUP BY k)
        SELECT view, item, k, round(lo.v * hu.v / (ns.v + 1e-10), 6) AS v FROM lo JOIN hu USING (view, item, k) JOIN ns USING (k) WHERE lo.v * hu.v > 0""",
    "graph_round": """WITH lo AS (SELECT 'ph' AS view, item, k, v FROM h UNION ALL SELECT 'ps', item::VARCHAR, k, v FROM hs),
        cells AS (SELECT 'ph' AS view, pid, item FROM x UNION ALL SELECT 'ps', pid, item::VARCHAR FROM s),
        edges AS (SELECT a.o_orderkey AS i, b.o_orderkey AS j, 0.5::DOUBLE AS w FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE b.o_orderkey IN (SELECT pid FROM x)),
        near AS (SELECT i AS pid, k, sum(w * v) AS v FROM edges JOIN g0 ON j = g0.pid GROUP BY ALL),
        deg AS (SELECT i AS pid, sum(w) AS d FROM edges GROUP BY i),
        up AS (SELECT pid, k, sum(v) AS v FROM cells JOIN lo USING (view, item) GROUP BY ALL),
        kl AS (SELECT a.k, b.k AS l, sum(a.v * b.v) AS v FROM lo a JOIN lo b USING (view, item) GROUP BY ALL),
        dn AS (SELECT pid, l AS k, sum(g.v * kl.v) AS v FROM g0 g JOIN kl USING (k) GROUP BY ALL),
        n1 AS (SELECT g.pid, g.k, g.v * (up.v + 0.3 * coalesce(near.v, 0)) / (dn.v + 0.3 * coalesce(d, 0) * g.v + 1e-10) AS v FROM g0 g JOIN up USING (pid, k) JOIN dn USING (pid, k) LEFT JOIN near USING (pid, k) LEFT JOIN deg USING (pid)),
        sizes AS (SELECT a.k, b.k AS l, sum(a.v * b.v) AS v FROM n1 a JOIN n1 b USING (pid) GROUP BY ALL),
        xg AS (SELECT view, item, k, sum(v) AS v FROM cells JOIN n1 USING (pid) GROUP BY ALL),
        hg AS (SELECT view, item, l AS k, sum(lo.v * z.v) AS v FROM lo JOIN sizes z USING (k) GROUP BY ALL)
        SELECT view, item, k, round(lo.v * xg.v / (hg.v + 1e-10), 6) AS v FROM lo JOIN xg USING (view, item, k) JOIN hg USING (view, item, k) WHERE lo.v * xg.v > 0""",
    "presence_long": "SELECT pid, item, 1.0::DOUBLE AS val FROM x",
    "doc_freq": "SELECT item, df FROM df",
    "tfidf_weights": "SELECT pid, item, round(val, 6) AS val FROM w",
    "tfidf_sublinear_l1": "SELECT pid, item, round(v / sum(v) OVER (PARTITION BY pid), 6) AS val FROM (SELECT pid, item, ln(1 + dose) * (ln(n::DOUBLE / df) + 1.0) AS v FROM dose JOIN df USING (item), n)",
    "tfidf_row_norm": "SELECT pid, round(sqrt(sum(idf * idf)), 6) AS norm FROM x JOIN idf USING (item) GROUP BY pid",
    "idf_decouple": "SELECT item, k, round(v / idf, 6) AS v FROM h JOIN idf USING (item)",
    "dose_scale": "SELECT pid, item, dose, greatest(max(dose) OVER (PARTITION BY item), 1e-10) AS scale, round(dose / greatest(max(dose) OVER (PARTITION BY item), 1e-10), 6) AS scaled FROM dose",
    "split_assign": "SELECT pid, CASE WHEN rn < floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM (SELECT pid, row_number() OVER (ORDER BY md5(pid || ':42'), pid) - 1 AS rn FROM (SELECT DISTINCT pid FROM x)), n",
    "leave_k_mask": """SELECT pid, item, split, split <> 'train' AND rn <= CASE WHEN c > 2 THEN 2 ELSE c - 1 END AS hidden FROM (
        SELECT x.pid, item, split, row_number() OVER (PARTITION BY x.pid ORDER BY md5(x.pid || ':' || item || ':42'), item) AS rn, count(*) OVER (PARTITION BY x.pid) AS c FROM x JOIN (
        SELECT pid, CASE WHEN rn < floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM (SELECT pid, row_number() OVER (ORDER BY md5(pid || ':42'), pid) - 1 AS rn FROM (SELECT DISTINCT pid FROM x)), n) sp ON x.pid = sp.pid)""",
    "concat_views": "SELECT pid, item, 1.0::DOUBLE AS val FROM x UNION ALL SELECT pid, 'nation ' || item, 0.5::DOUBLE FROM s",
    "frequent_items": "SELECT item, df AS support FROM df, n WHERE df >= floor(0.148::DOUBLE * n)",
    "frequent_pairs": "SELECT i, j, support FROM freq",
    "frequent_triples": "SELECT i, j, k, support FROM freq3",
    "pair_dictionary": "SELECT i, j, support, row_number() OVER (ORDER BY i, j) - 1 AS pair_id FROM freq",
    "pair_view": "SELECT pid, pair_id FROM pairs JOIN (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS pair_id FROM freq) USING (i, j)",
    "pmi_pairs": "SELECT i, j, support, round(pmi, 6) AS pmi FROM pmi",
    "motif_score": "SELECT array_to_string(members, '+') AS members, size, support, round(pmi, 6) AS pmi, round(score, 6) AS score, round(weight, 6) AS weight FROM motif",
    "pres_hyperedges": "SELECT pid AS edge, array_to_string(members, '+') AS members, round(1 / sqrt(size::DOUBLE), 6) AS weight FROM ents WHERE size BETWEEN 3 AND 6",
    "category_hyperedges": "SELECT category AS edge, string_agg(item, '+' ORDER BY item) AS members, 1.0::DOUBLE AS weight FROM cat GROUP BY category HAVING count(*) >= 2",
    "attribute_hyperedges": """SELECT array_to_string(members, '+') AS members, round(score, 6) AS score FROM (SELECT members, round(max(score), 9) AS score FROM (
        SELECT [i, j] AS members, sim AS score FROM alike WHERE j > i UNION ALL
        SELECT list_sort([a.i, a.j, b.j]), (a.sim + b.sim + coalesce(c.sim, 0)) / 3 FROM alike a JOIN alike b ON a.i = b.i AND a.j < b.j LEFT JOIN every c ON c.i = a.j AND c.j = b.j)
        WHERE score >= 0.9 GROUP BY members ORDER BY score DESC, members LIMIT 60)""",
    "hyper_concat": """SELECT edge, array_to_string(members, '+') AS members, weight FROM (SELECT 'entity:' || pid AS edge, members, round(1 / sqrt(size::DOUBLE), 6) AS weight FROM ents WHERE size BETWEEN 3 AND 6
        UNION ALL SELECT 'category:' || category, list_sort(list(item)), 1.0::DOUBLE FROM cat GROUP BY category HAVING count(*) >= 2)""",
    "hyper_bundle": """SELECT i, j, round(sum(w * v), 6) AS v FROM (
        SELECT 0.7::DOUBLE AS w, i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END - a / sqrt(p.d * q.d) AS v FROM (
            SELECT a.item AS i, b.item AS j, sum(a.weight / a.size) AS a FROM inc a JOIN inc b USING (edge) GROUP BY ALL)
            JOIN (SELECT item, sum(weight) AS d FROM inc GROUP BY item) p ON i = p.item JOIN (SELECT item, sum(weight) AS d FROM inc GROUP BY item) q ON j = q.item
        UNION ALL
        SELECT 0.3, i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END - a / sqrt(p.d * q.d) FROM (
            SELECT a.item AS i, b.item AS j, sum(1.0::DOUBLE / a.size) AS a FROM kinds a JOIN kinds b USING (category) GROUP BY ALL)
            JOIN (SELECT item, count(*) AS d FROM kinds GROUP BY item) p ON i = p.item JOIN (SELECT item, count(*) AS d FROM kinds GROUP BY item) q ON j = q.item)
        GROUP BY i, j""",
    "unmatched_symptoms": "SELECT c_mktsegment AS symptom, count(*) AS n FROM customer WHERE c_mktsegment < 'B' GROUP BY c_mktsegment",
    "sweep_change": "SELECT variant, metric_mean, round((metric_mean - b) / abs(b) * 100, 4) AS percent FROM (SELECT variant, round(avg(metric), 4) AS metric_mean FROM res GROUP BY variant), (SELECT round(avg(metric), 4) AS b FROM res WHERE variant = (SELECT min(variant) FROM res))",
    "subsample": "SELECT pid, count(*) AS n FROM x JOIN (SELECT pid FROM (SELECT DISTINCT pid, md5('7:' || pid) AS h FROM x) ORDER BY h, pid LIMIT 500) USING (pid) GROUP BY pid",
    "hyper_incidence": "SELECT pid AS edge, unnest(members) AS item, round(1 / sqrt(size::DOUBLE), 6) AS weight, CAST(size AS INT) AS size FROM ents WHERE size BETWEEN 3 AND 6",
    "hypergraph_laplacian": """SELECT i, j, round(CASE WHEN i = j THEN 1.0 ELSE 0.0 END - a / sqrt(p.d * q.d), 6) AS v FROM (
        SELECT a.item AS i, b.item AS j, sum(a.weight / a.size) AS a FROM inc a JOIN inc b USING (edge) GROUP BY ALL)
        JOIN (SELECT item, sum(weight) AS d FROM inc GROUP BY item) p ON i = p.item JOIN (SELECT item, sum(weight) AS d FROM inc GROUP BY item) q ON j = q.item""",
    "group_variance_loss": "SELECT round(sum(weight * d * d / size), 6) AS loss, true AS normalised FROM centred UNION ALL SELECT round(sum(weight * d * d), 6), false FROM centred",
    "group_variance_gradient": "SELECT item, k, round(sum(2 * weight * d / size), 6) AS g FROM centred GROUP BY item, k",
    "cooc_adjacency": "SELECT i, j, w FROM coadj",
    "category_adjacency": "SELECT i, j, w FROM catadj",
    "cosine_knn": """SELECT i, j, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rn FROM (
        SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rn <= 5""",
    "feature_cosine_knn": "SELECT i, j, round((sim + 1) / 2, 6) AS sim FROM alike",
    "feature_cosine_full": """WITH attrs AS (SELECT p_partkey AS item, 'size ' || p_size AS attr, 1.0::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, p_type, (p_size % 3 - 1)::DOUBLE FROM part),
        units AS (SELECT item, attr, v / sqrt(sum(v * v) OVER (PARTITION BY item)) AS u FROM attrs),
        dots AS (SELECT a.item AS i, b.item AS j, round(sum(a.u * b.u), 9) AS sim FROM units a JOIN units b ON a.attr = b.attr AND a.item <> b.item GROUP BY ALL)
        SELECT i, j, round((sim + 1) / 2, 6) AS sim FROM (SELECT a.p_partkey AS i, b.p_partkey AS j, coalesce(sim, 0) AS sim, row_number() OVER (PARTITION BY a.p_partkey ORDER BY coalesce(sim, 0) DESC, b.p_partkey) AS rn
            FROM part a JOIN part b ON a.p_partkey <> b.p_partkey LEFT JOIN dots ON dots.i = a.p_partkey AND dots.j = b.p_partkey) WHERE rn <= 60""",
    "jaccard_knn": "SELECT i, j, round(sim, 6) AS sim FROM jac",
    "symmetrize": "SELECT i, j, round(w, 6) AS w FROM g",
    "weighted_graph": "SELECT i, j, round(sum(w), 6) AS w FROM (SELECT i, j, 0.5 * w AS w FROM coadj UNION ALL SELECT i, j, 0.3 * w FROM catadj UNION ALL SELECT i, j, 0.2 * w FROM g) GROUP BY ALL",
    "laplacian_unnorm": "SELECT i, j, round(sum(v), 6) AS v FROM (SELECT item AS i, item AS j, coalesce(d, 0) AS v FROM nodes LEFT JOIN (SELECT i, sum(w) AS d FROM g GROUP BY i) q ON item = q.i UNION ALL SELECT i, j, -w FROM g) GROUP BY i, j",
    "laplacian_sym": """SELECT i, j, round(sum(v), 6) AS v FROM (SELECT item AS i, item AS j, 1.0::DOUBLE AS v FROM nodes UNION ALL
        SELECT g.i, g.j, -w / sqrt(a.d * b.d) FROM g JOIN (SELECT i, sum(w) AS d FROM g GROUP BY i) a ON g.i = a.i JOIN (SELECT i, sum(w) AS d FROM g GROUP BY i) b ON g.j = b.i) GROUP BY i, j""",
    "contra_matrix": "SELECT i, j, w FROM bad2",
    "violations": "SELECT x.pid AS set_id, x.n, coalesce(v, 0) AS violations FROM (SELECT pid, count(*) AS n FROM x GROUP BY pid) x LEFT JOIN (SELECT pid, count(*) AS v FROM pairs JOIN bad USING (i, j) GROUP BY pid) b ON x.pid = b.pid",
    "compat_rate": """SELECT round(coalesce(avg(CASE WHEN p.pid IS NOT NULL AND p.v = 0 THEN 1.0 ELSE 0.0 END), 1.0), 6) AS rate FROM (
        SELECT pid FROM x GROUP BY pid HAVING count(*) >= 2 AND pid NOT IN (SELECT pid FROM pairs JOIN bad USING (i, j))) t
        LEFT JOIN (SELECT pid, (SELECT count(*) FROM bad WHERE list_contains(m, i) AND list_contains(m, j)) AS v FROM (SELECT pid, list(item) AS m FROM ranked WHERE rank <= 6 GROUP BY pid)) p ON t.pid = p.pid""",
    "filter_hard": "SELECT pid AS qid, item, score FROM scores ANTI JOIN (SELECT DISTINCT pid, j AS item FROM x JOIN bad2 ON x.item = bad2.i) b USING (pid, item)",
    "filter_soft": "SELECT s.pid AS qid, s.item, round(score - 0.01 * coalesce(c, 0), 9) AS score FROM scores s LEFT JOIN (SELECT pid, j AS item, count(*) AS c FROM x JOIN bad2 ON x.item = bad2.i GROUP BY ALL) b ON s.pid = b.pid AND s.item = b.item",
    "contra_penalty": "SELECT round(sum(w * a.v * b.v), 6) AS penalty FROM bad2 JOIN h a ON bad2.i = a.item JOIN h b ON bad2.j = b.item AND a.k = b.k",
    "gram_matrix": "SELECT a.k, b.k AS l, round(sum(a.v * b.v), 9) AS v FROM h a JOIN h b ON a.item = b.item GROUP BY ALL",
    "matmul_long": "SELECT pid, k, round(v, 6) AS v FROM gx",
    "nre": """SELECT round(sqrt(greatest(xx - 2 * xc + cc, 0) / xx), 6) AS nre FROM (SELECT count(*)::DOUBLE AS xx FROM x), (SELECT sum(5 * gx.v * h.v) AS xc FROM x JOIN gx ON x.pid = gx.pid JOIN h ON h.item = x.item AND h.k = gx.k),
        (SELECT sum(a.v * b.v) AS cc FROM (SELECT a.k, b.k AS l, sum(25 * a.v * b.v) AS v FROM gx a JOIN gx b ON a.pid = b.pid GROUP BY ALL) a JOIN (SELECT a.k, b.k AS l, sum(a.v * b.v) AS v FROM h a JOIN h b ON a.item = b.item GROUP BY ALL) b USING (k, l))""",
    "frobenius_identity": """SELECT round(xx, 4) AS squared, round(xc, 4) AS "cross", round(cc, 4) AS recon, round(greatest(xx - 2 * xc + cc, 0), 4) AS error FROM (SELECT count(*)::DOUBLE AS xx FROM x), (SELECT sum(5 * gx.v * h.v) AS xc FROM x JOIN gx ON x.pid = gx.pid JOIN h ON h.item = x.item AND h.k = gx.k),
        (SELECT sum(a.v * b.v) AS cc FROM (SELECT a.k, b.k AS l, sum(25 * a.v * b.v) AS v FROM gx a JOIN gx b ON a.pid = b.pid GROUP BY ALL) a JOIN (SELECT a.k, b.k AS l, sum(a.v * b.v) AS v FROM h a JOIN h b ON a.item = b.item GROUP BY ALL) b USING (k, l))""",
    "recommend_dot": "SELECT pid, item, CAST(rank AS INT) AS rank, score FROM ranked WHERE rank <= 10",
    "dirichlet_smooth": "SELECT pid, k, round(v / sum(v) OVER (PARTITION BY pid), 6) AS v FROM (SELECT p.pid, t.k, coalesce(z.v, 0) + 0.1 AS v FROM (SELECT DISTINCT pid FROM z) p CROSS JOIN (SELECT DISTINCT k FROM hs) t LEFT JOIN z ON z.pid = p.pid AND z.k = t.k)",
    "dose_scores": "SELECT pid, h.item, round(sum(z.v * h.v * mean), 9) AS score FROM z JOIN h USING (k) JOIN (SELECT item, avg(dose) AS mean FROM dose GROUP BY item) d ON h.item = d.item GROUP BY ALL",
    "explain_topic": """SELECT side, k, item, CAST(rn AS INT) AS rank, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY side, k ORDER BY round(v, 9) DESC, item DESC) AS rn FROM (
        SELECT 'brand' AS side, k, item, v FROM h UNION ALL SELECT 'nation', k, item::VARCHAR, v FROM hs UNION ALL
        SELECT 'dose', k, item, v * mean FROM h JOIN (SELECT item, avg(dose) AS mean FROM dose GROUP BY item) USING (item) UNION ALL SELECT 'order', k, pid::VARCHAR, v FROM gx)) WHERE rn <= 5""",
    "greedy_formula": """WITH RECURSIVE foes AS (SELECT i AS item, list(j) AS f FROM bad2 GROUP BY i), cells AS (SELECT pid, scores.item, score, coalesce(f, []) AS f FROM scores LEFT JOIN foes ON scores.item = foes.item),
        chosen AS (SELECT pid, 0 AS step, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS item, CAST(NULL AS DOUBLE) AS score FROM (SELECT DISTINCT pid FROM scores)
        UNION ALL SELECT pid, step, taken, item, score FROM (SELECT c.pid, c.step + 1 AS step, list_append(c.taken, s.item) AS taken, s.item, s.score - 0.02::DOUBLE * len(list_intersect(c.taken, s.f)) AS score,
            row_number() OVER (PARTITION BY c.pid ORDER BY s.score - 0.02::DOUBLE * len(list_intersect(c.taken, s.f)) DESC, s.item DESC) AS rn
            FROM chosen c JOIN cells s ON c.pid = s.pid WHERE c.step < 5 AND NOT list_contains(c.taken, s.item)) WHERE rn = 1 AND score > 0)
        SELECT pid, CAST(step AS INT) AS step, item, round(score, 6) AS score FROM chosen WHERE step > 0""",
    "heldout_ppl_dot": """WITH cases AS (SELECT * FROM (VALUES (0.2::DOUBLE, 0.0::DOUBLE), (0.5, 0.0), (0.2, 0.1)) t(ratio, alpha), (VALUES (42), (7)) s(seed)),
        placed AS (SELECT ratio, alpha, seed, pid, item, row_number() OVER (PARTITION BY ratio, alpha, seed, pid ORDER BY md5(pid || ':' || item || ':' || seed), item) AS p, count(*) OVER (PARTITION BY ratio, alpha, seed, pid) AS c FROM x, cases),
        masked AS (SELECT *, p <= greatest(1, floor(c * ratio + 1e-9)) AS held FROM placed WHERE c >= 2),
        mix AS (SELECT ratio, alpha, seed, pid, k, sum(v) AS z FROM masked JOIN h USING (item) WHERE NOT held GROUP BY ALL),
        entity AS (SELECT DISTINCT ratio, alpha, seed, pid FROM masked),
        smooth AS (SELECT e.ratio, e.alpha, e.seed, e.pid, t.k, coalesce(z, 0) + e.alpha AS z FROM entity e CROSS JOIN (SELECT DISTINCT k FROM h) t LEFT JOIN mix m ON m.ratio = e.ratio AND m.alpha = e.alpha AND m.seed = e.seed AND m.pid = e.pid AND m.k = t.k WHERE e.alpha > 0 OR z IS NOT NULL),
        mixed AS (SELECT *, CASE WHEN alpha > 0 THEN z / sum(z) OVER (PARTITION BY ratio, alpha, seed, pid) ELSE z END AS t FROM smooth),
        shares AS (SELECT k, v / (sum(v) OVER (PARTITION BY k) + 1e-10) AS ps, v, item FROM h),
        preds AS (SELECT ratio, alpha, seed, pid, s.item, sum(t * CASE WHEN alpha > 0 THEN s.ps ELSE s.v END) AS q FROM mixed JOIN shares s USING (k) GROUP BY ALL),
        totals AS (SELECT ratio, alpha, seed, pid, sum(q) + 1e-10 * (SELECT count(*) FROM nodes) AS total FROM preds GROUP BY ALL)
        SELECT m.ratio, m.alpha, CAST(m.seed AS BIGINT) AS seed, count(*) AS n, round(exp(-avg(ln(CASE WHEN m.alpha > 0 THEN greatest(coalesce(q, 0), 1e-10) ELSE (coalesce(q, 0) + 1e-10) / total END))), 4) AS ppl
        FROM masked m JOIN totals t USING (ratio, alpha, seed, pid) LEFT JOIN preds p ON p.ratio = m.ratio AND p.alpha = m.alpha AND p.seed = m.seed AND p.pid = m.pid AND p.item = m.item WHERE held GROUP BY m.ratio, m.alpha, m.seed""",
    "role_folded_ppl": """WITH topics AS (SELECT p_type AS k, row_number() OVER (ORDER BY p_type) - 1 AS no FROM (SELECT DISTINCT p_type FROM part)),
        roles AS (SELECT p_brand AS item, p_type AS k, p_size % 2 AS role, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
        hr AS (SELECT item, k, role, c / sum(c) OVER (PARTITION BY k, role) AS v FROM roles),
        mix AS (SELECT x.pid, k, sum(v) AS z FROM x JOIN hr USING (item) WHERE x.pid IN (SELECT pid FROM s) GROUP BY ALL),
        smooth AS (SELECT p.pid, t.k, coalesce(z, 0) + 0.1 AS z FROM (SELECT DISTINCT pid FROM mix) p CROSS JOIN topics t LEFT JOIN mix ON mix.pid = p.pid AND mix.k = t.k WHERE t.k IN (SELECT k FROM hs)),
        both_ AS (SELECT 'plain' AS kind, pid, k, z FROM mix UNION ALL SELECT 'smoothed', pid, k, z / sum(z) OVER (PARTITION BY pid) FROM smooth),
        shares AS (SELECT item, k, v, v / (sum(v) OVER (PARTITION BY k) + 1e-10) AS ps FROM hs),
        preds AS (SELECT kind, pid, s.item, round(sum(z * CASE WHEN kind = 'plain' THEN s.v ELSE s.ps END), 9) AS q FROM both_ JOIN shares s USING (k) GROUP BY ALL),
        totals AS (SELECT kind, pid, sum(q) + 1e-10 * 25 AS total FROM preds GROUP BY ALL)
        SELECT t.kind, round(exp(-avg(ln((coalesce(q, 0) + 1e-10) / total))), 4) AS ppl FROM s JOIN totals t USING (pid) LEFT JOIN preds p ON p.kind = t.kind AND p.pid = s.pid AND p.item = s.item GROUP BY t.kind""",
    "family_tests": """WITH runs AS (SELECT o_orderpriority AS variant, year(o_orderdate) AS seed, round(avg(o_totalprice), 2) AS price, round(stddev_pop(o_totalprice), 2) AS spread FROM orders WHERE o_totalprice IS NOT NULL GROUP BY ALL),
        long AS (SELECT variant, seed, 'price' AS metric, price AS value FROM runs UNION ALL SELECT variant, seed, 'spread', spread FROM runs),
        kinds_ AS (SELECT DISTINCT variant AS v FROM runs),
        comps AS (SELECT 'price' AS family, a.v AS a, b.v AS b, 'price' AS metric, 1 AS way, 500.0::DOUBLE AS practical FROM kinds_ a JOIN kinds_ b ON a.v < b.v
            UNION ALL SELECT 'both', a.v, b.v, m.metric, m.way, m.practical FROM kinds_ a JOIN kinds_ b ON a.v < b.v AND a.v = (SELECT min(v) FROM kinds_), (VALUES ('price', 1, 500.0::DOUBLE), ('spread', -1, 300.0::DOUBLE)) m(metric, way, practical)),
        deltas AS (SELECT family, a, b, c.metric, practical, way * (p.value - q.value) AS delta FROM comps c JOIN long p ON p.variant = a AND p.metric = c.metric JOIN long q ON q.variant = b AND q.metric = c.metric AND q.seed = p.seed),
        ranks AS (SELECT *, CASE WHEN delta <> 0 THEN rank() OVER (PARTITION BY family, a, b, metric, delta <> 0 ORDER BY abs(delta)) END AS rk FROM deltas),
        sums AS (SELECT family, a, b, metric, any_value(practical) AS practical, count(*) AS n, count(rk) AS nonzero, count(*) FILTER (delta > 0) AS wins, avg(delta) AS mean, median(delta) AS median,
            coalesce(sum(sign(delta) * rk) / sum(rk), 0) AS effect, least(coalesce(sum(rk) FILTER (delta > 0), 0), coalesce(sum(rk) FILTER (delta < 0), 0)) AS w FROM ranks GROUP BY family, a, b, metric),
        ways AS (SELECT n, list_sum(list_transform(range(0, n), lambda i: ((m >> CAST(i AS INT)) & 1) * (i + 1))) AS t, count(*) AS c FROM range(2, 11) k(n), range(0, 1024) s(m) WHERE m < (1 << CAST(n AS INT)) GROUP BY ALL),
        tested AS (SELECT *, CASE WHEN nonzero < 2 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(c) FROM ways WHERE ways.n = nonzero AND t <= w) / pow(2, nonzero)) END AS p FROM sums),
        steps AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, a, b, metric) + 1)) AS step FROM tested),
        adjusted AS (SELECT *, max(step) OVER (PARTITION BY family ORDER BY p, a, b, metric) AS hp FROM steps)
        SELECT family, a, b, metric, n, nonzero, wins, round(mean, 4) AS mean, round(median, 4) AS median, round(effect, 6) AS effect, round(w::DOUBLE, 6) AS w, round(p, 6) AS p, round(hp, 6) AS holm,
        CASE WHEN hp >= 0.3 AND abs(median) < practical THEN 'not significant, negligible' WHEN hp >= 0.3 THEN 'not significant' WHEN abs(median) < practical THEN 'significant, negligible' WHEN median > 0 THEN 'better' ELSE 'worse' END AS verdict FROM adjusted""",
    "topic_usage_rank": "SELECT k, round(sum(v) / any_value(n), 6) AS usage FROM gx, n GROUP BY k ORDER BY usage DESC, k LIMIT 3",
    "active_topics": "SELECT pid, k, CAST(rn AS INT) AS rank, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(v, 9) DESC, k) AS rn FROM gx) WHERE rn <= 3",
    "precision_recall_k": "SELECT pid, count(val) FILTER (rank <= 5) AS hits, round(count(val) FILTER (rank <= 5) / 5, 6) AS p, round(count(val) FILTER (rank <= 5) / any_value(n_true), 6) AS r FROM judged GROUP BY pid",
    "average_precision": "SELECT pid, round(ap, 6) AS ap FROM ap",
    "ndcg_k": """SELECT d.pid, round(dcg / idcg, 6) AS ndcg FROM (SELECT pid, sum(coalesce(val, 0) / log2(rank + 1)) AS dcg FROM judged WHERE rank <= 10 GROUP BY pid) d
        JOIN (SELECT pid, sum(val / log2(rn + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY val DESC, item DESC) AS rn FROM w) WHERE rn <= 10 GROUP BY pid) i ON d.pid = i.pid""",
    "recommendation_summary": "SELECT round(map, 6) AS map, "
    + ", ".join(f"round(p_{k}, 6) AS p_{k}, round(r_{k}, 6) AS r_{k}, round(ndcg_{k}, 6) AS ndcg_{k}" for k in (5, 10))
    + " FROM (SELECT avg(ap) AS map FROM ap), "
    + ", ".join(
        f"""(SELECT avg(hits / {k}) AS p_{k}, avg(hits / n_true) AS r_{k}, avg(dcg / idcg) AS ndcg_{k} FROM (SELECT pid, count(val) FILTER (rank <= {k}) AS hits, any_value(n_true) AS n_true, sum(coalesce(val, 0) / log2(rank + 1)) FILTER (rank <= {k}) AS dcg FROM judged GROUP BY pid)
        JOIN (SELECT pid, sum(val / log2(rn + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY val DESC, item DESC) AS rn FROM w) WHERE rn <= {k} GROUP BY pid) USING (pid))"""
        for k in (5, 10)
    ),
    "ptm_prf": """SELECT round(avg(hits / 10), 6) AS precision, round(avg(hits / n_true), 6) AS recall, round(avg(dcg / greatest(idcg, 1e-10)), 6) AS ndcg FROM (
        SELECT pid, count(val) FILTER (rank <= 10) AS hits, any_value(n_true) AS n_true, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10 AND val IS NOT NULL), 0) AS dcg, list_sum(list_transform(range(1, least(10, any_value(n_true)) + 1), lambda r: 1 / log2(r + 1))) AS idcg FROM judged GROUP BY pid)""",
    "ptm_prf_calibrated": """SELECT round(avg(hits / own), 6) AS precision, round(avg(hits / n_true), 6) AS recall, round(avg(dcg / greatest(list_sum(list_transform(range(1, least(own, n_true) + 1), lambda r: 1 / log2(r + 1))), 1e-10)), 6) AS ndcg FROM (
        SELECT pid, own, n_true, count(val) FILTER (rank <= own) AS hits, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= own AND val IS NOT NULL), 0) AS dcg FROM (
        SELECT a.pid, own, n_true, val, row_number() OVER (PARTITION BY a.pid ORDER BY sc DESC, a.item DESC) AS rank FROM (
        SELECT pid, scores.item, round((greatest(score, 0) + 1e-10) / sum(greatest(score, 0) + 1e-10) OVER (PARTITION BY pid) / pow(df / n::DOUBLE + 1e-10, 0.5), 9) AS sc FROM scores JOIN df ON scores.item = df.item, n) a
        LEFT JOIN w ON a.pid = w.pid AND a.item = w.item JOIN (SELECT pid, count(*) AS n_true FROM w GROUP BY pid) t ON a.pid = t.pid
        JOIN (SELECT pid, least(greatest(CAST(round_even(1.5::DOUBLE * count(*), 0) AS INT), 1), 10) AS own FROM s GROUP BY pid) q ON a.pid = q.pid) GROUP BY pid, own, n_true)""",
    "reconstruction_ppl": """SELECT round(exp(-avg(ln((greatest(coalesce(score, 0), 0) + 1e-10) / total))), 4) AS ppl FROM x JOIN (SELECT pid, sum(greatest(score, 0)) + 1e-10 * (SELECT count(*) FROM nodes) AS total FROM (SELECT pid, h.item, round(sum(gx.v * h.v), 9) AS score FROM gx JOIN h USING (k) GROUP BY ALL) GROUP BY pid) t ON x.pid = t.pid
        LEFT JOIN (SELECT pid, h.item, round(sum(gx.v * h.v), 9) AS score FROM gx JOIN h USING (k) GROUP BY ALL) c ON x.pid = c.pid AND x.item = c.item""",
    "crossmodal_ppl": "SELECT round(exp(-avg(ln((greatest(coalesce(score, 0), 0) + 1e-10) / total))), 4) AS ppl FROM x JOIN (SELECT pid, sum(greatest(score, 0)) + 1e-10 * (SELECT count(*) FROM nodes) AS total FROM scores GROUP BY pid) t ON x.pid = t.pid LEFT JOIN scores ON x.pid = scores.pid AND x.item = scores.item",
    "coherence": """SELECT k, round(avg(ln((coalesce(c, 0) / n::DOUBLE + 1e-10) / (coalesce(p.df, 0) / n::DOUBLE * (coalesce(q.df, 0) / n::DOUBLE) + 1e-10))), 6) AS coherence FROM (
        SELECT a.k, a.item AS i, b.item AS j FROM top10 a JOIN top10 b ON a.k = b.k AND a.item < b.item) t LEFT JOIN (SELECT i, j, support AS c FROM counts) c ON t.i = c.i AND t.j = c.j LEFT JOIN df p ON t.i = p.item LEFT JOIN df q ON t.j = q.item, n GROUP BY k""",
    "tgc": """SELECT k, round(avg(CASE WHEN s.i IS NULL THEN 0.0 ELSE 1.0 END), 6) AS tgc FROM (SELECT a.k, a.item AS i, b.item AS j FROM top8 a JOIN top8 b ON a.k = b.k AND a.item < b.item) t
        LEFT JOIN (SELECT DISTINCT a.item AS i, b.item AS j FROM cat a JOIN cat b ON a.category = b.category AND a.item < b.item) s ON t.i = s.i AND t.j = s.j GROUP BY k""",
    "motif_hit": "SELECT t.k, round((SELECT count(*) FROM motif WHERE list_has_all(t.m, members)) / (SELECT count(*) FROM motif), 6) AS rate FROM (SELECT k, list(item) AS m FROM top10 GROUP BY k) t",
    "violation_rate_k": "SELECT pid, round((SELECT count(*) FROM bad WHERE list_contains(m, i) AND list_contains(m, j)) / 15.0::DOUBLE, 6) AS rate FROM (SELECT pid, list(item) AS m FROM ranked WHERE rank <= 6 GROUP BY pid)",
    "dose_errors": "SELECT round(avg(abs(dose - mean)), 6) AS mae, round(sqrt(avg((dose - mean) * (dose - mean))), 6) AS rmse, round(avg(2 * abs(dose - mean) / greatest(abs(dose) + abs(mean), 1e-10)), 6) AS smape FROM (SELECT dose, avg(dose) OVER (PARTITION BY item) AS mean FROM dose)",
    "paired_delta": "SELECT K, seed, x, y, round(delta, 4) AS delta FROM pd",
    "paired_outcomes": "SELECT count(*) AS n, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties, round(avg(delta), 4) AS mean_delta, round(median(delta), 4) AS median_delta FROM pd",
    "signed_ranks": "SELECT K, seed, delta, round(rank() OVER (ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY abs(delta)) - 1) / 2, 4) AS rank FROM (SELECT K, seed, round(delta, -3) AS delta FROM pd) WHERE delta <> 0",
    "rank_biserial": "SELECT seed, round(effect, 6) AS effect FROM effect",
    "holm": "SELECT seed, p, round(max(least(1.0, p * (m - rn + 1))) OVER (ORDER BY rn), 6) AS holm FROM (SELECT *, row_number() OVER (ORDER BY p, seed) AS rn, count(*) OVER () AS m FROM (SELECT seed, round(1 - abs(effect), 6) AS p FROM effect))",
    "interpretation": "SELECT seed, p, effect, CASE WHEN p >= 0.7 AND abs(effect) < 0.4 THEN 'not significant, negligible' WHEN p >= 0.7 THEN 'not significant' WHEN abs(effect) < 0.4 THEN 'significant, negligible' WHEN effect > 0 THEN 'better' ELSE 'worse' END AS verdict FROM (SELECT seed, round(1 - abs(effect), 6) AS p, round(effect, 6) AS effect FROM effect)",
    "corr_regr": """SELECT round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept FROM (
        SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM (SELECT size::DOUBLE AS x, metric AS y FROM res))""",
    "sweep_summary": "SELECT variant, count(*) AS n, round(avg(metric), 4) AS metric_mean, round(stddev_pop(metric), 4) AS metric_std FROM res GROUP BY variant",
    "best_setting": "SELECT variant, round(avg(metric), 4) AS metric_mean FROM res GROUP BY variant ORDER BY metric_mean DESC, variant LIMIT 1",
    "alias_lookup": "SELECT alias, canonical FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY no DESC) AS rn FROM (SELECT no, trim(unnest(string_split(value, ','))) AS alias, trim(split_part(value, ',', 1)) AS canonical FROM alines)) WHERE rn = 1",
    "loaded_views": """WITH ln AS (SELECT o_custkey AS pid, p_brand, n_name, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
        held AS (SELECT DISTINCT pid, p_brand AS item FROM ln),
        two AS (SELECT a.pid, a.item AS i, b.item AS j, count(*) OVER (PARTITION BY a.item, b.item) AS c FROM held a JOIN held b ON a.pid = b.pid AND a.item < b.item),
        no AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part)),
        att AS (SELECT p_brand, count(DISTINCT p_type) + min(p_size) + max(p_size) AS t FROM part GROUP BY p_brand)
        SELECT 'presence' AS view, item AS name, count(*) AS n, count(*)::DOUBLE AS total FROM held GROUP BY item
        UNION ALL SELECT 'dosage', p_brand, count(DISTINCT pid), round(sum(l_quantity)::DOUBLE, 2) FROM ln GROUP BY p_brand
        UNION ALL SELECT 'symptoms', n_name, count(DISTINCT pid), count(DISTINCT pid)::DOUBLE FROM ln GROUP BY n_name
        UNION ALL SELECT 'herb_attributes', p_brand, 1, t::DOUBLE FROM att
        UNION ALL SELECT 'symptom_features', n_name, 1, n_regionkey::DOUBLE FROM nation
        UNION ALL SELECT 'pairs', 'pairs', count(*), sum(101 * i + 1)::DOUBLE FROM no WHERE i < (SELECT max(i) FROM no)
        UNION ALL SELECT 'symptom_pairs', 'symptom_pairs', 24, sum(101 * r + 1)::DOUBLE FROM range(0, 24) t(r)
        UNION ALL SELECT 'conflicts', 'conflicts', count(*), sum(100 * a.i + b.i)::DOUBLE FROM bad JOIN no a ON a.p_brand = bad.i JOIN no b ON b.p_brand = bad.j
        UNION ALL SELECT 'pair_view', 'pair_view', count(*), count(*)::DOUBLE FROM two WHERE c >= 2""",
    "knowledge_load": "SELECT DISTINCT symptom, item FROM found WHERE item IS NOT NULL AND symptom >= 'B'",
    "anti_unmatched": "SELECT token, count(*) AS n FROM found WHERE item IS NULL GROUP BY token",
    "id_mismatch": "SELECT count(*) AS mismatches FROM (SELECT DISTINCT o_orderkey AS k FROM orders) FULL JOIN (SELECT DISTINCT pid FROM x) ON k = pid WHERE k IS NULL OR pid IS NULL",
}

ORACLES = {name: sql(body) for name, body in _BODIES.items()}
