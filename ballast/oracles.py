"""SQL that gives the rows of the corridor queries, as chains of common table expressions."""

from __future__ import annotations

import re

from ballast.sources import scene

_MM = "CAST(floor({} * 1000 + 5e-1) AS BIGINT)"


def mm(expression: str) -> str:
    return _MM.format(f"({expression})")


def nm(expression: str) -> str:
    """Mean heights in nanometres: in millimetres they often lie halfway."""
    return f"CAST(floor(({expression}) * 1e9 + 5e-1) AS BIGINT)"


#: Each stage reads earlier ones by name; ``chain`` puts before a query the stages that it needs.
STAGES: dict[str, str] = {
    "scene": scene.POINTS_SQL.format(orders="orders"),
    "track_mm": scene.TRACKS_SQL.format(orders="orders", nation="nation", region="region"),
    "points": "SELECT scene_id, point_id, x_mm / 1000e0 AS x, y_mm / 1000e0 AS y, z_mm / 1000e0 AS z, label FROM scene",
    "classes": "SELECT * FROM points WHERE label IN (0, 1, 100)",
    "vertices": "SELECT scene_id, track_id, 0 AS part, CAST(seq AS INT) AS seq, x_mm / 1000e0 AS x, y_mm / 1000e0 AS y FROM track_mm",
    "boxes": "SELECT scene_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM classes GROUP BY scene_id",
    "segs": """
SELECT *, sum(len) OVER (w ROWS UNBOUNDED PRECEDING) AS d1, coalesce(sum(len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS d0, lead(seq) OVER w IS NULL AS is_last
FROM (SELECT *, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) AS len
      FROM (SELECT *, lead(x) OVER (PARTITION BY scene_id, track_id, part ORDER BY seq) AS x1, lead(y) OVER (PARTITION BY scene_id, track_id, part ORDER BY seq) AS y1 FROM vertices)
      WHERE x1 IS NOT NULL)
WINDOW w AS (PARTITION BY scene_id, track_id, part ORDER BY seq)""",
    "hit_tracks": """
SELECT DISTINCT s.scene_id, s.track_id FROM segs s JOIN boxes b USING (scene_id)
WHERE EXISTS (SELECT 1 FROM range(0, 1001) r(k)
  WHERE s.x + (k / 1000e0) * (s.x1 - s.x) BETWEEN b.x_min AND b.x_max AND s.y + (k / 1000e0) * (s.y1 - s.y) BETWEEN b.y_min AND b.y_max)""",
    "dense": """
SELECT scene_id, track_id, part, k, x + t * (x1 - x) AS rx, y + t * (y1 - y) AS ry
FROM (SELECT *, least((least(k * 5e-1, d1) - d0) / len, 1e0) AS t
      FROM (SELECT *, unnest(range(CAST(ceil(d0 / 5e-1) AS BIGINT), CAST(ceil(d1 / 5e-1) AS BIGINT) + CASE WHEN is_last THEN 1 ELSE 0 END)) AS k
            FROM segs WHERE (scene_id, track_id) IN (SELECT (scene_id, track_id) FROM hit_tracks)))""",
    "rails": """
SELECT DISTINCT p.scene_id, p.point_id FROM classes p JOIN dense d ON p.scene_id = d.scene_id AND d.rx BETWEEN p.x - 2 AND p.x + 2
WHERE (p.x - d.rx) * (p.x - d.rx) + (p.y - d.ry) * (p.y - d.ry) <= 1e0""",
    "norm": """
SELECT p.scene_id, p.point_id, p.x - o.x0 AS x, p.y - o.y0 AS y, p.z - o.z0 AS z, r.point_id IS NOT NULL AS is_rail, p.label AS given
FROM classes p LEFT JOIN rails r USING (scene_id, point_id)
JOIN (SELECT scene_id, avg(x) AS x0, avg(y) AS y0, min(z) AS z0 FROM classes WHERE scene_id IN (SELECT scene_id FROM rails) GROUP BY scene_id) o ON o.scene_id = p.scene_id""",
    "nodes": "SELECT scene_id, CAST(floor(x / 15e-1) AS BIGINT) AS kx, CAST(floor(y / 15e-1) AS BIGINT) AS ky, avg(x) AS nx, avg(y) AS ny FROM norm WHERE is_rail GROUP BY ALL",
    "axis": """
SELECT scene_id, mx, my, cos(a) AS fx, sin(a) AS fy
FROM (SELECT scene_id, avg(nx) AS mx, avg(ny) AS my, atan2(2 * covar_pop(nx, ny), var_pop(nx) - var_pop(ny)) / 2 AS a FROM nodes GROUP BY scene_id)""",
    "uv": "SELECT scene_id, (nx - mx) * fx + (ny - my) * fy AS u, (nx - mx) * fy - (ny - my) * fx AS v FROM nodes JOIN axis USING (scene_id)",
    "trace": """
SELECT scene_id, bin, count(*) AS n, quantile_cont(u, 5e-1) AS u, quantile_cont(v, 5e-1) AS v
FROM (SELECT *, CAST(floor((u - min(u) OVER (PARTITION BY scene_id)) / 15e-1) AS BIGINT) AS bin FROM uv) GROUP BY scene_id, bin HAVING count(*) >= 3""",
    # the cubic of least squares in t = (u - uc) / us, by the normal equations and elimination
    "sums": """
SELECT scene_id, uc, us, u0, u9, n, """
    + ", ".join(f"sum(t ** {k}) AS s{k}" for k in range(7)) + ", " + ", ".join(f"sum(v * t ** {k}) AS b{k}" for k in range(4))
    + """
FROM (SELECT *, (u - uc) / us AS t FROM (SELECT scene_id, u, v, count(*) OVER w AS n, min(u) OVER w AS u0, max(u) OVER w AS u9, (min(u) OVER w + max(u) OVER w) / 2 AS uc, (max(u) OVER w - min(u) OVER w) / 2 AS us
      FROM trace WINDOW w AS (PARTITION BY scene_id)))
GROUP BY scene_id, uc, us, u0, u9, n""",
    "e1": "SELECT *, " + ", ".join(f"s{i + j} - s{i} * s{j} / s0 AS a{i}{j}" for i in range(1, 4) for j in range(i, 4)) + ", " + ", ".join(f"b{i} - s{i} * b0 / s0 AS c{i}" for i in range(1, 4)) + " FROM sums",
    "e2": "SELECT *, a22 - a12 * a12 / a11 AS d22, a23 - a12 * a13 / a11 AS d23, a33 - a13 * a13 / a11 AS d33, c2 - a12 * c1 / a11 AS f2, c3 - a13 * c1 / a11 AS f3 FROM e1",
    "cubic": """
SELECT *, (b0 - s1 * p1 - s2 * p2 - s3 * p3) / s0 AS p0
FROM (SELECT *, (c1 - a12 * p2 - a13 * p3) / a11 AS p1
      FROM (SELECT *, (f2 - d23 * p3) / d22 AS p2 FROM (SELECT *, (f3 - d23 * f2 / d22) / (d33 - d23 * d23 / d22) AS p3 FROM e2)))""",
    "line0": """
SELECT scene_id, vtx, mx + u * fx + v * fy AS cx, my + u * fy - v * fx AS cy
FROM (SELECT *, p0 + p1 * t + p2 * t * t + p3 * t * t * t AS v
      FROM (SELECT *, (u - uc) / us AS t
            FROM (SELECT *, u0 + vtx * (u9 - u0) / (m - 1) AS u
                  FROM (SELECT *, CAST(unnest(range(m)) AS INT) AS vtx FROM (SELECT *, greatest(n, CAST(floor((u9 - u0) / 15e-1) AS BIGINT)) AS m FROM cubic)))))
JOIN axis USING (scene_id)""",
    "line": """
SELECT scene_id, vtx, cx, cy, coalesce(sum(d) OVER (PARTITION BY scene_id ORDER BY vtx), 0e0) AS s
FROM (SELECT *, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) AS d FROM line0 WINDOW w AS (PARTITION BY scene_id ORDER BY vtx))""",
    "edges": "SELECT * FROM (SELECT *, lead(cx) OVER w AS cx1, lead(cy) OVER w AS cy1, lead(s) OVER w AS s1 FROM line WINDOW w AS (PARTITION BY scene_id ORDER BY vtx)) WHERE s1 IS NOT NULL",
    # the scene bends by far less than the limit, so every section has the full length but the last
    "marks": "SELECT scene_id, CAST(k AS INT) AS section_id, k * 10e0 AS s0, least((k + 1) * 10e0, total) AS s1 FROM (SELECT scene_id, total, unnest(range(CAST(ceil(total / 10e0) AS BIGINT))) AS k FROM (SELECT scene_id, max(s) AS total FROM line GROUP BY scene_id))",
    "ends": """
SELECT m.*, a.cx + (m.s0 - a.s) / (a.s1 - a.s) * (a.cx1 - a.cx) AS p0x, a.cy + (m.s0 - a.s) / (a.s1 - a.s) * (a.cy1 - a.cy) AS p0y,
  b.cx + (m.s1 - b.s) / (b.s1 - b.s) * (b.cx1 - b.cx) AS p1x, b.cy + (m.s1 - b.s) / (b.s1 - b.s) * (b.cy1 - b.cy) AS p1y
FROM marks m JOIN edges a ON a.scene_id = m.scene_id AND a.s <= m.s0 AND m.s0 < a.s1
JOIN edges b ON b.scene_id = m.scene_id AND b.s < m.s1 AND m.s1 <= b.s1""",
    "cuts": "SELECT scene_id, section_id, s0, s1, p0x, p0y, (p1x - p0x) / l AS fx, (p1y - p0y) / l AS fy FROM (SELECT *, sqrt((p1x - p0x) ** 2 + (p1y - p0y) ** 2) AS l FROM ends)",
    "near_vtx": """
SELECT n.*, arg_min(l.vtx, ((n.x - l.cx) * (n.x - l.cx) + (n.y - l.cy) * (n.y - l.cy), l.vtx)) AS vtx
FROM norm n JOIN line l USING (scene_id) GROUP BY ALL""",
    "assigned": """
SELECT n.*, l.s AS point_s, c.section_id, c.p0x, c.p0y, c.fx, c.fy FROM near_vtx n JOIN line l USING (scene_id, vtx)
JOIN cuts c ON c.scene_id = n.scene_id AND c.s0 <= l.s AND l.s < c.s1""",
    "rotated": """
SELECT *, (x - p0x) * fy - (y - p0y) * fx AS rx,
  (x - p0x) * fx + (y - p0y) * fy - min((x - p0x) * fx + (y - p0y) * fy) OVER (PARTITION BY scene_id, section_id) AS ry FROM assigned""",
    "near": """
SELECT * FROM rotated p WHERE is_rail OR EXISTS (
  SELECT 1 FROM rotated r WHERE r.is_rail AND r.scene_id = p.scene_id AND r.section_id = p.section_id AND (p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y) < 625e0)""",
    "corridor": """
SELECT n.* EXCLUDE (rx), n.rx - m AS rx
FROM near n JOIN (SELECT scene_id, section_id, (quantile_cont(rx, 5e-2) + quantile_cont(rx, 95e-2)) * 5e-1 AS m FROM near WHERE is_rail GROUP BY scene_id, section_id) USING (scene_id, section_id)""",
    "prof": """
SELECT scene_id, section_id, bin, x0 + (bin + 5e-1) * 25e-2 AS x, avg(z) AS z, count(*) AS n, bool_or(is_rail) AS rail
FROM (SELECT *, CAST(floor((rx - x0) / 25e-2) AS BIGINT) AS bin FROM (SELECT *, min(rx) OVER (PARTITION BY scene_id, section_id) AS x0 FROM corridor))
GROUP BY scene_id, section_id, x0, bin""",
    "sides0": """
SELECT scene_id, section_id, bin, x, z, n, CASE WHEN bin < lo THEN -1 ELSE 1 END AS side
FROM (SELECT *, min(bin) FILTER (rail) OVER w AS lo, max(bin) FILTER (rail) OVER w AS hi FROM prof WINDOW w AS (PARTITION BY scene_id, section_id))
WHERE bin < lo OR bin > hi""",
    "full_bins": "SELECT scene_id, section_id, side, unnest(range(min(bin), max(bin) + 1)) AS bin FROM sides0 GROUP BY scene_id, section_id, side",
    "side_fill": """
SELECT f.*, a.bin AS bin_a, a.x AS xa, a.z AS za, a.n AS na, b.bin AS bin_b, b.x AS xb, b.z AS zb
FROM full_bins f ASOF JOIN sides0 a ON a.scene_id = f.scene_id AND a.section_id = f.section_id AND a.side = f.side AND a.bin <= f.bin
ASOF JOIN sides0 b ON b.scene_id = f.scene_id AND b.section_id = f.section_id AND b.side = f.side AND b.bin >= f.bin""",
    "sides": """
SELECT *, side * x AS out_x, CAST(row_number() OVER (w ORDER BY side * x) - 1 AS BIGINT) AS i, count(*) OVER w AS len
FROM (SELECT scene_id, section_id, side, bin, CASE WHEN bin = bin_a THEN xa ELSE xa + (bin - bin_a) / CAST(bin_b - bin_a AS DOUBLE) * (xb - xa) END AS x,
        CASE WHEN bin = bin_a THEN za ELSE za + (bin - bin_a) / CAST(bin_b - bin_a AS DOUBLE) * (zb - za) END AS z, CASE WHEN bin = bin_a THEN na ELSE 0 END AS n FROM side_fill)
WINDOW w AS (PARTITION BY scene_id, section_id, side)""",
    "means": """
SELECT s.scene_id, s.section_id, s.side, s.i, CASE WHEN any_value(s.len) >= 5 THEN avg(o.z) ELSE any_value(s.z) END AS zs
FROM sides s CROSS JOIN range(-2, 3) k(d)
JOIN sides o ON o.scene_id = s.scene_id AND o.section_id = s.section_id AND o.side = s.side AND o.i = greatest(0, least(s.len - 1, s.i + k.d))
GROUP BY s.scene_id, s.section_id, s.side, s.i""",
    "slopes": """
SELECT *, CASE WHEN hs IS NULL THEN (ahead - zs) / hd WHEN hd IS NULL THEN (zs - back) / hs
  ELSE (hs * hs * ahead + (hd * hd - hs * hs) * zs - hd * hd * back) / (hs * hd * (hs + hd)) END AS dz
FROM (SELECT *, out_x - lag(out_x) OVER w AS hs, lead(out_x) OVER w - out_x AS hd, lag(zs) OVER w AS back, lead(zs) OVER w AS ahead
      FROM sides JOIN means USING (scene_id, section_id, side, i) WINDOW w AS (PARTITION BY scene_id, section_id, side ORDER BY i))""",
    # by side: lists of the three masks, and the search window
    "lists": """
SELECT scene_id, section_id, side, len, list(dz >= -1e-1 ORDER BY i) AS stop, list(dz > 1e-1 ORDER BY i) AS up, list(dz < -1e-1 ORDER BY i) AS down,
  count(*) FILTER (out_x - x0 < 6) AS lo, greatest(count(*) FILTER (out_x - x0 < 6), count(*) FILTER (out_x - x0 <= 16)) AS hi
FROM (SELECT *, min(out_x) OVER (PARTITION BY scene_id, section_id, side) AS x0 FROM slopes) WHERE len >= 2 GROUP BY scene_id, section_id, side, len""",
    "emb": "SELECT *, {run:stop,7,len,3} AS emb_end FROM lists",
    "ditch1": "SELECT *, greatest(emb_end, lo) AS a, {run:up,greatest(emb_end,lo),least(hi,greatest(emb_end,lo)+5),2} AS r1, {run:up,lo,hi,2} AS ru, {run:down,lo,hi,2} AS rd FROM emb",
    "ditch2": "SELECT *, least(hi, {end:down,rd}) AS j FROM ditch1",
    "ditch3": "SELECT *, CASE WHEN rd IS NOT NULL THEN {run:up,j,least(hi,j+6),2} END AS r2 FROM ditch2",
    "ditch4": """
SELECT *, least(hi, {end:up,r1}, r1 + 8) AS e1, least(hi, {end:up,ru}, ru + 8) AS eu, least(hi, {end:up,r2}, r2 + 8) AS e2,
  emb_end IS NOT NULL AND a < hi AND r1 IS NOT NULL AND r1 - a <= 3 AS immediate FROM ditch3""",
    "ditch5": """
SELECT *, CASE WHEN immediate THEN greatest(lo, r1 - 3) WHEN r2 IS NOT NULL AND (ru IS NULL OR rd <= ru) THEN greatest(rd, emb_end, lo) WHEN ru IS NOT NULL THEN greatest(ru, emb_end, lo) END AS b,
  least(len, CASE WHEN immediate THEN e1 WHEN r2 IS NOT NULL AND (ru IS NULL OR rd <= ru) THEN e2 WHEN ru IS NOT NULL THEN eu END) AS e FROM ditch4""",
    "ditches": "SELECT scene_id, section_id, side, len, lo, hi, emb_end, CASE WHEN ok THEN b END AS ditch_start, CASE WHEN ok THEN e END AS ditch_end FROM (SELECT *, emb_end IS NOT NULL AND lo < hi AND b IS NOT NULL AND e > b AS ok FROM ditch5)",
    "kinds": """
SELECT s.*, CASE WHEN emb_end IS NULL THEN 'emb' WHEN ditch_start IS NULL THEN CASE WHEN i < emb_end THEN 'emb' ELSE 'rest' END
  WHEN i < ditch_start THEN 'emb' WHEN i < ditch_end THEN 'ditch' ELSE 'rest' END AS kind
FROM slopes s JOIN ditches USING (scene_id, section_id, side)""",
    "ivals": "SELECT scene_id, section_id, side, kind, min(x) AS x_min, max(x) AS x_max FROM kinds GROUP BY scene_id, section_id, side, kind",
    "flags": """
SELECT p.scene_id, p.point_id, any_value(p.is_rail) AS is_rail,
  bool_or(v.kind = 'ditch' AND inside) AS d, bool_or(v.kind = 'emb' AND inside) AS e, bool_or(v.kind = 'rest' AND inside) AS r,
  count(DISTINCT v.side) FILTER (v.kind = 'emb') = 2 AND any_value(p.rx) BETWEEN min(v.x_min) FILTER (v.kind = 'emb') - 125e-3 AND max(v.x_max) FILTER (v.kind = 'emb') + 125e-3 AS c
FROM (SELECT p.*, v.side, v.kind, v.x_min, v.x_max, p.rx BETWEEN v.x_min - 125e-3 AND v.x_max + 125e-3 AS inside
      FROM corridor p JOIN ivals v USING (scene_id, section_id)) AS p, LATERAL (SELECT p.side, p.kind, p.x_min, p.x_max) AS v
GROUP BY p.scene_id, p.point_id""",
    "unsmoothed": """
SELECT n.scene_id, n.point_id, n.x, n.y, n.is_rail, n.given,
  CASE WHEN n.is_rail OR (NOT coalesce(f.d, false) AND (coalesce(f.e, false) OR coalesce(f.c, false))) THEN 10 WHEN f.d THEN 11 ELSE 1 END AS label
FROM norm n LEFT JOIN flags f USING (scene_id, point_id)""",
    "proj0": """
SELECT p.scene_id, p.point_id, arg_min(e.vtx, ((p.x - (e.cx + e.cx1) * 5e-1) * (p.x - (e.cx + e.cx1) * 5e-1) + (p.y - (e.cy + e.cy1) * 5e-1) * (p.y - (e.cy + e.cy1) * 5e-1), e.vtx)) AS seg
FROM unsmoothed p JOIN edges e USING (scene_id) GROUP BY p.scene_id, p.point_id""",
    "proj": """
SELECT *, s_a + t * l AS s, (x - (cx + t * vx)) * (vy / l) - (y - (cy + t * vy)) * (vx / l) AS across
FROM (SELECT *, greatest(0e0, least(1e0, ((x - cx) * vx + (y - cy) * vy) / (vx * vx + vy * vy))) AS t, sqrt(vx * vx + vy * vy) AS l
      FROM (SELECT p.*, seg, e.cx, e.cy, e.s AS s_a, e.cx1 - e.cx AS vx, e.cy1 - e.cy AS vy
            FROM unsmoothed p JOIN proj0 USING (scene_id, point_id) JOIN edges e ON e.scene_id = p.scene_id AND e.vtx = seg))""",
    "sl": """
SELECT *, CAST(greatest(0, least(n_s - 1, floor((s - s_lo) / 15e-1))) AS INT) AS si, CAST(floor(xa / 25e-2) AS INT) AS xi
FROM (SELECT *, max(xa) FILTER (label IN (10, 11)) OVER (PARTITION BY scene_id, side) AS widest
      FROM (SELECT *, CASE WHEN across >= 0 THEN 1 ELSE -1 END AS side, abs(across) AS xa, min(s) OVER w AS s_lo,
              CAST(greatest(4, ceil((max(s) OVER w - min(s) OVER w) / 15e-1)) AS INT) AS n_s
            FROM proj WINDOW w AS (PARTITION BY scene_id)))
WHERE xa <= greatest(widest + 75e-2, 2525e-2)""",
    "grid": """
SELECT *, CASE WHEN n_ditch > 0 AND n_ditch >= n_ground AND n_ditch >= n_emb THEN 11 WHEN n_emb > 0 AND n_emb >= n_ground THEN 10 ELSE 1 END AS cell
FROM (SELECT scene_id, side, n_s, si, xi, count(*) FILTER (label = 1) AS n_ground, count(*) FILTER (label = 10) AS n_emb, count(*) FILTER (label = 11) AS n_ditch, count(*) AS n_total
      FROM sl GROUP BY scene_id, side, n_s, si, xi)""",
    "curves": """
SELECT k.scene_id, k.side, k.si, CASE WHEN e < a - 25e-2 THEN e END AS emb_outer, CASE WHEN o < a - 25e-2 THEN i END AS ditch_inner, CASE WHEN o < a - 25e-2 THEN o END AS ditch_outer,
  coalesce(e >= a - 25e-2, false) OR coalesce(o >= a - 25e-2, false) AS edge_locked
FROM (SELECT DISTINCT scene_id, side, CAST(unnest(range(n_s)) AS INT) AS si FROM (SELECT DISTINCT scene_id, side, n_s FROM grid)) k
LEFT JOIN (SELECT scene_id, side, si, max(m) AS a, max(m) FILTER (cell = 10) AS e, min(m) FILTER (cell = 11) AS i, max(m) FILTER (cell = 11) AS o
           FROM (SELECT *, (xi + 5e-1) * 25e-2 AS m FROM grid) GROUP BY scene_id, side, si) USING (scene_id, side, si)""",
    "known": "SELECT scene_id, side, si, unnest(['emb', 'inner', 'outer', 'emb_on', 'ditch_on']) AS what, unnest([emb_outer, ditch_inner, ditch_outer, CASE WHEN emb_outer IS NULL THEN 0e0 ELSE 1e0 END, CASE WHEN ditch_outer IS NULL THEN 0e0 ELSE 1e0 END]) AS v FROM curves",
    "filled": """
SELECT k.scene_id, k.side, k.what, k.si, CASE WHEN k.v IS NOT NULL THEN k.v WHEN l.v IS NULL THEN r.v WHEN r.v IS NULL THEN l.v ELSE l.v + (k.si - l.si) * (r.v - l.v) / (r.si - l.si) END AS v, k.v AS raw
FROM known k ASOF LEFT JOIN (SELECT * FROM known WHERE v IS NOT NULL) l ON l.scene_id = k.scene_id AND l.side = k.side AND l.what = k.what AND l.si <= k.si
ASOF LEFT JOIN (SELECT * FROM known WHERE v IS NOT NULL) r ON r.scene_id = k.scene_id AND r.side = k.side AND r.what = k.what AND r.si >= k.si""",
    "gauss": "SELECT d, w / sum(w) OVER () AS w FROM (SELECT CAST(d AS INT) AS d, exp(-5e-1 * (d / (20e0 / 15e-1)) ** 2) AS w FROM range(-53, 54) g(d))",
    "curve": """
SELECT f.scene_id, f.side, f.what, f.si, CASE WHEN any_value(c.n_ditch) < 2 AND f.what IN ('inner', 'outer') THEN any_value(f.raw) ELSE sum(g.w * o.v) END AS v
FROM filled f JOIN (SELECT scene_id, side, count(emb_outer) AS n_emb, count(ditch_outer) AS n_ditch, max(si) AS top FROM curves GROUP BY scene_id, side) c ON c.scene_id = f.scene_id AND c.side = f.side AND c.n_emb >= 2
CROSS JOIN gauss g JOIN filled o ON o.scene_id = f.scene_id AND o.side = f.side AND o.what = f.what AND o.si = greatest(0, least(c.top, f.si + g.d))
GROUP BY f.scene_id, f.side, f.what, f.si""",
    "wide": "SELECT scene_id, side, si, " + ", ".join(f"max(v) FILTER (what = '{w}') AS {c}" for w, c in (("emb", "emb"), ("inner", "inn"), ("outer", "outr"), ("emb_on", "emb_on"), ("ditch_on", "ditch_on"))) + " FROM curve GROUP BY scene_id, side, si",
    "read": """
SELECT p.scene_id, p.point_id, p.xa, """
    + ", ".join(f"CASE WHEN part = 0 THEN a.{c} WHEN part = 1 THEN b.{c} ELSE a.{c} + part * (b.{c} - a.{c}) END AS {c}" for c in ("emb", "inn", "outr", "emb_on", "ditch_on"))
    + """
FROM (SELECT *, greatest(0e0, least(1e0, m - j)) AS part FROM (SELECT *, CAST(greatest(0, least(n_s - 2, floor(m))) AS INT) AS j FROM (SELECT *, (s - s_lo) / 15e-1 - 5e-1 AS m FROM sl))) p
JOIN curves l ON l.scene_id = p.scene_id AND l.side = p.side AND l.si = p.si AND NOT l.edge_locked
JOIN wide a ON a.scene_id = p.scene_id AND a.side = p.side AND a.si = p.j JOIN wide b ON b.scene_id = p.scene_id AND b.side = p.side AND b.si = p.j + 1""",
    "smoothed": """
SELECT u.scene_id, u.point_id, u.given, CASE WHEN u.is_rail THEN 10 WHEN r.point_id IS NULL THEN u.label
  WHEN r.ditch_on > 3e-1 AND r.xa > r.inn AND r.xa <= r.outr THEN 11 WHEN r.emb_on > 3e-1 AND r.xa <= r.emb THEN 10 ELSE 1 END AS label
FROM unsmoothed u LEFT JOIN read r USING (scene_id, point_id)""",
    "final": """
SELECT p.scene_id, p.point_id, CAST(CASE WHEN s.point_id IS NULL THEN p.label WHEN s.given <> 0 THEN s.label WHEN s.label = 10 THEN 0 ELSE 1 END AS SMALLINT) AS label
FROM points p LEFT JOIN smoothed s USING (scene_id, point_id)""",
}


def _runs(text: str) -> str:
    """``{run:mask,lo,hi,m}``: where the first run of m in a list of flags begins, within lo and hi; ``{end:mask,i}``: where the run at i ends."""

    def run(m: re.Match) -> str:
        mask, rest = m[1].split(",", 1)
        depth, cuts, last = 0, [], 0
        for k, ch in enumerate(rest):
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                cuts.append(rest[last:k])
                last = k + 1
        lo, hi, least = *cuts, rest[last:]
        return f"list_min(list_filter(range({lo}, {hi} - {least} + 1), lambda i: list_bool_and({mask}[i + 1:i + {least}])))"

    def end(m: re.Match) -> str:
        mask, at = m[1].split(",")
        return f"CASE WHEN {at} IS NOT NULL THEN coalesce(list_min(list_filter(range({at}, len), lambda i: NOT {mask}[i + 1])), len) END"

    return re.sub(r"\{end:([^}]*)\}", end, re.sub(r"\{run:([^}]*)\}", run, text))


STAGES = {name: _runs(body).replace("list_bool_and", "list_aggregate").replace("])))", "], 'bool_and')))") if "{run" in body else _runs(body) for name, body in STAGES.items()}


def chain(query: str, stages: dict[str, str] = STAGES) -> str:
    """The query with all the stages that it needs in front, each before those that read it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in stages:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(stages[name])
                if name not in needed:
                    needed.append(name)

    visit(query)
    if not needed:
        return query
    own = query.strip()
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({stages[n].strip()})" for n in needed) + (",\n" + own[5:] if own.startswith("WITH ") else "\n" + own)


_P = "scene_id, point_id"
_S = "scene_id, section_id"

QUERIES: dict[str, str] = {
    "class_filter": "SELECT scene_id, point_id, label FROM classes",
    "scene_bbox": f"SELECT scene_id, {mm('x_min')} AS x_min, {mm('x_max')} AS x_max, {mm('y_min')} AS y_min, {mm('y_max')} AS y_max FROM boxes",
    "track_vertices": f"SELECT scene_id, track_id, part, seq, {mm('x')} AS x, {mm('y')} AS y FROM vertices",
    "track_bbox_semi": "SELECT scene_id, track_id FROM hit_tracks",
    "densify_tracks": f"SELECT scene_id, track_id, part, k, {mm('rx')} AS rx, {mm('ry')} AS ry FROM dense",
    "rail_mask": "SELECT scene_id, point_id FROM rails",
    "normalise": f"SELECT {_P}, {mm('x')} AS x, {mm('y')} AS y, {mm('z')} AS z, is_rail FROM norm",
    "centerline_nodes": f"SELECT scene_id, kx, ky, {mm('nx')} AS nx, {mm('ny')} AS ny FROM nodes",
    "pca_axis": f"SELECT scene_id, {mm('mx')} AS mx, {mm('my')} AS my, {mm('fx * 1000')} AS fx, {mm('fy * 1000')} AS fy FROM axis",
    "trace_medians": f"SELECT scene_id, bin, n, {mm('u')} AS u, {mm('v')} AS v FROM trace",
    "centerline_vertices": f"SELECT scene_id, vtx, {mm('cx')} AS cx, {mm('cy')} AS cy FROM line",
    "arc_length": f"SELECT scene_id, vtx, {mm('s')} AS s FROM line",
    "section_cuts": f"SELECT {_S}, {mm('s0')} AS s0, {mm('s1')} AS s1, {mm('p0x')} AS p0x, {mm('p0y')} AS p0y, {mm('fx * 1000')} AS fx, {mm('fy * 1000')} AS fy FROM cuts",
    "nearest_vertex": f"SELECT {_P}, vtx FROM near_vtx",
    "section_assign": f"SELECT {_P}, section_id FROM assigned",
    "rotate_section": f"SELECT {_P}, section_id, {mm('rx')} AS rx, {mm('ry')} AS ry FROM rotated",
    "corridor_semi": f"SELECT {_P}, section_id FROM near",
    "rail_center": f"SELECT {_P}, {mm('rx')} AS rx FROM corridor",
    "xz_profile": f"SELECT {_S}, bin, {mm('x')} AS x, {nm('z')} AS z_nm, n, rail FROM prof",
    "zx_profile": f"SELECT {_S}, bin, {mm('avg(rx)')} AS x, count(*) AS n FROM (SELECT *, CAST(floor((z - min(z) OVER (PARTITION BY scene_id, section_id)) / 25e-2) AS BIGINT) AS bin FROM corridor) GROUP BY {_S}, bin",
    "rail_side_split": f"SELECT {_S}, side, bin, {nm('z')} AS z_nm FROM sides0",
    "gap_fill": f"SELECT {_S}, side, i, {mm('x')} AS x, {nm('z')} AS z_nm, n FROM sides",
    "moving_mean": f"SELECT {_S}, side, i, {mm('zs')} AS zs FROM means",
    "gradient": f"SELECT {_S}, side, i, {mm('dz')} AS dz FROM slopes",
    "emb_end": f"SELECT {_S}, side, emb_end FROM emb",
    "ditch_interval": f"SELECT {_S}, side, lo AS search_start, hi AS search_stop, ditch_start, ditch_end FROM ditches",
    "profile_split": f"SELECT {_S}, side, kind, {mm('x_min')} AS x_min, {mm('x_max')} AS x_max FROM ivals",
    "ground_unsmoothed": f"SELECT {_P}, label FROM unsmoothed",
    "sl_projection": f"SELECT {_P}, {mm('s')} AS s, {mm('across')} AS across FROM proj",
    "sl_grid": "SELECT scene_id, side, si, xi, n_ground, n_emb, n_ditch, n_total, cell FROM grid",
    "boundary_curves": f"SELECT scene_id, side, si, {mm('emb_outer')} AS emb_outer, {mm('ditch_inner')} AS ditch_inner, {mm('ditch_outer')} AS ditch_outer, edge_locked FROM curves",
    "boundary_smooth": f"SELECT scene_id, side, si, {mm('emb')} AS emb, {mm('inn')} AS ditch_inner, {mm('outr')} AS ditch_outer, {mm('emb_on')} AS emb_on, {mm('ditch_on')} AS ditch_on FROM wide",
    "voxel_subsample": """
SELECT scene_id, arg_min(point_id, (d2, point_id)) AS point_id
FROM (SELECT *, (x - (kx + 5e-1) * 5e-1) * (x - (kx + 5e-1) * 5e-1) + (y - (ky + 5e-1) * 5e-1) * (y - (ky + 5e-1) * 5e-1) + (z - (kz + 5e-1) * 5e-1) * (z - (kz + 5e-1) * 5e-1) AS d2
      FROM (SELECT *, floor(x / 5e-1) AS kx, floor(y / 5e-1) AS ky, floor(z / 5e-1) AS kz FROM classes))
GROUP BY scene_id, kx, ky, kz""",
    "raster_maxz": f"""
SELECT scene_id, iy, ix, {mm("max(z)")} AS z
FROM (SELECT *, CAST(floor((x - min(x) OVER w) / 5e-1) AS INT) AS ix, CAST(floor((y - min(y) OVER w) / 5e-1) AS INT) AS iy FROM classes WINDOW w AS (PARTITION BY scene_id))
GROUP BY scene_id, iy, ix""",
    "plot_parts": f"""
SELECT {_S}, bin, CAST(sum(CASE WHEN gap > greatest(3 * mid, 1e-6) THEN 1 ELSE 0 END) OVER (PARTITION BY scene_id, section_id ORDER BY bin) AS BIGINT) AS part
FROM (SELECT *, quantile_cont(gap, 5e-1) OVER (PARTITION BY scene_id, section_id) AS mid
      FROM (SELECT *, x - lag(x) OVER (PARTITION BY scene_id, section_id ORDER BY x) AS gap FROM prof WHERE NOT rail))""",
    "tile_assign": """
WITH s AS (SELECT *, x - min(x) OVER w AS u, y - min(y) OVER w AS v, floor((max(x) OVER w - min(x) OVER w) / 40) AS nx, floor((max(y) OVER w - min(y) OVER w) / 40) AS ny FROM points WINDOW w AS (PARTITION BY scene_id)),
t AS (SELECT scene_id, point_id, ty, tx FROM s JOIN range(0, 50) a(tx) ON tx <= nx AND u >= tx * 40 - 10 AND u < (tx + 1) * 40 + 10 JOIN range(0, 50) b(ty) ON ty <= ny AND v >= ty * 40 - 10 AND v < (ty + 1) * 40 + 10)
SELECT scene_id, point_id, ty, tx FROM (SELECT *, count(*) OVER (PARTITION BY scene_id, ty, tx) AS n FROM t) WHERE n >= 1024""",
    "viewer_buffers": f"""
SELECT scene_id, point_id, CAST(floor(point_id / 500000e0) AS BIGINT) AS buffer_id, {mm("x - min(x) OVER w")} AS x, {mm("y - min(y) OVER w")} AS y, {mm("z - min(z) OVER w")} AS z, label
FROM points WINDOW w AS (PARTITION BY scene_id)""",
    "ground_labels": "SELECT scene_id, point_id, label FROM final",
    "label_counts": "SELECT scene_id, label, count(*) AS n FROM final GROUP BY scene_id, label",
}


def all_sql() -> dict[str, str]:
    return {name: chain(query) for name, query in QUERIES.items()}
