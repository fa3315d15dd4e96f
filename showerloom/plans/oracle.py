"""The engine's operators restated in DuckDB SQL, as named common table expressions."""

from __future__ import annotations

import re

from ..sources.steps import STEPS_SQL

K = "event_id, subdetector, layer"


def _mean(c: str, w: str = "energy") -> str:
    return f"CASE WHEN min({c}) = max({c}) THEN min({c}) WHEN sum({w}) > 0 THEN sum({w} * {c}) / sum({w}) ELSE avg({c}) END"


def _settled(v: str) -> str:
    return f"floor(({v}) * CAST(1e9 AS DOUBLE) + 0.5) / CAST(1e9 AS DOUBLE)"


def _axis(source: str) -> str:
    """Centre, covariance and principal axis per event of a relation (event_id, x, y, z, energy)."""
    cov = ", ".join(f"sum(w * (x - cx) * (x - cx)) / sum(w) AS sxx".replace("(x - cx) * (x - cx)", f"({a} - c{a}) * ({b} - c{b})").replace("sxx", f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))  # noqa: F541
    return f"""SELECT event_id, n, cx, cy, cz, CASE WHEN good THEN vx / sqrt(nn) * sg ELSE 0 END AS ax, CASE WHEN good THEN vy / sqrt(nn) * sg ELSE 0 END AS ay, CASE WHEN good THEN vz / sqrt(nn) * sg ELSE 1 END AS az FROM (
 SELECT *, n >= 2 AND p > 0 AND nn > 0 AS good, CASE WHEN vx + vy + vz < 0 THEN -1 ELSE 1 END AS sg FROM (
 SELECT *, greatest(n0, n1, n2) AS nn, {", ".join(f"CASE WHEN n0 >= n1 AND n0 >= n2 THEN v0{k} WHEN n1 >= n2 THEN v1{k} ELSE v2{k} END AS v{k}" for k in "xyz")} FROM (
 SELECT *, {", ".join(f"v{i}x * v{i}x + v{i}y * v{i}y + v{i}z * v{i}z AS n{i}" for i in range(3))} FROM (
 SELECT *, sxy * syz - sxz * (syy - l) AS v0x, sxz * sxy - (sxx - l) * syz AS v0y, (sxx - l) * (syy - l) - sxy * sxy AS v0z,
  sxy * (szz - l) - sxz * syz AS v1x, sxz * sxz - (sxx - l) * (szz - l) AS v1y, (sxx - l) * syz - sxy * sxz AS v1z,
  (syy - l) * (szz - l) - syz * syz AS v2x, syz * sxz - sxy * (szz - l) AS v2y, sxy * syz - (syy - l) * sxz AS v2z FROM (
 SELECT *, q + p * 2 * cos(acos(least(greatest(CASE WHEN p > 0 THEN ((sxx - q) * ((syy - q) * (szz - q) - syz * syz) - sxy * (sxy * (szz - q) - syz * sxz) + sxz * (sxy * syz - (syy - q) * sxz)) / (p * p * p * 2) END, -1), 1)) / 3) AS l FROM (
 SELECT *, sqrt(((sxx - q) * (sxx - q) + (syy - q) * (syy - q) + (szz - q) * (szz - q) + (sxy * sxy + sxz * sxz + syz * syz) * 2) / 6) AS p FROM (
 SELECT *, (sxx + syy + szz) / 3 AS q FROM (
 SELECT event_id, n, cx, cy, cz, {cov} FROM (SELECT s.*, c.* EXCLUDE (event_id), CASE WHEN sw > 0 THEN energy ELSE 1 END AS w FROM {source} s JOIN (
  SELECT event_id, count(*) AS n, sum(energy) AS sw, {", ".join(f"{_mean(k)} AS c{k}" for k in "xyz")} FROM {source} GROUP BY event_id) c ON s.event_id = c.event_id) GROUP BY ALL))))))))"""


def _project(source: str, frame: str, extra: str = "") -> str:
    """Rows with w, u, v (and both transverse directions) in the frame's axes."""
    return f"""SELECT *, rx * ax + ry * ay + rz * az AS w, rx * e1x + ry * e1y + rz * e1z AS u, rx * e2x + ry * e2y + rz * e2z AS v FROM (
 SELECT *, (ay * e1z - az * e1y) / m2 AS e2x, (az * e1x - ax * e1z) / m2 AS e2y, (ax * e1y - ay * e1x) / m2 AS e2z FROM (
 SELECT *, sqrt((ay * e1z - az * e1y) * (ay * e1z - az * e1y) + (az * e1x - ax * e1z) * (az * e1x - ax * e1z) + (ax * e1y - ay * e1x) * (ax * e1y - ay * e1x)) + 1e-12 AS m2 FROM (
 SELECT *, fx_ / m1 AS e1x, fy_ / m1 AS e1y, fz_ / m1 AS e1z FROM (
 SELECT *, sqrt(fx_ * fx_ + fy_ * fy_ + fz_ * fz_) + 1e-12 AS m1 FROM (
 SELECT *, ay * 0 - az * hy AS fx_, az * hx - ax * 0 AS fy_, ax * hy - ay * hx AS fz_ FROM (
 SELECT s.*, f.* EXCLUDE (event_id), x - cx AS rx, y - cy AS ry, z - cz AS rz, CASE WHEN abs(ax) >= 0.9 THEN CAST(0 AS DOUBLE) ELSE 1 END AS hx, CASE WHEN abs(ax) >= 0.9 THEN CAST(1 AS DOUBLE) ELSE 0 END AS hy{extra}
  FROM {source} s JOIN {frame} f ON s.event_id = f.event_id))))))"""


def _wq(source: str, keys: str, value: str, names: dict[str, float]) -> str:
    """Weighted quantiles of a relation with step_id and energy."""
    cols = ", ".join(f"arg_min(CASE WHEN pc IS NULL OR c <= pc THEN v ELSE pv + (CAST({q} AS DOUBLE) - pc) * (v - pv) / (c - pc) END, k) FILTER (c >= {q} OR c = 1) AS {n}" for n, q in names.items())
    return f"""SELECT {keys}, {cols} FROM (SELECT *, lag(c) OVER (PARTITION BY {keys} ORDER BY k) AS pc FROM (
 SELECT {keys}, {value} AS v, row_number() OVER o AS k, lag({value}) OVER o AS pv, CASE WHEN sum(energy) OVER (PARTITION BY {keys}) > 0 THEN sum(energy) OVER (o ROWS UNBOUNDED PRECEDING) / sum(energy) OVER (PARTITION BY {keys}) END AS c
 FROM {source} WINDOW o AS (PARTITION BY {keys} ORDER BY {value}, step_id))) GROUP BY {keys}"""


def _bin(v: str, a: str, b: str, n: int) -> str:
    lo, hi = f"CASE WHEN {a} = {b} THEN {a} - 0.5 ELSE {a} END", f"CASE WHEN {a} = {b} THEN {b} + 0.5 ELSE {b} END"
    return f"CASE WHEN {v} >= ({lo}) AND {v} <= ({hi}) THEN CAST(least(floor(({v} - ({lo})) / (({hi}) - ({lo})) * {n}), {n - 1}) AS BIGINT) END"


def _components(name: str, nodes: str, pairs: str, keys: str) -> dict[str, str]:
    """Relations {name}_reach and {name}: smallest root of each node; pairs (keys, a, b) in both directions."""
    on = " AND ".join(f"r.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    pk = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return {
        f"{name}_reach": f"SELECT {keys}, id, id AS root FROM {nodes} UNION SELECT {pk}, p.b, r.root FROM {name}_reach r JOIN {pairs} p ON {on} AND r.id = p.a WHERE r.root < p.b",
        name: f"SELECT {keys}, id, min(root) AS root FROM {name}_reach GROUP BY {keys}, id",
    }


def _dbscan(name: str, rows: str, keys: str, eps: str) -> dict[str, str]:
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    d2 = "(a.fx - b.fx) * (a.fx - b.fx) + (a.fy - b.fy) * (a.fy - b.fy) + (a.ft - b.ft) * (a.ft - b.ft)"
    return {
        f"{name}_pairs": f"SELECT {ak}, a.step_id, b.step_id AS other, {d2} AS d2 FROM {rows} a JOIN {rows} b ON {same} WHERE {d2} <= {eps} * {eps}",
        f"{name}_count": f"SELECT {keys}, step_id, count(*) AS neighbours FROM {name}_pairs GROUP BY ALL",
        f"{name}_core": f"SELECT {keys}, step_id AS id FROM {name}_count WHERE neighbours >= 5",
        f"{name}_tocore": f"SELECT p.* FROM {name}_pairs p SEMI JOIN {name}_core c ON p.event_id = c.event_id AND p.other = c.id",
        f"{name}_links": f"SELECT {keys}, step_id AS a, other AS b FROM {name}_tocore p SEMI JOIN {name}_core c ON p.event_id = c.event_id AND p.step_id = c.id WHERE step_id <> other",
        **_components(f"{name}_root", f"{name}_core", f"{name}_links", keys),
        f"{name}_found": f"SELECT p.event_id, p.step_id, min(r.root) AS label FROM {name}_tocore p JOIN {name}_root r ON p.event_id = r.event_id AND p.other = r.id GROUP BY ALL",
    }


def _clue(name: str, dc: float, factor: float | None, rhoc: float, cap: str = "k <= least(rank + 1, 128) AND ") -> dict[str, str]:
    radius = (factor or 5.0) * dc / 5.0
    d2 = "(a.fx - b.fx) * (a.fx - b.fx) + (a.fy - b.fy) * (a.fy - b.fy)"
    same = "a.event_id = b.event_id AND a.subdetector = b.subdetector AND a.layer = b.layer"
    out = f"WHEN rho < {rhoc} AND delta >= {factor * dc / 5.0} THEN 'outlier'" if factor else ""
    return {
        f"{name}_rho": f"SELECT a.event_id, a.subdetector, a.layer, a.step_id, a.fx, a.fy, (count(*) - 1) * CAST(0.5 AS DOUBLE) + 1 AS rho FROM cfeat a JOIN cfeat b ON {same} WHERE {d2} <= CAST({dc / 5.0} AS DOUBLE) * CAST({dc / 5.0} AS DOUBLE) GROUP BY ALL",
        f"{name}_rank": f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY rho DESC, step_id) - 1 AS rank FROM {name}_rho",
        f"{name}_near": f"SELECT a.event_id, a.subdetector, a.layer, a.step_id, a.rank, b.step_id AS other, b.rank AS other_rank, {d2} AS d2, row_number() OVER (PARTITION BY a.event_id, a.subdetector, a.layer, a.step_id ORDER BY {d2}, b.step_id) AS k FROM {name}_rank a JOIN {name}_rank b ON {same} WHERE a.rank > 0 AND {d2} < CAST({radius} AS DOUBLE) * CAST({radius} AS DOUBLE)",
        f"{name}_first": f"SELECT {K}, step_id, arg_min(other, k) AS nh, sqrt(arg_min(d2, k)) AS found FROM {name}_near WHERE {cap}other_rank < rank GROUP BY ALL",
        f"{name}_peak": f"SELECT r.event_id, r.subdetector, r.layer, r.step_id, rho, rank, coalesce(found, max(found) OVER (PARTITION BY r.event_id, r.subdetector, r.layer), {radius}) AS delta, nh FROM {name}_rank r LEFT JOIN {name}_first f ON r.event_id = f.event_id AND r.step_id = f.step_id",
        f"{name}_raw": f"SELECT *, CASE WHEN rho >= {rhoc} AND delta >= {dc / 5.0} THEN 'seed' {out} ELSE 'follower' END AS raw FROM {name}_peak",
        f"{name}_kind": f"SELECT *, CASE WHEN raw <> 'outlier' AND rho * delta > 0 AND sum(CASE WHEN raw = 'seed' THEN 1 ELSE 0 END) OVER (PARTITION BY {K}) = 0 AND row_number() OVER (PARTITION BY {K} ORDER BY CASE WHEN raw = 'outlier' THEN 1 ELSE 0 END, rho * delta DESC, step_id) = 1 THEN 'seed' ELSE raw END AS kind FROM {name}_raw",
        f"{name}_walk": f"SELECT event_id, step_id AS id, step_id AS pos, kind, nh FROM {name}_kind UNION ALL SELECT w.event_id, w.id, k.step_id, k.kind, k.nh FROM {name}_walk w JOIN {name}_kind k ON w.event_id = k.event_id AND w.nh = k.step_id WHERE w.kind = 'follower'",
        f"{name}_found": f"SELECT event_id, id AS step_id, pos AS label FROM {name}_walk WHERE kind = 'seed'",
    }


def _labelled(found: str) -> str:
    return f"SELECT l.*, coalesce(f.label, -1) AS label FROM lay l LEFT JOIN {found} f ON l.event_id = f.event_id AND l.step_id = f.step_id"


def _cloud(labelled: str) -> str:
    return f'SELECT {K}, label, {", ".join(f"{_mean(k)} AS {k}" for k in "xyz")}, sum(energy) AS energy, count(*) AS n_steps, min("time") AS "time" FROM {labelled} WHERE label <> -1 GROUP BY {K}, label'


def _ccl(stage: str, factor: float = 0.6, ratio: float = 0.5, hits: int | None = None, name: str | None = None) -> dict[str, str]:
    name = name or stage
    half = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if stage == "ccl8" else [])
    rows = lambda x: "(VALUES " + ", ".join(f"({a}, {b})" for a, b in x) + ") o(a, b)"
    bridge = f" OR s.hits + t.hits >= {hits}" if hits else ""
    return {
        f"{name}_med": f"SELECT c.*, m.med FROM cells c JOIN (SELECT c.event_id, c.w_layer, c.i, c.j, median(d.energy) AS med FROM cells c, {rows([(0, 0), *half, *((-a, -b) for a, b in half)])} JOIN cells d ON d.event_id = c.event_id AND d.w_layer = c.w_layer AND d.i = c.i + o.a AND d.j = c.j + o.b GROUP BY ALL) m USING (event_id, w_layer, i, j)",
        f"{name}_edge": f"SELECT s.event_id, s.w_layer, s.i, s.j, t.i AS ni, t.j AS nj FROM {name}_med s, {rows(half)} JOIN {name}_med t ON t.event_id = s.event_id AND t.w_layer = s.w_layer AND t.i = s.i + o.a AND t.j = s.j + o.b WHERE (s.energy >= CAST({factor} AS DOUBLE) * greatest(s.med, 1e-12) AND t.energy >= CAST({factor} AS DOUBLE) * greatest(t.med, 1e-12) AND least(s.energy, t.energy) >= CAST({ratio} AS DOUBLE) * greatest(s.energy, t.energy)){bridge}",
        f"{name}_node": "SELECT event_id, w_layer, {'i': i, 'j': j} AS id FROM cells",
        f"{name}_link": f"SELECT event_id, w_layer, {{'i': i, 'j': j}} AS a, {{'i': ni, 'j': nj}} AS b FROM {name}_edge UNION ALL SELECT event_id, w_layer, {{'i': ni, 'j': nj}}, {{'i': i, 'j': j}} FROM {name}_edge",
        **_components(f"{name}_group", f"{name}_node", f"{name}_link", "event_id, w_layer"),
        f"{name}_celled": f"SELECT c.*, g.root.i AS gi, g.root.j AS gj FROM celled c JOIN {name}_group g ON c.event_id = g.event_id AND c.w_layer = g.w_layer AND c.i = g.id.i AND c.j = g.id.j",
        f"{name}_cloud": _grid_cloud(f"{name}_celled"),
    }


def _grid_cloud(source: str) -> str:
    return f'SELECT event_id, w_layer, gi, gj, {", ".join(f"{_mean(k)} AS {k}" for k in "xyz")}, sum(energy) AS energy, min("time") AS "time", count(*) AS n_steps FROM {source} GROUP BY event_id, w_layer, gi, gj'


ZONES = f"{K}, zone"
CTES: dict[str, str] = {
    "steps": STEPS_SQL.format(time='"time"'),
    "ecal": "SELECT * FROM steps WHERE subdetector = 0",
    "lay": "SELECT *, (cell_id >> 19) & 511 AS layer FROM steps",
    "feat": f'SELECT *, x / 5 AS fx, y / 5 AS fy, ("time" - median("time") OVER (PARTITION BY {K})) / 1 AS ft FROM lay QUALIFY count(*) OVER (PARTITION BY {K}) >= 5',
    "cfeat": f"SELECT *, x / 5 AS fx, y / 5 AS fy FROM lay QUALIFY count(*) OVER (PARTITION BY {K}) >= 5",
    **_dbscan("db", "feat", K, "CAST(1.5 AS DOUBLE)"),
    "db_label": _labelled("db_found"),
    "db_cloud": _cloud("db_label"),
    "radii": f"SELECT f.*, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS r FROM feat f JOIN (SELECT {K}, {_mean('x')} AS cx, {_mean('y')} AS cy FROM feat GROUP BY ALL) c USING ({K})",
    "rq_raw": _wq("radii", K, "r", {"rq": 0.68}),
    "rq": f"SELECT {K}, coalesce(rq, 0) AS rq FROM rq_raw",
    "zoned": f"SELECT z.*, CASE WHEN zone = 'core' THEN CAST({1.5 * 1.8} AS DOUBLE) ELSE CAST({1.5 * 0.6} AS DOUBLE) END AS eps FROM (SELECT radii.*, CASE WHEN r <= rq THEN 'core' ELSE 'tail' END AS zone FROM radii JOIN rq USING ({K})) z QUALIFY count(*) OVER (PARTITION BY {ZONES}) >= 5",
    **_dbscan("ad", "zoned", ZONES, "a.eps"),
    "ad_rows": "SELECT z.*, f.label FROM zoned z JOIN ad_found f ON z.event_id = f.event_id AND z.step_id = f.step_id",
    "ad_centre": f"SELECT {ZONES}, label, {', '.join(f'CASE WHEN sum(energy) > 0 THEN sum(energy * {c}) / sum(energy) ELSE sum(energy * {c}) END AS {c}' for c in ('fx', 'fy', 'ft'))} FROM ad_rows GROUP BY ALL",
    "ad_merge": f"SELECT * FROM (SELECT t.event_id, t.label, c.label AS core_label, (t.fx - c.fx) * (t.fx - c.fx) + (t.fy - c.fy) * (t.fy - c.fy) + (t.ft - c.ft) * (t.ft - c.ft) AS d2, row_number() OVER (PARTITION BY t.event_id, t.subdetector, t.layer, t.label ORDER BY (t.fx - c.fx) * (t.fx - c.fx) + (t.fy - c.fy) * (t.fy - c.fy) + (t.ft - c.ft) * (t.ft - c.ft), c.label) AS k FROM ad_centre t JOIN ad_centre c USING ({K}) WHERE t.zone = 'tail' AND c.zone = 'core') WHERE k = 1 AND d2 <= 2.25",
    "ad_final": "SELECT r.event_id, r.step_id, coalesce(CASE WHEN r.zone = 'tail' THEN m.core_label END, r.label) AS label FROM ad_rows r LEFT JOIN ad_merge m ON r.event_id = m.event_id AND r.label = m.label",
    "ad_label": _labelled("ad_final"),
    "ad_cloud": _cloud("ad_label"),
    **_clue("cl", 15.3, None, 5.0),
    "cl_label": _labelled("cl_found"),
    **_clue("co", 5.0, 2.0, 3.0, ""),
    **_clue("cx", 15.3, None, 5.0, ""),
    "cx_label": _labelled("cx_found"),
    "cx_cloud": _cloud("cx_label"),
    "bars": "SELECT event_id, quantile_cont(energy, 0.7) AS bar, count(*) AS n FROM ecal GROUP BY event_id",
    "hot": "SELECT e.* FROM ecal e JOIN bars b ON e.event_id = b.event_id WHERE n < 5 OR energy >= bar",
    "frame": _axis("hot"),
    "proj": _project("ecal", "(SELECT event_id, cx, cy, cz, ax, ay, az FROM frame)"),
    "width": """SELECT event_id, raw_width, coalesce(least(greatest(raw_width, CAST(2 AS DOUBLE)), CAST(10 AS DOUBLE)), CAST(2 AS DOUBLE)) AS w_width FROM (SELECT event_id, CASE WHEN n > 1 AND s > 0 THEN s * 2 * pow(CAST(n AS DOUBLE), CAST(-1 AS DOUBLE) / 3) END AS raw_width
 FROM (SELECT event_id, count(*) AS n, CASE WHEN quantile_cont(w, 0.75) > quantile_cont(w, 0.25) THEN quantile_cont(w, 0.75) - quantile_cont(w, 0.25) ELSE stddev_pop(w) END AS s FROM proj GROUP BY event_id))""",
    "celled": "SELECT p.*, w_width, CAST(floor(w / w_width + 0.5) AS BIGINT) AS w_layer, CAST(floor(u / 3 + 0.5) AS BIGINT) AS i, CAST(floor(v / 3 + 0.5) AS BIGINT) AS j FROM proj p JOIN width USING (event_id)",
    "cells": "SELECT event_id, w_layer, i, j, sum(energy) AS energy, count(*) AS hits FROM celled GROUP BY ALL",
    "none_celled": "SELECT *, i AS gi, j AS gj FROM celled",
    "none_cloud": _grid_cloud("none_celled"),
    **_ccl("ccl4"),
    **_ccl("ccl8"),
    **_ccl("ccl4", hits=6, name="gate"),
    "sides": "SELECT 'before' AS side, event_id, step_id, x, y, z, energy FROM ecal UNION ALL SELECT 'after', event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY w_layer, gi, gj) AS BIGINT), x, y, z, energy FROM none_cloud",
    "first_axis": _axis("ecal"),
    "along": "SELECT e.event_id, x, y, z, energy, n, (x - cx) * ax + (y - cy) * ay + (z - cz) * az AS l FROM ecal e JOIN first_axis f ON e.event_id = f.event_id",
    "trim": "SELECT a.event_id, x, y, z, energy FROM along a JOIN (SELECT event_id, quantile_cont(l, 0.1) AS p0, quantile_cont(l, 0.99) AS p1 FROM along GROUP BY event_id) p ON a.event_id = p.event_id WHERE n >= 10 AND l >= p0 AND l <= p1",
    "second_axis": _axis("trim"),
    "refined": f"SELECT f.event_id, {', '.join(f'CASE WHEN s.n >= 2 THEN s.{p}{k} ELSE f.{p}{k} END AS {p}{k}' for p in 'ca' for k in 'xyz')} FROM first_axis f LEFT JOIN second_axis s ON f.event_id = s.event_id",
    "cyl0": _project("sides", "refined"),
    "cyl1": "SELECT *, w AS long, sqrt(u * u + v * v) AS r, u * e1x + v * e2x AS tx, u * e1y + v * e2y AS ty, u * e1z + v * e2z AS tz, (1 - ax * ax) / rn AS fx, (0 - ay * ax) / rn AS fy, (0 - az * ax) / rn AS fz FROM (SELECT *, CASE WHEN rn0 > 1e-9 THEN rn0 ELSE 1 END AS rn FROM (SELECT *, sqrt((1 - ax * ax) * (1 - ax * ax) + ay * ax * ay * ax + az * ax * az * ax) AS rn0 FROM cyl0))",
    "cyl": f"SELECT side, event_id, step_id, energy, {_settled('long')} AS long, {_settled('r')} AS r, {_settled('atan2((fy * tz - fz * ty) * ax + (fz * tx - fx * tz) * ay + (fx * ty - fy * tx) * az, tx * fx + ty * fy + tz * fz)')} AS phi FROM cyl1",
    "phi0": "SELECT event_id, CASE WHEN sum(energy) > 0 THEN atan2(sum(energy * sin(phi)), sum(energy * cos(phi))) ELSE 0 END AS centre FROM cyl WHERE side = 'before' GROUP BY event_id",
    "cent": f"SELECT c.* EXCLUDE (phi), {_settled('a - floor(a / (2 * pi())) * (2 * pi()) - pi()')} AS phi FROM (SELECT c.*, phi - centre + pi() AS a FROM cyl c JOIN phi0 p ON c.event_id = p.event_id) c",
    "bounds": f"SELECT event_id, {', '.join(f"{_settled(f'quantile_cont({c}, {q})')} AS {c}_{n}" for c in ('long', 'r', 'phi') for n, q in (('lo', 0.01), ('hi', 0.99)))} FROM cent WHERE side = 'before' GROUP BY event_id",
    "flagged": f"SELECT c.side, c.event_id, step_id, energy, long, r, phi, {' AND '.join(f'{c} >= {c}_lo AND {c} <= {c}_hi' for c in ('long', 'r', 'phi'))} AS kept FROM cent c JOIN bounds b ON c.event_id = b.event_id",
    "kept": "SELECT side, event_id, step_id, energy, r, phi, long - coalesce(min(CASE WHEN side = 'before' THEN long END) OVER (PARTITION BY event_id), 0) AS long FROM flagged WHERE kept",
    "lims": f"SELECT event_id, {', '.join(f'''coalesce({f}(CASE WHEN side = 'before' THEN {c} END), {d}) AS {c}_{n}''' for c in ('long', 'r') for n, f, d in (('a', 'min', 0), ('b', 'max', 1)))} FROM kept GROUP BY event_id",
    "hist0": f"SELECT event_id, side, 'long' AS observable, {_bin('long', 'long_a', 'long_b', 30)} AS bin, energy AS w FROM kept JOIN lims USING (event_id) UNION ALL SELECT event_id, side, 'r', {_bin('r', 'r_a', 'r_b', 50)}, energy FROM kept JOIN lims USING (event_id) UNION ALL SELECT event_id, side, 'log_energy', {_bin('log10(energy + 1e-12)', 'CAST(-8 AS DOUBLE)', 'CAST(2 AS DOUBLE)', 50)}, 1 FROM kept",
    "hist": "SELECT event_id, side, observable, bin, sum(w) AS value FROM hist0 WHERE bin IS NOT NULL GROUP BY ALL",
    "shares": "SELECT h.side, h.observable, bin, value / CASE WHEN h.observable = 'log_energy' THEN CAST(objects AS DOUBLE) WHEN in_range > 0 THEN in_range WHEN own > 0 THEN own ELSE 1 END AS share FROM hist h JOIN (SELECT event_id, side, observable, sum(value) AS own FROM hist GROUP BY ALL) o USING (event_id, side, observable) JOIN (SELECT event_id, side, count(*) AS objects FROM kept GROUP BY ALL) n USING (event_id, side) LEFT JOIN (SELECT event_id, side, sum(value) AS in_range FROM hist WHERE observable = 'long' GROUP BY ALL) i USING (event_id, side)",
    "dense": "SELECT * FROM (VALUES ('before'), ('after')) s(side), (SELECT 'long' AS observable, range AS bin FROM range(30) UNION ALL SELECT 'r', range FROM range(50) UNION ALL SELECT 'log_energy', range FROM range(50)) b",
    "avgp": "SELECT d.side, d.observable, d.bin, coalesce(s / (SELECT count(DISTINCT event_id) FROM kept), 0) AS value FROM dense d LEFT JOIN (SELECT side, observable, bin, sum(share) AS s FROM shares GROUP BY ALL) t USING (side, observable, bin)",
    "mom": "SELECT event_id, side, " + ", ".join(f"CASE WHEN sum(energy) > 0 THEN sum(energy * ({v})) / sum(energy) ELSE 0 END AS {n}" for n, v in (("m1l", "long"), ("m2l", "long * long"), ("m1r", "r"), ("m2r", "r * r"))) + " FROM kept GROUP BY ALL",
    "moml": "SELECT side, observable, v FROM mom UNPIVOT (v FOR observable IN (m1l, m2l, m1r, m2r))",
    "momlim": "SELECT observable, a - (b - a) * 0.05 AS a, b + (b - a) * 0.05 AS b FROM (SELECT observable, min(v) - CASE WHEN min(v) = max(v) THEN 1e-6 ELSE 0 END AS a, max(v) + CASE WHEN min(v) = max(v) THEN 1e-6 ELSE 0 END AS b FROM moml GROUP BY observable)",
    "momhist": f"SELECT observable, side, bin, k * 40 / (sum(k) OVER (PARTITION BY observable, side) * (b - a)) AS density FROM (SELECT observable, side, {_bin('v', 'a', 'b', 40)} AS bin, a, b, CAST(count(*) AS DOUBLE) AS k FROM moml JOIN momlim USING (observable) GROUP BY ALL)",
    "cont_r": _wq("kept", "event_id, side", "r", {"r50": 0.5, "r80": 0.8, "r90": 0.9}),
    "cont_w": _wq("kept", "event_id, side", "long", {"w10": 0.1, "w50": 0.5, "w90": 0.9}),
    "cont": "SELECT * FROM cont_r JOIN cont_w USING (event_id, side)",
    "contl": "SELECT side, observable, v FROM cont UNPIVOT (v FOR observable IN (r50, r80, r90, w10, w50, w90))",
    "closure": "SELECT event_id, a / b AS closure FROM (SELECT event_id, sum(CASE WHEN side = 'before' THEN energy END) AS b, sum(CASE WHEN side = 'after' THEN energy END) AS a FROM sides GROUP BY event_id) WHERE b > 0",
    "viewed": "SELECT * FROM sides WHERE event_id = (SELECT min(event_id) FROM sides)",
    "viewl": "SELECT step_id + CASE WHEN side = 'after' THEN 1000000000 ELSE 0 END AS step_id, energy, axis, v FROM viewed UNPIVOT (v FOR axis IN (x, y, z))",
    "viewq": _wq("viewl", "axis", "v", {"lo": 0.02, "hi": 0.98}),
    "view0": "SELECT axis, CASE WHEN flat THEN a ELSE lo END - CASE WHEN flat AND a = b THEN 1 ELSE 0 END AS lo, CASE WHEN flat THEN b ELSE hi END + CASE WHEN flat AND a = b THEN 1 ELSE 0 END AS hi FROM (SELECT q.*, a, b, lo IS NULL OR hi IS NULL OR lo = hi AS flat FROM viewq q JOIN (SELECT axis, min(v) AS a, max(v) AS b FROM viewl GROUP BY axis) m USING (axis))",
    "view": "SELECT *, floor(lo / dtick) * dtick AS tick0 FROM (SELECT *, CASE WHEN hi <= lo THEN 1 WHEN base >= raw THEN base WHEN base * 2 >= raw THEN base * 2 WHEN base * 5 >= raw THEN base * 5 ELSE base * 10 END AS dtick FROM (SELECT *, pow(CAST(10 AS DOUBLE), floor(log10(raw))) AS base FROM (SELECT *, (hi - lo) / 6 AS raw FROM (SELECT axis, lo - (hi - lo) * 0.08 AS lo, hi + (hi - lo) * 0.08 AS hi FROM view0))))",
}


def _compared(prefix: str, label: str) -> None:
    """The validation's relations once more, with a cluster cloud of the barrel as the other side."""
    chain = ["sides", "cyl0", "cyl1", "cyl", "phi0", "cent", "bounds", "flagged", "kept", "cont_r", "cont_w", "cont", "contl", "closure"]
    cloud = f"(SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY layer, label) AS step_id, x, y, z, energy FROM ({_cloud(f'(SELECT * FROM {label} WHERE subdetector = 0)')}))"
    sides = f"SELECT 'before' AS side, event_id, step_id, x, y, z, energy FROM ecal WHERE event_id IN (SELECT event_id FROM {cloud}) UNION ALL SELECT 'after', event_id, CAST(step_id AS BIGINT), x, y, z, energy FROM {cloud}"
    for name in chain:
        sql = sides if name == "sides" else CTES[name]
        for other in chain:
            sql = re.sub(rf"\b(FROM|JOIN)\s+{other}\b", rf"\1 {prefix}_{other}", sql)
        CTES[f"{prefix}_{name}"] = sql


_compared("vd", "db_label")
_compared("vc", "cl_label")
_compared("vx", "cx_label")


def with_ctes(final: str) -> str:
    """final behind the expressions that it needs, in order."""
    needed: list[str] = []

    def need(sql: str, own: str = "") -> None:
        for word in re.findall(r"\b\w+\b", sql):
            if word in CTES and word != own and word not in needed and re.search(rf"(FROM|JOIN|,)\s+{word}\b", sql):
                need(CTES[word], word)
                if word not in needed:
                    needed.append(word)

    need(final)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n.endswith(('_reach', '_walk')) else 'MATERIALIZED '}({CTES[n]})" for n in needed) + "\n" + final
