"""The station views once more as portable SQL, for the check queries."""

from __future__ import annotations


def obs_sql(id_column: str = "l_suppkey", zero: int = 5) -> str:
    return f"""SELECT {id_column} AS ID, CAST(l_shipdate AS DATE) AS DATE,
  CASE WHEN l_returnflag = 'A' THEN 'WESD' ELSE 'SNWD' END AS ELEMENT,
  CASE WHEN l_quantity <= {zero} THEN CAST(0 AS DOUBLE)
       WHEN l_orderkey % 499 = 0 THEN l_quantity * 100 ELSE l_quantity END AS VALUE,
  CASE WHEN l_discount >= 0.095 THEN 'P' WHEN l_discount >= 0.085 THEN 'T' ELSE NULL END AS MFLAG,
  CASE WHEN l_tax >= 0.075 THEN 'G' WHEN l_tax < 0.005 THEN NULL
       WHEN l_tax < 0.015 THEN ' ' ELSE '' END AS QFLAG,
  l_linestatus AS SFLAG,
  l_orderkey AS k_order, l_linenumber AS k_line, l_partkey AS k_part, l_suppkey AS k_supp
FROM lineitem"""


STATIONS = """SELECT s_suppkey AS ID,
  CAST(30 + (s_suppkey * 53 % 200) / CAST(10 AS DOUBLE) AS DOUBLE) AS LATITUDE,
  CAST(-125 + (s_suppkey * 37 % 600) / CAST(10 AS DOUBLE) AS DOUBLE) AS LONGITUDE,
  CAST(s_suppkey * 97 % 3000 AS DOUBLE) AS ELEVATION,
  n_name AS STATE, s_name AS NAME,
  CONCAT(n_regionkey + 1, '.', n_nationkey % 3 + 1, '.', n_nationkey % 15 + 1) AS ECO3,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(40 + n_nationkey % 10 AS DOUBLE) END AS STATE_MAX,
  CONCAT('C', s_suppkey % 4) AS COUNTY
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

COUNTY = """SELECT n_name AS STATE, CONCAT('C', c.i) AS COUNTY, d.DAYS, CAST(20 + 2 * d.DAYS AS DOUBLE) AS COUNTY_MAX
FROM nation
CROSS JOIN (VALUES (0),(1),(2),(3)) c(i)
CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) d(DAYS)"""

# Four rectangles that serve as regions (id, x0, y0, x1, y1).
RECTANGLES = [("A", -125.0, 30.0, -105.0, 40.0), ("B", -105.0, 30.0, -85.0, 40.0),
              ("C", -85.0, 30.0, -65.0, 50.0), ("D", -120.0, 41.0, -95.0, 48.0)]

REGIONS = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({d} AS DOUBLE))"
    for r, a, b, c, d in RECTANGLES) + ") t(region_id, x0, y0, x1, y1)"

BASE = {"obs": obs_sql(), "obs_sparse": obs_sql("l_partkey", 25), "stations": STATIONS,
        "county_maxes": COUNTY, "regions": REGIONS}


def wy(date: str = "DATE") -> str:
    return f"(year({date}) + CASE WHEN month({date}) > 9 THEN 1 ELSE 0 END)"


def with_views(body: str, *views: str, **extra: str) -> str:
    """``body`` behind a WITH list of the named base views and any extra ones."""
    parts = [f"{v} AS ({BASE[v]})" for v in views] + [f"{k} AS ({q})" for k, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


ROW_RULES = """(MFLAG IS NULL OR MFLAG <> 'P') AND (QFLAG IS NULL OR QFLAG IN ('', ' '))
  AND month(DATE) NOT IN (7, 8, 9)"""


# --- numeric helpers as SQL text ----------------------------------------------------

def qnorm_sql(p: str) -> str:
    """Normal quantile of a SQL expression strictly between 0 and 1."""
    from firnline.functions import extremes as e

    def _poly(coefficients, x):
        return e.polynomial_text(coefficients, x, "")

    q = f"({p} - 0.5)"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    c = f"(0.180625 - {q} * {q})"
    centre = f"{q} * {_poly(e.AS241_CENTRE_NUM, c)} / {_poly(e.AS241_CENTRE_DEN, c)}"
    t, f = f"({r} - 1.6)", f"({r} - 5.0)"
    tail = f"{_poly(e.AS241_TAIL_NUM, t)} / {_poly(e.AS241_TAIL_DEN, t)}"
    far = f"{_poly(e.AS241_FAR_NUM, f)} / {_poly(e.AS241_FAR_DEN, f)}"
    return (f"CASE WHEN abs{q} <= 0.425 THEN {centre} ELSE sign{q} * "
            f"CASE WHEN {r} <= 5 THEN {tail} ELSE {far} END END")


def newton_chain(start: str, step: str, rounds: int, prefix: str) -> dict[str, str]:
    """CTEs ``<prefix>0`` .. ``<prefix>N``; ``step`` has the placeholder {prev}."""
    out = {f"{prefix}0": start}
    for i in range(rounds):
        out[f"{prefix}{i + 1}"] = step.format(prev=f"{prefix}{i}")
    return out


def tilt_sql(source: str, rounds: int = 25, prefix: str = "tk") -> dict[str, str]:
    """k and log_scale per G of rows (G, y); the last CTE is ``<prefix>_fit``."""
    base = f"""SELECT G, max(y) AS top, avg(y) AS mean, 1.2825498301618641 / stddev_pop(y) AS k
        FROM {source} GROUP BY G HAVING max(y) > min(y)"""
    step = f"""SELECT G, top, mean, least(greatest(k - (s1 / s0 - (mean - top) - 1 / k)
            / (s2 / s0 - (s1 / s0) * (s1 / s0) + 1 / (k * k)), k / 4), k * 4) AS k FROM (
          SELECT G, top, mean, k, sum(exp(k * (y - top))) AS s0, sum((y - top) * exp(k * (y - top))) AS s1,
            sum((y - top) * (y - top) * exp(k * (y - top))) AS s2
          FROM {{prev}} JOIN {source} USING (G) GROUP BY G, top, mean, k)"""
    out = newton_chain(base, step, rounds, prefix)
    out[f"{prefix}_fit"] = f"""SELECT G, k, top + ln(avg(exp(k * (y - top)))) / k AS log_scale
        FROM {prefix}{rounds} JOIN {source} USING (G) GROUP BY G, top, k"""
    return out


def digamma_sql(x: str) -> str:
    z = f"({x} + 8)"
    r = f"(1 / ({z} * {z}))"
    series = f"{r} * (1.0/12 - {r} * (1.0/120 - {r} * (1.0/252 - {r} * (1.0/240 - {r} / 132))))"
    shift = " + ".join(f"1 / ({x} + {i})" for i in range(8))
    return f"(ln{z} - 0.5 / {z} - {series} - ({shift}))"


def trigamma_sql(x: str) -> str:
    z = f"({x} + 8)"
    r = f"(1 / ({z} * {z}))"
    series = f"{r} / {z} * (1.0/6 - {r} * (1.0/30 - {r} * (1.0/42 - {r} / 30)))"
    shift = " + ".join(f"1 / (({x} + {i}) * ({x} + {i}))" for i in range(8))
    return f"(1 / {z} + {r} / 2 + {series} + {shift})"


def gamma_shape_sql(source: str, rounds: int = 15, prefix: str = "gk") -> dict[str, str]:
    """Shape per G of rows (G, m, ml): mean and mean log."""
    base = f"""SELECT G, ln(m) - ml AS s, (3 - (ln(m) - ml) + sqrt(pow(ln(m) - ml - 3, 2) + 24 * (ln(m) - ml)))
        / (12 * (ln(m) - ml)) AS k FROM {source}"""
    step = (f"SELECT G, s, k - (ln(k) - {digamma_sql('k')} - s) / (1 / k - {trigamma_sql('k')}) AS k FROM {{prev}}")
    return newton_chain(base, step, rounds, prefix)


def gamma_quantile_sql(source: str, rounds: int = 10, prefix: str = "gq") -> dict[str, str]:
    """x per G of rows (G, p, a): unit-rate gamma quantile, Newton on the power series.

    The last CTE is ``<prefix>_fit``. The start is the cube of a normal.
    """
    cdf = ("exp(a * ln(x) - x - lgamma(a + 1)) * list_sum(list_transform(range(0, 2500), "
           "lambda n: exp(n * ln(x) + lgamma(a + 1) - lgamma(a + n + 1))))")
    start = f"pow(greatest(1 - 1 / (9 * a) + ({qnorm_sql('p')}) / (3 * sqrt(a)), 0.01), 3) * a"
    base = f"SELECT G, p, a, {start} AS x FROM {source}"
    step = f"""SELECT G, p, a, greatest(x - ({cdf} - p) / exp((a - 1) * ln(x) - x - lgamma(a)), x / 4) AS x FROM {{prev}}"""
    out = newton_chain(base, step, rounds, prefix)
    out[f"{prefix}_fit"] = f"SELECT * FROM {prefix}{rounds}"
    return out


# --- geometry as SQL text ------------------------------------------------------------

def vector_sql(prefix: str, lon: str, lat: str) -> str:
    return (f"cos(radians({lat})) * cos(radians({lon})) AS {prefix}x, "
            f"cos(radians({lat})) * sin(radians({lon})) AS {prefix}y, sin(radians({lat})) AS {prefix}z")


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = 6378.388) -> str:
    return (f"2 * {radius} * asin(least(1, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1}))"
            f" * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))")


RECTANGLE_EDGES = """SELECT region_id, x0 AS x1, y0 AS y1, x1 AS x2, y0 AS y2 FROM regions
UNION ALL SELECT region_id, x1, y0, x1, y1 FROM regions
UNION ALL SELECT region_id, x1, y1, x0, y1 FROM regions
UNION ALL SELECT region_id, x0, y1, x0, y0 FROM regions"""


def sphere_distance_ctes(points: str, edges: str, key: str, radius: float = 6371.01,
                         on: str = "true", group: str = "region_id", extra: str = "") -> dict[str, str]:
    """CTE ``near`` (key, group, km): great circle distance to the nearest edge of each group.

    Cross-track form in angles: bearings decide whether the foot lies on the edge.
    """
    return {
        "pv": f"SELECT *, {vector_sql('p', 'LONGITUDE', 'LATITUDE')} FROM {points}",
        "ev": f"SELECT *, {vector_sql('s', 'x1', 'y1')}, {vector_sql('f', 'x2', 'y2')} FROM {edges}",
        "en": """SELECT *, sy * fz - sz * fy AS nx, sz * fx - sx * fz AS ny, sx * fy - sy * fx AS nz FROM ev""",
        "legs": f"""SELECT pv.{key}, en.{group}{extra}, px * nx + py * ny + pz * nz AS pn, sqrt(nx * nx + ny * ny + nz * nz) AS nn,
            (ny * sz - nz * sy) * px + (nz * sx - nx * sz) * py + (nx * sy - ny * sx) * pz AS past_a,
            (fy * nz - fz * ny) * px + (fz * nx - fx * nz) * py + (fx * ny - fy * nx) * pz AS before_b,
            2 * asin(least(1, sqrt(pow(px - sx, 2) + pow(py - sy, 2) + pow(pz - sz, 2)) / 2)) AS da,
            2 * asin(least(1, sqrt(pow(px - fx, 2) + pow(py - fy, 2) + pow(pz - fz, 2)) / 2)) AS db
            FROM pv JOIN en ON {on}""",
        "near": f"""SELECT {key}, {group}, {radius} * min(CASE WHEN nn > 1e-15 AND past_a > 0 AND before_b > 0
            THEN asin(least(1, abs(pn) / nn)) ELSE least(da, db) END) AS km FROM legs GROUP BY {key}, {group}""",
    }


IN_RECTANGLE = "LONGITUDE >= x0 AND LONGITUDE < x1 AND LATITUDE >= y0 AND LATITUDE < y1"

PLACES = """SELECT c_custkey AS ID, CAST(-125 + (c_custkey * 37 % 6007) / CAST(100 AS DOUBLE) AS DOUBLE) AS LONGITUDE,
  CAST(30 + (c_custkey * 53 % 2003) / CAST(100 AS DOUBLE) AS DOUBLE) AS LATITUDE,
  CAST(c_custkey * 89 % 3001 AS DOUBLE) AS ELEVATION, c_acctbal AS VALUE FROM customer"""

GRID = """SELECT CAST(floor(p_partkey / n) AS BIGINT) AS row, CAST(p_partkey % n AS BIGINT) AS col,
  -125 + (p_partkey % n) * (CAST(60 AS DOUBLE) / (n - 1)) AS x, 30 + floor(p_partkey / n) * (CAST(20 AS DOUBLE) / (n - 1)) AS y,
  CASE WHEN p_size >= 6 THEN p_retailprice END AS PPTWT, CAST(p_size AS DOUBLE) AS TD, CAST(p_size - 10 AS DOUBLE) AS MAT
  FROM part, (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS n FROM part) g"""
GRID_SPEC = """SELECT -125.0 AS gx, 30.0 AS gy, CAST(60 AS DOUBLE) / (n - 1) AS dx, CAST(20 AS DOUBLE) / (n - 1) AS dy
  FROM (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS n FROM part)"""
BASE.update({"places": PLACES, "grid": GRID, "spec": GRID_SPEC, "edges": RECTANGLE_EDGES})


# --- linkage as SQL text -----------------------------------------------------------------

def linkage_ctes(method: str, dist_adj: float, elev_adj: float, h: float, source: str, group: str = "''") -> dict[str, str]:
    """CTE ``clustered`` (G, ID, CLUST): one merge after the other in every component of the pairs up to ``h``.

    The linkage of two clusters is taken from all pairs of their members anew in each step, the nearest pair merges,
    ties by name. For WITH RECURSIVE; ``source`` has ID, LONGITUDE, LATITUDE and ELEVATION.
    """
    gap = (f"{haversine_sql('a.LONGITUDE', 'a.LATITUDE', 'b.LONGITUDE', 'b.LATITUDE')} / {dist_adj}"
           f" + abs(a.ELEVATION - b.ELEVATION) / {elev_adj}")
    squared = method == "ward.D2"
    top = h * h if squared else h
    delta = "d * d" if squared else "d"
    linkage = {"complete": "max(d)", "average": "sum(x.n * y.n * d) / sum(x.n * y.n)", "mcquitty": "sum(x.w * y.w * d)"}.get(method)
    cur = "SELECT x.root, x.cluster AS u, y.cluster AS v, {} AS l FROM agg x JOIN agg y ON x.root = y.root JOIN apart ON apart.u = x.node AND apart.v = y.node"
    if linkage:
        found = cur.format(linkage) + " WHERE x.cluster < y.cluster GROUP BY ALL"
    else:
        cross = cur.format(f"sum(x.n * y.n * {delta})") + " GROUP BY ALL"
        found = f"""SELECT c.root, c.u, c.v, 2 * a.k * b.k / (a.k + b.k) * (c.l / (a.k * b.k) - coalesce(s.l, 0) / (2 * a.k * a.k) - coalesce(t.l, 0) / (2 * b.k * b.k)) AS l
          FROM ({cross}) c JOIN (SELECT cluster, sum(n) AS k FROM agg GROUP BY cluster) a ON a.cluster = c.u
          JOIN (SELECT cluster, sum(n) AS k FROM agg GROUP BY cluster) b ON b.cluster = c.v
          LEFT JOIN ({cross}) s ON s.u = c.u AND s.v = c.u LEFT JOIN ({cross}) t ON t.u = c.v AND t.v = c.v WHERE c.u < c.v"""
    return {
        "nodes": f"""SELECT {group} AS G, LONGITUDE, LATITUDE, ELEVATION, min(ID) AS node, CAST(count(*) AS DOUBLE) AS n
          FROM {source} GROUP BY ALL""",
        "link": f"SELECT a.node AS u, b.node AS v FROM nodes a JOIN nodes b ON a.G IS NOT DISTINCT FROM b.G AND a.node <> b.node AND {gap} <= {h}",
        "reach(node, low)": """SELECT node, node FROM nodes UNION SELECT link.v, reach.low FROM reach JOIN link ON link.u = reach.node
          WHERE reach.low < link.v""",
        "part": "SELECT node, min(low) AS root FROM reach GROUP BY node",
        "apart": f"""SELECT a.node AS u, b.node AS v, {gap} AS d FROM nodes a JOIN part p ON p.node = a.node JOIN part q ON q.root = p.root
          JOIN nodes b ON b.node = q.node AND b.node <> a.node""",
        "agg(step, root, cluster, node, n, w)": f"""SELECT 0, root, node, node, n, CAST(1 AS DOUBLE) FROM nodes JOIN part USING (node) UNION ALL
          SELECT step + 1, agg.root, CASE WHEN cluster = best.m.v THEN best.m.u ELSE cluster END, node, n,
            CASE WHEN cluster IN (best.m.u, best.m.v) THEN w / 2 ELSE w END
          FROM agg JOIN (SELECT root, min(struct_pack(l := l, u := u, v := v)) AS m FROM ({found}) WHERE l <= {top} GROUP BY root) best
          ON best.root = agg.root""",
        "last": "SELECT node, first(cluster ORDER BY step DESC) AS cluster FROM agg GROUP BY node",
        "clustered": f"""SELECT s.G, s.ID, dense_rank() OVER (PARTITION BY s.G ORDER BY low) AS CLUST FROM (SELECT {group} AS G, * FROM {source}) s
          JOIN nodes k ON k.G IS NOT DISTINCT FROM s.G AND k.LONGITUDE = s.LONGITUDE AND k.LATITUDE = s.LATITUDE AND k.ELEVATION = s.ELEVATION
          JOIN last USING (node) JOIN (SELECT cluster, min(node) AS low FROM last GROUP BY cluster) USING (cluster)""",
    }


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)
