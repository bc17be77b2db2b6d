"""SQL twins of the named queries: plain, unbucketed forms of the same questions."""

from __future__ import annotations

from habitat.config import ENV_VARS, LAND_COVER

MODELS = ["m1", "m2", "m3", "m4"]
BLOCKS = {n: [(i * (64 // n), 64 if i == n - 1 else (i + 1) * (64 // n)) for i in range(n)] for n in (9, 4)}
COVER = sorted(LAND_COVER.values())
WEIGHTS = [0.5, -1.0, 0.25, 2.0, -0.75, 1.5, -0.1, 0.3, 1.0]


def d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def lat(k: str) -> str:
    return f"({d(50.0)} + (({k}) * 7919 % 100003) / {d(100003.0)})"


def lon(k: str) -> str:
    return f"({d(-3.0)} + (({k}) * 104729 % 100003) / {d(100003.0)})"


def px(k: str) -> str:
    return f"((({k}) * 104729 % 100003) / {d(100003.0)} * {d(100000.0)})"


def py(k: str) -> str:
    return f"((({k}) * 7919 % 100003) / {d(100003.0)} * {d(100000.0)})"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (
        f"sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2)"
    )
    return f"({d(12742.0)} * asin(sqrt(least({d(1.0)}, {h}))))"


def cover(code: str) -> str:
    cases = " ".join(f"WHEN {c} THEN '{n}'" for c, n in LAND_COVER.items())
    return f"CASE {code} {cases} ELSE 'Unknown' END"


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


RAW = f"""
SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 'PRESENT' ELSE 'ABSENT' END AS status,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS "eventDate",
       year(o_orderdate) AS y, o_orderpriority AS species,
       CASE WHEN o_totalprice >= 20000 THEN {lat('o_orderkey')} END AS "decimalLatitude",
       {lon('o_orderkey')} AS "decimalLongitude"
FROM orders"""

RECORDS = f"""
SELECT o_orderkey AS row_id, o_orderstatus AS status, {lat('o_orderkey')} AS la, {lon('o_orderkey')} AS lo, CAST(o_orderdate AS DATE) AS dt
FROM orders"""

COVARIATES = f"""
SELECT l_returnflag AS cov, {lat('l_partkey')} AS la, {lon('l_partkey')} AS lo, CAST(l_shipdate AS DATE) AS dt FROM lineitem"""

CLEAN = f"""
SELECT row_id, species, "decimalLatitude", "decimalLongitude", "eventDate" FROM ({RAW})
WHERE status = 'PRESENT' AND "decimalLatitude" IS NOT NULL AND "eventDate" IS NOT NULL"""

def block_mean(i: int, blocks: int) -> str:
    """Mean of the ``i``-th of ``blocks`` equal parts of an embedding, the last part taking the rest."""
    start, end = BLOCKS[blocks][i]
    return "(" + " + ".join(f"CAST(embedding[{k + 1}] AS DOUBLE)" for k in range(start, end)) + f") / {d(float(end - start))}"


FEATURES = (
    "SELECT vec_id AS row_id, CASE WHEN label < 3 THEN 1 ELSE 0 END AS label, "
    + ", ".join(f'{block_mean(i, len(ENV_VARS))} AS "{c}"' for i, c in enumerate(ENV_VARS))
    + " FROM embeddings"
)

SCORES = (
    "SELECT vec_id AS row_id, CASE WHEN label < 3 THEN 1 ELSE 0 END AS label, "
    + ", ".join(
        f"round({d(1.0)} / ({d(1.0)} + exp({block_mean(i, len(MODELS))} * {d(-20.0)})), 6) AS {m}" for i, m in enumerate(MODELS)
    )
    + " FROM embeddings"
)

LONG_SCORES = " UNION ALL ".join(f"SELECT row_id, '{m}' AS model, {m} AS p FROM ({SCORES})" for m in MODELS)

TEST_ROW = "CAST('0x' || substr(md5('42:' || CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < CAST(0.2 AS DOUBLE)"

INDICES = {
    "NDVI": "(b8 - b4) / nullif(b8 + b4, 0)",
    "NDWI": "(b3 - b8) / nullif(b3 + b8, 0)",
    "NDBI": "(b11 - b8) / nullif(b11 + b8, 0)",
    "SAVI": f"(b8 - b4) / nullif(b8 + b4 + {d(0.5)}, 0) * {d(1.5)}",
    "MNDWI": "(b3 - b11) / nullif(b3 + b11, 0)",
    "NDSI": "(b3 - b11) / nullif(b3 + b11, 0)",
    "BSI": "((b4 + b2) - (b8 + b11)) / nullif(b4 + b2 + b8 + b11, 0)",
    "UI": "(b8 - b11) / nullif(b8 + b11, 0)",
}
PRIMES = {"b2": 7919, "b3": 104729, "b4": 1299709, "b8": 15485863, "b11": 32452843}


def bands(k: str) -> str:
    return ", ".join(f"CAST({k} * {p} % 1000 + 1 AS DOUBLE) AS {b}" for b, p in PRIMES.items())


def aoi(values: dict[str, str], after: dict[str, str] | None) -> str:
    """Means over a 10 km box among the pixels of the record's scene."""
    half = d(10.0 / 111.32 / 2)
    mean = ", ".join(f'avg({v}) AS "{k}"' for k, v in values.items())
    final = rounded(list(INDICES)) if after is None else ", ".join(f'{v} AS "{k}"' for k, v in after.items())
    return f"""
WITH boxes AS (SELECT DISTINCT l_suppkey AS scene, l_partkey AS k, {lat('l_partkey')} AS la, {lon('l_partkey')} AS lo FROM lineitem),
pixels AS (SELECT l_suppkey AS scene, {lat('l_orderkey')} AS pla, {lon('l_orderkey')} AS plo, {bands('l_partkey')} FROM lineitem),
means AS (
  SELECT b.scene, b.k, {mean} FROM boxes b JOIN pixels p ON p.scene = b.scene
   AND pla BETWEEN la - {half} AND la + {half} AND plo BETWEEN lo - {half} AND lo + {half} GROUP BY b.scene, b.k)
SELECT l_orderkey, l_linenumber, {final}
FROM lineitem LEFT JOIN means ON means.scene = l_suppkey AND means.k = l_partkey"""


def flags(radius_rows: str, names: list[str]) -> str:
    """Brute-force join of records and covariates of the same month."""
    out = ", ".join(f'CAST(coalesce(max(CASE WHEN c.cov = \'{n}\' THEN 1 END), 0) AS INTEGER) AS "{n}_presence"' for n in names)
    near = haversine("r.la", "r.lo", "c.la", "c.lo")
    return f"""
SELECT r.row_id, {out} FROM ({radius_rows}) r LEFT JOIN ({COVARIATES}) c
 ON year(r.dt) = year(c.dt) AND month(r.dt) = month(c.dt) AND {near} <= {d(1.0)} GROUP BY r.row_id"""


EDGES = f"""
SELECT poly_id, unnest([{{'x1': cx + q, 'y1': cy, 'x2': cx, 'y2': cy + q}}, {{'x1': cx, 'y1': cy + q, 'x2': cx - q, 'y2': cy}},
                        {{'x1': cx - q, 'y1': cy, 'x2': cx, 'y2': cy - q}}, {{'x1': cx, 'y1': cy - q, 'x2': cx + q, 'y2': cy}}], recursive := true)
FROM (SELECT n_name AS poly_id, {px('n_nationkey')} AS cx, {py('n_nationkey')} AS cy, ({d(5000.0)} + n_nationkey * 400) * f AS q
      FROM nation, (VALUES ({d(1.0)}), ({d(0.5)})) rings(f))"""


def inside(points: str, edges: str = EDGES) -> str:
    """Points (x, y) with an odd number of edges to their right, in any polygon; the edges' crossings are gathered per line first."""
    return f"""
SELECT DISTINCT p.x, p.y FROM ({points}) p JOIN (
  SELECT y, poly_id, list(x_at) AS at FROM (
    SELECT r.y, e.poly_id, e.x1 + (r.y - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) AS x_at
    FROM (SELECT DISTINCT y FROM ({points})) r JOIN ({edges}) e ON least(e.y1, e.y2) <= r.y AND greatest(e.y1, e.y2) > r.y)
  GROUP BY y, poly_id) c ON c.y = p.y
WHERE len(list_filter(c.at, lambda v: v > p.x)) % 2 = 1"""


COUNTRY_EDGES = f"SELECT * FROM ({EDGES}) WHERE poly_id IN ('NATION_1', 'NATION_2', 'NATION_5', 'NATION_9')"
PLANAR = f"SELECT o_orderkey AS row_id, {px('o_orderkey')} AS x, {py('o_orderkey')} AS y, o_totalprice AS probability FROM orders"
SEGMENTS = f"SELECT {px('s_suppkey')} AS x1, {py('s_suppkey')} AS y1, {px('s_suppkey + 1')} AS x2, {py('s_suppkey + 1')} AS y2 FROM supplier"


def raster_tables() -> str:
    return """
size1 AS (SELECT max(o_orderkey) // 125 + 1 AS h FROM orders), size2 AS (SELECT max(p_partkey) // 50 + 1 AS h FROM part),
gb AS (SELECT o_orderkey // 125 AS r, o_orderkey % 125 AS c,
              CASE WHEN o_orderkey // 125 * 4 < h THEN 0 ELSE o_custkey % 22 END AS k FROM orders, size1),
ni AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, CASE WHEN p_partkey % 50 < 15 THEN 0 ELSE p_size % 22 END AS k FROM part)"""


def rasters() -> str:
    return f"""{raster_tables()},
points AS (SELECT c_custkey AS row_id,
   CAST(floor((c_custkey * 104729 % 129 * 10 - 15) / {d(10.0)}) AS BIGINT) AS c1,
   CAST(floor((c_custkey * 7919 % (size1.h + 4) * 10 - 15) / {d(10.0)}) AS BIGINT) AS r1,
   CAST(floor((c_custkey * 31 % 54 * 10 - 15) / {d(10.0)}) AS BIGINT) AS c2,
   CAST(floor((c_custkey * 17 % (size2.h + 4) * 10 - 15) / {d(10.0)}) AS BIGINT) AS r2,
   size1.h AS h1, size2.h AS h2 FROM customer, size1, size2)"""


WINDOW_MODE = """
w AS (SELECT *, greatest(r1 - 5, 0) AS ra, greatest(c1 - 5, 0) AS ca, greatest(r2 - 5, 0) AS rb, greatest(c2 - 5, 0) AS cb FROM points),
ok AS (SELECT *, ra < h1 AND ca < 125 AS valid1, rb < h2 AND cb < 50 AS valid2 FROM w),
m1 AS (SELECT row_id, k, count(*) AS n FROM ok JOIN gb ON gb.r >= ra AND gb.r < ra + 10 AND gb.c >= ca AND gb.c < ca + 10
        WHERE valid1 AND k <> 0 AND gb.r < h1 GROUP BY row_id, k),
m2 AS (SELECT row_id, k, count(*) AS n FROM ok JOIN ni ON ni.r >= rb AND ni.r < rb + 10 AND ni.c >= cb AND ni.c < cb + 10
        WHERE valid1 AND k <> 0 AND ni.r < h2 GROUP BY row_id, k),
b1 AS (SELECT row_id, k FROM m1 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, k) = 1),
b2 AS (SELECT row_id, k FROM m2 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, k) = 1),
found AS (SELECT ok.row_id, CASE WHEN NOT valid1 THEN NULL WHEN b1.k IS NOT NULL THEN b1.k WHEN valid2 THEN coalesce(b2.k, 0) END AS k FROM ok
           LEFT JOIN b1 ON b1.row_id = ok.row_id LEFT JOIN b2 ON b2.row_id = ok.row_id)"""


def site_flag(radius: float) -> str:
    return f"""
SELECT r.row_id, CAST(coalesce(max(CASE WHEN s.la IS NOT NULL THEN 1 END), 0) AS INTEGER) AS wind_turbines_presence
FROM ({RECORDS}) r LEFT JOIN (SELECT {lat('s_suppkey')} AS la, {lon('s_suppkey')} AS lo FROM supplier WHERE s_acctbal > 0) s
  ON {haversine('r.la', 'r.lo', 's.la', 's.lo')} <= {d(radius)} GROUP BY r.row_id"""


def least_cloudy(scene_id: str) -> str:
    return f"""
WITH daily AS (SELECT CAST(l_shipdate AS DATE) AS acq, min({{'cloud': l_extendedprice, 'id': {scene_id}}}) AS s
               FROM lineitem GROUP BY 1)
SELECT r.row_id, min(s).id AS scene_id FROM ({RECORDS}) r LEFT JOIN daily ON acq >= dt - 15 AND acq < dt + 15 GROUP BY r.row_id"""


def temperature() -> str:
    half = d(10.0 / 111.32 / 2)
    return f"""
WITH readings AS (SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS acq, {lat('l_partkey')} AS pla, {lon('l_partkey')} AS plo,
                         CAST(14000 + l_orderkey % 1000 AS DOUBLE) AS raw FROM lineitem),
pixel AS (SELECT r.row_id, pla, plo, avg(raw) AS m FROM ({RECORDS}) r JOIN readings ON acq >= dt - 15 AND acq < dt + 15
   AND pla BETWEEN la - {half} AND la + {half} AND plo BETWEEN lo - {half} AND lo + {half} GROUP BY r.row_id, pla, plo)
SELECT o_orderkey AS row_id, "LST" FROM orders LEFT JOIN (
  SELECT row_id, round(avg(m * {d(0.02)}), 6) AS "LST" FROM pixel GROUP BY row_id) ON row_id = o_orderkey"""


def enriched() -> str:
    """All enrichment steps over the orders, each in its unbucketed form."""
    half = d(10.0 / 111.32 / 2)
    names = ["A", "N", "R"]
    near = haversine("r.la", "r.lo", "c.la", "c.lo")
    columns = ", ".join(f'coalesce(max(CASE WHEN c.cov = \'{n}\' THEN 1 END), 0) AS "{n}_presence"' for n in names)
    return f"""
WITH rec AS MATERIALIZED ({RECORDS}),
scene AS MATERIALIZED ({least_cloudy('l_suppkey')}),
pix AS MATERIALIZED (SELECT l_suppkey AS scene_id, {lat('l_orderkey')} AS pla, {lon('l_orderkey')} AS plo, {bands('l_partkey')} FROM lineitem),
means AS MATERIALIZED (SELECT r.row_id, {', '.join(f'avg({v}) AS "{k}"' for k, v in INDICES.items())}
  FROM rec r JOIN scene ON scene.row_id = r.row_id JOIN pix ON pix.scene_id = scene.scene_id
   AND pla BETWEEN la - {half} AND la + {half} AND plo BETWEEN lo - {half} AND lo + {half} GROUP BY r.row_id),
temp AS MATERIALIZED ({temperature()}),
cov AS MATERIALIZED ({COVARIATES}),
flag AS MATERIALIZED (SELECT r.row_id, {columns} FROM rec r LEFT JOIN cov c
  ON year(r.dt) = year(c.dt) AND month(r.dt) = month(c.dt) AND {near} <= {d(1.0)} GROUP BY r.row_id),
site AS MATERIALIZED ({site_flag(1.0)}),
gbxy AS MATERIALIZED ({projection(*BRITISH, 'la', 'lo', RECORDS)}),
nixy AS MATERIALIZED ({projection(*IRISH, 'la', 'lo', RECORDS)}),
road AS (SELECT x1 + {d(330000.0)} AS x1, y1 + {d(12000.0)} AS y1, x2 - x1 AS dx, y2 - y1 AS dy FROM ({SEGMENTS})),
along AS (SELECT row_id, east AS x, north AS y, x1, y1, dx, dy,
   greatest({d(0.0)}, least({d(1.0)}, coalesce(((east - x1) * dx + (north - y1) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM gbxy, road),
near_road AS (SELECT row_id, CASE WHEN min(sqrt((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2)) <= 500 THEN 1 ELSE 0 END AS near_road
  FROM along GROUP BY row_id),
{raster_tables()},
points AS (SELECT g.row_id, CAST(floor((g.east - 320000) / 1000) AS BIGINT) AS c1, CAST(floor((140000 - g.north) / 1000) AS BIGINT) AS r1,
   CAST(floor((i.east - 545000) / 2000) AS BIGINT) AS c2, CAST(floor((-5000 - i.north) / 2000) AS BIGINT) AS r2, size1.h AS h1, size2.h AS h2
   FROM gbxy g JOIN nixy i ON i.row_id = g.row_id, size1, size2),
{WINDOW_MODE}
SELECT rec.row_id, dt AS "eventDate", {', '.join(f'round("{k}", 6) AS "{k}"' for k in INDICES)}, "LST", "A_presence", "N_presence", "R_presence",
  wind_turbines_presence, near_road, {cover('k')} AS "Land_cover"
FROM rec JOIN means ON means.row_id = rec.row_id JOIN temp ON temp.row_id = rec.row_id JOIN flag ON flag.row_id = rec.row_id
 JOIN site ON site.row_id = rec.row_id JOIN near_road ON near_road.row_id = rec.row_id JOIN found ON found.row_id = rec.row_id
WHERE {' AND '.join(f'"{k}" IS NOT NULL' for k in INDICES)} AND "LST" IS NOT NULL AND k BETWEEN 1 AND 21"""


def boyce(source: str, group: str) -> str:
    """Boyce index per group of a (group, p, label) source."""
    return f"""
SELECT g.{group}, CASE WHEN max(g.phi) > min(g.plo) AND sum(CASE WHEN zero > 0 THEN 1 ELSE 0 END) >= 2
   THEN corr(CASE WHEN zero > 0 THEN (lo + b * step + CASE WHEN b = 9 THEN hi ELSE lo + (b + 1) * step END) / 2 END,
             CASE WHEN zero > 0 THEN one / CAST(zero AS DOUBLE) END) ELSE 0 END AS boyce
FROM (
  SELECT {group}, b, lo, hi, step, plo, phi, sum(label) AS one, sum(1 - label) AS zero FROM (
    SELECT s.{group}, label, lo, hi, step, plo, phi,
      CASE WHEN p >= hi THEN 9 ELSE (SELECT max(i) FROM range(10) bins(i) WHERE p >= lo + i * step) END AS b
    FROM ({source}) s JOIN (
      SELECT {group}, min(p) AS lo, max(p) AS hi, (max(p) - min(p)) / {d(10.0)} AS step,
             min(CASE WHEN label = 1 THEN p END) AS plo, max(CASE WHEN label = 1 THEN p END) AS phi
      FROM ({source}) GROUP BY {group}) e ON e.{group} = s.{group})
  GROUP BY {group}, b, lo, hi, step, plo, phi) g GROUP BY g.{group}"""


def auc(source: str, group: str) -> str:
    """Mid-rank AUC per group of a (group, p, label) source."""
    return f"""
SELECT {group}, coalesce((sum(CASE WHEN label = 1 THEN mid END) - any_value(n1) * (any_value(n1) + 1) / 2)
         / nullif(CAST(any_value(n1) AS DOUBLE) * any_value(n0), 0), 0) AS auc
FROM (SELECT {group}, label,
        rank() OVER (PARTITION BY {group} ORDER BY p) + (count(*) OVER (PARTITION BY {group}, p) - 1) / {d(2.0)} AS mid,
        sum(label) OVER (PARTITION BY {group}) AS n1, sum(1 - label) OVER (PARTITION BY {group}) AS n0 FROM ({source}))
GROUP BY {group}"""


ORDER_SCORES = (
    "SELECT o_orderpriority AS species, o_totalprice AS p, floor(o_totalprice / 1000) AS tied,"
    " CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders"
)


def merged(source: str, group: str) -> str:
    return f"""
SELECT a.{group}, auc, boyce, (auc - 0.5) / 0.5 AS auc_norm, (boyce + 1) / 2 AS boyce_norm,
       ((auc - 0.5) / 0.5 + (boyce + 1) / 2) / 2 AS mixed
FROM ({auc(source, group)}) a JOIN ({boyce(source, group)}) b ON a.{group} = b.{group}"""


def powerset() -> str:
    parts = []
    for mask in range(1, 16):
        chosen = [m for i, m in enumerate(MODELS) if mask >> i & 1]
        mean = f"({' + '.join(chosen)}) / {d(float(len(chosen)))}"
        parts.append(f"SELECT '{'+'.join(chosen)}' AS ensemble, label, {mean} AS p FROM s")
    return f"WITH s AS MATERIALIZED ({SCORES}), e AS MATERIALIZED ({' UNION ALL '.join(parts)})\nSELECT ensemble, {rounded(['auc', 'boyce', 'mixed'])} FROM ({merged('SELECT * FROM e', 'ensemble')})"


def projection(a: float, b: float, f0: float, lat0: float, lon0: float, e0: float, n0: float, shift, rot, ppm: float, la: str, lo: str, source: str) -> str:
    """WGS84 to a transverse Mercator grid, as a chain of subqueries."""
    import math

    wa, wb = 6378137.0, 6356752.314245179
    we2, e2, n = 1 - (wb / wa) ** 2, 1 - (b / a) ** 2, (a - b) / (a + b)
    tx, ty, tz = (-v for v in shift)
    rx, ry, rz = (-math.radians(v / 3600) for v in rot)
    k, p0, ep2 = 1 - ppm * 1e-6, math.radians(lat0), e2 / (1 - e2)
    c = [1 + n + 1.25 * n**2 + 1.25 * n**3, 3 * n + 3 * n**2 + 21 / 8 * n**3, 15 / 8 * (n**2 + n**3), 35 / 24 * n**3]
    return f"""
WITH g0 AS (SELECT row_id, radians({la}) AS ph, radians({lo}) AS lm FROM ({source})),
g1 AS (SELECT *, {d(wa)} / sqrt(1 - {d(we2)} * sin(ph) * sin(ph)) AS nu0 FROM g0),
g2 AS (SELECT row_id, nu0 * cos(ph) * cos(lm) AS x, nu0 * cos(ph) * sin(lm) AS y, nu0 * {d(1 - we2)} * sin(ph) AS z FROM g1),
g3 AS (SELECT row_id, {d(tx)} + {d(k)} * (x - {d(rz)} * y + {d(ry)} * z) AS x, {d(ty)} + {d(k)} * ({d(rz)} * x + y - {d(rx)} * z) AS y,
       {d(tz)} + {d(k)} * ({d(rx)} * y - {d(ry)} * x + z) AS z FROM g2),
g4 AS (SELECT *, sqrt(x * x + y * y) AS h, atan2(z * {d(a)}, sqrt(x * x + y * y) * {d(b)}) AS u FROM g3),
g5 AS (SELECT row_id, atan2(z + {d(ep2 * b)} * sin(u) ** 3, h - {d(e2 * a)} * cos(u) ** 3) AS ph, atan2(y, x) - {d(math.radians(lon0))} AS dl FROM g4),
g6 AS (SELECT *, {d(a * f0)} / sqrt(1 - {d(e2)} * sin(ph) ** 2) AS nu, {d(a * f0 * (1 - e2))} / (1 - {d(e2)} * sin(ph) ** 2) ** 1.5 AS rho FROM g5),
g7 AS (SELECT *, nu / rho - 1 AS eta2, tan(ph) ** 2 AS t2, sin(ph) AS s, cos(ph) AS cs,
       {d(b * f0)} * ({d(c[0])} * (ph - {d(p0)}) - {d(c[1])} * sin(ph - {d(p0)}) * cos(ph + {d(p0)})
        + {d(c[2])} * sin(2 * (ph - {d(p0)})) * cos(2 * (ph + {d(p0)})) - {d(c[3])} * sin(3 * (ph - {d(p0)})) * cos(3 * (ph + {d(p0)}))) AS m FROM g6)
SELECT row_id,
  round({d(e0)} + dl * nu * cs + dl ** 3 * nu / 6 * cs ** 3 * (nu / rho - t2)
    + dl ** 5 * nu / 120 * cs ** 5 * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2), 3) AS east,
  round({d(n0)} + m + dl ** 2 * nu / 2 * s * cs + dl ** 4 * nu / 24 * s * cs ** 3 * (5 - t2 + 9 * eta2)
    + dl ** 6 * nu / 720 * s * cs ** 5 * (61 - 58 * t2 + t2 * t2), 3) AS north
FROM g7"""


def unprojection(source: str) -> str:
    """British grid (x, y) to WGS84, by fixed-point iteration for the foot latitude."""
    import math

    a, b, f0, p0, l0, n0 = 6377563.396, 6356256.909237285, 0.9996012717, math.radians(49.0), math.radians(-2.0), -100000.0
    wa, wb = 6378137.0, 6356752.314245179
    e2, we2, n = 1 - (b / a) ** 2, 1 - (wb / wa) ** 2, (a - b) / (a + b)
    c = [1 + n + 1.25 * n**2 + 1.25 * n**3, 3 * n + 3 * n**2 + 21 / 8 * n**3, 15 / 8 * (n**2 + n**3), 35 / 24 * n**3]

    def arc(ph: str) -> str:
        return (
            f"({d(b * f0)} * ({d(c[0])} * ({ph} - {d(p0)}) - {d(c[1])} * sin({ph} - {d(p0)}) * cos({ph} + {d(p0)})"
            f" + {d(c[2])} * sin(2 * ({ph} - {d(p0)})) * cos(2 * ({ph} + {d(p0)})) - {d(c[3])} * sin(3 * ({ph} - {d(p0)})) * cos(3 * ({ph} + {d(p0)}))))"
        )

    steps = ["f0 AS (SELECT *, (y - {0}) / {1} + {2} AS ph FROM src)".format(d(n0), d(a * f0), d(p0))]
    for i in range(1, 8):
        steps.append(f"f{i} AS (SELECT * EXCLUDE (ph), ph + (y - {d(n0)} - {arc('ph')}) / {d(a * f0)} AS ph FROM f{i - 1})")
    tx, ty, tz = 446.448, -125.157, 542.06
    rx, ry, rz = (math.radians(v / 3600) for v in (0.15, 0.247, 0.842))
    k, ep2 = 1 - 20.489e-6, we2 / (1 - we2)
    return f"""
WITH src AS ({source}), {', '.join(steps)},
h0 AS (SELECT *, {d(a * f0)} / sqrt(1 - {d(e2)} * sin(ph) ** 2) AS nu, {d(a * f0 * (1 - e2))} / (1 - {d(e2)} * sin(ph) ** 2) ** 1.5 AS rho,
       tan(ph) AS t, x - 400000 AS de FROM f7),
h1 AS (SELECT *, nu / rho - 1 AS eta2 FROM h0),
h2 AS (SELECT row_id,
  ph - t / (2 * rho * nu) * de ** 2 + t / (24 * rho * nu ** 3) * (5 + 3 * t ** 2 + eta2 - 9 * t ** 2 * eta2) * de ** 4
     - t / (720 * rho * nu ** 5) * (61 + 90 * t ** 2 + 45 * t ** 4) * de ** 6 AS ph,
  {d(l0)} + de / (cos(ph) * nu) - de ** 3 / (6 * cos(ph) * nu ** 3) * (nu / rho + 2 * t ** 2)
     + de ** 5 / (120 * cos(ph) * nu ** 5) * (5 + 28 * t ** 2 + 24 * t ** 4)
     - de ** 7 / (5040 * cos(ph) * nu ** 7) * (61 + 662 * t ** 2 + 1320 * t ** 4 + 720 * t ** 6) AS lm FROM h1),
h3 AS (SELECT *, {d(a)} / sqrt(1 - {d(e2)} * sin(ph) ** 2) AS nu FROM h2),
h4 AS (SELECT row_id, nu * cos(ph) * cos(lm) AS x, nu * cos(ph) * sin(lm) AS y, nu * {d(1 - e2)} * sin(ph) AS z FROM h3),
h5 AS (SELECT row_id, {d(tx)} + {d(k)} * (x - {d(rz)} * y + {d(ry)} * z) AS x, {d(ty)} + {d(k)} * ({d(rz)} * x + y - {d(rx)} * z) AS y,
       {d(tz)} + {d(k)} * ({d(rx)} * y - {d(ry)} * x + z) AS z FROM h4),
h6 AS (SELECT *, sqrt(x * x + y * y) AS h, atan2(z * {d(wa)}, sqrt(x * x + y * y) * {d(wb)}) AS u FROM h5)
SELECT row_id, degrees(atan2(y, x)) AS longitude,
       degrees(atan2(z + {d(ep2 * wb)} * sin(u) ** 3, h - {d(we2 * wa)} * cos(u) ** 3)) AS latitude FROM h6"""


BRITISH = (6377563.396, 6356256.909237285, 0.9996012717, 49.0, -2.0, 400000.0, -100000.0, (446.448, -125.157, 542.06), (0.15, 0.247, 0.842), -20.489)
IRISH = (6377340.189, 6356034.447938534, 1.000035, 53.5, -8.0, 200000.0, 250000.0, (482.5, -130.6, 564.6), (-1.042, -0.214, -0.631), 8.15)


def mlp(shift: int = 0, logit: bool = False) -> str:
    """The fixed network written out as expressions, layer by layer; ``p``, or its logit ``z``."""
    def w(layer: int, i: int, j: int) -> float:
        return ((i * 7 + j * 3 + layer * 5 + shift) % 11 - 5) / 4.0

    def b(layer: int, j: int) -> float:
        return ((j * 3 + layer) % 5 - 2) / 8.0

    def unit(layer: int, inputs: list[str], j: int) -> str:
        return " + ".join([*(f"{d(w(layer, i, j))} * {x}" for i, x in enumerate(inputs)), d(b(layer, j))])

    inputs = [f'"{c}"' for c in ENV_VARS]
    first = ", ".join(f"greatest({d(0.0)}, {unit(0, inputs, j)}) AS a{j}" for j in range(3))
    second = ", ".join(f"greatest({d(0.0)}, {unit(1, ['a0', 'a1', 'a2'], j)}) + a{j} AS b{j}" for j in range(3))
    third = ", ".join(f"greatest({d(0.0)}, {unit(2, ['b0', 'b1', 'b2'], j)}) + b{j} AS c{j}" for j in range(3))
    z = unit(3, ["c0", "c1", "c2"], 0)
    out = f"{z} AS z" if logit else f"{d(1.0)} / ({d(1.0)} + exp(-({z}))) AS p"
    return f"""
SELECT row_id, {out} FROM (
 SELECT row_id, {third} FROM (SELECT row_id, {second} FROM (SELECT row_id, {first} FROM ({FEATURES}))))"""


def linear_values() -> str:
    means = ", ".join(f'avg("{c}") AS "m_{c}"' for c in ENV_VARS)
    return " UNION ALL ".join(
        f"SELECT row_id, '{c}' AS feature, {d(w)} * (\"{c}\" - \"m_{c}\") AS value FROM ({FEATURES}), (SELECT {means} FROM ({FEATURES}))"
        for c, w in zip(ENV_VARS, WEIGHTS)
    )


CLASS_CELLS = (
    "SELECT lang AS y, CASE WHEN n_chars < 500 THEN 'en' WHEN n_chars < 1500 THEN 'de' ELSE 'fr' END AS q FROM documents"
)

RESAMPLED = """
WITH nodes AS (SELECT o_orderkey // 125 AS i, o_orderkey % 125 AS j, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'),
cells AS (SELECT DISTINCT i - a AS i, j - b AS j FROM nodes, range(2) q(a), range(2) r(b)),
corner AS (SELECT c.i, c.j, f00.v AS f00, f10.v AS f10, f01.v AS f01, f11.v AS f11 FROM cells c
  LEFT JOIN nodes f00 ON f00.i = c.i AND f00.j = c.j LEFT JOIN nodes f10 ON f10.i = c.i + 1 AND f10.j = c.j
  LEFT JOIN nodes f01 ON f01.i = c.i AND f01.j = c.j + 1 LEFT JOIN nodes f11 ON f11.i = c.i + 1 AND f11.j = c.j + 1),
halves AS (
  SELECT i * 1000 AS x, j * 1000 AS y, f00 AS v FROM corner
  UNION ALL SELECT i * 1000 + 500, j * 1000, (f00 + f10) / 2 FROM corner
  UNION ALL SELECT i * 1000, j * 1000 + 500, (f00 + f01) / 2 FROM corner
  UNION ALL SELECT i * 1000 + 500, j * 1000 + 500, CASE WHEN f00 + f10 + f01 + f11 IS NOT NULL THEN (f00 + f10 + f01 + f11) / 4
     WHEN f00 IS NULL OR f11 IS NULL THEN (f10 + f01) / 2 ELSE (f00 + f11) / 2 END
     FROM corner WHERE (f00 IS NULL)::INT + (f10 IS NULL)::INT + (f01 IS NULL)::INT + (f11 IS NULL)::INT <= 1)
SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(v, 4) AS probability FROM halves WHERE v IS NOT NULL
  AND x < (SELECT max(o_orderkey // 125) * 1000 FROM orders) AND y < (SELECT max(o_orderkey % 125) * 1000 FROM orders)"""

ORACLE: dict[str, str] = {
    "occurrence_clean": f"{CLEAN} AND y >= 1997",
    "occurrence_count_since": f"SELECT count(*) AS n FROM ({CLEAN}) WHERE year(\"eventDate\") >= 1999",
    "operational_sites": f"SELECT {lat('s_suppkey')} AS \"decimalLatitude\", {lon('s_suppkey')} AS \"decimalLongitude\" FROM supplier WHERE s_acctbal > 0",
    "predicate_filter": """
SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND year(o_orderdate) >= 1997""",
    "dedup_union_label": """
SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, 'presence' AS type, CAST(NULL AS VARCHAR) AS event_type, 1 AS label
FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL AND ts IS NOT NULL
UNION ALL
SELECT DISTINCT user_id, CAST(ts AS DATE), 'background', event_type, 0
FROM events WHERE event_type <> 'purchase' AND user_id IS NOT NULL AND ts IS NOT NULL""",
    "one_hot_flags": "SELECT p_partkey, CAST(CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS DOUBLE) AS near_road, "
    + f"{d(0.0)} AS cats_presence, "
    + ", ".join(f"CAST(CASE WHEN lc = '{c}' THEN 1 ELSE 0 END AS DOUBLE) AS \"Land_cover_{c}\"" for c in COVER)
    + f" FROM (SELECT *, {cover('p_size % 23')} AS lc FROM part) WHERE lc <> 'Unknown'",
    "one_hot_decode": f"SELECT p_partkey, {cover('p_size % 23')} AS \"Land_cover\" FROM part",
    "one_hot_drop_first": """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS "status_O",
       CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "status_P" FROM orders""",
    "numeric_cast": """
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level, TRY_CAST(o_orderpriority AS DOUBLE) AS text FROM orders""",
    "bounds": f"SELECT min(lo) AS min_x, min(la) AS min_y, max(lo) AS max_x, max(la) AS max_y FROM ({RECORDS})",
    "sample_rows": f"SELECT row_id, label FROM ({FEATURES}) ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id LIMIT 50",
    "first_rows": f"SELECT row_id, label FROM ({FEATURES}) ORDER BY row_id LIMIT 200",
    "spectral_indices": "SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(f'round({v}, 6) AS "{k}"' for k, v in INDICES.items())
    + f" FROM (SELECT l_orderkey, l_linenumber, l_partkey, {bands('l_partkey')} FROM lineitem)",
    "aoi_boxes": f"""
WITH r AS (SELECT *, {d(1.0 / 111.32 / 2)} AS h, 1 - {d(0.00669437999014)} * sin(radians(la)) ** 2 AS w FROM ({RECORDS})),
t AS (SELECT *, degrees(500 * w ** 1.5 / {d(6378137.0 * (1 - 0.00669437999014))}) AS dy,
             degrees(500 * sqrt(w) / ({d(6378137.0)} * cos(radians(la)))) AS dx FROM r)
SELECT row_id, round(la - h, 6) AS flat_lat_min, round(la + h, 6) AS flat_lat_max, round(lo - h, 6) AS flat_lon_min,
       round(lo + h, 6) AS flat_lon_max, round(la - dy, 6) AS true_lat_min, round(la + dy, 6) AS true_lat_max,
       round(lo - dx, 6) AS true_lon_min, round(lo + dx, 6) AS true_lon_max FROM t""",
    "tiles": f"""
SELECT row_id, tile_x, tile_y, round(tile_x * {d(0.0157)} - {d(0.003)}, 6) AS west, round(tile_y * {d(0.009)} - {d(0.002)}, 6) AS south,
       round((tile_x + 1) * {d(0.0157)} + {d(0.003)}, 6) AS east, round((tile_y + 1) * {d(0.009)} + {d(0.002)}, 6) AS north
FROM (SELECT row_id, CAST(floor(lo / {d(0.0157)}) AS INTEGER) AS tile_x, CAST(floor(la / {d(0.009)}) AS INTEGER) AS tile_y FROM ({RECORDS}))""",
    "loss_columns": f"""
SELECT round(avg(p), 6) AS mean_p,
       round(avg(-(label * ln(p + {d(1e-8)}) + (1 - label) * ln(1 - p + {d(1e-8)}))), 6) AS eps_loss,
       round(avg(greatest(z, {d(0.0)}) - z * label + ln(1 + exp(-abs(z)))), 6) AS bce_loss
FROM (SELECT label, z, {d(1.0)} / (1 + exp(-z)) AS p FROM (SELECT label, "NDVI" * {d(10.0)} AS z FROM ({FEATURES})))""",
    "to_bng_grid": f"SELECT row_id, east AS easting_gb, north AS northing_gb FROM ({projection(*BRITISH, 'la', 'lo', RECORDS)})",
    "to_irish": f"SELECT row_id, east AS easting_ni, north AS northing_ni FROM ({projection(*IRISH, 'la', 'lo', RECORDS)})",
    "from_bng_grid": "SELECT row_id, round(longitude, 8) AS longitude, round(latitude, 8) AS latitude FROM ("
    + unprojection(f"SELECT row_id, x + {d(400000.0)} AS x, y + {d(200000.0)} AS y FROM ({PLANAR})")
    + ")",
    "radius_month_flags": flags(f"SELECT * FROM ({RECORDS}) WHERE status = 'F'", ["A", "N", "R"]),
    "flagged_share_by_month": f"""
WITH clean AS (SELECT row_id, "decimalLatitude" AS la, "decimalLongitude" AS lo, "eventDate" AS dt FROM ({CLEAN} AND y >= 1996)),
flagged AS ({flags('SELECT * FROM clean', ['R'])})
SELECT CAST(month(dt) AS INTEGER) AS month, count(*) AS records, CAST(sum("R_presence") AS BIGINT) AS flagged,
       round(avg("R_presence"), 6) AS share FROM clean JOIN flagged ON clean.row_id = flagged.row_id GROUP BY month(dt)""",
    "site_radius_flag": site_flag(5.0),
    "lookup_first": f"""
SELECT c_custkey, coalesce(o_totalprice, 0) AS o_totalprice FROM customer LEFT JOIN (
  SELECT {lat('o_custkey')} AS la, {lon('o_custkey')} AS lo, o_totalprice,
         row_number() OVER (PARTITION BY {lat('o_custkey')}, {lon('o_custkey')} ORDER BY o_orderkey) AS i FROM orders)
  ON i = 1 AND la = {lat('c_custkey')} AND lo = {lon('c_custkey')}""",
    "attach_results": """
SELECT o_orderkey AS row_id, mean_quantity FROM orders LEFT JOIN (
  SELECT l_orderkey, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "least_cloudy_scene": f"""
WITH scene AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_shipdate AS DATE) AS acq, l_extendedprice AS cloud,
   {lat('l_partkey')} AS sla, {lon('l_partkey')} AS slo, l_quantity / {d(100.0)} + {d(0.05)} AS half FROM lineitem),
found AS (
  SELECT r.row_id, id, row_number() OVER (PARTITION BY r.row_id ORDER BY cloud, id) AS i
  FROM ({RECORDS}) r JOIN scene s ON s.acq >= r.dt - 15 AND s.acq < r.dt + 15
   AND sla - half <= la + {d(1.0 / 111.32 / 2)} AND sla + half >= la - {d(1.0 / 111.32 / 2)}
   AND slo - half <= lo + {d(1.0 / 111.32 / 2)} AND slo + half >= lo - {d(1.0 / 111.32 / 2)})
SELECT o_orderkey AS row_id, id AS scene_id FROM orders LEFT JOIN found ON row_id = o_orderkey AND i = 1""",
    "least_cloudy_anywhere": least_cloudy("l_orderkey * 10 + l_linenumber"),
    "aoi_mean": aoi(INDICES, None),
    "aoi_mean_of_bands": aoi({b: b for b in PRIMES}, INDICES),
    "lst_mean": temperature(),
    "nearest_segment": f"""
WITH pairs AS (SELECT p.row_id, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM ({PLANAR}) p, ({SEGMENTS}) s),
along AS (SELECT *, greatest({d(0.0)}, least({d(1.0)}, coalesce(((x - x1) * dx + (y - y1) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM pairs),
best AS (SELECT row_id, min(sqrt((x - (x1 + t * dx)) * (x - (x1 + t * dx)) + (y - (y1 + t * dy)) * (y - (y1 + t * dy)))) AS m FROM along GROUP BY row_id)
SELECT row_id, CASE WHEN m <= 2000 THEN round(m, 6) END AS distance_to_road, CASE WHEN m <= 500 THEN 1 ELSE 0 END AS near_road FROM best""",
    "raster_point": f"""
WITH {rasters()},
found AS (SELECT p.row_id, CASE WHEN r1 BETWEEN 0 AND h1 - 1 AND c1 BETWEEN 0 AND 124 THEN
     CASE WHEN coalesce(gb.k, 0) <> 0 THEN gb.k WHEN r2 BETWEEN 0 AND h2 - 1 AND c2 BETWEEN 0 AND 49 THEN coalesce(ni.k, 0) END END AS k
   FROM points p LEFT JOIN gb ON gb.r = r1 AND gb.c = c1 LEFT JOIN ni ON ni.r = r2 AND ni.c = c2)
SELECT row_id, CAST(k AS INTEGER) AS class, {cover('k')} AS "Land_cover" FROM found""",
    "raster_window_mode": f"""
WITH {rasters()},
{WINDOW_MODE}
SELECT row_id, CAST(k AS INTEGER) AS class, {cover('k')} AS "Land_cover" FROM found""",
    "points_in_polygon": f"SELECT row_id FROM ({PLANAR}) p JOIN ({inside(PLANAR)}) i ON i.x = p.x AND i.y = p.y",
    "masked_grid": f"""
SELECT row_id, CASE WHEN i.x IS NOT NULL THEN probability END AS probability
FROM ({PLANAR}) p LEFT JOIN ({inside(PLANAR)}) i ON i.x = p.x AND i.y = p.y""",
    "lattice": f"""
WITH b AS (SELECT min(least(x1, x2)) AS a, min(least(y1, y2)) AS b, max(greatest(x1, x2)) AS c, max(greatest(y1, y2)) AS e FROM ({SEGMENTS}))
SELECT round(a + i * {d(1000.0)}, 3) AS x, round(b + j * {d(1000.0)}, 3) AS y FROM b, range(200) xs(i), range(200) ys(j)
WHERE i < ceil((c - a) / 1000) AND j < ceil((e - b) / 1000)""",
    "national_grid": f"""
WITH b AS (SELECT min(least(x1, x2)) AS a, min(least(y1, y2)) AS b, max(greatest(x1, x2)) AS c, max(greatest(y1, y2)) AS e FROM ({EDGES})),
pts AS MATERIALIZED (SELECT a + i * {d(500.0)} AS x, b + j * {d(500.0)} AS y FROM b, range(500) xs(i), range(500) ys(j)
        WHERE i < ceil((c - a) / 500) AND j < ceil((e - b) / 500)),
kept AS (SELECT 0 AS row_id, x, y FROM ({inside('SELECT x, y FROM pts')}))
SELECT round(longitude, 7) AS longitude, round(latitude, 7) AS latitude FROM ({unprojection('SELECT * FROM kept')})""",
    "country_grid": f"""
WITH b AS (SELECT min(least(x1, x2)) AS a, min(least(y1, y2)) AS b, max(greatest(x1, x2)) AS c, max(greatest(y1, y2)) AS e FROM ({COUNTRY_EDGES})),
pts AS MATERIALIZED (SELECT a + i * {d(500.0)} AS x, b + j * {d(500.0)} AS y FROM b, range(500) xs(i), range(500) ys(j)
        WHERE i < ceil((c - a) / 500) AND j < ceil((e - b) / 500)),
kept AS (SELECT 0 AS row_id, x, y FROM ({inside('SELECT x, y FROM pts', COUNTRY_EDGES)}))
SELECT round(longitude, 7) AS longitude, round(latitude, 7) AS latitude FROM ({unprojection('SELECT * FROM kept')})""",
    "resample_grid": RESAMPLED,
    "probability_map": f"""
WITH v AS MATERIALIZED ({RESAMPLED}) SELECT v.x, v.y, CASE WHEN i.x IS NOT NULL THEN probability END AS probability
FROM v LEFT JOIN ({inside('SELECT x, y FROM v')}) i ON i.x = v.x AND i.y = v.y""",
    "hash_split": f"SELECT row_id, {TEST_ROW} AS is_test FROM (SELECT o_orderkey AS row_id FROM orders)",
    "scaler_fit": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(\"{c}\"), 6) AS mean, round(stddev_pop(\"{c}\"), 6) AS std FROM ({FEATURES}) WHERE NOT ({TEST_ROW})"
        for c in ENV_VARS
    ),
    "scaler_apply": f"WITH f AS ({FEATURES}), s AS (SELECT "
    + ", ".join(f'avg("{c}") AS "m_{c}", stddev_pop("{c}") AS "s_{c}"' for c in ENV_VARS)
    + f" FROM f WHERE NOT ({TEST_ROW})) SELECT row_id, "
    + ", ".join(f'round(("{c}" - "m_{c}") / "s_{c}", 6) AS "{c}"' for c in ENV_VARS)
    + " FROM f, s",
    "boyce_index": f"SELECT species, round(boyce, 6) AS boyce FROM ({boyce(ORDER_SCORES, 'species')})",
    "roc_auc": f"SELECT species, round(auc, 6) AS auc FROM ({auc(f'SELECT species, tied AS p, label FROM ({ORDER_SCORES})', 'species')})",
    "merged_metric": f"SELECT species, {rounded(['auc', 'boyce', 'auc_norm', 'boyce_norm', 'mixed'])} FROM ({merged(ORDER_SCORES, 'species')})",
    "metrics_long": f"WITH m AS MATERIALIZED ({merged(ORDER_SCORES, 'species')}) "
    + " UNION ALL ".join(f"SELECT species, '{c}' AS metric, round({c}, 6) AS value FROM m" for c in ("auc_norm", "boyce_norm", "mixed")),
    "ensemble_mean": f"SELECT row_id, round(avg(p), 8) AS probability FROM ({LONG_SCORES}) GROUP BY row_id",
    "high_probability": f"SELECT * FROM ({LONG_SCORES}) WHERE p > {d(0.6)}",
    "ensemble_powerset": powerset(),
    "feature_corr": " UNION ALL ".join(
        f"SELECT '{'probability' if c == 'UI' else c}' AS feature, round(corr(\"{c}\", \"UI\"), 6) AS corr FROM ({FEATURES})"
        for c in ["label", *ENV_VARS]
    ),
    "value_share": f"""
SELECT lc AS "Land_cover", count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 6) AS share
FROM (SELECT {cover('p_size % 23')} AS lc FROM part) GROUP BY lc""",
    "class_report": f"""
WITH cells AS ({CLASS_CELLS}), classes AS (SELECT y AS class FROM cells UNION SELECT q FROM cells),
per AS (SELECT class, (SELECT count(*) FROM cells WHERE y = class AND q = class) AS tp,
               (SELECT count(*) FROM cells WHERE y = class) AS support, (SELECT count(*) FROM cells WHERE q = class) AS said FROM classes),
rate AS (SELECT *, coalesce(tp / nullif(said, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall FROM per),
full_rate AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rate),
rows AS (SELECT class, precision, recall, f1, support FROM full_rate
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support)::DOUBLE, sum(tp) / sum(support)::DOUBLE, sum(tp) / sum(support)::DOUBLE, sum(support) FROM full_rate
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM full_rate
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM full_rate)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rows""",
    "logit_score": "SELECT row_id, round(1 / (1 + exp(-("
    + " + ".join([d(0.1), *(f'{d(w)} * "{c}"' for c, w in zip(ENV_VARS, WEIGHTS))])
    + f"))), 6) AS p FROM ({FEATURES})",
    "linear_attribution": f"SELECT row_id, feature, round(value, 6) AS value FROM ({linear_values()})",
    "linear_importance": f"SELECT feature, round(avg(abs(value)), 6) AS importance FROM ({linear_values()}) GROUP BY feature ORDER BY avg(abs(value)) DESC, feature LIMIT 5",
    "shapley_total": f"WITH n AS MATERIALIZED ({mlp(logit=True)}) SELECT row_id, round(z - (SELECT avg(z) FROM (SELECT z FROM n ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id LIMIT 50)), 6) AS total FROM n",
    "logit_optimum": f"SELECT {TEST_ROW} AS is_test, count(*) AS n, CAST(sum(label) AS BIGINT) AS presences, TRUE AS converged, TRUE AS above_chance FROM ({FEATURES}) GROUP BY 1",
    "class_shares": f"SELECT species, count(*) AS n, TRUE AS sums_to_one FROM (SELECT vec_id AS row_id, 'species_' || label AS species FROM embeddings) WHERE {TEST_ROW} GROUP BY species",
    "grid_search_facts": "SELECT 192::BIGINT AS settings, 192::BIGINT AS scored, 4::BIGINT AS penalties, TRUE AS in_range, TRUE AS none_alike, TRUE AS best_not_below_fixed",
    "stored_models": f"SELECT row_id, {TEST_ROW} AS is_test, TRUE AS same, TRUE AS old_scores FROM ({FEATURES})",
    "linear_ensemble": f"""
SELECT m::INTEGER AS models, count(*) AS rows, CAST(sum(label) AS BIGINT) AS presences, TRUE AS auc_is_share_of_pairs
FROM ({FEATURES}), (VALUES (1, 1), (1, 2), (2, 3)) e(m, k) WHERE {TEST_ROW} GROUP BY m, k""",
    "class_facts": f"""SELECT species, count(*) AS n, TRUE AS shares_and_best, TRUE AS calibration_not_above_constant
FROM (SELECT vec_id AS row_id, 'species_' || label AS species FROM embeddings) WHERE {TEST_ROW} GROUP BY species""",
    "first_file_rows": "SELECT status AS \"occurrenceStatus\", y::INTEGER AS year, species, \"decimalLongitude\" FROM (" + RAW
    + ") QUALIFY row_number() OVER (PARTITION BY status ORDER BY row_id) <= 200",
    "stage_tables": f"SELECT row_id, dt AS \"eventDate\", 2::BIGINT AS copies, round(la, 9) AS latitude, TRUE AS same FROM ({RECORDS})",
    "residual_mlp_score": f"SELECT row_id, round(p, 6) AS p FROM ({mlp()})",
    "score_models": f"SELECT a.row_id, round((a.p + b.p) / 2, 6) AS probability FROM ({mlp()}) a JOIN ({mlp(2)}) b ON b.row_id = a.row_id",
    "type_split": f"""
SELECT {lat('o_orderkey')} AS "decimalLatitude", {lon('o_orderkey')} AS "decimalLongitude" FROM orders WHERE o_orderstatus = 'F'""",
    "occurrence_files": f"""SELECT species, "decimalLatitude", "decimalLongitude", "eventDate" FROM ({CLEAN} AND y >= 1997)""",
    "grid_counts": f"""
WITH b AS (SELECT min(least(x1, x2)) AS a, min(least(y1, y2)) AS b, max(greatest(x1, x2)) AS c, max(greatest(y1, y2)) AS e FROM ({EDGES})),
pts AS MATERIALIZED (SELECT a + i * {d(1000.0)} AS x, b + j * {d(1000.0)} AS y FROM b, range(500) xs(i), range(500) ys(j)
        WHERE i < ceil((c - a) / 1000) AND j < ceil((e - b) / 1000))
SELECT (SELECT count(*) FROM pts) AS points, (SELECT count(*) FROM ({inside('SELECT x, y FROM pts')})) AS inside""",
    "points_in_box": f"""
SELECT row_id FROM ({PLANAR}), (SELECT min(least(x1, x2)) AS a, min(least(y1, y2)) AS b, max(greatest(x1, x2)) AS c,
  max(greatest(y1, y2)) AS e FROM ({EDGES}) WHERE poly_id IN ('NATION_1', 'NATION_2', 'NATION_5', 'NATION_9')) WHERE x BETWEEN a AND c AND y BETWEEN b AND e""",
    "enriched_records": enriched(),
}
ORACLE["saved_scaler"] = ORACLE["scaler_apply"]
