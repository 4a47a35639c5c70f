"""Cameras from points: every row of ``lineitem`` is a point seen in the view of its supplier; ellipses from all events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelbase.functions.scalar import tidy
from voxelbase.plans import poses as P

R = lambda e, n=6: f"(round({e}, {n}) + 0.0)"
QUERIES, ORACLES = {}, {}
FOCAL, CU, CV = 1200.0, 512.0, 384.0


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def truth(view: Column) -> tuple[list[list[Column]], list[Column]]:
    """Rotation (turn about z, then tilt about x) and shift of a view."""
    a, b = view * 0.7, 0.4 * F.sin(view * 1.3)
    ca, sa, cb, sb = F.cos(a), F.sin(a), F.cos(b), F.sin(b)
    return [[ca, -sa, F.lit(0.0)], [cb * sa, cb * ca, -sb], [sb * sa, sb * ca, cb]], [5 * F.sin(view * 1.0), 4 * F.cos(view * 1.0), 400 + 10 * F.sin(view * 3.0)]


def points(spark, d, noise: float = 0.2) -> DataFrame:
    """(view, x, y, z, u, v): places from part, quantity and order, seen with up to half of ``noise`` pixels of error."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    view = F.col("l_suppkey")
    x, y, z = F.col("l_partkey") % 41 - 20.0, F.col("l_quantity").cast("double") - 25.0, F.col("l_orderkey") % 37 - 18.0
    r, t = truth(view)
    c = [r[k][0] * x + r[k][1] * y + r[k][2] * z + t[k] for k in range(3)]
    wrong = [(F.pmod(F.round(F.col("l_extendedprice") * m), F.lit(1000.0)) / 1000 - 0.4995) * noise for m in (100, 700)]
    u, v = (FOCAL * c[k] / c[2] + o + w for k, o, w in zip((0, 1), (CU, CV), wrong, strict=True))
    return li.select(view.alias("view"), x.alias("x"), y.alias("y"), z.alias("z"), u.alias("u"), v.alias("v"))


def _turn(rotation: Column, true) -> Column:
    """Degrees between a rotation and the true one."""
    trace = sum((rotation[3 * i + j] * true[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    return F.degrees(F.acos(F.least(F.lit(1.0), (trace - 1) / 2)))


@query("joint_poses", None)
def _(spark, d):
    """(view, points, turn off the truth in degrees, shift off it, cost); held against a dense fit of all unknowns in the tests."""
    rows, _ = P.joint_poses(points(spark, d))
    r, t = truth(F.col("view"))
    off = F.sqrt(sum(((F.col("translation")[k] - t[k]) * (F.col("translation")[k] - t[k]) for k in range(3)), F.lit(0.0)))
    return rows.select("view", "n", tidy(_turn(F.col("rotation"), r), 3).alias("turn"), tidy(off, 3).alias("shift"), tidy(F.col("cost"), 4).alias("cost"))


TRUTH_SQL = "SELECT DISTINCT l_suppkey AS view, l_suppkey * 0.7 AS a, 0.4 * sin(l_suppkey * 1.3) AS b FROM lineitem"


@query(
    "view_cameras",
    f"""WITH t AS ({TRUTH_SQL}), n AS (SELECT l_suppkey AS view, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 6)
SELECT view, n, {FOCAL} AS focal, {CU} AS cu, {CV} AS cv, {R('cos(a)', 4)} AS r00, {R('-sin(b)', 4)} AS r12, {R('cos(b)', 4)} AS r22, {R('400 + 10 * sin(view * 3.0)', 3)} AS tz FROM t JOIN n USING (view)""",
)
def _(spark, d):
    """Each view on its own from points without noise: the matrices' parts are those the points were made with."""
    c = P.cameras(points(spark, d, 0.0))
    r, t = F.col("rotation"), F.col("translation")
    return c.select("view", F.col("n").cast("long").alias("n"), tidy(F.col("fu"), 3).alias("focal"), tidy(F.col("cu"), 3).alias("cu"), tidy(F.col("cv"), 3).alias("cv"), tidy(r[0], 4).alias("r00"), tidy(r[5], 4).alias("r12"), tidy(r[8], 4).alias("r22"), tidy(t[2], 3).alias("tz"))


M_SQL = "SELECT vec_id AS view, list_transform(embedding, lambda q: q::double) AS e FROM embeddings"


@query(
    "split_cameras",
    f"""WITH e AS ({M_SQL}), g AS (SELECT view,
{', '.join(f"{' + '.join(f'e[{4 * i + k + 1}] * e[{4 * j + k + 1}]' for k in range(3))} AS g{i}{j}" for i in range(3) for j in range(i, 3))} FROM e),
c AS (SELECT view, g02 / g22 AS cu, g12 / g22 AS cv, g00 / g22 AS a, g01 / g22 AS b, g11 / g22 AS c FROM g), f AS (SELECT *, sqrt(c - cv * cv) AS fv, (b - cu * cv) / sqrt(c - cv * cv) AS skew FROM c)
SELECT view, {R('sqrt(a - cu * cu - skew * skew)', 5)} AS fu, {R('fv', 5)} AS fv, {R('skew', 5)} AS skew, {R('cu', 5)} AS cu, {R('cv', 5)} AS cv FROM f""",
)
def _(spark, d):
    """Inner parts of the matrix that the first twelve values of each embedding make; the SQL takes them from its Gram matrix."""
    m = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("view"), F.slice("embedding", 1, 12).alias("p"))
    return P.split_cameras(m).select("view", *(tidy(F.col(c), 5).alias(c) for c in ("fu", "fv", "skew", "cu", "cv")))


@query(
    "ellipse_fit",
    f"""SELECT user_id, count(*) AS n, {R('3.0 + user_id % 7', 4)} AS cy, {R('user_id % 11 - 4.0', 4)} AS cx, {R('5.0 + user_id % 5', 4)} AS major, {R('2.0 + user_id % 3', 4)} AS minor, {R('0.1 + user_id % 13 * 0.2', 4)} AS angle FROM events GROUP BY user_id HAVING count(*) >= 8""",
)
def _(spark, d):
    """Every event is a point on its user's ellipse; the fit gives back the ellipse."""
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("user_id")
    angle, a, b = 0.1 + k % 13 * 0.2, 5.0 + k % 5, 2.0 + k % 3
    turn = F.col("event_id") * 2.399963
    px, py = a * F.cos(turn), b * F.sin(turn)
    rows = e.select("user_id", (k % 11 - 4.0 + px * F.cos(angle) - py * F.sin(angle)).alias("x"), (3.0 + k % 7 + px * F.sin(angle) + py * F.cos(angle)).alias("y"))
    return P.ellipses(rows, "user_id").where("n >= 8").select("user_id", "n", *(tidy(F.col(c), 4).alias(c) for c in ("cy", "cx", "major", "minor", "angle")))
