"""RA: raster operators; an image is all vectors of one label, a vector is one image row."""

from pyspark.sql import functions as F

from ..functions.lexicon import KERNELS
from ..operators import raster as A
from ..plans.ordered import row_numbers
from ..plans.tables import table
from .base import query, r


def rows(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("image_id"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = row_numbers(e, ["image_id"], [F.col("vec_id")], F.floor(F.col("vec_id") / 100), "rn")
    return n.select("image_id", (F.col("rn") - 1).alias("y"), "v")


PX = """px AS MATERIALIZED (SELECT image_id, y, unnest(v)::DOUBLE AS v, (generate_subscripts(v, 1) - 1)::INT AS x FROM (
 SELECT label AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding AS v FROM embeddings)),
mb AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM px GROUP BY 1)"""


def conv(weights, scale, offset):
    vals = ", ".join(f"({dy - 1}, {dx - 1}, {weights[dy * 3 + dx]})" for dy in range(3) for dx in range(3))
    return f"""cv AS (SELECT p.image_id, p.y, p.x, sum(q.v * k.w) / {float(scale)} + {float(offset)} AS v FROM px p JOIN mb USING (image_id), (VALUES {vals}) k(dy, dx, w)
 JOIN px q ON TRUE WHERE q.image_id = p.image_id AND q.y = p.y + k.dy AND q.x = p.x + k.dx AND p.x > 0 AND p.x < mx AND p.y > 0 AND p.y < my GROUP BY 1, 2, 3)"""


def _conv(name):
    w, s, o = KERNELS[name]

    @query(f"RA-01-{name}", f"WITH {PX}, {conv(w, s, o)} SELECT image_id, y, x, round(v, 6) AS v FROM cv")
    def _(spark, d):
        out = A.convolve(rows(spark, d), name)
        return out.select("image_id", "y", F.posexplode("v").alias("x", "v")).select("image_id", "y", (F.col("x") + 1).alias("x"), r("v").alias("v"))


for _k in KERNELS:
    _conv(_k)

_BW = [1, 2, 1, 2, 4, 2, 1, 2, 1]


@query("RA-02", f"WITH {PX}, {conv(_BW, 16, 0)} SELECT image_id, y, x, round(v, 6) AS v FROM cv")
def _(spark, d):
    out = A.blur(rows(spark, d), 1)
    return out.select("image_id", "y", F.posexplode("v").alias("x", "v")).select("image_id", "y", (F.col("x") + 1).alias("x"), r("v").alias("v"))


def _remap(name, fn, x, y):
    @query(f"RA-03-{name}", f"WITH {PX} SELECT image_id, ({x})::BIGINT AS x, ({y})::BIGINT AS y, round(v, 6) AS v FROM px JOIN mb USING (image_id)")
    def _(spark, d):
        return fn(A.pixels(rows(spark, d))).select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), r("v").alias("v"))


_remap("rot90", lambda p: A.rotate(p, 1), "y", "mx - x")
_remap("rot180", lambda p: A.rotate(p, 2), "mx - x", "my - y")
_remap("rot270", lambda p: A.rotate(p, 3), "my - y", "x")
_remap("flip_lr", lambda p: A.flip(p, "left_right"), "mx - x", "y")
_remap("flip_tb", lambda p: A.flip(p, "top_bottom"), "x", "my - y")
_remap("transpose", A.transpose, "y", "x")


@query("RA-04", f"""WITH {PX}, s AS (SELECT image_id, least(1.0::DOUBLE, 16.0::DOUBLE / (greatest(mx, my) + 1)) AS s FROM mb)
SELECT image_id, floor(x * s)::BIGINT AS x, floor(y * s)::BIGINT AS y, round(avg(v), 8) AS v, count(*) AS n FROM px JOIN s USING (image_id) GROUP BY 1, 2, 3""")
def _(spark, d):
    return A.downsample(A.pixels(rows(spark, d)), 16).withColumn("v", r("v", 8))
