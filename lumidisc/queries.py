"""All registered queries but those of the corpus operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidisc.functions import color as C
from lumidisc.functions import geo as G
from lumidisc.functions import text as T
from lumidisc.operators import candidates, composite, dates, mirror, palette, segmentation, viewpoints
from lumidisc.plans import geometry, turntable
from lumidisc.raster import kernels as K
from lumidisc.raster.arrow import grid, grids, per_batch, per_image
from lumidisc.sinks import sheets
from lumidisc.sources import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, days: tuple[str, ...] = ()):
    """days: columns with days or times, which both sides give as text."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("string") for c in days}) if days else out

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in days)}) FROM ({sql})" if days else sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.pixels(read(spark, sf_dir, "embeddings"))


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).select("image_id", "row", "col", F.col("r").alias("grey"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.frames(read(spark, sf_dir, "events"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.images(read(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- SQL parts
LV = "lv AS (SELECT vec_id AS image_id, list_transform(embedding, lambda e: CAST(least(greatest(floor((CAST(e AS DOUBLE) + 0.6e0) / 1.2e0 * 255), 0), 255) AS INT)) AS l FROM embeddings)"
PX = LV + ', px AS (SELECT image_id, CAST(i // 8 AS INT) AS "row", CAST(i % 8 AS INT) AS col, l[i + 1] AS r, l[(i + 21) % 64 + 1] AS g, l[(i + 42) % 64 + 1] AS b FROM lv, range(64) t(i))'
LUM = "CAST(least(greatest(round_even(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b, 0), 0), 255) AS INT)"
CLOUD = "greatest(r, g, b) / 255e0 * pow(1 - CASE WHEN greatest(r, g, b) = 0 THEN 0e0 ELSE (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) END, 2)"
HSV = (
    PX
    + """, n AS (SELECT *, r / 255e0 AS x, g / 255e0 AS y, b / 255e0 AS z FROM px), m AS (SELECT *, greatest(x, y, z) AS v, greatest(x, y, z) - least(x, y, z) AS d FROM n),
hsv AS (SELECT *, CASE WHEN v = 0 THEN 0e0 ELSE d / v END AS s,
 (CASE WHEN d = 0 THEN 0e0 WHEN v = x THEN (y - z) / d - 6 * floor((y - z) / d / 6) WHEN v = y THEN (z - x) / d + 2 ELSE (x - y) / d + 4 END) / 6 AS h FROM m)"""
)
FR = "frames AS (SELECT event_id, 'disc_' || strftime(ts, '%Y%m%d%H%M%S') AS image, CAST(ts AS DATE) AS day, date_trunc('second', ts) AS captured, ((event_id * 7919) % 1801) / 10e0 - 90e0 AS lat, ((event_id * 104729) % 3600) / 10e0 - 180e0 AS lon, CAST(floor(abs(value) * 1000) AS BIGINT) AS bytes FROM events)"
COS = "(sin(radians({a})) * sin(radians({c})) + cos(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))"
DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1998-03-01' AND DATE '1998-10-14')"


def wrap_sql(x: str) -> str:
    return f"(({x}) + 180e0 - 360e0 * floor((({x}) + 180e0) / 360e0) - 180e0)"


def human_sql(n: str) -> str:
    return f"CASE WHEN {n} >= 1073741824 THEN printf('%.1f GiB', {n} / 1073741824e0) WHEN {n} >= 1048576 THEN printf('%.1f MiB', {n} / 1048576e0) WHEN {n} >= 1024 THEN printf('%.1f KiB', {n} / 1024e0) ELSE printf('%d B', {n}) END"


# ---------------------------------------------------------------- colour
@query(f"WITH {PX} SELECT image_id, row, col, {LUM} AS lum FROM px")
def luminance(spark, sf_dir):
    return px(spark, sf_dir).select("image_id", "row", "col", C.luminance(F.col("r"), F.col("g"), F.col("b")).alias("lum"))


@query(f"WITH {PX} SELECT image_id, row, col, round({CLOUD}, 9) AS score FROM px")
def cloud_score(spark, sf_dir):
    return px(spark, sf_dir).select("image_id", "row", "col", F.round(C.cloud_score(F.col("r"), F.col("g"), F.col("b")), 9).alias("score"))


@query(f"WITH {HSV} SELECT image_id, row, col, round(h, 9) AS h, round(s, 9) AS s, round(v, 9) AS v FROM hsv")
def rgb_hsv(spark, sf_dir):
    h, s, v = C.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    return px(spark, sf_dir).select("image_id", "row", "col", F.round(h, 9).alias("h"), F.round(s, 9).alias("s"), F.round(v, 9).alias("v"))


SEXTANT = """sx AS (SELECT *, CAST(floor(hh * 6) AS INT) % 6 AS k, hh * 6 - floor(hh * 6) AS f FROM {src}),
pq AS (SELECT *, vv * (1 - ss) AS p, vv * (1 - ss * f) AS q, vv * (1 - ss * (1 - f)) AS t FROM sx),
out AS (SELECT *, 255 * CASE k WHEN 0 THEN vv WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE vv END AS r2,
 255 * CASE k WHEN 0 THEN t WHEN 1 THEN vv WHEN 2 THEN vv WHEN 3 THEN q WHEN 4 THEN p ELSE p END AS g2,
 255 * CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN vv WHEN 4 THEN vv ELSE q END AS b2 FROM pq)"""


@query(f"WITH {HSV}, src AS (SELECT *, h AS hh, s AS ss, v AS vv FROM hsv), {SEXTANT.format(src='src')} SELECT image_id, row, col, round(r2, 6) AS r2, round(g2, 6) AS g2, round(b2, 6) AS b2 FROM out")
def hsv_rgb(spark, sf_dir):
    hsv = px(spark, sf_dir).withColumns(dict(zip("hsv", C.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")), strict=True)))
    r, g, b = C.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v"))
    return hsv.select("image_id", "row", "col", F.round(r, 6).alias("r2"), F.round(g, 6).alias("g2"), F.round(b, 6).alias("b2"))


VIB = "least(greatest(1 - pow(1 - s, 2.8e0), 0), 1)"
TONE = "least(greatest(0.5e0 + (pow(least(greatest((v - 0.05e0) / 0.95e0, 0), 1), 1 / 2.4e0) - 0.5e0) * 1.35e0, 0), 1)"
DELTA = "(h - 35e0 / 360 + 0.5e0 - floor(h - 35e0 / 360 + 0.5e0) - 0.5e0)"
LAND = f"(least(greatest(1 - abs({DELTA}) / (35e0 / 360), 0), 1) * least(greatest((s - 0.12e0) / 0.15e0, 0), 1) * least(greatest((0.55e0 - v) / (0.55e0 - 0.28e0), 0), 1))"


def _hsv(spark, sf_dir):
    return px(spark, sf_dir).withColumns(dict(zip("hsv", C.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")), strict=True)))


@query(f"WITH {HSV} SELECT image_id, row, col, round({VIB}, 9) AS x FROM hsv")
def grade_vibrance(spark, sf_dir):
    return _hsv(spark, sf_dir).select("image_id", "row", "col", F.round(C.vibrance(F.col("s"), 1.8), 9).alias("x"))


@query(f"WITH {HSV} SELECT image_id, row, col, round({TONE}, 9) AS x FROM hsv")
def grade_tone(spark, sf_dir):
    return _hsv(spark, sf_dir).select("image_id", "row", "col", F.round(C.tone(F.col("v"), C.Grade()), 9).alias("x"))


@query(f"WITH {HSV} SELECT image_id, row, col, round({LAND}, 9) AS x FROM hsv")
def grade_land(spark, sf_dir):
    return _hsv(spark, sf_dir).select("image_id", "row", "col", F.round(C.land_weight(F.col("h"), F.col("s"), F.col("v"), C.Grade()), 9).alias("x"))


@query(
    f"WITH {HSV}, src AS (SELECT *, h + {LAND} * 0.25e0 - floor(h + {LAND} * 0.25e0) AS hh, {VIB} AS ss, {TONE} AS vv FROM hsv), {SEXTANT.format(src='src')} "
    "SELECT image_id, row, col, " + ", ".join(f"CAST(least(greatest(round_even(round({c} * 0.25e0 + {c}2 * 0.75e0, 9), 0), 0), 255) AS INT) AS {c}3" for c in "rgb") + " FROM out"
)
def grade_full(spark, sf_dir):
    graded = C.grade(F.col("r"), F.col("g"), F.col("b"), C.Grade(amount=0.75))
    return px(spark, sf_dir).select("image_id", "row", "col", *(c.alias(f"{n}3") for n, c in zip("rgb", graded, strict=True)))


@query(f"WITH {PX} SELECT image_id, row, col, CAST(round_even((r * b + 20 * (255 - b)) / 255e0, 0) AS INT) AS flat FROM px")
def flatten_alpha(spark, sf_dir):
    return px(spark, sf_dir).select("image_id", "row", "col", C.flatten(F.col("r"), F.col("b"), 20).alias("flat"))


# ---------------------------------------------------------------- segmentation
@query(f"WITH {PX} SELECT image_id, r AS grey, count(*) AS n FROM px GROUP BY ALL")
def histogram(spark, sf_dir):
    return segmentation.histogram(grey(spark, sf_dir))


OTSU = (
    PX
    + """, ids AS (SELECT DISTINCT image_id FROM px), c AS (SELECT image_id, r, count(*) AS n FROM px GROUP BY ALL),
h AS (SELECT i.image_id, lev, coalesce(n, 0) AS n FROM ids i CROSS JOIN range(256) t(lev) LEFT JOIN c ON c.image_id = i.image_id AND c.r = lev),
s AS (SELECT *, sum(n) OVER w AS below, sum(n * lev) OVER w AS mass, sum(n) OVER (PARTITION BY image_id) AS total, sum(n * lev) OVER (PARTITION BY image_id) AS whole FROM h WINDOW w AS (PARTITION BY image_id ORDER BY lev ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, CASE WHEN below = 0 OR below = total THEN 0e0 ELSE pow(CAST(whole AS DOUBLE) * below - CAST(total AS DOUBLE) * mass, 2) / (CAST(below AS DOUBLE) * (total - below)) END AS split FROM s),
x AS (SELECT *, max(split) OVER (PARTITION BY image_id) AS best FROM v),
thr AS (SELECT image_id, CAST(round_even(avg(lev), 0) AS INT) AS threshold FROM x WHERE split >= best * (1 - 1e-12) GROUP BY image_id)"""
)


@query(f"WITH {OTSU} SELECT image_id, threshold FROM thr")
def otsu(spark, sf_dir):
    return segmentation.otsu(grey(spark, sf_dir))


QUALITY = (
    OTSU
    + """, a AS (SELECT image_id, count(*) FILTER (r > threshold) AS area, min(col) FILTER (r > threshold) AS l, min(row) FILTER (r > threshold) AS t, max(col) FILTER (r > threshold) + 1 AS rr, max(row) FILTER (r > threshold) + 1 AS bb FROM px JOIN thr USING (image_id) GROUP BY image_id),
k AS (SELECT *, NOT (area > 0 AND area >= 0.3e0 * 64) AS empty FROM a),
q AS (SELECT image_id, CASE WHEN empty THEN 0 ELSE area END AS area, empty, CASE WHEN NOT empty THEN greatest(l - 1, 0) END AS box_left, CASE WHEN NOT empty THEN greatest(t - 1, 0) END AS box_top, CASE WHEN NOT empty THEN least(rr + 1, 8) END AS box_right, CASE WHEN NOT empty THEN least(bb + 1, 8) END AS box_bottom,
 CASE WHEN empty THEN 0e0 ELSE area / 64e0 END AS coverage, CASE WHEN empty THEN 0e0 ELSE area / CAST((rr - l) * (bb - t) AS DOUBLE) END AS fill, CASE WHEN empty THEN 0e0 ELSE (rr - l) / CAST(bb - t AS DOUBLE) END AS aspect FROM k),
mq AS (SELECT *, round(greatest(abs(fill - pi() / 4) / (pi() / 4), abs(aspect - 1)), 9) AS deviation FROM q)"""
)


def _quality(spark, sf_dir):
    g = grey(spark, sf_dir)
    return segmentation.quality(g, segmentation.otsu(g), min_area=0.3, pad=1).withColumn("deviation", F.round("deviation", 9))


@query(f"WITH {QUALITY} SELECT image_id, area, empty, box_left, box_top, box_right, box_bottom, coverage, fill, aspect, deviation, NOT empty AND deviation < 0.12e0 AS is_disc FROM mq")
def mask_quality(spark, sf_dir):
    return _quality(spark, sf_dir)


@query(f"WITH {QUALITY} SELECT image_id, CASE WHEN image_id % 50 = 0 THEN 'unreadable' WHEN empty THEN 'no object found' WHEN abs(aspect - 1) >= abs(fill - pi() / 4) / (pi() / 4) THEN printf('aspect ratio %.3f', aspect) ELSE printf('fill ratio %.3f', fill) END AS reason FROM mq")
def review_reason(spark, sf_dir):
    error = F.when(F.col("image_id") % 50 == 0, "unreadable")
    return _quality(spark, sf_dir).select("image_id", T.review_reason(error, F.col("empty"), F.col("fill"), F.col("aspect")).alias("reason"))


@query(
    f"WITH {QUALITY}, o AS (SELECT CASE WHEN image_id % 50 = 0 THEN 'failed' WHEN image_id % 7 = 0 THEN 'skipped' WHEN empty THEN 'empty' ELSE 'ok' END AS status, NOT (NOT empty AND deviation < 0.12e0) AS needs_review FROM mq) "
    "SELECT count(*) AS found, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.replace('-', '_')}" for s in ("ok", "skipped", "empty", "failed", "dry-run")) + ", count(*) FILTER (needs_review) AS needs_review FROM o"
)
def status_counts(spark, sf_dir):
    status = F.when(F.col("image_id") % 50 == 0, "failed").when(F.col("image_id") % 7 == 0, "skipped").when(F.col("empty"), "empty").otherwise("ok")
    return segmentation.status_counts(_quality(spark, sf_dir).select(status.alias("status"), (~F.col("is_disc")).alias("needs_review")))


# ---------------------------------------------------------------- neighbourhoods (mask: level over 120)
MASK = PX + ", m AS (SELECT image_id, row, col FROM px WHERE r > 120)"
REACH = """RECURSIVE {px}, comp(image_id, row, col, root) AS (SELECT image_id, row, col, row * 8 + col FROM m UNION
 SELECT m.image_id, m.row, m.col, c.root FROM comp c JOIN m ON m.image_id = c.image_id AND abs(m.row - c.row) <= 1 AND abs(m.col - c.col) <= 1 WHERE c.root < m.row * 8 + m.col),
lab AS (SELECT image_id, row, col, min(root) AS label FROM comp GROUP BY ALL)"""
SET_SQL = "SELECT image_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM {}"


def _masked(spark, sf_dir, work):
    """work: from the masks of a batch of images to the pixels that are in the result."""

    def each(stack: np.ndarray) -> tuple[np.ndarray, dict]:
        of, row, col = np.nonzero(work(stack > 120))
        return of, {"row": row.astype(np.int32), "col": col.astype(np.int32)}

    return per_batch(dense(spark, sf_dir), each, "row int, col int", D.SIDE)


@query(f"WITH {REACH.format(px=MASK)}, sz AS (SELECT image_id, label, count(*) AS n FROM lab GROUP BY ALL), big AS (SELECT image_id, label FROM sz QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) = 1) SELECT lab.image_id, lab.row, lab.col FROM lab JOIN big USING (image_id, label)")
def components_largest(spark, sf_dir):
    return _masked(spark, sf_dir, K.largest)


@query(
    f"WITH RECURSIVE {MASK}, bg AS (SELECT image_id, row, col FROM px WHERE r <= 120), o(image_id, row, col) AS (SELECT image_id, row, col FROM bg WHERE row IN (0, 7) OR col IN (0, 7) UNION "
    "SELECT bg.image_id, bg.row, bg.col FROM o JOIN bg ON bg.image_id = o.image_id AND abs(bg.row - o.row) + abs(bg.col - o.col) = 1) SELECT image_id, row, col FROM px WHERE (image_id, row, col) NOT IN (SELECT image_id, row, col FROM o)"
)
def fill_holes(spark, sf_dir):
    return _masked(spark, sf_dir, K.fill_holes)


@query(f"WITH {MASK} SELECT DISTINCT image_id, CAST(row + dy AS INT) AS row, CAST(col + dx AS INT) AS col FROM m, range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE row + dy BETWEEN 0 AND 7 AND col + dx BETWEEN 0 AND 7")
def dilate(spark, sf_dir):
    return _masked(spark, sf_dir, lambda m: K.dilate(m, 1))


ERODED = "e AS (SELECT m.image_id, m.row, m.col FROM m JOIN m n ON n.image_id = m.image_id AND abs(n.row - m.row) <= 1 AND abs(n.col - m.col) <= 1 GROUP BY ALL HAVING count(*) = 9)"


@query(f"WITH {MASK}, {ERODED} SELECT image_id, row, col FROM e")
def erode(spark, sf_dir):
    return _masked(spark, sf_dir, lambda m: K.erode(m, 1))


@query(f"WITH {MASK}, {ERODED} SELECT image_id, row, col FROM m EXCEPT SELECT image_id, row, col FROM e")
def outline(spark, sf_dir):
    return _masked(spark, sf_dir, lambda m: m & ~K.erode(m, 1))


_W = [float(x) for x in K.gaussian_weights(0.5)]


def _blur_sql(src: str, axis: str, name: str) -> str:
    taps = ", ".join(f"({i - len(_W) // 2}, {w!r}e0)" for i, w in enumerate(_W))
    other = "col" if axis == "row" else "row"
    at = f"(s.{axis} + k.d)"
    mirrored = f"CASE WHEN {at} < 0 THEN -1 - {at} WHEN {at} > 7 THEN 15 - {at} ELSE {at} END"
    return f"{name} AS (SELECT s.image_id, s.row, s.col, CAST(floor(sum(k.w * n.v) + 1e-9) AS INT) AS v FROM {src} s CROSS JOIN (VALUES {taps}) k(d, w) JOIN {src} n ON n.image_id = s.image_id AND n.{other} = s.{other} AND n.{axis} = {mirrored} GROUP BY ALL)"


@query(f"WITH {PX}, g0 AS (SELECT image_id, row, col, r AS v FROM px), {_blur_sql('g0', 'row', 'g1')}, {_blur_sql('g1', 'col', 'g2')} SELECT image_id, row, col, v FROM g2")
def gaussian_blur(spark, sf_dir):
    return per_image(dense(spark, sf_dir), lambda im: grid(K.blur(im, 0.5)), "row int, col int, v int", D.SIDE)


@query(f"WITH {PX} SELECT image_id, CAST(o.i AS INT) AS row, CAST(p.j AS INT) AS col, r AS v FROM range(3) o(i), range(3) p(j), px WHERE row = CAST(floor((o.i + 0.5e0) * 8 / 3) AS INT) AND col = CAST(floor((p.j + 0.5e0) * 8 / 3) AS INT)")
def downsample_nearest(spark, sf_dir):
    return per_image(dense(spark, sf_dir), lambda im: grid(K.resize_nearest(im, 3)), "row int, col int, v int", D.SIDE)


def _rgba(image: np.ndarray) -> np.ndarray:
    """The image as all three channels, with itself, rotated by 21 places, as alpha."""
    return np.dstack((image, image, image, np.roll(image.ravel(), -21).reshape(image.shape)))


def _box_sql(size: int) -> str:
    over = lambda c, o: f"least({o} * 8e0 / {size} + 8e0 / {size}, {c} + 1) - greatest({o} * 8e0 / {size}, {c})"
    return (
        f"WITH {PX}, t AS (SELECT image_id, o.i, p.j, r, g AS a, ({over('row', 'o.i')}) * ({over('col', 'p.j')}) AS w FROM px, range({size}) o(i), range({size}) p(j) WHERE {over('row', 'o.i')} > 0 AND {over('col', 'p.j')} > 0), "
        "u AS (SELECT image_id, i, j, sum(w * a) AS wa, sum(w * a * r) AS war, sum(w) AS w FROM t GROUP BY ALL) "
        "SELECT image_id, CAST(i AS INT) AS row, CAST(j AS INT) AS col, CASE WHEN wa > 0 THEN round(war / wa, 6) ELSE 0e0 END AS v, round(wa / w, 6) AS alpha FROM u"
    )


def _boxed(spark, sf_dir, size: int, supersample: int = 1):
    def work(image: np.ndarray) -> dict:
        rgba = _rgba(image)
        mean = K.box_mean(K.resize_nearest(rgba, size * supersample) if supersample > 1 else rgba, size)
        return grid(image[:size, :size]) | {"v": mean[..., 0].ravel(), "alpha": mean[..., 3].ravel()}

    out = per_image(dense(spark, sf_dir), work, "row int, col int, v double, alpha double", D.SIDE)
    return out.withColumns({"v": F.round("v", 6), "alpha": F.round("alpha", 6)})


@query(_box_sql(4))
def supersample_mean(spark, sf_dir):
    return _boxed(spark, sf_dir, 4, supersample=2)


@query(_box_sql(3))
def downsample_box(spark, sf_dir):
    return _boxed(spark, sf_dir, 3)


@query(f"WITH {PX} SELECT image_id, CAST(row * 2 + dy AS INT) AS row, CAST(col * 2 + dx AS INT) AS col, r AS v FROM px, range(2) a(dy), range(2) b(dx)")
def upscale(spark, sf_dir):
    return per_image(dense(spark, sf_dir), lambda im: grid(K.upscale(im, 2)), "row int, col int, v int", D.SIDE)


SHEET = PX + ", n AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS k FROM lv), w AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM lv)"


@query(f"WITH {SHEET} SELECT CAST(row + (k // w) * 8 AS INT) AS y, CAST(col + (k % w) * 8 AS INT) AS x, r AS v FROM px JOIN n USING (image_id), w")
def contact_sheet(spark, sf_dir):
    order = D.numbered(dense(spark, sf_dir), "image_id", "k")
    return sheets.sheet_pixels(px(spark, sf_dir).join(order, "image_id"), order.count(), D.SIDE).select("y", "x", F.col("r").alias("v"))


# ---------------------------------------------------------------- palettes
SWATCHES = [(0, 0, 0), (60, 60, 60), (120, 120, 120), (200, 200, 200), (160, 90, 40), (40, 90, 160), (90, 140, 60)]


@query(f"WITH {PX} SELECT r, g, b, count(*) AS n FROM px GROUP BY ALL")
def palette_histogram(spark, sf_dir):
    return palette.color_histogram(px(spark, sf_dir))


@query(
    f"WITH {PX}, c AS (SELECT DISTINCT r, g, b FROM px), p(swatch, x, y, z) AS (VALUES {', '.join(str((i, *s)) for i, s in enumerate(SWATCHES))}), "
    "d AS (SELECT *, (r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z) AS d2 FROM c, p) SELECT r, g, b, swatch, d2 FROM d QUALIFY row_number() OVER (PARTITION BY r, g, b ORDER BY d2, swatch) = 1"
)
def palette_nearest(spark, sf_dir):
    return palette.nearest(px(spark, sf_dir), SWATCHES)


def _cut_round(k: int, most: int) -> str:
    return (
        f"h{k} AS (SELECT box, x.c AS c, x.v AS v, sum(n) AS n FROM (SELECT box, n, unnest([{{c: 0, v: r}}, {{c: 1, v: g}}, {{c: 2, v: b}}]) AS x FROM c{k}) GROUP BY ALL), "
        f"w{k} AS (SELECT *, sum(n) OVER (PARTITION BY box, c ORDER BY v) AS below, sum(n) OVER (PARTITION BY box, c) AS total, max(v) OVER (PARTITION BY box, c) AS top FROM h{k}), "
        f"s{k} AS (SELECT box, c, max(v) - min(v) AS spread, max(total) AS total, coalesce(min(v) FILTER (2 * below >= total AND v < top), max(v) FILTER (v < top)) AS cut FROM w{k} GROUP BY box, c), "
        f"b{k} AS (SELECT * FROM s{k} QUALIFY row_number() OVER (PARTITION BY box ORDER BY spread DESC, c) = 1), "
        f"t{k} AS (SELECT * FROM b{k} WHERE spread > 0 QUALIFY row_number() OVER (ORDER BY spread * total DESC, box) <= {most} - (SELECT count(*) FROM b{k})), "
        f"c{k + 1} AS (SELECT r, g, b, n, c{k}.box * 2 + CASE WHEN [r, g, b][t{k}.c + 1] > cut THEN 1 ELSE 0 END AS box FROM c{k} LEFT JOIN t{k} ON t{k}.box = c{k}.box)"
    )


@query(
    f"WITH {PX}, c0 AS (SELECT r, g, b, count(*) AS n, 0 AS box FROM px GROUP BY r, g, b), {', '.join(_cut_round(k, 16) for k in range(4))}, "
    "m AS (SELECT DISTINCT r, g, b FROM (SELECT box, " + ", ".join(f"CAST(round_even(sum({c} * n) / CAST(sum(n) AS DOUBLE), 0) AS INT) AS {c}" for c in "rgb") + " FROM c4 GROUP BY box)) "
    "SELECT CAST(row_number() OVER (ORDER BY r, g, b) - 1 AS INT) AS idx, r, g, b FROM m"
)
def palette_mediancut(spark, sf_dir):
    return palette.shared_palette(px(spark, sf_dir), 16)


_SPREAD = "list_transform({w}, lambda v, k: v + {e} * (CASE WHEN k = i + 2 AND i % 8 < 7 THEN 7e0 WHEN k = i + 8 AND i % 8 > 0 AND i < 56 THEN 3e0 WHEN k = i + 9 AND i < 56 THEN 5e0 WHEN k = i + 10 AND i % 8 < 7 AND i < 56 THEN 1e0 ELSE 0e0 END) / 16)"


@query(
    f"WITH RECURSIVE {LV}, swatches AS (SELECT [{', '.join(f'{{n: {n}, r: {r}e0, g: {g}e0, b: {b}e0}}' for n, (r, g, b) in enumerate(SWATCHES))}] AS s), "
    "st AS (SELECT image_id, 0 AS i, CAST(l AS DOUBLE[]) AS r, CAST(l AS DOUBLE[]) AS g, CAST(l AS DOUBLE[]) AS b, CAST([] AS DOUBLE[]) AS done FROM lv UNION ALL "
    f"SELECT image_id, i + 1, {_SPREAD.format(w='r', e='(x - c.r)')}, {_SPREAD.format(w='g', e='(y - c.g)')}, {_SPREAD.format(w='b', e='(z - c.b)')}, list_append(done, c.r) FROM ("
    "SELECT *, s[list_sort(list_transform(s, lambda p: {d: (p.r - x) * (p.r - x) + (p.g - y) * (p.g - y) + (p.b - z) * (p.b - z), n: p.n}))[1].n + 1] AS c FROM ("
    "SELECT *, least(greatest(r[i + 1], 0), 255) AS x, least(greatest(g[i + 1], 0), 255) AS y, least(greatest(b[i + 1], 0), 255) AS z FROM st, swatches WHERE i < 64))) "
    "SELECT image_id, CAST(j // 8 AS INT) AS row, CAST(j % 8 AS INT) AS col, CAST(done[j + 1] AS INT) AS v FROM st, range(64) t(j) WHERE i = 64"
)
def dither(spark, sf_dir):
    return per_batch(dense(spark, sf_dir), lambda stack: grids(K.quantize(np.stack((stack,) * 3, -1), np.array(SWATCHES, np.uint8), dither=True)[..., 0]), "row int, col int, v int", D.SIDE)


# ---------------------------------------------------------------- geometry
@query(f"WITH {FR} SELECT event_id, round(degrees(acos(least(greatest({COS.format(a='10e0', b='20e0', c='lat', d='lon')}, -1), 1))), 6) AS distance FROM frames")
def great_circle(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", F.round(G.great_circle(F.lit(10.0), F.lit(20.0), F.col("lat"), F.col("lon")), 6).alias("distance"))


@query(
    f"WITH {FR} SELECT event_id, round(100 + 80 * cos(radians(lat)) * sin(radians(lon - 20)), 6) AS x, round(100 - 80 * (cos(radians(10e0)) * sin(radians(lat)) - sin(radians(10e0)) * cos(radians(lat)) * cos(radians(lon - 20))), 6) AS y, "
    f"round({COS.format(a='10e0', b='20e0', c='lat', d='lon')}, 9) AS cos_c FROM frames"
)
def geo_forward(spark, sf_dir):
    x, y, c = G.project(F.col("lat"), F.col("lon"), *(F.lit(float(v)) for v in (10, 20, 100, 100, 80)))
    return frames(spark, sf_dir).select("event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(c, 9).alias("cos_c"))


@query(
    f"WITH {FR}, p AS (SELECT event_id, (lon / 180) AS x, (lat / 90) AS y FROM frames), r AS (SELECT *, sqrt(x * x + y * y) AS rho FROM p), c AS (SELECT *, asin(least(rho, 1)) AS c FROM r), "
    "g AS (SELECT *, degrees(asin(least(greatest(cos(c) * sin(radians(10e0)) + CASE WHEN rho = 0 THEN 0 ELSE y * sin(c) * cos(radians(10e0)) / rho END, -1), 1))) AS la, degrees(atan2(x * sin(c), rho * cos(radians(10e0)) * cos(c) - y * sin(radians(10e0)) * sin(c))) AS turn FROM c) "
    f"SELECT event_id, round(la, 5) AS lat, round({wrap_sql('20e0 + turn')}, 5) AS lon, rho <= 1 AS on_disc FROM g WHERE abs(rho - 1) > 1e-9"
)
def geo_inverse(spark, sf_dir):
    lat, lon, on = G.unproject(F.col("lon") / 180.0, F.lit(0.0) - F.col("lat") / 90.0, *(F.lit(float(v)) for v in (10, 20, 0, 0, 1)))
    rho = F.sqrt(F.pow(F.col("lon") / 180.0, F.lit(2)) + F.pow(F.col("lat") / 90.0, F.lit(2)))
    return frames(spark, sf_dir).where(F.abs(rho - 1) > 1e-9).select("event_id", F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"), on.alias("on_disc"))


CELL = "(90 - lat) / 180 * {h} - 0.5e0 AS fr, (lon + 180) / 360 * {w} - 0.5e0 - {w} * floor(((lon + 180) / 360 * {w} - 0.5e0) / {w}) AS fc"


@query(
    f"WITH {FR}, c AS (SELECT event_id, least(greatest(floor(fr + 0.5e0), 0), 35) AS y, floor(fc + 0.5e0) % 72 AS x FROM (SELECT event_id, {CELL.format(h=36, w=72)} FROM frames)) "
    "SELECT event_id, CAST(y AS INT) AS cell_row, CAST(x AS INT) AS cell_col, round(90 - (y + 0.5e0) / 36 * 180, 9) AS lat, round(-180 + (x + 0.5e0) / 72 * 360, 9) AS lon FROM c"
)
def cell_to_latlon(spark, sf_dir):
    """The centre of the cell that each frame looks at."""
    fr, fc = G.cell_at(F.col("lat"), F.col("lon"), 36, 72)
    y, x = F.least(F.greatest(F.floor(fr + 0.5), F.lit(0)), F.lit(35)).cast("int"), (F.floor(fc + 0.5) % 72).cast("int")
    lat, lon = G.cell_center(F.col("cell_row"), F.col("cell_col"), 36, 72)
    cells = frames(spark, sf_dir).select("event_id", y.alias("cell_row"), x.alias("cell_col"))
    return cells.select("event_id", "cell_row", "cell_col", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query(f"WITH {FR} SELECT event_id, round(fr, 6) AS fr, round(fc, 6) AS fc FROM (SELECT event_id, {CELL.format(h=36, w=72)} FROM frames)")
def latlon_to_cell(spark, sf_dir):
    fr, fc = G.cell_at(F.col("lat"), F.col("lon"), 36, 72)
    return frames(spark, sf_dir).select("event_id", F.round(fr, 6).alias("fr"), F.round(fc, 6).alias("fc"))


# ---------------------------------------------------------------- candidates and composite
NEAR = FR + (
    ", vp AS (SELECT CAST(i AS INT) AS vp, 12e0 AS a, i * 360e0 / 6 AS b FROM range(6) t(i)), "
    f"dist AS (SELECT vp, event_id, image, round(degrees(acos(least(greatest({COS.format(a='a', b='b', c='lat', d='lon')}, -1), 1))), 6) AS distance, degrees(acos(least(greatest({COS.format(a='a', b='b', c='lat', d='lon')}, -1), 1))) AS exact FROM vp, frames), "
    "near AS (SELECT vp, CAST(row_number() OVER (PARTITION BY vp ORDER BY distance, image, event_id) AS INT) AS rank, event_id, image, distance FROM dist WHERE exact < 2 * degrees(acos(0.35e0)) QUALIFY rank <= 48)"
)


def _near(spark, sf_dir):
    return candidates.nearest_frames(frames(spark, sf_dir), candidates.viewpoints(spark, 6, 12.0), 48)


@query(f"WITH {NEAR} SELECT * FROM near")
def candidate_topk(spark, sf_dir):
    return _near(spark, sf_dir)


@query(f"WITH {NEAR} SELECT image, vp, rank, event_id FROM near QUALIFY row_number() OVER (PARTITION BY image ORDER BY vp, rank) = 1")
def candidate_union(spark, sf_dir):
    return candidates.union_frames(_near(spark, sf_dir))


def _tap(y: str, x: str, k: int) -> str:
    return f"l[({y} * 8 + {x} + {k}) % 64 + 1]"


def _soft(k: int) -> str:
    """A bilinear sample of the channel that begins k places on."""
    return f"(({_tap('y0', 'x0', k)} * (1 - fx) + {_tap('y0', 'x1', k)} * fx) * (1 - fy) + ({_tap('y1', 'x0', k)} * (1 - fx) + {_tap('y1', 'x1', k)} * fx) * fy)"


_WHOLE = ", ".join(f"CAST(floor(least(greatest({c}, 0), 255) + 1e-6) AS INT) AS {c}" for c in "rgb")
SEEN = f"""{LV}, {FR}, f AS (SELECT event_id AS idx, lat, lon, l FROM frames JOIN lv ON lv.image_id = event_id % (SELECT count(*) FROM embeddings)),
cells AS (SELECT CAST(i // 72 AS INT) AS cell_row, CAST(i % 72 AS INT) AS cell_col, 90 - (i // 72 + 0.5e0) / 36 * 180 AS la, -180 + (i % 72 + 0.5e0) / 72 * 360 AS lo FROM range(2592) t(i)),
j AS (SELECT *, {COS.format(a='lat', b='lon', c='la', d='lo')} AS cos_c FROM cells, f),
p AS (SELECT *, 3.5e0 + 3.5e0 * cos(radians(la)) * sin(radians(lo - lon)) AS x, 3.5e0 - 3.5e0 * (cos(radians(lat)) * sin(radians(la)) - sin(radians(lat)) * cos(radians(la)) * cos(radians(lo - lon))) AS y FROM j WHERE cos_c >= 0.35e0),
q AS (SELECT cell_row, cell_col, idx, cos_c, l, CAST(floor(x) AS INT) AS x0, CAST(floor(y) AS INT) AS y0, x - floor(x) AS fx, y - floor(y) AS fy FROM p WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7),
t AS (SELECT *, least(x0 + 1, 7) AS x1, least(y0 + 1, 7) AS y1 FROM q),
o AS (SELECT cell_row, cell_col, idx, cos_c, {_soft(0)} AS sr, {_soft(21)} AS sg, {_soft(42)} AS sb FROM t),
c AS (SELECT cell_row, cell_col, idx, cos_c, sr, sg, sb, {_WHOLE} FROM (SELECT *, sr AS r, sg AS g, sb AS b FROM o)),
seen AS (SELECT cell_row, cell_col, idx, sr, sg, sb, round({CLOUD} + 0.5e0 * (1 - cos_c), 9) AS score FROM c WHERE {LUM} >= 30),
win AS (SELECT cell_row, cell_col, idx, sr AS r, sg AS g, sb AS b, score FROM seen QUALIFY row_number() OVER (PARTITION BY cell_row, cell_col ORDER BY score, idx) = 1)"""


def _seen(spark, sf_dir, k: int = 1):
    """What every frame of the table shows, with an image of the whole table; the best k of each cell and task."""
    discs = D.discs(read(spark, sf_dir, "events"), read(spark, sf_dir, "embeddings"))
    return composite.observed(discs.repartition(spark.sparkContext.defaultParallelism), 36, 72, blend_k=k, batch_rows=2000)


def _soft_rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 5) for c in "rgb"})


@query(f"WITH {SEEN} SELECT cell_row, cell_col, idx, round(r, 5) AS r, round(g, 5) AS g, round(b, 5) AS b, score FROM win")
def composite_winner(spark, sf_dir):
    return _soft_rounded(composite.winners(_seen(spark, sf_dir)))


@query(
    f"WITH {SEEN}, k AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY cell_row, cell_col ORDER BY score, idx) <= 3), m AS (SELECT *, min(score) OVER (PARTITION BY cell_row, cell_col) AS best FROM k), "
    "w AS (SELECT *, 1 / greatest(score, 1e-6) AS w FROM m WHERE score <= best * 1.5e0 + 1e-6) "
    "SELECT cell_row, cell_col, arg_min(idx, score + idx * 1e-18) AS idx, round(sum(sr * w) / sum(w), 5) AS r, round(sum(sg * w) / sum(w), 5) AS g, round(sum(sb * w) / sum(w), 5) AS b, count(*) AS n FROM w GROUP BY ALL"
)
def composite_blend(spark, sf_dir):
    return _soft_rounded(composite.blend(_seen(spark, sf_dir, 3)))


@query(f"WITH {SEEN} SELECT count(*) AS covered, round(count(*) / 2592e0, 9) AS share FROM win")
def grid_coverage(spark, sf_dir):
    return composite.coverage(composite.winners(_seen(spark, sf_dir)), 36, 72).withColumn("share", F.round("share", 9))


VIEW = f"""{LV}, {NEAR}, pix AS (SELECT CAST(i // 16 AS INT) AS "row", CAST(i % 16 AS INT) AS col, (i % 16 - 8) / 7e0 AS u, (8 - i // 16) / 7e0 AS v FROM range(256) t(i)),
rho AS (SELECT *, sqrt(u * u + v * v) AS rho, asin(least(sqrt(u * u + v * v), 1)) AS c FROM pix WHERE sqrt(u * u + v * v) <= 1),
place AS (SELECT vp, "row", col, degrees(asin(least(greatest(cos(c) * sin(radians(a)) + CASE WHEN rho = 0 THEN 0 ELSE v * sin(c) * cos(radians(a)) / rho END, -1), 1))) AS la, {wrap_sql('b + degrees(atan2(u * sin(c), rho * cos(radians(a)) * cos(c) - v * sin(radians(a)) * sin(c)))')} AS lo FROM vp, rho),
f AS (SELECT vp, rank AS idx, lat, lon, l FROM near JOIN frames USING (event_id) JOIN lv ON lv.image_id = event_id % (SELECT count(*) FROM embeddings)),
j AS (SELECT *, {COS.format(a='lat', b='lon', c='la', d='lo')} AS cos_c FROM place JOIN f USING (vp)),
p AS (SELECT *, 3.5e0 + 3.5e0 * cos(radians(la)) * sin(radians(lo - lon)) AS x, 3.5e0 - 3.5e0 * (cos(radians(lat)) * sin(radians(la)) - sin(radians(lat)) * cos(radians(la)) * cos(radians(lo - lon))) AS y FROM j WHERE cos_c >= 0.35e0),
q AS (SELECT vp, "row", col, idx, cos_c, l, CAST(floor(x) AS INT) AS x0, CAST(floor(y) AS INT) AS y0, x - floor(x) AS fx, y - floor(y) AS fy FROM p WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7),
t AS (SELECT *, least(x0 + 1, 7) AS x1, least(y0 + 1, 7) AS y1 FROM q),
o AS (SELECT vp, "row", col, idx, cos_c, {_soft(0)} AS sr, {_soft(21)} AS sg, {_soft(42)} AS sb FROM t),
c AS (SELECT vp, "row", col, idx, cos_c, sr, sg, sb, {_WHOLE} FROM (SELECT *, sr AS r, sg AS g, sb AS b FROM o)),
seen AS (SELECT vp, "row", col, idx, sr, sg, sb, round({CLOUD} + 0.5e0 * (1 - cos_c), 9) AS score FROM c WHERE {LUM} >= 30)"""


@query(f"WITH {VIEW} SELECT vp, \"row\", col, idx AS contributor, round(sr, 5) AS r, round(sg, 5) AS g, round(sb, 5) AS b FROM seen QUALIFY row_number() OVER (PARTITION BY vp, \"row\", col ORDER BY score, idx) = 1")
def render_independent(spark, sf_dir):
    """Each viewpoint from its own candidates; the pixels that any of them shows."""
    s = turntable.TurntableSettings(lat0=12.0, frames=6, radius=7)
    discs = D.discs(read(spark, sf_dir, "events"), read(spark, sf_dir, "embeddings"))
    near = _near(spark, sf_dir).join(F.broadcast(candidates.viewpoints(spark, 6, 12.0)), "vp").select("vp", "vp_lon", "rank", F.col("event_id").alias("idx"))
    return _soft_rounded(viewpoints.pixels(viewpoints.states(discs.join(viewpoints.asked(near, "idx"), "idx"), s), s))


def _points(spark, sf_dir):
    return frames(spark, sf_dir).select(F.col("event_id").alias("id"), "lat", "lon")


PLACED = f"pt AS (SELECT event_id AS id, least(greatest(fr, 0), 35) AS fr, fc FROM (SELECT event_id, {CELL.format(h=36, w=72)} FROM frames))"


@query(f"WITH {SEEN}, {PLACED}, tap AS (SELECT id, CAST(round_even(fr, 0) AS INT) AS y, CAST(round_even(fc, 0) AS INT) % 72 AS x FROM pt) SELECT id, round(r, 5) AS r, round(g, 5) AS g, round(b, 5) AS b FROM tap LEFT JOIN win ON y = cell_row AND x = cell_col")
def grid_nearest(spark, sf_dir):
    return _soft_rounded(composite.sample(_points(spark, sf_dir), composite.winners(_seen(spark, sf_dir)), 36, 72, nearest=True))


@query(
    f"WITH {SEEN}, {PLACED}, tap AS (SELECT id, least(CAST(floor(fr) AS INT) + dy, 35) AS y, (CAST(floor(fc) AS INT) + dx) % 72 AS x, (CASE dy WHEN 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE dx WHEN 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END) AS w FROM pt, range(2) a(dy), range(2) b(dx)) "
    "SELECT id, round(sum(w * coalesce(r, 0)), 5) AS r, round(sum(w * coalesce(g, 0)), 5) AS g, round(sum(w * coalesce(b, 0)), 5) AS b FROM tap LEFT JOIN win ON y = cell_row AND x = cell_col GROUP BY id"
)
def grid_bilinear(spark, sf_dir):
    return _soft_rounded(composite.sample(_points(spark, sf_dir), composite.winners(_seen(spark, sf_dir)), 36, 72))


# ---------------------------------------------------------------- dates
WANTED = "want AS (SELECT CAST(DATE '1994-12-01' + CAST(i * 60 AS INT) AS DATE) AS requested FROM range(45) t(i))"


@query(f"WITH {DAYS}, {WANTED} SELECT requested, d AS resolved, CAST(d - requested AS INT) AS snap_days FROM want, days QUALIFY row_number() OVER (PARTITION BY requested ORDER BY abs(d - requested), d) = 1", days=("requested", "resolved"))
def pick_explicit(spark, sf_dir):
    wanted = spark.range(45).select(F.date_add(F.lit("1994-12-01").cast("date"), (F.col("id") * 60).cast("int")).alias("requested"))
    return dates.pick_explicit(D.available(read(spark, sf_dir, "orders")), wanted)


@query(f"WITH {DAYS} SELECT d FROM days ORDER BY d DESC LIMIT 14", days=("d",))
def pick_last(spark, sf_dir):
    return dates.pick_last(D.available(read(spark, sf_dir, "orders")), 14)


@query(f"WITH {DAYS} SELECT d FROM days WHERE d BETWEEN DATE '1997-11-05' AND DATE '1998-12-24'", days=("d",))
def pick_range(spark, sf_dir):
    return dates.pick_range(D.available(read(spark, sf_dir, "orders")), "1997-11-05", "1998-12-24")


@query(
    f"WITH RECURSIVE {DAYS}, pool AS (SELECT list(d ORDER BY d) AS p FROM days WHERE d BETWEEN DATE '1998-01-01' AND DATE '1999-06-30'), "
    "st AS (SELECT 0 AS i, CAST(NULL AS DATE) AS requested, CAST(NULL AS DATE) AS resolved, p FROM pool UNION ALL SELECT i + 1, t, best, list_filter(p, lambda x: x <> best) FROM ("
    "SELECT *, list_sort(list_transform(p, lambda x: {gap: abs(x - t), d: x}))[1].d AS best FROM (SELECT *, CAST(DATE '1998-01-01' + CAST(round_even(i * (DATE '1999-06-30' - DATE '1998-01-01') / 23e0, 0) AS INT) AS DATE) AS t FROM st WHERE i < 24))) "
    "SELECT requested, resolved, CAST(resolved - requested AS INT) AS snap_days FROM st WHERE i > 0",
    days=("requested", "resolved"),
)
def pick_spread(spark, sf_dir):
    return dates.pick_spread(D.available(read(spark, sf_dir, "orders")), "1998-01-01", "1999-06-30", 24)


# ---------------------------------------------------------------- mirror
RAW = "raw AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'not_a_stamp' WHEN event_id % 13 = 0 THEN 'disc_20241399000000' ELSE 'disc_' || strftime(ts, '%Y%m%d%H%M%S') END AS image, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date FROM events)"


@query(f"WITH {RAW}, n AS (SELECT *, try_strptime(nullif(regexp_extract(image, '([0-9]{{14}})$', 1), ''), '%Y%m%d%H%M%S') AS named FROM raw) SELECT image, CAST(named AS DATE) AS archive_day, CASE WHEN date IS NOT NULL THEN coalesce(try_strptime(date, '%Y-%m-%d %H:%M:%S'), named) END AS captured FROM n WHERE named IS NOT NULL", days=("archive_day", "captured"))
def parse_frames(spark, sf_dir):
    e = F.col("event_id")
    image = F.when(e % 11 == 0, "not_a_stamp").when(e % 13 == 0, "disc_20241399000000").otherwise(F.concat(F.lit("disc_"), F.date_format("ts", "yyyyMMddHHmmss")))
    date = F.when(e % 7 == 0, F.lit(None)).when(e % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    raw = read(spark, sf_dir, "events").select(image.alias("image"), date.alias("date"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    return mirror.parse_frames(raw).select("image", "archive_day", F.col("captured").cast("timestamp_ntz").alias("captured"))


@query(f"WITH {FR} SELECT event_id, 'natural/' || strftime(day, '%Y/%m/%d') || '/png/' || image || '.png' AS path, 'natural/' || strftime(day, '%Y/%m/%d') || '/thumbs/' || image || '.jpg' AS thumb FROM frames")
def archive_path(spark, sf_dir):
    one = lambda form: T.archive_path(F.lit("natural"), F.col("day"), F.col("image"), form)
    return frames(spark, sf_dir).select("event_id", one("png").alias("path"), one("thumbs").alias("thumb"))


INV = FR + ", inv AS (SELECT image FROM frames WHERE event_id % 3 = 0), sizes AS (SELECT image, max(bytes) AS probed FROM frames WHERE event_id % 2 = 0 GROUP BY image)"


def _inv(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f, f.where("event_id % 3 = 0").select("image"), f.where("event_id % 2 = 0").groupBy("image").agg(F.max("bytes").alias("bytes"))


@query(f"WITH {INV} SELECT event_id, image FROM frames WHERE image IN (SELECT image FROM inv)")
def plan_present(spark, sf_dir):
    f, inv, _ = _inv(spark, sf_dir)
    return mirror.present(f, inv).select("event_id", "image")


@query(f"WITH {INV} SELECT event_id, image FROM frames WHERE image NOT IN (SELECT image FROM inv)")
def plan_missing(spark, sf_dir):
    f, inv, _ = _inv(spark, sf_dir)
    return mirror.missing(f, inv).select("event_id", "image")


@query(f"WITH {INV} SELECT count(*) AS files, CAST(sum(coalesce(probed, 2650000)) AS BIGINT) AS bytes FROM frames LEFT JOIN sizes USING (image) WHERE image NOT IN (SELECT image FROM inv)")
def plan_bytes(spark, sf_dir):
    f, inv, sizes = _inv(spark, sf_dir)
    return mirror.with_sizes(mirror.missing(f, inv), sizes, "png").agg(F.count("*").alias("files"), F.sum("need").cast("bigint").alias("bytes"))


SPAN = f"st AS (SELECT day, abs({wrap_sql('lon - lag(lon) OVER (PARTITION BY day ORDER BY captured, event_id)')}) AS step FROM frames), span AS (SELECT day, round(coalesce(sum(step), 0), 6) AS span FROM st GROUP BY day)"


@query(f"WITH {FR}, {SPAN} SELECT day, span FROM span", days=("day",))
def longitude_span(spark, sf_dir):
    return mirror.longitude_span(frames(spark, sf_dir))


@query(
    f"WITH {INV}, {SPAN}, d AS (SELECT day, count(*) AS frames, count(*) FILTER (image NOT IN (SELECT image FROM inv)) AS missing, CAST(coalesce(sum(CASE WHEN image NOT IN (SELECT image FROM inv) THEN coalesce(probed, 2650000) END), 0) AS BIGINT) AS bytes FROM frames LEFT JOIN sizes USING (image) GROUP BY day) "
    f"SELECT day, frames, missing, bytes, span, {human_sql('bytes')} AS size FROM d JOIN span USING (day)",
    days=("day",),
)
def plan_report_by_day(spark, sf_dir):
    return mirror.report_by_day(*_inv(spark, sf_dir), "png").select("day", "frames", "missing", "bytes", "span", "size")


@query(f"WITH {FR}, s AS (SELECT day, event_id, bytes, CAST(sum(bytes) OVER (ORDER BY day, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM frames) SELECT *, running <= 50000000 AS fits FROM s", days=("day",))
def budget_running(spark, sf_dir):
    return mirror.running_budget(frames(spark, sf_dir).select("day", "event_id", "bytes"), 50_000_000)


STATUS = "CASE event_id % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN 'current' WHEN 2 THEN 'failed' ELSE 'downloaded' END"


@query(f"WITH {FR}, r AS (SELECT {STATUS} AS status, bytes FROM frames) SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("downloaded", "skipped", "current", "failed")) + ", CAST(coalesce(sum(bytes) FILTER (status = 'downloaded'), 0) AS BIGINT) AS bytes FROM r")
def fetch_stats(spark, sf_dir):
    return mirror.fetch_stats(frames(spark, sf_dir).select(F.expr(STATUS).alias("status"), "bytes"))


@query(f"WITH {FR}, n AS (SELECT event_id, bytes * bytes AS n FROM frames) SELECT event_id, {human_sql('n')} AS size FROM n")
def human_bytes(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", T.human_bytes(F.col("bytes") * F.col("bytes")).alias("size"))


LITERALS = "CASE event_id % 6 WHEN 0 THEN event_id || 'KiB' WHEN 1 THEN event_id || ' kb' WHEN 2 THEN '1_' || event_id || 'M' WHEN 3 THEN event_id || '.5GB' WHEN 4 THEN event_id || 'x' ELSE 'many' END"


@query(f"SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN event_id * 1024 WHEN 1 THEN event_id * 1000 WHEN 2 THEN CAST('1' || event_id AS BIGINT) * 1048576 WHEN 3 THEN event_id * 1000000000 + 500000000 END AS BIGINT) AS bytes FROM events")
def parse_bytes(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", T.parse_bytes(F.expr(LITERALS)).alias("bytes"))


@query(f"WITH {FR}, s AS (SELECT strftime(captured, '%Y%m%d%H%M%S') AS stamp, event_id FROM frames) SELECT a.stamp, a.event_id AS natural, b.event_id AS cloud FROM s a JOIN s b USING (stamp) WHERE a.event_id % 2 = 0 AND b.event_id % 3 = 0")
def pair_by_stamp(spark, sf_dir):
    f = frames(spark, sf_dir)
    return mirror.pair_by_stamp(f.where("event_id % 2 = 0"), f.where("event_id % 3 = 0"))


@query(f"WITH {FR}, n AS (SELECT day, event_id, row_number() OVER (PARTITION BY day ORDER BY captured, event_id) - 1 AS k FROM frames) SELECT day, event_id, CAST(k AS INT) AS k FROM n WHERE k % 20 = 0", days=("day",))
def every_nth(spark, sf_dir):
    return dates.every_nth(frames(spark, sf_dir), 20).select("day", "event_id", "k")


ETAG = FR + ", e AS (SELECT 'natural/' || strftime(day, '%Y/%m/%d') || '/png/' || image || '.png' AS path, event_id, event_id % 4 AS m FROM frames), t AS (SELECT path, max('\"' || event_id || '\"') AS etag FROM e WHERE m = 0 GROUP BY path)"


@query(f"WITH {ETAG} SELECT event_id, etag FROM e LEFT JOIN t USING (path)")
def etag_lookup(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("path", T.archive_path(F.lit("natural"), F.col("day"), F.col("image"), "png"))
    tags = f.where("event_id % 4 = 0").groupBy("path").agg(F.max(F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"'))).alias("etag"))
    return mirror.with_etags(f, tags).select("event_id", "etag")


@query(f"WITH {FR}, cache AS (SELECT image, max(event_id % 100) AS radius FROM frames WHERE event_id % 3 = 1 GROUP BY image) SELECT event_id, CASE WHEN cache.image IS NULL THEN 'compute' ELSE 'cached' END AS found, CAST(radius AS BIGINT) AS radius FROM frames LEFT JOIN cache USING (image)")
def geometry_cache_lookup(spark, sf_dir):
    f = frames(spark, sf_dir)
    cache = f.where("event_id % 3 = 1").groupBy("image").agg(F.max(F.col("event_id") % 100).alias("radius"))
    return geometry.lookup(f, cache, ("image",)).select("event_id", "found", "radius")


@query(f"""WITH {FR} SELECT day, count(*) AS n, substr(sha256('{{"frames":' || count(*) || ',"source":"' || strftime(day, '%Y-%m-%d') || '"}}'), 1, 8) AS run_id FROM frames GROUP BY day""", days=("day",))
def run_id(spark, sf_dir):
    """A run for the frames of each day."""
    by_day = frames(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"))
    return by_day.withColumn("run_id", T.run_id_of(source=F.date_format("day", "yyyy-MM-dd"), frames=F.col("n")))
