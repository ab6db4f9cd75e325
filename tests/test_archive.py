import datetime as dt
import glob
import json
import os
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumidisc import cli, queries
from lumidisc.functions import color as C
from lumidisc.functions import geo as G
from lumidisc.functions import text as T
from lumidisc.operators import candidates, composite, dates, viewpoints
from lumidisc.plans import mirror, segment_batch, sprites, turntable
from lumidisc.raster import kernels as K
from lumidisc.sinks import gif, png
from lumidisc.sources import images, metadata
from lumidisc.sources.http import ArchiveError, BudgetExceeded, Client, Pace, Response

SF = "/root/testdata/sf0.001"


def disc(size=120, radius=50, center=None, color=(60, 110, 190), noise=0, seed=0):
    y, x = np.mgrid[:size, :size]
    cy, cx = center or (size // 2, size // 2)
    out = np.zeros((size, size, 3), float)
    out[(y - cy) ** 2 + (x - cx) ** 2 <= radius**2] = color
    return K.to_uint8(out + np.random.default_rng(seed).normal(0, noise, out.shape)) if noise else out.astype(np.uint8)


def save(path, image):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(png.encode(image))


# oracle
@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(df):
    rows = [[None if pd.isna(v) else v for v in r] for r in df[sorted(df.columns)].astype(object).values.tolist()]
    return sorted(([str(v).removesuffix(" 00:00:00")[:19] if hasattr(v, "year") else f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_agree_with_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        want = duck.execute(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)
    else:
        assert len(got)


def test_sheet_and_sampled_grid_of_the_whole_table(spark):
    images = sorted((r["image_id"], r["levels"]) for r in queries.dense(spark, SF).collect())
    columns = int(np.ceil(np.sqrt(len(images))))
    want = {(n // columns * 8 + i // 8, n % columns * 8 + i % 8): v for n, (_, levels) in enumerate(images) for i, v in enumerate(levels)}
    got = [((r["y"], r["x"]), r["v"]) for r in queries.QUERIES["contact_sheet"](spark, SF).collect()]
    assert len(images) > 10 and len(got) == len(want) and dict(got) == want
    grid = {(r["cell_row"], r["cell_col"]): (r["r"], r["g"], r["b"]) for r in queries.QUERIES["composite_winner"](spark, SF).collect()}
    near = {r["id"]: (r["r"], r["g"], r["b"]) for r in queries.QUERIES["grid_nearest"](spark, SF).collect()}
    soft = {r["id"]: (r["r"], r["g"], r["b"]) for r in queries.QUERIES["grid_bilinear"](spark, SF).collect()}
    points = queries.frames(spark, SF).select("event_id", "lat", "lon").collect()
    assert len(points) == len(near) == len(soft)
    for p in points:
        y, x = min(max((90 - p["lat"]) / 180 * 36 - 0.5, 0), 35), ((p["lon"] + 180) / 360 * 72 - 0.5) % 72
        if min(abs(y % 1 - 0.5), abs(x % 1 - 0.5)) > 1e-6:
            assert near[p["event_id"]] == grid.get((round(y), round(x) % 72), (None,) * 3)
        taps = [(min(int(y) + i, 35), (int(x) + j) % 72, (y % 1 if i else 1 - y % 1) * (x % 1 if j else 1 - x % 1)) for i in (0, 1) for j in (0, 1)]
        for c in range(3):
            assert soft[p["event_id"]][c] == pytest.approx(sum(w * grid.get((a, b), (0, 0, 0))[c] for a, b, w in taps), abs=1e-4)


# kernels
def test_segment_of_a_disc():
    s = K.segment(disc(200, 50, (100, 100)), sigma=0)
    assert s.tight == (50, 50, 151, 151) and abs(s.fill - np.pi / 4) < 0.02 and s.is_disc
    assert K.segment(disc(200, 50, (100, 100)), pad=10, sigma=0).box == (40, 40, 161, 161)
    notch = disc(200, 50, (100, 100))
    notch[:, 115:] = 0
    assert not K.segment(notch).is_disc
    hole = disc(200, 50, (100, 100))
    hole[95:105, 95:105] = 0
    assert K.segment(hole).mask[100, 100] and not K.segment(hole, holes=False).mask[100, 100]
    dot = np.zeros((200, 200, 3), np.uint8)
    dot[3, 3] = 255
    assert K.segment(dot, min_area=0.001, sigma=0).box is None and K.segment(np.zeros((60, 60, 3), np.uint8), threshold=40).box is None


def test_otsu_takes_the_middle_of_ties():
    assert K.otsu(np.array([[10] * 5 + [200] * 5], np.uint8)) == round(np.arange(10, 200).mean())
    assert K.otsu(np.zeros((0, 0), np.uint8)) == 0


def test_labels_and_holes_equal_a_flood():
    r = np.random.default_rng(0)
    for _ in range(60):
        m = r.random((9, 11)) < 0.45
        for eight in (True, False):
            got, want, n = K.label(m, eight), np.zeros(m.shape, int), 0
            for y, x in zip(*np.nonzero(m), strict=True):
                if not want[y, x]:
                    n += 1
                    todo = [(y, x)]
                    while todo:
                        a, b = todo.pop()
                        if 0 <= a < 9 and 0 <= b < 11 and m[a, b] and not want[a, b]:
                            want[a, b] = n
                            todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if eight or i == 0 or j == 0]
            assert (got == want).all()


def test_shrink_and_grow():
    m = np.zeros((12, 12), bool)
    m[3:9, 3:9] = True
    assert K.dilate(m, 2).sum() == 100 and K.erode(m, 2).sum() == 4 and not K.erode(np.ones((5, 5), bool), 1)[0].any()


def test_resampling_and_palettes():
    r = np.random.default_rng(4)
    rgba = r.integers(0, 256, (60, 60, 4)).astype(np.uint8)
    for method in ("nearest", "box"):
        assert K.downsample(rgba, 16, method, 2).shape == (16, 16, 4)
    with pytest.raises(ValueError):
        K.downsample(rgba, 16, "magic")
    flat = np.full((9, 9, 4), (90, 140, 60, 255), np.uint8)
    assert (K.resize_box(flat, 4) == flat[0, 0]).all()
    clear = flat.copy()
    clear[:, :4] = (255, 0, 0, 0)
    assert (K.resize_box(clear, 3)[..., :3][K.resize_box(clear, 3)[..., 3] > 0] == (90, 140, 60)).all()
    colors, n = np.unique(rgba[..., :3].reshape(-1, 3), axis=0, return_counts=True)
    palette = K.median_cut(colors, n, 12)
    assert len(palette) <= 12 and len(np.unique(K.quantize(rgba[..., :3], palette, True).reshape(-1, 3), axis=0)) <= 12
    assert (K.upscale(rgba, 3)[::3, ::3] == rgba).all()


@pytest.mark.parametrize("tag", range(1, 9))
def test_orientation_tags(tag):
    image = np.arange(6).reshape(2, 3, 1).astype(np.uint8)
    turned = {1: image, 2: image[:, ::-1], 3: image[::-1, ::-1], 4: image[::-1], 5: image.swapaxes(0, 1), 6: np.rot90(image, -1), 7: np.rot90(image.swapaxes(0, 1), 2), 8: np.rot90(image, 1)}
    assert (K.orient(image, tag) == turned[tag]).all()
    entry = struct.pack("<HHIHH", 274, 3, 1, tag, 0)
    tiff = b"II*\0" + struct.pack("<IH", 8, 1) + entry
    assert images.orientation(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda\0\2") == tag


def test_png_and_gif(spark, tmp_path):
    r = np.random.default_rng(1)
    for shape in ((5, 7, 1), (6, 3, 3), (4, 9, 4)):
        image = r.integers(0, 256, shape).astype(np.uint8)
        assert (png.decode(png.encode(image)) == image).all()
    save(str(tmp_path / "a.png"), disc(40, 15))
    row = images.read_images(spark, str(tmp_path)).first().asDict()
    assert (images.array_of(row) == disc(40, 15)).all()
    frames = [r.integers(0, 256, (20, 20, 3)).astype(np.uint8) // 64 * 64 for _ in range(3)]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.gif").write_bytes(gif.encode(frames))
    row = images.read_images(spark, str(tmp_path / "g")).first().asDict()
    assert (images.array_of(row) == frames[0]).all() and gif.encode([]) == b""


# columns
def test_projection_round_trip(spark):
    r = np.random.default_rng(2)
    rows = [(float(lat0), float(lon0), float(x), float(y)) for lat0, lon0 in ((0, 0), (23.4, -120), (-23.4, 179), (89, 45)) for x, y in zip(*(r.uniform(-70, 70, 300) for _ in range(2)), strict=True) if x * x + y * y < 98**2]
    df = spark.createDataFrame(rows, "a double, b double, x double, y double")
    place = (F.col("a"), F.col("b"), F.lit(0.0), F.lit(0.0), F.lit(100.0))
    lat, lon, on = G.unproject(F.col("x"), F.col("y"), *place)
    df = df.select("*", lat.alias("lat"), lon.alias("lon"), on.alias("on"))
    col, row, _ = G.project(F.col("lat"), F.col("lon"), *place)
    worst = df.select(F.max(F.abs(col - F.col("x"))), F.max(F.abs(row - F.col("y"))), F.min(F.col("on").cast("int"))).first()
    assert worst[0] < 1e-6 and worst[1] < 1e-6 and worst[2] == 1


def test_dense_and_column_colours_agree(spark):
    r = np.random.default_rng(3)
    rgb = r.integers(0, 256, (400, 3))
    df = spark.createDataFrame([tuple(map(int, x)) for x in rgb], "r int, g int, b int")
    graded = df.select(*C.grade(F.col("r"), F.col("g"), F.col("b")), C.cloud_score(F.col("r"), F.col("g"), F.col("b"))).collect()
    dense = sprites.dense_grade(rgb[None].astype(np.uint8), sprites.SpriteSettings())[0]
    assert np.abs(np.array([x[:3] for x in graded]) - dense).max() <= 1
    assert np.allclose([x[3] for x in graded], turntable.dense_score(rgb))
    with pytest.raises(NotImplementedError):
        C.SCORERS["cloudfraction"](F.col("r"), F.col("g"), F.col("b"))


def test_sizes(spark):
    df = spark.createDataFrame([("10GiB",), ("1_000 kb",), (".5k",), ("7",), ("x",)], "t string")
    assert [x[0] for x in df.select(T.parse_bytes(F.col("t"))).collect()] == [10 << 30, 1_000_000, 512, 7, None]
    assert cli.byte_size("1.5MiB") == 3 << 19
    with pytest.raises(Exception, match="not a size"):
        df.select(T.parse_bytes(F.col("t"), strict=True)).collect()


# dates
def test_picking_days():
    year = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(366)]
    found = dates.spread(year, year[0], year[-1], 12)
    assert len({b for _, b in found}) == 12 and found[0][1] == year[0] and found[-1][1] == year[-1]
    few = [dt.date(2024, 1, d) for d in (9, 10, 11)]
    assert [b for _, b in dates.spread(few, dt.date(2024, 1, 1), dt.date(2024, 1, 20), 3)] == few
    assert [b for _, b in dates.spread(few, dt.date(2024, 1, 1), dt.date(2024, 1, 20), 2)] == [few[0], few[2]]
    assert dates.spread(year, year[0], year[-1], 1)[0][1] in (dt.date(2024, 7, 1), dt.date(2024, 7, 2))
    assert dates.spread([], year[0], year[-1], 3) == []


def test_candidates_are_bounded(spark):
    frames = queries.frames(spark, SF)
    near = candidates.nearest_frames(frames, candidates.viewpoints(spark, 4), 5)
    assert near.groupBy("vp").count().agg(F.max("count")).first()[0] == 5
    plan = near._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "WindowGroupLimit" in plan


# metadata
def test_frame_index(spark, tmp_path):
    day = tmp_path / "natural/2024/01/01"
    day.mkdir(parents=True)
    entries = [{"image": "disc_20240101003633", "date": "2024-01-01 00:31:45", "centroid_coordinates": {"lat": 5.0, "lon": -170.0}}, {"image": "disc_20240101020000", "date": "soon"}, {}, {"image": "not_a_timestamp"}, {"image": "disc_20241399000000"}]
    (day / "metadata.json").write_text(json.dumps(entries))
    other = tmp_path / "natural/2024/01/02"
    other.mkdir()
    (other / "metadata.json").write_text("no json {")
    rows = metadata.frame_index(spark, str(tmp_path)).orderBy("image").collect()
    assert [(str(r["archive_day"]), str(r["captured"]), r["lat"]) for r in rows] == [("2024-01-01", "2024-01-01 00:31:45", 5.0), ("2024-01-01", "2024-01-01 02:00:00", None)]
    (day / "x.part").write_text("12345")
    plan = metadata.inventory(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    assert metadata.mirror_bytes(spark, str(tmp_path)) == sum(len(p.read_text()) for p in (day / "metadata.json", other / "metadata.json"))


# http
class Server:
    """Answers from a list for each path, the last again and again; sleeps move its clock."""

    def __init__(self, **answers):
        self.answers, self.asked, self.now, self.slept = answers, [], 0.0, []

    def __call__(self, method, url, headers):
        key = url.split("//h/")[1]
        self.asked.append((method, key, headers))
        queue = self.answers[key] if key in self.answers else [Response(404)]
        found = queue.pop(0) if len(queue) > 1 else queue[0]
        found = found(headers) if callable(found) else found
        return Response(found.status, dict(found.headers), list(found.chunks))

    def sleep(self, s):
        self.slept.append(s)
        self.now += s

    def client(self, **more):
        return Client("http://h", transport=self, clock=lambda: self.now, sleep=self.sleep, delay=0, **more)


def test_pace():
    s = Server()
    p = Pace(2.0, lambda: s.now, s.sleep)
    p.wait()
    s.now += 0.5
    p.wait()
    assert s.slept == [1.5]


def test_retries_and_downloads(tmp_path):
    body = b"0123456789"
    ok = Response(200, {"Content-Length": "10", "ETag": "e1"}, [body])
    s = Server(a=[Response(503), Response(429, {"Retry-After": "7"}), ok], j=[Response(200, {}, [b"{"]), Response(200, {}, [b"[1]"])], gone=[Response(404)], down=[Response(500)], h=[Response(200, {"Content-Length": "12"})])
    c = s.client(retries=2)
    target = str(tmp_path / "x/a.png")
    assert c.download("a", target) == ("downloaded", 10, "e1") and s.slept == [1.0, 7.0] and open(target, "rb").read() == body
    assert c.get_json("j") == [1] and c.content_length("h") == 12 and c.content_length("gone") is None
    with pytest.raises(ArchiveError):
        c.get_json("gone")
    with pytest.raises(ArchiveError):
        c.get_json("down")
    s.answers["a"] = [Response(304)]
    assert c.download("a", target, etag="e1")[0] == "current" and s.asked[-1][2]["If-None-Match"] == "e1"


def test_resume_and_truncation(tmp_path):
    target = str(tmp_path / "a")
    open(f"{target}.part", "wb").write(b"01234")
    rest = lambda h: Response(206, {"Content-Length": "5"}, [b"56789"]) if h.get("Range") == "bytes=5-" else Response(500)
    assert Server(a=[rest]).client().download("a", target)[1] == 5 and open(target, "rb").read() == b"0123456789"
    open(f"{target}2.part", "wb").write(b"xx")
    assert Server(a=[Response(200, {"Content-Length": "3"}, [b"abc"])]).client().download("a", f"{target}2")[1] == 3 and open(f"{target}2", "rb").read() == b"abc"
    with pytest.raises(ArchiveError):
        Server(a=[lambda h: Response(200, {"Content-Length": "9"}, [b"abc"]) if "Range" not in h else Response(206, {"Content-Length": "6"}, [])]).client(retries=1).download("a", f"{target}3")
    assert not os.path.exists(f"{target}3")


def archive():
    names = {dt.date(2024, 1, d): [f"disc_202401{d:02d}0{h}0000" for h in range(3)] for d in (1, 2)}
    answers = {"api/natural/available": [Response(200, {}, [json.dumps([*map(str, names), "junk", str(min(names))]).encode()])]}
    for day, images_ in names.items():
        answers[f"api/natural/date/{day}"] = [Response(200, {}, [json.dumps([{"image": i} for i in images_]).encode()])]
        for i in images_:
            answers[mirror.remote("natural", "png", day, i)] = [Response(200, {"Content-Length": "100", "ETag": i}, [b"x" * 100])]
    return Server(**answers), names


def test_plan_and_fetch(tmp_path):
    server, names = archive()
    root, c = str(tmp_path), server.client()
    assert mirror.available_dates(c, "natural", root) == sorted(names)
    plan = mirror.build_plan(c, root, "natural", "png", [*names, min(names)])
    assert len(plan.missing) == 6 and plan.download_bytes == 600
    with pytest.raises(BudgetExceeded):
        mirror.fetch(c, plan, root, max_bytes=100)
    stats = mirror.fetch(c, plan, root)
    assert (stats.downloaded, stats.bytes, stats.failed) == (6, 600, 0)
    asked = len(server.asked)
    again = mirror.build_plan(c, root, "natural", "png", list(names))
    assert mirror.fetch(c, again, root).skipped == 6 and len(server.asked) == asked  # no request at all
    big = mirror.build_plan(c, root, "natural", "png", list(names), force=True)
    stopped = mirror.fetch(c, big, root, max_bytes=plan_bytes(root) + 650, force=True)
    assert not stopped.stopped
    big.sizes = dict.fromkeys(big.sizes, 10)
    assert mirror.fetch(c, big, root, max_bytes=plan_bytes(root) + 150, force=True).stopped


def plan_bytes(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, n in os.walk(root) for f in n)


def test_fetch_command(tmp_path, capsys):
    server, _ = archive()
    a = cli.parser().parse_args(["fetch", "http://h", "--root", str(tmp_path), "--date", "2024-01-05"])
    assert cli.run_fetch(a, server.client()) == 0
    out = capsys.readouterr().out
    assert "3 days off" in out and "3 downloaded" in out
    a.max_bytes, a.force = 10, True
    assert cli.run_fetch(a, server.client()) == 2


# plans
def test_batch(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    save(str(source / "a.png"), disc())
    save(str(source / "b.png"), np.zeros((60, 60, 3), np.uint8))
    save(str(source / "nested/a.png"), disc(120, 40))
    save(str(source / ".hidden.png"), disc())
    save(str(source / "outputs/c.png"), disc())
    (source / "corrupt.png").write_bytes(b"nothing")
    (source / "notes.txt").write_text("x")
    run, found = segment_batch.process(spark, str(source), out, segment_batch.Settings(threshold=40), recursive=True)
    status = {r["input"]: r["status"] for r in found.collect()}
    assert status == {"a.png": "ok", "b.png": "empty", "nested/a.png": "ok", "corrupt.png": "failed"}
    cut = png.decode(open(f"{run}/cutouts/nested/a.png.png", "rb").read())
    assert cut.shape[2] == 4 and not cut[cut[..., 3] == 0][:, :3].any() and os.path.exists(f"{run}/overlays/a.png.png")
    told = json.load(open(f"{run}/manifest.json"))
    assert told["counts"]["ok"] == 2 and told["counts"]["failed"] == 1 and os.path.realpath(f"{out}/latest") == run
    again = {r["input"]: r for r in segment_batch.process(spark, str(source), out, segment_batch.Settings(threshold=40), recursive=True)[1].collect()}
    assert again["a.png"]["status"] == "skipped" and again["a.png"]["fill"] > 0.7
    reasons = {r["input"]: r["reason"] for r in segment_batch.review(found).collect()}
    assert reasons["corrupt.png"] == "cannot be decoded" and reasons["b.png"] == "no object found"
    with pytest.raises(NotADirectoryError):
        segment_batch.process(spark, str(tmp_path / "none"), out)
    assert "looks like a full disc" in segment_batch.report(disc())


def tiny_mirror(root):
    for day, lons in (("2024/01/01", (-170, -100, -30, 40, 110, 170)), ("2024/06/01", (-150, -80, -10, 60, 130))):
        entries = []
        for h, lon in enumerate(lons):
            name = f"disc_{day.replace('/', '')}{h:02d}0000"
            entries.append({"image": name, "date": f"{day.replace('/', '-')} {h:02d}:00:00", "centroid_coordinates": {"lat": 5.0, "lon": float(lon)}})
            save(f"{root}/natural/{day}/png/{name}.png", disc(120, 50, color=(60 + h * 10, 110, 190), noise=2, seed=h))
        with open(f"{root}/natural/{day}/metadata.json", "w") as f:
            json.dump(entries, f)


def test_turntable_and_sprites(spark, tmp_path):
    root = str(tmp_path / "mirror")
    tiny_mirror(root)
    s = turntable.TurntableSettings(frames=4, radius=40, max_candidates=10)
    run, report = turntable.render_all(spark, root, str(tmp_path / "out"), s)
    rows = report.collect()
    told = json.load(open(f"{run}/manifest.json"))
    assert len(rows) == 4 and told["candidates"] == 11 and told["reference_coverage"] > 0.6
    frame = png.decode(open(f"{run}/frames/frame_000.png", "rb").read())
    assert frame.shape == (86, 86, 4) and set(np.unique(frame[..., 3])) <= {0, 255}
    blended, _ = turntable.render_all(spark, root, str(tmp_path / "out"), turntable.TurntableSettings(frames=2, radius=40, blend_k=3), write_gif=False, write_sheet=False)
    grid = spark.read.parquet(f"{blended}/grid")
    assert grid.count() == grid.select("cell").distinct().count() and blended != run
    with pytest.raises(KeyError):
        turntable.render_all(spark, root, str(tmp_path / "out"), turntable.TurntableSettings(scorer="none"))
    made, sizes = sprites.render_all(spark, f"{run}/frames", str(tmp_path / "art"), sprites.SpriteSettings(sizes=(8, 16), colors=8, display_scale=2))
    assert [(r["size"], r["frames"], r["output_size"]) for r in sizes.collect()] == [(8, 4, 16), (16, 4, 32)]
    colors = {tuple(c) for i in range(4) for c in png.decode(open(f"{made}/16/frame_{i:03d}.png", "rb").read())[..., :3].reshape(-1, 3)}
    assert len(colors) <= 8 and os.path.exists(f"{made}/rotation_8.gif")
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        sprites.render_all(spark, str(tmp_path / "none"), str(tmp_path / "art"))


def test_one_place_has_one_colour_in_all_frames(spark):
    """All viewpoints sample one grid, so a place never changes between frames."""
    s = turntable.TurntableSettings(radius=60)
    grid = np.random.default_rng(5).integers(0, 256, (60, 120, 3)).astype(np.uint8)
    seen = set()
    for lon0 in (-10.0, 0.0, 10.0):
        col, row, _ = turntable.dense_project(np.array([20.0]), np.array([5.0]), 0.0, lon0, 65, 65, 60)
        lat, lon, on = turntable.dense_unproject(col, row, 0.0, lon0, 65, 65, 60)
        seen.add(tuple(K.to_uint8(K.bilinear(grid, (90 - lat) / 180 * 60 - 0.5, np.mod((lon + 180) / 360 * 120 - 0.5, 120), wrap=True))[0]))
    assert len(seen) == 1 and turntable.render(grid, np.ones((60, 120), bool), 0.0, s)[1] == 0


def test_winner_is_whole_and_least_cloudy(spark):
    """Each winner is an observation that occurred, and no other has a smaller score."""
    seen = queries._seen(spark, SF).cache()
    from lumidisc.operators import composite

    best = composite.winners(seen)
    assert best.join(seen, ["cell_row", "cell_col", "idx", "r", "g", "b", "score"], "left_anti").count() == 0
    assert best.alias("a").join(seen.alias("b"), ["cell_row", "cell_col"]).where("b.score < a.score").count() == 0
    mean = composite.blend(seen)
    limits = seen.groupBy("cell_row", "cell_col").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    assert mean.join(limits, ["cell_row", "cell_col"]).where("r < low - 1e-6 OR r > high + 1e-6").count() == 0


QUADRANTS = {"NW": (20, 60, 140), "NE": (160, 140, 90), "SW": (30, 90, 40), "SE": (200, 170, 120)}


def quadrants(cloudy=(), colors=None):
    """A disc of four flat colours with cloud over some, as large as the viewpoint's."""
    half = round(60 * 1.08)
    y, x = np.mgrid[: 2 * half, : 2 * half]
    out = np.zeros((2 * half, 2 * half, 3), np.uint8)
    for name, color in (colors or QUADRANTS).items():
        out[((y < half) == (name[0] == "N")) & ((x < half) == (name[1] == "W")) & ((y - half) ** 2 + (x - half) ** 2 <= 60**2)] = (250, 250, 250) if name in cloudy else color
    return out


def from_candidates(spark, images, **settings):
    """(rgba, contributor, suspect share) of one viewpoint from frames that were taken from there."""
    s = turntable.TurntableSettings(radius=60, frames=1, **settings)
    half = round(60 * 1.08)
    rows = [(0, 0.0, n, 0.0, 0.0, float(half), float(half), 60.0, 2 * half, 2 * half, 3, image.tobytes()) for n, image in enumerate(images)]
    df = spark.createDataFrame(rows, "vp int, vp_lon double, rank int, lat double, lon double, cx double, cy double, radius double, height int, width int, channels int, data binary")
    r = turntable.render_views(df, s).first()
    return np.frombuffer(r["rgba"], np.uint8).reshape(2 * half, 2 * half, 4), np.frombuffer(r["contributor"], "<i2").reshape(2 * half, 2 * half), r["suspect_fraction"]


SPOTS = {"NW": (45, 45), "NE": (45, 85), "SW": (85, 45), "SE": (85, 85)}


def test_independent_viewpoints_take_clear_quadrants_whole(spark):
    rgba, who, suspect = from_candidates(spark, [quadrants(("NW", "NE")), quadrants(("SW", "SE"))])
    assert {n: tuple(rgba[at][:3].tolist()) for n, at in SPOTS.items()} == QUADRANTS
    assert {n: int(who[at]) for n, at in SPOTS.items()} == {"NW": 1, "NE": 1, "SW": 0, "SE": 0}
    assert not rgba[0, 0].any() and who[0, 0] == -1 and 0 < suspect < 0.2  # the rim is beyond the caps
    rgba, who, _ = from_candidates(spark, [quadrants(tuple(QUADRANTS)), quadrants()])
    inner = rgba[30:64, 30:64].reshape(-1, 4)
    assert {tuple(c) for c in inner[inner[:, 3] > 0][:, :3].tolist()} == {QUADRANTS["NW"]} and who[45, 45] == 1
    pale, white = ({k: (v,) * 3 for k in QUADRANTS} for v in (235, 255))
    assert from_candidates(spark, [quadrants(colors=white), quadrants(colors=pale)])[0][45, 45, :3].tolist() == [235] * 3
    dark = {k: (5, 5, 5) for k in QUADRANTS}
    assert tuple(from_candidates(spark, [quadrants(colors=dark), quadrants()])[0][45, 45, :3]) == QUADRANTS["NW"]
    rgba, _, suspect = from_candidates(spark, [quadrants(colors=dark)])
    assert suspect == 1 and not rgba[..., 3].any()


def test_independent_blend_is_convex(spark):
    brighter = {k: tuple(c + 10 for c in v) for k, v in QUADRANTS.items()}
    rgba, _, _ = from_candidates(spark, [quadrants(), quadrants(colors=brighter)], blend_k=2, blend_margin=2.0)
    low = np.array(QUADRANTS["NW"])
    assert (rgba[45, 45, :3] > low).any() and (rgba[45, 45, :3] >= low).all() and (rgba[45, 45, :3] <= low + 10).all()
    with pytest.raises(ValueError):
        from_candidates(spark, [quadrants()], blend_k=0)


def direct_view(frames, lon0, s):
    """Every observation of every pixel, sorted: {position: (colours of the blend, rank of the best)}. Nothing is kept or merged."""
    half, seen = round(s.radius * s.margin), {}
    for rank, lat, lon, cx, cy, radius, image in frames:
        for row, col in np.ndindex(2 * half, 2 * half):
            la, lo, on = turntable.dense_unproject(np.array(float(col)), np.array(float(row)), s.lat0, lon0, half, half, s.radius)
            x, y, cos_c = composite.dense_project(la, lo, lat, lon, cx, cy, radius)
            if on and cos_c >= s.min_cos and 0 <= x <= image.shape[1] - 1 and 0 <= y <= image.shape[0] - 1:
                bright, rgb, score = composite.sampled(image, *(np.array([float(v)]) for v in (y, x, cos_c)), s.scorer, s.luminance_floor, s.obliqueness_penalty)
                if len(bright):
                    seen.setdefault((row, col), []).append((score[0], rank, rgb[0]))
    out = {}
    for at, found in seen.items():
        best = sorted(found, key=lambda o: o[:2])[: s.blend_k]
        near = [o for o in best if o[0] <= best[0][0] * s.blend_margin + 1e-6]
        weight = [1 / max(o[0], 1e-6) for o in near]
        out[at] = sum(w * o[2] for w, o in zip(weight, near, strict=True)) / sum(weight), best[0][1]
    return out


DISC_COLUMNS = "lat double, lon double, cx double, cy double, radius double, height int, width int, channels int, data binary"


@pytest.mark.parametrize("k", [1, 3])
def test_viewpoints_from_merged_tiles_equal_all_observations(spark, monkeypatch, k):
    s = turntable.TurntableSettings(lat0=12.0, radius=9, blend_k=k, blend_margin=1.8)
    rng, lons = np.random.default_rng(7), (0.0, 35.0, 170.0)
    frames = [(float(lat), float(lon), 8.0, 8.0, 7.5, rng.integers(0, 256, (17, 17, 3), dtype=np.uint8)) for lat, lon in zip(rng.uniform(-30, 30, 12), rng.uniform(-180, 180, 12), strict=True)]
    frames += [frames[0], (0.0, 0.0, 8.0, 8.0, 7.5, np.zeros((17, 17, 3), np.uint8))]  # a repeated image, and a dark one
    rows = [([(v, lon, n) for v, lon in enumerate(lons)], *f[:5], 17, 17, 3, f[5].tobytes()) for n, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "serves array<struct<vp int, vp_lon double, rank int>>, " + DISC_COLUMNS)
    want = {(v, *at): (rgb, who) for v, lon in enumerate(lons) for at, (rgb, who) in direct_view([(n, *f) for n, f in enumerate(frames)], lon, s).items()}
    assert len(want) > 500
    for parts, held in ((1, viewpoints.HELD), (5, viewpoints.HELD), (3, 1)):  # the last sends each tile on at once
        seen = viewpoints.states(df.repartition(parts), s, held=held)
        got = {(r["vp"], r["row"], r["col"]): r for r in viewpoints.pixels(seen, s).collect()}
        assert got.keys() == want.keys() and all(got[at]["contributor"] == who for at, (_, who) in want.items())
        assert max(abs(np.array([got[at][c] for c in "rgb"]) - rgb).max() for at, (rgb, _) in want.items()) < 1e-9
    assert seen.count() >= 3 * len(frames) - 3
    whole = {r["vp"]: r for r in turntable.render_frames(df, s).collect()}
    for (v, row, col), (rgb, who) in want.items():
        at = row * 2 * round(9 * 1.08) + col
        assert np.frombuffer(whole[v]["contributor"], "<i2")[at] == who and abs(np.frombuffer(whole[v]["rgba"], np.uint8)[4 * at : 4 * at + 3] - rgb).max() <= 0.5 + 1e-6


def test_viewpoints_of_several_tiles_and_of_nothing(spark):
    s = turntable.TurntableSettings(radius=170)  # two tiles
    half, places = viewpoints.disc(170, 1.08)
    assert viewpoints.TILE < len(places) < 2 * viewpoints.TILE
    image = np.full((2 * half, 2 * half, 3), (40, 120, 200), np.uint8)
    row = lambda vp, image: ([(vp, 0.0, 1)], 0.0, 0.0, float(half), float(half), 170.0, 2 * half, 2 * half, 3, image.tobytes())
    schema = "serves array<struct<vp int, vp_lon double, rank int>>, " + DISC_COLUMNS
    got = {r["vp"]: r for r in turntable.render_frames(spark.createDataFrame([row(0, image), row(4, image * 0)], schema), s).collect()}
    rgba = np.frombuffer(got[0]["rgba"], np.uint8).reshape(2 * half, 2 * half, 4)
    col, line = np.meshgrid(np.arange(2 * half) - half, half - np.arange(2 * half))
    cap = np.sqrt(np.clip(1 - (col**2 + line**2) / 170**2, 0, None)) >= s.min_cos + 1e-9
    assert (rgba[cap] == (40, 120, 200, 255)).all() and not rgba[~cap & (np.hypot(col, line) > 171)].any()
    assert got[4]["suspect_fraction"] == 1 and not any(got[4]["rgba"]) and set(np.frombuffer(got[4]["contributor"], "<i2")) == {-1}
    assert turntable.render_frames(spark.createDataFrame([], schema), s).count() == 0
    with pytest.raises(ValueError):
        viewpoints.states(spark.createDataFrame([], schema), turntable.TurntableSettings(blend_k=2), whole=True)


def test_independent_rendering_shuffles_no_images(spark, tmp_path):
    root = str(tmp_path / "mirror")
    tiny_mirror(root)
    plan = turntable.render_independent(spark, root, turntable.TurntableSettings(frames=3, radius=20, max_candidates=10))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    depth = lambda line: max(line.find("+- "), line.find(":- "))
    at = next(i for i, line in enumerate(lines) if "FileScan image" in line)
    above, now = [], depth(lines[at])
    for line in reversed(lines[:at]):  # from the scan to the root of the plan
        if depth(line) < now:
            above.append(line)
            now = depth(line)
    seen = next(i for i, line in enumerate(above) if "MapInArrow each(serves" in line)
    assert not [line for line in above[:seen] if "Exchange" in line]
    keys = [line.split("Exchange ")[1].split(",")[0] for line in above if "Exchange" in line]
    assert len(keys) == 2 and keys[0].startswith("hashpartitioning(vp") and "SortMergeJoin" not in "".join(above)


def test_independent_rendering_of_a_mirror(spark, tmp_path):
    root = str(tmp_path / "mirror")
    tiny_mirror(root)
    s = turntable.TurntableSettings(frames=3, radius=20, max_candidates=10)
    rows = {r["vp"]: r for r in turntable.render_independent(spark, root, s).collect()}
    assert sorted(rows) == [0, 1, 2] and all(0 <= r["suspect_fraction"] < 1 and len(r["rgba"]) == 44 * 44 * 4 for r in rows.values())
    assert turntable.render_independent(spark, str(tmp_path / "mirror"), turntable.TurntableSettings(frames=2, radius=20, max_candidates=1)).count() == 2


def test_run_ids_of_columns_are_those_of_settings(spark):
    rows = [("natural", 3, True), ('quote" \\ \u00e9', -1, False), ("", 0, None), (None, 7, True)]
    df = spark.createDataFrame(rows, "source string, frames long, force boolean")
    got = df.withColumn("id", T.run_id_of(source=F.col("source"), frames=F.col("frames"), force=F.col("force"))).collect()
    assert [r["id"] for r in got] == [T.run_id(force=f, frames=n, source=s) for s, n, f in rows] and len({r["id"] for r in got}) == 4


def test_geometry_is_remembered(spark, tmp_path, monkeypatch):
    from lumidisc.plans import geometry

    root, settings = str(tmp_path), segment_batch.Settings()
    for name, image in (("a", disc(200, 50)), ("b", np.zeros((60, 60, 3), np.uint8))):
        save(f"{root}/{name}.png", image)
    (tmp_path / "c.png").write_bytes(b"nothing")
    frames = spark.createDataFrame([("natural", n, f"{root}/{n}.png", i) for i, n in enumerate("abc")], "collection string, image string, path string, idx int")
    images.small_batches(spark)
    found, new = geometry.located(spark, root, frames, settings)
    (r,) = found.collect()
    assert new == 3 and r["image"] == "a" and abs(r["cx"] - 100) < 2 and abs(r["cy"] - 100) < 2 and abs(r["radius"] - 50) < 2
    again, new = geometry.located(spark, root, frames, settings)
    assert new == 0 and again.collect() == [r]  # nothing is segmented, not even what had no disc
    assert geometry.stored(spark, root, settings).count() == 3
    assert geometry.located(spark, root, frames, segment_batch.Settings(pad=20))[1] == 3  # other settings, other entries
    assert geometry.located(spark, root, frames.where("image = 'z'"), settings)[1] == 0


def test_inspection_of_pairs(spark, tmp_path):
    from lumidisc.plans import inspect_pairs

    root = str(tmp_path / "mirror")
    for n in range(14):
        day, stamp = f"2024/01/{n + 1:02d}", f"202401{n + 1:02d}030000"
        save(f"{root}/natural/{day}/png/disc_{stamp}.png", disc())
        if n != 3:
            other = disc(color=(200, 200, 200))
            if n % 2 == 0:  # a chart, no disc
                other[:], other[20:40, 10:100] = 0, (9, 99, 9)
            save(f"{root}/cloud/{day}/png/cloud_{stamp}.png", other)
    found = inspect_pairs.pairs(spark, root)
    assert found.count() == 13
    sheet = str(tmp_path / "sheet.png")
    rows = {r["stamp"]: r for r in inspect_pairs.inspect(spark, root, sheet).collect()}
    days = [n + 1 for n in range(14) if n != 3]
    assert sorted(rows) == [f"202401{d:02d}030000" for d in days[::2][:6]]  # 13 pairs: every second, six at most
    assert all(r["is_disc"] == (int(s[6:8]) % 2 == 0) and r["colors"] >= 1 for s, r in rows.items())
    image = png.decode(open(sheet, "rb").read())
    assert image.shape == (2 * inspect_pairs.THUMB, 6 * inspect_pairs.THUMB, 3) and image.any()
    os.makedirs(f"{root}/aerosol")
    assert inspect_pairs.inspect(spark, root, other="aerosol").count() == 0
    with pytest.raises(ValueError):
        inspect_pairs.inspect(spark, root, other="natural")
    (tmp_path / "repo/.git").mkdir(parents=True)
    (tmp_path / "repo/a/b").mkdir(parents=True)
    assert inspect_pairs.find_root(str(tmp_path / "repo/a/b")) == str(tmp_path / "repo")


def test_degrees_swept_and_the_default_ceiling():
    assert mirror.degrees_swept([170.0, -170.0, 150.0]) == 60 and mirror.degrees_swept([5.0]) == 0
    a = cli.parser().parse_args(["fetch", "http://h"])
    assert a.max_bytes == 10 << 30


def test_resume_checks_what_it_gets(tmp_path):
    """A part of another file isn't carried on."""
    target = str(tmp_path / "a")
    open(f"{target}.part", "wb").write(b"01234")
    open(f"{target}.part.etag", "w").write('"e1"')
    wrong = lambda h: Response(206, {"Content-Range": "bytes 2-9/10", "Content-Length": "8"}, [b"23456789"])
    s = Server(a=[wrong, Response(200, {"Content-Length": "3", "ETag": '"e2"'}, [b"abc"])])
    assert s.client().download("a", target)[1] == 3 and open(target, "rb").read() == b"abc" and not os.path.exists(f"{target}.part.etag")
    assert s.asked[0][2]["If-Range"] == '"e1"' and "Range" not in s.asked[1][2]


def test_every_nth_stops_after_some(spark):
    found = dates.every_nth(queries.frames(spark, SF), 3, 2)
    assert {r["k"] for r in found.select("k").distinct().collect()} == {0, 3}


def test_streamed_days(spark, tmp_path):
    from lumidisc.streaming import frames

    root = str(tmp_path / "mirror")
    tiny_mirror(root)
    q = frames.daily_counts(frames.stream_index(spark, root)).writeStream.outputMode("update").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.sql("SELECT max(frames) AS n FROM days GROUP BY day").collect()) == [5, 6]


def test_commands(spark, tmp_path, capsys):
    save(str(tmp_path / "in/a.png"), disc())
    assert zlib.crc32(b"") == 0 and cli.selected([dt.date(2024, 1, 1)], cli.parser().parse_args(["fetch", "x"])) == [(dt.date(2024, 1, 1),) * 2]
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["batch"])
    with pytest.raises(ValueError):
        sprites.parse_sizes(",")
    assert sprites.parse_sizes("8, 16,") == (8, 16) and cli.human(1536) == "1.5 KiB"


def test_entry_has_all_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_sql_functions(spark):
    from lumidisc.functions import sql

    assert "disc_pixels" in sql.register(spark)
    df = queries.px(spark, SF).limit(500)
    df.createOrReplaceTempView("px")
    own = df.select(C.luminance(F.col("r"), F.col("g"), F.col("b")), F.round(C.cloud_score(F.col("r"), F.col("g"), F.col("b")), 9)).collect()
    assert sorted(own) == sorted(spark.sql("SELECT disc_luminance(r, g, b), round(disc_cloud_score(r, g, b), 9) FROM px").collect())
    assert spark.sql("SELECT round(disc_great_circle(0D, 0D, 0D, 90D), 9), disc_wrap_lon(180D), disc_looks_round(0.785D, 1D)").first()[:] == (90.0, -180.0, True)
    assert spark.sql("SELECT * FROM disc_pixels(X'010203040506', 1, 2, 3)").collect()[1][:] == (0, 1, 4, 5, 6)


# stores and resumable runs
def test_geometry_of_other_formats_and_changed_files(spark, tmp_path):
    """Another format of an image, a replaced file and a repaired one are measured; nothing else is."""
    from lumidisc.plans import geometry

    root, settings = str(tmp_path), segment_batch.Settings()
    save(f"{root}/a.png", disc(200, 50))
    (tmp_path / "b.png").write_bytes(b"nothing")

    def run(*names):
        frames = spark.createDataFrame([("natural", n.split(".")[0], f"{root}/{n}") for n in names], "collection string, image string, path string")
        found, new = geometry.located(spark, root, frames, settings)
        return {r["path"].rsplit("/", 1)[1]: round(r["radius"]) for r in found.collect()}, new

    assert run("a.png", "b.png") == ({"a.png": 50}, 2)
    save(f"{root}/a.bmp", disc(50, 20))  # its bytes tell its format
    assert run("a.png", "a.bmp", "b.png") == ({"a.png": 50, "a.bmp": 20}, 1)
    save(f"{root}/a.png", disc(120, 40))
    assert run("a.png", "a.bmp") == ({"a.png": 40, "a.bmp": 20}, 1)
    save(f"{root}/b.png", disc(120, 30))
    assert run("a.png", "a.bmp", "b.png") == ({"a.png": 40, "a.bmp": 20, "b.png": 30}, 1)
    assert run("a.png", "a.bmp", "b.png")[1] == 0


def test_a_store_with_many_writers(spark, tmp_path):
    from lumidisc.sinks.versions import Versions

    table = Versions(spark, f"{tmp_path}/store", "k int, v int, at int", ("k",), "at")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v int, at int")
    assert table.read().count() == 0 and table.merge() is None
    table.add(rows((1, 10, 1), (2, 20, 1)))
    table.add(rows((1, 11, 2)))
    before = table.folders()
    table.add(rows((3, 30, 3)))  # while another run merges what was there before
    table._add(table.newest(table.read(before)), before)
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 11, 2), (2, 20, 1), (3, 30, 3)]
    one, other = table.folders(), table.folders()  # two merges at once
    table._add(table.newest(table.read(one)), one)
    table._add(table.newest(table.read(other)), other)
    assert sorted(tuple(r) for r in table.newest(table.read()).collect()) == [(1, 11, 2), (2, 20, 1), (3, 30, 3)]
    table.merge()
    assert len(table.folders()) == 1 and table.read().count() == 3
    rows((9, 9, 9)).write.parquet(f"{tmp_path}/store/data/half")  # a run that ended before its entry
    assert table.read().count() == 3


def by_input(found):
    rows = [(r["input"], r["status"]) for r in found.collect()]
    assert len(rows) == len({i for i, _ in rows})
    return dict(rows)


def test_batches_over_a_growing_folder(spark, tmp_path):
    """Two calls over a folder that grows come to what one call comes to; images come in micro-batches."""
    source, settings = tmp_path / "in", segment_batch.Settings(threshold=40)
    for n in "abc":
        save(str(source / f"{n}.png"), disc(60, 20))
    told = []
    first = segment_batch.process(spark, str(source), str(tmp_path / "one"), settings, files_per_batch=2, on_progress=lambda *x: told.append(x))[1]
    assert by_input(first) == dict.fromkeys(("a.png", "b.png", "c.png"), "ok") and [x[:2] for x in told] == [(1, 3), (2, 3), (3, 3)]
    for n in "de":
        save(str(source / f"{n}.png"), disc(60, 25))
    os.utime(source / "e.png", (10**9, 10**9))  # an old file that comes late
    (source / "f.png").write_bytes(b"nothing")
    run, second = segment_batch.process(spark, str(source), str(tmp_path / "one"), settings, files_per_batch=2)
    assert by_input(second) == {"a.png": "skipped", "b.png": "skipped", "c.png": "skipped", "d.png": "ok", "e.png": "ok", "f.png": "failed"}
    whole_run, whole = segment_batch.process(spark, str(source), str(tmp_path / "two"), settings)
    numbers = lambda df: sorted((r["input"], r["fill"], r["output"]) for r in df.collect())
    assert numbers(second) == numbers(whole) and sorted(os.listdir(f"{run}/cutouts")) == sorted(os.listdir(f"{whole_run}/cutouts"))
    save(str(source / "f.png"), disc(60, 20))  # repaired, and known to the stream
    assert by_input(segment_batch.process(spark, str(source), str(tmp_path / "one"), settings)[1])["f.png"] == "ok"
    dry = by_input(segment_batch.process(spark, str(source), str(tmp_path / "three"), settings, dry_run=True)[1])
    assert set(dry.values()) == {"dry-run"} and len(dry) == 6 and not (tmp_path / "three").exists()
    assert set(by_input(segment_batch.process(spark, str(source), str(tmp_path / "one"), settings, force=True)[1]).values()) == {"ok"}


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_batch_that_breaks_off_is_made_once(spark, tmp_path, monkeypatch, when):
    source, settings = tmp_path / "in", segment_batch.Settings(threshold=40)
    for n in "abcd":
        save(str(source / f"{n}.png"), disc(60, 20))
    write = segment_batch.Outcomes.write

    def broken(self, rows, batch):
        if batch == 1 and when == "before":
            raise RuntimeError("lost")
        out = write(self, rows, batch)
        if batch == 1:
            raise RuntimeError("lost")  # its outcomes are there, but the checkpoint doesn't know that
        return out

    monkeypatch.setattr(segment_batch.Outcomes, "write", broken)
    with pytest.raises(Exception, match="lost"):
        segment_batch.process(spark, str(source), str(tmp_path / "out"), settings, files_per_batch=1)
    monkeypatch.setattr(segment_batch.Outcomes, "write", write)
    run, found = segment_batch.process(spark, str(source), str(tmp_path / "out"), settings, files_per_batch=1)
    assert sorted(by_input(found)) == ["a.png", "b.png", "c.png", "d.png"]
    rows = segment_batch.Outcomes(spark, run).read().collect()
    assert len(rows) == 4 and {r["status"] for r in rows} == {"ok"}


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names}


def test_files_land_by_commit(spark, tmp_path):
    from lumidisc.sinks.landing import LandingWriter, land_files

    root = f"{tmp_path}/out"
    rows = [(f"{i % 3}/f{i}.bin", bytes([i]) * i) for i in range(20)]
    land_files(spark.createDataFrame(rows, "path string, content binary").repartition(4), root)
    assert tree(root) == dict(rows)
    land_files(spark.createDataFrame([("0/f0.bin", b"new"), ("empty", None)], "path string, content binary"), f"file://{root}")
    assert tree(root) == dict(rows) | {"0/f0.bin": b"new", "empty": b""}
    # a job that fails in one task leaves nothing, not even what other tasks wrote
    for bad in ("../escape", "/abs", "", None):
        with pytest.raises(Exception, match="no path below the root"):
            land_files(spark.createDataFrame([("good", b"x"), (bad, b"y")], "path string, content binary").repartition(2), root)
    assert tree(root) == dict(rows) | {"0/f0.bin": b"new", "empty": b""} and not [d for d in os.listdir(root) if d.startswith(".")]
    # of two attempts at a task one is committed
    writer = LandingWriter(f"{tmp_path}/again")
    batch = lambda v: iter([pa.RecordBatch.from_pydict({"path": ["a"], "content": [v]})])
    writer.write(batch(b"lost"))
    writer.commit([writer.write(batch(b"kept")), None])
    assert tree(f"{tmp_path}/again") == {"a": b"kept"}


def test_median_cut_in_rounds(spark):
    """At most so many boxes, none empty; equal colours share one; every box lies in its own part of the colours."""
    from lumidisc.operators import palette

    rng = np.random.default_rng(5)
    rows = [(*map(int, c), int(n)) for c, n in zip(np.unique(rng.integers(0, 256, (400, 3)), axis=0), rng.integers(1, 50, 400), strict=False)]
    colors = spark.createDataFrame(rows, "r int, g int, b int, n bigint")
    for most in (1, 2, 5, 16, 100):
        found = palette.boxes(colors, most).collect()
        ranges = {}
        for r in found:
            ranges.setdefault(r["box"], []).append((r["r"], r["g"], r["b"]))
        assert len(found) == len(rows) and len(ranges) == most
        apart = [(np.min(x, 0), np.max(x, 0)) for x in ranges.values()]
        assert all(((a[1] < b[0]) | (b[1] < a[0])).any() for i, a in enumerate(apart) for b in apart[:i])
    few = spark.createDataFrame([(1, 2, 3, 10), (200, 2, 3, 1)], "r int, g int, b int, n bigint")
    assert len({r["box"] for r in palette.boxes(few, 16).collect()}) == 2
    assert palette.shared_palette(spark.createDataFrame([], "r int, g int, b int"), 4).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_a_grid_that_is_kept_between_runs(spark, tmp_path, k):
    """Increments, one of them repeated and two made at once, come to the grid of all frames."""
    from lumidisc.operators import composite
    from lumidisc.plans.grid_state import GridState
    from lumidisc.sources import derived

    discs = derived.discs(queries.read(spark, SF, "events"), queries.read(spark, SF, "embeddings")).where("idx < 240").cache()
    state = GridState(spark, f"{tmp_path}/grid", 12, 24, blend_k=k)
    part = lambda i: discs.where(F.col("idx") % 4 == i)
    assert state.update(part(0)) == 60 and state.update(part(0)) == 0
    assert state.update(part(0).unionByName(part(1))) == 60
    folders = state.table.folders()
    assert len(folders) == 1
    assert state.update(part(2)) == 60
    other = GridState(spark, f"{tmp_path}/grid", 12, 24, blend_k=k)
    other.table.folders = lambda: folders  # began before the last update ended
    assert other.update(part(3)) == 60
    assert state.frames().count() == 240 and len(state.table.folders()) == 2
    seen = composite.observed(discs, 12, 24, blend_k=k)
    whole = composite.winners(seen) if k == 1 else composite.blend(seen, k)
    cells = lambda df: sorted((r["cell_row"], r["cell_col"], r["idx"], *(round(r[c], 9) for c in "rgb")) for r in df.collect())
    assert cells(state.grid()) == cells(whole)


def test_workers_without_the_package(tmp_path):
    """The first thing that a session does is to read images: its workers are sent the package."""
    import subprocess
    import sys

    save(str(tmp_path / "a.png"), disc())
    script = (
        f"import sys; sys.path.insert(0, {os.getcwd()!r})\n"
        "from lumidisc.session import build\nfrom lumidisc.sources.images import read_images\n"
        "spark = build('local[1]', 'bare', **{'spark.ui.enabled': 'false'})\n"
        f"print('read', read_images(spark, {str(tmp_path / 'a.png')!r}).first()['height'])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONSAFEPATH": "1"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "read 120" in out.stdout, out.stderr[-2000:]


def test_session_settings_stay(spark, tmp_path):
    settings = lambda: {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    before = settings()
    for name in ("components_largest", "dither", "composite_winner", "render_independent", "pick_spread", "palette_mediancut", "candidate_topk"):
        queries.QUERIES[name](spark, SF)
    save(str(tmp_path / "a.png"), disc())
    images.read_images(spark, str(tmp_path)).count()
    assert settings() == before


def test_composite_looks_at_few_places_of_late_frames(monkeypatch):
    """In one process: most frames can't improve a grid that has seen many, and neither are sampled nor inserted; the outcome is the same without the bound from levels."""
    import pyarrow as pa

    from lumidisc.operators import composite

    class Here:
        sparkSession = None

        def mapInArrow(self, f, schema):
            return f

    r, n = np.random.default_rng(3), 4000
    of = {"idx": np.arange(n), "lat": r.uniform(-90, 90, n).round(1), "lon": r.uniform(-180, 180, n).round(1), **{c: np.full(n, 3.5) for c in ("cx", "cy", "radius")}}
    sizes = {c: pa.array(np.full(n, x), pa.int32()) for c, x in (("height", 8), ("width", 8), ("channels", 3))}
    batch = pa.RecordBatch.from_pydict({**of, **sizes, "data": pa.array([r.integers(0, 256, 192, np.uint8).tobytes() for _ in range(n)], pa.binary())})
    monkeypatch.setattr(composite, "ship", lambda spark: None)
    sampled, insert, places, inserts = composite.sampled, composite.Best.insert, [], []
    monkeypatch.setattr(composite, "sampled", lambda image, row, *more: places.append(len(row)) or sampled(image, row, *more))
    monkeypatch.setattr(composite.Best, "insert", lambda self, *given: inserts.append(1) or insert(self, *given))
    found = []
    for bounds in (composite.DENSE_LEAST, {}):
        monkeypatch.setattr(composite, "DENSE_LEAST", bounds)
        places.clear(), inserts.clear()
        out = pa.Table.from_batches(list(composite.observed(Here(), 12, 24, blend_k=2, batch_rows=400)(iter([batch]))))
        found.append((out.to_pydict(), sum(places), len(inserts)))
    (one, few, inserted), (other, more, _) = found
    assert one == other and len(one["idx"]) == 2 * 12 * 24
    assert few < more and few < 0.1 * n * 12 * 24 and inserted < 0.7 * n, (few, more, inserted)
