"""Image functions that SQL can't express, against plain versions."""

import colorsys
import random

from pyspark.sql import functions as F
from sievework.functions import images as I


def grid(rnd, h, w, colors=((0, 0, 0), (255, 0, 0), (10, 200, 30), (90, 90, 90))):
    return [v for _ in range(h * w) for v in (*rnd.choice(colors), rnd.choice((0, 50, 120, 200, 255)))]


def plain_regions(flat, h, w, above):
    left, out = {(y, x) for y in range(h) for x in range(w) if flat[4 * (y * w + x) + 3] > above}, []
    while left:
        todo = [left.pop()]
        region = list(todo)
        while todo:
            y, x = todo.pop()
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
            region += near
        ys, xs = [p[0] for p in region], [p[1] for p in region]
        out.append((len(region), min(ys), min(xs), max(ys) + 1, max(xs) + 1))
    return sorted(out, key=lambda r: (-r[0], r[1], r[2]))


def test_regions(spark):
    rnd = random.Random(1)
    rows = [(i, grid(rnd, h, w), h, w) for i, (h, w) in enumerate([(1, 1), (5, 7), (9, 9), (12, 3), (12, 3), (2, 20)] * 6)]
    snake = [255 if (y % 4 == 0 or (y % 4 == 2) or x == (9 if y % 4 == 1 else 0)) else 0 for y in range(10) for x in range(10)]
    rows += [(100, [v for a in snake for v in (1, 1, 1, a)], 10, 10), (101, [0] * 16, 2, 2)]
    df = spark.createDataFrame(rows, "id int, g array<int>, h int, w int").repartition(3)
    got = {r.id: ([tuple(x) for x in r.r], r.s) for r in df.withColumn("r", I.regions("g", "h", "w", F.lit(100))).withColumn("s", I.region_statistics(F.col("r"), F.lit(10))).collect()}
    for i, g, h, w in rows:
        want = plain_regions(g, h, w, 100)
        assert got[i][0] == want
        assert (got[i][1].regions, got[i][1].tiny_pixels) == (len(want), sum(r[0] for r in want[1:] if r[0] <= 2))
    assert len(got[100][0]) == 1 and got[101][1].largest_share == 0


def test_hues(spark):
    rnd = random.Random(2)
    flat = [rnd.randrange(256) for _ in range(4 * 300)] + [7, 7, 7, 9] + [255, 0, 0, 1]
    df = spark.createDataFrame([(flat,)], "g array<int>")
    found = df.select(I.hue_components("g").alias("h")).select("h.*").first()
    for k in range(0, len(flat), 4):
        h, s, v = colorsys.rgb_to_hsv(*(c / 255 for c in flat[k : k + 3]))
        assert abs(found.hue[k // 4] - h) < 1e-9 and abs(found.value[k // 4] - v) < 1e-9 and abs(found.chroma[k // 4] - s * v) < 1e-9
    for angle in (0.0, 360.0, 45.0, 120.0, -75.0):
        turned = df.select(I.rotate_hue("g", F.lit(angle)).alias("t")).first().t
        for k in range(0, len(flat), 4):
            h, s, v = colorsys.rgb_to_hsv(*(c / 255 for c in flat[k : k + 3]))
            want = [255 * c for c in colorsys.hsv_to_rgb((h + angle / 360) % 1, s, v)]
            assert all(abs(a - b) <= 0.5 + 1e-6 for a, b in zip(turned[k : k + 3], want, strict=True)) and turned[k + 3] == flat[k + 3]
    summary = spark.createDataFrame([([255, 0, 0, 255] * 40,), ([255, 30, 0, 255] * 40,), ([0, 0, 255, 255] * 40,), ([9, 9, 9, 255] * 40,)], "g array<int>").withColumn("m", I.color_summary("g"))
    red = [r for r in summary.select("m.*").collect()]
    assert [None if r.hue is None else round(r.hue) for r in red] == [0, 7, 240, None]
    one, two = summary.limit(1).select(F.col("m").alias("a")), summary.select(F.col("m").alias("b"))
    assert sorted(r.k for r in one.join(two).select(I.compatible_colors(F.col("a"), F.col("b")).alias("k")).collect()) == [False, False, True, True]


def test_fit_halve_and_pixelize(spark):
    row = [0] * 16 + [5, 5, 5, 255, 6, 6, 6, 255] + [0] * 8  # 4 wide, 2 high; two pixels in the second row
    df = spark.createDataFrame([(row[:32], 2, 4), ([0] * 32, 2, 4)], "g array<int>, h int, w int")
    fitted = [r.f for r in df.select(I.fit_centered("g", "h", "w", F.lit(4)).alias("f")).collect()]
    top = [[0] * 16, [5, 5, 5, 255] * 2 + [6, 6, 6, 255] * 2]
    assert fitted == [top[0] + top[1] + top[1] + top[0], None]
    cell = [1, 2, 3, 255] * 2
    same = spark.createDataFrame([(cell * 2, 2, 2)], "g array<int>, h int, w int")
    assert [tuple(r.d) for r in same.select(I.downsample_half("g", "h", "w", F.lit("box")).alias("d")).collect()] == [([1, 2, 3, 255], True)]
    rnd = random.Random(3)
    big = spark.createDataFrame([(grid(rnd, 8, 8, [(r, 7, 3 * r) for r in range(0, 80, 5)]), 8, 8)], "g array<int>, h int, w int")
    for mode in ("direct_lowres", "raw", "palette_quant", "pixelized_quant"):
        out = big.select("g", I.pixelized(mode, 4, 3, 2)("g", "h", "w", "h").alias("p")).first()
        assert len(out.p) == 64 and (mode == "direct_lowres" or set(out.p[3::4]) == {255})
        if mode.endswith("quant"):
            assert len({tuple(out.p[k : k + 3]) for k in range(0, 64, 4)}) <= 3
        else:  # the middle of each 2 x 2 cell is its last pixel
            assert out.p[:3] == out.g[4 * 9 : 4 * 9 + 3]
