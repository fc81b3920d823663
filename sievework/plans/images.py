"""Queries: image measures and resampling over grids of 4 x 4 pixels that part keys define."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import pixels as P
from .registry import query

# two grids per part: colours on a coarse scale, some pixels hidden, some half transparent
GRIDS = """px as (select p_partkey as k, unnest(range(0, 16)) as i from part),
  g as (select k, i, i // 4 as y, i % 4 as x, (k * (i + 1)) % 256 // 64 * 64 as r, (k * (i + 1) + 60) % 256 // 64 * 64 as g, (k * (i // 2 + 1) + 120) % 256 // 64 * 64 as b, case (k + i) % 3 when 0 then 0 when 1 then 255 else 130 end as a,
    (k * (i + 2) + 9) % 256 // 64 * 64 as r2, (k * (i + 1) + 70) % 256 // 64 * 64 as g2, (k * (i + 3) + 120) % 256 // 64 * 64 as b2, case when (k + i) % 4 = 0 then 0 else 255 end as a2 from px)"""
CHANNELS = """ch as (select k, x, y, a, a2, unnest([r, g, b]) as v, unnest([r2, g2, b2]) as v2, unnest([0, 1, 2]) as c from g)"""


def _grids(t):
    k = F.col("p_partkey")

    def grid(red, green, blue, alpha):
        cells = [f(F.lit(i)) for i in range(16) for f in (red, green, blue, alpha)]
        return F.array(*[c.cast("int") for c in cells])

    coarse = lambda v: F.floor(F.pmod(v, F.lit(256)) / 64) * 64
    one = grid(lambda i: coarse(k * (i + 1)), lambda i: coarse(k * (i + 1) + 60), lambda i: coarse(k * (F.floor(i / 2) + 1) + 120), lambda i: F.when((k + i) % 3 == 0, 0).when((k + i) % 3 == 1, 255).otherwise(130))
    two = grid(lambda i: coarse(k * (i + 2) + 9), lambda i: coarse(k * (i + 1) + 70), lambda i: coarse(k * (i + 3) + 120), lambda i: F.when((k + i) % 4 == 0, 0).otherwise(255))
    return t.part.select("p_partkey", "p_size", "p_name", one.alias("one"), two.alias("two"), F.lit(4).alias("side"), F.lit(2).alias("half"))


def _rounded(struct: str, names: str):
    return [F.round(F.col(struct)[n], 6).alias(n) for n in names.split()]


@query("image_metrics", f"""with {GRIDS}, {CHANNELS}, co as (select *, 255 + a / 255.0::double * (v - 255) as w1, 255 + a2 / 255.0::double * (v2 - 255) as w2, a / 255.0::double * v as b1, a2 / 255.0::double * v2 as b2 from ch),
  m as (select k, (avg(abs(w1 - w2)) + avg(abs(b1 - b2))) / 2 as composite_mae from co group by k),
  e as (select p.k, (avg(abs((q.w1 - p.w1) - (q.w2 - p.w2))) filter (where q.y = p.y + 1) + avg(abs((q.w1 - p.w1) - (q.w2 - p.w2))) filter (where q.x = p.x + 1)) / 2 as edge_mae from co p join co q on p.k = q.k and p.c = q.c and ((q.y = p.y + 1 and q.x = p.x) or (q.y = p.y and q.x = p.x + 1)) group by p.k),
  s as (select p.k, (avg(abs(p.b1 - q.b1)) filter (where p.y = q.y and p.x = 0 and q.x = 3) + avg(abs(p.b1 - q.b1)) filter (where p.x = q.x and p.y = 0 and q.y = 3)) / 2 as seam_mae from co p join co q on p.k = q.k and p.c = q.c group by p.k),
  al as (select k, avg(abs(a - a2)) as alpha_mae, coalesce(count(*) filter (where a >= 128 and a2 >= 128) / nullif(count(*) filter (where a >= 128 or a2 >= 128), 0)::double, 1.0) as alpha_iou from g group by k),
  c1 as (select distinct k, r, g, b from g where a > 8), c2 as (select distinct k, r2, g2, b2 from g where a2 > 8),
  d as (select c1.k, r, g, b, min((abs(r - r2) + abs(g - g2) + abs(b - b2)) / 3.0::double) as d from c1 left join c2 using (k) group by all), pal as (select k, count(*)::int as visible_colors, avg(d) as palette_mae from d group by k)
  select k as p_partkey, round(composite_mae, 6) as composite_mae, round(alpha_mae, 6) as alpha_mae, round(alpha_iou, 6) as alpha_iou, round(edge_mae, 6) as edge_mae, coalesce(visible_colors, 0) as visible_colors, round(palette_mae, 6) as palette_mae, round(seam_mae, 6) as seam_mae from m join e using (k) join s using (k) join al using (k) left join pal using (k)""")
def image_metrics(t):
    d = _grids(t).select("p_partkey", I.image_metrics("one", "two", "side", "side").alias("m"))
    return d.select("p_partkey", *_rounded("m", "composite_mae alpha_mae alpha_iou edge_mae palette_mae seam_mae"), "m.visible_colors")


@query("image_relative_metrics", f"""with {GRIDS}, gr as (select *, (r + g + b) / 3.0::double as l1, (r2 + g2 + b2) / 3.0::double as l2 from g),
  e as (select p.k, avg(abs(q.l1 - p.l1)) filter (where q.y = p.y + 1) + avg(abs(q.l1 - p.l1)) filter (where q.x = p.x + 1) as e1, avg(abs(q.l2 - p.l2)) filter (where q.y = p.y + 1) + avg(abs(q.l2 - p.l2)) filter (where q.x = p.x + 1) as e2 from gr p join gr q on p.k = q.k and ((q.y = p.y + 1 and q.x = p.x) or (q.y = p.y and q.x = p.x + 1)) group by p.k),
  m as (select k, avg((abs(r - r2) + abs(g - g2) + abs(b - b2)) / 3.0::double) as rgb_l1, count(*) filter (where a > 127 and a2 > 127) / greatest(count(*) filter (where a > 127 or a2 > 127), 1)::double as alpha_iou from g group by k)
  select k as p_partkey, round(rgb_l1, 6) as rgb_l1, round(alpha_iou, 6) as alpha_iou, round(abs(e1 - e2) / greatest(e2, 1e-3), 6) as edge_rel from m join e using (k)""")
def image_relative_metrics(t):
    d = _grids(t).select("p_partkey", I.relative_metrics("one", "two", "side", "side").alias("m"))
    return d.select("p_partkey", *_rounded("m", "rgb_l1 alpha_iou edge_rel"))


@query("image_conversion", f"""with {GRIDS}, s as (select * from g where x % 2 = 0 and y % 2 = 0), j as (select b.k, b.r, b.g, b.b, b.a, s.r2 as r1, s.g2 as g1, s.b2 as b1, s.a2 as a1 from g b join s on s.k = b.k and s.x = b.x // 2 * 2 and s.y = b.y // 2 * 2),
  m as (select k, avg((abs(r1 * a1 / 255.0::double - r * a / 255.0::double) + abs(g1 * a1 / 255.0::double - g * a / 255.0::double) + abs(b1 * a1 / 255.0::double - b * a / 255.0::double) + abs(a1 - a)) / 255.0::double / 4) as premultiplied_mae,
    coalesce(count(*) filter (where a1 >= 127.5 and a >= 127.5) / nullif(count(*) filter (where a1 >= 127.5 or a >= 127.5), 0)::double, 1.0) as alpha_iou, sum(a1) / 255.0::double / greatest(1e-12, sum(a) / 255.0::double) as opacity_mass_ratio from j group by k),
  f as (select k, count(distinct r * 65536 + g * 256 + b) filter (where a > 0)::int as colors_before from g group by k),
  n as (select k, count(distinct r2 * 65536 + g2 * 256 + b2) filter (where a2 > 0)::int as colors_after, count(*) filter (where a2 >= 128)::int as visible_pixels, count(*) filter (where a2 > 0) = 0 as empty from s group by k),
  w as (select k, count(distinct r2 * 65536 + g2 * 256 + b2)::int as introduced_colors from s where a2 > 0 and not exists (select 1 from g where g.k = s.k and g.a > 0 and g.r = s.r2 and g.g = s.g2 and g.b = s.b2) group by k)
  select k as p_partkey, round(premultiplied_mae, 6) as premultiplied_mae, round(alpha_iou, 6) as alpha_iou, round(opacity_mass_ratio, 6) as opacity_mass_ratio, colors_before, colors_after, coalesce(introduced_colors, 0) as introduced_colors, visible_pixels, empty from m join f using (k) join n using (k) left join w using (k)""")
def image_conversion(t):
    corners = F.array(*[F.get("two", 4 * (4 * y + x) + c) for y in (0, 2) for x in (0, 2) for c in range(4)])
    d = _grids(t).select("p_partkey", I.conversion_metrics("one", corners, "half", "half").alias("m"))
    return d.select("p_partkey", *_rounded("m", "premultiplied_mae alpha_iou opacity_mass_ratio"), "m.colors_before", "m.colors_after", "m.introduced_colors", "m.visible_pixels", "m.empty")


@query("image_style", f"""with {GRIDS}, gr as (select *, r + g + b as l, greatest(r, g, b) as hi, least(r, g, b) as lo from g),
  e as (select p.k, (avg(abs(q.l - p.l)) filter (where q.y = p.y + 1) + avg(abs(q.l - p.l)) filter (where q.x = p.x + 1)) / 3 as edge from gr p join gr q on p.k = q.k and ((q.y = p.y + 1 and q.x = p.x) or (q.y = p.y and q.x = p.x + 1)) group by p.k),
  f as (select p.k, avg((p.l = q.l and p.l = u.l)::int) as flat_blocks from gr p join gr q on q.k = p.k and q.y = p.y and q.x = p.x + 1 join gr u on u.k = p.k and u.x = p.x and u.y = p.y + 1 where p.x % 2 = 0 and p.y % 2 = 0 group by p.k),
  s as (select k, count(distinct r * 65536 + g * 256 + b)::int as colors, avg((hi - lo) / greatest(hi, 1)::double) as saturation from gr where a > 8 group by k)
  select k as p_partkey, colors, round(flat_blocks, 6) as flat_blocks, round(saturation, 6) as saturation, round(edge, 6) as edge from e join f using (k) join s using (k)""")
def image_style(t):
    d = _grids(t).select("p_partkey", I.style_statistics("one", "side", "side").alias("m"))
    return d.select("p_partkey", "m.colors", *_rounded("m", "flat_blocks saturation edge"))


@query("image_downsample", f"""with {GRIDS}, c as (select k, y // 2 as cy, x // 2 as cx, (y % 2) * 2 + x % 2 as q, r, g, b, a from g),
  m as (select k, cy, cx, sum(a) as t, coalesce(sum(r * a) / nullif(sum(a), 0)::double, 0) as mr, coalesce(sum(g * a) / nullif(sum(a), 0)::double, 0) as mg, coalesce(sum(b * a) / nullif(sum(a), 0)::double, 0) as mb, max(a) as top, max(r) filter (where q = 3) as nr, max(g) filter (where q = 3) as ng, max(b) filter (where q = 3) as nb, max(a) filter (where q = 3) as na from c group by all),
  p as (select c.k, cy, cx, r, g, b, a, row_number() over (partition by c.k, cy, cx order by (r - mr) ** 2 + (g - mg) ** 2 + (b - mb) ** 2, q) as n from c join m using (k, cy, cx) where a = top),
  x as (select m.k, cy, cx, [nr, ng, nb, na] as nearest, [round_even(mr, 0), round_even(mg, 0), round_even(mb, 0), round_even(t / 4.0::double, 0)] as box, [r, g, b, a] as pal from m join p using (k, cy, cx) where n = 1)
  select k as p_partkey, array_to_string(flatten(list(list_transform(nearest, lambda v: v::int) order by cy, cx)), ',') as nearest, array_to_string(flatten(list(list_transform(box, lambda v: v::int) order by cy, cx)), ',') as box, array_to_string(flatten(list(list_transform(pal, lambda v: v::int) order by cy, cx)), ',') as palette from x group by k""")
def image_downsample(t):
    """The grids' cells are not of one colour each, so none is lossless; tests show that case."""
    d = _grids(t)
    return d.select("p_partkey", *[F.array_join(I.downsample_half("one", "side", "side", F.lit(m))["grid"], ",").alias(m) for m in ("nearest", "box", "palette")])


HUE = "case when hi = lo then 0 when hi = r then ((g - b) / (hi - lo)::double + 6) % 6 when hi = g then (b - r) / (hi - lo)::double + 2 else (r - g) / (hi - lo)::double + 4 end"


@query("image_colors", f"""with {GRIDS}, h as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from g), s as (select *, {HUE} as hue, (hi - lo) / 255.0::double as chroma, a / 255.0::double as al, hi / 255.0::double as val from h),
  c as (select *, al >= 0.5 and chroma >= 0.12 and val >= 0.15 as colored from s),
  v as (select k, sum(chroma * al * cos(hue * pi() / 3)) filter (where colored) as x, sum(chroma * al * sin(hue * pi() / 3)) filter (where colored) as y, sum(chroma * al) filter (where colored) as m, count(*) filter (where colored)::int as pixels, count(*) filter (where al >= 0.5) as seen, sum(chroma * al) / greatest(sum(al), 1) as chroma,
    count(*) filter (where al >= 0.5 and chroma > 0.25 * val and val > 0.12 and hue / 6 >= 0.52 and hue / 6 < 0.72) as blue from c group by k)
  select k as p_partkey, round(coalesce(sqrt(x * x + y * y) / m, 0), 6) as concentration, pixels, round(pixels / greatest(seen, 1)::double, 6) as coverage, round(chroma, 6) as chroma, round(blue / greatest(seen, 1)::double, 6) as blue from v""")
def image_colors(t):
    d = _grids(t).select("p_partkey", I.color_summary("one").alias("m"), I.color_fraction("one", F.lit("blue")).alias("blue"))
    return d.select("p_partkey", *_rounded("m", "concentration coverage chroma"), "m.pixels", F.round("blue", 6).alias("blue"))


@query("image_seams", f"""with {GRIDS}, ch as (select k, x, y, unnest([r, g, b, a]) as v, unnest([0, 1, 2, 3]) as c from g)
  , s as (select p.k, avg(abs(p.v - q.v)) filter (where p.y = q.y and p.x = 0 and q.x = 3) as horizontal, avg(abs(p.v - q.v)) filter (where p.x = q.x and p.y = 0 and q.y = 3) as vertical from ch p join ch q on p.k = q.k and p.c = q.c group by p.k)
  select k as p_partkey, round((horizontal + vertical) / 2, 6) as score, round(horizontal, 6) as horizontal, round(vertical, 6) as vertical from s""")
def image_seams(t):
    d = _grids(t).select("p_partkey", I.seams("one", "side", "side", F.lit(1)).alias("m"))
    return d.select("p_partkey", *_rounded("m", "score horizontal vertical"))


@query("image_cells", """with a as (select p_partkey, p_size * 8 as w, (p_partkey % 16 + 1) * 16 as h, case when p_partkey % 3 = 0 then 32 end as hint from part),
  c as (select *, list_filter([case when hint = 32 and w % 32 = 0 and h % 32 = 0 and (w // 32) * (h // 32) >= 2 then 32 end] || list_transform([16, 32, 24, 8], lambda x: case when w % x = 0 and h % x = 0 and (w // x) * (h // x) between 2 and 4096 then x end), lambda x: x is not null)[1] as fit from a)
  select p_partkey, case when w <= 64 and h <= 64 then greatest(w, h)::int else fit end as cell, not (w <= 64 and h <= 64) and fit is not null as is_grid from c""")
def image_cells(t):
    p = t.part.select("p_partkey", (F.col("p_size") * 8).alias("w"), ((F.col("p_partkey") % 16 + 1) * 16).alias("h"), F.when(F.col("p_partkey") % 3 == 0, 32).alias("hint"))
    return p.select("p_partkey", I.cell_choice("w", "h", "hint", [8, 16, 24, 32], [16, 32, 24, 8]).alias("c")).select("p_partkey", "c.cell", "c.is_grid")


@query("image_valid", f"""with {GRIDS} select k as p_partkey, count(*) filter (where a > 8) / 16.0::double >= 0.05 and count(*) filter (where a > 100) >= 4 and count(distinct case when a > 100 then r * 65536 + g * 256 + b end) >= 2 as valid from g group by k""")
def image_valid(t):
    return _grids(t).select("p_partkey", I.interesting("one").alias("valid"))


@query("image_tiles", f"""with {GRIDS}, t as (select k, (ty * 4 + y) * 8 + tx * 4 + x as pos, [r, g, b, a] as p from g, range(0, 2) u(ty), range(0, 2) v(tx)), w as (select k, ((y + 1) % 4) * 4 + (x + 3) % 4 as pos, [r, g, b, a] as p from g)
  select t.k as p_partkey, array_to_string(flatten(list(t.p order by t.pos)), ',') as tiled, any_value(rolled) as rolled from t join (select k, array_to_string(flatten(list(p order by pos)), ',') as rolled from w group by k) using (k) group by t.k""")
def image_tiles(t):
    d = _grids(t)
    return d.select("p_partkey", F.array_join(I.tiled("one", "side", "side", F.lit(2)), ",").alias("tiled"), F.array_join(P.roll("one", "side", "side", F.lit(1), F.lit(-1)), ",").alias("rolled"))


@query("image_regions")
def image_regions(t):
    """Regions, fitting, pixel modes and hues, which SQL can't express; tests hold each against a plain version."""
    d = _grids(t).withColumn("found", I.regions("one", "side", "side", F.lit(100)))
    seen = F.size(F.filter(P.channel("one", 3), lambda a: a > 100))
    s = I.region_statistics(F.col("found"), seen)
    return d.select(
        "p_partkey", s["regions"].alias("regions"), s["tiny_pixels"].alias("tiny_pixels"), F.round(s["largest_share"], 6).alias("largest_share"),
        I.fit_centered("one", "side", "side", F.lit(8)).alias("fitted"), I.pixelized("pixelized_quant", 4, 3, 2)("one", "side", "side", "half").alias("pixelized"), I.rotate_hue("one", F.lit(120.0)).alias("turned"),
    )
