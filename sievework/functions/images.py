"""Image measures and resampling over batches of pixel grids.

Grids are flat RGBA arrays in row order with their height and width. Each
function takes an Arrow batch, stacks the grids of one shape into one array of
four dimensions (grid, row, column, channel) and measures all of them at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import col
from .pixels import NUMBERS, channel, pixels

#: Alpha from which a pixel is in the foreground, above which it is visible at all, and above which an edge picture counts it.
FOREGROUND, VISIBLE, SOLID = 128, 8, 127


_KINDS = {"double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "doubles": T.ArrayType(T.DoubleType()), "ints": NUMBERS}


def _struct(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in kinds.items()])


def _stacks(flat: pd.Series, h: pd.Series, w: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(positions, stack)`` of the grids of each shape."""
    shape = pd.DataFrame({"h": h.to_numpy(), "w": w.to_numpy()})
    for (a, b), at in shape.groupby(["h", "w"]).indices.items():
        yield at, np.stack([np.asarray(flat.iloc[i], np.float64) for i in at]).reshape(len(at), int(a), int(b), 4)


def _like(flat: pd.Series, at: np.ndarray, shape: tuple) -> np.ndarray:
    return np.stack([np.asarray(flat.iloc[i], np.float64) for i in at]).reshape(shape)


def _filled(n: int, columns: dict[str, object], parts: list[tuple[np.ndarray, dict]]) -> pd.DataFrame:
    out = pd.DataFrame({c: pd.Series([None] * n, dtype=kind) for c, kind in columns.items()})
    for at, found in parts:
        for c, values in found.items():
            out.loc[at, c] = values
    return out


def _mean(x: np.ndarray) -> np.ndarray:
    """Mean of all but the first dimension; zero of nothing."""
    flat = x.reshape(len(x), -1)
    return flat.mean(axis=1) if flat.shape[1] else np.zeros(len(x))


def _over(grids: np.ndarray, background: float) -> np.ndarray:
    share = grids[..., 3:] / 255
    return background + share * (grids[..., :3] - background)


def _slopes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return values[:, 1:] - values[:, :-1], values[:, :, 1:] - values[:, :, :-1]


def _overlap(a: np.ndarray, b: np.ndarray, empty: float) -> np.ndarray:
    either = _mean(a | b)
    return np.where(either > 0, _mean(a & b) / np.where(either > 0, either, 1), empty)


def _colors(grid: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.unique(grid[mask][:, :3], axis=0)


def _border_gaps(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean difference of the left and right borders, and of the upper and lower ones."""
    return _mean(np.abs(values[:, :, :width] - values[:, :, -width:])), _mean(np.abs(values[:, :width] - values[:, -width:]))


_METRICS = {"composite_mae": "float64", "alpha_mae": "float64", "alpha_iou": "float64", "edge_mae": "float64", "visible_colors": "float64", "palette_mae": "float64", "seam_mae": "float64"}


@F.pandas_udf(_struct(composite_mae="double", alpha_mae="double", alpha_iou="double", edge_mae="double", visible_colors="int", palette_mae="double", seam_mae="double"))
def image_metrics(predicted: pd.Series, target: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    """L1: errors against a target of the same shape, in units of 0 to 255.

    Colours are held against each other over white and over black, so hidden
    colours don't count. Edges are differences of neighbours over white. The
    palette's error is the mean distance of each visible colour to the nearest
    of the target's, null where either has none. Seams are gaps between opposite
    borders over black. An empty union of foregrounds counts as full overlap.
    """
    parts = []
    for at, p in _stacks(predicted, h, w):
        t = _like(target, at, p.shape)
        white, black = (_over(p, 255), _over(t, 255)), (_over(p, 0), _over(t, 0))
        edges = [_mean(np.abs(a - b)) for a, b in zip(_slopes(white[0]), _slopes(white[1]), strict=True)]
        count, palette = [], []
        for one, other in zip(p, t, strict=True):
            mine, wanted = _colors(one, one[..., 3] > VISIBLE), _colors(other, other[..., 3] > VISIBLE)
            count.append(len(mine))
            # in blocks, so that many colours don't make a table of all pairs
            near = [np.abs(mine[k : k + 256, None] - wanted[None]).mean(axis=2).min(axis=1) for k in range(0, len(mine), 256)] if len(wanted) else []
            palette.append(float(np.concatenate(near).mean()) if near else None)
        found = {
            "composite_mae": (_mean(np.abs(white[0] - white[1])) + _mean(np.abs(black[0] - black[1]))) / 2,
            "alpha_mae": _mean(np.abs(p[..., 3] - t[..., 3])),
            "alpha_iou": _overlap(p[..., 3] >= FOREGROUND, t[..., 3] >= FOREGROUND, 1.0),
            "edge_mae": sum(edges) / 2,
            "visible_colors": count,
            "palette_mae": palette,
            "seam_mae": sum(_border_gaps(black[0], 1)) / 2,
        }
        parts.append((at, found))
    return _filled(len(h), _METRICS, parts)


def _edge_strength(rgb: np.ndarray) -> np.ndarray:
    gray = rgb.mean(axis=-1)
    return sum(_mean(np.abs(s)) for s in _slopes(gray))


@F.pandas_udf(_struct(rgb_l1="double", alpha_iou="double", edge_rel="double"))
def relative_metrics(output: pd.Series, target: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    """Mean colour error, overlap of solid pixels (zero of an empty union), and the error of edge strength relative to the target's."""
    parts = []
    for at, o in _stacks(output, h, w):
        t = _like(target, at, o.shape)
        strength = _edge_strength(t[..., :3])
        relative = np.abs(_edge_strength(o[..., :3]) - strength) / np.maximum(strength, 1e-3)
        parts.append((at, {"rgb_l1": _mean(np.abs(o[..., :3] - t[..., :3])), "alpha_iou": _overlap(o[..., 3] > SOLID, t[..., 3] > SOLID, 0.0), "edge_rel": relative}))
    return _filled(len(h), dict.fromkeys(("rgb_l1", "alpha_iou", "edge_rel"), "float64"), parts)


@F.pandas_udf(_struct(premultiplied_mae="double", alpha_iou="double", opacity_mass_ratio="double", colors_before="int", colors_after="int", introduced_colors="int", visible_pixels="int", empty="boolean"))
def conversion_metrics(source: pd.Series, output: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    """A source of twice the sides ``h, w`` of its conversion: error, overlap, opacity kept, colours kept and new."""
    names = ("premultiplied_mae", "alpha_iou", "opacity_mass_ratio", "colors_before", "colors_after", "introduced_colors", "visible_pixels", "empty")
    parts = []
    for at, small in _stacks(output, h, w):
        n, a, b = small.shape[:3]
        before, after = _like(source, at, (n, 2 * a, 2 * b, 4)), small.repeat(2, axis=1).repeat(2, axis=2)
        flat = [np.concatenate([g[..., :3] * g[..., 3:] / 255, g[..., 3:]], axis=3) / 255 for g in (after, before)]
        colors = [[{tuple(c) for c in _colors(g, g[..., 3] > 0).tolist()} for g in stack] for stack in (before, small)]
        found = {
            "premultiplied_mae": _mean(np.abs(flat[0] - flat[1])),
            "alpha_iou": _overlap(after[..., 3] >= 127.5, before[..., 3] >= 127.5, 1.0),
            "opacity_mass_ratio": after[..., 3].sum(axis=(1, 2)) / 255 / np.maximum(before[..., 3].sum(axis=(1, 2)) / 255, 1e-12),
            "colors_before": [len(c) for c in colors[0]],
            "colors_after": [len(c) for c in colors[1]],
            "introduced_colors": [len(y - x) for x, y in zip(*colors, strict=True)],
            "visible_pixels": (small[..., 3] >= FOREGROUND).sum(axis=(1, 2)),
            "empty": ~(small[..., 3] > 0).any(axis=(1, 2)),
        }
        parts.append((at, found))
    return _filled(len(h), {c: "boolean" if c == "empty" else "float64" for c in names}, parts)


@F.pandas_udf(_struct(colors="int", flat_blocks="double", saturation="double", edge="double"))
def style_statistics(flat: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    """Visible colours, the share of 2 x 2 blocks whose corner equals its neighbours in brightness, saturation and edge strength; zeros without visible pixels."""
    parts = []
    for at, g in _stacks(flat, h, w):
        seen = g[..., 3] > VISIBLE
        gray = g[..., :3].sum(axis=-1)
        corner = gray[:, 0::2, 0::2]
        same = (corner == gray[:, 0::2, 1::2]) & (corner == gray[:, 1::2, 0::2])
        high, low = g[..., :3].max(axis=-1), g[..., :3].min(axis=-1)
        n = np.maximum(seen.sum(axis=(1, 2)), 1)
        some = seen.any(axis=(1, 2))
        saturation = np.where(seen, (high - low) / np.maximum(high, 1), 0).sum(axis=(1, 2)) / n
        found = {"colors": [len(_colors(x, m)) for x, m in zip(g, seen, strict=True)], "flat_blocks": _mean(same) * some, "saturation": saturation * some, "edge": _edge_strength(g[..., :3]) * some}
        parts.append((at, found))
    return _filled(len(h), dict.fromkeys(("colors", "flat_blocks", "saturation", "edge"), "float64"), parts)


def _hsv(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in sixths of a turn, chroma and value; the hue of a grey is zero."""
    rgb = g[..., :3] / 255
    order = rgb.argmax(axis=-1)
    high, chroma = rgb.max(axis=-1), np.ptp(rgb, axis=-1)
    # the hue's sector starts at the greatest channel; the other two, in cyclic order, say how far it is turned
    ahead, behind = (np.take_along_axis(rgb, ((order + k) % 3)[..., None], axis=-1)[..., 0] for k in (1, 2))
    turn = np.divide(ahead - behind, chroma, out=np.zeros_like(chroma), where=chroma > 0)
    return np.where(chroma > 0, (2 * order + turn) % 6, 0.0), chroma, high


@F.pandas_udf(_struct(hue="doubles", chroma="doubles", value="doubles"))
def hue_components(flat: pd.Series) -> pd.DataFrame:
    """Hue (0 to 1), chroma and value of each pixel."""
    rows = [_hsv(np.asarray(x, np.float64).reshape(-1, 4)) for x in flat]
    return pd.DataFrame({"hue": [r[0] / 6 for r in rows], "chroma": [r[1] for r in rows], "value": [r[2] for r in rows]})


@F.pandas_udf(NUMBERS)
def rotate_hue(flat: pd.Series, degrees: pd.Series) -> pd.Series:
    """Hues turned; the greatest and least channel of a pixel, and its alpha, stay as they are."""

    def turned(x, d):
        g = np.asarray(x, np.float64).reshape(-1, 4)
        if not np.isfinite(d):
            raise ValueError("an angle must be finite")
        if d % 360 == 0:
            return list(x)
        hue, chroma, high = _hsv(g)
        # each channel falls off from its own hue (0, 2, 4) as far as the hue is away from it
        away = np.abs((hue[:, None] + d / 60 - np.array([0.0, 2.0, 4.0]) + 3) % 6 - 3)
        rgb = high[:, None] - chroma[:, None] * np.clip(away - 1, 0, 1)
        return np.concatenate([np.rint(255 * rgb).clip(0, 255), g[:, 3:]], axis=1).astype(np.int64).reshape(-1).tolist()

    return pd.Series([turned(x, d) for x, d in zip(flat, degrees, strict=True)])


@F.pandas_udf(_struct(hue="double", concentration="double", pixels="int", coverage="double", chroma="double"))
def color_summary(flat: pd.Series) -> pd.DataFrame:
    """Mean direction of the hues of coloured pixels in degrees (null without any), its concentration, how many they are, and their share of the foreground."""
    out = []
    for x in flat:
        g = np.asarray(x, np.float64).reshape(-1, 4)
        hue, chroma, high = _hsv(g)
        alpha = g[:, 3] / 255
        seen = alpha >= 0.5
        colored = seen & (chroma >= 0.12) & (high >= 0.15)
        weight = np.where(colored, chroma * alpha, 0.0)
        x_sum, y_sum, mass = (weight * np.cos(hue * np.pi / 3)).sum(), (weight * np.sin(hue * np.pi / 3)).sum(), weight.sum()
        out.append((np.degrees(np.arctan2(y_sum, x_sum)) % 360 if mass else None, np.hypot(x_sum, y_sum) / mass if mass else 0.0, colored.sum(), colored.sum() / max(seen.sum(), 1), (chroma * alpha).sum() / max(alpha.sum(), 1.0)))
    return pd.DataFrame(out, columns=["hue", "concentration", "pixels", "coverage", "chroma"])


def compatible_colors(target: Column, reference: Column) -> Column:
    """B15 over two colour summaries: enough coloured pixels, enough coverage, clear hues, at most 30 degrees apart; never for a null hue."""
    apart = F.abs(F.pmod(target["hue"] - reference["hue"] + 180, F.lit(360.0)) - 180)
    enough = (target["pixels"] >= 8) & (target["coverage"] >= 0.15) & (reference["pixels"] >= 32)
    clear = (target["concentration"] >= 0.6) & (reference["concentration"] >= 0.6)
    return enough & clear & F.coalesce(apart <= 30, F.lit(False))


#: Hue ranges of colour names, in parts of a turn, lower end included.
HUES = {"red": ((0.0, 0.045), (0.95, 1.0)), "blue": ((0.52, 0.72),), "green": ((0.20, 0.48),), "purple": ((0.72, 0.92),), "golden": ((0.08, 0.20),)}


@F.pandas_udf(T.DoubleType())
def color_fraction(flat: pd.Series, color: pd.Series) -> pd.Series:
    """The share of foreground pixels that are of the named colour, neither grey nor dark."""
    out = []
    for x, name in zip(flat, color, strict=True):
        g = np.asarray(x, np.float64).reshape(-1, 4)
        hue, chroma, high = (v[g[:, 3] >= 127.5] for v in _hsv(g))
        vivid = (chroma > 0.25 * high) & (high > 0.12)
        inside = np.zeros(len(hue), bool)
        for low, end in HUES[name]:
            inside |= (hue / 6 >= low) & (hue / 6 < end) if low != 0.95 else hue / 6 > low
        out.append(float((inside & vivid).mean()) if len(hue) else 0.0)
    return pd.Series(out)


def _nearest(size: int, wanted: int) -> np.ndarray:
    """Which of ``size`` places the middle of each of ``wanted`` equal parts falls on."""
    return ((np.arange(wanted) + 0.5) * size / wanted).astype(np.int64)


def _resized(g: np.ndarray, height: int, width: int) -> np.ndarray:
    return g[_nearest(g.shape[0], height)][:, _nearest(g.shape[1], width)]


def _each(function: Callable[..., np.ndarray]):
    """A batch function over single grids (height, width, channel) and one more argument."""

    def run(flat: pd.Series, h: pd.Series, w: pd.Series, more: pd.Series) -> pd.Series:
        grids = (np.asarray(x, np.int64).reshape(int(a), int(b), 4) for x, a, b in zip(flat, h, w, strict=True))
        return pd.Series([None if (y := function(g, m)) is None else y.reshape(-1).tolist() for g, m in zip(grids, more, strict=True)])

    return run


@F.pandas_udf(_struct(grid="ints", lossless="boolean"))
def downsample_half(flat: pd.Series, h: pd.Series, w: pd.Series, method: pd.Series) -> pd.DataFrame:
    """L4: half the sides. Repeated 2 x 2 cells are taken as they are; else by ``nearest``, ``box`` or ``palette``.

    ``box`` is the mean with colours weighted by alpha; ``palette`` the pixel of
    a cell that is nearest to that mean among its most opaque ones.
    """
    grids, lossless = [], []
    for x, a, b, how in zip(flat, h, w, method, strict=True):
        g = np.asarray(x, np.float64).reshape(int(a), int(b), 4)
        cells = np.stack([g[i::2, j::2] for i in (0, 1) for j in (0, 1)])  # the four pixels of each cell, in row order
        exact = bool((cells == cells[0]).all())
        weight = cells[..., 3:]
        total = weight.sum(axis=0)
        mean = np.divide((cells[..., :3] * weight).sum(axis=0), total, out=np.zeros_like(cells[0, ..., :3]), where=total > 0)
        if exact:
            small = cells[0]
        elif how == "nearest":
            small = cells[3]
        elif how == "box":
            small = np.rint(np.concatenate([mean, total / 4], axis=-1))
        elif how == "palette":
            off = ((cells[..., :3] - mean) ** 2).sum(axis=-1)
            off = np.where(cells[..., 3] == cells[..., 3].max(axis=0), off, np.inf)
            small = np.take_along_axis(cells, off.argmin(axis=0)[None, ..., None], axis=0)[0]
        else:
            raise ValueError(f"no method {how}")
        grids.append(small.astype(np.int64).reshape(-1).tolist())
        lossless.append(exact)
    return pd.DataFrame({"grid": grids, "lossless": lossless})


def _fitted(g: np.ndarray, size: int) -> np.ndarray | None:
    seen = g.any(axis=-1)
    if not seen.any():
        return None
    rows, columns = np.flatnonzero(seen.any(axis=1)), np.flatnonzero(seen.any(axis=0))
    cut = g[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
    scale = min(size / cut.shape[1], size / cut.shape[0])
    tall, wide = (max(1, round(n * scale)) for n in cut.shape[:2])
    out = np.zeros((size, size, 4), np.int64)
    top, left = (size - tall) // 2, (size - wide) // 2
    out[top : top + tall, left : left + wide] = _resized(cut, tall, wide)
    out[out[..., 3] == 0] = 0
    return out


#: What isn't empty, enlarged or reduced with its proportions kept, in the middle of a square; null for an empty grid.
fit_centered = F.pandas_udf(_each(lambda g, size: _fitted(g, int(size))), NUMBERS)

#: The grid repeated so often both ways.
tiled = F.pandas_udf(_each(lambda g, n: np.tile(g, (int(n), int(n), 1))), NUMBERS)


def _median_cut(g: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` colours: the box with the widest channel is halved at its median until there are enough; each becomes its rounded mean."""
    colors, where = np.unique(g[..., :3].reshape(-1, 3), axis=0, return_inverse=True)
    weight = np.bincount(where.reshape(-1), minlength=len(colors))
    boxes = [np.arange(len(colors))]
    while len(boxes) < n:
        widths = [np.ptp(colors[b], axis=0).max() for b in boxes]
        k = int(np.argmax(widths))
        if not widths[k]:
            break
        box = boxes.pop(k)
        box = box[np.argsort(colors[box, np.ptp(colors[box], axis=0).argmax()], kind="stable")]
        half = np.cumsum(weight[box])
        at = int(np.clip(np.searchsorted(half, half[-1] / 2) + 1, 1, len(box) - 1))
        boxes += [box[:at], box[at:]]
    means = np.zeros_like(colors)
    for b in boxes:
        means[b] = np.rint(np.average(colors[b], axis=0, weights=weight[b]))
    return np.concatenate([means[where.reshape(-1)].reshape(*g.shape[:2], 3), g[..., 3:]], axis=2)


def pixelized(mode: str, size: int, palette: int = 16, low: int = 16):
    """A function of ``(flat, h, w, seed column)`` for one mode.

    ``direct_lowres`` and ``raw`` resize by nearest pixels (``raw`` drops the
    alpha); ``palette_quant`` reduces the colours by a median cut first;
    ``pixelized_quant`` goes through ``low`` pixels a side before that.
    """
    if mode not in ("direct_lowres", "raw", "palette_quant", "pixelized_quant"):
        raise ValueError(f"no mode {mode}")

    def make(g, _):
        if mode == "pixelized_quant":
            g = _resized(_resized(g, low, low), size, size)
        if mode.endswith("quant"):
            g = _median_cut(g, palette)
        out = _resized(g, size, size).copy()
        if mode != "direct_lowres":
            out[..., 3] = 255
        return out

    return F.pandas_udf(_each(make), NUMBERS)


@F.pandas_udf(_struct(score="double", horizontal="double", vertical="double"))
def seams(flat: pd.Series, h: pd.Series, w: pd.Series, border: pd.Series) -> pd.DataFrame:
    """Mean differences of opposite borders of some width, over all channels, and their mean."""
    parts = []
    for at, g in _stacks(flat, h, w):
        for width in np.unique(border.to_numpy()[at]):
            mine = border.to_numpy()[at] == width
            across, along = _border_gaps(g[mine], int(width))
            parts.append((at[mine], {"score": (across + along) / 2, "horizontal": across, "vertical": along}))
    return _filled(len(h), dict.fromkeys(("score", "horizontal", "vertical"), "float64"), parts)


def _labels(mask: np.ndarray) -> np.ndarray:
    """Regions of a stack of masks whose pixels touch, corners included, named by their least pixel number; -1 outside.

    All grids at once: names spread to neighbours and then along what they
    point at, so the number of rounds grows with the logarithm of a region.
    """
    n, h, w = mask.shape
    own = np.arange(n * h * w).reshape(mask.shape)
    outside = n * h * w
    name = np.where(mask, own, outside)
    while True:
        wide = np.pad(name, ((0, 0), (1, 1), (1, 1)), constant_values=outside)
        least = np.minimum.reduce([wide[:, dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)])
        least = np.where(mask, least, outside)
        table = np.append(least.reshape(-1), outside)
        least = np.where(mask, table[least], outside)
        if (least == name).all():
            return np.where(mask, name, -1)
        name = least


_REGION = T.ArrayType(_struct(size="int", top="int", left="int", bottom="int", right="int"))


@F.pandas_udf(_REGION)
def regions(flat: pd.Series, h: pd.Series, w: pd.Series, above: pd.Series) -> pd.Series:
    """The 8-connected regions of pixels with more alpha than ``above``, largest first, then from the top left, with their boxes (ends exclusive)."""
    out: list = [None] * len(h)
    for at, g in _stacks(flat, h, w):
        name = _labels(g[..., 3] > above.to_numpy()[at][:, None, None])
        for i, grid in zip(at, name, strict=True):
            y, x = np.nonzero(grid >= 0)
            ids, k = np.unique(grid[y, x], return_inverse=True)
            top, left = np.full(len(ids), len(grid)), np.full(len(ids), grid.shape[1])
            bottom, right = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            np.minimum.at(top, k, y)
            np.minimum.at(left, k, x)
            np.maximum.at(bottom, k, y + 1)
            np.maximum.at(right, k, x + 1)
            found = list(zip(np.bincount(k, minlength=len(ids)).tolist(), top.tolist(), left.tolist(), bottom.tolist(), right.tolist(), strict=True))
            out[i] = [dict(zip(("size", "top", "left", "bottom", "right"), f, strict=True)) for f in sorted(found, key=lambda f: (-f[0], f[1], f[2]))]
    return pd.Series(out)


def region_statistics(found: Column, foreground: Column) -> Column:
    """Number of regions, pixels of tiny ones (two at most) besides the largest, and the largest one's share of the foreground."""
    tiny = F.aggregate(F.filter(F.slice(found, 2, 1 << 20), lambda r: r["size"] <= 2), F.lit(0), lambda s, r: s + r["size"])
    largest = F.coalesce(F.get(found, 0)["size"], F.lit(0))
    return F.struct(F.size(found).alias("regions"), tiny.alias("tiny_pixels"), (largest / F.greatest(foreground, F.lit(1))).alias("largest_share"))


def interesting(rgba: Column | str) -> Column:
    """At least a twentieth of the pixels visible, four well visible ones, and two colours among these."""
    alpha = channel(rgba, 3)
    share = F.size(F.filter(alpha, lambda a: a > VISIBLE)) / F.size(alpha)
    solid = F.transform(F.filter(pixels(rgba), lambda p: p % 256 > 100), lambda p: F.floor(p / 256))
    return (share >= 0.05) & (F.size(solid) >= 4) & (F.size(F.array_distinct(solid)) >= 2)


def cell_choice(width: Column | str, height: Column | str, hint: Column | str, cells: list[int], prefer: list[int], *, single: int = 64, most: int = 4096) -> Column:
    """``cell, is_grid``. Small pictures are one cell; else a hinted cell that fits, else the first preferred one that does, else null.

    A cell fits if it divides both sides into two tiles or more, up to ``most``.
    """
    w, h, named = col(width), col(height), col(hint)
    tiles = lambda c: F.floor(w / c) * F.floor(h / c)
    fits = lambda c: (w % c == 0) & (h % c == 0) & (tiles(c) >= 2) & (tiles(c) <= most)
    cell = F.when(named.isin(*cells) & fits(named), named)
    for c in prefer:
        cell = cell.when(fits(F.lit(c)), F.lit(c))
    small = (w <= single) & (h <= single)
    cell = F.when(small, F.greatest(w, h)).otherwise(cell).cast("int")
    return F.struct(cell.alias("cell"), (~small & cell.isNotNull()).alias("is_grid"))
