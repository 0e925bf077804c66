"""Grids of numbers as columns: masks, their components and outlines, texture, resampling, rasters.

A grid is an array of numbers by row and its width; each row of a table holds a
bounded grid, so nothing is moved.  The functions return columns.  They work on
all grids of one shape in an Arrow batch at once.

Edge cases: a null or empty grid, a width that does not divide its length, and a
grid with a null or infinite number give null (for struct results: null fields).
Repeated rows give repeated results.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_AROUND = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x]
#: Weights of the three channels (blue, green, red) in a grey level, in 2 ** -14. Fixed values.
GREY_WEIGHTS, GREY_SHIFT = (1868, 9617, 4899), 14
#: Levels at or beyond which a channel is clipped. Fixed values.
CLIP_LOW, CLIP_HIGH = 6, 249


def _by_shape(run, grids: int):
    """A function over series: ``grids`` grids, the width, further columns; ``run`` gets all rows of one shape as arrays and gives one result a row."""

    def f(*columns: pd.Series) -> pd.Series:
        values, width, more = columns[:grids], columns[grids], columns[grids + 1 :]
        out, shapes = [None] * len(width), defaultdict(list)
        for i, w in enumerate(width):
            row = [None if v.iloc[i] is None else np.asarray(v.iloc[i], float) for v in values]
            if not pd.isna(w) and w > 0 and all(r is not None and len(r) and len(r) == len(row[0]) and np.isfinite(r).all() for r in row) and len(row[0]) % int(w) == 0:
                shapes[len(row[0]) // int(w), int(w)].append((i, row))
        for (h, w), found in shapes.items():
            stacked = [np.stack([row[k] for _, row in found]).reshape(len(found), h, w) for k in range(grids)]
            for (i, _), x in zip(found, run(*stacked, *(m.iloc[[i for i, _ in found]].tolist() for m in more))):
                out[i] = x
        return pd.Series(out, dtype=object)

    return f


def _column(run, returns: str, grids, width, *more) -> Column:
    f = _by_shape(run, len(grids))
    n = len(grids) + 1 + len(more)
    plain = (lambda a, b: f(a, b)) if n == 2 else (lambda a, b, c: f(a, b, c)) if n == 3 else (lambda a, b, c, d: f(a, b, c, d))
    plain.__annotations__ = dict.fromkeys("abcd"[:n], pd.Series) | {"return": pd.Series}
    return F.pandas_udf(plain, returns)(*grids, width, *more)


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets (row, column) of the round neighbourhood of a cell, itself included."""
    r = max(int(radius), 1)
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if abs(x) <= round((r * r - y * y) ** 0.5)]


def dilated(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Cells that have a cell of the mask at one of the offsets; what lies outside the grid is not in the mask."""
    r = max(abs(v) for o in offsets for v in o)
    h, w = mask.shape[-2:]
    p = np.pad(mask, [(0, 0)] * (mask.ndim - 2) + [(r, r), (r, r)])
    out = np.zeros_like(mask)
    for y, x in offsets:
        out |= p[..., r + y : r + y + h, r + x : r + x + w]
    return out


def rooted(mask: np.ndarray, offsets=_AROUND) -> np.ndarray:
    """For each cell of (grids, rows, columns) the least cell number of its component, or the number of cells outside the mask.

    Each pass takes the least root around a cell, then the root of that root, so
    the passes grow slowly with a component's length.
    """
    k, h, w = mask.shape
    none = h * w
    at = np.where(mask, np.arange(none).reshape(h, w), none)
    while True:
        p = np.pad(at, ((0, 0), (1, 1), (1, 1)), constant_values=none)
        low = np.minimum.reduce([at, *(p[:, 1 + y : 1 + y + h, 1 + x : 1 + x + w] for y, x in offsets)])
        low = np.where(mask, low, none).reshape(k, -1)
        low = np.take_along_axis(np.pad(low, ((0, 0), (0, 1)), constant_values=none), low, 1).reshape(mask.shape)
        if np.array_equal(low, at):
            return at
        at = low


_COMPONENT = "label:int,area:int,left:int,top:int,width:int,height:int,touches:boolean,ring:int,inside:double,around:double,perimeter:double,outline_area:double,cells:array<int>"


def components(mask, grey, valid, width, min_area: int = 1, edge: int = 3, ring: int = 12, least_ring: int = 1) -> Column:
    """The 8-connected components of a mask (cells that are not 0), in the order of their first cells, as structs.

    label: from 1, over all components, also those below ``min_area``.  touches:
    the component reaches within ``edge`` cells of a cell that is not ``valid``.
    ring: valid cells outside the mask within ``ring`` cells.  inside, around:
    mean of ``grey`` over the component and over its ring; null if the ring has
    under ``least_ring`` cells, as there is nothing to compare with then.
    perimeter, outline_area: length of the outer contour through the cells'
    centres, and the area inside it.  cells: cell numbers.
    """

    def run(mask, grey, valid):
        mask, valid = mask != 0, valid != 0
        at = rooted(mask)
        h, w = mask.shape[1:]
        unsafe = dilated(~valid, disc(edge))
        around = disc(ring)
        reach = max(int(ring), 1)
        for k in range(len(mask)):
            cells = np.flatnonzero(mask[k])
            roots, member = np.unique(at[k].ravel()[cells], return_inverse=True)
            order = np.argsort(member, kind="stable")
            groups = np.split(cells[order], np.cumsum(np.bincount(member, minlength=len(roots)))[:-1]) if len(cells) else []
            out = []
            for label, own in enumerate(groups, 1):
                if len(own) < min_area:
                    continue
                y, x = own // w, own % w
                y0, x0 = max(0, y.min() - reach), max(0, x.min() - reach)
                box = (slice(y0, y.max() + reach + 1), slice(x0, x.max() + reach + 1))
                shape = np.zeros(mask[k][box].shape, bool)
                shape[y - y0, x - x0] = True
                near = dilated(shape, around) & ~mask[k][box] & valid[k][box]
                n = int(near.sum())
                enough = n >= max(1, least_ring)
                length, inner = outline(shape)
                out.append({
                    "label": label, "area": len(own), "left": int(x.min()), "top": int(y.min()), "width": int(np.ptp(x)) + 1, "height": int(np.ptp(y)) + 1, "touches": bool(unsafe[k].ravel()[own].any()), "ring": n,
                    "inside": float(grey[k][box][shape].mean()) if enough else None, "around": float(grey[k][box][near].mean()) if enough else None, "perimeter": length, "outline_area": inner, "cells": own.tolist(),
                })
            yield out

    return _column(run, f"array<struct<{_COMPONENT}>>", (mask, grey, valid), width)


#: Neighbours of a cell clockwise, from the one to the left.
_CLOCK = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def outline(shape: np.ndarray) -> tuple[float, float]:
    """(length, enclosed area) of the outer contour of one component, walked from cell to cell with the outside on the left."""
    p = np.pad(shape, 1)
    start = tuple(int(v) for v in np.unravel_index(int(p.argmax()), p.shape))
    here, back, first = start, 0, None
    length = area = 0.0
    while True:
        for i in range(1, 9):
            turn = (back + i) % 8
            there = here[0] + _CLOCK[turn][0], here[1] + _CLOCK[turn][1]
            if p[there]:
                break
        else:
            return 0.0, 0.0  # a single cell
        if (here, turn) == first:
            return float(length), abs(area) / 2
        first = first or (here, turn)
        length += 1.0 if turn % 2 == 0 else 2**0.5
        area += here[1] * there[0] - there[1] * here[0]
        # the cell looked at before the next one lies outside; seen from there it is the new way back
        y, x = here[0] + _CLOCK[turn - 1][0] - there[0], here[1] + _CLOCK[turn - 1][1] - there[1]
        here, back = there, _CLOCK.index((y, x))


def border_share(mask, width, margin: int = 12) -> Column:
    """Share of the outline cells of a mask that lie within ``margin`` cells of the frame; null for an empty or a full mask.

    Outline cells have the outside beside them: the background that reaches the
    frame, and what lies beyond it.  Holes, and what lies in them, do not count.
    """

    def run(mask):
        mask = mask != 0
        h, w = mask.shape[1:]
        back = np.pad(~mask, ((0, 0), (1, 1), (1, 1)), constant_values=True)
        cross = [(-1, 0), (1, 0), (0, -1), (0, 1)]
        outside = rooted(back, cross) == 0  # the padded corner reaches all of it
        line = mask & dilated(outside, cross)[:, 1:-1, 1:-1]
        y, x = np.arange(h)[:, None], np.arange(w)
        border = (y < margin) | (y >= h - margin) | (x < margin) | (x >= w - margin)
        for k, m in enumerate(mask):
            yield None if m.all() or not m.any() else float((line[k] & border).sum() / line[k].sum())

    return _column(run, "double", (mask,), width)


_TEXTURE = "noise:double,entropy:double,flat:double,top_share:double,distinct_share:double,clipped:double,sharpness:double"


def texture(values, width, channels: int = 1, block: int = 16, levels: int = 32, least: int = 32) -> Column:
    """Measures of a grid of levels 0 to 255, as a struct; with three channels the width counts all numbers of a row.

    noise: mean response of a second-difference stencil over cells that are not
    clipped, scaled to a deviation.  entropy: mean over blocks of the bits of the
    block's histogram of ``levels`` levels; blocks with under 60 % or ``least``
    cells that are not clipped do not count, and null means that none did.
    flat: share of cells (not clipped) without gradient.  top_share,
    distinct_share: cells in the 16 most frequent colours of 5 bits a channel, and
    distinct colours a cell.  clipped: share of clipped cells.  sharpness:
    variance of the Laplacian.  Beyond the frame cells are mirrored.
    """

    def run(raw):
        k, h = raw.shape[:2]
        cells = raw.astype(np.int64).reshape(k, h, -1, channels)
        w = cells.shape[2]
        keep = ~((cells <= CLIP_LOW) | (cells >= CLIP_HIGH)).any(axis=3)
        grey = cells[..., 0] if channels == 1 else (cells @ np.array(GREY_WEIGHTS) + (1 << GREY_SHIFT >> 1)) >> GREY_SHIFT
        p = np.pad(grey, ((0, 0), (1, 1), (1, 1)), mode="reflect").astype(float)
        at = lambda y, x: p[:, 1 + y : 1 + y + h, 1 + x : 1 + x + w]
        cross, corners = at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1), at(-1, -1) + at(-1, 1) + at(1, -1) + at(1, 1)
        second = np.abs(4 * grey - 2 * cross + corners)[:, 1:-1, 1:-1]
        laplace = cross - 4 * grey
        down = (at(1, -1) + 2 * at(1, 0) + at(1, 1)) - (at(-1, -1) + 2 * at(-1, 0) + at(-1, 1))
        right = (at(-1, 1) + 2 * at(0, 1) + at(1, 1)) - (at(-1, -1) + 2 * at(0, -1) + at(1, -1))
        flat = np.hypot(down, right) < 2.0
        colour = (cells >> 3) @ (1 << 5 * np.arange(channels - 1, -1, -1))
        for i in range(k):
            inner, ok = second[i], keep[i][1:-1, 1:-1]
            bits = []
            for y in range(0, h - block + 1, block):
                for x in range(0, w - block + 1, block):
                    here = keep[i, y : y + block, x : x + block]
                    n = int(here.sum())
                    if n < 0.6 * block * block or n < least:
                        continue
                    share = np.bincount(grey[i, y : y + block, x : x + block][here] * levels // 256)
                    share = share[share > 0] / n
                    bits.append(float(-(share * np.log2(share)).sum()))
            _, counts = np.unique(colour[i], return_counts=True)
            yield {
                "noise": float(np.sqrt(np.pi / 2) * (inner[ok] if ok.any() else inner).mean() / 6) if inner.size else 0.0,
                "entropy": float(np.mean(bits)) if bits else None,
                "flat": float((flat[i][keep[i]] if keep[i].any() else flat[i]).mean()),
                "top_share": float(np.sort(counts)[::-1][:16].sum() / (h * w)),
                "distinct_share": len(counts) / (h * w),
                "clipped": float(1 - keep[i].mean()),
                "sharpness": float(laplace[i].var()),
            }

    # a series of dicts cannot be a struct; an array of one can
    return F.get(_column(lambda raw: ([x] for x in run(raw)), f"array<struct<{_TEXTURE}>>", (values,), width), 0)


def _cover(n: int, m: int) -> np.ndarray:
    """Weights (m, n): the share of each of m equal parts of a line that each of n equal parts covers."""
    low, high = np.arange(m)[:, None] * n, (np.arange(m)[:, None] + 1) * n
    a, b = np.arange(n) * m, (np.arange(n) + 1) * m
    return np.maximum(0, np.minimum(high, b) - np.maximum(low, a)) / n


def resized(values, width, to_height: int = 32, to_width: int = 32, whole: bool = False) -> Column:
    """The grid at another size; a new cell is the mean of what it covers.  whole: rounded to whole levels, halves to even."""

    def run(grid):
        out = _cover(grid.shape[1], to_height) @ grid @ _cover(grid.shape[2], to_width).T
        return (np.rint(out) if whole else out).reshape(len(grid), -1).tolist()

    return _column(run, "array<double>", (values,), width)


def equalised(values, width, clip: float = 2.0, tiles: int = 8) -> Column:
    """Levels 0 to 255 with local contrast equalised: clipped histograms of tiles, blended between the tiles' centres.

    A grid that ``tiles`` does not divide is mirrored at its right and lower side,
    up to the next multiple of ``tiles`` beyond it.
    """

    def run(raw):
        k, h, w = raw.shape
        grey = np.clip(raw, 0, 255).astype(np.int64)
        more = (tiles - h % tiles, tiles - w % tiles) if h % tiles or w % tiles else (0, 0)
        p = np.pad(grey, ((0, 0), (0, more[0]), (0, more[1])), mode="reflect")
        th, tw = p.shape[1] // tiles, p.shape[2] // tiles
        area = th * tw
        limit = max(int(clip * area / 256), 1)
        tile = p.reshape(k, tiles, th, tiles, tw).transpose(0, 1, 3, 2, 4).reshape(k * tiles * tiles, area)
        hist = np.bincount((tile + 256 * np.arange(len(tile))[:, None]).ravel(), minlength=256 * len(tile)).reshape(-1, 256)
        excess = np.maximum(hist - limit, 0).sum(1)
        hist = np.minimum(hist, limit) + (excess // 256)[:, None]
        # what is left goes to every so many-th level, one each
        left = excess % 256
        step = np.maximum(256 // np.maximum(left, 1), 1)[:, None]
        level = np.arange(256)
        hist += (level % step == 0) & (level // step < left[:, None])
        curve = np.clip(np.rint(np.cumsum(hist, 1) * (255 / area)), 0, 255).reshape(k, tiles, tiles, 256)

        def between(n, size):
            f = np.arange(n) / size - 0.5
            low = np.floor(f).astype(int)
            return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), f - low

        y1, y2, fy = between(h, th)
        x1, x2, fx = between(w, tw)
        look = lambda y, x: curve[np.arange(k)[:, None, None], y[:, None], x, grey]
        upper, lower = look(y1, x1) * (1 - fx) + look(y1, x2) * fx, look(y2, x1) * (1 - fx) + look(y2, x2) * fx
        out = np.rint(upper * (1 - fy[:, None]) + lower * fy[:, None])
        return out.reshape(k, -1).tolist()

    return _column(run, "array<double>", (values,), width)


def rasterised(rings, source_width, source_height, size: int, min_area: float = 1.0) -> Column:
    """Cell numbers, rising, of the rings (arrays of x, y, x, y ...) of a photo, drawn into ``size`` x ``size`` cells.

    Rings of under 3 points or ``min_area`` are left out.  Corners are moved to
    the nearest cell; a cell belongs to the fill if an odd number of ring sides
    lies to its right, or if it lies on a side.  Null without rings or frame.
    """

    def one(rings, width, height):
        if rings is None or not width or not height:
            return None
        fill, edge = np.zeros((size, size), bool), np.zeros((size, size), bool)
        y, x = np.mgrid[:size, :size]
        for ring in rings:
            p = np.asarray(ring if ring is not None else [], float)
            p = p[: len(p) // 2 * 2].reshape(-1, 2)
            if len(p) < 3 or not np.isfinite(p).all() or abs((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()) / 2 < min_area:
                continue
            p = np.rint(p * (size / width, size / height)).astype(np.int64)
            for (xa, ya), (xb, yb) in zip(p, np.roll(p, -1, axis=0)):
                side = (xb - xa) * (y - ya) - (x - xa) * (yb - ya)  # 0 on the line; its sign tells the side
                edge |= (side == 0) & (x >= min(xa, xb)) & (x <= max(xa, xb)) & (y >= min(ya, yb)) & (y <= max(ya, yb))
                fill ^= ((ya > y) != (yb > y)) & ((side > 0) if yb > ya else (side < 0))
        return np.flatnonzero(fill | edge).tolist()

    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(a, b, c)], dtype=object)

    return F.pandas_udf(run, "array<int>")(rings, source_width, source_height)
