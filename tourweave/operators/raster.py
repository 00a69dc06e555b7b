"""Pixel operators on scanned cells, in NumPy behind Arrow.

A raster row is ``(image_id, width, height, rgba)``; every image is worked on by itself, so
memory is bounded by one image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Slopes that a column's shear is looked for at, and what counts as ink in lines and columns.
SHEARS = np.arange(-40, 41) * 0.002
DARK = 150


def grey(rgba: bytes, width: int, height: int) -> np.ndarray:
    """Brightness 0 to 255; too few bytes are padded white."""
    a = np.frombuffer(rgba, np.uint8)[: width * height * 4]
    a = np.concatenate([a, np.full(width * height * 4 - len(a), 255, np.uint8)]).reshape(height, width, 4).astype(np.float64)
    return a[..., 0] * 0.3 + a[..., 1] * 0.59 + a[..., 2] * 0.11


def to_rgba(g: np.ndarray) -> bytes:
    out = np.full((*g.shape, 4), 255, np.uint8)
    out[..., :3] = np.clip(g, 0, 255).astype(np.uint8)[..., None]
    return out.tobytes()


def _round(x):
    """To the nearest whole number, halves up."""
    return np.floor(np.asarray(x, np.float64) + 0.5).astype(np.int64)


def components(ink: np.ndarray) -> tuple[np.ndarray, int]:
    """Eight-connected components of a mask: labels from 1, 0 for paper.

    Runs of each row are joined to the runs of the row above that they touch (union-find over
    runs, not pixels).
    """
    labels = np.zeros(ink.shape, np.int64)
    parent = [0]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(ink):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        runs, k = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            label = 0
            while k < len(above) and above[k][1] < a:
                k += 1
            j = k
            while j < len(above) and above[j][0] <= b:
                other = find(above[j][2])
                if label:
                    low = min(find(label), other)
                    parent[find(label)] = parent[other] = low
                    label = low
                else:
                    label = other
                j += 1
            if not label:
                label = len(parent)
                parent.append(label)
            labels[y, a:b] = label
            runs.append((a, b, label))
        above = runs
    roots = np.array([find(i) for i in range(len(parent))])
    kept, dense = np.unique(roots, return_inverse=True)
    return dense[labels], len(kept) - 1


def clear_rules(g: np.ndarray, char_height: float, threshold: float = 165, keep: tuple[float, float, float, float] | None = None, keep_specks: bool = False) -> np.ndarray:
    """Black and white at ``threshold``, with only the shapes that may be letters or digits of the cell.

    Out go specks (both sides under 0.2 letter heights), rules (over 1.7 heights tall and under 0.35 wide,
    or over 2.5 wide and under 0.25 tall), whatever touches an edge, and shapes whose centre is
    outside of ``keep`` (x0, y0, x1, y1).  With ``keep_specks`` a speck within 0.15 heights of a larger shape
    stays, and so does a shape of which 0.45 lie between the kept heights.
    """
    labels, n = components(g < threshold)
    out = np.where(labels > 0, 0.0, 255.0)
    if not n:
        return out
    ys, xs = np.nonzero(labels)
    of = labels[ys, xs]
    x0, x1 = np.full(n + 1, g.shape[1]), np.full(n + 1, -1)
    y0, y1 = np.full(n + 1, g.shape[0]), np.full(n + 1, -1)
    for low, high, v in ((x0, x1, xs), (y0, y1, ys)):
        np.minimum.at(low, of, v)
        np.maximum.at(high, of, v)
    w, h = x1 - x0 + 1, y1 - y0 + 1
    speck = np.maximum(w, h) < 0.2 * char_height
    gone = (h > 1.7 * char_height) & (w < 0.35 * char_height) | (w > 2.5 * char_height) & (h < 0.25 * char_height)
    gone |= (x0 == 0) | (y0 == 0) | (x1 == g.shape[1] - 1) | (y1 == g.shape[0] - 1)
    if keep is not None:
        left, top, right, bottom = keep
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        within = np.maximum(0, np.minimum(y1, bottom) - np.maximum(y0, top) + 1) / np.maximum(h, 1)
        gone |= (cx < left) | (cx > right) | ((cy < top) | (cy > bottom)) & ~(keep_specks & (within >= 0.45))
    larger, reach = ~speck, 0.15 * char_height
    larger[0] = False
    for i in np.flatnonzero(speck[1:]) + 1:
        beside = keep_specks and (larger & (x0 - reach <= x1[i]) & (x1 + reach >= x0[i]) & (y0 - reach <= y1[i]) & (y1 + reach >= y0[i])).any()
        gone[i] |= not beside
    out[(labels > 0) & gone[labels]] = 255
    return out


def line_path(g: np.ndarray, char_height: float) -> tuple[np.ndarray, int]:
    """``(offsets, width of a strip)``: how far off the middle a text line runs in each vertical strip; a shortest path.

    Strips are 0.35 letter heights wide, windows 0.8 high, offsets 0.9 at most.  A strip's cost is less by the
    ink in its window, and more by 0.3 a point off the middle; a step costs a point each and is 0.15
    heights at most.  Ties take the higher place on the page.  Without room for a path there are no strips.
    """
    height, width = g.shape
    size = max(4.0, char_height)
    strip, window, step = max(2, int(_round(size * 0.35))), max(3, int(_round(size * 0.8))), max(1, int(_round(size * 0.15)))
    middle = int(_round(height / 2))
    reach = min(int(_round(size * 0.9)), int(np.floor(middle - window / 2)) - 1)
    if reach < 1:
        return np.empty(0, np.int64), strip
    ink = np.add.reduceat((g < DARK).astype(np.float64), np.arange(0, width, strip), axis=1)
    total = np.concatenate([np.zeros((1, ink.shape[1])), np.cumsum(ink, axis=0)])
    offsets = np.arange(-reach, reach + 1)
    top = middle + offsets - window // 2
    cost = total[np.minimum(top, height)] - total[np.minimum(top + window, height)] + 0.3 * np.abs(offsets)[:, None]
    apart = np.abs(offsets[:, None] - offsets[None, :])
    moves = np.where(apart <= step, apart, np.inf)
    best, back = cost[:, 0], []
    for s in range(1, ink.shape[1]):
        through = best[None, :] + moves
        back.append(through.argmin(axis=1))
        best = through.min(axis=1) + cost[:, s]
    at = [int(best.argmin())]
    for b in reversed(back):
        at.append(int(b[at[-1]]))
    return offsets[np.array(at[::-1])], strip


def follow_line(g: np.ndarray, char_height: float) -> np.ndarray:
    """The picture with each column shifted so that the text line runs straight through its middle."""
    height, width = g.shape
    path, strip = line_path(g, char_height)
    if not len(path):
        return g
    at = np.arange(width) / strip - 0.5
    a = np.clip(np.floor(at).astype(np.int64), 0, len(path) - 1)
    b, share = np.minimum(a + 1, len(path) - 1), np.clip(at - a, 0, 1)
    y = np.arange(height)[:, None] + _round(path[a] * (1 - share) + path[b] * share)[None, :]
    return np.where((y >= 0) & (y < height), g[np.clip(y, 0, height - 1), np.arange(width)[None, :]], 255.0)


def column_shear(g: np.ndarray, xref: float | None = None, char_height: float | None = None) -> list[tuple[float, float | None]]:
    """``(y, slope)`` of strips 7 letter heights high that overlap by half: the slope whose slanted histogram of ink is the most peaked.

    Slopes turn about ``xref``, the right edge.  Ties take the flatter slope; a strip with less ink than its height has none.
    """
    height, width = g.shape
    xref, char_height = width if xref is None else xref, height / 60 if char_height is None else char_height
    band = max(40, int(_round(char_height * 7)))
    step = max(20, int(_round(band / 2)))
    ys, xs = np.nonzero(g < DARK)
    flat_first = SHEARS[np.argsort(np.abs(np.arange(-40, 41)), kind="stable")]
    out = []
    for top in range(0, height, step):
        bottom = min(height, top + band)
        inside = (ys >= top) & (ys < bottom)
        y, x = ys[inside] - top, xs[inside] - xref
        slope = None
        if len(y) >= band:
            rows = [_round(y - s * x) for s in flat_first]
            slope = float(flat_first[int(np.argmax([int((np.bincount(r - r.min()) ** 2).sum()) for r in rows]))])
        out.append(((top + bottom) / 2, slope))
        if bottom == height:
            break
    return out


def smoothed(knots: list[tuple[float, float | None]]) -> list[tuple[float, float]]:
    """Median of three; unknown slopes take the known one nearest in height, of two the upper on the page; ends the upper of two values."""
    known = [(y, s) for y, s in knots if s is not None]
    if not known:
        return [(0.0, 0.0)]
    filled = [s if s is not None else min(known, key=lambda k: abs(k[0] - y))[1] for y, s in knots]
    out = []
    for i, (y, _) in enumerate(knots):
        three = sorted(filled[max(0, i - 1) : i + 2])
        out.append((y, three[len(three) // 2]))
    return out


def slope_at(knots: list[tuple[float, float]], y: np.ndarray) -> np.ndarray:
    return np.interp(y, [k[0] for k in knots], [k[1] for k in knots])


def straighten(g: np.ndarray, knots: list[tuple[float, float]], xref: float | None = None) -> np.ndarray:
    """Shear every row back about ``xref`` (the right edge), by the nearest pixel; what comes from outside is white."""
    height, width = g.shape
    y, x = np.mgrid[0:height, 0:width]
    source = _round(y + slope_at(knots, y) * (x - (width if xref is None else xref)))
    return np.where((source >= 0) & (source < height), g[np.clip(source, 0, height - 1), x], 255.0)


def straightened_words(words: pd.DataFrame, knots: list[tuple[float, float]], xref: float, left: float = 0.0, top: float = 0.0) -> pd.DataFrame:
    """Boxes read from a straightened column at ``left``, ``top``, back on the page; the line's own place is kept.

    A box takes the upper and the lower end of its tilt; blank words are dropped.
    """
    out = words[words["text"].fillna("").str.strip() != ""].copy()
    middle = (out["y0"] + out["y1"]) / 2
    slope = slope_at(knots, middle.to_numpy())
    ends = np.stack([slope * (out["x0"] - xref), slope * (out["x1"] - xref)])
    out["line_x"], out["line_y"] = left + xref, top + middle
    out["y0"], out["y1"] = top + out["y0"] + ends.min(axis=0), top + out["y1"] + ends.max(axis=0)
    out["x0"], out["x1"] = left + out["x0"], left + out["x1"]
    return out


def blank_right_of(g: np.ndarray, edge: float, lean: float, y0: float = 0.0) -> np.ndarray:
    """White out what does not lie left of an edge that leans with y."""
    y, x = np.mgrid[0 : g.shape[0], 0 : g.shape[1]]
    return np.where(x < edge + lean * (y - y0), g, 255.0)


def straight_column(page: np.ndarray, edge: float, lean: float = 0.0, y0: float = 0.0) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The customer column of a page, blanked right of its leaning edge and straightened, with the slopes that were taken out.

    It is as wide as the edge gets at the top, in the middle and at the bottom; slopes turn about its right end.
    """
    height, width = page.shape
    ends = [edge, *(edge + lean * (y - y0) for y in (0, height / 2, height))]
    own = max(1, min(width, int(np.ceil(max(ends)))))
    column = blank_right_of(page[:, :own], edge, lean, y0)
    knots = smoothed(column_shear(column, own, width / 60))
    return straighten(column, knots, own), knots


def crop(g: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    return g[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)]


def map_images(images: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a pixel operator to every image; images without pixels come back as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(len(b)):
                r = b.iloc[i]
                g = f(grey(r["rgba"], r["width"], r["height"])) if r["rgba"] is not None and r["width"] > 0 and r["height"] > 0 else None
                yield pd.DataFrame({"image_id": [r["image_id"]], "width": [r["width"] if g is None else g.shape[1]], "height": [r["height"] if g is None else g.shape[0]], "rgba": [r["rgba"] if g is None else to_rgba(g)]})

    return images.select("image_id", "width", "height", "rgba").mapInPandas(run, "image_id string, width int, height int, rgba binary")
