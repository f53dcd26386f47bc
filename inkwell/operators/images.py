"""Pixel operators on image rows (page, height, width, data with three bytes a pixel, blue first), in NumPy per Arrow batch.

Grey is (29 B + 150 G + 77 R + 128) >> 8. Regions are 8-connected; a region's area is that of the
polygon through its border pixels' centres where the region is a solid rectangle, (w - 1)(h - 1),
and its pixel count less half its border otherwise, so it can differ from a traced contour's by a
few pixels on ragged borders.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Thresholds of dark and light regions, and the 5 x 5 elliptic structuring element.
DARK, LIGHT = 50, 240
ELLIPSE = ((0, 0, 1, 0, 0), (1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (0, 0, 1, 0, 0))


def pixels(height: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def grey(image: np.ndarray) -> np.ndarray:
    wide = image.astype(np.uint32)
    return ((29 * wide[..., 0] + 150 * wide[..., 1] + 77 * wide[..., 2] + 128) >> 8).astype(np.uint8)


def swapped(image: np.ndarray) -> np.ndarray:
    """Red and blue exchanged."""
    return image[..., ::-1]


def cropped(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    return image[y1:y2, x1:x2]


def _framed(mask: np.ndarray, rows: int, columns: int, value: bool = False) -> np.ndarray:
    """A mask in a frame; np.pad takes several times as long on small pictures."""
    height, width = mask.shape
    out = np.full((height + 2 * rows, width + 2 * columns), value)
    out[rows : rows + height, columns : columns + width] = mask
    return out


def _morph(mask: np.ndarray, grow: bool) -> np.ndarray:
    """Grown or shrunk by ELLIPSE: its three middle rows are five wide, the outer ones one."""
    height, width = mask.shape
    framed = _framed(mask, 2, 2, not grow)
    both = np.logical_or if grow else np.logical_and
    wide = both(framed[1:-1, :width], framed[1:-1, 4:])
    for x in (1, 2, 3):
        both(wide, framed[1:-1, x : x + width], out=wide)
    out = both(framed[:height, 2:-2], framed[4:, 2:-2])
    for y in (0, 1, 2):
        both(out, wide[y : y + height], out=out)
    return out


def cleaned(mask: np.ndarray) -> np.ndarray:
    """Closed, then opened."""
    closed = _morph(_morph(mask, True), False)
    return _morph(_morph(closed, False), True)


def _runs(mask: np.ndarray, corners: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column, column after and region of each run of set pixels in a row.

    Runs of neighbouring rows that touch (with `corners` also at a corner) are of one region; regions are
    numbered from 0 in order of their first pixel.
    """
    wide = _framed(mask, 0, 1).view(np.int8)
    edge = np.diff(wide, axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    m = len(row)
    if not m:
        return row, begin, end, row
    # runs of the row above that reach into this run's columns: they lie side by side
    span, reach = mask.shape[1] + 2, int(corners)
    low = np.searchsorted(row * span + end, (row - 1) * span + begin + 1 - reach, "left")
    high = np.searchsorted(row * span + begin, (row - 1) * span + end - 1 + reach, "right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(m), n)
    b = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    root = np.arange(m)
    while True:  # the least number of each region spreads, along whole chains at once
        new = root.copy()
        both = np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], both)
        np.minimum.at(new, root[b], both)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return row, begin, end, np.unique(root, return_inverse=True)[1]
        root = new


def _painted(shape: tuple[int, int], row: np.ndarray, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A picture with the value of each run at its pixels, 0 elsewhere."""
    out = np.zeros((shape[0], shape[1] + 1), np.int64)
    out[row, begin] += value
    out[row, end] -= value
    return np.cumsum(out, 1)[:, :-1]


def labelled(mask: np.ndarray) -> np.ndarray:
    """Numbers of the 8-connected regions from 1, in order of their first pixel."""
    row, begin, end, region = _runs(mask, True)
    return _painted(mask.shape, row, begin, end, region + 1)


def regions(mask: np.ndarray) -> list[dict]:
    """Box, area and number of each region, without those inside the holes of others being merged."""
    row, begin, end, region = _runs(mask, True)
    if not len(row):
        return []
    by = np.argsort(region, kind="stable")
    at = np.flatnonzero(np.diff(region[by], prepend=-1))
    x1, x2 = np.minimum.reduceat(begin[by], at), np.maximum.reduceat(end[by], at)
    y1, y2 = np.minimum.reduceat(row[by], at), np.maximum.reduceat(row[by], at) + 1
    size = np.add.reduceat((end - begin)[by], at)
    # a pixel is on the border if one beside, above or below it is not set
    padded = _framed(mask, 1, 1)
    border = mask & ~(padded[1:-1, :-2] & padded[1:-1, 2:] & padded[:-2, 1:-1] & padded[2:, 1:-1])
    along = np.concatenate([np.zeros((mask.shape[0], 1), np.int64), np.cumsum(border, 1)], 1)
    edge = np.bincount(region, along[row, end] - along[row, begin], len(at))
    out = []
    for k, (x, y, w, h, n) in enumerate(zip(x1.tolist(), y1.tolist(), (x2 - x1).tolist(), (y2 - y1).tolist(), size.tolist())):
        area = float((w - 1) * (h - 1)) if n == w * h else n - float(edge[k]) / 2 - 1
        out.append({"x": x, "y": y, "w": w, "h": h, "area": area, "label": k + 1})
    return out


def dark_candidates(images: DataFrame) -> DataFrame:
    """Candidate rows for geometry.dark_boxes of each image; filters and scores stay in SQL."""

    def found(frames):
        for frame in frames:
            rows = []
            for page, height, width, data in zip(frame["page"], frame["height"], frame["width"], frame["data"]):
                shade = grey(pixels(height, width, data))
                for i, r in enumerate(regions(cleaned(shade <= DARK))):
                    mean = float(shade[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]].mean())
                    rows.append((page, i, r["x"], r["y"], r["w"], r["h"], r["area"], mean, width, height))
            yield pd.DataFrame(rows, columns=["page", "ord", "x", "y", "w", "h", "area", "mean", "page_w", "page_h"])

    return images.select("page", "height", "width", "data").mapInPandas(found, "page long, ord int, x int, y int, w int, h int, area double, mean double, page_w int, page_h int")


def row_profiles(images: DataFrame) -> DataFrame:
    """Mean grey of each pixel row: (page, y, mean)."""

    def means(frames):
        for frame in frames:
            for page, height, width, data in zip(frame["page"], frame["height"], frame["width"], frame["data"]):
                yield pd.DataFrame({"page": page, "y": np.arange(height, dtype=np.int32), "mean": grey(pixels(height, width, data)).mean(1)})

    return images.select("page", "height", "width", "data").mapInPandas(means, "page long, y int, mean double")


def erase(image: np.ndarray, force_dark: bool = False) -> tuple[np.ndarray, bool, tuple[int, int, int, int]]:
    """Fill the largest region of a bubble with its ground; the picture, whether it is dark, and the region's box.

    Dark bubbles (mean grey under 100) are filled black, others white. Without a region all is filled.
    """
    shade = grey(image)
    dark = force_dark or float(shade.mean()) < 100
    mask = shade <= DARK if dark else shade > LIGHT
    out = image.copy()
    found = regions(mask)
    ground = 0 if dark else 255
    if not found:
        out[:] = ground
        return out, dark, (0, 0, image.shape[1], image.shape[0])
    best = max(found, key=lambda r: r["area"])
    out[_filled(labelled(mask) == best["label"])] = ground
    return out, dark, (best["x"], best["y"], best["x"] + best["w"], best["y"] + best["h"])


def _filled(region: np.ndarray) -> np.ndarray:
    """A region with its holes: all that the outside, 4-connected, does not reach."""
    free = np.pad(~region, 1, constant_values=True)
    row, begin, end, part = _runs(free, False)  # the run of the upper edge comes first: its region is the outside
    outside = _painted(free.shape, row, begin, end, (part == 0).astype(np.int64))
    return outside[1:-1, 1:-1] == 0


def erased(crops: DataFrame) -> DataFrame:
    """(page, bubble, data, is_dark) of crops (page, bubble, height, width, data, force_dark)."""

    def fill(frames):
        for frame in frames:
            rows = []
            for page, bubble, height, width, data, force in zip(*(frame[c] for c in ("page", "bubble", "height", "width", "data", "force_dark"))):
                picture, dark, _ = erase(pixels(height, width, data), bool(force))
                rows.append((page, bubble, picture.tobytes(), dark))
            yield pd.DataFrame(rows, columns=["page", "bubble", "data", "is_dark"])

    return crops.mapInPandas(fill, "page long, bubble long, data binary, is_dark boolean")


def cut_out(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """The pixels in each box of each page: (page, bubble, height, width, data, force_dark). boxes: (page, ord, x1, y1, x2, y2, is_dark)."""

    def crop(frames):
        for frame in frames:
            rows = []
            for page, height, width, data, found in zip(*(frame[c] for c in ("page", "height", "width", "data", "boxes"))):
                picture = pixels(height, width, data)
                for b in found:
                    part = cropped(picture, int(b["x1"]), int(b["y1"]), int(b["x2"]), int(b["y2"]))
                    if part.size:
                        rows.append((page, b["ord"], part.shape[0], part.shape[1], part.tobytes(), bool(b["is_dark"])))
            yield pd.DataFrame(rows, columns=["page", "bubble", "height", "width", "data", "force_dark"])

    from pyspark.sql import functions as F

    listed = boxes.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("ord", "x1", "y1", "x2", "y2", "is_dark"))).alias("boxes"))
    # Spark takes a picture for 100 bytes and would broadcast all of them; merged, both sides may be of any size
    return images.hint("merge").join(listed, "page").select("page", "height", "width", "data", "boxes").mapInPandas(crop, "page long, bubble long, height int, width int, data binary, force_dark boolean")
