"""Box and polygon geometry as column expressions (no UDF): all stay in generated code.

Boxes are either normalised centre form (cx, cy, w, h in 0..1) or corners (x1, y1, x2, y2). Polygons are arrays of struct(x, y).
A null coordinate gives a null result; a degenerate box gives null where the function says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def envelope(df: DataFrame) -> DataFrame:
    """Add x1 y1 x2 y2 bw bh (normalised) and w_px h_px of a box or polygon label with the frame's width and height."""
    box = F.col("kind") == "bbox"

    def side(low: bool, c: str, centre: str, size: str) -> Column:
        along = F.transform("points", lambda p: p[c])
        return F.when(box, F.col(centre) - F.col(size) / 2 if low else F.col(centre) + F.col(size) / 2).otherwise(F.array_min(along) if low else F.array_max(along))

    out = df.withColumns({"x1": side(True, "x", "cx", "w"), "y1": side(True, "y", "cy", "h"), "x2": side(False, "x", "cx", "w"), "y2": side(False, "y", "cy", "h")})
    out = out.withColumns({"bw": F.col("x2") - F.col("x1"), "bh": F.col("y2") - F.col("y1")})
    return out.withColumns({"w_px": F.col("bw") * F.col("width"), "h_px": F.col("bh") * F.col("height")})


def corners(cx: Column, cy: Column, w: Column, h: Column, width: Column | float = 1.0, height: Column | float = 1.0) -> Box:
    """Normalised centre form to corners in pixels."""
    return (cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height


def to_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Pixel corners to struct(cx, cy, w, h), clipped to the frame; null if nothing is left."""
    a, c = clamp(F.least(x1, x2) / width), clamp(F.greatest(x1, x2) / width)
    b, d = clamp(F.least(y1, y2) / height), clamp(F.greatest(y1, y2) / height)
    return F.when((c > a) & (d > b), F.struct(((a + c) / 2).alias("cx"), ((b + d) / 2).alias("cy"), (c - a).alias("w"), (d - b).alias("h")))


def to_segment(points: Column, width: Column, height: Column) -> Column:
    """Pixel polygon to normalised points; points already in 0..1 are kept. Null under three points."""
    unit = F.forall(points, lambda p: (p["x"] >= 0) & (p["x"] <= 1) & (p["y"] >= 0) & (p["y"] <= 1))
    scaled = F.transform(points, lambda p: F.struct(clamp(F.when(unit, p["x"]).otherwise(p["x"] / width)).alias("x"), clamp(F.when(unit, p["y"]).otherwise(p["y"] / height)).alias("y")))
    return F.when(F.size(points) >= 3, scaled)


def rotate_quarter(cx: Column, cy: Column, w: Column, h: Column, k: int) -> Column:
    """A label turned with its frame by k quarter turns clockwise."""
    k %= 4
    a, b, c, d = ((cx, cy, w, h), (1 - cy, cx, h, w), (1 - cx, 1 - cy, w, h), (cy, 1 - cx, h, w))[k]
    return F.struct(a.alias("cx"), b.alias("cy"), c.alias("w"), d.alias("h"))


def rotate_points(points: Column, degrees: float, width: Column, height: Column) -> Column:
    """Normalised points turned about the frame's centre by an angle, clipped to the frame."""
    turn = F.radians(F.lit(degrees))

    def one(p: Column) -> Column:
        x, y = (p["x"] - 0.5) * width, (p["y"] - 0.5) * height
        return F.struct(clamp((x * F.cos(turn) - y * F.sin(turn)) / width + 0.5).alias("x"), clamp((x * F.sin(turn) + y * F.cos(turn)) / height + 0.5).alias("y"))

    return F.transform(points, one)


def box_points(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])


def points_box(points: Column) -> Column:
    """Envelope of points as struct(x1, y1, x2, y2)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def crop_box(box: Box, window: Box) -> Column:
    """Pixel box within a pixel window, as normalised struct(cx, cy, w, h) of the window; null without overlap."""
    x1, y1, x2, y2 = box
    left, top, right, bottom = window
    a, b, c, d = F.greatest(x1, left), F.greatest(y1, top), F.least(x2, right), F.least(y2, bottom)
    w, h = right - left, bottom - top
    return F.when((c > a) & (d > b), F.struct((((a + c) / 2 - left) / w).alias("cx"), (((b + d) / 2 - top) / h).alias("cy"), ((c - a) / w).alias("w"), ((d - b) / h).alias("h")))


def crop_points(points: Column, window: Box) -> Column:
    """Pixel polygon clamped into a pixel window and normalised to it; null when its envelope misses the window."""
    left, top, right, bottom = window
    e = points_box(points)
    moved = F.transform(points, lambda p: F.struct(clamp((p["x"] - left) / (right - left)).alias("x"), clamp((p["y"] - top) / (bottom - top)).alias("y")))
    return F.when((e["x2"] > left) & (e["x1"] < right) & (e["y2"] > top) & (e["y1"] < bottom), moved)


def offset_box(box: Box, left: Column, top: Column) -> Box:
    return box[0] + left, box[1] + top, box[2] + left, box[3] + top


def offset_points(points: Column, left: Column, top: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + left).alias("x"), (p["y"] + top).alias("y")))


def tile_starts(size: Column, tile: int, overlap: float) -> Column:
    """Starts of tiles along one side; the last tile is moved back to the border, a short side has the one tile 0."""
    step = max(1, round(tile * (1 - overlap)))
    fits = F.sequence(F.lit(0), F.greatest(F.lit(0), size - tile), F.lit(step))
    return F.array_distinct(F.concat(fits, F.array(F.greatest(F.lit(0), size - tile))))


def tiles(frames: DataFrame, tile_w: int, tile_h: int, overlap: float) -> DataFrame:
    """One row per frame and tile: left, top, right, bottom in pixels."""
    out = frames.withColumn("left", F.explode(tile_starts(F.col("width"), tile_w, overlap))).withColumn("top", F.explode(tile_starts(F.col("height"), tile_h, overlap)))
    return out.withColumn("right", F.least(F.col("left") + tile_w, "width")).withColumn("bottom", F.least(F.col("top") + tile_h, "height"))


def clip(box: Box, width: Column, height: Column) -> Box:
    x1, y1, x2, y2 = box
    low = F.lit(0.0)
    return F.greatest(low, F.least(x1, width)), F.greatest(low, F.least(y1, height)), F.greatest(low, F.least(x2, width)), F.greatest(low, F.least(y2, height))


def letterbox(width: Column, height: Column, size: int) -> Column:
    """Scale and padding that fit a frame into a square of `size`."""
    gain = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    return F.struct(gain.alias("gain"), ((size - F.bround(width * gain, 0)) / 2).alias("pad_x"), ((size - F.bround(height * gain, 0)) / 2).alias("pad_y"))


def pixel_corners(box: Box) -> list[Column]:
    """Corners as whole pixels, halves to even."""
    return [F.bround(c, 0).cast("int") for c in box]


def sanitize(cx: Column, cy: Column, w: Column, h: Column, least: float) -> Column:
    """Box clipped to the frame; null if a side is then under `least`."""
    x1, y1, x2, y2 = (clamp(c) for c in corners(cx, cy, w, h))
    return F.when((x2 - x1 >= least) & (y2 - y1 >= least), F.struct(((x1 + x2) / 2).alias("cx"), ((y1 + y2) / 2).alias("cy"), (x2 - x1).alias("w"), (y2 - y1).alias("h")))


def side_of(box: Box, roi: Box, tolerance: Column | float) -> Column:
    """Which side or corner of a region a box lies nearest to: the nearest side, with the second where both are about as near."""
    gaps = F.array_sort(F.array(*[F.struct(d.alias("d"), F.lit(n).alias("n")) for d, n in ((box[0] - roi[0], "left"), (box[1] - roi[1], "top"), (roi[2] - box[2], "right"), (roi[3] - box[3], "bottom"))]))
    one, two = gaps[0], gaps[1]
    apart = ~((one["n"].isin("left", "right") & two["n"].isin("left", "right")) | (one["n"].isin("top", "bottom") & two["n"].isin("top", "bottom")))
    return F.when(((two["d"] - one["d"]) <= tolerance) & apart, F.concat_ws("-", F.array_sort(F.array(one["n"], two["n"])))).otherwise(one["n"])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union of corner boxes; 0 without overlap."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / union)


def iou_centre(a: Box, b: Box) -> Column:
    """The same for centre-form boxes."""
    return iou(corners(*a), corners(*b))


def visibility(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Share of a normalised box's area that lies inside the frame."""
    inside = F.greatest(F.lit(0.0), clamp(x2) - clamp(x1)) * F.greatest(F.lit(0.0), clamp(y2) - clamp(y1))
    return inside / F.greatest((x2 - x1) * (y2 - y1), F.lit(1e-9))


def cvat_box(xtl: Column, ytl: Column, xbr: Column, ybr: Column, width: Column, height: Column) -> Column:
    """CVAT corners to struct(cx, cy, w, h); degenerate boxes give null."""
    return to_box(xtl, ytl, xbr, ybr, width, height)


def square_context(box: Box, width: Column, height: Column, padding: float) -> Column:
    """A square region around a pixel box with padding, moved and shrunk to lie in the frame."""
    side = F.least(F.greatest(box[2] - box[0], box[3] - box[1]) * (1 + 2 * padding), width.cast("double"), height.cast("double"))
    left = F.greatest(F.lit(0.0), F.least((box[0] + box[2]) / 2 - side / 2, width - side))
    top = F.greatest(F.lit(0.0), F.least((box[1] + box[3]) / 2 - side / 2, height - side))
    return F.struct(left.alias("left"), top.alias("top"), side.alias("side"))
