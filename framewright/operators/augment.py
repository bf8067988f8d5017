"""Augmentation planning on tables, and pixel operations on raw grey or RGB arrays.

What is relational stays relational: variants are rows, label geometry is column expressions, budgets and donors are aggregates. Pixel
operations take struct rows (height, width, channels, pixels BINARY) through Arrow-batched functions; decoding image files is left to
the reader, since no image library is assumed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.geometry import iou, rotate_points, rotate_quarter
from framewright.operators.balance import uniform
from framewright.operators.evaluation import iou_matrix
from framewright.operators.ordered import numbered

# Noise parameters at intensity 0 and 1.
NOISE = {"gaussian": {"std": (2.0, 40.0)}, "poisson_gaussian": {"gain": (0.01, 0.6), "std": (1.0, 25.0)}, "impulse": {"share": (0.001, 0.15)}}
FLIPS = ("none", "horizontal", "vertical", "both")


def flip_variants(frames: DataFrame, probability: float | None, seed: int = 0) -> DataFrame:
    """Each frame with its flip variants: all four, or one drawn by hash with the given probability."""
    if probability is None:
        return frames.withColumn("flip", F.explode(F.array(*[F.lit(f) for f in FLIPS])))
    u = uniform("image_id", seed=seed)
    pick = F.element_at(F.array(*[F.lit(f) for f in FLIPS[1:]]), (F.floor(uniform("image_id", seed=seed + 1) * 3) + 1).cast("int"))
    return frames.withColumn("flip", F.when(u < probability, pick).otherwise("none"))


def orthogonal_variants(frames: DataFrame, probability: float | None, seed: int = 0) -> DataFrame:
    """Each frame with quarter turns 0 to 3: all, or one drawn by hash."""
    if probability is None:
        return frames.withColumn("turns", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return frames.withColumn("turns", F.when(uniform("image_id", seed=seed) < probability, (F.floor(uniform("image_id", seed=seed + 1) * 3) + 1).cast("int")).otherwise(0))


def flipped_boxes(labels: DataFrame) -> DataFrame:
    """Normalised box labels under their flip."""
    h, v = F.col("flip").isin("horizontal", "both"), F.col("flip").isin("vertical", "both")
    return labels.withColumn("cx", F.when(h, 1 - F.col("cx")).otherwise(F.col("cx"))).withColumn("cy", F.when(v, 1 - F.col("cy")).otherwise(F.col("cy")))


def turned_boxes(labels: DataFrame) -> DataFrame:
    """Normalised box labels under their quarter turns."""
    forms = [rotate_quarter(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), k) for k in range(4)]
    r = F.when(F.col("turns") == 1, forms[1]).when(F.col("turns") == 2, forms[2]).when(F.col("turns") == 3, forms[3]).otherwise(forms[0])
    return labels.withColumn("_r", r).withColumns({c: F.col(f"_r.{c}") for c in ("cx", "cy", "w", "h")}).drop("_r")


def rotated_polygons(labels: DataFrame, degrees: float) -> DataFrame:
    return labels.withColumn("points", rotate_points(F.col("points"), degrees, F.col("width"), F.col("height")))


def donor_pool(geo: DataFrame, least_px: float) -> DataFrame:
    """Instances large enough to be pasted elsewhere, with their class's use so far (0) and a random order."""
    return geo.where((F.col("w_px") >= least_px) & (F.col("h_px") >= least_px) & F.col("cls_id").isNotNull()).withColumn("order", uniform("image_id", "line_no"))


def donor_turns(pool: DataFrame) -> DataFrame:
    """The least-used-class donor order in closed form: the n-th donors of all classes come before any class's n+1-th."""
    placed = numbered(pool, ["cls_id"], ["order", "image_id", "line_no"])
    return placed.withColumnRenamed("pos", "turn")


def inserted_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per frame and class: labels that a step added."""
    a = after.groupBy("image_id", "cls_id").agg(F.count(F.lit(1)).alias("a"))
    b = before.groupBy("image_id", "cls_id").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, ["image_id", "cls_id"], "left").select("image_id", "cls_id", F.greatest(F.lit(0), F.col("a") - F.coalesce("b", F.lit(0))).alias("inserted")).where("inserted > 0")


def too_similar(variants: DataFrame, thr: float = 0.97) -> DataFrame:
    """Variants of a frame whose boxes all but repeat an accepted earlier one (mean best IoU >= thr); a frame's variants are few."""

    def judge(b: pd.DataFrame) -> pd.DataFrame:
        accepted: list[np.ndarray] = []
        out = []
        for v, rows in b.groupby("variant", sort=True):
            xy = np.stack([rows["cx"] - rows["w"] / 2, rows["cy"] - rows["h"] / 2, rows["cx"] + rows["w"] / 2, rows["cy"] + rows["h"] / 2], axis=1).astype(float)
            same = any(iou_matrix(xy, o).max(axis=1).mean() >= thr for o in accepted)
            if not same:
                accepted.append(xy)
            out.append((b["image_id"].iloc[0], int(v), bool(same)))
        return pd.DataFrame(out, columns=["image_id", "variant", "similar"])

    return variants.select("image_id", "variant", "cx", "cy", "w", "h").groupBy("image_id").applyInPandas(judge, "image_id string, variant int, similar boolean")


def grid_positions(frames: DataFrame, boxes: DataFrame, patch_w: int, patch_h: int, step: int, k: int = 10) -> DataFrame:
    """Per frame the k grid places for a patch farthest from all box centres that overlap none of them."""
    g = frames.withColumn("x", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("width") - patch_w), F.lit(step)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("height") - patch_h), F.lit(step))))
    j = g.join(boxes.select("image_id", "x1", "y1", "x2", "y2"), "image_id", "left")
    over = F.coalesce(iou((F.col("x").cast("double"), F.col("y").cast("double"), F.col("x") + float(patch_w), F.col("y") + float(patch_h)), tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))), F.lit(0.0))
    dx, dy = F.col("x") + patch_w / 2 - (F.col("x1") + F.col("x2")) / 2, F.col("y") + patch_h / 2 - (F.col("y1") + F.col("y2")) / 2
    far = dx * dx + dy * dy  # squares order as the distances do, and alike in every engine
    p = j.groupBy("image_id", "x", "y").agg(F.max(over).alias("over"), F.min(far).alias("far")).where("over = 0")
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(F.coalesce("far", F.lit(1e18)).alias("far"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))))), 1, k)
    return p.groupBy("image_id").agg(best.alias("b")).select("image_id", F.posexplode("b").alias("rank", "b")).select("image_id", "rank", (-F.col("b.nx")).alias("x"), (-F.col("b.ny")).alias("y"))


def place(width: int, height: int, taken: np.ndarray, pw: int, ph: int, most_iou: float, least_distance: float) -> tuple[int, int] | None:
    """The grid place of a patch inside a frame whose centre is farthest from those of all taken boxes, if one keeps clear of them."""
    if pw > width or ph > height:
        return None
    cell = max(8, int(max(pw, ph) * 0.8))
    x, y = (g.ravel() for g in np.meshgrid(np.arange(0, width - pw + 1, cell), np.arange(0, height - ph + 1, cell)))
    at = np.stack([x, y, x + pw, y + ph], axis=1).astype(float)
    if not len(taken):
        return int(x[0]), int(y[0])
    centre = lambda b: np.stack([b[:, 0] + b[:, 2], b[:, 1] + b[:, 3]], axis=1) / 2
    far = np.sqrt(((centre(at)[:, None] - centre(taken)[None]) ** 2).sum(axis=2)).min(axis=1)
    ok = (iou_matrix(at, taken).max(axis=1) <= most_iou) & (far >= least_distance)
    if not ok.any():
        return None
    best = min(np.flatnonzero(ok), key=lambda i: (-far[i], y[i], x[i]))
    return int(x[best]), int(y[best])


def places(size: np.ndarray, boxes: np.ndarray, n_boxes: np.ndarray, patches: np.ndarray, n_patches: np.ndarray, most_iou: float = 0.0, least_distance: float = 0.0) -> np.ndarray:
    """`place` for the patches of many frames at once, a frame's one after another: x and y of each patch, -1 and -1 where it finds no place.

    size has width and height of each frame, boxes x1 y1 x2 y2 and patches width and height, frame by frame; n_boxes and n_patches are
    the numbers of a frame's. All frames' first patches are placed together, then all second ones; frames whose grids are about as
    wide share one array, and are sorted by their boxes so that the k-th boxes of all are one slice of it.
    """
    held, at = n_boxes.copy(), np.full((len(patches), 2), -1, np.int64)  # a frame's room: its boxes, then its patches as they find a place
    room = np.concatenate([[0], np.cumsum(n_boxes + n_patches)])[:-1]
    first = np.cumsum(n_patches) - n_patches
    taken = np.zeros((len(boxes) + len(patches), 4))
    taken[np.arange(len(boxes)) + np.repeat(room - (np.cumsum(n_boxes) - n_boxes), n_boxes)] = boxes
    for turn in range(int(n_patches.max(initial=0))):
        f = np.flatnonzero(n_patches > turn)
        f = f[(patches[first[f] + turn] <= size[f]).all(axis=1)]  # NaN fits nowhere
        pw, ph = patches[first[f] + turn].astype(np.int64).T
        at[first[f] + turn] = 0  # where nothing is taken yet; the others follow
        cell = np.maximum(8, (np.maximum(pw, ph) * 0.8).astype(np.int64))
        nx, ny = (size[f, 0].astype(np.int64) - pw) // cell + 1, (size[f, 1].astype(np.int64) - ph) // cell + 1
        wide = np.where(nx > 16, -(-nx // 8) * 8, -(-nx // 2) * 2)
        rest = np.flatnonzero(held[f] > 0)
        rest = rest[np.lexsort([-held[f[rest]], wide[rest]])]
        load = np.cumsum(wide[rest] * ny[rest]) // 1_000_000  # frames whose arrays are in memory at a time
        cuts = np.flatnonzero((np.diff(wide[rest]) != 0) | (np.diff(load) != 0)) + 1
        for p in np.split(rest, cuts) if len(rest) else ():
            at[first[f[p]] + turn] = _places(cell[p], nx[p], ny[p], pw[p], ph[p], int(wide[p[0]]), taken, room[f[p]], held[f[p]], most_iou, least_distance)
        found = np.flatnonzero(at[first[f] + turn, 0] >= 0)
        xy = at[first[f[found]] + turn]
        taken[room[f[found]] + held[f[found]]] = np.column_stack([xy, xy[:, 0] + pw[found], xy[:, 1] + ph[found]])
        held[f[found]] += 1
    return at


def _places(cell: np.ndarray, nx: np.ndarray, ny: np.ndarray, pw: np.ndarray, ph: np.ndarray, wide: int, taken: np.ndarray, room: np.ndarray, held: np.ndarray, most_iou: float, least_distance: float) -> np.ndarray:
    """x and y of one patch in each of some frames with falling numbers of boxes held: a row of the arrays is a row of a frame's grid."""
    start, fr = np.cumsum(ny) - ny, np.repeat(np.arange(len(ny)), ny)
    x, y = np.arange(wide) * cell[:, None], (np.arange(len(fr)) - start[fr]) * cell[fr]
    xc, yc = (x + (x + pw[:, None])) / 2, (y + (y + ph[fr])) / 2
    far, clear = np.full((len(fr), wide), np.inf), (np.arange(wide) < nx[:, None])[fr] & (most_iou >= 0)
    for k in range(int(held[0])):
        m = int(np.searchsorted(-held, -k))  # frames that hold more than k
        r = slice(0, int(start[m - 1] + ny[m - 1]))
        of = fr[r]
        x1, y1, x2, y2 = taken[room[:m] + k].T
        dx, dy = (xc[:m] - ((x1 + x2) / 2)[:, None]) ** 2, (yc[r] - ((y1 + y2) / 2)[of]) ** 2
        d = dx[of]
        d += dy[:, None]
        np.minimum(far[r], d, out=far[r])
        w = np.minimum(x[:m] + pw[:m, None], x2[:, None]) - np.maximum(x[:m], x1[:, None])
        h = np.minimum(y[r] + ph[of], y2[of]) - np.maximum(y[r], y1[of])
        low = np.flatnonzero(h > 0)
        i, j = np.nonzero((w > 0)[of[low]])
        i = low[i]
        o = of[i]
        inter = w[o, j] * h[i]
        clear[i, j] &= inter / np.maximum((pw * ph)[o] + ((x2 - x1) * (y2 - y1))[o] - inter, 1e-12) <= most_iou
    far = np.sqrt(far)
    far[~(clear & (far >= least_distance))] = -1
    best = far.argmax(axis=1)  # the first of equals, so the lowest x; below, the lowest y
    far = far[np.arange(len(fr)), best]
    most = np.maximum.reduceat(far, start)
    some = np.flatnonzero((far == most[fr]) & (far >= 0))
    some = some[np.unique(fr[some], return_index=True)[1]]
    out = np.full((len(ny), 2), -1, np.int64)
    out[fr[some]] = np.column_stack([x[fr[some], best[some]], y[some]])
    return out


def placed_patches(frames: DataFrame, boxes: DataFrame, patches: DataFrame, most_iou: float = 0.0, least_distance: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """image_id, patch_no, x, y of the patches (image_id, patch_no, pw, ph) that find a place, one after another: each counts as taken for the next.

    The result also has the columns of patches named in keep. Each table is grouped by frame before they meet, and frames are placed
    many at a time; a frame's boxes and patches are few. Frames without size and patches of frames that are not there are left out;
    of repeated rows of a frame or a patch the first by size counts.
    """
    number = lambda *c: [F.col(x).cast("double").alias(x) for x in c]
    gathered = lambda df, *c: df.where("image_id is not null").groupBy("image_id").agg(F.collect_list(F.struct(*c)).alias("r"))
    f = frames.where("width > 0 and height > 0 and image_id is not null").groupBy("image_id").agg(F.min(F.struct(*number("width", "height"))).alias("f"))
    b = gathered(boxes.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null"), *number("x1", "y1", "x2", "y2")).withColumnRenamed("r", "b")
    p = gathered(patches.where("pw > 0 and ph > 0 and patch_no is not null"), *number("patch_no", "pw", "ph"), *keep).select("image_id", F.sort_array("r").alias("p"))
    rows = f.join(p, "image_id").join(b, "image_id", "left").select(F.col("image_id").cast("string").alias("image_id"), "f", F.coalesce("b", F.array().cast(b.schema["b"].dataType)).alias("b"), "p")

    def numbers(structs: pa.StructArray, *names: str) -> np.ndarray:
        return np.column_stack([structs.field(n).to_numpy(zero_copy_only=False) for n in names]).astype(float)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _together(batches, 10_000_000):
            size, (b, p) = np.trunc(numbers(t["f"], "width", "height")), (t[c].flatten() for c in "bp")
            n_b, n_p = (np.diff(t[c].offsets.to_numpy()).astype(np.int64) for c in "bp")
            of, n = np.repeat(np.arange(len(size)), n_p), numbers(p, "patch_no")[:, 0]
            once = np.ones(len(n), bool)
            once[1:] = (of[1:] != of[:-1]) | (n[1:] != n[:-1])
            once = np.flatnonzero(once)
            at = places(size, numbers(b, "x1", "y1", "x2", "y2"), n_b, np.rint(numbers(p, "pw", "ph")[once]), np.bincount(of[once], minlength=len(size)), most_iou, least_distance)
            found = np.flatnonzero(at[:, 0] >= 0)
            at, once = at[found], once[found]
            kept = p.take(pa.array(once))
            yield pa.RecordBatch.from_arrays([t["image_id"].take(pa.array(of[once])), pa.array(n[once].astype(np.int32)), *(pa.array(c.astype(np.int32)) for c in at.T), *(kept.field(c) for c in keep)], names=["image_id", "patch_no", "x", "y", *keep])

    return rows.mapInArrow(plan, ", ".join(["image_id string, patch_no int, x int, y int", *(f"`{c}` {patches.schema[c].dataType.simpleString()}" for c in keep)]))


def _together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches, some put together to about so many bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def feathered(image: np.ndarray, patch: np.ndarray, x: int, y: int, margin: int) -> np.ndarray:
    """The image with a patch pasted at (x, y), its colours matched to the place and its rim of `margin` pixels blended in."""
    h, w = patch.shape[:2]
    under = image[y : y + h, x : x + w]
    rim = np.minimum(np.minimum(np.arange(h)[:, None] + 1, h - np.arange(h)[:, None]), np.minimum(np.arange(w)[None] + 1, w - np.arange(w)[None]))
    share = np.minimum(1.0, rim / (margin + 1))[..., None]
    out = image.copy()
    out[y : y + h, x : x + w] = np.rint(share * matched_colour(patch, under) + (1 - share) * under).astype(np.uint8)
    return out


def noise_parameters(kind: str, intensity: Column) -> Column:
    """Parameters of a noise at an intensity of 0 to 1, by linear interpolation."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), intensity))
    return F.struct(*[(F.lit(a) + t * (b - a)).alias(n) for n, (a, b) in NOISE[kind].items()])


def poisson_gaussian(x: np.ndarray, gain: float, std: float, rng: np.random.Generator) -> np.ndarray:
    shot = rng.poisson(np.maximum(x, 0) / max(gain, 1e-6)) * gain if gain > 0 else x
    return np.clip(np.rint(shot + rng.normal(0, std, x.shape)), 0, 255).astype(np.uint8)


def impulse(x: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    u, out = rng.random(x.shape[:2]), x.copy()
    out[u < share / 2], out[u > 1 - share / 2] = 0, 255
    return out


def matched_colour(patch: np.ndarray, region: np.ndarray) -> np.ndarray:
    """The patch with the region's mean and standard deviation per channel."""
    p, r = patch.astype(float), region.astype(float)
    axes = (0, 1)
    out = (p - p.mean(axes)) / np.maximum(p.std(axes), 1e-6) * r.std(axes) + r.mean(axes)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def on_pixels(frames: DataFrame, change: Callable[[np.ndarray, str], np.ndarray]) -> DataFrame:
    """Apply a pixel function of (array, image_id) to rows of image_id, height, width, channels, pixels; the id seeds what is random."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                x = change(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, r.channels), r.image_id)
                out.append((r.image_id, x.shape[0], x.shape[1], x.shape[2], np.ascontiguousarray(x).tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "height", "width", "channels", "pixels"])

    return frames.select("image_id", "height", "width", "channels", "pixels").mapInPandas(run, "image_id string, height int, width int, channels int, pixels binary")
