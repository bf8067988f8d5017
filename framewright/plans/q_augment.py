"""Queries of augmentation planning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import augment as A
from framewright.operators.ordered import numbered
from framewright.plans import views as V

U = lambda s: f"(('0x' || substr(md5(concat_ws(':', image_id, '{s}')), 1, 8))::bigint / 4294967296.0)"


def flip_plan(s: SparkSession, d: str) -> DataFrame:
    return A.flip_variants(V.frames(s, d, "split").where("split = 'train'").select("image_id"), 0.5, seed=3)


def augmented_boxes(s: SparkSession, d: str) -> DataFrame:
    b = V.annotations(s, d, "kind", "cls_id", "cx", "cy", "w", "h").where("kind = 'bbox' and split = 'train'")
    x = A.turned_boxes(A.orthogonal_variants(A.flipped_boxes(A.flip_variants(b, 0.5, seed=3)), 0.5, seed=5))
    return x.groupBy("cls_id", "flip", "turns").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cx"), 4).alias("cx"), F.round(F.sum("cy"), 4).alias("cy"), F.round(F.sum("w"), 4).alias("w"))


def donor_turns(s: SparkSession, d: str) -> DataFrame:
    return A.donor_turns(A.donor_pool(V.geometries(s, d).where("split = 'train'"), 100)).select("cls_id", "turn", "image_id", "line_no")


def paste_positions(s: SparkSession, d: str) -> DataFrame:
    g = V.geometries(s, d).where("split = 'train'").select("image_id", *[(F.col(c) * F.col(k)).alias(c) for c, k in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))])
    f = V.frames(s, d, "split", "width", "height").where("split = 'train'").select("image_id", "width", "height")
    return A.grid_positions(f, g, 200, 200, 160)


def paste_plan(s: SparkSession, d: str) -> DataFrame:
    """Each train frame takes the next two donors in order of use; where they fit, one after the other, is where they are pasted."""
    g = V.geometries(s, d, "cls_id").where("split = 'train'")
    pool = A.donor_pool(g.select("image_id", "line_no", "cls_id", "w_px", "h_px"), 100)
    donors = numbered(A.donor_turns(pool).select("turn", "cls_id", "image_id", "line_no", "w_px", "h_px"), [], ["turn", "cls_id", "image_id", "line_no"])
    donors = donors.select(F.col("image_id").alias("donor_image"), F.col("line_no").alias("donor_line"), F.expr("pos div 2").alias("frame_no"), (F.col("pos") % 2).cast("int").alias("patch_no"), F.ceil("w_px").cast("int").alias("pw"), F.ceil("h_px").cast("int").alias("ph"))
    f = V.frames(s, d, "split", "width", "height").where("split = 'train'").select("image_id", "width", "height")
    patches = numbered(f.select("image_id"), [], ["image_id"]).withColumnRenamed("pos", "frame_no").join(donors, "frame_no")
    boxes = g.select("image_id", *[(F.col(c) * F.col(k)).alias(c) for c, k in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))])
    return A.placed_patches(f, boxes, patches, keep=["donor_image", "donor_line"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (flip_plan, augmented_boxes, donor_turns, paste_positions, paste_plan)}
FLIP = f"case when {U(3)} < 0.5 then case floor({U(4)} * 3)::int when 0 then 'horizontal' when 1 then 'vertical' else 'both' end else 'none' end"
ORACLES = {
    "flip_plan": V.with_(V.IMG) + f"select image_id, {FLIP} as flip from img where split = 'train'",
    "augmented_boxes": V.with_(V.ANN, f"f as (select cls_id, image_id, {FLIP} as flip, cx, cy, w, h, case when {U(5)} < 0.5 then floor({U(6)} * 3)::int + 1 else 0 end as turns from ann where kind = 'bbox' and split = 'train')", "g as (select cls_id, flip, turns, case when flip in ('horizontal', 'both') then 1 - cx else cx end as cx, case when flip in ('vertical', 'both') then 1 - cy else cy end as cy, w, h from f)") + "select cls_id, flip, turns, count(*) as n, round(sum(case turns when 1 then 1 - cy when 2 then 1 - cx when 3 then cy else cx end), 4) as cx, round(sum(case turns when 1 then cx when 2 then 1 - cy when 3 then 1 - cx else cy end), 4) as cy, round(sum(case when turns in (1, 3) then h else w end), 4) as w from g group by 1, 2, 3",
    "donor_turns": V.with_(V.ANN, V.IMG, V.GEO) + "select cls_id, turn, image_id, line_no from (select cls_id, image_id, line_no, row_number() over (partition by cls_id order by (('0x' || substr(md5(concat_ws(':', image_id, line_no::varchar, '0')), 1, 8))::bigint / 4294967296.0), image_id, line_no) - 1 as turn from geo where split = 'train' and w_px >= 100 and h_px >= 100 and cls_id is not null)",
    "paste_positions": V.with_(
        V.ANN, V.IMG, V.GEO, "b as (select image_id, x1 * width as x1, y1 * height as y1, x2 * width as x2, y2 * height as y2 from geo where split = 'train')",
        "g as (select image_id, x, unnest(range(0, greatest(0, height - 200) + 1, 160)) as y from (select image_id, height, unnest(range(0, greatest(0, width - 200) + 1, 160)) as x from img where split = 'train'))",
        "j as (select g.image_id, x, y, case when x1 is not null and least(x + 200.0, x2) > greatest(x, x1) and least(y + 200.0, y2) > greatest(y, y1) then 1 else 0 end as hit, (x + 100.0 - (x1 + x2) / 2) * (x + 100.0 - (x1 + x2) / 2) + (y + 100.0 - (y1 + y2) / 2) * (y + 100.0 - (y1 + y2) / 2) as far from g left join b using (image_id))",
    ) + "select image_id, rank::int as rank, x::int as x, y::int as y from (select image_id, x, y, row_number() over (partition by image_id order by coalesce(min(far), 1e18) desc, y, x) - 1 as rank from j group by image_id, x, y having max(hit) = 0) where rank < 10",
}
