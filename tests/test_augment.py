import numpy as np
from pyspark.sql import functions as F

from framewright.operators import augment as A


def test_noise_and_colour():
    rng = np.random.default_rng(0)
    x = np.full((40, 50, 3), 120, np.uint8)
    n = A.poisson_gaussian(x, 0.2, 5.0, rng)
    assert n.shape == x.shape and n.dtype == np.uint8 and 1 < n.std() < 20
    i = A.impulse(x, 0.1, rng)
    assert 0.05 < (i != x).any(axis=2).mean() < 0.15
    m = A.matched_colour(rng.integers(0, 50, (10, 10, 3)).astype(np.uint8), rng.integers(100, 200, (20, 20, 3)).astype(np.uint8))
    assert abs(m.mean() - 150) < 8


def test_pixels_run_on_executors(spark):
    df = spark.createDataFrame([("a", 2, 3, 1, bytearray(range(6))), ("b", 1, 1, 3, bytearray([1, 2, 3]))], "image_id string, height int, width int, channels int, pixels binary")
    got = {r.image_id: (r.height, r.width, list(r.pixels)) for r in A.on_pixels(df, lambda x, _: np.rot90(x)).collect()}
    assert got["a"] == (3, 2, [2, 5, 1, 4, 0, 3]) and got["b"] == (1, 1, [1, 2, 3])


def test_variants_and_similarity(spark):
    f = spark.createDataFrame([(f"i{i}",) for i in range(400)], "image_id string")
    assert A.flip_variants(f, None).count() == 1600 and A.orthogonal_variants(f, None).count() == 1600
    drawn = A.flip_variants(f, 0.5)
    assert drawn.count() == 400 and 120 < drawn.where("flip <> 'none'").count() < 280
    v = spark.createDataFrame([("a", 0, 0.5, 0.5, 0.2, 0.2), ("a", 1, 0.5001, 0.5, 0.2, 0.2), ("a", 2, 0.3, 0.5, 0.2, 0.2)], "image_id string, variant int, cx double, cy double, w double, h double")
    assert {r.variant: r.similar for r in A.too_similar(v).collect()} == {0: False, 1: True, 2: False}


def test_grid_positions_avoid_boxes(spark):
    f = spark.createDataFrame([("a", 100, 100), ("b", 100, 100)], "image_id string, width int, height int")
    b = spark.createDataFrame([("a", 0.0, 0.0, 50.0, 50.0)], "image_id string, x1 double, y1 double, x2 double, y2 double")
    p = [(r.image_id, r.rank, r.x, r.y) for r in A.grid_positions(f, b, 40, 40, 20, 2).collect()]
    assert ("a", 0, 60, 60) in p and all(x >= 50 or y >= 50 for i, _, x, y in p if i == "a") and len(p) == 4


def test_noise_parameters(spark):
    r = spark.range(1).select(A.noise_parameters("impulse", F.lit(2.0)).alias("p")).first().p
    assert abs(r.share - 0.15) < 1e-9


def test_donors_and_places_are_whole(spark, sf):
    import __spark_entry__
    from framewright.plans import views as V

    q = __spark_entry__.queries()
    pool = A.donor_pool(V.geometries(spark, sf).where("split = 'train'"), 100)
    turns = q["donor_turns"](spark, sf).collect()
    assert len(turns) == pool.count() and max(r.turn for r in turns) > 2
    places = q["paste_positions"](spark, sf).collect()
    train = {r.image_id for r in V.frames(spark, sf, "split").where("split = 'train'").select("image_id").collect()}
    assert {r.image_id for r in places} <= train and len({r.image_id for r in places}) > 0.9 * len(train) and max(r.rank for r in places) == 9


def test_patches_find_places_one_after_another(spark):
    frames = spark.createDataFrame([("i", 400, 300), ("i", 400, 300), ("j", 90, 90), ("k", None, 5), ("e", 500, 500)], "image_id string, width int, height int")
    boxes = spark.createDataFrame([("i", 0.0, 0.0, 150.0, 150.0), ("i", None, 0.0, 1.0, 1.0), ("x", 0.0, 0.0, 1.0, 1.0)], "image_id string, x1 double, y1 double, x2 double, y2 double")
    patches = spark.createDataFrame([("i", 0, 100, 80, "z"), ("i", 1, 100, 80, "z"), ("i", 1, 100, 80, "z"), ("i", 2, 390, 290, "z"), ("j", 0, 100, 80, "z"), ("k", 0, 1, 1, "z"), ("q", 0, 9, 9, "z"), (None, 0, 9, 9, "z"), ("e", 0, None, 9, "z")], "image_id string, patch_no int, pw int, ph int, x string")
    got = {(r.image_id, r.patch_no): (r.x, r.y) for r in A.placed_patches(frames, boxes, patches).collect()}
    assert set(got) == {("i", 0), ("i", 1)}
    rects = [(0, 0, 150, 150)] + [(x, y, x + 100, y + 80) for x, y in got.values()]
    assert all(a[2] <= b[0] or b[2] <= a[0] or a[3] <= b[1] or b[3] <= a[1] for n, a in enumerate(rects) for b in rects[:n])
    assert got["i", 0] == (240, 160)  # the grid place farthest from the box
    assert A.placed_patches(frames.limit(0), boxes, patches).count() == 0


def test_places_of_many_frames_are_those_of_each_frame():
    rng = np.random.default_rng(7)
    for most_iou, least_distance in ((0.0, 0.0), (0.2, 60.0)):
        n, size = 120, rng.integers(1, 900, (120, 2))
        n_boxes, n_patches = rng.integers(0, 9, n), rng.integers(0, 4, n)
        centre, half = rng.integers(0, 900, (n_boxes.sum(), 2)), rng.integers(-3, 200, (n_boxes.sum(), 2)) * 0.37
        boxes, patches = np.hstack([centre - half, centre + half]), rng.integers(0, 250, (n_patches.sum(), 2))
        boxes[0, 1] = np.nan
        want, j = [], 0
        for i, taken in enumerate(np.split(boxes, np.cumsum(n_boxes)[:-1])):
            for pw, ph in patches[j : j + n_patches[i]].tolist():
                at = A.place(int(size[i, 0]), int(size[i, 1]), taken, pw, ph, most_iou, least_distance)
                taken = taken if at is None else np.vstack([taken, [at[0], at[1], at[0] + pw, at[1] + ph]])
                want.append(at or (-1, -1))
            j += n_patches[i]
        got = A.places(size.astype(float), boxes, n_boxes, patches.astype(float), n_patches, most_iou, least_distance)
        assert got.tolist() == [list(w) for w in want] and (got >= 0).any() and (got < 0).any()


def test_paste_plan_calls_python_by_batches(spark, sf):
    import __spark_entry__
    from framewright.plans import views as V

    plan = __spark_entry__.queries()["paste_plan"](spark, sf)
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in physical and "FlatMapGroups" not in physical  # no call of its own for each frame
    rows = plan.collect()
    assert rows and len({(r.donor_image, r.donor_line) for r in rows}) == len({(r.image_id, r.patch_no) for r in rows}) == len(rows)
    named, whole = V.geometries(spark, sf, "cls_id"), V.geometries(spark, sf)
    assert named.count() == whole.count() and named.exceptAll(whole.select(named.columns)).count() == 0


def test_patches_keep_named_columns(spark):
    frames = spark.createDataFrame([("i", 400, 300), ("i", 300, 300), (None, 9, 9)], "image_id string, width int, height int")
    boxes = spark.createDataFrame([], "image_id string, x1 double, y1 double, x2 double, y2 double")
    patches = spark.createDataFrame([("i", 0, 100, 80.0, "b", 1), ("i", 0, 90, 80.0, "a", 2), ("i", 1, 301, 80.0, "c", 3), ("i", 2, 50, float("nan"), "d", 4), ("i", 3, 50, 50.0, None, None)], "image_id string, patch_no int, pw int, ph double, donor string, line int")
    got = {r.patch_no: (r.x, r.y, r.donor, r.line) for r in A.placed_patches(frames, boxes, patches, keep=["donor", "line"]).collect()}
    assert set(got) == {0, 3} and got[0] == (0, 0, "a", 2) and got[3][2:] == (None, None)  # of two sizes of a frame or patch the first, by size


def test_feathered_paste():
    rng = np.random.default_rng(3)
    image, patch = rng.integers(0, 255, (60, 80, 3), dtype=np.uint8), rng.integers(0, 255, (20, 30, 3), dtype=np.uint8)
    out = A.feathered(image, patch, 10, 15, 4)
    inside = np.zeros((60, 80), bool)
    inside[15:35, 10:40] = True
    assert (out[~inside] == image[~inside]).all()
    matched = A.matched_colour(patch, image[15:35, 10:40])
    assert (out[19:31, 14:36] == matched[4:16, 4:26]).all()  # beyond the rim the patch is whole
    assert np.abs(out[15, 10].astype(int) - image[15, 10]).max() <= np.abs(matched[0, 0].astype(int) - image[15, 10]).max() / 5 + 1
