import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaline.operators import generate
from alphaline.operators import pixels as px


@pytest.fixture
def square():
    alpha = np.zeros((100, 120))
    alpha[30:80, 30:90] = 1
    return alpha


def sources(spark, n=6):
    rng = np.random.default_rng(0)
    rows = [(f"s{k}" + ("_e00" if k == 5 else ""), [int(v) for v in rng.integers(0, 256, 144)], "hair") for k in range(n)]
    return spark.createDataFrame(rows, "id string, a array<int>, category string")


def test_a_resumed_run_equals_a_full_one(spark):
    rows = sources(spark).repartition(3)
    for kind, kernel in generate.KERNELS.items():
        whole = generate.make(generate.plan(rows, "id", kind, 2), ["copy_id", "category"], "a", 12, kernel).collect()
        there = spark.createDataFrame([(r.copy_id,) for r in whole[::3]], "copy_id string")
        rest = generate.make(generate.plan(rows, "id", kind, 2, existing=there), ["copy_id", "category"], "a", 12, kernel).collect()
        assert sorted(map(str, whole)) == sorted(map(str, rest + whole[::3])) and len(whole) == 10


def test_no_derivative_of_a_derivative_and_no_held_out_source(spark):
    out = spark.createDataFrame([("s1",)], "id string")
    planned = generate.plan(sources(spark), "id", "bokeh", F.when(F.col("id") == "s2", 0).otherwise(1), excluded=out)
    assert sorted(r.copy_id for r in planned.collect()) == ["s0_k00", "s3_k00", "s4_k00"]


def test_a_kernel_without_a_result_gives_nulls(spark):
    rows = spark.createDataFrame([("x", [0] * 16)], "id string, a array<int>")
    row = generate.make(generate.plan(rows, "id", "edge"), ["copy_id"], "a", 4, generate.edge_copy).first()
    assert row.copy_id == "x_e00" and row.a8 is None and row.rgb is None


def test_colour_images_are_used(spark):
    rows = spark.createDataFrame([("x", [255] * 4, [10, 20, 30] * 4)], "id string, a array<int>, rgb3 array<int>")
    row = generate.make(generate.plan(rows, "id", "bokeh"), ["copy_id"], "a", 2, generate.bokeh_copy, image="rgb3").first()
    assert row.rgb == [10, 20, 30] * 4


def test_edge_copies_cut_through_the_subject(square):
    for k in range(60):
        window = px.cut_window(square, px.stream(f"w{k}"))
        top, left, bottom, right = window
        part = square[top:bottom, left:right]
        assert part.size >= 0.5 * square.size - 1e-9
        sides = [part[0].any(), part[-1].any(), part[:, 0].any(), part[:, -1].any()]
        assert 1 <= sum(sides) <= 2
        assert 0 < part.sum() < square.sum()
    whole = [px.cut_window(np.ones((100, 120)), px.stream(f"w{k}")) for k in range(60)]
    twice = sum((bottom - top < 100) and (right - left < 120) for top, left, bottom, right in whole)
    assert 5 < twice < 40 and all((bottom - top) * (right - left) >= 6000 for top, left, bottom, right in whole)


def test_erosion_equals_brute_force():
    rng = np.random.default_rng(1)
    mask = rng.random((13, 17)) < 0.9
    for radius in (0, 1, 2):
        for outside in (False, True):
            wide = np.pad(mask, radius, constant_values=outside)
            brute = np.array([[wide[y : y + 2 * radius + 1, x : x + 2 * radius + 1].all() for x in range(17)] for y in range(13)])
            assert (px.erode(mask, radius, outside) == brute).all()


def test_block_means_repeat_the_last_pixel():
    assert px.block_means(np.array([[0.0, 1.0, 4.0]]), 2).tolist() == [[0.5, 4.0]]


def test_connectivity_counts_islands():
    truth = np.zeros((20, 20))
    truth[:10] = 1
    pred = truth.copy()
    pred[15:17, 3:7] = 0.8
    assert px.conn_error(pred, truth) == pytest.approx(8 * 0.8 / 1000)
    assert px.conn_error(truth, truth) == 0


def test_layers(square):
    colour = np.ones((100, 120, 3))
    fitted, alpha = px.fit(colour, square, 50, 50)
    assert alpha.shape == (41, 50) and fitted.shape == (41, 50, 3)
    _, placed = px.paste((colour, square), (60, 60), -30, -30)
    assert placed[:50, :60].all() and not placed[50:].any()
    assert px.clear_rectangles(square, (0, 0, 50, 120))[:50].sum() == 0
    assert np.allclose(px.rotated(square, 0), square) and px.rotated(square, 90).sum() == pytest.approx(square.sum(), rel=0.2)
    assert px.subject_layer(colour, square * 0, "ink", 30, 2) is None
    made = px.subject_layer(colour, square, "none", 30, 2)[1]
    assert made.shape == (29, 34) and made[2:-2, 2:-2].all() and not made[:2].any()


def test_lights_and_decorations_have_an_end():
    assert px.sunburst((50, 50), (25, 25), 10, 8)[0].max() == 0 < px.sunburst((50, 50), (25, 25), 10, 8).max()
    assert px.ring((50, 50), (25, 25), 10, 2)[25, 35] == 1 and px.ring((50, 50), (25, 25), 10, 2)[25, 25] == 0
    line = px.streak((50, 50), (25, 25), 0.0, 20, 1)
    assert line[25, 40] > 0.7 and line[30, 25] < 1e-4


def element(top, left, height, width, alpha=1.0, **more):
    return {"rgb": np.ones((4, 4, 3)) * 0.5, "alpha": np.full((4, 4), alpha), "top": top, "left": left, "height": height, "width": width, **more}


def test_templates():
    canvas, back = (200, 300), element(0, 0, 200, 300)
    parts = [element(20, 20, 100, 100), element(60, 60, 100, 100, 0.5), element(150, 250, 10, 10, angle=45, opacity=0.5)]
    shown, truth = px.render_template(canvas, [back, *parts])
    assert truth[30, 30] == 1 and truth[140, 140] == pytest.approx(0.5) and truth[5, 5] == 0 and shown.shape == (200, 300, 3)
    assert px.render_template(canvas, parts) is None
    assert px.render_template((150, 300), [back, *parts]) is None
    assert px.render_template(canvas, [back] * 4) is None
    assert px.render_template(canvas, [back, *[element(0, 0, 3, 3)] * 3]) is None


def test_designs_keep_their_margin(square):
    for k in range(5):
        shown, alpha = px.design_sample([(np.ones((100, 120, 3)), square)] * 2, (80, 90), px.stream(f"d{k}"))
        assert shown.shape == (80, 90, 3) and 0 <= alpha.min() and alpha.max() <= 1 and alpha.max() > 0
        assert not alpha[:4].any() and not alpha[-4:].any() and not alpha[:, :4].any() and not alpha[:, -4:].any()
