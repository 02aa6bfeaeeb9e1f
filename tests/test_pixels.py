import numpy as np
import pytest

from alphaline.operators import kernels
from alphaline.operators import pixels as px


@pytest.fixture
def square():
    a = np.zeros((100, 100))
    a[25:75, 25:75] = 1
    return a


def test_equal_maps_have_no_error(square):
    assert px.grad_error(square, square) == 0
    assert px.conn_error(square, square) == 0


def test_gradient_of_a_constant_is_zero():
    assert np.abs(px.gradient_magnitude(np.full((20, 30), 0.7))).max() < 1e-12


def test_gradient_of_a_ramp_is_its_slope():
    ramp = np.tile(np.arange(60) * 0.01, (40, 1))
    assert np.allclose(px.gradient_magnitude(ramp)[10:30, 15:45], 0.01, atol=1e-4)


def test_conn_error_sees_a_detached_island(square):
    pred = square.copy()
    pred[2:6, 2:6] = 1
    assert px.conn_error(pred, square) == pytest.approx(16 / 1000)


def test_components_are_four_connected():
    mask = np.array([[1, 0, 1], [0, 1, 1], [1, 0, 0]], bool)
    assert px.components(mask).tolist() == [[1, 0, 2], [0, 2, 2], [3, 0, 0]]
    assert px.largest_component(mask).sum() == 3
    assert not px.largest_component(np.zeros((3, 3), bool)).any()


def test_components_equal_flood_fill():
    mask = np.random.default_rng(1).random((25, 31)) < 0.55
    label = px.components(mask)
    seen, sizes = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        stack, n = [(y, x)], 0
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            n += 1
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < 25 and 0 <= d < 31 and mask[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    stack.append((c, d))
        sizes.append(n)
    assert np.bincount(label.ravel())[1:].tolist() == sizes


def test_compose_places_the_subject_only(square):
    fg, bg = np.ones((100, 100, 3)), np.zeros((50, 60, 3))
    out, alpha = px.compose(fg, square, bg, px.stream("a"))
    assert out.shape[:2] == alpha.shape and alpha.max() > 0.9
    assert np.allclose(out, alpha[..., None], atol=1e-9)
    again = px.compose(fg, square, bg, px.stream("a"))
    assert np.array_equal(out, again[0]) and np.array_equal(alpha, again[1])


def test_filters_keep_alpha_bit_by_bit(square):
    image = px.stream("f").random((100, 100, 3))
    for name in px.FILTERS:
        out, alpha = px.filtered(image, square, name)
        assert alpha is square and out.shape == image.shape


def test_defocus_keeps_an_opaque_subject(square):
    image = px.stream("b").random((100, 100, 3))
    out = px.defocus(image, square, 4)
    assert np.allclose(out[30:70, 30:70], image[30:70, 30:70])


def test_effects_leave_half_transparent_pixels(square):
    assert ((px.shadow(square, (3, 4), 3) > 0.05) & (px.shadow(square, (3, 4), 3) < 0.95)).any()
    _, alpha = px.light_effects(np.zeros((100, 100, 3)), square, px.stream("x"))
    assert alpha[square < 1].max() <= 0.9 and (alpha[square == 1] == 1).all()
    wisps = px.smoke(square, px.stream("s"))[square == 0]
    assert wisps.max() <= 0.5 + 1e-9 and (wisps[wisps > 0] >= 0.1).all()


def test_windows_keep_enough(square):
    for k in range(20):
        box = px.cut_window(square, px.stream(f"w{k}"))
        assert box is None or (box[2] - box[0]) * (box[3] - box[1]) >= 5000
    assert px.cut_window(np.zeros((9, 9)), px.stream("e")) is None


def test_compact_glow_is_zero_outside():
    assert px.compact_glow((50, 50), (25, 25), 10)[0, 0] == 0


def test_stack_unites_alphas():
    half = np.full((4, 4), 0.5)
    _, alpha = px.stack([(np.ones((4, 4, 3)), half), (np.ones((4, 4, 3)), half)], np.zeros((4, 4, 3)))
    assert np.allclose(alpha, 0.75)


def test_refine_changes_the_band_only(square):
    soft = px.gaussian(square, 6)
    out = px.refine(np.zeros((100, 100, 3)), soft, lambda crop: np.zeros(crop.shape[:2]))
    assert (out != soft).any() and np.array_equal(out[45:55, 45:55], soft[45:55, 45:55])


def test_model_names():
    assert kernels.model("raw")()(np.ones(2)).tolist() == [1, 1]
    assert kernels.model("raw+smooth")()(np.ones((9, 9))).shape == (9, 9)
    with pytest.raises(KeyError):
        kernels.model("none")


def test_predict_isolates_errors(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.9]), (2, None)], "id int, image array<double>")

    def load():
        return lambda a: a * 1.0 if a.dtype != object else 1 / 0

    found = {r.id: r for r in kernels.predict(rows, ["id"], "image", load).collect()}
    assert found[1].alpha == [0.1, 0.9] and found[2].error.startswith("ZeroDivisionError")


def test_a_stack_is_judged_image_by_image():
    pred, truth = np.random.default_rng(8).integers(0, 256, (2, 7, 9, 40)) / 255
    pred[..., 0], truth[..., 1], pred[..., 2] = 0, pred[..., 1], 1
    each = [(pred[..., k], truth[..., k]) for k in range(40)]
    for work in (px.conn_error, px.grad_error):
        assert np.allclose(work(pred, truth), [work(a, b) for a, b in each], rtol=0, atol=1e-12)
    found = px.largest_component(pred >= 0.5)
    assert all((found[..., k] == px.largest_component(a >= 0.5)).all() for k, (a, _) in enumerate(each))
    assert all((px.erode(pred >= 0.1, 1, True)[..., k] == px.erode(a >= 0.1, 1, True)).all() for k, (a, _) in enumerate(each))


def test_small_images_are_taken_in_stacks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(k, *rng.integers(0, 256, (2, 64 if k % 3 else 24)).tolist()) for k in range(60)] + [(60, None, [1] * 8), (61, [1] * 8, None), (62, [], [])]
    pairs = spark.createDataFrame(rows, "k long, p array<int>, g array<int>").coalesce(1)
    found = {r.k: (r.grad, r.conn) for r in kernels.pair_metrics(pairs, ["k"], "p", "g", 8).collect()}
    for k, p, g in rows[:60]:
        a, b = (np.array(x).reshape(-1, 8) / 255 for x in (p, g))
        assert found[k] == (pytest.approx(px.grad_error(a, b), abs=1e-9), pytest.approx(px.conn_error(a, b), abs=1e-9))
    assert len(found) == 63 and {found[k] for k in (60, 61, 62)} == {(None, None)}
    conn = kernels.pair_metrics(pairs, ["k"], "p", "g", 8, ("conn",))
    assert conn.columns == ["k", "conn"] and {r.k: r.conn for r in conn.collect()} == {k: v[1] for k, v in found.items()}
    calls = []
    monkeypatch.setattr(px, "conn_error", lambda a, b: calls.append(a.shape) or np.zeros(a.shape[2]))
    monkeypatch.setattr(kernels, "STACK_PIXELS", 640)
    got = []
    monkeypatch.setattr(type(pairs), "mapInArrow", lambda df, run, schema: got.extend(run(iter([df.toArrow().to_batches()[0]]))))
    kernels.pair_metrics(pairs.where("k < 60"), ["k"], "p", "g", 8, ("conn",))
    assert calls == [(3, 8, 20), *[(8, 8, 10)] * 4] and got[0].num_rows == 60


def test_all_metrics_of_stacks(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(k, rng.integers(0, 256, 64).tolist(), (rng.integers(0, 256, 64) * (rng.random(64) < 0.08)).tolist()) for k in range(50)]
    pairs = spark.createDataFrame(rows, "k long, p array<int>, g array<int>").coalesce(1)
    found = {(r.k, r.metric): r.value for r in kernels.all_metrics(pairs, ["k"], "p", "g", 8, 1, 12).collect()}
    expected = {}
    for k, p, g in rows:
        a, b = (np.array(x).reshape(8, 8) / 255 for x in (p, g))
        expected |= {(k, "sad"): np.abs(a - b).sum() / 1000, (k, "mae"): np.abs(a - b).mean(), (k, "mse"): ((a - b) ** 2).mean()}
        expected |= {(k, "grad"): px.grad_error(a, b), (k, "conn"): px.conn_error(a, b)}
        rest = a[px.erode(b == 0, 1, False)]
        if len(rest) >= 12:
            expected |= {(k, "bg_mae"): rest.mean(), (k, "bg_smear"): (rest > 0.05).mean()}
    assert 250 < len(expected) < 350 and found == pytest.approx(expected, abs=1e-12)
    shapes = []
    monkeypatch.setattr(px, "grad_error", lambda a, b: shapes.append(a.shape) or np.zeros(a.shape[2]))
    monkeypatch.setattr(type(pairs), "mapInArrow", lambda df, run, schema: list(run(iter(df.toArrow().to_batches()))) and df.selectExpr("k", *(f"0D {n.split()[0]}" for n in schema.split(", ")[1:])))
    kernels.all_metrics(pairs, ["k"], "p", "g", 8, 1, 12)
    assert shapes == [(8, 8, 50)]


def test_component_sizes_of_stacks(spark):
    rng = np.random.default_rng(12)
    rows = [(k, rng.integers(0, 256, 63).tolist()) for k in range(40)] + [(40, [0] * 63)]
    found = {r.k: (r.n_comp, r.largest) for r in kernels.component_sizes(spark.createDataFrame(rows, "k long, a array<int>"), "k", "a", 9, 100).collect()}
    each = {k: px.sizes(np.array(a).reshape(-1, 9) >= 100) for k, a in rows}
    assert found == {k: (len(s), s.max(initial=0)) for k, s in each.items()}
