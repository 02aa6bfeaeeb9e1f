import html

from pyspark.sql import functions as F

from alphaline import catalog
from alphaline.operators import kernels, manifest, metrics
from tests.conftest import DATA


def test_union_counts_every_layer(spark):
    layers = spark.createDataFrame([("a", 0, 0.1)] * 20_000, "label string, pos int, v double")
    assert abs(metrics.union_log(layers, "label", "pos", value="v").first().log_clear + 2107.2103) < 1e-3
    whole = {(r.label, r.pos): r.union_a for r in catalog.QUERIES["alpha_union"](spark, DATA).collect()}
    part = {(r.label, r.pos): r.u for r in catalog.pixels(spark, DATA).where("vec_id % 25 = 0").groupBy("label", "pos").agg((1 - F.product(1 - F.col("a") / 2550.0)).alias("u")).collect()}
    assert set(part) <= set(whole) and all(whole[k] > part[k] - 1e-6 for k in part) and sum(whole.values()) > sum(part.values())


def test_gallery_cells_hold_whole_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    cells = {r.page_id: r.cell for r in catalog.QUERIES["gallery_cells"](spark, DATA).collect()}
    assert cells == {k: html.escape(v) for k, v in pages.items()} and max(map(len, pages.values())) > 200


def test_hinge_spares_foreground_edges_and_soft_samples(spark):
    def sample(key, truth, logit):
        return key, [logit] * 25, [truth(k % 5) for k in range(25)]

    rows = spark.createDataFrame([sample("hard", lambda x: 255 if x == 0 else 0, 2.0), sample("soft", lambda x: 128 if x < 2 else 0, 9.0)], "k string, logit array<double>, truth array<int>")
    found = {r.k: r for r in kernels.background_losses(rows, ["k"], "logit", "truth", 5, 1, 0.5, 0.03).collect()}
    assert (found["hard"].n_bg, found["hard"].gated, found["hard"].hinge) == (15, 15, 30.0)
    assert (found["soft"].gated, found["soft"].hinge) == (0, 0.0) and found["soft"].n_bg == 10
    assert abs(found["hard"].bce - 15 * 2.126928) < 1e-4


def test_audit_covers_every_document_and_right_only(spark):
    left, right = (spark.createDataFrame([(i,) for i in ids], "doc_id long") for ids in ((1, 2, 3), (3, 4)))
    assert {r.side: r.n for r in manifest.one_sided(left, right, "doc_id").collect()} == {"left_only": 2, "right_only": 1, "both": 1}
    found = {r.side: r.n for r in catalog.QUERIES["pair_audit"](spark, DATA).collect()}
    assert found["left_only"] + found["both"] == spark.read.parquet(f"{DATA}/documents.parquet").count()
