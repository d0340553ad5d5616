"""Registered queries without SQL do as much as their operators."""

from pyspark.sql import functions as F

from motilis import constants as K
from motilis.operators import estimation, geometry
from motilis.plans import catalog_more
from motilis.plans.fixtures import observations


def test_g5_gives_every_pixel(spark, sf):
    cam = geometry.scaled(geometry.CORPUS, 480)
    n = geometry.pixels(spark, cam).count()
    r = catalog_more.QUERIES["g5_analytic_flow"](spark, sf).agg(F.count(F.lit(1)), F.count_distinct("x", "y")).first()
    assert tuple(r) == (n, n)


def test_a4_and_a5_draw_all_resamples(spark, sf):
    assert catalog_more.QUERIES["a4_iid_interval"](spark, sf).first().b == K.BOOTSTRAP_B
    o = observations(spark, sf)
    want = estimation.design_effect(*(estimation.interval(f(o, K.BOOTSTRAP_B)) for f in (estimation.cluster_bootstrap_means, estimation.iid_bootstrap_means)))
    assert catalog_more.QUERIES["a5_design_effect"](spark, sf).first() == want.first()
