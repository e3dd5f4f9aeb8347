"""Views that are computed once."""

import os

import pytest
from reconcord.plans import views

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_views_behind_a_staged_one_read_what_was_written(spark):
    v = views.register(spark, DATA)
    want = v["inflows"].collect()
    got = views.with_staged(v, "payouts")["inflows"]
    assert not any("orders" in f for f in got.inputFiles())
    assert sorted(map(str, got.collect())) == sorted(map(str, want))
