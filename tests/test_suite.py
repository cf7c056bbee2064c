"""The study's adjusted models on the test tables against dense matrices of the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionlab.operators import covariates as cv
from mentionlab.operators import suite
from mentionlab.plans import view
from tests.test_frames import dense_gee

NUMERIC, CATEGORICAL = ("child", "year_c"), ("age_band", "register")


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    r = cv.prepare(view.frame(spark, sf_dir), view.GROUPS, ("age_band", "register"), ("child", "multi"))
    keep = r.where("incident_id % 5 < 2").select("incident_id", "article_id", "exposed", "outcome", "strict", "body", "entity", "entity_group", "tier", "multi", "is_wire", *NUMERIC, *CATEGORICAL)
    return spark.createDataFrame(keep.collect(), keep.schema).cache()


def dense(rows, exposure="exposed", outcome="outcome", keep=lambda r: True, covariates=True, exchangeable=True):
    own = [r for r in rows if keep(r)]
    bands = sorted({r.age_band for r in own})[1:] if covariates else []
    registers = sorted({r.register for r in own})[1:] if covariates else []
    numbers = ([float(r.child), r.year_c] for r in own) if covariates else ([] for _ in own)
    data = [(r.incident_id, float(r[outcome]), [float(exposure(r)) if callable(exposure) else float(r[exposure]), *n, *[float(r.age_band == b) for b in bands], *[float(r.register == g) for g in registers]]) for r, n in zip(own, numbers, strict=True)]
    b, se, _ = dense_gee(data, None, exchangeable, rounds=80)
    return b[1], se[1]


def test_contrasts_with_matched_pairs(spark, rows):
    from mentionlab.operators.inference import discordance

    raw = rows.collect()
    matched = discordance(rows.where("exposed = 1 AND multi = 1"), "outcome", "body")
    pairs = {"against other_bev": ("exposed", "other_bev"), "against premium": ("exposed", "premium"), "none": ("exposed",)}
    got = {r.frame: r for r in suite.adjusted_contrasts(rows, pairs, NUMERIC, CATEGORICAL, matched=matched).collect()}
    assert set(got) == {*pairs, "within incidents"} and got["none"].p is None and got["none"].p_holm is None
    for name in ("against other_bev", "against premium"):
        assert (got[name].log_or, got[name].se) == pytest.approx(dense(raw, keep=lambda r: r.entity_group in pairs[name]), abs=1e-6)  # noqa: B023
    own = [r for r in raw if r.exposed and r.multi]
    b, c = sum(r.outcome > r.body for r in own), sum(r.outcome < r.body for r in own)
    assert got["within incidents"].odds_ratio == pytest.approx(b / c) and got["within incidents"].se == pytest.approx(math.sqrt(1 / b + 1 / c))
    family = sorted((r.p, r.frame) for r in got.values() if r.p is not None)
    top = 0.0
    for i, (p, frame) in enumerate(family):
        top = min(1.0, max(top, (len(family) - i) * p))
        assert got[frame].p_holm == pytest.approx(top)


def test_controls_and_sensitivities(spark, rows):
    raw = rows.collect()
    got = {r.frame: (r.log_or, r.se) for r in suite.adjusted_controls(rows, "body", F.col("entity") == "BUILDING", NUMERIC, CATEGORICAL).collect()}
    assert got["outcome control"] == pytest.approx(dense(raw, outcome="body"), abs=1e-6)
    assert got["exposure control"] == pytest.approx(dense(raw, exposure=lambda r: r.entity == "BUILDING", keep=lambda r: not r.exposed), abs=1e-6)
    parts = {"all": F.lit(True), "tier 1": F.col("tier") == 1}
    got = {r.frame: (r.log_or, r.se) for r in suite.adjusted_sensitivities(rows, parts, NUMERIC, CATEGORICAL, {"strict": "strict"}, wire=rows.where("is_wire = 1")).collect()}
    want = {"all": dense(raw), "tier 1": dense(raw, keep=lambda r: r.tier == 1), "strict": dense(raw, outcome="strict"), "one per wire group": dense(raw, keep=lambda r: r.is_wire == 1), "independence": dense(raw, exchangeable=False), "unadjusted": dense(raw, covariates=False)}
    assert set(got) == set(want)
    for frame, numbers in want.items():
        assert got[frame] == pytest.approx(numbers, abs=1e-6), frame
    assert np.isfinite(list(got.values())).all()


def test_subgroups_behind_their_gates(spark, rows):
    raw = rows.collect()
    got = {r.frame: r for r in suite.exchangeable_subgroups(rows, ("tier", "age_band")).collect()}
    assert (got["tier = 1"].log_or, got["tier = 1"].se) == pytest.approx(dense(raw, keep=lambda r: r.tier == 1, covariates=False), abs=1e-6)
    few = suite.exchangeable_subgroups(rows.limit(20), ("tier",)).collect()
    assert all(r.log_or is None for r in few)
