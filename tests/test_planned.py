"""The panel of all four conditions and all scores, and the bootstrap at its full number of resamples."""

import os

import pytest

from causeway.plans import panels

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_all_contrasts_of_all_scores(spark):
    rows = panels.panel_planned_contrasts(spark, DATA).collect()
    assert {r.metric for r in rows} == set(panels.ALL_METRICS) and len(rows) == 6 * 9
    assert sum(r.contrast.startswith("full_pipeline - ") for r in rows) == 3 * 9
    assert all(r.p_holm is None or r.p_holm >= r.p for r in rows)


def test_full_pipeline_in_the_model(spark):
    assert {r.condition_name for r in panels.panel_planned_anova(spark, DATA.replace("sf0.001", "sf0.01")).collect()} == set(panels.ALL_CONDITIONS)


def test_all_resamples(spark):
    rows = panels.panel_planned_bootstrap(spark, DATA.replace("sf0.001", "sf0.01")).collect()
    assert {r.contrast.split("|")[1] for r in rows} >= {"full_pipeline - single_pass", "no_few_shot - no_revision"}
    # edge scores that hardly differ have resamples without spread, which give no d_z
    assert all(r.resamples > 9_000 for r in rows if r.contrast.startswith("node_f1")) and all(r.low <= r.high for r in rows)
