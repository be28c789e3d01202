"""Songs are dealt out by the number of candidates, so what a task of the kit queries holds doesn't grow with the table."""

import math
import re

import pandas as pd
import pytest

from tessella import kit_queries, queries
from tessella.plans import kit

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q57_pads", "q58_kept_order", "q59_pad_slices", "q60_swapped_pad"])
def test_tasks_grow_with_the_candidates(spark, name, monkeypatch):
    want = queries.QUERIES[name](spark, DATA).toPandas()
    monkeypatch.setattr(kit, "TASK_ROWS", 250)
    got = queries.QUERIES[name](spark, DATA)
    tasks = math.ceil(kit_queries.found(spark, DATA).count() / 250)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert tasks > 20 and re.search(rf"hashpartitioning\(song_id#\d+L?, {tasks}\), REPARTITION_BY_NUM", plan)
    columns = sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got.toPandas(), want))
    pd.testing.assert_frame_equal(got, want)


def test_the_join_of_pads_has_tasks_by_its_slices(spark, monkeypatch):
    want = queries.QUERIES["q59_pad_slices"](spark, DATA).toPandas()
    monkeypatch.setattr(kit, "JOIN_ROWS", 250, raising=False)
    got = queries.QUERIES["q59_pad_slices"](spark, DATA)
    tasks = math.ceil(kit_queries.found(spark, DATA).count() / 250)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"hashpartitioning\(song_id#\d+L?, slice_id#\d+, {tasks}\), REPARTITION_BY_NUM", plan)) == 2
    assert not re.search(r"hashpartitioning\(song_id#\d+L?, slice_id#\d+, \d+\), ENSURE_REQUIREMENTS", plan)
    columns = sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got.toPandas(), want))
    pd.testing.assert_frame_equal(got, want)
