"""Every registered query against its SQL twin, and the shape of the plans."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

import __spark_entry__ as entry  # noqa: E402
from abuse_lens.workload.oracle import ORACLE  # noqa: E402
from abuse_lens.workload.queries import QUERIES  # noqa: E402
from check import canonical, connect  # noqa: E402


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


# the optional text operators are tested in their own folder
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    theirs = connect(SF).execute(entry.oracle_sql()[name]).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["q_episodes", "q_decisions", "q_allowlist_join", "q_packets_in_regime", "q_amp_median", "q_rules"])
def test_no_nested_loops_without_broadcast(spark, name):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = final_plan(entry.queries()[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_flagship_scans_once_and_shuffles_counters_once(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = final_plan(entry.entry(spark))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert len(re.findall("FileScan parquet", plan)) == 1
    assert "Python" not in plan and "InPandas" not in plan


def test_one_key_with_most_rows(spark):
    """A key far hotter than all others: sliced chain equals an unsliced one."""
    import random

    from abuse_lens.config import ReportConfig
    from abuse_lens.operators import deltas, episodes
    from helpers import counter, counters

    rng = random.Random(11)
    rows, total = [], 0
    for i in range(3000):
        total += rng.choice([0, 0, 100, 9000, 9000])
        rows.append(counter(60 * i, total, ip=1, hs=total // 100))
    for ip in range(2, 40):
        rows += [counter(60 * i, 5000 * i * (ip % 3), ip=ip) for i in range(rng.randrange(1, 30))]
    table = counters(spark, rows)
    results = []
    for width in (3, 64, 10**6):
        cfg = ReportConfig(slice_intervals=width)
        d = deltas.with_deltas(table, width * 60)
        ep = episodes.detect_episodes(deltas.interval_stats(d, cfg, 60), cfg, 60)
        results.append(sorted(map(tuple, ep.collect()), key=repr))
    assert results[0] == results[1] == results[2] and len(results[0]) > 300
