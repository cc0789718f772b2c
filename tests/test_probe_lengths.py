"""Probe gaps at the very length where the rule changes."""

from cuesheet.operators import timeaxis


def test_the_limit_is_the_exact_product_of_its_decimals(spark):
    # 1.1 - 0.5 and 0.4 * 1.5 are the same double, one step above 0.6
    assert 1.1 - 0.5 == 0.4 * 1.5 > 0.6
    df = spark.createDataFrame([(1, 0.5, 1.1), (2, 0.0, 0.6)], "item long, start_s double, end_s double")
    got = {r["item"]: (r["gap_s"], r["n_pairs"]) for r in timeaxis.probe_plan(df, "start_s", "end_s").collect()}
    assert got == {1: (0.4, 1), 2: (0.3, 2)}
