import math
import random

from pyspark.sql import functions as F

from cuesheet.operators import matching


def cell_order(controls, key):
    """Reference order between equal keys: the cell whose first control comes first, then input order."""
    first = {}
    for c in controls:
        first.setdefault(key(c), c["seq"])
    return {c["id"]: (first[key(c)], c["seq"]) for c in controls}


def greedy_channel(rows, max_days=180):
    pairs = []
    for ch in {r["ch"] for r in rows}:
        own = [r for r in rows if r["ch"] == ch]
        controls = [r for r in own if not r["tr"]]
        tie = cell_order(controls, lambda c: (c["day"], c["dur"]))
        used = set()
        for t in (r for r in own if r["tr"]):
            free = [c for c in controls if c["id"] not in used and abs(c["day"] - t["day"]) <= max_days]
            if free:
                b = min(free, key=lambda c: (abs(c["day"] - t["day"]), abs(c["dur"] - t["dur"]), tie[c["id"]]))
                used.add(b["id"])
                pairs.append((t["id"], b["id"]))
    return sorted(pairs)


def run_channel(spark, rows, m):
    df = spark.createDataFrame(rows, "id long, ch long, day long, dur double, tr boolean, seq long")
    out = matching.match_in_channel(
        df, id_="id", channel="ch", day="day", span="dur", treated=F.col("tr"), seq="seq", m=m
    )
    return sorted((r["treated"], r["control"]) for r in out.collect())


def test_channel_matching_equals_greedy_walk(spark):
    rng = random.Random(1)
    rows = [
        # channel 0 is hot and crowded, so lists have to grow; equal days and durations occur
        dict(id=i, ch=0 if rng.random() < 0.6 else rng.randint(1, 4), day=rng.randint(0, 60) * 4,
             dur=float(rng.randint(60, 70)), tr=rng.random() < 0.5, seq=i)
        for i in range(60)
    ]
    assert run_channel(spark, rows, m=2) == greedy_channel(rows)


def test_channel_matching_small_cases(spark):
    mk = lambda i, ch, day, tr, dur=100.0: dict(id=i, ch=ch, day=day, dur=dur, tr=tr, seq=i)
    # one control, two treated: one pair; too far apart: none; never across channels
    rows = [
        mk(1, 1, 10, True), mk(2, 1, 12, True), mk(3, 1, 11, False),
        mk(4, 2, 0, True), mk(5, 2, 181, False),
        mk(6, 3, 0, True), mk(7, 4, 0, False),
    ]
    assert run_channel(spark, rows, 4) == [(1, 3)]


def test_log_matching_equals_greedy_walk(spark):
    rng = random.Random(5)
    treated = [dict(id=i, v=math.log(rng.randint(1, 40))) for i in range(25)]
    controls = [dict(id=100 + i, v=math.log(rng.randint(1, 40))) for i in range(28)]
    first = {}
    for c in controls:
        first.setdefault(c["v"], c["id"])
    free, want = list(controls), []
    for t in sorted(treated, key=lambda r: (r["v"], r["id"])):
        b = min(free, key=lambda c: (abs(c["v"] - t["v"]), first[c["v"]], c["id"]))
        free.remove(b)
        want.append((t["id"], b["id"]))
    out = matching.match_nearest(
        spark.createDataFrame(treated, "id long, v double"), spark.createDataFrame(controls, "id long, v double"),
        id_="id", value="v", m=2,
    )
    assert sorted((r["treated"], r["control"]) for r in out.collect()) == sorted(want)
