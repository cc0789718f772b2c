"""One-to-one nearest matching without reuse.

Treated rows choose in their order, each the nearest control still free. That serial choice equals
deferred acceptance in which every control prefers the treated row that comes first, and proposals
may be made in any order, so it runs in rounds of joins and aggregates.

Controls that agree in all matching columns form a *cell* with a capacity: a group of copies of any
size is one candidate. A treated row first sees its ``m`` nearest cells; a row that loses them all
gets twice as many, until its candidates end. Between two equally near cells the one whose first
control comes first is preferred; inside a cell controls are handed out in their order.

Inside channels only crowded ones need the rounds: a channel of at most ``CROWDED`` rows is served as the definition
says, row by row, in the task that its rows are shuffled to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.operators.ordered import cut_points, scan
from cuesheet.session import materialise

Builder = Callable[[DataFrame, int], DataFrame]
#: Rows of a channel from which on it is matched in rounds.
CROWDED = 1000


def _below(probes: DataFrame, marks: DataFrame, keys: Sequence[str], x: str, cuts) -> DataFrame:
    """Probes with ``_p``, the number of marks of their key with a smaller ``x``."""
    both = marks.select(*keys, x, F.lit(1).alias("_k"), F.lit(1).alias("_one")).unionByName(
        probes.withColumns({"_k": F.lit(0), "_one": F.lit(0)}),
        allowMissingColumns=True,
    )
    s = scan(both, keys, [x, "_k"], running={"_p": F.col("_one")}, cuts=cuts)
    return s.where(F.col("_k") == 0).select(*probes.columns, "_p")


def _around(probes: DataFrame, cells: DataFrame, keys: Sequence[str], x: str, m: int, cuts) -> DataFrame:
    """Each probe with up to m marks on either side (``cells`` is numbered by ``_pos`` per key)."""
    p = _below(probes, cells, keys, x, cuts)
    p = p.withColumn("_pos", F.explode(F.sequence(F.col("_p") - (m - 1), F.col("_p") + m)))
    return p.withColumnRenamed(x, "_x").drop("_p").join(cells, [*keys, "_pos"]).drop("_pos")


def _numbered(df: DataFrame, keys: Sequence[str], x: str, cuts) -> DataFrame:
    return scan(df, keys, [x], running={"_pos": F.lit(1)}, cuts=cuts)


def _top(edges: DataFrame, order: Sequence[Column], m: int) -> DataFrame:
    w = Window.partitionBy("t").orderBy(*order)
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)


def accept(treated: DataFrame, build: Builder, *, m: int = 4) -> DataFrame:
    """Deferred acceptance. treated: t, ord; edges of ``build``: t, ord, cell, cap, rank.

    Returns t, ord, cell and ``k``, the place of the treated row among those of its cell.
    """
    cuts = cut_points(treated, "ord")
    live = materialise(build(treated, m))
    left = live.count()
    sizes = {m: treated}
    while True:
        best = live.groupBy("t", "ord").agg(F.min_by(F.struct("cell", "cap"), "rank").alias("b")).select("t", "ord", "b.cell", "b.cap")
        held = scan(best, ["cell"], ["ord"], running={"k": F.lit(1)}, cuts=cuts)
        full = held.groupBy("cell").agg(
            F.max(F.when(F.col("k") <= F.col("cap"), F.col("ord"))).alias("_limit"),
            F.max("cap").alias("_cap"), F.count("*").alias("_n"),
        ).where(F.col("_n") >= F.col("_cap"))
        # a full cell never takes a later row again: all such edges go at once
        kept = materialise(
            live.join(full.select("cell", "_limit"), "cell", "left")
            .where(F.col("_limit").isNull() | (F.col("ord") <= F.col("_limit"))).drop("_limit")
        )
        n = kept.count()
        live, removed, left = kept, left - n, n
        if removed:
            continue
        more = None
        for size, asked in sorted(sizes.items(), reverse=True):  # a row moves up one size at most
            lost = materialise(asked.join(live.select("t").distinct(), "t", "left_anti"))
            if lost.isEmpty():
                continue
            sizes[size] = materialise(asked.join(lost.select("t"), "t", "left_anti"))
            wider = build(lost, size * 2)
            grown = wider.groupBy("t").agg(F.count("*").alias("_n")).where(F.col("_n") > size).select("t")
            wider = materialise(wider.where(F.col("rank") > size).join(grown, "t", "left_semi"))
            if not wider.isEmpty():
                sizes[size * 2] = sizes[size * 2].unionByName(lost) if size * 2 in sizes else lost
                more = wider if more is None else more.unionByName(wider)
        if more is None:
            return held.where(F.col("k") <= F.col("cap")).select("t", "ord", "cell", "k")
        live = materialise(live.unionByName(more))
        left = live.count()


def match_nearest(
    treated: DataFrame,
    controls: DataFrame,
    *,
    id_: str,
    value: str,
    keys: Sequence[str] = (),
    order: str | None = None,
    seq: str | None = None,
    m: int = 4,
) -> DataFrame:
    """Nearest by |value difference| (per ``keys``); treated in the order of value, then id.

    Output: keys, treated, control, gap.
    """
    keys, seq = list(keys), seq or id_
    t = _with_order(treated.where(F.col(value).isNotNull()), [order or value, id_])
    t = t.select(F.col(id_).alias("t"), "ord", *keys, F.col(value).cast("double").alias("x"))
    c = controls.where(F.col(value).isNotNull()).withColumn("x", F.col(value).cast("double"))
    cuts = cut_points(c, "x")
    cells = c.groupBy(*keys, "x").agg(F.count("*").alias("cap"), F.min(seq).alias("_first"))
    cells = materialise(_numbered(cells, keys, "x", cuts))

    def build(rows: DataFrame, m_: int) -> DataFrame:
        e = _around(rows.select("t", "ord", *keys, "x"), cells, keys, "x", m_, cuts)
        e = _top(e, [F.abs(F.col("x") - F.col("_x")), F.col("_first")], m_)
        return e.select("t", "ord", F.struct(*keys, "x").alias("cell"), "cap", "rank")

    t = materialise(t)
    got = accept(t, build, m=m)
    numbered = scan(
        c.select(*keys, "x", seq, id_).select(F.struct(*keys, "x").alias("cell"), F.col(seq).alias("_s"), F.col(id_).alias("control")),
        ["cell"], ["_s"], running={"k": F.lit(1)},
    )
    pairs = got.join(numbered, ["cell", "k"]).join(t.select("t", "x"), "t")
    return pairs.select(
        *[F.col(f"cell.{k}").alias(k) for k in keys], F.col("t").alias("treated"), "control",
        F.abs(F.col("x") - F.col("cell.x")).alias("gap"),
    )


def _serve(rows: list[tuple], max_days: int) -> Iterator[tuple]:
    """Pairs (treated, control, days, gap) of one channel; rows: treated or not, order, id, day, x."""
    first: dict[tuple, int] = {}
    free = []
    for t, seq, i, day, x in rows:
        if not t:
            at = (day, "nan" if x != x else x)
            first[at] = min(first.get(at, seq), seq)
            free.append((seq, i, day, x, at))
    for _, _, i, day, x in sorted((r for r in rows if r[0]), key=lambda r: r[1]):
        best = None
        for n, (seq, _, d, y, at) in enumerate(free):
            days = abs(d - day)
            if days <= max_days:
                gap = abs(y - x)
                rank = (days, gap != gap, 0.0 if gap != gap else gap, first[at], seq)
                if best is None or rank < best[0]:
                    best = (rank, n)
        if best is not None:
            _, control, d, y, _ = free.pop(best[1])
            yield i, control, abs(d - day), abs(y - x)


def _match_small(base: DataFrame, max_days: int) -> DataFrame:
    """Pairs of channels that a task can hold one at a time: they come as neighbouring rows."""
    kinds = {c: base.schema[c].dataType.simpleString() for c in ("_id", "ch")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out, types = None, [], [], None

        def block() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["channel", "treated", "control", "days", "gap"])

        for b in batches:
            types = [b.schema.field(0).type, b.schema.field(1).type, b.schema.field(1).type, pa.int64(), pa.float64()]
            for ch, i, day, x, seq, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ch != at:
                    out += [(at, *p) for p in _serve(rows, max_days)]
                    at, rows = ch, []
                    if len(out) > 10_000:
                        yield block()
                        out = []
                rows.append((t, seq, i, day, x))
        out += [(at, *p) for p in _serve(rows, max_days)]
        if out:
            yield block()

    near = base.select("ch", "_id", "day", "x", "_seq", "_t").repartition("ch").sortWithinPartitions("ch")
    return near.mapInArrow(run, f"channel {kinds['ch']}, treated {kinds['_id']}, control {kinds['_id']}, days bigint, gap double")


def match_in_channel(
    rows: DataFrame,
    *,
    id_: str,
    channel: str,
    day: str,
    span: str,
    treated: Column,
    seq: str,
    max_days: int = 180,
    m: int = 4,
    crowded: int = CROWDED,
) -> DataFrame:
    """Within a channel: nearest by (days apart, span gap), at most ``max_days`` apart.

    ``day`` is a day number, ``seq`` the input order. Channels of more than ``crowded`` rows are matched in rounds,
    with the same result. Output: channel, treated, control, days, gap.
    """
    base = rows.where(F.col(day).isNotNull() & F.col(span).isNotNull() & F.col(channel).isNotNull()).select(
        F.col(id_).alias("_id"), F.col(channel).alias("ch"), F.col(day).cast("bigint").alias("day"),
        F.col(span).cast("double").alias("x"), F.col(seq).cast("bigint").alias("_seq"), F.coalesce(treated, F.lit(False)).alias("_t"),
    )
    # fewer than one channel in `crowded` rows is large
    large = materialise(base.groupBy("ch").agg(F.count("*").alias("_n")).where(F.col("_n") > crowded).select("ch"))
    if large.isEmpty():
        return _match_small(base, max_days)
    small = _match_small(base.join(large, "ch", "left_anti"), max_days)
    return small.unionByName(_match_rounds(base.join(large, "ch", "left_semi"), max_days, m))


def _match_rounds(base: DataFrame, max_days: int, m: int) -> DataFrame:
    """Pairs of channels of any size, by deferred acceptance."""
    t = materialise(base.where("_t").select(F.col("_id").alias("t"), F.col("_seq").alias("ord"), "ch", "day", "x"))
    c = base.where(~F.col("_t"))
    day_cuts, x_cuts = cut_points(c, "day"), cut_points(c, "x")
    cells = c.groupBy("ch", "day", "x").agg(F.count("*").alias("cap"), F.min("_seq").alias("_first"))
    cells = materialise(_numbered(cells, ["ch", "day"], "x", x_cuts))
    days = materialise(_numbered(cells.select("ch", "day").distinct(), ["ch"], "day", day_cuts))

    def build(some: DataFrame, m_: int) -> DataFrame:
        near = _around(some.select("t", "ord", "ch", "day", "x"), days, ["ch"], "day", m_, day_cuts)
        # after the join `day` is the control's day and `_x` the treated row's
        near = near.withColumn("days", F.abs(F.col("day") - F.col("_x"))).where(F.col("days") <= max_days).drop("_x")
        e = _around(near, cells, ["ch", "day"], "x", m_, x_cuts)
        e = _top(e, [F.col("days"), F.abs(F.col("x") - F.col("_x")), F.col("_first")], m_)
        return e.select("t", "ord", F.struct("ch", "day", "x").alias("cell"), "cap", "rank")

    got = accept(t, build, m=m)
    numbered = scan(
        c.select(F.struct("ch", "day", "x").alias("cell"), "_seq", F.col("_id").alias("control")),
        ["cell"], ["_seq"], running={"k": F.lit(1)},
    )
    pairs = got.join(numbered, ["cell", "k"]).join(t.drop("ord", "ch"), "t")
    return pairs.select(
        F.col("cell.ch").alias("channel"), F.col("t").alias("treated"), "control",
        F.abs(F.col("day") - F.col("cell.day")).alias("days"), F.abs(F.col("x") - F.col("cell.x")).alias("gap"),
    )


def _with_order(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Dense order 1…n over the whole table without one task sorting it all."""
    return scan(df.withColumn("_all", F.lit(0)), ["_all"], list(dict.fromkeys(by)), running={"ord": F.lit(1)}).drop("_all")
