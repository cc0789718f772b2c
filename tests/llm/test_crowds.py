"""Near-duplicate vectors in crowds larger than any list, against all pairs."""

import numpy as np
import pytest
from test_operators import plain_components

from cuesheet.llm import neighbours


def crowds(sizes, strays, seed=1, width=24):
    """Crowds of nearly equal vectors around centres of cosine 0.985 to the first, and vectors on their own."""
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(width, width)))
    out = []
    for k, n in enumerate(sizes):
        centre = q[0] if not k else 0.985 * q[0] + np.sqrt(1 - 0.985**2) * q[k]
        out += [centre + rng.normal(size=width) * 1e-5 for _ in range(n)]
    return np.array([*out, *rng.normal(size=(strays, width))])


@pytest.mark.parametrize("sizes,strays", [((200, 200), 600), ((150, 3, 40), 100)])
def test_links_between_crowds(spark, sizes, strays):
    v = crowds(sizes, strays)
    u = v / np.sqrt((v**2).sum(1))[:, None]
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    root = plain_components(len(v), [tuple(p) for p in np.argwhere(np.triu(near))])
    order = np.random.default_rng(3).permutation(len(v))  # ids don't follow the crowds
    table = spark.createDataFrame([(int(i), v[i].tolist(), 1) for i in order], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_duplicates(table).collect()}
    assert got == {i: (int(near[i].sum()), root[i]) for i in range(len(v))}
    assert max(n for n, _ in got.values()) > neighbours.SIZE * 10


def test_missed_recall_is_an_error(spark, monkeypatch):
    v = crowds((30,), 10)
    table = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(neighbours, "_audit", lambda *a: 0.5)
    with pytest.raises(RuntimeError, match="0.5000 of the audited links"):
        neighbours.near_duplicates(table, passes=2).collect()
