"""Many needles in many texts against looking for each in each."""

import random

import pyarrow as pa
import pytest

from cuesheet.operators import needles as many


@pytest.mark.parametrize("chunk", [1, 7, 64, many.CHUNK])
def test_hits_are_those_of_each_in_each(monkeypatch, chunk):
    monkeypatch.setattr(many, "CHUNK", chunk)
    rng = random.Random(chunk)
    for abc in ["ab", "abü", "aß日本x ", "abcdefgh\0"] * 8:
        made = lambda sizes: "".join(rng.choice(abc) for _ in range(rng.choice(sizes)))  # noqa: E731, B023
        texts = [None if rng.random() < 0.1 else made([0, 1, 2, 5, 9, 30, 200]) for _ in range(rng.randint(0, 20))]
        needles = {made([0, 1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 40]) for _ in range(40)} | {t[3 : 3 + rng.choice([8, 9, 12, 100])] for t in texts if t}
        needles = sorted(needles)
        rows = pa.array(["before", *texts, "after"], rng.choice([pa.string(), pa.large_string()])).slice(1, len(texts))
        row, which = many.Needles([s.encode() for s in needles]).find(rows)
        want = [(i, k) for i, t in enumerate(texts) if t is not None for k, s in enumerate(needles) if s in t]
        assert list(zip(row.tolist(), which.tolist(), strict=True)) == want


def test_no_needles_and_no_texts():
    assert len(many.Needles([]).find(pa.array(["a", None]))[0]) == 0
    assert len(many.Needles([b"a", b""]).find(pa.array([], pa.string()))[0]) == 0
    assert [x.tolist() for x in many.Needles([b"a", b""]).find(pa.array([None, "ba", ""]))] == [[1, 1, 2], [0, 1, 1]]
