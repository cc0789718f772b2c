import random
import zlib

import numpy as np
from cuesheet.llm import packing


def test_patterns_use_every_piece_once():
    rng = random.Random(3)
    for capacity in (10, 64, 2048):
        for _ in range(20):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 400))]
            lengths += [capacity // 3 or 1] * rng.randint(0, 300)
            histogram = {n: lengths.count(n) for n in set(lengths)}
            found = packing.patterns(histogram, capacity)
            used = {}
            for combination, times in found:
                assert sum(combination) <= capacity and times > 0
                for n in combination:
                    used[n] = used.get(n, 0) + times
            assert used == histogram
            table = packing.slots(found)
            bins = {}
            for n, rows in table.items():
                for rank in range(histogram[n]):
                    hit = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
                    step = rank - hit[0]
                    bins.setdefault(hit[1] + step // hit[2], []).append((hit[3] + step % hit[2] * n, n))
            assert len(bins) == sum(t for _, t in found)
            for pieces in bins.values():
                at = 0
                for offset, n in sorted(pieces):
                    assert offset == at
                    at += n
                assert at <= capacity


def test_fullest_is_the_best_sum():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 8))]
        room = rng.randint(0, 60)
        best = max(s for m in range(1 << len(lengths)) if (s := sum(x for k, x in enumerate(lengths) if m >> k & 1)) <= room)
        assert sum(packing.fullest({n: lengths.count(n) for n in lengths}, room)) == best


def test_encoder_agrees_with_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder()
    for text in ("", " ", "a", "a  b", " a\n b \n\nc's d", "é  x", "tab\t x", "it's  we'll", "x <|endoftext|> y", "  \n ", "1,000 a  b", "日本 語 x"):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_pack(spark):
    docs = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (2, None, 9), (None, "", 9), (3, "word " * 5000, 9), (4, "same", 9), (5, "same", 9)], "doc_id long, text string, length int")
    rows = packing.pack(docs, keep_ids=True).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] != 3 and r["doc_id"] is not None) == [1, 2, 2, 4, 5]
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 3)
    assert [p for p, _, _ in long] == list(range(len(long))) and all(n == 2048 for _, _, n in long[1:]) and long[1][1] == long[0][2]
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) == -(-total // 2048)
    assert packing.pack(docs.limit(0)).count() == 0
