"""Decontamination where names begin sentences, capitals aren't ASCII, case changes, or slots fill an item."""

from test_operators import documents

from cuesheet.llm import decontaminate


def test_names_at_sentence_starts_and_dense_items(spark):
    tom = "Tom has 5 red apples at home. Tom buys 3 more from the shop. Tom gives 2 of them away."
    emile = "After lunch Émile walks three miles and meets Zoé near the old bridge."
    dense = "add 3 4 5 6 7 8 plus 9 11"
    bench = spark.createDataFrame([(1, tom), (2, emile), (3, dense)], "item_id long, text string")
    rows = [
        (1, tom.replace("Tom", "Anna").replace("5", "8")), (2, emile.replace("Émile", "Óscar").replace("Zoé", "Anna").replace("three", "seven")),
        (3, f"so {dense} today"), (4, dense.replace("9", "10").replace("5", "55").replace("7", "77")), (5, emile.lower()), (6, tom.lower()),
        (7, "Tom has 5 red apples at home. Anna buys 3 more from the shop. Eve gives 2 of them away."), (8, tom),
    ]
    got = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.matches(documents(spark, rows), bench).collect())
    assert got == [(1, 1, "template"), (2, 2, "template"), (3, 3, "copy"), (5, 2, "copy"), (6, 1, "copy"), (8, 1, "copy")]
