"""Rules are tried only where a text holds their words; that changes no result."""

from pyspark.sql import functions as F

from cuesheet.operators import scrub

TEXTS = [
    "A wide shot, SubTitles on top; black  bars, BLACK BARS left.", "soft ſubtitles here, then Karaoke text, end", "LYRİCS text, a pıllarbox; ok then",
    "Type that is Burned-In, seen on the channel name; mail @someone now", "hand-lettered words, nothing else; plain", "channelname, watermarks, blackbars", "", None,
]


def test_hints_change_no_rule(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    plain = F.transform(scrub.clauses(F.col("text")), lambda c: scrub.first_rule(c))
    got = scrub.scrub(df, "text").select("text", F.transform("removed", lambda r: r["rule"]).alias("got")).collect()
    want = df.select("text", F.filter(plain, lambda r: r.isNotNull()).alias("want")).collect()
    assert {r["text"]: r["got"] for r in got} == {r["text"]: r["want"] for r in want}
    found = {x for r in got for x in r["got"] or []}
    assert found == {name for name, _ in scrub.STRIP_RULES}


def test_texts_without_a_rules_words_are_not_searched(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    possible = [r[0] for r in df.select(scrub.possible_rules(F.col("text"))).collect()]
    assert possible[0] == [True, False, True, False] and possible[4] == [False, False, True, False] and possible[6] == [False] * 4
    assert possible[1] == possible[2] == [True] * 4


def test_other_rules_are_tried_on_every_clause(spark):
    df = spark.createDataFrame([("one red fish, two blue fish here",)], "text string")
    assert [r["rule"] for r in scrub.scrub(df, "text", (("red", r"\bred\b"),)).first()["removed"]] == ["red"]


def test_audit_judges_a_text_once(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(2)
    rows = scrub.audit_rows(scrub.scrub(df, "text"), ["doc_id"])
    assert rows.count() > 0
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
