"""Text columns: normalisation, scripts, titles, scrubbing patterns."""

from __future__ import annotations

import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from cuesheet.functions.numbers import as_col, rnd

# Title patterns that mark an item as something else than an original clip.
EXCLUDE_TITLE = (
    r"remix|リミックス|arrange|アレンジ|cover|カバー|歌ってみた|"
    r"instrumental|インスト|off\s*vocal|カラオケ|karaoke|remaster|"
    r"リマスター|ライブ|\blive\b|クロスフェード|xfd|trailer|予告|teaser|"
    r"ティザー|ラジオ|radio|mmd|talk|対談|インタビュー|interview|"
    r"メイキング|making|behind|tour|ツアー|試聴|digest|\breel\b|"
    r"anniversary|visualizer|session|発表会|解説|\bdj\b|performance|"
    r"つくってみた|studio\s*film|(dance|acoustic|piano|band|かわいい)\s*ver|"
    r"official\s*audio|メドレー|medley|全曲紹介|東方|touhou|mix\b|"
    r"を出します|\btr\.\s*\d|album\s*(preview|announcement)|"
    r"full\s*album|"
    r"직캠|fancam|안무|choreograph|dance\s*practice|무대|stage\s*mix|"
    r"lyric\s*video|리릭\s*비디오|콘서트|concert|응원법|비하인드|"
    r"교차편집|자컨|challenge|챌린지|reaction|리액션"
)
REQUIRED_MARKER = r"\bM/?V\b|official\s*(music\s*)?video|music\s*video|뮤직\s*비디오"
TITLE_MARK = r"\bMV\b|Music Video|ミュージックビデオ|뮤직비디오"
EMOJI = (
    r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2B00}-\x{2BFF}\x{FE0F}]"
)
# Script classes, the language label prefix and the thresholds of the line filters.
SCRIPTS = {"ko": "[가-힣]", "ja": "[ぁ-んァ-ヶ一-龯ー]"}
LATIN = "[A-Za-z]"
LANG_LABEL = r"^\s*(일본어|한국어|japanese|korean)\s*[:：]\s*"
MIN_SHARE = 0.3
MIN_LINE_CHARS = 2
MIN_LINES = 8
MIN_REPEAT_CHARS = 5
# Title phrase extraction.
BRACKETS = r"[\(\[【「『《〈].*?[\)\]】」』》〉]"
MARKERS = r"(official\s*)?(music\s*video|m/?v)|feat\.?\s*\S*|prod\.?\s*\S*"
SEPARATORS = r"[/|\-–—:·]+"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(x) -> Column:
    """Unicode NFKC. Plain ASCII is its own normal form, so only other text reaches Python."""
    c = as_col(x)
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(x) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(as_col(x), F.lit(WHITE))


def squash(x) -> Column:
    """Letters and digits only, lowered: the key for repetition and substring tests."""
    return F.lower(F.regexp_replace(as_col(x), r"[^\p{L}\p{N}]+", ""))


def script_share(x, lang: str, latin: bool = False) -> Column:
    """Share of characters in the script of ``lang``, optionally counting Latin letters too."""
    c = as_col(x)
    hits = F.regexp_count(c, F.lit(SCRIPTS[lang]))
    if latin:
        hits = hits + F.regexp_count(c, F.lit(LATIN))
    return hits / F.greatest(F.length(c), F.lit(1))


def title_columns(title) -> dict[str, Column]:
    t = as_col(title)
    return {
        "title_len": F.length(t).cast("bigint"),
        "title_has_emoji": t.rlike(EMOJI),
        "title_bracket_segments": F.regexp_count(t, F.lit(r"【[^】]*】|\[[^\]]*\]")).cast("bigint"),
        "title_has_mv_mark": t.rlike("(?iu)" + TITLE_MARK),
        "title_exclaim_count": F.regexp_count(t, F.lit("[!！]")).cast("bigint"),
    }


def title_phrase(title, channel) -> Column:
    """The longest title part that is not the channel name, squashed; '' when none is left."""
    bare = F.regexp_replace(as_col(title), BRACKETS, " ")
    bare = F.regexp_replace(bare, "(?iu)" + MARKERS, " ")
    parts = F.filter(F.transform(F.split(bare, SEPARATORS), squash), lambda p: p != "")
    ch = squash(F.coalesce(as_col(channel), F.lit("")))

    def longest(arr):
        ranked = F.transform(arr, lambda p, i: F.struct(F.length(p), -i, p.alias("p")))
        return F.array_max(ranked)["p"]

    own = longest(
        F.filter(parts, lambda p: (ch != "") & ~F.contains(ch, p) & ~F.contains(p, ch))
    )
    whole = F.coalesce(longest(parts), F.lit(""))
    stripped = F.when(ch != "", F.replace(whole, ch, F.lit(""))).otherwise(whole)
    return F.coalesce(own, F.when(F.length(stripped) >= 2, stripped), F.lit(""))


@F.pandas_udf(DoubleType())
def _deflate_ratio(s: pd.Series) -> pd.Series:
    def one(text):
        raw = text.encode("utf-8")
        return round(len(zlib.compress(raw, 9)) / len(raw), 4) if raw else None

    return s.map(one, na_action="ignore").astype("float64")


def deflate_ratio(x) -> Column:
    """Compressed over raw bytes (deflate level 9): lower means more repetitive."""
    return _deflate_ratio(as_col(x))


def let(value: Column, body) -> Column:
    """Bind an array expression to a lambda variable, so that it is evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pin(value: Column) -> Column:
    """Generator that fixes an expensive expression as a column.

    A filter on the result cannot be pushed below it, so the expression runs once per row and not
    once for the filter and again for the output.
    """
    return F.explode(F.array(value))


def collapse(lines: Column) -> Column:
    """Drop an array element equal to its predecessor (after filtering, as the caller did)."""
    return let(
        lines,
        lambda all_: F.filter(
            all_,
            lambda x, i: (i == 0)
            | (x["line"] != F.element_at(all_, F.greatest(i, F.lit(1)))["line"]),
        ),
    )


def repeat_of(lines: Column) -> Column:
    """The first element whose squashed line (5 characters or more) occurred before, by position.

    ``lines`` is array<struct<pos, t_s, line>>. One sort inside the row: equal keys become
    neighbours, every neighbour but the first of its run is a repetition, the earliest wins.
    """
    keyed = F.transform(
        lines, lambda x: F.struct(squash(x["line"]).alias("key"), x["pos"].alias("pos"), x["t_s"].alias("t_s"))
    )
    keyed = F.array_sort(F.filter(keyed, lambda x: F.length(x["key"]) >= MIN_REPEAT_CHARS))

    def earliest(run: Column) -> Column:
        again = F.zip_with(
            run,
            F.slice(run, 2, F.size(run)),
            lambda a, b: F.when(
                a["key"] == b["key"], F.struct(b["pos"].alias("pos"), b["t_s"].alias("t_s"))
            ),
        )
        return F.array_min(F.filter(again, lambda x: x.isNotNull()))

    return let(keyed, earliest)


def clean_lines(text, lang: str | None = None, latin: bool = False, share: float = MIN_SHARE) -> Column:
    """Text to array<struct<pos, t_s, line>>: trim, strip a language label, filter, collapse.

    ``t_s`` is 4 s per source line. Stays inside the row: no shuffle, whatever the text length.
    """
    raw = F.transform(
        F.split(as_col(text), LINE_BREAK),
        lambda x, i: F.struct(
            i.cast("bigint").alias("pos"),
            (i * 4).cast("bigint").alias("t_s"),
            strip(F.regexp_replace(strip(x), "(?iu)" + LANG_LABEL, "")).alias("line"),
        ),
    )

    def keep(x):
        ok = F.length(x["line"]) >= MIN_LINE_CHARS
        if lang:
            ok = ok & (script_share(x["line"], lang, latin) >= share)
        elif latin:
            ok = ok & (F.regexp_count(x["line"], F.lit(LATIN)) / F.greatest(F.length(x["line"]), F.lit(1)) >= share)
        return ok

    return collapse(F.filter(raw, keep))


def phrase_hits(lines: Column, phrase: Column) -> Column:
    """struct<first_s, count> of the lines containing the phrase; none for a phrase under 2 characters."""
    hit = F.when(F.length(phrase) >= 2, F.filter(lines, lambda x: F.contains(squash(x["line"]), phrase)))

    def summary(found: Column) -> Column:
        # negative index or size of a missing array must not count
        n = F.coalesce(F.size(found), F.lit(0))
        return F.struct(
            F.when(n > 0, found[0]["t_s"]).alias("first_s"),
            F.greatest(n, F.lit(0)).cast("bigint").alias("count"),
        )

    return let(F.coalesce(hit, F.slice(lines, 1, 0)), summary)


def id_from_url(x) -> Column:
    """The 11-character id inside a link, else the text itself."""
    c = as_col(x)
    found = F.regexp_extract(c, r"(?:v=|youtu\.be/|shorts/)([\w-]{11})", 1)
    return F.when(found != "", found).otherwise(c)


def ratio4(num, den) -> Column:
    return rnd(num / den, 4)
