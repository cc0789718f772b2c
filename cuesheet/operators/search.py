"""Case-insensitive search over titles, lines and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.text import nfkc
from cuesheet.session import materialise


def fold(text: Column, normalise: bool) -> Column:
    return F.lower(nfkc(text)) if normalise else F.lower(text)


def corpus_search(
    features: DataFrame,
    lines: DataFrame,
    scenes: DataFrame,
    needle: str,
    limit: int = 50,
    *,
    normalise: bool = False,
) -> DataFrame:
    """Union of title, line and scene hits, by item and time, title hits (no time) first.

    features(item, title, channel), lines(item, t_s, pos, line), scenes(item, t_s, pos, blob).
    Each branch is cut to ``limit`` rows in the final order before the titles are joined, so only a
    bounded number of hits is joined and sorted.
    """
    want = F.lit(needle.lower())
    order = [F.col("item"), F.col("t_s").asc_nulls_first(), F.col("where"), F.col("pos").asc_nulls_first()]

    def hits(df: DataFrame, text: Column, where: str, t, pos) -> DataFrame:
        found = df.where(F.contains(fold(F.coalesce(text, F.lit("")), normalise), want))
        return found.select(
            "item", t.cast("double").alias("t_s"), F.lit(where).alias("where"), pos.cast("bigint").alias("pos"), text.alias("text")
        ).orderBy(*order).limit(limit)

    none = F.lit(None)
    title = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("channel", F.lit("")))
    both = (
        hits(features, title, "title", none, none)
        .unionByName(hits(lines, F.col("line"), "lyric", F.col("t_s"), F.col("pos")))
        .unionByName(hits(scenes, F.col("blob"), "scene", F.col("t_s"), F.col("pos")))
        .orderBy(*order)
        .limit(limit)
    )
    # at most `limit` rows; the feature table is scanned for their titles and not shuffled
    both = materialise(both)
    titles = features.select("item", "title").join(F.broadcast(both.select("item").distinct()), "item", "left_semi")
    return both.join(titles, "item", "left").select("item", "title", "t_s", "where", "pos", "text").orderBy(*order)
