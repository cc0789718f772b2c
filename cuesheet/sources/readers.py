"""Tables and per-item artifacts from files, always with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuesheet.functions.text import id_from_url

# Fixed value: what an item id looks like.
ITEM_ID = "[A-Za-z0-9_-]{11}"

SCENES = "struct<summary:struct<duration_s:double,fps:double,num_scenes:bigint,avg_shot_len_s:double,median_shot_len_s:double,min_shot_len_s:double,max_shot_len_s:double,cuts_per_minute:double,avg_brightness:double,avg_saturation:double>,scenes:array<struct<scene:bigint,start_s:double,end_s:double,len_s:double,brightness:double,saturation:double,dominant_color:string,keyframe:string>>>"
SCENE_TAG = "array<struct<setting:string,shot_type:string,style:string,mood:string,num_characters:bigint,has_lyrics_text:boolean,visual_elements:array<string>,keyframe:string>>"
LINES = "struct<lang:string,source:string,has_hardsub:boolean,lines:array<struct<t_s:double,line:string>>>"
AUDIO = "struct<bpm:double,key:string,key_confidence:double,rms_mean:double,rms_std:double,spectral_centroid_hz:double,onsets_per_sec:double,peak_energy_at_s:double,duration_s:double,energy_curve_10s:array<double>,beat_times_s:array<double>>"
ARTIFACTS = {"scenes.json": SCENES, "scene_tags.json": SCENE_TAG, "lyrics_lines.json": LINES, "audio_features.json": AUDIO}


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with header, quoted multi-line cells and an optional byte-order mark; empty is NULL."""
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
        .option("nullValue", "").option("emptyValue", "").option("encoding", "UTF-8").csv(path)
    )


def read_artifact(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """One artifact kind over all item folders: (item, doc).

    The item is the folder name and must be a valid id. A file that is not JSON gives no row: it
    counts as missing. Whole files are read as text and parsed with a typed schema.
    """
    raw = spark.read.option("wholetext", True).text(f"{root}/*/{name}")
    item = F.regexp_extract(F.col("_metadata.file_path"), rf"/({ITEM_ID})/[^/]+$", 1)
    typed = F.from_json("value", schema or ARTIFACTS[name], {"mode": "PERMISSIVE"})
    out = raw.select(item.alias("item"), typed.alias("doc"), F.col("value").alias("_text"))
    return out.where((F.col("item") != "") & F.get_json_object("_text", "$").isNotNull()).drop("_text")


def artifact_presence(spark: SparkSession, root: str) -> DataFrame:
    """(item, artifact, length, modified) of every JSON file in a valid item folder; contents are not read."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*.json").select("path", "length", "modificationTime")
    return files.select(
        F.regexp_extract("path", rf"/({ITEM_ID})/[^/]+$", 1).alias("item"),
        F.element_at(F.split("path", "/"), -1).alias("artifact"),
        "length",
        F.col("modificationTime").alias("modified"),
    ).where(F.col("item") != "")


def bundle(features: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row per item with every artifact as a struct column, NULL where it is missing."""
    out = features
    for name, df in parts.items():
        out = out.join(df.select("item", F.col("doc").alias(name)), "item", "left")
    return out


def scenes_of(bundles: DataFrame, scenes: str = "scenes", tags: str = "scene_tags") -> DataFrame:
    """Scene rows zipped with their labels by position; a missing tail gives NULL labels."""
    rows = bundles.select("item", F.posexplode(F.col(f"{scenes}.scenes")).alias("pos", "scene"), F.col(tags).alias("_tags"))
    return rows.select("item", "pos", "scene", F.get("_tags", F.col("pos")).alias("tag"))


def catalog(features: DataFrame) -> DataFrame:
    """One line per item: what there is to talk about."""
    names = {
        "video_id": "video_id", "title": "title", "channel": "channel", "duration_s": "duration_s",
        "upload_date": "upload_date", "view_per_sub": "view_per_sub", "num_scenes": "scene_num_scenes",
        "cuts_per_minute": "scene_cuts_per_minute", "bpm": "audio_bpm", "key": "audio_key", "style": "tag_style_top",
        "mood": "tag_mood_top", "lyrics_lang": "lyrics_lang", "lyrics_source": "lyrics_source",
        "n_lyric_lines": "lyrics_n_lyric_lines",
    }
    return features.select(
        *[F.col(c).alias(k) if c in features.columns else F.lit(None).alias(k) for k, c in names.items()]
    )


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Favourites: an id or link per line, # starts a comment, first word counts, first mention wins."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")
    word = F.element_at(F.split(F.trim(F.element_at(F.split("value", "#"), 1)), r"\s+"), 1)
    ids = raw.select("line_no", word.alias("_w")).where(F.col("_w") != "").select("line_no", id_from_url("_w").alias("item"))
    return ids.groupBy("item").agg(F.min("line_no").alias("line_no"))


def fingerprint(spark: SparkSession, root: str) -> str:
    """Digest of (path, length, modification time) of all artifacts: changes when a source changes.

    Row digests are added up on the map side; one row reaches the driver.
    """
    from cuesheet.operators.audit import table_digest

    return table_digest(artifact_presence(spark, root)).first()["digest"]
