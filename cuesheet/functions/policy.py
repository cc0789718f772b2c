"""Which feature columns may enter a hypothesis test."""

# Formal columns by kind, confounders, and prefixes of experimental columns.
NUMERIC = [
    "duration_s", "scene_num_scenes", "scene_avg_shot_len_s",
    "scene_median_shot_len_s", "scene_min_shot_len_s", "scene_max_shot_len_s",
    "scene_cuts_per_minute", "scene_avg_brightness", "scene_avg_saturation",
    "audio_bpm", "audio_rms_mean", "audio_rms_std",
    "audio_spectral_centroid_hz", "audio_onsets_per_sec",
    "audio_peak_energy_ratio", "audio_lufs_i", "audio_lra_lu",
    "tag_closeup_ratio", "tag_wide_ratio", "tag_avg_characters",
    "tag_lyrics_text_ratio", "lyrics_n_lyric_lines", "lyrics_lyric_lines_per_min",
    "lyrics_first_lyric_at_s", "lyrics_first_vocal_at_s", "lyrics_text_frame_ratio",
    "thumb_brightness", "thumb_saturation", "thumb_num_characters",
    "title_len", "title_bracket_segments", "title_exclaim_count",
    "sync_cut_beat_offset_med_s", "sync_cut_on_beat_ratio",
    "sync_cut_accel_at_peak", "sync_first_cut_s", "sync_beats_per_cut",
    "hook_cuts_first_15s", "hook_energy_first_10s_ratio", "upload_hour",
]
BINARY = [
    "title_has_emoji", "title_has_mv_mark", "was_premiere", "has_nico_link",
    "lyrics_has_hardsub", "thumb_has_text",
]
CATEGORICAL = [
    "tag_mood_top", "thumb_mood", "lyrics_topic_1", "lyrics_sentiment",
    "lyrics_addressee", "lyrics_source", "audio_key", "upload_weekday",
]
CONFOUNDERS = ["subscriber_count", "channel_video_count", "upload_date"]
EXPERIMENTAL_PREFIXES = ("ext_", "motion_")
CORE_ARTIFACTS = [
    "features.json", "scenes.json", "audio_features.json", "loudness.json", "scene_tags.json",
    "lyrics_lines.json", "sync_features.json", "thumb_tags.json", "meta.json",
]


def kind_of(column: str) -> str | None:
    for kind, names in (("numeric", NUMERIC), ("binary", BINARY), ("categorical", CATEGORICAL)):
        if column in names:
            return kind
    return None
