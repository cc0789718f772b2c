"""Clause scrubbing, phrase rewriting and pattern scans over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.text import let, pin, strip

# What a clause must not talk about, in order of precedence.
STRIP_RULES = (
    ("subtitle", r"\b(sub-?titles?|hardsubs?|fan-?subs?|caption\s*(band|bar|strip)|subs)\b"),
    ("burned_text", r"\b(lyrics?|karaoke|caption)\b.{0,24}\b(text|line|typography|overlay|type)\b"
                    r"|\b(text|typography|lettering|type)\b.{0,24}\b(overlay|burn(ed|t)-?in|on-?screen)\b"),
    ("pillarbox", r"\b(pillar-?box\w*|letter-?box\w*|black bars?)\b"),
    ("watermark", r"\bwatermark\b|\bchannel (logo|handle|name|tag)\b|(?<!\w)@[A-Za-z0-9_]{2,}"),
)
# What a text must hold, in lower case, for a rule to match anywhere in it; a rule that isn't listed is tried on every clause.
HINTS = {
    STRIP_RULES[0][1]: ("sub", "caption"),
    STRIP_RULES[1][1]: ("lyric", "karaoke", "caption", "overlay", "burn", "screen"),
    STRIP_RULES[2][1]: ("pillar", "letter", "black bar"),
    STRIP_RULES[3][1]: ("watermark", "channel ", "@"),
}
# Letters outside ASCII that a pattern without case takes for s, k or i.
FOLDED = ("\u017f", "\u212a", "\u0131", "\u0130")
TEXT_DEPENDENT = (
    r"\b(title (card|logo)|logo|credits?|end-?roll text|lettering|hand-?lettered"
    r"|katakana|hiragana|kanji|hangul)\b"
)
MIN_KEPT_CHARS = 8
# Readable lettering turned into shapes (pattern, replacement).
REWRITES = (
    (r"\bhand-?lettered\s+(Japanese|Korean|English)\s+"
     r"(?:words|text|typography|characters|lettering|type)\b", "hand-lettered $1-style glyph shapes"),
    (r"\b(Japanese|Korean|English)\s+(?:hand-?lettered\s+)?"
     r"(?:words|text|typography|characters|lettering|type)\b", "$1-style glyph shapes"),
    (r"\b(kanji|katakana|hiragana|hangul)\s+(?:characters|text|typography)\b", "$1-like glyph shapes"),
    (r"\bend-?credit\s+(?:text|typography)\b", "end-credit-style columns of small glyph shapes"),
    (r"\bthe letters\s+[A-Z]\s+and\s+[A-Z]\b", "letter-like shapes"),
    (r"\b(?:lyric|caption)\s+(?:text|typography)\b", "glyph shapes"),
)
FLAGS = "(?iu)"


def clauses(text: Column) -> Column:
    """Split on . ; , and keep the delimiter with its clause."""
    found = F.regexp_extract_all(text, F.lit(r"[^.;,]*[.;,]|[^.;,]+$"), F.lit(0))
    return F.filter(found, lambda c: strip(c) != "")


def possible_rules(text: Column, rules=STRIP_RULES) -> Column:
    """Per rule, whether it can match at all: a look for its words in the whole text, which most texts don't hold."""

    def found(low: Column) -> Column:
        odd = F.lit(False)
        for c in FOLDED:
            odd = odd | F.contains(text, F.lit(c))
        flags = []
        for _, pattern in rules:
            may = F.lit(pattern not in HINTS)
            for h in HINTS.get(pattern, ()):
                may = may | F.contains(low, F.lit(h))
            flags.append(may | odd)
        return F.array(*flags)

    return let(F.lower(text), found)


def first_rule(clause: Column, rules=STRIP_RULES, possible: Column | None = None) -> Column:
    hit = F.lit(None).cast("string")
    for i, (name, pattern) in reversed(list(enumerate(rules))):
        match = clause.rlike(FLAGS + pattern)
        hit = F.when(match if possible is None else possible[i] & match, name).otherwise(hit)
    return hit


def tidy(text: Column) -> Column:
    s = strip(text)
    s = F.regexp_replace(s, r"(?U)\s{2,}", " ")
    s = F.regexp_replace(s, r"(?U)^[\s,;.]+", "")
    s = F.regexp_replace(s, r"(?U)[\s,;]+$", "")
    return F.when((s != "") & ~s.rlike(r"[.!?]$"), F.concat(s, F.lit("."))).otherwise(s)


def scrub(df: DataFrame, text: str, rules=STRIP_RULES) -> DataFrame:
    """Add ``scrubbed``, ``removed`` (array<struct<pos, rule, clause>>), ``applied``.

    A text that would keep fewer than 8 characters stays as it is and is not ``applied``. One pass
    inside the row; the audit rows come from exploding ``removed``.
    """
    judged = let(
        possible_rules(F.col(text), rules),
        lambda may: F.transform(
            clauses(F.col(text)),
            lambda c, i: F.struct(
                i.cast("bigint").alias("pos"), first_rule(c, rules, may).alias("rule"), c.alias("clause")
            ),
        ),
    )

    def split(all_: Column) -> Column:
        kept = F.transform(F.filter(all_, lambda x: x["rule"].isNull()), lambda x: x["clause"])
        gone = F.filter(all_, lambda x: x["rule"].isNotNull())
        return F.struct(
            tidy(F.array_join(kept, "")).alias("clean"),
            F.transform(
                gone, lambda x: F.struct(x["pos"].alias("pos"), x["rule"].alias("rule"), strip(x["clause"]).alias("clause"))
            ).alias("removed"),
        )

    # pinned: exploding ``removed`` filters on it, which would otherwise judge every text twice
    out = df.select("*", pin(let(judged, split)).alias("_s"))
    touched = F.size("_s.removed") > 0
    applied = touched & (F.length(strip(F.col("_s.clean"))) >= MIN_KEPT_CHARS)
    return out.select(
        *df.columns,
        F.when(applied, F.col("_s.clean")).otherwise(F.col(text)).alias("scrubbed"),
        F.col("_s.removed").alias("removed"),
        F.coalesce(applied, F.lit(False)).alias("applied"),
        F.coalesce(touched & ~applied, F.lit(False)).alias("needs_rewrite"),
    )


def audit_rows(scrubbed: DataFrame, ids: list[str]) -> DataFrame:
    return scrubbed.select(*ids, "applied", F.explode("removed").alias("r")).select(*ids, "applied", "r.*")


def rewrite(text: Column, rules=REWRITES) -> tuple[Column, Column]:
    """Rewritten text and the number of rewrites."""
    n = F.lit(0)
    for pattern, replacement in rules:
        n = n + F.regexp_count(text, F.lit(FLAGS + pattern))
        text = F.regexp_replace(text, FLAGS + pattern, replacement)
    return text, n.cast("bigint")


def text_dependent_clauses(text: Column) -> Column:
    return F.filter(clauses(text), lambda c: c.rlike(FLAGS + TEXT_DEPENDENT))


# ------------------------------------------------------------- scans

# Address blocks that are not public.
PRIVATE_BLOCKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4",
)
SHARED_BLOCK = "100.64.0.0/10"
IPV4 = r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)"


def _bounds(block: str) -> tuple[int, int]:
    net, bits = block.split("/")
    a, b, c, d = (int(x) for x in net.split("."))
    low = (a << 24) + (b << 16) + (c << 8) + d
    return low, low + (1 << (32 - int(bits))) - 1


def _address(text: Column) -> Column:
    """Dotted quad as a number, NULL when it is not a valid address."""
    octets = F.split(text, r"\.")
    valid = F.forall(octets, lambda o: (o.cast("int") <= 255) & ((F.length(o) == 1) | ~o.startswith("0")))
    value = F.lit(0).cast("bigint")
    for i in range(4):
        value = value * 256 + octets[i].cast("bigint")
    return F.when(valid, value)


def has_private_ip(text: Column, blocks=PRIVATE_BLOCKS) -> Column:
    ranges = [_bounds(b) for b in blocks]

    def private(t: Column) -> Column:
        return let(
            _address(t),
            lambda v: F.coalesce(
                F.array_contains(F.array(*[v.between(lo, hi) for lo, hi in ranges]), True), F.lit(False)
            ),
        )

    # the regular expression runs first and most texts hold no address at all
    return F.exists(F.regexp_extract_all(text, F.lit(IPV4), F.lit(0)), private)


# Keys and places that must not be published.
UNSAFE_KEYS = (
    "lyrics", "raw_lyrics", "lyrics_lines", "lyrics_ocr", "thumb_text_content", "formats",
    "requested_formats", "local_path", "cookies", "cookie", "headers", "request_headers",
    "vlm_prompt", "vlm_response", "media_url", "video_url", "__proto__", "constructor", "prototype",
)
LOCAL_PATH = r"\b[A-Za-z]:[\\/]|\\\\|(?:^|\s)/(?:home|Users|tmp|var|mnt|etc|root|private|opt)/"


def unsafe_reasons(text: Column) -> Column:
    """Array of reasons why a text must not be published."""
    low = F.lower(text)
    signed = F.contains(low, F.lit("googlevideo.com")) | (
        F.contains(low, F.lit("expire="))
        & (F.contains(low, F.lit("sig=")) | F.contains(low, F.lit("signature=")))
    )
    return F.array_compact(
        F.array(
            F.when(text.rlike("(?i)" + LOCAL_PATH) | F.contains(low, F.lit("file://")), "local path"),
            F.when(F.contains(low, F.lit("localhost")) | has_private_ip(text), "private host"),
            F.when(signed, "signed media url"),
        )
    )


def unsafe_columns(df: DataFrame) -> list[str]:
    """Names of columns that must never be published, wherever they are nested."""
    found: list[str] = []

    def walk(dtype, path):
        fields = getattr(dtype, "fields", None)
        if fields is not None:
            for f in fields:
                name = f"{path}.{f.name}" if path else f.name
                if f.name in UNSAFE_KEYS:
                    found.append(name)
                walk(f.dataType, name)
        elif hasattr(dtype, "elementType"):
            walk(dtype.elementType, path)
        elif hasattr(dtype, "valueType"):
            walk(dtype.valueType, path)

    walk(df.schema, "")
    return found


# Shapes of secrets.
SECRET_RULES = (
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9_]{24,}\b"),
    ("google_key", r"\bAIza[0-9A-Za-z_-]{30,}\b"),
    ("secret_key", r"\bsk-[A-Za-z0-9_-]{24,}\b"),
    ("shared_address", r"(?:100\.(?:6[4-9]|[78]\d|9\d|1[01]\d|12[0-7])\.\d{1,3}\.\d{1,3})"),
    ("base64_media", r"data:image/[^\s]{0,64}base64,"),
)


def secret_findings(df: DataFrame, text: str, ids: list[str], rules=SECRET_RULES) -> DataFrame:
    """(ids, rule, hits) for every rule that matches; one pass over the text."""
    hits = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.regexp_count(F.col(text), F.lit(pat)).cast("bigint").alias("hits"))
            for name, pat in rules
        ]
    )
    found = df.select(*ids, F.explode(F.filter(hits, lambda h: h["hits"] > 0)).alias("h"))
    return found.select(*ids, "h.*")
