"""Column functions for captions, names, timecodes and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Caption block tags and the word classes of tagged captions.
SECTIONS = ("SceneDesc", "Action", "BodyDesc", "Style")
POS_CLASSES = (
    "VERB", "NOUN", "DET", "ADP", "NUM", "AUX", "PRON", "ADJ", "ADV",
    "Loc_VIP", "Body_VIP", "Obj_VIP", "Act_VIP", "Desc_VIP", "OTHER",
)


def to_timecode(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``; milliseconds are cut, hours wrap at 24."""
    ms = F.floor(seconds * 1000).cast("long")
    hours = F.pmod(F.floor(ms / 3600000), F.lit(24)).cast("int")
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        hours,
        F.pmod(F.floor(ms / 60000), F.lit(60)).cast("int"),
        F.pmod(F.floor(ms / 1000), F.lit(60)).cast("int"),
        F.pmod(ms, F.lit(1000)).cast("int"),
    )


def from_timecode(code: Column) -> Column:
    p = F.split(F.trim(code), ":")
    return F.get(p, F.lit(0)).cast("double") * 3600 + F.get(p, F.lit(1)).cast("double") * 60 + F.get(p, F.lit(2)).cast("double")


def sanitize_name(name: Column) -> Column:
    return F.regexp_replace(F.replace(name, F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_]", "")


def clean_title(title: Column) -> Column:
    return F.lower(F.trim(F.replace(title, F.lit("|"), F.lit(""))))


def parse_scene_key(key: Column) -> dict[str, Column]:
    """``video_a/b`` -> video a, scene b."""
    pattern = r"^video_([^/]+)/(.+)$"
    return {"video": F.regexp_extract(key, pattern, 1), "scene": F.regexp_extract(key, pattern, 2)}


def clip_short_name(name: Column) -> Column:
    """``video_v_merged_scene_s_body_b`` -> ``v_s_b``; other names unchanged."""
    return F.regexp_replace(name, r"^video_(\w+?)_merged_scene_(\w+?)_body_(\w+)$", "$1_$2_$3")


def section(text: Column, tag: str) -> Column:
    """Body of the first ``<tag>…</tag>`` block, null when there is none."""
    pattern = rf"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def sections(text: Column, tags: tuple[str, ...] = SECTIONS) -> dict[str, Column]:
    return {t: section(text, t) for t in tags}


def strip(x: Column) -> Column:
    """Trim blanks of any kind, newlines included."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def items_by_position(block: Column) -> Column:
    """Texts after each ``<digits>`` tag, cut at the next ``<``; the array
    index is the person."""
    parts = F.split(block, r"<[0-9]+>")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.get(F.split(strip(p), "<"), F.lit(0)))


def items_by_tag(block: Column) -> Column:
    """``map<person, text>`` from ``<n>text``: text runs to the next opening
    tag; newlines become blanks, closers are dropped, empty texts skipped, and
    the last of equal tags wins."""
    parts = F.split(block, r"<[0-9]+>")
    texts = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda p: F.regexp_replace(F.replace(F.replace(strip(p), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" ")), r"</[0-9]+>", ""),
    )
    ids = F.regexp_extract_all(block, F.lit(r"<([0-9]+)>"), F.lit(1))
    pairs = F.filter(F.arrays_zip(ids.alias("k"), texts.alias("v")), lambda p: p["v"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def inner_items(block: Column) -> Column:
    """Texts between ``<n>`` and ``</n>``."""
    return F.regexp_extract_all(block, F.lit(r"(?s)<[0-9]+>(.*?)</[0-9]+>"), F.lit(1))


def closed_tags(block: Column) -> Column:
    """Number of closed item tags in a block."""
    return F.coalesce(F.size(F.regexp_extract_all(block, F.lit(r"</[0-9]+>"), F.lit(0))), F.lit(0))


def words(text: Column, stopwords: list[str] | None = None, min_len: int = 1) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    if min_len > 1:
        w = F.filter(w, lambda x: F.length(x) >= min_len)
    if stopwords:
        w = F.filter(w, lambda x: ~x.isin(stopwords))
    return w


def numbered_list(text: Column) -> Column:
    """Texts of the lines ``n: text``."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*[0-9]+\s*:\s*(.+)$"), F.lit(1))


def strip_enumeration(text: Column) -> Column:
    """Drop leading digits, dots and blanks of every line; drop blank lines."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(s, r"^[0-9. ]+", "")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def mirror_text(text: Column, mode: str = "swap") -> Column:
    """Exchange left/right and clockwise/counter-clockwise.

    ``mode="sequential"`` applies the four replacements one after another, so
    both sides end as "left" and turning words keep theirs.
    """
    turn = "counter-clockwise"
    if mode == "sequential":
        for old, new in (("left", "right"), ("right", "left"), ("clockwise", turn), (turn, "clockwise")):
            text = F.replace(text, F.lit(old), F.lit(new))
        return text
    mark = F.lit("\u0001")
    for a, b in (("left", "right"), (turn, "clockwise")):
        text = F.replace(F.replace(F.replace(text, F.lit(a), mark), F.lit(b), F.lit(a)), mark, F.lit(b))
    return text


def truncate_text(text: Column, n: int = 2000) -> Column:
    """Trim and cut; empty becomes null."""
    t = F.trim(text)
    return F.when(t != "", F.substring(t, 1, n))


def split_tokens(tagged: Column) -> Column:
    """``word/POS word/POS`` -> array of structs."""
    toks = F.filter(F.split(F.trim(tagged), r"\s+"), lambda t: F.instr(t, "/") > 0)
    return F.transform(
        toks,
        lambda t: F.struct(
            F.regexp_extract(t, r"^(.*)/([^/]*)$", 1).alias("word"),
            F.regexp_extract(t, r"^(.*)/([^/]*)$", 2).alias("pos"),
        ),
    )


def pos_onehot(pos: Column, classes: tuple[str, ...] = POS_CLASSES) -> Column:
    """One-hot vector; unknown classes light the last entry."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), pos)
    at = F.when(at > 0, at).otherwise(F.lit(len(classes)))
    return F.transform(F.sequence(F.lit(1), F.lit(len(classes))), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def code_string(text: Column, limit: int = 511, default: int = 1, default_len: int = 4) -> Column:
    """Integers in the text up to the first above ``limit``; defaults if none."""
    nums = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0)), lambda x: F.coalesce(x.try_cast("long"), F.lit(limit + 1)))
    over = F.array_position(F.transform(nums, lambda x: x > limit), True)
    cut = F.when(over > 0, F.slice(nums, F.lit(1), (over - 1).cast("int"))).otherwise(nums)
    return F.when(F.size(cut) > 0, cut).otherwise(F.array_repeat(F.lit(default).cast("long"), default_len))
