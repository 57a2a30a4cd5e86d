"""Caption tables: blocks to one row per person."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.functions import text as X


def caption_items(captions: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per person by position; sections of different length are
    padded with nulls."""
    t = F.col(text)
    d = captions.select(
        *keys,
        *[F.coalesce(X.items_by_position(X.section(t, tag)), F.array().cast("array<string>")).alias(n) for n, tag in
          (("body_desc", "BodyDesc"), ("style", "Style"), ("action", "Action"))],
    )
    d = d.select(*keys, F.posexplode(F.arrays_zip("body_desc", "style", "action")).alias("person_id", "i"))
    return d.select(*keys, F.col("person_id").cast("string").alias("person_id"), "i.body_desc", "i.style", "i.action")


def person_actions(captions: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, person, action) by tag number."""
    d = captions.select(*keys, X.items_by_tag(X.section(F.col(text), "Action")).alias("m"))
    return d.select(*keys, F.explode("m").alias("person", "action"))


def mirror_dataset(clips: DataFrame, ident: str, text: str, flip: dict, mode: str = "swap") -> DataFrame:
    """The table and its mirrored copy: id prefixed with M, text swapped,
    other columns replaced by the expressions in ``flip``."""
    m = clips.withColumns({ident: F.concat(F.lit("M"), F.col(ident)), text: X.mirror_text(F.col(text), mode), **flip})
    return clips.unionByName(m)
