"""Searching photos by who is in them and by file name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlight.functions.text import contains_text, file_name, fold_case
from kinlight.operators.text_index import TextIndex

MOST_HITS = 500


def appearances(faces: DataFrame, detector: str | None = None) -> DataFrame:
    """Distinct (photo_id, person_id) of active, named faces."""
    kept = faces.filter(F.col("active") & F.col("person_id").isNotNull())
    if detector is not None:
        kept = kept.filter(F.col("detector_id") == detector)
    return kept.select("photo_id", "person_id").distinct()


def photos_with(appear: DataFrame, people: list[int], match_all: bool) -> DataFrame:
    """Photos in which all, or any, of the people appear. Repeated people count once; an unknown one leaves
    no photo with all."""
    wanted = sorted(set(people))
    hits = appear.filter(F.col("person_id").isin(wanted))
    if not match_all:
        return hits.select("photo_id").distinct()
    return hits.groupBy("photo_id").agg(F.count_distinct("person_id").alias("n")).filter(F.col("n") == len(wanted)).select("photo_id")


def search(photos: DataFrame, faces: DataFrame, persons: DataFrame, people: list[int] | None = None, match_all: bool = True, text: str | None = None, scope: str | None = None, detector: str | None = None, limit: int = MOST_HITS, index: TextIndex | None = None) -> DataFrame:
    """Photos by people and text, newest first: (photo_id, path, taken_utc, names, position, total, truncated).

    Without people, text is looked for in the whole path, with people in the file name; ``scope`` ("path" or
    "name") overrides it. An empty question has an empty answer. At most ``limit`` photos come, and ``total``
    is how many matched. ``names`` are those of the active, named faces, sorted. With an ``index`` of the paths by
    photo_id, only its candidates are looked at for text.
    """
    people, text = people or [], (text or "").strip()
    appear = appearances(faces, detector)
    if not people and not text:
        matched = photos.filter(F.lit(False))
    else:
        matched = photos
        if people:
            matched = matched.join(photos_with(appear, people, match_all), "photo_id", "left_semi")
        if text:
            by_name = (scope or ("name" if people else "path")) == "name"
            matched = matched if index is None else index.narrowed(matched, "photo_id", text)
            matched = matched.filter(contains_text(file_name("path") if by_name else "path", text))
    newest = [F.coalesce("taken_utc", "mtime_utc").desc() if "mtime_utc" in photos.columns else F.desc("taken_utc"), fold_case("path"), "photo_id"]
    matched = matched.select("photo_id", "path", "taken_utc", *[c for c in ("mtime_utc",) if c in photos.columns])
    total = matched.agg(F.count("*").alias("total"))
    top = matched.orderBy(*newest).limit(limit)
    named = top.select("photo_id").join(appear, "photo_id").join(persons.select("person_id", "display_name"), "person_id")
    names = named.groupBy("photo_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct(fold_case("display_name").alias("k"), "display_name"))), lambda p: p["display_name"]), ", ").alias("names"))
    from pyspark.sql import Window

    placed = top.withColumn("position", F.row_number().over(Window.orderBy(*newest)))
    found = placed.join(names, "photo_id", "left").crossJoin(F.broadcast(total))
    return found.select("photo_id", "path", "taken_utc", F.coalesce("names", F.lit("")).alias("names"), "position", "total", (F.col("total") > limit).alias("truncated"))
