"""Schemas of the library's tables, their enumerations, and the versions in which they came.

Ids are longs here (the driver's tables have such keys); times are timestamps in UTC; vectors are arrays of
floats; unsigned 64-bit hashes are longs with the same bits.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "array<float>": T.ArrayType(T.FloatType(), containsNull=False),
}


def _table(**columns: str) -> T.StructType:
    """A schema from ``name="type"``; a type that ends in ``?`` is nullable."""
    return T.StructType([T.StructField(name, _TYPES[kind.rstrip("?")], kind.endswith("?")) for name, kind in columns.items()])


SCAN_ROOTS = _table(id="bigint", path="string", recursive="boolean", is_implicit="boolean", last_scan_utc="timestamp?")
PHOTOS = _table(id="bigint", path="string", file_size="bigint", mtime_utc="timestamp", content_hash="string?", width="int?", height="int?", orientation="int", taken_utc="timestamp?", camera="string?", state="int", indexed_utc="timestamp?", error="string?")
PERSONS = _table(id="bigint", display_name="string", cover_face_id="bigint?", centroid="array<float>?", created_utc="timestamp")
CLUSTERS = _table(id="bigint", detector_id="string", embedder_id="string", person_id="bigint?", size="int", medoid_face_id="bigint?", created_utc="timestamp")
FACES = _table(id="bigint", photo_id="bigint", detector_id="string", detector_version="string", active="boolean", bbox_x="double", bbox_y="double", bbox_w="double", bbox_h="double", det_score="double", landmarks="array<float>", blur_score="double?", face_px="int", cluster_id="bigint?", person_id="bigint?", assignment="int")
FACE_EMBEDDINGS = _table(face_id="bigint", embedder_id="string", embedder_version="string", dim="int", vector="array<float>")
FACE_LINKS = _table(face_a="bigint", face_b="bigint", kind="int", created_utc="timestamp")
EXPORT_RUNS = _table(id="bigint", started_utc="timestamp", finished_utc="timestamp?", output_root="string", pattern="string", mode="int", source="int", status="int", undone_utc="timestamp?")
EXPORT_OPS = _table(id="bigint", run_id="bigint", photo_id="bigint", person_id="bigint?", src_path="string", dst_path="string", op="int", status="int", bytes="bigint", src_hash="string?", error="string?")
SETTINGS = _table(key="string", value="string")
PHOTO_DETECTIONS = _table(photo_id="bigint", detector_id="string", detector_version="string", face_count="int", detected_utc="timestamp")
IGNORED_FACES = _table(face_id="bigint", created_utc="timestamp")
PHOTO_SIGNATURES = _table(photo_id="bigint", hash_across="bigint", hash_down="bigint", sharpness="double", computed_utc="timestamp")
SCHEMA_VERSION = _table(version="int", applied_utc="timestamp")

TABLES = {
    "scan_roots": SCAN_ROOTS,
    "photos": PHOTOS,
    "persons": PERSONS,
    "clusters": CLUSTERS,
    "faces": FACES,
    "face_embeddings": FACE_EMBEDDINGS,
    "face_links": FACE_LINKS,
    "export_runs": EXPORT_RUNS,
    "export_ops": EXPORT_OPS,
    "settings": SETTINGS,
    "photo_detections": PHOTO_DETECTIONS,
    "ignored_faces": IGNORED_FACES,
    "photo_signatures": PHOTO_SIGNATURES,
}

#: Key columns of each table.
KEYS = {name: ["id"] for name in ("scan_roots", "photos", "persons", "clusters", "faces", "export_runs", "export_ops")} | {
    "face_embeddings": ["face_id", "embedder_id"],
    "face_links": ["face_a", "face_b"],
    "settings": ["key"],
    "photo_detections": ["photo_id", "detector_id"],
    "ignored_faces": ["face_id"],
    "photo_signatures": ["photo_id"],
}

#: Which table's rows go when a parent's row goes: child, its column, the parent.
CASCADES = [
    ("faces", "photo_id", "photos"),
    ("face_embeddings", "face_id", "faces"),
    ("face_links", "face_a", "faces"),
    ("face_links", "face_b", "faces"),
    ("ignored_faces", "face_id", "faces"),
    ("export_ops", "photo_id", "photos"),
    ("photo_detections", "photo_id", "photos"),
    ("photo_signatures", "photo_id", "photos"),
]
#: Which column becomes null instead.
SET_NULL = [
    ("faces", "person_id", "persons"),
    ("clusters", "person_id", "persons"),
    ("export_ops", "person_id", "persons"),
    ("faces", "cluster_id", "clusters"),
]

#: Versions of the schema and the tables that each added.
MIGRATIONS = {
    1: ["scan_roots", "photos", "persons", "clusters", "faces", "face_embeddings", "face_links", "export_runs", "export_ops", "settings"],
    2: ["photo_detections"],
    3: ["ignored_faces"],
    4: ["photo_signatures"],
}


class PhotoState:
    NEW, DECODED, DETECTED, EMBEDDED, FAILED = 0, 1, 2, 3, 99


class Assignment:
    AUTO, CONFIRMED, REJECTED, PENDING = 0, 1, 2, 3


class LinkKind:
    MUST, CANNOT = 0, 1


class ExportMode:
    COPY, MOVE = 0, 1


class ExportSource:
    EVERY_NAMED_PERSON, CHOSEN_PEOPLE = 0, 1


class RunStatus:
    RUNNING, COMPLETED, FAILED, CANCELLED, UNDONE = 0, 1, 2, 3, 4


class OpStatus:
    PLANNED, DONE, FAILED, SKIPPED, UNDONE = 0, 1, 2, 3, 4
