"""What a user does to the library, end to end: checks, the change, and all that has to be recomputed after it.

A :class:`Library` holds the tables; each action returns a new one and an outcome of a few counts. An action that is
refused changes nothing and says why.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlight.functions.text import fold_case, valid_name
from kinlight.operators import people, sums
from kinlight.operators.clustering import absorb
from kinlight.operators.vectors import medoid, unit_mean
from kinlight.plans.lineage import cut

#: Similarity from which an unnamed group counts as a known person's.
MATCH = 0.5


@dataclass(frozen=True)
class Library:
    """``persons(person_id, display_name, cover_face_id, centroid)``, ``faces(face_id, person_id, cluster_id,
    assignment, vector, min_side, score)``, where 1 is a confirmed and 2 a rejected assignment, and
    ``clusters(cluster_id, person_id, size, medoid_face_id)``. With ``sums`` of the people's vectors (see
    :mod:`kinlight.operators.sums`), actions keep those up to date and take means from them."""

    persons: DataFrame
    faces: DataFrame
    clusters: DataFrame
    sums: DataFrame | None = None

    def with_faces(self, faces: DataFrame) -> Library:
        """The library with changed faces, and with the sums that follow from the change."""
        if self.sums is None:
            return replace(self, faces=faces)
        changed = cut(sums.differences(self.faces.drop("vector"), faces.drop("vector")))
        return replace(self, faces=faces, sums=cut(sums.updated(self.sums, sums.change_of(changed, self.faces))))


def decided():
    return F.coalesce(F.col("assignment").isin(1, 2), F.lit(False))


def recalibrate(library: Library, ids: list[int]) -> Library:
    """Centroid and cover of some people from the faces that they have now; a person without vectors loses the
    centroid. Only those people's faces are read."""
    here = F.col("person_id").isin(ids)
    if library.sums is None:
        own = people.calibrate(library.persons.filter(here), library.faces.filter(here & ~(F.col("assignment") == 2)))
    else:
        own = _from_sums(library, here)
    return replace(library, persons=cut(library.persons.filter(~here).unionByName(own.select(*library.persons.columns))))


def _from_sums(library: Library, here: Column) -> DataFrame:
    """Calibrated people by their sums; vectors are read only of those whose cover isn't theirs any more."""
    means = sums.centroids(library.sums.filter(here)).select("person_id", "centroid")
    persons = library.persons.filter(here).drop("centroid").join(means, "person_id", "left")
    theirs = library.faces.filter(here & ~(F.col("assignment") == 2))
    owned = theirs.select("person_id", F.col("face_id").alias("cover_face_id"), F.lit(True).alias("_own"))
    marked = cut(persons.join(owned, ["person_id", "cover_face_id"], "left"))
    bare = marked.filter("_own is null")
    fresh = people.covers(theirs.join(bare.select("person_id"), "person_id", "left_semi"), means)
    anew = bare.drop("cover_face_id", "_own").join(fresh, "person_id", "left")
    return marked.filter("_own").drop("_own").unionByName(anew)


def _missing(library: Library, ids: list[int]) -> bool:
    return library.persons.filter(F.col("person_id").isin(ids)).select("person_id").distinct().count() < len(set(ids))


def name_group(library: Library, cluster_id: int, name: str, new_id: int, least: float = MATCH) -> tuple[Library, dict]:
    """Name a group: its undecided faces become the person's, who is new or has that name already, ignoring case;
    the group gets the person, a new person the group's medoid as cover; the person is calibrated; and every other
    unnamed group whose mean vector is as near as ``least`` to theirs is absorbed, after which they are calibrated
    again. Outcome: status (named, merged, or why it was refused), person_id, faces and groups absorbed."""
    group = library.clusters.filter(F.col("cluster_id") == cluster_id).first()
    if group is None:
        return library, {"status": "no such group"}
    persons, faces, status = people.name_cluster(library.persons, library.faces, cluster_id, name, new_id)
    if status not in ("named", "merged"):
        return library, {"status": status}
    clean = valid_name(F.lit(name))
    person = persons.filter(fold_case("display_name") == fold_case(clean)).select("person_id").first().person_id
    if status == "named":
        persons = persons.withColumn("cover_face_id", F.when(F.col("person_id") == person, F.lit(group.medoid_face_id)).otherwise(F.col("cover_face_id")))
    before = library.faces.filter((F.col("cluster_id") == cluster_id) & ~decided()).count()
    named = F.when(F.col("cluster_id") == cluster_id, F.lit(person).cast("long")).otherwise(F.col("person_id"))
    now = recalibrate(replace(library, persons=persons, clusters=cut(library.clusters.withColumn("person_id", named))).with_faces(cut(faces)), [person])
    now, groups, absorbed = absorb_groups(now, person, least)
    return now, {"status": status, "person_id": person, "faces": before + absorbed, "groups": groups}


def absorb_groups(library: Library, person: int, least: float = MATCH) -> tuple[Library, int, int]:
    """Give a person all unnamed groups that look like them and have a face left to assign: groups and faces
    absorbed are counted, and the person is calibrated if there are any."""
    own = library.persons.filter((F.col("person_id") == person) & (F.size("centroid") > 0))
    if own.isEmpty():
        return library, 0, 0
    open_groups = library.clusters.filter("person_id is null").select("cluster_id", F.lit(None).cast("long").alias("person_id"))
    means = unit_mean(library.faces.filter("vector is not null").join(open_groups.select("cluster_id"), "cluster_id", "left_semi"), "cluster_id", zero_as_null=True)
    near = absorb(own, means.filter("centroid is not null").join(open_groups, "cluster_id"), least).select("cluster_id")
    free = library.faces.filter(~decided()).join(near, "cluster_id", "left_semi").groupBy("cluster_id").agg(F.count("*").alias("n"))
    taken = cut(free.withColumn("_taken", F.lit(True)))
    groups, faces = taken.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not groups:
        return library, 0, 0
    marked = library.faces.join(taken.select("cluster_id", "_taken"), "cluster_id", "left")
    changed = people.assign(marked, F.col("_taken").isNotNull() & ~decided(), F.lit(person), 0).select(*library.faces.columns)
    clusters = library.clusters.join(taken.select("cluster_id", "_taken"), "cluster_id", "left")
    clusters = clusters.withColumn("person_id", F.when(F.col("_taken"), F.lit(person).cast("long")).otherwise(F.col("person_id")))
    return recalibrate(replace(library, clusters=cut(clusters.select(*library.clusters.columns))).with_faces(cut(changed)), [person]), int(groups), int(faces)


def move_faces(library: Library, face_ids: list[int], source: int, target: int) -> tuple[Library, dict]:
    """Move chosen faces from one person to another, as confirmed, and calibrate both. Refused without faces, to the
    same person, and if one of the two is gone."""
    if not face_ids:
        return library, {"status": "nothing selected"}
    if source == target:
        return library, {"status": "same person"}
    if _missing(library, [source, target]):
        return library, {"status": "no such person"}
    moved = library.with_faces(cut(people.move_faces(library.faces, F.col("face_id").isin(face_ids), target)))
    return recalibrate(moved, [source, target]), {"status": "moved", "faces": len(set(face_ids))}


def remove_faces(library: Library, face_ids: list[int], person: int) -> tuple[Library, dict]:
    """Take chosen faces from a person, as rejected, and calibrate them. Refused without faces, and if the person is
    gone."""
    if not face_ids:
        return library, {"status": "nothing selected"}
    if _missing(library, [person]):
        return library, {"status": "no such person"}
    left = library.with_faces(cut(people.remove_faces(library.faces, F.col("face_id").isin(face_ids))))
    return recalibrate(left, [person]), {"status": "removed", "faces": len(set(face_ids))}


def merge_people(library: Library, keep: int, sources: list[int]) -> tuple[Library, dict]:
    """Merge people into one and calibrate that one. Refused if no other person is named, or one is gone."""
    others = sorted(set(sources) - {keep})
    if not others:
        return library, {"status": "nothing to merge"}
    if _missing(library, [keep, *others]):
        return library, {"status": "no such person"}
    persons, faces, clusters = people.merge_people(library.persons, library.faces, library.clusters, keep, others)
    return recalibrate(replace(library, persons=cut(persons), clusters=cut(clusters)).with_faces(cut(faces)), [keep]), {"status": "merged", "people": len(others)}


def repair(library: Library) -> tuple[Library, dict]:
    """Recompute all that is derived: everybody's centroid and cover, sizes and medoids of groups; groups without
    faces go. Outcome: people calibrated, averages lost, covers repaired, groups resized and removed. Repairing twice
    changes nothing more."""
    was = library.persons.select("person_id", F.col("cover_face_id").alias("_cover"), (F.size("centroid") > 0).alias("_had"))
    fresh = cut(people.calibrate(library.persons, library.faces.filter("person_id is not null and assignment <> 2")).select(*library.persons.columns))
    both = fresh.join(was, "person_id")
    lost = F.coalesce(F.col("_had"), F.lit(False)) & ~F.coalesce(F.size("centroid") > 0, F.lit(False))
    covers = ~F.col("cover_face_id").eqNullSafe(F.col("_cover"))
    n, averages, repaired = both.agg(F.count("*"), F.coalesce(F.sum(lost.cast("int")), F.lit(0)), F.coalesce(F.sum(covers.cast("int")), F.lit(0))).first()
    members = library.faces.filter("cluster_id is not null")
    groups = cut(people.repair_clusters(library.clusters.drop("person_id"), members, medoid(members.filter("vector is not null"), "cluster_id")))
    actions = {r.action: r["count"] for r in groups.groupBy("action").count().collect()}
    clusters = groups.filter("action <> 'removed'").drop("action").join(library.clusters.select("cluster_id", "person_id"), "cluster_id")
    outcome = {"people": n, "averages_lost": averages, "covers": repaired, "resized": actions.get("fixed", 0), "removed": actions.get("removed", 0)}
    kept = None if library.sums is None else cut(sums.sums_of(library.faces))
    return replace(library, persons=fresh, clusters=cut(clusters.select(*library.clusters.columns)), sums=kept), outcome
