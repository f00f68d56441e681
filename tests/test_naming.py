"""Naming all groups: the outcome of naming one after the other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlight.operators import naming, workflows

FACES = "face_id long, person_id long, cluster_id long, assignment int, vector array<double>, min_side double, score double"
PERSONS = "person_id long, display_name string, cover_face_id long, centroid array<double>"
CLUSTERS = "cluster_id long, person_id long, size long, medoid_face_id long"


def unit(v):
    return v / np.linalg.norm(v)


def library_of(seed, groups=30):
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    centres = [unit(rng.normal(0, 1, 4)) for _ in range(6)]
    faces, clusters, face = [], [], 0
    for g in range(groups):
        size = draw.randrange(1, 6)
        members = []
        for _ in range(size):
            vector = None if draw.random() < 0.08 else unit(draw.choice(centres[g % 6 : g % 6 + 1]) + rng.normal(0, 0.35, 4)).tolist()
            assignment = draw.choice([0, 0, 0, 1, 2]) if g % 5 else 1 if g % 2 else 0
            faces.append([face, 1 if assignment == 1 else None, g, assignment, vector, float(draw.randrange(40, 90)), draw.random()])
            members.append(face)
            face += 1
        clusters.append([g, 1 if g % 11 == 3 else None, size, draw.choice(members)])
    persons = [[1, "PERSON 2", None, None], [2, "Person 007", None, None], [3, "Bob", None, None]]
    return persons, faces, clusters


def mean_of(vectors):
    vectors = [v for v in vectors if v is not None]
    total = np.sum(vectors, 0) if vectors else np.zeros(4)
    return unit(total) if vectors and np.linalg.norm(total) > 0 else None


def one_by_one(persons, faces, clusters, least):
    """Name groups in turn; returns who owns which face and group, and the new names."""
    faces, clusters = [list(f) for f in faces], [list(c) for c in clusters]
    taken, number, person, skipped, absorbed = {p[1].lower() for p in persons}, 0, 100, 0, 0
    new = {}
    for c in sorted((c for c in clusters if c[1] is None), key=lambda c: (-c[2], c[0])):
        if c[1] is not None:
            continue
        mine = [f for f in faces if f[2] == c[0] and f[3] not in (1, 2)]
        if not mine:
            skipped += 1
            continue
        number += 1
        while f"person {number}" in taken:
            number += 1
        new[person] = f"Person {number}"
        c[1] = person
        for f in mine:
            f[1] = person
        centroid = mean_of([f[4] for f in mine])
        if centroid is not None:
            for other in clusters:
                around = mean_of([f[4] for f in faces if f[2] == other[0]])
                free = [f for f in faces if f[2] == other[0] and f[3] not in (1, 2)]
                if other[1] is None and around is not None and free and around @ centroid >= least:
                    other[1] = person
                    absorbed += 1
                    for f in free:
                        f[1] = person
        person += 1
    return {f[0]: f[1] for f in faces}, {c[0]: c[1] for c in clusters}, new, skipped, absorbed


@pytest.mark.parametrize(("seed", "least", "finish"), [(1, 0.8, 10_000), (2, 0.85, 0), (4, -2.0, 5)])
def test_as_if_one_after_the_other(spark, seed, least, finish):
    persons, faces, clusters = library_of(seed)
    lib = workflows.Library(spark.createDataFrame(persons, PERSONS), spark.createDataFrame(faces, FACES), spark.createDataFrame(clusters, CLUSTERS))
    now, outcome = naming.name_all_groups(lib, " Person ", 100, least, finish)
    own, groups, new, skipped, absorbed = one_by_one(persons, faces, clusters, least)
    assert {r.face_id: r.person_id for r in now.faces.collect()} == own
    assert {r.cluster_id: r.person_id for r in now.clusters.collect()} == groups
    found = {r.person_id: r for r in now.persons.collect()}
    assert {p: r.display_name for p, r in found.items() if p >= 100} == new and len(found) == len(new) + 3
    assert (outcome["named"], outcome["skipped"], outcome["absorbed"]) == (len(new), skipped, absorbed)
    for p in new:
        want = mean_of([f[4] for f in faces if own[f[0]] == p])
        assert (found[p].centroid is None) == (want is None) and (want is None or found[p].centroid == pytest.approx(want.tolist()))
        led = min((c for c in clusters if groups[c[0]] == p), key=lambda c: (-c[2], c[0]))
        cover = next(f for f in faces if f[0] == found[p].cover_face_id)
        assert cover[2] == led[0] and own[cover[0]] == p and (own[led[3]] != p or cover[0] == led[3])


def test_one_group_as_by_name_group(spark):
    persons, faces, clusters = library_of(9)
    clusters = [[c, 1 if c else None, s, m] for c, _, s, m in clusters]
    lib = workflows.Library(spark.createDataFrame(persons, PERSONS), spark.createDataFrame(faces, FACES), spark.createDataFrame(clusters, CLUSTERS))
    one, _ = workflows.name_group(lib, 0, "Person 1", 100)
    every, _ = naming.name_all_groups(lib, "Person", 100)
    for table in ("persons", "faces", "clusters"):
        assert sorted(map(str, getattr(one, table).collect())) == sorted(map(str, getattr(every, table).collect()))


def test_refusals_and_nothing_to_name(spark):
    persons, faces, clusters = library_of(1)
    lib = workflows.Library(spark.createDataFrame(persons, PERSONS), spark.createDataFrame(faces, FACES), spark.createDataFrame(clusters, CLUSTERS))
    assert naming.name_all_groups(lib, "  ", 100) == (lib, {"status": "invalid"})
    assert naming.name_all_groups(lib, "x" * 200, 100)[1] == {"status": "invalid"}
    named = workflows.Library(lib.persons, lib.faces, lib.clusters.withColumn("person_id", F.lit(1).cast("long")))
    assert naming.name_all_groups(named, "Person", 100)[1] == {"status": "named", "named": 0, "skipped": 0, "absorbed": 0, "faces": 0}


def test_rounds_settle_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(6)]
    hub = [(100, g) for g in range(101, 180)] + [(150, 190), (190, 191)]
    links = spark.createDataFrame(chain + hub, "h long, g long")
    want = {1, 3, 5, *range(101, 180), 191}
    for finish in (0, 10_000):
        assert {r.g for r in naming.settle(links, finish).collect()} == want
