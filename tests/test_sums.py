"""Means kept as sums stay equal to means made anew, and only vectors of moved faces are read."""

import random

import numpy as np
import pytest

from kinlight.operators import sums, vectors
from kinlight.plans.lineage import cut


def test_two_hundred_changes(spark):
    draw, rng = random.Random(4), np.random.default_rng(4)
    state = {i: [draw.choice([None, 1, 2, 3, 4, 5]), draw.choice([0, 1, 2])] for i in range(80)}
    held = {i: None if i % 13 == 0 else rng.normal(0, 1, 6).tolist() for i in state}
    known = spark.createDataFrame(list(held.items()), "face_id long, vector array<double>")

    def table():
        rows = [(i, p, a, held[i]) for i, (p, a) in state.items()]
        return spark.createDataFrame(rows, "face_id long, person_id long, assignment int, vector array<double>")

    before = table()
    kept = cut(sums.sums_of(before))
    for _ in range(4):
        for _ in range(50):  # moved, rejected, taken back, deleted people, new people
            state[draw.randrange(80)][:] = draw.choice([None, 1, 2, 3, 4, 5, 6]), draw.choice([0, 1, 2])
        after = table()
        changed = cut(sums.differences(before.drop("vector"), after.drop("vector")))
        moved = {r.face_id for r in changed.collect()}
        only = known.filter(known.face_id.isin(list(moved)))  # no other vector is there to be read
        kept = cut(sums.updated(kept, sums.change_of(changed, only)))
        before = after
    fresh, off = sums.repaired(kept, before)
    assert off.count() == 0
    want = {r.person_id: (r.sum, r.n) for r in fresh.collect()}
    got = {r.person_id: (r.sum, r.n) for r in kept.collect()}
    assert got.keys() == want.keys() and all(got[p][0] == pytest.approx(want[p][0], abs=1e-9) and got[p][1] == want[p][1] for p in want)
    means = {r.person_id: r.centroid for r in sums.centroids(kept).collect()}
    assert all(np.linalg.norm(m) == pytest.approx(1) for m in means.values())
    counted = before.filter("person_id is not null and assignment <> 2")
    assert {r.person_id: r.face_id for r in sums.covers_and_medoids(before, kept).collect()} == {r.person_id: r.medoid for r in vectors.medoid(counted, "person_id").collect()}
    broken = kept.filter("person_id <> 1")
    assert [r.person_id for r in sums.repaired(broken, before)[1].collect()] == [1]
