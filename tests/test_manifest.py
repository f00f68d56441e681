"""Commits over several tables are seen whole or not at all."""

import pytest

from kinlight.operators import people
from kinlight.sources.manifest import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, f"file://{tmp_path}/store")
    persons = spark.createDataFrame([(1, "Ann"), (2, "Bob")], "person_id long, display_name string")
    faces = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 2, 2)], "face_id long, person_id long, assignment int")
    clusters = spark.createDataFrame([(10, 2)], "cluster_id long, person_id long")
    assert made.read().version == 0 and made.commit(made.read(), {"persons": persons, "faces": faces, "clusters": clusters}) == 1
    return made


def rows(snapshot):
    return {name: sorted(map(tuple, t.collect())) for name, t in snapshot.tables.items()}


def merged(snapshot):
    t = snapshot.tables
    return dict(zip(("persons", "faces", "clusters"), people.merge_people(t["persons"], t["faces"], t["clusters"], 1, [2]), strict=True))


def test_a_merge_is_seen_whole_or_not_at_all(store):
    before = store.read()
    was = rows(before)
    folders = store.write(merged(before))  # a crash here: written, and nothing seen
    assert store.read().version == 1 and rows(store.read()) == was
    assert store.publish(before, folders) == 2
    now = rows(store.read())
    assert now == {"persons": [(1, "Ann")], "faces": [(1, 1, 0), (2, 1, 1), (3, 1, 2)], "clusters": [(10, 1)]}
    assert rows(before) == was and rows(store.read(1)) == was  # who reads the old version goes on reading it


def test_one_of_two_writers_is_refused(store):
    first, second = store.read(), store.read()
    assert store.commit(first, {"clusters": first.tables["clusters"].limit(0)}) == 2
    with pytest.raises(Conflict):
        store.commit(second, merged(second))
    assert rows(store.read())["clusters"] == [] and len(rows(store.read())["persons"]) == 2
    # both have looked before either renames
    base, other = store.read(), store.read()
    folders = store.write({"clusters": base.tables["clusters"]})
    store._versions = lambda: [2]
    assert store.publish(base, folders) == 3
    with pytest.raises(Conflict):
        store.publish(other, folders)
    del store._versions
    assert store.read().version == 3


def test_cleaning_keeps_what_is_named(store):
    store.write({"faces": store.read().tables["faces"]})
    store.commit(store.read(), merged(store.read()))
    assert store.clean(keep=1) == 4
    assert store.read().version == 2 and len(rows(store.read())["faces"]) == 3 and store.clean(keep=1) == 0
