"""Journaled runs: stopped between any two steps, they go on to the same end."""

import os

import pytest

from kinlight.operators import runs
from kinlight.sources import actions


class Stop(Exception):
    pass


def stopping_once(seen):
    """Stops before each step when it comes up for the first time."""

    def step(name):
        if name not in seen:
            seen.append(name)
            raise Stop

    return step


def folder_with(tmp_path, name, n=6):
    src = tmp_path / name
    src.mkdir()
    for i in range(n):
        (src / f"{i}.jpg").write_bytes(b"picture" * (i + 1))
    return str(src)


def plan_of(spark, src, dst, n=6):
    return spark.createDataFrame([(i, f"{src}/{i}.jpg", f"{dst}/p{i % 2}/{i}.jpg") for i in range(n)], "id long, src_path string, dst_path string")


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


@pytest.mark.parametrize("kind", ["copy", "move"])
def test_goes_on_after_every_stop(spark, tmp_path, kind):
    src, dst, journal = folder_with(tmp_path, "in"), str(tmp_path / "out"), str(tmp_path / "journal")
    os.makedirs(f"{dst}/p1")
    with open(f"{dst}/p1/3.jpg", "wb") as f:
        f.write(b"somebody else's")
    plan, seen, found = plan_of(spark, src, dst), [], None
    while found is None:
        try:
            found = runs.run(plan, journal, kind, wave=3, step=stopping_once(seen))
        except Stop:
            if seen[-1].startswith("act"):  # a crash inside a wave: one action was done, and nobody wrote it down
                for r in spark.read.parquet(f"{journal}/started/wave={seen[-1][4:]}").filter("id <> 3").limit(1).collect():
                    actions.__dict__[f"{kind}_new"](r.src_path, r.dst_path)
    assert len(seen) >= 4 and seen[0] == "plan" and seen[-1] == "end"
    status = {r.id: r.status for r in found.collect()}
    assert status == {i: runs.SKIPPED if i == 3 else runs.DONE for i in range(6)}
    assert tree(dst) == sorted(f"p{i % 2}/{i}.jpg" for i in range(6)) and (tmp_path / "out/p1/3.jpg").read_bytes() == b"somebody else's"
    assert tree(src) == ([f"{i}.jpg" for i in range(6)] if kind == "copy" else ["3.jpg"])
    assert (tmp_path / "out/p1/5.jpg").read_bytes() == b"picture" * 6
    again = runs.run(plan.limit(0), journal, kind, step=seen.append)
    assert seen[-2:] == ["end", "end"] and again.count() == 6


def test_undo_puts_back_and_says_what_is_blocked(spark, tmp_path):
    src, dst, journal = folder_with(tmp_path, "in"), str(tmp_path / "out"), str(tmp_path / "journal")
    runs.run(plan_of(spark, src, dst), journal, "move")
    assert tree(src) == []
    (tmp_path / "in/2.jpg").write_bytes(b"new one")
    os.remove(f"{dst}/p0/4.jpg")
    found, counts = runs.undo(spark, journal)
    assert counts == {"undone": 4, "blocked": 2, "run_undone": False}
    assert {r.id for r in found.collect() if r.status != runs.DONE} == {2, 4}
    assert tree(src) == ["0.jpg", "1.jpg", "2.jpg", "3.jpg", "5.jpg"] and (tmp_path / "in/2.jpg").read_bytes() == b"new one"
    assert runs.undo(spark, journal)[1] == counts


def test_quarantine_forgets_what_went(spark, tmp_path):
    src, dst, journal = folder_with(tmp_path, "in", 3), str(tmp_path / "away"), str(tmp_path / "journal")
    plan = spark.createDataFrame([(1, f"{src}/1.jpg", f"{dst}/1.jpg", 14), (2, f"{src}/none.jpg", f"{dst}/2.jpg", 1)], "photo_id long, src_path string, dst_path string, bytes long")
    roots = spark.createDataFrame([(src,)], "path string")
    photos = spark.createDataFrame([(i,) for i in range(3)], "id long")
    store = {"photos": photos, "faces": spark.createDataFrame([(7, 1), (8, 2)], "id long, photo_id long")}
    assert runs.quarantine(plan, roots, f"{src}/sub", store, journal)[2] == "inside_root"
    left, found, why = runs.quarantine(plan, roots, dst, store, journal)
    assert why == "ok" and {r.id: r.status for r in found.collect()} == {1: runs.DONE, 2: runs.FAILED}
    assert {r.id for r in left["photos"].collect()} == {0, 2} and {r.id for r in left["faces"].collect()} == {8}


def test_export_checks_and_copies(spark, tmp_path):
    src, dst = folder_with(tmp_path, "in", 2), str(tmp_path / "out")
    plan = spark.createDataFrame([(i, 1, f"{src}/{i}.jpg", f"{dst}/Ann/{i}.jpg", 7) for i in range(2)], "photo_id long, person_id long, src_path string, dst_path string, bytes long")
    roots = spark.createDataFrame([(src,)], "path string")
    assert runs.export(plan, roots, dst, str(tmp_path / "j1"), False, free=3) == (None, "no_space")
    found, why = runs.export(plan, roots, dst, str(tmp_path / "j2"), False, free=100)
    assert why == "ok" and tree(dst) == ["Ann/0.jpg", "Ann/1.jpg"] and found.filter("status = 1").count() == 2
