import hashlib
import io
import os

import pytest

from kinlight.operators import exports
from kinlight.sources import actions


def test_actions_never_overwrite(tmp_path, spark):
    a, b, c = (str(tmp_path / n) for n in ("a", "sub/b", "c"))
    with open(a, "wb") as f:
        f.write(b"123")
    assert actions.copy_new(a, b) == 3
    with pytest.raises(FileExistsError):
        actions.copy_new(a, b)
    with pytest.raises(FileExistsError):
        actions.move_new(a, b)
    mark = actions.mark_of(a)
    assert actions.move_new(a, c) == 3 and actions.move_new(a, c, mark) == 3
    with pytest.raises(FileNotFoundError):  # a file that happens to be there isn't the one that was moved
        actions.move_new(a, c)
    with pytest.raises(FileNotFoundError):
        actions.move_new(a, c, (3, "0" * 64))
    assert actions.delete(c) and not actions.delete(c)
    plan = spark.createDataFrame([(1, b, str(tmp_path / "d")), (2, b, b), (3, "/none", str(tmp_path / "e"))], "id long, src_path string, dst_path string")
    assert {r.id: r.status for r in exports.execute(plan, actions.copy_new).collect()} == {1: 1, 2: 3, 3: 2}


def test_model_is_verified(tmp_path):
    target, good = str(tmp_path / "m" / "x.onnx"), hashlib.sha256(b"model").hexdigest()
    with pytest.raises(ValueError):
        actions.fetch_model(target, good, lambda: io.BytesIO(b"other"))
    assert not list((tmp_path / "m").iterdir())
    assert actions.fetch_model(target, good, lambda: io.BytesIO(b"model")) == target

    def never():
        raise AssertionError

    assert actions.fetch_model(target, good, never) == target


def test_repeated_after_a_stop_between_any_steps(tmp_path):
    def fresh(n):
        src, dst = str(tmp_path / f"s{n}"), str(tmp_path / f"t{n}")
        with open(src, "wb") as f:
            f.write(b"picture")
        return src, dst, actions.mark_of(src)

    src, dst, mark = fresh(1)  # a move stopped between link and unlink
    os.link(src, dst)
    assert actions.move_new(src, dst, mark) == 7 and not os.path.exists(src)
    src, dst, mark = fresh(2)  # a move to another volume, stopped before its source went
    actions.copy_new(src, dst)
    assert actions.move_new(src, dst, mark) == 7 and not os.path.exists(src)
    src, dst, mark = fresh(3)  # a copy stopped half way
    with open(f"{dst}.part-{hashlib.sha256(src.encode()).hexdigest()[:12]}", "wb") as f:
        f.write(b"pic")
    assert actions.copy_new(src, dst, mark) == 7 == actions.copy_new(src, dst, mark)
    assert sorted(p.name for p in tmp_path.iterdir() if "3" in p.name) == ["s3", "t3"]
    src, dst, mark = fresh(4)  # changed since
    with open(src, "ab") as f:
        f.write(b"!")
    for act in (actions.copy_new, actions.move_new):
        with pytest.raises(OSError):
            act(src, dst, mark)
    assert os.path.exists(src) and not os.path.exists(dst)
    with pytest.raises(FileExistsError):
        actions.move_new(src, src)
    assert os.path.exists(src)
