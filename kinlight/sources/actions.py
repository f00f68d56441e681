"""File actions for executing plans: they never overwrite, and say what happened by their errors.

Copies are written beside their target under a name of their own and linked into place, so a target is whole or not
there; moves link, then unlink. Both can be repeated after a crash between any two steps: with the ``mark`` of the
source, its length and SHA-256, taken before the first attempt, work that is done counts as done, and a file that just
happens to be there doesn't.
"""

from __future__ import annotations

import errno
import hashlib
import os
import shutil
from collections.abc import Callable
from typing import BinaryIO

#: Length and SHA-256 of a file.
Mark = tuple[int, str]


def mark_of(path: str) -> Mark:
    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
        return f.tell(), digest


def _is(path: str, mark: Mark | None) -> bool:
    return mark is not None and os.path.isfile(path) and os.path.getsize(path) == mark[0] and mark_of(path) == mark


def copy_new(src: str, dst: str, mark: Mark | None = None) -> int:
    """Copy a file to a place that is free; bytes written. FileExistsError if it isn't, unless what is there has the
    ``mark`` of the source, which a repeated copy is known by."""
    if os.path.lexists(dst):
        if _is(dst, mark):
            return mark[0]
        raise FileExistsError(dst)
    os.makedirs(os.path.dirname(dst) or ".", exist_ok=True)
    part = f"{dst}.part-{hashlib.sha256(src.encode()).hexdigest()[:12]}"
    shutil.copyfile(src, part)
    shutil.copystat(src, part)
    n = os.path.getsize(part)
    if mark is not None and not _is(part, mark):
        os.remove(part)
        raise OSError(errno.ESTALE, "the file has changed since it was planned", src)
    try:
        os.link(part, dst)  # refuses a target that has come up meanwhile
    finally:
        os.remove(part)
    return n


def move_new(src: str, dst: str, mark: Mark | None = None) -> int:
    """Move a file to a place that is free; bytes moved. FileExistsError if it isn't, FileNotFoundError without a
    source, unless what is there has the source's ``mark`` and the source is gone or the same file: a repeated move."""
    there, here = os.path.lexists(dst), os.path.lexists(src)
    if there:
        if here and os.path.samefile(src, dst):
            if os.path.abspath(src) == os.path.abspath(dst):
                raise FileExistsError(dst)
            os.remove(src)
            return os.path.getsize(dst)
        if _is(dst, mark) and (not here or _is(src, mark)):
            if here:
                os.remove(src)
            return mark[0]
        raise FileExistsError(dst) if here else FileNotFoundError(src)
    if mark is not None and here and not _is(src, mark):
        raise OSError(errno.ESTALE, "the file has changed since it was planned", src)
    n = os.path.getsize(src)
    os.makedirs(os.path.dirname(dst) or ".", exist_ok=True)
    try:
        os.link(src, dst)
    except OSError as e:
        if e.errno not in (errno.EXDEV, errno.EPERM, errno.ENOTSUP):
            raise
        copy_new(src, dst, mark)  # another volume
    os.remove(src)
    return n


def delete(path: str) -> bool:
    """Delete a file; False if there was none."""
    try:
        os.remove(path)
    except FileNotFoundError:
        return False
    return True


def fetch_model(target: str, sha256: str, opener: Callable[[], BinaryIO]) -> str:
    """Make sure that a model file with this digest is at ``target``: fetched beside it, verified, and renamed
    into place. A wrong digest raises ValueError and leaves nothing behind."""
    if os.path.exists(target):
        with open(target, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() == sha256.lower():
                return target
    part = f"{target}.part"
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    digest = hashlib.sha256()
    with opener() as source, open(part, "wb") as out:
        while block := source.read(1 << 20):
            digest.update(block)
            out.write(block)
    if digest.hexdigest() != sha256.lower():
        os.remove(part)
        raise ValueError(f"{target}: the file's digest is {digest.hexdigest()}")
    os.replace(part, target)
    return target
