"""Planning exports into folders by person, undoing moves, and quarantining duplicates.

Plans are tables; only :func:`execute` touches files, one partition at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlight.functions.text import file_name, fold_case, folder_name, inside, stem
from kinlight.operators.maintenance import delete_photos
from kinlight.plans.lineage import cut
from kinlight.plans.numbering import free_numbers, numbered_in_groups


def inside_any(roots: DataFrame, folder: str) -> bool:
    """Whether a folder lies in, or is, one of the scan roots."""
    return not roots.filter(inside(F.lit(folder), F.col("path"))).isEmpty()


def unique_destinations(plan: DataFrame, order: list[Column | str], existing: DataFrame | None = None) -> DataFrame:
    """Give each row of ``plan(folder, name)`` a path of its own, ignoring case: the first in ``order`` keeps
    its name, later ones get `` (2)``, `` (3)`` and so on before the extension, however many there are.

    ``existing(path)`` is taken from the start, and so is every name that the plan itself asks for: a made-up name
    gives way to a real one. So the rows that ask for one name get its free numbers in turn, all at once."""
    ext = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    base = F.concat_ws("/", "folder", "name")
    rows = plan.withColumn("_base", fold_case(base))
    ranked = cut(numbered_in_groups(rows, "_base", order))
    there = ranked.select(F.col("_base").alias("_path"), F.lit(False).alias("_real")).distinct()
    if existing is not None:
        there = there.unionByName(existing.select(fold_case("path").alias("_path"), F.lit(True).alias("_real")))
    # a taken path blocks number 1 of its own name if it exists, and number n of the name before " (n)"
    suffix = r"^(.*) \((\d{1,9})\)((?:\.[^./]*)?)$"
    name = F.concat(F.regexp_extract("_path", suffix, 1), F.regexp_extract("_path", suffix, 3))
    number = F.expr("try_cast(regexp_extract(_path, '^.* [(]([1-9][0-9]{0,8})[)]([.][^./]*)?$', 1) as bigint)")
    blocked = there.filter("_real").select(F.col("_path").alias("_base"), F.lit(1).cast("long").alias("number"))
    blocked = blocked.unionByName(there.select(name.alias("_base"), number.alias("number")).filter("number > 1"))
    asked = ranked.select("_base").distinct()
    numbers = free_numbers(ranked, blocked.join(asked, "_base", "left_semi"), "_base")
    made_up = F.concat(F.col("folder"), F.lit("/"), stem("name"), F.lit(" ("), F.col("number").cast("string"), F.lit(")"), ext)
    return numbers.withColumn("dst_path", F.when(F.col("number") == 1, base).otherwise(made_up)).drop("_base", "nth", "number")


def plan_export(appear: DataFrame, photos: DataFrame, persons: DataFrame, root: str, move: bool, people: list[int] | None = None) -> DataFrame:
    """One operation per person and photo (copy), or per photo (move: its first person by name): (photo_id,
    person_id, src_path, dst_path, bytes). Folders are named for people; order is by name, then photo."""
    chosen = persons if people is None else persons.filter(F.col("person_id").isin(people))
    rows = appear.join(chosen.select("person_id", "display_name"), "person_id").join(photos.select("photo_id", "path", F.col("file_size").alias("bytes")), "photo_id")
    if move:
        first = Window.partitionBy("photo_id").orderBy(fold_case("display_name"), "person_id")
        rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    named = rows.select("photo_id", "person_id", "display_name", F.col("path").alias("src_path"), F.concat_ws("/", F.lit(root.rstrip("/")), folder_name("display_name")).alias("folder"), file_name("path").alias("name"), "bytes")
    planned = unique_destinations(named, [fold_case("display_name"), F.col("person_id"), F.col("photo_id")])
    return planned.select("photo_id", "person_id", "src_path", "dst_path", "bytes")


def plan_bytes(plan: DataFrame, free: int | None = None) -> DataFrame:
    """Operations and bytes of a plan, and whether they fit; unknown free space counts as enough."""
    enough = F.lit(True) if free is None else F.coalesce(F.sum("bytes"), F.lit(0)) <= free
    return plan.agg(F.count("*").alias("ops"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), enough.alias("fits"))


def plan_quarantine(members: DataFrame, photos: DataFrame, folder: str, existing: DataFrame | None = None) -> DataFrame:
    """Moves of all but the best of each set into one folder under names of their own: (photo_id, src_path,
    dst_path, bytes)."""
    extra = members.filter("rank > 1").select("photo_id").join(photos.select("photo_id", "path", F.col("file_size").alias("bytes")), "photo_id")
    rows = extra.select("photo_id", F.col("path").alias("src_path"), F.lit(folder.rstrip("/")).alias("folder"), file_name("path").alias("name"), "bytes")
    return unique_destinations(rows, [F.col("photo_id")], existing).select("photo_id", "src_path", "dst_path", "bytes")


def checked(plan: DataFrame, roots: DataFrame, folder: str, free: int | None = None) -> tuple[DataFrame | None, str]:
    """A plan that may run, or None, and why: ``inside_root`` if the target folder is a scan root or in one,
    ``nothing`` if the plan is empty, ``no_space`` if its bytes exceed ``free`` (None: unknown, which is enough),
    else ``ok``."""
    if inside_any(roots, folder):
        return None, "inside_root"
    need = plan_bytes(plan, free).first()
    return (None, "nothing") if not need.ops else (None, "no_space") if not need.fits else (plan, "ok")


def forget_moved(store: dict[str, DataFrame], outcome: DataFrame) -> dict[str, DataFrame]:
    """The tables without the photos that were moved away, given ``outcome(id, status)``, and all that hangs on
    them; photos that failed or were skipped stay."""
    return delete_photos(store, outcome.filter("status = 1").select("id"))


def plan_undo(ops: DataFrame, files: DataFrame) -> DataFrame:
    """What undoing a move does to each done operation, given ``files(path)`` that exist: (id, from_path,
    to_path, outcome), blocked where the original's place is taken or the moved file is gone."""
    there = files.select(fold_case("path").alias("_p"), F.lit(True).alias("_there")).distinct()
    done = ops.filter("status = 1")
    src = done.withColumn("_p", fold_case("src_path")).join(there, "_p", "left").withColumnRenamed("_there", "_src").drop("_p")
    both = src.withColumn("_p", fold_case("dst_path")).join(there, "_p", "left").withColumnRenamed("_there", "_dst").drop("_p")
    blocked = F.col("_src").isNotNull() | F.col("_dst").isNull()
    return both.select("id", F.col("dst_path").alias("from_path"), F.col("src_path").alias("to_path"), F.when(blocked, "blocked").otherwise("undone").alias("outcome"))


def undo_status(plan: DataFrame) -> DataFrame:
    """Counts of an undo, and whether the run may be marked undone: only if nothing was blocked."""
    return plan.agg(F.sum((F.col("outcome") == "undone").cast("long")).alias("undone"), F.sum((F.col("outcome") == "blocked").cast("long")).alias("blocked"), (F.sum((F.col("outcome") == "blocked").cast("long")) == 0).alias("run_undone"))


def execute(plan: DataFrame, act: Callable[[str, str], int]) -> DataFrame:
    """Run ``act(src, dst)``, which returns bytes written and raises FileExistsError or OSError, on each row of
    a plan: its id with status done (1), failed (2) or skipped (3), bytes and error. The plan must be in the
    journal first, as a task may run again: acts have to be safe to repeat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    rows.append((r.id, 1, act(r.src_path, r.dst_path), None))
                except FileExistsError:
                    rows.append((r.id, 3, 0, None))
                except OSError as e:
                    rows.append((r.id, 2, 0, str(e)))
            yield pd.DataFrame(rows, columns=["id", "status", "bytes", "error"])

    return plan.select("id", "src_path", "dst_path").mapInPandas(run, "id long, status int, bytes long, error string")


def run_counters(outcome: DataFrame) -> DataFrame:
    """Operations and bytes by status."""
    return outcome.groupBy("status").agg(F.count("*").alias("ops"), F.sum("bytes").alias("bytes"))


def add_scan_root(roots: DataFrame, path: str, exists: bool = True) -> tuple[DataFrame, str]:
    """Add a folder to the scan roots: not_found, already_present, already_covered by a root above it, or
    added, in which case roots below it go."""
    if not exists:
        return roots, "not_found"
    new = F.lit(path.rstrip("/"))
    if not roots.filter(fold_case(F.rtrim("path", F.lit("/"))) == fold_case(new)).isEmpty():
        return roots, "already_present"
    if not roots.filter(inside(new, F.col("path"), itself=False)).isEmpty():
        return roots, "already_covered"
    row = roots.sparkSession.range(1).select(new.alias("path"))
    return roots.filter(~inside(F.col("path"), new, itself=False)).unionByName(row, allowMissingColumns=True), "added"
