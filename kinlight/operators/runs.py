"""Running plans of file actions from a journal, so that a run goes on after a crash and can be undone.

A journal is a folder of tables in any store that Spark writes to: ``planned`` holds the whole plan, dealt to waves;
``started/wave=n`` the marks (length and digest) of a wave's files, taken before it touches any; ``done/wave=n`` what
became of them. Each is written by one Spark job and counts once it is whole. A run does what the journal lacks: a wave
that was started but isn't done runs again, and its actions tell by the marks what they had done already, as they do
when Spark repeats a task. Files are touched by the tasks, through paths that all executors have mounted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlight.operators.exports import checked, forget_moved
from kinlight.sources import actions

#: Operations of a wave: what may have to be looked at again after a crash.
WAVE = 100_000
DONE, FAILED, SKIPPED = 1, 2, 3
ACTS: dict[str, Callable[..., int]] = {"copy": actions.copy_new, "move": actions.move_new}


def _whole(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder))


def _once(table: DataFrame, path: str) -> DataFrame:
    """Write a table unless the journal has it whole; read it back."""
    spark = table.sparkSession
    if not _whole(spark, path):
        table.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for path in batch["src_path"]:
            try:
                found.append(actions.mark_of(path))
            except OSError:
                found.append((None, None))
        batch["length"] = pd.array([n for n, _ in found], "Int64")
        batch["digest"] = [d for _, d in found]
        yield batch


def _acting(kind: str):
    act = ACTS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                mark = None if r.digest is None else (int(r.length), r.digest)
                try:
                    rows.append((r.id, DONE, act(r.src_path, r.dst_path, mark), None))
                except FileExistsError:
                    rows.append((r.id, SKIPPED, 0, None))
                except OSError as e:
                    rows.append((r.id, FAILED, 0, str(e)))
            yield pd.DataFrame(rows, columns=["id", "status", "bytes", "error"])

    return run


def run(plan: DataFrame, journal: str, kind: str, wave: int = WAVE, step: Callable[[str], None] = lambda name: None) -> DataFrame:
    """Run ``plan(id, src_path, dst_path)`` as copies or moves, or go on with the run that ``journal`` holds (its own
    plan then counts, and ``plan`` isn't read): (id, src_path, dst_path, status, bytes, error). ``step`` hears of each
    step before it is taken. Targets that exist are skipped, missing or changed sources fail; the others go on."""
    spark = plan.sparkSession
    planned = f"{journal}/planned"
    if not _whole(spark, planned):
        step("plan")
        waves = max(1, -(-plan.count() // wave))
        of = F.pmod(F.xxhash64("id"), F.lit(waves)).cast("int")
        plan.select(F.col("id").cast("long").alias("id"), "src_path", "dst_path", of.alias("wave")).write.mode("overwrite").partitionBy("wave").parquet(planned)
    ops = spark.read.schema("id long, src_path string, dst_path string, wave int").parquet(planned)
    for n in sorted(r.wave for r in ops.select("wave").distinct().collect()):
        done = f"{journal}/done/wave={n}"
        if _whole(spark, done):
            continue
        step(f"start {n}")
        mine = ops.filter(F.col("wave") == n).select("id", "src_path", "dst_path")
        started = _once(mine.mapInPandas(_marks, "id long, src_path string, dst_path string, length long, digest string"), f"{journal}/started/wave={n}")
        step(f"act {n}")
        _once(started.mapInPandas(_acting(kind), "id long, status int, bytes long, error string"), done)
    step("end")
    return outcome(spark, journal)


def outcome(spark: SparkSession, journal: str) -> DataFrame:
    """What the journal says of each operation; those of waves that aren't done have no status."""
    ops = spark.read.schema("id long, src_path string, dst_path string, wave int").parquet(f"{journal}/planned").drop("wave")
    done = [f"{journal}/done/wave={n}" for n in _waves(spark, journal)]
    kinds = "id long, status int, bytes long, error string"
    known = spark.read.schema(kinds).parquet(*done) if done else spark.createDataFrame([], kinds)
    return ops.join(known, "id", "left")


def _waves(spark: SparkSession, journal: str) -> list[int]:
    waves = spark.read.schema("id long, wave int").parquet(f"{journal}/planned").select("wave").distinct().collect()
    return [r.wave for r in waves if _whole(spark, f"{journal}/done/wave={r.wave}")]


def undo(spark: SparkSession, journal: str, wave: int = WAVE, step: Callable[[str], None] = lambda name: None) -> tuple[DataFrame, dict]:
    """Move back what a run of moves has moved, journaled beside it in the same way: the operations' outcome and how
    many were undone and blocked (the place is taken, or the moved file gone or changed). The run counts as undone
    only if none was blocked."""
    back = outcome(spark, journal).filter(F.col("status") == DONE).select("id", F.col("dst_path").alias("src_path"), F.col("src_path").alias("dst_path"))
    found = run(back, f"{journal}/undo", "move", wave, step)
    undone, total = found.agg(F.coalesce(F.sum((F.col("status") == DONE).cast("long")), F.lit(0)), F.count("*")).first()
    return found, {"undone": undone, "blocked": total - undone, "run_undone": undone == total}


def export(plan: DataFrame, roots: DataFrame, folder: str, journal: str, move: bool, free: int | None = None, wave: int = WAVE) -> tuple[DataFrame | None, str]:
    """Check a plan of :func:`kinlight.operators.exports.plan_export` and run it: its outcome and ``ok``, or None and
    why it may not run. A run that the journal holds already goes on without another check."""
    if not _whole(plan.sparkSession, f"{journal}/planned"):
        allowed, why = checked(plan, roots, folder, free)
        if allowed is None:
            return None, why
    keyed = plan.withColumn("id", F.xxhash64("photo_id", "dst_path"))
    return run(keyed, journal, "move" if move else "copy", wave), "ok"


def quarantine(plan: DataFrame, roots: DataFrame, folder: str, store: dict[str, DataFrame], journal: str, free: int | None = None, wave: int = WAVE) -> tuple[dict[str, DataFrame], DataFrame | None, str]:
    """Move duplicates away by a plan of :func:`kinlight.operators.exports.plan_quarantine` and forget those that
    went, with all that hangs on them: the tables, the outcome (by photo) and ``ok``, or why it may not run."""
    if not _whole(plan.sparkSession, f"{journal}/planned"):
        allowed, why = checked(plan, roots, folder, free)
        if allowed is None:
            return store, None, why
    found = run(plan.withColumn("id", F.col("photo_id")), journal, "move", wave)
    return forget_moved(store, found.select("id", "status")), found, "ok"
