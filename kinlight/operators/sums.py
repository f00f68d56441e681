"""People's mean vectors, kept as sums: a change adds and takes away the vectors of the faces that moved.

``sums(person_id, sum, n)`` has one row a person with vectors. After an action only faces whose person has changed are
looked at: ids and people of before and after are compared without vectors, and just the vectors of the difference are
read. The mean of anybody is then their sum, scaled; a face's similarities to all others of its person add up to its
product with the sum, less that with itself, so covers and medoids need no pairs either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlight.operators.vectors import vector_sums
from kinlight.plans.lineage import join_spread

REJECTED = 2


def _counted(faces: DataFrame) -> DataFrame:
    """Faces that count for their person: not rejected."""
    return faces.filter("person_id is not null").filter(~F.col("assignment").eqNullSafe(REJECTED))


def sums_of(faces: DataFrame) -> DataFrame:
    """The sums of ``faces(face_id, person_id, assignment, vector)`` from all vectors."""
    return vector_sums(_counted(faces), "person_id")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(face_id, gone_from, come_to) of the faces whose person, among those that count, isn't the same."""
    was, now = (_counted(f).select("face_id", F.col("person_id").alias(n)) for f, n in ((before, "gone_from"), (after, "come_to")))
    return was.join(now, "face_id", "full").filter(~F.col("gone_from").eqNullSafe(F.col("come_to")))


def change_of(changed: DataFrame, vectors: DataFrame) -> DataFrame:
    """What ``changed(face_id, gone_from, come_to)`` adds to the sums: (person_id, sum, n). Of ``vectors(face_id,
    vector)`` only those of changed faces are read; a face without a vector changes nothing."""
    of = changed.join(vectors.select("face_id", "vector").filter("vector is not null"), "face_id")
    gone = of.filter("gone_from is not null").select(F.col("gone_from").alias("person_id"), F.lit(-1).alias("sign"), "vector")
    come = of.filter("come_to is not null").select(F.col("come_to").alias("person_id"), F.lit(1).alias("sign"), "vector")
    parts = gone.unionByName(come).select("person_id", "sign", F.posexplode("vector").alias("pos", "x"))
    summed = parts.groupBy("person_id", "pos").agg(F.sum(F.col("sign") * F.col("x").cast("double")).alias("s"), F.sum("sign").alias("n"))
    return summed.groupBy("person_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("sum"), F.max("n").alias("n"))


def updated(sums: DataFrame, change: DataFrame) -> DataFrame:
    """Sums after a change; people without any vector left have no row."""
    both = sums.join(change.select("person_id", F.col("sum").alias("_sum"), F.col("n").alias("_n")), "person_id", "full")
    added = F.when(F.col("sum").isNull(), F.col("_sum")).when(F.col("_sum").isNull(), F.col("sum")).otherwise(F.zip_with("sum", "_sum", lambda a, b: a + b))
    n = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return both.select("person_id", added.alias("sum"), n.cast("long").alias("n")).filter("n > 0")


def centroids(sums: DataFrame) -> DataFrame:
    """(person_id, centroid, n): the sums at unit length; one of length zero stays as it is."""
    length = F.sqrt(F.aggregate("sum", F.lit(0.0).cast("double"), lambda a, x: a + x * x))
    unit = F.transform("sum", lambda x: x / F.col("_length"))
    return sums.withColumn("_length", length).select("person_id", F.when(F.col("_length") > 0, unit).otherwise(F.col("sum")).alias("centroid"), "n")


def repaired(sums: DataFrame, faces: DataFrame, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """Sums made anew from all vectors, and the people whose kept sums were off by more than ``tolerance`` in an entry, or
    missing, or too many: (person_id)."""
    fresh = sums_of(faces)
    both = fresh.join(sums.select("person_id", F.col("sum").alias("_sum"), F.col("n").alias("_n")), "person_id", "full")
    near = F.coalesce(F.forall(F.zip_with("sum", "_sum", lambda a, b: F.abs(a - b) <= tolerance), lambda x: x), F.lit(False))
    return fresh, both.filter(~(F.col("n").eqNullSafe(F.col("_n")) & near)).select("person_id")


def covers_and_medoids(faces: DataFrame, sums: DataFrame) -> DataFrame:
    """(person_id, face_id) of the face with the largest product with its person's sum less that with itself: the one
    most like all others. Ties go to the smaller id. One pass over the people's faces, nothing is paired."""
    from kinlight.functions.vectors import dot

    with_sum = join_spread(_counted(faces).filter("vector is not null"), sums.select("person_id", "sum"), ["person_id"], "face_id", "inner")
    score = F.round(dot("vector", "sum") - dot("vector", "vector"), 9)
    best = with_sum.groupBy("person_id").agg(F.max(F.struct(score.alias("s"), (-F.col("face_id")).alias("neg"))).alias("m"))
    return best.select("person_id", (-F.col("m.neg")).alias("face_id"))
