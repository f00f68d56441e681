"""Naming all unnamed groups, each absorbing those that look like it, as if one after the other.

Taken one by one in the order of size, a group is named unless an earlier one has absorbed it, and absorbs later ones
within reach. Which groups get a name is thus decided by the links "an earlier group would absorb a later one": a group
is named as soon as no link from an undecided group leads to it, and whatever a named one links to is absorbed. All
groups for which that holds are settled together, in rounds, until no undecided link is left; who absorbed a group is
then the first named one that links to it. The outcome is that of one after the other.

Links come from the pruned similarity join. Late rounds of few links are finished by one task, whose size has a bound.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlight.functions.text import valid_name
from kinlight.operators import people
from kinlight.operators.vectors import similar_pairs, unit_mean
from kinlight.operators.workflows import MATCH, Library, decided
from kinlight.plans.lineage import BROADCAST_ROWS, cut, join_spread
from kinlight.plans.numbering import numbered

#: Links that one task settles by itself.
FINISH_LINKS = 200_000


def _in_sequence(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which ends of a few links are named, going through them in order."""
    before: dict[int, list[int]] = {}
    for h, g in zip(pdf["h"].tolist(), pdf["g"].tolist(), strict=True):
        before.setdefault(g, []).append(h)
    named: set[int] = set()
    everyone = sorted(set(pdf["h"].tolist()) | before.keys())
    for g in everyone:
        if named.isdisjoint(before.get(g, ())):
            named.add(g)
    return pd.DataFrame({"g": everyone, "named": [g in named for g in everyone]})


def settle(links: DataFrame, finish: int = FINISH_LINKS) -> DataFrame:
    """Groups that come to be absorbed: (g), given ``links(h, g)``, h before g. All others on a link are named."""
    left, done = cut(links.select("h", "g").distinct()), []
    while (n := left.count()) > finish:
        ends = left.select(F.col("h").alias("v"), F.lit(0).alias("t")).union(left.select(F.col("g").alias("v"), F.lit(1).alias("t")))
        first = ends.groupBy("v").agg(F.max("t").alias("t")).filter("t = 0").select(F.col("v").alias("h"), F.lit(True).alias("_first"))
        led = cut(_with(left, first, "h", "g", n))
        absorbed = cut(led.filter("_first").select("g").distinct())
        done.append(absorbed)
        gone = absorbed.select("g", F.lit(True).alias("_gone"))
        rest = _with(led.filter("_first is null").drop("_first"), gone, "g", "h", n).filter("_gone is null").drop("_gone")
        left = cut(_with(rest, gone.withColumnRenamed("g", "h"), "h", "g", n).filter("_gone is null").select("h", "g"))
    last = left.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_in_sequence, "g long, named boolean").filter("not named").select("g")
    return cut(reduce(DataFrame.unionByName, done, last))


def _with(links: DataFrame, marks: DataFrame, key: str, other: str, n: int) -> DataFrame:
    """``links`` with the marks of their ``key``; there are no more marks than twice the ``n`` links."""
    return links.join(F.broadcast(marks), key, "left") if 2 * n <= BROADCAST_ROWS else join_spread(links, marks, [key], other)


def links_of(groups: DataFrame, least: float) -> DataFrame:
    """(h, g) where group h, once named, would absorb the later group g: the mean of the faces that h brings along,
    ``own``, is as near as ``least`` to the mean of all of g's, ``mean``. ``groups(rank, mean, own)``; a null ``own``
    equals ``mean``, and an empty one absorbs nothing."""
    of_all = groups.filter(F.size("mean") > 0).select((2 * F.col("rank") + 1).alias("id"), F.col("mean").alias("v"))
    apart = groups.filter(F.size("own") > 0).select((2 * F.col("rank")).alias("id"), F.col("own").alias("v"))
    near = similar_pairs(of_all.unionByName(apart), least, id_col="id", vector_col="v").filter("a % 2 = 1 or b % 2 = 1")
    both = near.select("a", "b").union(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("b % 2 = 1")
    pairs = both.select(F.expr("a div 2").alias("h"), F.expr("b div 2").alias("g"), (F.col("a") % 2 == 1).alias("_by_mean")).filter("h < g")
    same = groups.select(F.col("rank").alias("h"), F.col("own").isNull().alias("_same"))
    return join_spread(pairs, same, ["h"], "g", "inner").filter("not _by_mean or _same").select("h", "g")


def name_all_groups(library: Library, stem: str, first_id: int, least: float = MATCH, finish: int = FINISH_LINKS) -> tuple[Library, dict]:
    """Name every unnamed group ``<stem> 1``, ``<stem> 2`` and so on, larger groups first, with free numbers only;
    each absorbs later ones that look like it, as :func:`kinlight.operators.workflows.name_group` does. Groups whose
    faces have all been decided on are skipped and use up no number. New people get ids from ``first_id`` in the
    order of their numbers. Outcome: status, named, skipped, absorbed (groups), faces (assigned)."""
    clean = library.persons.sparkSession.range(1).select(valid_name(F.lit(f"{stem.strip()} 1")).alias("n")).first().n
    if not stem.strip() or clean is None:
        return library, {"status": "invalid"}
    prefix = f"{stem.strip()} "
    pending = library.clusters.filter("person_id is null").select("cluster_id", "size", "medoid_face_id")
    ranked = cut(numbered(pending, [F.desc("size"), F.asc("cluster_id")])[0].withColumnRenamed("row_no", "rank"))
    faces = library.faces.withColumn("_open", ~decided())
    members = cut(join_spread(faces.filter("cluster_id is not null"), ranked.select("cluster_id", "rank"), ["cluster_id"], "face_id", "inner"))
    seen = members.groupBy("rank").agg(F.sum(F.col("_open").cast("long")).alias("free"), F.count(F.when(~F.col("_open"), F.col("vector"))).alias("_decided"))
    mean = unit_mean(members, "rank", zero_as_null=True).select("rank", F.col("centroid").alias("mean"))
    mixed = members.join(seen.filter("_decided > 0 and free > 0").select("rank"), "rank", "left_semi")
    own = unit_mean(mixed.filter("_open"), "rank", zero_as_null=True).select("rank", F.coalesce("centroid", F.array().cast("array<double>")).alias("own"))
    stand = cut(ranked.join(seen, "rank", "left").withColumn("free", F.coalesce("free", F.lit(0))))
    open_groups = stand.filter("free > 0").join(mean, "rank", "left").join(own, "rank", "left")
    own_or_none = F.when(F.col("_decided") > 0, F.coalesce("own", F.array().cast("array<double>"))).otherwise(F.col("own"))
    links = cut(links_of(open_groups.select("rank", "mean", own_or_none.alias("own")), least))

    lost = settle(links, finish)
    named = cut(stand.filter("free > 0").select("rank", "cluster_id", "size", "medoid_face_id").join(lost.withColumnRenamed("g", "rank"), "rank", "left_anti"))
    leaders = named.select(F.col("rank").alias("h"), F.lit(True).alias("_named"))
    taken_by = join_spread(links, leaders, ["h"], "g", "inner").groupBy("g").agg(F.min("h").alias("leader"))
    of = taken_by.join(lost, "g", "left_semi").select(F.col("g").alias("rank"), "leader")
    names = people.numbered_names(named.select("cluster_id", "size"), library.persons, prefix)
    fresh = cut(named.join(names, "cluster_id").select("rank", (F.col("nth") - 1 + first_id).alias("_person"), "display_name", "medoid_face_id"))
    count = fresh.count()
    owner = of.unionByName(named.select("rank", F.col("rank").alias("leader")))
    given = cut(owner.join(fresh.select(F.col("rank").alias("leader"), "_person"), "leader").join(ranked.select("rank", "cluster_id"), "rank").select("cluster_id", "rank", "leader", "_person"))
    if not count:
        return library, {"status": "named", "named": 0, "skipped": stand.count(), "absorbed": 0, "faces": 0}

    marked = join_spread(faces, given.select("cluster_id", "_person"), ["cluster_id"], "face_id")
    take = F.col("_person").isNotNull() & F.col("_open")
    changed = cut(people.assign(marked, take, F.col("_person"), 0).select(*library.faces.columns))
    clusters = library.clusters.join(given.select("cluster_id", "_person"), "cluster_id", "left").withColumn("person_id", F.coalesce("_person", "person_id"))
    blank = {f.name: F.lit(None).cast(f.dataType) for f in library.persons.schema.fields}
    new = fresh.select(*[c.alias(n) for n, c in (blank | {"person_id": F.col("_person"), "display_name": F.col("display_name"), "cover_face_id": F.col("medoid_face_id")}).items()])
    # a cover is chosen among the faces of the named group, and stays whatever is absorbed afterwards
    led = given.filter("rank = leader").select("cluster_id")
    first_faces = changed.join(led, "cluster_id", "left_semi").filter("assignment <> 2 or assignment is null")
    own_faces = first_faces.join(fresh.select(F.col("_person").alias("person_id")), "person_id", "left_semi")
    covered = cut(people.calibrate(new, own_faces).select(*library.persons.columns))
    all_faces = changed.filter("assignment <> 2 or assignment is null").join(fresh.select(F.col("_person").alias("person_id")), "person_id", "left_semi")
    persons = library.persons.unionByName(people.calibrate(covered, all_faces).select(*library.persons.columns))
    skipped, absorbed = stand.filter("free = 0").count(), given.filter("rank <> leader").count()
    assigned = changed.join(fresh.select(F.col("_person").alias("person_id")), "person_id", "left_semi").count()
    now = replace(library.with_faces(changed), persons=cut(persons), clusters=cut(clusters.select(*library.clusters.columns)))
    return now, {"status": "named", "named": count, "skipped": skipped, "absorbed": absorbed, "faces": assigned}
