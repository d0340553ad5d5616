"""Gates on chains of versions: amendments that follow one another, and files that must not be older than the plan they carry out.

Amendments have one prior each, so all of them are followed at once by doubling: a round takes each version as far again as the ones
before, and a chain of a thousand takes ten. A version that no round brings to a first one hangs on a loop. Commits may have several
parents; a repository's history is walked in one task, each commit once, many repositories a call.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grouped import over_whole_groups, starts
from .ranks import written


def amendment_chain(amendments: DataFrame) -> DataFrame:
    """document, version, steps, problem of each amendment. amendments: document, version, prior (null for the first version).

    A sound document has one first version and each amendment changes the one before it. Problems, the first that applies: repeated
    (the version is named twice), second root (another, smaller version has no prior either), unknown prior, fork (another
    amendment has its prior), after a problem (a version before it has one), loop (its priors lead back to where they were); null
    where there is none. steps: amendments since the first version, null where it is not reached."""
    a = amendments.select(F.col("document").alias("grp"), "version", "prior")
    named = a.groupBy("grp", "version").agg(F.count(F.lit(1)).alias("times"), F.min("prior").alias("prior"))
    roots = Window.partitionBy("grp").orderBy(F.col("prior").isNotNull(), "version")
    known = named.select("grp", F.col("version").alias("prior"), F.lit(True).alias("known"))
    rows = named.withColumn("nth", F.row_number().over(roots)).withColumn("forks", F.count(F.lit(1)).over(Window.partitionBy("grp", "prior"))).join(known, ["grp", "prior"], "left")
    first = F.col("prior").isNull() & (F.col("nth") == 1)
    own = F.when(F.col("times") > 1, "repeated").when(F.col("prior").isNull() & ~first, "second root").when(F.col("prior").isNotNull() & F.col("known").isNull(), "unknown prior").when(F.col("prior").isNotNull() & (F.col("forks") > 1), "fork")
    # at: the version that `far` steps back lead to, null past an end; met: whether one of those passed over has a problem
    rows = written(rows.select("grp", "version", first.alias("first"), own.alias("own"), F.when(F.col("known"), F.col("prior")).alias("at")))
    # a document's longest chain has fewer steps than it has versions
    most = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    state = rows.select("grp", "version", "at", F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("far"))
    bad = rows.select("grp", F.col("version").alias("at"), F.col("own").isNotNull().alias("bad"))
    state = state.join(bad, ["grp", "at"], "left").select("grp", "version", "at", "far", F.coalesce("bad", F.lit(False)).alias("met"))
    # where a version ends: itself if nothing is before it
    state = written(state.withColumn("last", F.coalesce("at", "version")))
    reach = 1
    while reach < most:
        back = state.select("grp", F.col("version").alias("last"), F.col("at").alias("at2"), F.col("far").alias("far2"), F.col("met").alias("met2"), F.col("last").alias("last2"))
        state = written(state.join(back, ["grp", "last"]).select("grp", "version", F.when(F.col("at").isNotNull(), F.col("at2")).alias("at"), F.when(F.col("at").isNotNull(), F.col("far") + F.col("far2")).otherwise(F.col("far")).alias("far"), F.when(F.col("at").isNotNull(), F.col("met") | F.col("met2")).otherwise(F.col("met")).alias("met"), F.col("last2").alias("last")))
        reach *= 2
    ended = rows.filter("at is null").select("grp", F.col("version").alias("last"), F.col("first").alias("end"))
    out = rows.drop("at").join(state.select("grp", "version", "far", "met", "last"), ["grp", "version"]).join(ended, ["grp", "last"], "left")
    problem = F.coalesce("own", F.when(F.col("met"), "after a problem"), F.when(F.col("end").isNull(), "loop"))
    return out.select(F.col("grp").alias("document"), "version", F.when(F.col("end"), F.col("far")).cast("int").alias("steps"), problem.alias("problem"))


def _descendants(rows: pd.DataFrame) -> pd.DataFrame:
    """repo, id, steps of the commits that each repository's plan's own leads to, itself at 0. rows: repo, id, parent, and the plan's commit as a row without either."""
    bounds, ids, steps, sizes = starts(rows.repo.to_numpy()), [], [], []
    child, parent, plan = rows.id.tolist(), rows.parent.tolist(), rows.plan_id.tolist()
    for a, b in zip(bounds, bounds[1:]):
        now = list(dict.fromkeys(x for x in plan[a:b] if x is not None))
        met = dict.fromkeys(now, 0)
        after: dict = {}
        for c, p in zip(child[a:b], parent[a:b]) if now else ():
            if c is not None and p is not None:
                after.setdefault(p, []).append(c)
        while now:
            found = dict.fromkeys(c for p in now for c in after.get(p, ()) if c not in met)
            met.update(dict.fromkeys(found, met[now[0]] + 1))
            now = list(found)
        ids.extend(met)
        steps.extend(met.values())
        sizes.append(len(met))
    return pd.DataFrame({"repo": rows.repo.iloc[np.repeat(bounds[:-1], sizes)].reset_index(drop=True), "id": pd.Series(ids, dtype=object), "steps": np.array(steps, np.int32)})


def plan_before_code(commits: DataFrame, added: DataFrame, plan: str) -> DataFrame:
    """Files that were added without their repository's plan before them: repo, path, problem. By ancestry, not by time, which rewriting changes.

    commits: repo, id, parent (a row for each parent; null for none); added: repo, path, id (the commit that added it; null if it is
    not committed); plan: the path that has to come first. Problems: no plan, uncommitted, same commit, not an ancestor."""
    text = lambda c: F.col(c).cast("string")
    first = added.filter(F.col("path") == plan).groupBy("repo").agg(F.min(text("id")).alias("plan_id"))
    rows = commits.select("repo", text("id").alias("id"), text("parent").alias("parent"), F.lit(None).cast("string").alias("plan_id"))
    rows = rows.unionByName(first.filter("plan_id is not null").select("repo", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("parent"), "plan_id"))
    kind = commits.schema["repo"].dataType.simpleString()
    after = over_whole_groups(rows, "repo", "id", _descendants, f"repo {kind}, id string, steps int")
    files = added.filter(F.col("path") != plan).select("repo", "path", text("id").alias("id")).join(first.withColumn("planned", F.lit(True)), "repo", "left").join(after, ["repo", "id"], "left")
    problem = F.when(F.col("planned").isNull(), "no plan").when(F.col("id").isNull(), "uncommitted").when(F.col("steps") == 0, "same commit").when(F.col("steps").isNull(), "not an ancestor")
    return files.select("repo", "path", problem.alias("problem")).filter("problem is not null")
