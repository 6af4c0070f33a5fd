"""References to records that do not exist, for composite keys with partial nulls.

References are grouped by null mask: which of their key columns are null.  The declared match semantics say
what a mask means:

simple   a reference with any null is none (SQL's default)
partial  a reference must match on its non-null columns; one without any non-null column is none
full     all columns null is none; some null is an orphan of status ``partial``

Each mask that has to match is anti-joined on its own non-null columns with the targets living at its time.  Only the
orphans, the few that are left, are then joined with one row a key that tells their status.  A key that holds a third of
all references is split by the engine: the anti-join's left side may be cut at will, and the right side has as many rows
as the key has lives.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_references(refs: DataFrame, targets: DataFrame, keys: list[str], at: str, created: str, deleted: str, match: str = "simple") -> DataFrame:
    """The rows of ``refs`` without a living target, with ``status`` (in place of a column of that name).

    refs has ``keys`` and the time ``at`` of each reference, and any other columns; targets has ``keys``, ``created``,
    ``deleted`` (null while it lives).  A target lives at t if created <= t and deleted is null or > t.  status:
    ``missing`` if no target has the key, ``deleted`` if one was created at or before t, else ``late``; ``partial`` see
    above.  A null time lives nowhere: its key is missing, or else late.  Targets with null created never live;
    targets with a null in a key column match nothing under that column.  Repeated references all stay.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics {match}")
    refs = refs.drop("status")
    lives = targets.select(*[F.col(k).cast(refs.schema[k].dataType).alias(f"__{k}") for k in keys], F.col(created).alias("__c"), F.col(deleted).alias("__d"))
    t = F.col(at)
    out = None
    for mask in product((True, False), repeat=len(keys)):
        full, none = all(mask), not any(mask)
        if none or (match == "simple" and not full):
            continue
        chosen = refs
        for k, there in zip(keys, mask, strict=True):
            chosen = chosen.where(F.col(k).isNotNull() if there else F.col(k).isNull())
        if match == "full" and not full:
            part = chosen.withColumn("status", F.lit("partial"))
        else:
            on = [k for k, there in zip(keys, mask, strict=True) if there]
            same = [F.col(k) == F.col(f"__{k}") for k in on]
            alive = (F.col("__c") <= t) & (F.col("__d").isNull() | (F.col("__d") > t))
            lost = chosen.join(lives, [*same, alive], "left_anti")
            known = lives.where(" AND ".join(f"`__{k}` IS NOT NULL" for k in on)).groupBy(*[f"__{k}" for k in on]).agg(F.min("__c").alias("__first"), F.lit(True).alias("__known"))
            status = F.when(F.col("__known").isNull(), "missing").when(F.coalesce(F.col("__first") <= t, F.lit(False)), "deleted").otherwise("late")
            part = lost.join(known, same, "left").withColumn("status", status)
        part = part.select(*refs.columns, "status")
        out = part if out is None else out.unionByName(part)
    return out
