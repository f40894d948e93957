"""A batch of moderation requests applied to the stored tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeboard.operators.moderation import NO_USER, authorize, delete_users, hide_users
from forgeboard.session import shared_dir, stage_in
from forgeboard.sources.snapshots import Snapshot, SnapshotStore


class Moderated(NamedTuple):
    """The version that holds the outcome, and the requests without one, with the reason."""

    version: int
    rejects: DataFrame


def moderate(store: SnapshotStore, requests: DataFrame) -> Moderated:
    """Apply ``(actor, action, target, hide, arrival)`` rows as far as they are allowed.

    Requests for a login take effect as they arrive: of the hides before its
    first delete the last one counts, and a hide that comes after it meets no
    user. A request without arrival comes before all others, and a delete
    before a hide of the same arrival. Who is an admin is settled before the
    batch. Only the parts that hold an allowed target are rewritten; moderation
    changes no key, so keys need no new check.
    """
    stage = stage_in(shared_dir(store.spark, "moderation"))
    decided = authorize(stage("requests", requests), store.read().users)
    allowed = stage("allowed", decided.allowed)
    came = F.struct(F.col("arrival").isNotNull().alias("known"), "arrival")
    gone = stage(
        "gone", allowed.filter("action = 'delete'").groupBy(F.col("target").alias("_gone")).agg(F.min(came).alias("_at"))
    )
    hides = stage(
        "hides",
        allowed.filter("action = 'hide'")
        .join(gone, F.col("target") == F.col("_gone"), "left")
        .withColumn("late", F.coalesce(came >= F.col("_at"), F.lit(False)))
        .withColumn("login", F.col("target"))
        .drop("_gone", "_at"),
    )
    deletes = gone.select(F.col("_gone").alias("login"))
    touched = store.touched_parts(allowed.select(F.col("target").alias("owner")))
    before = store.read(parts=touched)
    hidden = hide_users(before.users, hides.filter("NOT late").drop("late"))
    late = hides.filter("late").withColumn("reason", F.lit(NO_USER))
    left = delete_users(hidden.users, before.repos, deletes)
    rejects = stage(
        "rejects",
        decided.denied.unionByName(hidden.rejects.drop("login"))
        .unionByName(late.drop("login", "late"))
        .select("actor", "action", "target", "hide", "arrival", "reason"),
    )
    version = store.publish(Snapshot(left.users, left.repos), touched, check=False)
    return Moderated(version, rejects)
