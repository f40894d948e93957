"""Hiding, deleting, and who may ask for it, as batches of request rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeboard.operators.maintenance import last_arrival
from forgeboard.sources.schema import USER_KEY


#: What callers look for in the reasons of requests turned away.
NO_USER = "affected no users"
NOT_ONESELF = "Users can only modify themselves"
NO_ADMIN = "Only admins can delete users"


class Hidden(NamedTuple):
    """The users after the requests, and the requests that met no user."""

    users: DataFrame
    rejects: DataFrame


def hide_users(users: DataFrame, requests: DataFrame) -> Hidden:
    """Set ``hide`` for exact logins from ``(login, hide[, arrival])``.

    Among several requests for a login the last one counts. A request that
    does not say whether to hide is turned away.
    """
    clear = requests.filter("hide IS NOT NULL")
    wanted = last_arrival(clear, USER_KEY).select(
        F.col("login").alias("_login"), F.col("hide").alias("_hide")
    )
    shown = users.join(wanted, F.col("login") == F.col("_login"), "left").select(
        *[
            F.when(F.col("_login").isNotNull(), F.col("_hide")).otherwise(F.col(c)).alias(c)
            if c == "hide"
            else F.col(c)
            for c in users.columns
        ]
    )
    unmet = clear.join(users.select("login"), "login", "left_anti")
    unclear = requests.filter("hide IS NULL")
    return Hidden(
        shown,
        unmet.withColumn("reason", F.lit(NO_USER)).unionByName(
            unclear.withColumn("reason", F.lit("hide is required"))
        ),
    )


class Remaining(NamedTuple):
    """What is left after deleting."""

    users: DataFrame
    repos: DataFrame


def delete_users(users: DataFrame, repos: DataFrame, logins: DataFrame) -> Remaining:
    """Remove the repositories and the profile of each login; unknown logins are no error.

    A login asked for twice changes nothing, so the requests go into the joins
    as they are. That leaves adaptive execution free to split a hot owner.
    """
    gone = logins.select("login")
    return Remaining(
        users.join(gone, "login", "left_anti"),
        repos.join(gone.withColumnRenamed("login", "owner"), "owner", "left_anti"),
    )


class Decided(NamedTuple):
    """Requests by outcome."""

    allowed: DataFrame
    denied: DataFrame


def authorize(requests: DataFrame, users: DataFrame) -> Decided:
    """Split ``(actor, action, target, ...)`` rows.

    ``hide`` is for admins and for oneself, ``delete`` for admins alone. An
    actor without a profile is no admin.
    """
    actors = users.select(F.col("login").alias("actor"), F.col("is_admin").alias("_admin"))
    admin = F.coalesce("_admin", F.lit(False))
    may = ((F.col("action") == "hide") & (admin | (F.col("actor") == F.col("target")))) | (
        (F.col("action") == "delete") & admin
    )
    judged = requests.join(actors, "actor", "left").withColumn(
        "_may", F.coalesce(may, F.lit(False))
    )
    reason = F.when(F.col("action") == "hide", NOT_ONESELF).when(
        F.col("action") == "delete", NO_ADMIN
    ).otherwise("unknown action")
    return Decided(
        judged.filter("_may").select(*requests.columns),
        judged.filter("NOT _may").select(*requests.columns, reason.alias("reason")),
    )
