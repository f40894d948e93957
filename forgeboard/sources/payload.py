"""Raw JSON payloads to table rows."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeboard.operators.maintenance import ARRIVAL
from forgeboard.sources.schema import (
    MAX_LENGTH,
    MODERATION_FLAGS,
    REPO,
    REPO_BOUNDED,
    REPO_KEY,
    USER,
    USER_BOUNDED,
    USER_KEY,
)

CORRUPT = "_corrupt_record"
# The name an account was visited by, which may differ in case from its login.
VISITED = "visited"
TOO_LONG = "value too long"
MALFORMED = "malformed payload"
# A row set aside for one of these ends its listing: what it should have said is
# unknown, so nothing may be pruned on its account.
ENDS_LISTING = (TOO_LONG, MALFORMED)
_STAMPED = [*MODERATION_FLAGS, "refreshed_at"]


def _wire(schema: T.StructType, skip: list[str]) -> list[T.StructField]:
    """Payload fields: as stored, but every one optional and counts read at full width."""
    wide = {T.IntegerType(): T.LongType()}
    return [
        T.StructField(f.name, wide.get(f.dataType, f.dataType))
        for f in schema.fields
        if f.name not in skip
    ]


USER_PAYLOAD = T.StructType([*_wire(USER, _STAMPED), T.StructField(CORRUPT, T.StringType())])
REPO_PAYLOAD = T.StructType(
    [
        T.StructField("owner", T.StructType([T.StructField("login", T.StringType())])),
        *_wire(REPO, ["owner", "refreshed_at"]),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

# One line of a landed file. ``kind`` is profile, repo or listing; ``login``
# names the account being visited; ``fetched_at`` is the fetch time of a
# profile and the start of the listing for the other two; ``ok`` says whether
# the call ended well; ``body`` is the payload as text.
ENVELOPE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("login", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("body", T.StringType()),
    ]
)


def file_position() -> Column:
    """Which stretch of which file a line lies in, older files first."""
    return F.struct(
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def arrival_order(position: Column | None = None) -> Column:
    """Position of a line among all files: the stretch it lies in, then its place there."""
    position = file_position() if position is None else position
    return F.struct(
        position.alias("stretch"), F.monotonically_increasing_id().alias("line")
    ).alias(ARRIVAL)


def read_payload(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Payload rows from files of JSON lines, each with its arrival position.

    Lines are read as text and parsed with the full schema, so that a line is
    found malformed no matter which columns a query goes on to use.
    """
    lines = spark.read.text(path).select(F.col("value").alias("body"), arrival_order())
    return parse_body(lines, schema)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Envelope lines from files, each with its arrival position."""
    return spark.read.schema(ENVELOPE).json(path).select(*ENVELOPE.names, arrival_order())


def parse_body(df: DataFrame, schema: T.StructType, body: str = "body") -> DataFrame:
    """Payload rows from a text column; the other columns stay."""
    parsed = F.from_json(
        body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    others = [c for c in df.columns if c != body]
    return df.select(*others, parsed.alias("_p")).select(*others, "_p.*")


class Normalized(NamedTuple):
    """Rows in table form, and the payload rows that have none, with the reason."""

    rows: DataFrame
    rejects: DataFrame


def _int32(name: str) -> str:
    """A count in 32 bits; one beyond that range wraps around as it does at the source."""
    low = f"pmod({name}, 4294967296)"
    return f"CAST(IF({low} < 2147483648, {low}, {low} - 4294967296) AS INT)"


def _judge(
    payload: DataFrame,
    schema: T.StructType,
    missing: dict[str, tuple[str, str]],
    bounded: list[str],
    filled: dict[str, str],
    refreshed_at: datetime | str,
) -> DataFrame:
    """Payload rows in table form with a ``reason``, which is NULL for a good row.

    ``missing`` gives each key column its payload field and what to say when
    that is absent or empty; ``bounded`` are the columns of limited length and
    ``filled`` those a payload does not decide.
    """
    cases = [f"WHEN {CORRUPT} IS NOT NULL THEN '{MALFORMED}'"] if CORRUPT in payload.columns else []
    cases += [f"WHEN coalesce({field}, '') = '' THEN '{say}'" for field, say in missing.values()]
    long = [f"length({missing.get(c, (c,))[0]}) > {MAX_LENGTH}" for c in bounded]
    cases.append(f"WHEN {' OR '.join(long)} THEN '{TOO_LONG}'")

    def value(field: T.StructField) -> str:
        name = field.name
        if name in filled:
            return f"{filled[name]} AS {name}"
        if name in missing:
            return f"{missing[name][0]} AS {name}"
        return f"{_int32(name)} AS {name}" if isinstance(field.dataType, T.IntegerType) else name

    stamp = F.col(refreshed_at) if isinstance(refreshed_at, str) else F.lit(refreshed_at)
    kept = [c for c in (ARRIVAL, VISITED) if c in payload.columns]
    return payload.withColumn("refreshed_at", stamp.cast("timestamp")).selectExpr(
        *[value(f) for f in schema.fields], *kept, f"CASE {' '.join(cases)} END AS reason"
    )


def split(judged: DataFrame, key: list[str]) -> Normalized:
    """Part judged rows into good ones and rejects."""
    return Normalized(
        judged.filter("reason IS NULL").drop("reason"),
        judged.filter("reason IS NOT NULL").select(*key, "reason"),
    )


def judge_users(payload: DataFrame, refreshed_at: datetime | str) -> DataFrame:
    return _judge(
        payload,
        USER,
        {"login": ("login", "user missing login")},  # fixed value: what callers look for
        USER_BOUNDED,
        {"company": "coalesce(company, '')", **{flag: "false" for flag in MODERATION_FLAGS}},
        refreshed_at,
    )


def judge_repos(payload: DataFrame, refreshed_at: datetime | str) -> DataFrame:
    return _judge(
        payload,
        REPO,
        # What callers look for.
        {"owner": ("owner.login", "repo missing owner"), "name": ("name", "repo missing name")},
        REPO_BOUNDED,
        {},
        refreshed_at,
    )


def normalize_users(payload: DataFrame, refreshed_at: datetime | str) -> Normalized:
    """Profile payloads to user rows.

    Absent fields become NULL, an absent company becomes empty text. The
    moderation flags are never taken from a payload. ``refreshed_at`` is a
    time or the name of a column that holds it.
    """
    return split(judge_users(payload, refreshed_at), USER_KEY)


def normalize_repos(payload: DataFrame, refreshed_at: datetime | str) -> Normalized:
    """Repository payloads to repository rows; a bad row is set aside, the rest go on."""
    return split(judge_repos(payload, refreshed_at), REPO_KEY)
