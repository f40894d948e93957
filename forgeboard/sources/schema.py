"""The three tables, their keys, and the checks run before a publish."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STR, _INT, _BOOL, _TIME = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _fields(names: str, data_type: T.DataType, nullable: bool = True) -> list[T.StructField]:
    return [T.StructField(n, data_type, nullable) for n in names.split()]


USER = T.StructType(
    _fields("login", _STR, False)
    + _fields("email location", _STR)
    + _fields("hireable", _BOOL)
    + _fields("blog bio", _STR)
    + _fields("followers following public_repos public_gists", _INT)
    + _fields("avatar_url", _STR)
    + _fields("disk_usage", _INT)
    + _fields("created_at updated_at", _TIME)
    + _fields("type name", _STR)
    + _fields("hide is_admin", _BOOL, False)
    + _fields("refreshed_at", _TIME)
    + _fields("company", _STR, False)
)

REPO = T.StructType(
    _fields("owner name", _STR, False)
    + _fields("description language homepage", _STR)
    + _fields(
        "forks_count network_count open_issues_count stargazers_count"
        " subscribers_count watchers_count size",
        _INT,
    )
    + _fields("fork", _BOOL)
    + _fields("default_branch master_branch", _STR)
    + _fields("created_at pushed_at updated_at refreshed_at", _TIME)
)

RUN = T.StructType(_fields("created_at", _TIME, False))

USER_KEY = ["login"]
REPO_KEY = ["owner", "name"]

# Flags kept by moderation; a refresh never overwrites them.
MODERATION_FLAGS = ["hide", "is_admin"]

# Values a column takes when it is added to older data.
ADDED_DEFAULTS = {"hide": False, "is_admin": False, "company": ""}

# Bounded text columns.
MAX_LENGTH = 255
USER_BOUNDED = ["login", "type", "name"]
REPO_BOUNDED = ["owner", "name", "language"]


def _sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else "'" + str(value).replace("'", "\\'") + "'"


def evolve(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Bring ``df`` to ``schema``: add absent columns with their default.

    Columns already there keep their values, so applying it twice changes
    nothing.
    """
    defaults = ADDED_DEFAULTS if defaults is None else defaults
    present = {f.name: f.dataType for f in df.schema.fields}

    def column(field: T.StructField) -> str:
        if present.get(field.name) == field.dataType:
            return field.name
        value = field.name if field.name in present else _sql_literal(defaults.get(field.name))
        return f"CAST({value} AS {field.dataType.simpleString()}) AS {field.name}"

    return df.selectExpr(*[column(f) for f in schema.fields])


def validate_keys(
    df: DataFrame,
    key: list[str],
    required: list[str] | None = None,
    bounded: list[str] | None = None,
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """Rows ``(rule, column, key, rows)``, one per broken rule and key.

    One narrow scan finds NULLs and over-long text. Duplicates are counted
    with map-side partial aggregation, so a key copied a billion times reaches
    its reducer as one row per input task.
    """
    required = [c for c in (required or []) if c not in key]
    shown = F.to_json(F.struct(*key)).alias("key")

    def broken(rule: str, column: str, test: Column) -> Column:
        return F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column")))

    tests = [broken("null_key", c, F.col(c).isNull()) for c in key]
    tests += [broken("null_required", c, F.col(c).isNull()) for c in required]
    tests += [broken("too_long", c, F.length(c) > max_length) for c in (bounded or [])]
    per_row = (
        df.select(*key, F.explode(F.array_compact(F.array(*tests))).alias("hit"))
        .groupBy("hit.rule", "hit.column", *key)
        .agg(F.count("*").alias("rows"))
        .select("rule", "column", shown, "rows")
    )
    whole_key = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    copies = (
        df.filter(whole_key)
        .groupBy(*key)
        .agg(F.count("*").alias("rows"))
        .filter("rows > 1")
        .select(
            F.lit("duplicate_key").alias("rule"), F.lit(",".join(key)).alias("column"), shown, "rows"
        )
    )
    return per_row.unionByName(copies)


def user_violations(users: DataFrame) -> DataFrame:
    return validate_keys(users, USER_KEY, [*MODERATION_FLAGS, "company"], USER_BOUNDED)


def repo_violations(repos: DataFrame) -> DataFrame:
    return validate_keys(repos, REPO_KEY, bounded=REPO_BOUNDED)
