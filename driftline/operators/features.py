"""Feature tables: flow counters, protocol fields, physical roles, change rate and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.catalog import (
    BAND_COLUMNS,
    DEFAULT_ROLES,
    FLOW_NUMERIC,
    RUDDER,
    RUDDER_FULL_SCALE,
    SAFE_BANDS,
    RoleCatalog,
    feature_schema,
    identifies_domain,
)
from driftline.functions.scalar import (
    band,
    epoch_micros,
    is_write,
    role_value,
    safe_double,
)
from driftline.operators.ordered import Split, previous_row


class LeakageError(ValueError):
    """A column that identifies the domain reached a feature table."""


def assert_no_leakage(columns: list[str]) -> None:
    leaked = sorted(c for c in columns if identifies_domain(c))
    if leaked:
        raise LeakageError(f"identity columns among the features: {leaked}")


def _optional(df: DataFrame, name: str, absent: Column) -> Column:
    return F.col(name) if name in df.columns else absent


def counter(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(safe_double(name), F.lit(0.0))


def code_text(df: DataFrame, name: str) -> Column:
    """A numeric code as canonical text (``3.0``), so both domains spell it alike."""
    if name not in df.columns:
        return F.lit("na")
    return F.coalesce(safe_double(name).cast("string"), F.col(name).cast("string"), F.lit("na"))


def with_time(df: DataFrame) -> DataFrame:
    """Add ``t_us`` from ``timestamp`` unless the table already carries it."""
    if "t_us" in df.columns:
        return df
    stamp = epoch_micros("timestamp") if "timestamp" in df.columns else F.lit(None).cast("bigint")
    return df.withColumn("t_us", stamp)


def rate_of_change(
    df: DataFrame, value: str, name: str, split: Split = Split()
) -> DataFrame:
    """Per-run change of ``value`` per second between consecutive *sampled* rows; 0 elsewhere.

    Rows lacking the value or the time are not samples: they keep rate 0 and do not interrupt the
    sequence, so only samples enter the window.
    """
    sampled = (
        F.col(value).isNotNull() & F.col("t_us").isNotNull() & F.col("run_id").isNotNull()
    )
    samples = previous_row(
        df.filter(sampled), ["run_id"], "t_us", ["event_id"], [value, "t_us"], split
    )
    seconds = (F.col("t_us") - F.col("previous.t_us")) / F.lit(1e6)
    rate = F.try_divide(F.col(value) - F.col(f"previous.{value}"), seconds)
    samples = samples.withColumn(name, F.coalesce(rate, F.lit(0.0))).drop("previous")
    # A plain filter keeps rows where the predicate is false but never null: the parts are
    # disjoint and complete.
    return samples.unionByName(df.filter(~sampled).withColumn(name, F.lit(0.0)))


def build_features(
    df: DataFrame,
    schema: str,
    keep: list[str] | None = None,
    roles: RoleCatalog = DEFAULT_ROLES,
    split: Split = Split(),
) -> DataFrame:
    """Feature columns of ``schema`` plus the ``keep`` columns needed to join or score later.

    ``keep`` columns travel beside the features and are excluded from ``feature_schema(schema)``.
    """
    fs = feature_schema(schema)
    assert_no_leakage(fs.numeric + fs.categorical)
    keep = ["event_id"] if keep is None else keep
    write = is_write() if "modbus_function" in df.columns else F.lit(False)

    columns: dict[str, Column] = {c: counter(df, c) for c in FLOW_NUMERIC}
    columns["flow_state"] = F.coalesce(
        _optional(df, "flow_state", F.lit("unknown")).cast("string"), F.lit("na")
    )
    if fs.protocol:
        columns["modbus_function"] = code_text(df, "modbus_function")
        columns["modbus_access"] = F.coalesce(
            _optional(df, "modbus_access", F.lit("na")).cast("string"), F.lit("na")
        )
    if not fs.roles:
        return df.select(*keep, *[v.alias(k) for k, v in columns.items()])

    for role in fs.roles:
        columns[f"_{role}"] = role_value(roles, role, df.columns)
        low, high = SAFE_BANDS[role]
        columns[BAND_COLUMNS[role]] = band(columns[f"_{role}"], low, high, write)
    df = with_time(df)
    wanted = list(dict.fromkeys([*keep, "run_id", "t_us", "event_id"]))
    wide = df.select(
        *[F.col(c).alias(f"_keep_{c}") for c in wanted],
        *[v.alias(k) for k, v in columns.items()],
    ).withColumnsRenamed({f"_keep_{c}": c for c in ("run_id", "t_us", "event_id")})
    rated = rate_of_change(wide, f"_{RUDDER}", "rudder_rate", split)
    features = [*fs.numeric, *fs.categorical]
    values = {r: F.coalesce(F.col(f"_{r}"), F.lit(0.0)) for r in fs.roles}
    values |= {f"{r}_present": F.col(f"_{r}").isNotNull().cast("int") for r in fs.roles}
    shared = ("run_id", "t_us", "event_id")
    return rated.select(
        *[F.col(c if c in shared else f"_keep_{c}").alias(c) for c in keep],
        *[values.get(c, F.col(c)).alias(c) for c in features],
    )


def side_roles(df: DataFrame, roles: RoleCatalog = DEFAULT_ROLES) -> DataFrame:
    """Side-analysis readings of single domains; never part of a shared feature schema."""
    out = df
    for domain, specs in roles.side.items():
        for role in specs:
            raw = [c for c in role.columns if c in df.columns]
            value = safe_double(raw[0]) / F.lit(role.scale) if raw else F.lit(None).cast("double")
            if "source_dataset" in df.columns:
                value = F.when(F.col("source_dataset") == domain, value)
            out = out.withColumn(f"{role.name}_norm", value)
    return out


def tracking_error(command: str, actual: str) -> Column:
    """Commanded minus actual rudder angle on the full scale; null if either is missing."""
    return (safe_double(command) - safe_double(actual)) / F.lit(RUDDER_FULL_SCALE)


def leakage_checks(columns: list[str]) -> dict[str, bool]:
    return {c: not identifies_domain(c) for c in columns}
