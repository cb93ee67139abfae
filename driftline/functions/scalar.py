"""Column expressions shared by the operators; all are JVM built-ins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.catalog import FAMILIES, OTHER, WRITE_CODES, RoleCatalog


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Numbers as text; the engine's own casts would also take type suffixes such as ``3f`` and ``1.5d``.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$"


def stripped(c: str | Column) -> Column:
    """Text without white space at either end."""
    return F.btrim(col(c).cast("string"), F.lit(WHITE_SPACE))


def safe_double(c: str | Column) -> Column:
    """Double value; text that is no number, NaN and missing all become null.

    The type is known when the plan is made, so numeric columns are cast without looking at text.
    """
    text = stripped(c)
    value = F.when(F.typeof(col(c)) != "string", col(c).try_cast("double"))
    value = value.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.isnan(value), None).otherwise(value)


def scenario_family(c: str | Column) -> Column:
    """Family a scenario name equals or ends with (``<domain>_<family>``), else ``other``."""
    name = F.lower(stripped(c))
    result = F.lit(None)
    for family in reversed(FAMILIES):
        hit = (name == family) | name.endswith(f"_{family}")
        result = F.when(hit, family).otherwise(result)
    return F.coalesce(result, F.lit(OTHER))


def is_attack(c: str | Column = "label") -> Column:
    return F.coalesce((col(c) == "attack").cast("int"), F.lit(0))


def is_write(c: str | Column = "modbus_function") -> Column:
    return F.coalesce(safe_double(c).isin([float(v) for v in WRITE_CODES]), F.lit(False))


def epoch_micros(c: str | Column) -> Column:
    """Microseconds since the epoch of an ISO-8601 stamp; bad stamps are null.

    A stamp without offset is UTC, whatever the session's time zone.
    """
    text = stripped(c)
    day_only = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    no_offset = text.contains(":") & ~text.rlike("([zZ]|[+-][0-9]{2}(:?[0-9]{2})?)$")
    stamp = (
        F.when(day_only, F.concat(text, F.lit("T00:00:00Z")))
        .when(no_offset, F.concat(text, F.lit("Z")))
        .otherwise(text)
    )
    return F.unix_micros(F.try_to_timestamp(stamp))


def epoch_seconds(c: str | Column) -> Column:
    return epoch_micros(c) / F.lit(1e6)


def mean_present(columns: Iterable[Column]) -> Column:
    """Row-wise mean over the columns that are present; null when none is."""
    columns = list(columns)
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    count = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, count)


def role_value(
    catalog: RoleCatalog, role: str, available: Iterable[str], domain_column: str = "source_dataset"
) -> Column:
    """Normalised role value, chosen per row by the row's domain."""
    available = set(available)

    def for_domain(domain: str) -> Column:
        spec = catalog.spec(domain, role)
        raw = [c for c in spec.columns if c in available] if spec else []
        if not raw:
            return F.lit(None).cast("double")
        return mean_present(safe_double(c) / F.lit(spec.scale) for c in raw)

    value = for_domain(catalog.default)
    if domain_column not in available:
        return value
    for domain in catalog.domains:
        if domain != catalog.default:
            value = F.when(F.col(domain_column) == domain, for_domain(domain)).otherwise(value)
    return value


def band(value: Column, low: float, high: float, write: Column) -> Column:
    return (
        F.when(~write, "na")
        .when(value.isNull(), "unknown")
        .when(value.between(low, high), "in_band")
        .otherwise("out_of_band")
    )


def hash32(*parts: str | Column) -> Column:
    """Replayable 32-bit hash: leading eight hex digits of the MD5 of the parts joined by ``|``."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def next_double(c: Column) -> Column:
    """Next double above ``c`` in pure arithmetic (Rump, Zimmermann, Boldo, Melquiond 2009)."""
    phi = 2.0**-53 * (1.0 + 2.0**-52)
    return c + (F.abs(c) * F.lit(phi) + F.lit(5e-324))


def r6(c: str | Column) -> Column:
    return F.round(col(c).cast("double"), 6)
