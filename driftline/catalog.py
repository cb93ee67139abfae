"""Event schema, physical roles, feature schemas and the identity columns kept out of features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("pkts_toserver", T.DoubleType()),
        T.StructField("pkts_toclient", T.DoubleType()),
        T.StructField("bytes_toserver", T.DoubleType()),
        T.StructField("bytes_toclient", T.DoubleType()),
        T.StructField("flow_state", T.StringType()),
        T.StructField("modbus_function", T.DoubleType()),
        T.StructField("modbus_access", T.StringType()),
        T.StructField("modbus_quantity", T.DoubleType()),
        T.StructField("modbus_address", T.DoubleType()),
        T.StructField("dest_port", T.DoubleType()),
        T.StructField("rudder_angle", T.DoubleType()),
        T.StructField("rpm_command", T.DoubleType()),
        T.StructField("throttle_command_left", T.DoubleType()),
        T.StructField("throttle_command_right", T.DoubleType()),
        T.StructField("hydraulic_pump_rpm_left", T.DoubleType()),
        T.StructField("hydraulic_pump_rpm_right", T.DoubleType()),
    ]
)

# Scenario families, in matching order; anything else becomes OTHER.
FAMILIES = ("normal", "fault", "manipulation", "recon")
OTHER = "other"

# Event types, write function codes and feature column names.
ACCEPTED_TYPES = ("flow", "modbus")
WRITE_CODES = (5, 6, 15, 16)
FLOW_NUMERIC = ("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient")
FLOW_CATEGORICAL = ("flow_state",)
PROTOCOL_CATEGORICAL = ("modbus_function", "modbus_access")

# Columns that identify a domain or give the answer away.
IDENTITY_COLUMNS = (
    "source_dataset", "sensor", "register_space",
    "src_ip", "dest_ip", "dst_ip", "sip", "dip",
    "src_port", "dest_port", "dst_port", "src_port_role",
    "modbus_address", "modbus_quantity", "modbus_quantity_norm",
    "run_id", "scenario", "phase", "label", "attack_type",
    "alert_signature", "alert_sid", "timestamp", "_order",
    "engine_rpm", "ballast_level", "ballast_setpoint", "rpm_command",
    "heading_cmd", "heading", "rudder_angle", "gen_load", "bus_freq", "load_cmd",
    "hydraulic_pump_rpm_left", "hydraulic_pump_rpm_right",
    "throttle_command_left", "throttle_command_right",
)
# Testbed-specific decoder columns all carry this ending.
IDENTITY_SUFFIX = "_decoded"


def identifies_domain(column: str) -> bool:
    return column in IDENTITY_COLUMNS or column.endswith(IDENTITY_SUFFIX)


@dataclass(frozen=True)
class Role:
    """One canonical physical quantity and the raw columns it is read from in a domain."""

    name: str
    columns: tuple[str, ...]
    scale: float = 1.0


RUDDER = "rudder_norm"
PROPULSION = "propulsion_demand_norm"

# Full-scale readings and the safe bands of the normalised roles.
RUDDER_FULL_SCALE = 35.0
SHAFT_FULL_SCALE = 1200.0
PUMP_FULL_SCALE = 3000.0
SAFE_BANDS = {RUDDER: (-1.0, 1.0), PROPULSION: (0.0, 1.0)}
BAND_COLUMNS = {RUDDER: "rudder_band", PROPULSION: "propulsion_band"}


@dataclass(frozen=True)
class RoleCatalog:
    """Roles per ``source_dataset`` value; rows of an unlisted domain use ``default``."""

    domains: dict[str, tuple[Role, ...]]
    default: str
    side: dict[str, tuple[Role, ...]] = field(default_factory=dict)

    def spec(self, domain: str, role: str) -> Role | None:
        return next((r for r in self.domains[domain] if r.name == role), None)


SITE_A, SITE_B = "site_a", "site_b"

DEFAULT_ROLES = RoleCatalog(
    domains={
        SITE_A: (
            Role(RUDDER, ("rudder_angle",), RUDDER_FULL_SCALE),
            Role(PROPULSION, ("rpm_command",), SHAFT_FULL_SCALE),
        ),
        SITE_B: (
            Role(RUDDER, ("rudder_angle",), RUDDER_FULL_SCALE),
            Role(PROPULSION, ("throttle_command_left", "throttle_command_right")),
        ),
    },
    default=SITE_A,
    side={
        SITE_B: (
            Role("hydraulic_pump_rpm_left", ("hydraulic_pump_rpm_left",), PUMP_FULL_SCALE),
            Role("hydraulic_pump_rpm_right", ("hydraulic_pump_rpm_right",), PUMP_FULL_SCALE),
        )
    },
)


@dataclass(frozen=True)
class FeatureSchema:
    name: str
    protocol: bool
    roles: tuple[str, ...]

    @property
    def numeric(self) -> list[str]:
        columns = list(FLOW_NUMERIC)
        for role in self.roles:
            columns += [role, f"{role}_present"]
        return columns + (["rudder_rate"] if self.roles else [])

    @property
    def categorical(self) -> list[str]:
        columns = list(FLOW_CATEGORICAL)
        if self.protocol:
            columns += PROTOCOL_CATEGORICAL
        return columns + [BAND_COLUMNS[role] for role in self.roles]


FEATURE_SCHEMAS = {
    s.name: s
    for s in (
        FeatureSchema("flow", False, ()),
        FeatureSchema("protocol", True, ()),
        FeatureSchema("physical_strict", True, (RUDDER,)),
        FeatureSchema("physical_proxy", True, (RUDDER, PROPULSION)),
    )
}


def feature_schema(name: str) -> FeatureSchema:
    if name not in FEATURE_SCHEMAS:
        raise ValueError(f"unknown feature schema: {name}")
    return FEATURE_SCHEMAS[name]
