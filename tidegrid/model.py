"""Schemas, classes and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Classes, names of fields and their types.
STALL, CABINET = "stall", "cabinet"
CLASSES = (STALL, CABINET)
ENVELOPE_REQUIRED = ("message_id", "device_id", "device_class", "arrival_ts_ms", "readings")
IDENTITY = ("device_id", "device_class", "firmware_version", "device_ts_ms", "payload_hash", "arrival_ts_ms")
NATURAL_KEY = ("device_id", "device_ts_ms", "payload_hash")

STALL_READING = "session_id string, state string, output_voltage_v double, output_current_a double, output_power_kw double, connector_temp_c double, energy_delivered_kwh double, fault_code bigint, device_ts_ms bigint, payload_hash string"
CABINET_READING = "grid_voltage_v double, grid_frequency_hz double, transformer_temp_c double, contactor_closed boolean, active_stall_count bigint, aggregate_power_kw double, fault_code bigint, device_ts_ms bigint, payload_hash string"
ENVELOPE = "message_id string, device_id string, device_class string, firmware_version string, site_id string, protocol string, sent_ts_ms bigint, arrival_ts_ms bigint"


@dataclass(frozen=True)
class Thresholds:
    """The limits of checks."""

    future_ms: int = 6 * 3_600_000
    stuck_run: int = 5
    burst_gap_ratio: float = 3.0
    burst_batch_ratio: float = 0.5
    burst_least_messages: int = 4
    grid_ms: int = 60_000
    lateness_horizon_ms: int = 24 * 3_600_000
    silence_ms: int = 30 * 60_000
    suppression_floor: int = 20
    size_edges: tuple[int, ...] = (256, 512, 1024, 2048, 4096, 8192)
    #: Most change a second, by canonical signal.
    jump_rates: dict[str, float] = field(
        default_factory=lambda: {"output_voltage_v": 10.0, "output_current_a": 40.0, "output_power_kw": 20.0, "connector_temp_c": 2.0, "transformer_temp_c": 0.5, "energy_delivered_kwh": 0.05, "grid_voltage_v": 5.0, "grid_frequency_hz": 0.05}
    )
    session_scoped: tuple[str, ...] = ("output_voltage_v", "output_current_a", "output_power_kw", "connector_temp_c", "energy_delivered_kwh")


DEFAULTS = Thresholds()


@dataclass(frozen=True)
class Signal:
    """An entry of the catalog: what a raw field of one class and firmware becomes."""

    raw: str
    canonical: str
    type: str
    unit: str | None = None
    low: float | None = None
    high: float | None = None
    kind: str = "measurement"


def _signals(rows: list[tuple]) -> list[Signal]:
    return [Signal(*r) for r in rows]


#: Names, types, units and valid ranges.
STALL_SIGNALS = _signals([
    ("session_id", "session_id", "string"), ("state", "session_state", "enum"), ("output_voltage_v", "output_voltage_v", "float", "V", 390.0, 410.0), ("output_current_a", "output_current_a", "float", "A", 0.0, 257.5),
    ("output_power_kw", "output_power_kw", "float", "kW", 0.0, 105.6), ("connector_temp_c", "connector_temp_c", "float", "degC", 29.0, 43.7), ("energy_delivered_kwh", "energy_delivered_kwh", "float", "kWh", 0.0, None), ("fault_code", "stall_fault_code", "int"),
])
CABINET_SIGNALS = _signals([
    ("grid_voltage_v", "grid_voltage_v", "float", "V", 475.0, 485.0), ("grid_frequency_hz", "grid_frequency_hz", "float", "Hz", 59.9, 60.1), ("transformer_temp_c", "transformer_temp_c", "float", "degC", 34.0, 60.0), ("contactor_closed", "contactor_closed", "bool"),
    ("active_stall_count", "active_stall_count", "int", None, 0.0, 8.0), ("aggregate_power_kw", "aggregate_power_kw", "float", "kW", 0.0, 480.0), ("fault_code", "cabinet_fault_code", "int"),
])
CATALOG: dict[tuple[str, str], list[Signal]] = {(STALL, v): STALL_SIGNALS for v in ("2.1.4", "2.3.0", "3.0.1")} | {(CABINET, v): CABINET_SIGNALS for v in ("1.8.2", "1.9.0")}
#: How much more often than usual a firmware's devices lose touch, and the most that is expected of any.
QUIRKS = {"2.1.4": 2.5, "2.3.0": 1.3, "3.0.1": 0.5, "1.8.2": 2.5, "1.9.0": 1.3}
MOST_OUTAGES, MOST_DROPS = 0.95, 0.9
