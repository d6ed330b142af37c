"""The signal catalog: from a mapping, JSON or YAML file to typed entries and a DataFrame."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..model import Signal


class CatalogError(ValueError):
    pass


def from_mapping(data: dict) -> dict[tuple[str, str], list[Signal]]:
    """device_class -> firmware -> raw field -> entry; what isn't a mapping is metadata."""
    out: dict[tuple[str, str], list[Signal]] = {}
    for device_class, versions in data.items():
        if not isinstance(versions, dict):
            continue
        for firmware, fields in versions.items():
            if not isinstance(fields, dict):
                continue
            entries = []
            for raw, e in fields.items():
                try:
                    low, high = e.get("valid_range") or (None, None)
                    entries.append(Signal(raw, e["canonical_name"], e["type"], e.get("unit"), low, high, e.get("kind", "measurement")))
                except (KeyError, TypeError, AttributeError, ValueError) as x:
                    raise CatalogError(f"{device_class} {firmware} {raw}: {x!r}") from x
            out[device_class, str(firmware)] = entries
    return out


def load(path: str) -> dict[tuple[str, str], list[Signal]]:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return from_mapping(json.loads(text))
    import yaml  # not everywhere installed

    return from_mapping(yaml.safe_load(text))


def frame(spark: SparkSession, catalog: dict[tuple[str, str], list[Signal]]) -> DataFrame:
    rows = [(c, f, s.raw, s.canonical, s.type, s.unit, s.low, s.high) for (c, f), signals in catalog.items() for s in signals]
    return spark.createDataFrame(rows, "device_class string, firmware_version string, raw_field string, canonical_name string, type string, unit string, low double, high double")
