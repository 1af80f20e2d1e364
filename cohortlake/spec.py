"""Table specifications: typed properties, event order and settings, kept as JSON."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from cohortlake.errors import ConfigError

TYPES: dict[str, T.DataType] = {"int": T.LongType(), "double": T.DoubleType(), "bool": T.BooleanType(), "text": T.StringType()}
BUILT_IN = ("stamp", "event", "id", "session")
MAX_PROPERTIES = 4096
_NAME = re.compile(r"[^ 0-9][a-z0-9_]+")
_MINUTE, _DAY = 60_000, 86_400_000

#: Defaults and the smallest and largest value of each setting (milliseconds, but for event_max).
SETTINGS: dict[str, tuple[int, int, int]] = {
    "event_max": (5_000, 1, 1 << 31),
    "event_ttl": (5 * 365 * _DAY, _MINUTE, 100 * 365 * _DAY),
    "session_time": (30 * _MINUTE, 1_000, 365 * _DAY),
    "maint_interval": (_DAY, _MINUTE, 365 * _DAY),
    "segment_interval": (1_000, 100, _DAY),
    "tz_offset": (0, -_DAY, _DAY),
}


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    is_set: bool = False
    is_customer: bool = False

    def __post_init__(self):
        if not _NAME.fullmatch(self.name) or self.name in BUILT_IN:
            raise ConfigError(f"bad property name {self.name!r}", "property_name")
        if self.type not in TYPES:
            raise ConfigError(f"bad type {self.type!r} of {self.name}; one of {', '.join(TYPES)}", "property_type")

    @property
    def spark_type(self) -> T.DataType:
        return T.ArrayType(TYPES[self.type]) if self.is_set else TYPES[self.type]


@dataclass(frozen=True)
class TableSpec:
    name: str
    id_type: str = "textual"
    properties: tuple[Property, ...] = ()
    event_order: tuple[str, ...] = ()
    settings: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        if self.id_type not in ("numeric", "textual"):
            raise ConfigError("id_type must be numeric or textual", "id_type")
        names = [p.name for p in self.properties]
        if len(set(names)) < len(names):
            raise ConfigError("a property is named twice", "property_exists")
        if len(names) > MAX_PROPERTIES:
            raise ConfigError(f"more than {MAX_PROPERTIES} properties", "property_count")
        for key in self.settings:
            if key not in SETTINGS:
                raise ConfigError(f"unknown setting {key!r}", "setting")

    def setting(self, name: str) -> int:
        default, low, high = SETTINGS[name]
        return min(max(int(self.settings.get(name, default)), low), high)

    @property
    def event_properties(self) -> tuple[Property, ...]:
        return tuple(p for p in self.properties if not p.is_customer)

    @property
    def customer_properties(self) -> tuple[Property, ...]:
        return tuple(p for p in self.properties if p.is_customer)

    @property
    def id_spark_type(self) -> T.DataType:
        return T.LongType() if self.id_type == "numeric" else T.StringType()

    def get(self, name: str) -> Property | None:
        return next((p for p in self.properties if p.name == name), None)

    def with_property(self, p: Property) -> TableSpec:
        if self.get(p.name):
            raise ConfigError(f"property {p.name} exists", "property_exists")
        return replace(self, properties=(*self.properties, p))

    def without_property(self, name: str) -> TableSpec:
        if not self.get(name):
            raise ConfigError(f"no property {name}", "property_missing")
        return replace(self, properties=tuple(p for p in self.properties if p.name != name))

    def with_settings(self, **changes: int) -> TableSpec:
        return replace(self, settings={**self.settings, **changes})

    def events_schema(self) -> T.StructType:
        return T.StructType([T.StructField("id", self.id_spark_type), T.StructField("stamp", T.LongType()), T.StructField("event", T.StringType()), *[T.StructField(p.name, p.spark_type) for p in self.event_properties]])

    def customers_schema(self) -> T.StructType:
        return T.StructType([T.StructField("id", self.id_spark_type), *[T.StructField(p.name, p.spark_type) for p in self.customer_properties]])

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, name: str, body: str | dict) -> TableSpec:
        d = json.loads(body) if isinstance(body, str) else body
        keys = {"name", "type", "is_set", "is_customer"}
        return cls(name, d.get("id_type", "textual"), tuple(Property(**{k: v for k, v in p.items() if k in keys}) for p in d.get("properties", ())), tuple(d.get("event_order", ())), dict(d.get("settings", {})))


class Catalog:
    """Named specifications; a session's tables are the DataFrames bound to them in engine.Engine."""

    def __init__(self) -> None:
        self._specs: dict[str, TableSpec] = {}

    def create(self, spec: TableSpec) -> TableSpec:
        if spec.name in self._specs:
            raise ConfigError(f"table {spec.name} exists", "table_exists")
        self._specs[spec.name] = spec
        return spec

    def describe(self, name: str) -> TableSpec:
        if name not in self._specs:
            raise ConfigError(f"no table {name}", "table_missing")
        return self._specs[name]

    def alter(self, spec: TableSpec) -> TableSpec:
        self.describe(spec.name)
        self._specs[spec.name] = spec
        return spec

    def drop(self, name: str) -> None:
        self.describe(name)
        del self._specs[name]

    def list(self) -> list[str]:
        return sorted(self._specs)
