"""Fingerprints of frames and parameters, and manifests of analyses and benchmarks."""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json
import math
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.errors import ConfigurationError
from gapwise.functions import nullity

VERSION = "0.1.0"


def canonical(value: object) -> object:
    """A JSON value in which every type keeps its name, so that unlike values never look alike."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, int):
        return {"int": str(value)}
    if isinstance(value, float):
        return {"float": "nan" if math.isnan(value) else repr(value)}
    if isinstance(value, Decimal):
        return {"decimal": str(value.normalize())}
    if isinstance(value, (dt.datetime, dt.date, dt.time)):
        return {type(value).__name__: value.isoformat()}
    if isinstance(value, dt.timedelta):
        return {"timedelta": str(value // dt.timedelta(microseconds=1))}
    if isinstance(value, (bytes, bytearray)):
        return {"bytes": bytes(value).hex()}
    if isinstance(value, Mapping):
        return {"map": sorted(([canonical(k), canonical(v)] for k, v in value.items()), key=json.dumps)}
    if isinstance(value, (set, frozenset)):
        return {"set": sorted((canonical(v) for v in value), key=json.dumps)}
    if isinstance(value, (list, tuple)):
        return {type(value).__name__: [canonical(v) for v in value]}
    raise ConfigurationError("parameters", type(value).__name__, "can't be told in JSON")


def stable_json(value: object) -> str:
    return json.dumps(canonical(value), sort_keys=True, separators=(",", ":"), allow_nan=False)


def row_fingerprints(df: DataFrame, row_id: str) -> DataFrame:
    """row, sha256 of the row's values as text, in column order."""
    texts = [F.coalesce(nullity.column(c).cast("string"), F.lit("\x00")) for c in df.columns]
    return df.select(nullity.column(row_id).alias("row"), F.sha2(F.concat_ws("\x1f", *texts), 256).alias("sha256"))


def dataframe_fingerprint(df: DataFrame, *, operation: str | None = None, parameters: Mapping[str, object] | None = None) -> str:
    """SHA-256 over the schema, the operation, its parameters and all rows, whatever their order.

    Rows are hashed apart and summed by two independent 64-bit hashes in one partial aggregate, so no row order
    and no single task is needed; repeated rows count.
    """
    text = F.to_json(F.struct(*[nullity.column(c) for c in df.columns]), {"ignoreNullFields": "false"})
    digest = F.sha2(text, 256)
    part = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count(F.lit(1)), *[F.sum(part(at)) for at in (1, 13, 25, 37, 49)]).first()
    body = stable_json({"schema": df.schema.json(), "rows": [str(x) for x in sums], "operation": operation, "parameters": dict(parameters or {})})
    return hashlib.sha256(body.encode()).hexdigest()


def analysis_provenance(df: DataFrame, operation: str, parameters: Mapping[str, object] | None = None) -> dict[str, object]:
    """What was done to which data, with the hashes of both."""
    if not operation:
        raise ConfigurationError("operation", operation, "must be a name")
    return {
        "schema_version": 1,
        "package": "gapwise",
        "version": VERSION,
        "operation": operation,
        "parameters": dict(parameters or {}),
        "input_sha256": dataframe_fingerprint(df),
        "analysis_sha256": dataframe_fingerprint(df, operation=operation, parameters=parameters),
    }


@dataclass(frozen=True)
class BenchmarkManifest:
    """Evidence of a benchmark: what ran where on which data, with its results and tolerances."""

    name: str
    operation: str
    dataset: str
    dataset_sha256: str
    rows: int
    columns: int
    seed: int
    engine: str
    engine_version: str
    python_version: str
    platform: str
    cores: int
    created: str
    parameters: Mapping[str, object]
    metrics: Mapping[str, float]
    tolerances: Mapping[str, float]
    schema_version: int = 2

    def __post_init__(self):
        for f in ("name", "operation", "dataset", "engine", "engine_version", "python_version", "platform", "created"):
            if not isinstance(getattr(self, f), str) or not getattr(self, f).strip():
                raise ConfigurationError(f, getattr(self, f), "must be a text")
        if len(self.dataset_sha256) != 64 or set(self.dataset_sha256) - set("0123456789abcdef"):
            raise ConfigurationError("dataset_sha256", self.dataset_sha256, "must be 64 hex digits")
        for f in ("metrics", "tolerances"):
            if any(isinstance(v, bool) or not math.isfinite(v) for v in getattr(self, f).values()):
                raise ConfigurationError(f, getattr(self, f), "must map to finite numbers")
        if self.rows < 0 or self.columns < 0 or self.cores < 1:
            raise ConfigurationError("rows", self.rows, "counts can't be negative")

    def to_dict(self) -> dict[str, object]:
        return dataclasses.asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":"), allow_nan=False)

    def sha256(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    @classmethod
    def from_dict(cls, payload: Mapping[str, object]) -> BenchmarkManifest:
        names = {f.name for f in dataclasses.fields(cls)}
        if set(payload) != names:
            raise ConfigurationError("payload", sorted(set(payload) ^ names), "must have exactly the manifest's keys")
        return cls(**payload)
