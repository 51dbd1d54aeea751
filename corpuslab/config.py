"""Registries (datasets, models, experiments, rewards) as plain mappings read on the driver, and provenance of results."""

from __future__ import annotations

import datetime
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators.reward import Weights
from corpuslab.schema import CorpusError


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, through Spark's file systems."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return rows[0]["value"] if rows else ""


def parse(text: str) -> dict[str, Any]:
    """JSON, or YAML if its library is there."""
    try:
        value = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise CorpusError("reading YAML needs PyYAML") from e
        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise CorpusError("a registry is a mapping")
    return value


def section(registry: Mapping[str, Any], name: str) -> dict[str, Any]:
    value = registry.get(name)
    if not isinstance(value, Mapping) or not value:
        raise CorpusError(f"the registry has no section {name}")
    return dict(value)


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with over's values; mappings on both sides are merged, other values replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), Mapping) and isinstance(v, Mapping) else v
    return out


def entry(registry: Mapping[str, Any], kind: str, key: str) -> dict[str, Any]:
    """An entry of a section, on top of the registry's defaults."""
    entries = section(registry, kind)
    if key not in entries:
        raise CorpusError(f"{kind} has no {key}; there are {sorted(entries)}")
    return merged(registry.get("defaults", {}), entries[key]) | {"key": key}


def reward_weights(registry: Mapping[str, Any], name: str) -> Weights:
    """An ablation's weights, which must be a convex combination."""
    weights = entry(registry, "ablations", name).get("weights", {})
    unknown = set(weights) - set(Weights.__dataclass_fields__)
    if unknown:
        raise CorpusError(f"unknown weights {sorted(unknown)}")
    return Weights(**{k: float(v) for k, v in weights.items()}).validate()


def sidecar(spark: SparkSession, path: str) -> dict[str, Any]:
    """The metadata beside a result; what is wrong with it is recorded, not raised."""
    try:
        return parse(read_text(spark, path))
    except Exception as e:  # noqa: BLE001  a missing or broken sidecar must not stop an analysis
        return {"error": f"{type(e).__name__}: {e}".splitlines()[0][:300]}


def provenance(predictions: DataFrame, order: str, columns: tuple[str, ...] = ("model_key", "model_id", "experiment_key", "experiment_family", "experiment_track"), most: int = 20) -> dict[str, Any]:
    """Rows, and for each column of provenance that is there its distinct values by first appearance (20 at most)."""
    out: dict[str, Any] = {"rows": predictions.count(), "analysed_at": datetime.datetime.now(datetime.UTC).isoformat()}
    for c in columns:
        if c in predictions.columns:
            seen = predictions.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min(order).alias("_o")).orderBy("_o").limit(most).collect()
            out[c] = [r[c] for r in seen]
    return out
