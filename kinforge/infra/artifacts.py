"""Append-only registry of results: Parquet or JSON payload, meta written last.

Everything goes through Hadoop's file system API, so a registry may lie in any
store the cluster reads.
"""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession

from kinforge.infra.config import load_config_from_env

TIERS = ("smoke", "target")


class ArtifactMissing(LookupError):
    """No complete run of that name."""


class TierMixingError(LookupError):
    """The newest run is of another tier."""


class ArtifactRegistry:
    """Runs ``<root>/<name>/<stamp>-<tier>``; the newest complete run counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def from_env(cls, spark: SparkSession) -> ArtifactRegistry:
        """The registry in the folder that the runner's environment names."""
        return cls(spark, load_config_from_env().paths.artifacts)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write_text(self, path: str, text: str) -> None:
        out = self._fs(path).create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read_text(self, path: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())  # one small file

    @staticmethod
    def _check(name: str, tier: str) -> None:
        if not re.fullmatch(r"[a-z0-9_.-]+", name):
            raise ValueError(f"bad artifact name {name!r}")
        if tier not in TIERS:
            raise ValueError(f"tier must be one of {TIERS}")

    def register(self, name: str, payload: DataFrame | dict, tier: str, meta: dict | None = None) -> str:
        """Write a payload, then its meta, which makes the run complete."""
        self._check(name, tier)
        run = f"{self.root}/{name}/{time.time_ns():020d}-{tier}"
        if isinstance(payload, DataFrame):
            payload.write.parquet(f"{run}/table.parquet")
        else:
            self._write_text(f"{run}/value.json", json.dumps(payload, sort_keys=True))
        kind = "table" if isinstance(payload, DataFrame) else "value"
        self._write_text(f"{run}/meta.json", json.dumps({"name": name, "tier": tier, "kind": kind, **(meta or {})}, sort_keys=True))
        return run

    def runs(self, name: str) -> list[str]:
        """Complete runs, oldest first."""
        folder = f"{self.root}/{name}"
        fs = self._fs(folder)
        if not fs.exists(self._path(folder)):
            return []
        found = sorted(s.getPath().getName() for s in fs.listStatus(self._path(folder)))
        return [f"{folder}/{r}" for r in found if fs.exists(self._path(f"{folder}/{r}/meta.json"))]

    def newest(self, name: str, tier: str) -> str:
        self._check(name, tier)
        runs = self.runs(name)
        if not runs:
            raise ArtifactMissing(f"{name}: no complete run")
        if not runs[-1].endswith(f"-{tier}"):
            raise TierMixingError(f"{name}: the newest run is {runs[-1].rpartition('-')[2]}, not {tier}")
        return runs[-1]

    def load(self, name: str, tier: str) -> DataFrame | dict:
        run = self.newest(name, tier)
        meta = json.loads(self._read_text(f"{run}/meta.json"))
        return self.spark.read.parquet(f"{run}/table.parquet") if meta["kind"] == "table" else json.loads(self._read_text(f"{run}/value.json"))

    def meta(self, name: str, tier: str) -> dict:
        return json.loads(self._read_text(f"{self.newest(name, tier)}/meta.json"))

    def exists(self, name: str, tier: str) -> bool:
        try:
            self.newest(name, tier)
        except LookupError:
            return False
        return True
