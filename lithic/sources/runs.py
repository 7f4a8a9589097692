"""Run directories, manifests and logs: small files of the driver, read and written by the cluster's file system API."""

from __future__ import annotations

import hashlib
import json
import platform
import time
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical
from ..operators.datasets import run_order


def load_run_manifest(path: str) -> dict[str, Any]:
    """A graph of runs (JSON, or YAML where that library is there): {"runs": [{"name", "depends_on"}]}, checked and ordered."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict) or not isinstance(found.get("runs"), list):
        raise ValueError(f"{path}: no list of runs")
    names = [r.get("name") for r in found["runs"]]
    if None in names or len(set(names)) < len(names):
        raise ValueError(f"{path}: runs need names of their own")
    return found | {"order": run_order([(r["name"], r.get("depends_on", [])) for r in found["runs"]])}


def wanted_runs(manifest: dict[str, Any], names: list[str]) -> list[str]:
    """The named runs and all that they need, in order."""
    needs = {r["name"]: r.get("depends_on", []) for r in manifest["runs"]}
    if unknown := sorted(set(names) - set(needs)):
        raise ValueError(f"unknown run: {', '.join(unknown)}")
    found, todo = set(), list(names)
    while todo:
        if (name := todo.pop()) not in found:
            found.add(name)
            todo += needs[name]
    return [n for n in manifest["order"] if n in found]


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, digest) of files, read by the executors; one file is one row, so it must fit a task."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"))


def sha256_file(path: Path) -> str:
    """Digest of a local file, in blocks."""
    h = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return f"sha256:{h.hexdigest()}"


class RunDirectory:
    """One run's folder: manifest, status and artifacts with their checksums. A finished run isn't started again."""

    def __init__(self, path: str):
        self.path = Path(path)

    def create(self, manifest: dict[str, Any], overwrite: bool = False) -> RunDirectory:
        if self.path.exists() and any(self.path.iterdir()) and not overwrite:
            raise FileExistsError(f"{self.path} holds a run")
        self.path.mkdir(parents=True, exist_ok=True)
        self._write("run_manifest.json", manifest | {"environment": environment()})
        self._write("artifacts.json", {})
        return self.status("initialized")

    def _write(self, name: str, value: Any) -> None:
        own = self.path / f".{name}.new"
        own.write_text(json.dumps(value, indent=2, sort_keys=True) + "\n", encoding="utf-8")
        own.rename(self.path / name)  # readers see the old or the new file, never a part

    def read(self, name: str) -> Any:
        return json.loads((self.path / name).read_text(encoding="utf-8"))

    def status(self, state: str, **more: Any) -> RunDirectory:
        self._write("status.json", {"state": state, "at": time.time(), **more})
        return self

    def add_artifact(self, name: str, path: str, kind: str = "file") -> RunDirectory:
        file = self.path / path
        entry = {"path": path, "kind": kind, "bytes": file.stat().st_size, "digest": sha256_file(file)}
        self._write("artifacts.json", self.read("artifacts.json") | {name: entry})
        return self

    def broken_artifacts(self) -> list[str]:
        """Names whose file is gone or has changed."""
        found = self.read("artifacts.json")
        return sorted(n for n, a in found.items() if not (self.path / a["path"]).exists() or sha256_file(self.path / a["path"]) != a["digest"])


def environment() -> dict[str, str]:
    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "system": platform.system()}


def manifest_identity(manifest: dict[str, Any]) -> str:
    """Hash of a dataset's manifest in canonical form, less what differs from place to place."""
    kept = {k: v for k, v in manifest.items() if k not in ("output_dir", "created_at", "host")}
    return "sha256:" + hashlib.sha256(canonical(kept).encode()).hexdigest()


def append_metrics(path: str, step: int, metrics: dict[str, float]) -> None:
    """One line a step; a step at or below the last one is refused, so a restarted run can't write it twice."""
    last = tail(path, 1)
    if last and json.loads(last[0])["step"] >= step:
        raise ValueError(f"step {step} isn't after the last one")
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps({"step": step, **metrics}, sort_keys=True) + "\n")


def tail(path: str, n: int, most_bytes: int = 200_000) -> list[str]:
    """The last n lines of a log, of which no more than the last `most_bytes` are read. No file: no lines."""
    file = Path(path)
    if not file.exists():
        return []
    with file.open("rb") as f:
        f.seek(max(0, file.stat().st_size - most_bytes))
        return f.read().decode("utf-8", "replace").splitlines()[-n:]


def write_shard_progress(path: str, shards: list[dict[str, Any]]) -> None:
    """The progress of all shards, replaced as a whole after each."""
    file = Path(path)
    own = file.with_name(f".{file.name}.new")
    own.write_text(json.dumps({"shards": sorted(shards, key=lambda s: s["shard"]), "done": sum(s.get("status") == "validated" for s in shards)}, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    own.rename(file)
