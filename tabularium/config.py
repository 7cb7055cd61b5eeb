"""Settings of a run."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ProfileConfig:
    """Thresholds of the profile (fixed values)."""

    max_classes: int = 20
    max_low_cardinality: int = 20
    high_cardinality: int = 50
    text_unique_ratio: float = 0.5
    id_unique_ratio: float = 0.9
    high_missing: float = 0.3
    strong_correlation: float = 0.97
    rare_level: float = 0.01
    examples: int = 5
    imbalance: float = 5.0
    strict_ids: bool = False


@dataclass(frozen=True)
class Settings:
    """Places and providers, from the environment."""

    output_dir: str = field(default_factory=lambda: os.environ.get("TABULARIUM_OUTPUT", "out"))
    data_dir: str = field(default_factory=lambda: os.environ.get("TABULARIUM_DATA", "data"))
    llm_provider: str = field(default_factory=lambda: os.environ.get("TABULARIUM_LLM", "stub"))
    seed: int = 42


@dataclass(frozen=True)
class Layout:
    """Where a project's files go: <output>/<project>/<module>/..."""

    project: str
    root: str = "out"

    def log(self, spark, module: str, event: dict) -> str:
        """Append an event to the module's log (a row of time and JSON a call)."""
        import json
        import time

        from .sources.writers import append_history

        row = (time.time(), json.dumps(event, default=str))
        return append_history(spark.createDataFrame([row], "time double, event string").coalesce(1), self.path(module, "log"))

    def events(self, spark, module: str):
        """(time, event) of the module's log, oldest first."""
        return spark.read.schema("time double, event string").parquet(self.path(module, "log")).orderBy("time")

    def save_metadata(self, spark, module: str, facts: dict) -> str:
        """The module's metadata as JSON: what every run tells, and ``facts``."""
        import json
        import time

        path, now = self.path(module, "metadata"), time.time()
        common = {"project": self.project, "module": module, "root": self.root, "created_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now)), "time": now}
        spark.createDataFrame([(json.dumps(common | facts, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        self.log(spark, module, {"saved": path})
        return path

    def metadata(self, spark, module: str) -> dict:
        import json

        return json.loads(spark.read.text(self.path(module, "metadata")).first()[0])

    def path(self, module: str, *names: str) -> str:
        return "/".join([self.root.rstrip("/"), self.project, module, *names])

    def paths(self, module: str) -> dict[str, str]:
        return {"folder": self.path(module), "log": self.path(module, "log"), "metadata": self.path(module, "metadata")}

    @classmethod
    def of(cls, folder: str) -> tuple[Layout, str]:
        """The layout that a module's folder belongs to, and the module."""
        root, project, module = folder.rstrip("/").rsplit("/", 2)
        return cls(project, root), module
