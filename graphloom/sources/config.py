"""Settings from files, looked up by dotted paths."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _parsed(text: str) -> dict:
    try:
        import yaml
    except ModuleNotFoundError:  # JSON is read without it
        return json.loads(text) or {}
    return yaml.safe_load(text) or {}


class Config:
    """Named files of settings (YAML, or JSON), read through Spark; one that is missing or malformed is empty."""

    def __init__(self, spark: SparkSession, files: dict[str, str]):
        self.spark, self.files = spark, files
        self.reload()

    def reload(self) -> None:
        self.held = {name: self._read(path) for name, path in self.files.items()}

    def _read(self, path: str) -> dict:
        try:
            found = _parsed(self.spark.read.text(path, wholetext=True).first()[0])
        except Exception:
            return {}
        return found if isinstance(found, dict) else {}

    def get(self, path: str, default=None):
        """The value at `name.key.key`, or the default where a part of the path is missing."""
        value = self.held
        for part in path.split("."):
            if not isinstance(value, dict) or part not in value:
                return default
            value = value[part]
        return value
