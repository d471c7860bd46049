"""A commit log in a folder that outlives the driver: one small file a version, the newest counts.

What a version names was written before it, under paths of its own; a file gets its name
by one rename, so a version is there whole or not at all.  Tables that no version names
are leftovers of a driver that was lost between the two.  One driver writes a log.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import SparkSession


class Log:
    def __init__(self, spark: SparkSession, folder: str, keep: int = 8):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._at("log")
        if not fs.exists(path):
            return []
        return sorted(int(m[1]) for s in fs.listStatus(path) if (m := re.fullmatch(r"(\d{12})\.json", s.getPath().getName())))

    def latest(self) -> dict[str, Any] | None:
        found = self.versions()
        if not found:
            return None
        _, path = self._at(f"log/{found[-1]:012d}.json")
        return json.loads("".join(r[0] for r in self.spark.read.text(path.toString(), wholetext=True).collect()))

    def commit(self, state: dict[str, Any]) -> None:
        """``state["version"]`` must be the next one."""
        version = state["version"]
        fs, path = self._at(f"log/{version:012d}.json")
        if fs.exists(path):
            raise RuntimeError(f"version {version} of {self.folder} is there already: another driver writes it")
        _, draft = self._at(f"log/.{version:012d}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        if not fs.rename(draft, path):
            raise RuntimeError(f"version {version} of {self.folder} couldn't be written")
        for old in self.versions()[: -self.keep]:
            fs.delete(self._at(f"log/{old:012d}.json")[1], False)

    def drop(self, names: list[str]) -> None:
        """Delete tables, by their names in the folder."""
        for name in names:
            fs, path = self._at(name)
            fs.delete(path, True)

    def tables(self) -> list[str]:
        fs, path = self._at("tables")
        return [f"tables/{s.getPath().getName()}" for s in fs.listStatus(path)] if fs.exists(path) else []
