"""The schema registry: which tables are sharded, by which typed key."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.canonical import type_family

FORMAT = 4


def table_name(name: str) -> str:
    """schema.table; unquoted parts are folded to lower case, quoted ones kept, public by default."""
    parts = re.findall(r'"((?:[^"]|"")*)"|([^."]+)', name)
    names = [q.replace('""', '"') if q or not u else u.strip().lower() for q, u in parts]
    if len(names) not in (1, 2):
        raise ValueError(f"not a table name: {name!r}")
    return ".".join(names if len(names) == 2 else ["public", *names])


@dataclass(frozen=True)
class ShardedTable:
    key: tuple[str, ...]
    types: tuple[str, ...]
    generated: bool = False  # a single integer key that the allocator fills


@dataclass(frozen=True)
class Registry:
    tables: dict[str, ShardedTable] = field(default_factory=dict)
    unsharded: dict[str, str] = field(default_factory=dict)  # table -> primary or replicated
    revision: int = 0

    def with_sharded(self, name: str, key: list[str], types: list[str], generated: bool = False) -> Registry:
        if not key or len(key) != len(types) or len(set(key)) != len(key):
            raise ValueError("a shard key has one or more distinct columns, each with a type")
        families = [type_family(t) for t in types]
        if generated and (len(key) != 1 or families[0] != "integer"):
            raise ValueError("a generated key is one integer column that is the whole shard key")
        new = ShardedTable(tuple(key), tuple(types), generated)
        full = table_name(name)
        return replace(self, tables=self.tables | {full: new}, unsharded={k: v for k, v in self.unsharded.items() if k != full}, revision=self.revision + 1)

    def with_unsharded(self, name: str, policy: str = "primary") -> Registry:
        if policy not in ("primary", "replicated"):
            raise ValueError(f"unknown policy {policy!r}")
        full = table_name(name)
        return replace(self, unsharded=self.unsharded | {full: policy}, tables={k: v for k, v in self.tables.items() if k != full}, revision=self.revision + 1)

    def without(self, name: str) -> Registry:
        full = table_name(name)
        return replace(self, tables={k: v for k, v in self.tables.items() if k != full}, unsharded={k: v for k, v in self.unsharded.items() if k != full}, revision=self.revision + 1)

    def sharded(self, name: str) -> ShardedTable | None:
        return self.tables.get(table_name(name))

    def policy(self, name: str) -> str | None:
        return self.unsharded.get(table_name(name))

    def fingerprint(self) -> str:
        """A token that changes with the tables, their keys and key types only."""
        payload = {"tables": {k: list(t.key) for k, t in sorted(self.tables.items())}, "types": {k: list(t.types) for k, t in sorted(self.tables.items())}}
        return "sha256:" + hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()

    def inventory(self, spark: SparkSession) -> DataFrame:
        rows = [(n, "sharded", list(t.key), list(t.types), t.generated) for n, t in self.tables.items()] + [(n, p, [], [], False) for n, p in self.unsharded.items()]
        return spark.createDataFrame(sorted(rows), "table_name string, policy string, shard_key array<string>, key_types array<string>, generated boolean")

    def to_json(self) -> dict:
        return {"format": FORMAT, "revision": self.revision, "tables": {n: {"key": list(t.key), "types": list(t.types), "generated": t.generated} for n, t in self.tables.items()}, "unsharded": self.unsharded}

    @classmethod
    def from_json(cls, data: dict) -> Registry:
        if data.get("format") != FORMAT:
            raise ValueError(f"registry format {data.get('format')!r}, expected {FORMAT}")
        return cls({n: ShardedTable(tuple(t["key"]), tuple(t["types"]), t["generated"]) for n, t in data["tables"].items()}, dict(data["unsharded"]), data["revision"])
