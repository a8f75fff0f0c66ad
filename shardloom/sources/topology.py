"""The topology catalog: shards, their life cycle, and who owns each virtual shard."""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import VSHARDS, modulo_owners
from .registry import Registry

FORMAT = 1
#: state -> states that may follow; a new shard starts as adding, removed is final
STATES = {"adding": ("ready", "removed"), "ready": ("draining",), "draining": ("ready", "removed"), "removed": ()}
ROUTABLE = ("ready", "draining")


@dataclass(frozen=True)
class Shard:
    name: str
    state: str = "ready"
    weight: int = 1
    labels: dict[str, str] = field(default_factory=dict)

    @property
    def id(self) -> str:
        return "shard-" + hashlib.sha256(b"shard\0" + self.name.encode()).hexdigest()[:20]


@dataclass(frozen=True)
class Distribution:
    """Owner names and, for each of the 65,536 slots, the index of its owner (two bytes a slot)."""

    owners: tuple[str, ...]
    slots: array

    @classmethod
    def modulo(cls, names: list[str]) -> Distribution:
        order = tuple(sorted(names))
        at = {n: i for i, n in enumerate(order)}
        return cls(order, array("H", [at[o] for o in modulo_owners(list(order))]))

    @classmethod
    def of_owners(cls, owners: list[str]) -> Distribution:
        """From a list of each slot's owner, as an older catalog keeps it."""
        names = tuple(sorted(set(owners)))
        at = {n: i for i, n in enumerate(names)}
        return cls(names, array("H", [at[o] for o in owners]))

    def owner(self, slot: int) -> str:
        return self.owners[self.slots[slot]]

    def moved(self, slots: list[int], to: str) -> Distribution:
        """The same with some slots given to another owner."""
        owners = self.owners if to in self.owners else (*self.owners, to)
        new = array("H", self.slots)
        for s in slots:
            new[s] = owners.index(to)
        return Distribution(owners, new)

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        """vshard, shard: 65,536 rows whatever the data."""
        import pandas as pd

        rows = pd.DataFrame({"vshard": range(VSHARDS), "shard": [self.owners[i] for i in self.slots]})
        return spark.createDataFrame(rows, "vshard int, shard string")


@dataclass(frozen=True)
class Topology:
    shards: dict[str, Shard]
    distributions: dict[str, Distribution]
    tables: dict[str, str]  # sharded table -> distribution
    schema_fingerprint: str
    revision: int = 1
    updated: float = 0.0

    def distribution(self, table: str) -> Distribution:
        return self.distributions[self.tables[table]]

    def routable(self) -> list[str]:
        return sorted(n for n, s in self.shards.items() if s.state in ROUTABLE)

    def validate(self) -> None:
        if not self.shards or not self.distributions:
            raise ValueError("a topology has shards and a distribution")
        for name, s in self.shards.items():
            if name != s.name or not name or s.state not in STATES or s.weight < 1:
                raise ValueError(f"shard {name!r} is not valid")
            if any(not k or len(k) > 63 or len(v) > 255 for k, v in s.labels.items()):
                raise ValueError(f"shard {name!r} has a label that is not valid")
        for name, d in self.distributions.items():
            if len(d.slots) != VSHARDS:
                raise ValueError(f"distribution {name!r} has {len(d.slots)} slots")
            used = {d.owners[i] if i < len(d.owners) else None for i in set(d.slots)}
            if None in used or len(set(d.owners)) != len(d.owners):
                raise ValueError(f"distribution {name!r} has a slot without an owner")
            if not used <= set(self.routable()):
                raise ValueError(f"distribution {name!r} gives slots to {sorted(used - set(self.routable()))}")
        if missing := set(self.tables.values()) - set(self.distributions):
            raise ValueError(f"no distribution {sorted(missing)}")

    def validate_schema(self, registry: Registry) -> None:
        """The registry and this topology speak of the same tables and keys."""
        if self.schema_fingerprint != registry.fingerprint():
            raise ValueError("the topology is for another schema")
        if set(self.tables) != set(registry.tables):
            raise ValueError(f"tables differ: {sorted(set(self.tables) ^ set(registry.tables))}")

    def validate_transition(self, new: Topology) -> None:
        """new may follow this one."""
        if new.revision != self.revision + 1 or new.updated <= self.updated:
            raise ValueError("revision and time go on by one step")
        for name, s in new.shards.items():
            before = self.shards.get(name)
            if before is None and s.state != "adding":
                raise ValueError(f"new shard {name!r} starts as adding")
            if before and s.state != before.state and s.state not in STATES[before.state]:
                raise ValueError(f"shard {name!r} can't go from {before.state} to {s.state}")
        if gone := [n for n in self.shards if n not in new.shards]:
            raise ValueError(f"shards {gone} vanished; they stay as removed")
        new.validate()

    def with_shard(self, shard: Shard, now: float) -> Topology:
        return replace(self, shards=self.shards | {shard.name: shard}, revision=self.revision + 1, updated=now)

    def placements(self, spark: SparkSession) -> DataFrame:
        """table_name, vshard, shard for every sharded table."""
        out = None
        for table in sorted(self.tables):
            part = self.distribution(table).to_dataframe(spark).select(F.lit(table).alias("table_name"), "vshard", "shard")
            out = part if out is None else out.union(part)
        return out if out is not None else spark.createDataFrame([], "table_name string, vshard int, shard string")

    def to_json(self) -> dict:
        return {
            "format": FORMAT, "revision": self.revision, "updated": self.updated, "schema_fingerprint": self.schema_fingerprint, "tables": self.tables,
            "shards": {n: {"state": s.state, "weight": s.weight, "labels": s.labels} for n, s in self.shards.items()},
            "distributions": {n: {"owners": list(d.owners), "slots": d.slots.tobytes().hex()} for n, d in self.distributions.items()},
        }

    @classmethod
    def from_json(cls, data: dict) -> Topology:
        shards = {n: Shard(n, s["state"], s["weight"], s["labels"]) for n, s in data["shards"].items()}
        distributions = {}
        for n, d in data["distributions"].items():
            slots = array("H")
            slots.frombytes(bytes.fromhex(d["slots"]))
            distributions[n] = Distribution(tuple(d["owners"]), slots)
        return cls(shards, distributions, dict(data["tables"]), data["schema_fingerprint"], data["revision"], data["updated"])


def bootstrap(registry: Registry, shards: list[str], now: float = 0.0, distributions: dict[str, str] | None = None) -> Topology:
    """The first topology: every table by the modulo rule over the named shards.

    distributions: table -> name of its distribution; tables share `default` otherwise.
    """
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards have distinct names")
    tables = {t: (distributions or {}).get(t, "default") for t in registry.tables}
    made = {d: Distribution.modulo(shards) for d in {"default", *tables.values()}}
    out = Topology({n: Shard(n) for n in shards}, made, tables, registry.fingerprint(), 1, now)
    out.validate()
    return out
