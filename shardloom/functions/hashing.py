"""Placement: key text -> virtual shard (low 16 bits of FNV-1a) -> owner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import canonical, literal_text

VSHARDS = 65_536
# Fixed values of FNV-1a (64 bits) and their low 16 bits, which alone decide the virtual shard.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
LOW_OFFSET, LOW_PRIME = FNV_OFFSET & 0xFFFF, FNV_PRIME & 0xFFFF


def fnv1a64(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def key_text(columns: list[Column | str], types: list[str]) -> Column:
    """Canonical texts joined by NUL; null if any part is null (null is never a key)."""
    parts = [canonical(c, t) for c, t in zip(columns, types, strict=True)]
    return F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit("\0"), p] if i else [p])])


def _step(h: Column, byte: Column) -> Column:
    """The low bits of a product depend on the low bits of its factors only: 16-bit steps never overflow."""
    return (h.bitwiseXOR(byte) * F.lit(LOW_PRIME)).bitwiseAND(F.lit(0xFFFF))


def _steps(h: Column, text: Column) -> Column:
    """The steps over a text's bytes; where all are ASCII, its characters are its bytes."""
    plain = F.aggregate(F.sequence(F.lit(1), F.length(text)), h, lambda x, i: _step(x, F.ascii(F.substr(text, i, F.lit(1)))))
    code = F.hex(F.encode(text, "UTF-8"))
    byte = F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda i: F.conv(F.substr(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(text == "", h).when(F.octet_length(text) == F.length(text), plain).otherwise(F.aggregate(byte, h, lambda x, b: _step(x, b)))


def vshard(columns: list[Column | str], types: list[str]) -> Column:
    """The virtual shard (0 to 65535) of a row, without a UDF but for float keys; null if a part is null."""
    h, known = F.lit(LOW_OFFSET), F.lit(True)
    for i, (column, kind) in enumerate(zip(columns, types, strict=True)):
        part = canonical(column, kind)
        h = _steps(_step(h, F.lit(0)) if i else h, part)  # NUL between parts
        known = known & part.isNotNull()
    return F.when(known, h.cast("int"))


def literal_vshard(values: list[str], types: list[str | None]) -> int | None:
    """The virtual shard of a key given as literals; null if one is no value of its type."""
    texts = [literal_text(v, t) for v, t in zip(values, types, strict=True)]
    if any(t is None for t in texts):
        return None
    return fnv1a64("\0".join(texts).encode()) % VSHARDS


def modulo_owner(slot: Column, shards: int) -> Column:
    """The 1-based place of the owner among n sorted shards: remainder 0 belongs to the last."""
    r = F.pmod(slot, F.lit(shards))
    return F.when(r == 0, F.lit(shards)).otherwise(r).cast("int")


def modulo_owners(names: list[str], slots: int = VSHARDS) -> list[str]:
    """The owner of every slot under the modulo rule."""
    order = sorted(names)
    return [order[slot % len(order) - 1] for slot in range(slots)] if order else [""] * slots
