"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """How turns are marked. Each role has the text before and after its own text, and a loss flag.

    Other roles are written as other[0] role other[1] text other[2], without loss. controls are
    strings that mark something for some reader: they never occur inside an escaped text.
    """

    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n", False), "user": ("<s>[INST] ", " [/INST]", False), "assistant": (" ", " </s>", True)})
    other: tuple[str, str, str] = ("[ROLE]", "[=]", "[/ROLE]")
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[=]", "[/ROLE]", "<|")
    #: state -> role -> next state; a role that has no entry breaks the order of turns
    turns: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    ends: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        """A backslash is doubled; a control string gets backslash, point behind its first character."""
        starts = re.compile(f"(?={'|'.join(re.escape(c) for c in self.controls)}).", re.S)  # overlapping ones too
        return starts.sub(lambda m: m[0] + "\\.", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\([\\.])", lambda m: "\\" if m[1] == "\\" else "", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's text segments in order, each with its loss flag."""
        if role in self.roles:
            before, after, loss = self.roles[role]
            return [(before, False), (self.escape(text), loss), (after, False)]
        a, b, c = self.other
        return [(a + self.escape(role) + b, False), (self.escape(text), False), (c, False)]

    def next(self, formatted: str, at: int = 0) -> tuple[str, str, int]:
        """Role and text of the turn that begins at at, and where it ends, by its marks alone; ValueError if it is not whole."""
        a, b, c = self.other
        if formatted.startswith(a, at):
            middle = formatted.index(b, at + len(a))
            end = formatted.index(c, middle + len(b))
            return self.unescape(formatted[at + len(a) : middle]), self.unescape(formatted[middle + len(b) : end]), end + len(c)
        for role, (before, after, _) in sorted(self.roles.items(), key=lambda r: -len(r[1][0])):
            if formatted.startswith(before, at):
                end = formatted.index(after, at + len(before))
                return role, self.unescape(formatted[at + len(before) : end]), end + len(after)
        raise ValueError("not a formatted turn")

    def parse(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        role, text, end = self.next(formatted)
        if end != len(formatted):
            raise ValueError("more than one formatted turn")
        return role, text


SEGMENT = pa.struct([("text", pa.string()), ("loss", pa.bool_())])
TURN = "conv_id long, n long, role string, valid boolean, last boolean, segments array<struct<text: string, loss: boolean>>"


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a turn: conv_id, n (from 0), role, valid, last, segments (text and loss flag).

    A conversation's output is the concatenation of its turns' segments in the order of n.
    valid: the roles so far follow the template's machine, and at the last turn its state may
    end; turns out of order are formatted like others. conversations needs conv_id, turn, role,
    text; other columns are ignored. Turns go by (turn, role, text), nulls first; a null text or
    role is an empty one; rows with a null conv_id form one conversation. Repeated rows are
    turns of their own.

    Texts of any length are whole turns; an empty table gives no rows. The rows of a conversation
    stream through one task in order, one Arrow batch at a time: a long conversation costs time there, not memory. Partitions come out sorted by conv_id, n.
    """
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the latest turn: its row waits for whether another follows
        state, n, ok = "start", 0, True
        out: list[list] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(SEGMENT)]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n", "role", "valid", "last", "segments"])
            out.clear()
            return batch

        def done(row: list, last: bool) -> None:
            row[3], row[4] = row[3] and (not last or state in t.ends), last
            out.append(row)

        for batch in batches:
            for conv, role, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if held is not None:
                    done(held, held[0] != conv)
                if held is None or held[0] != conv:
                    state, n, ok = "start", 0, True
                follows = t.turns.get(state, {}).get(role)
                ok = ok and follows is not None
                state = follows or role
                held = [conv, n, role, ok, False, [{"text": x, "loss": y} for x, y in t.segments(role, text)]]
                n += 1
            if out:
                yield flush()
        if held is not None:
            done(held, True)
            yield flush()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "turn")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(run, TURN)


def digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Read formatted() output back: one row a conversation, hashes of what the output says.

    Turns are found by the template's marks in the conversation's text as it streams by, whatever
    rows it came in; only a turn that has not ended yet is held.
    """
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, held = None, [], ""

        def start(conv) -> dict:
            return {"conv_id": conv, "n_turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0, "valid": True}

        def end(x: dict) -> dict:
            if held:
                raise RuntimeError("a conversation's last turn does not end")
            return x | {"turns_sha256": x["all"].hexdigest(), "loss_sha256": x["loss"].hexdigest()}

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        for batch in batches:
            for conv, n, valid, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if n == 0:
                    if now:
                        rows.append(end(now))
                    now = start(conv)
                whole = "".join(s["text"] for s in segments)
                now["formatted_chars"] += len(whole)
                held, at = held + whole, 0
                while at < len(held):
                    try:
                        role, text, at = t.next(held, at)
                    except ValueError:
                        break
                    now["n_turns"] += 1
                    now["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                held = held[at:]
                now["valid"] = valid
                for s in segments:
                    if s["loss"]:
                        plain = t.unescape(s["text"])
                        now["loss_chars"] += len(plain)
                        now["loss"].update(plain.encode("utf-8", "surrogatepass"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in zip(names, kinds, strict=True)], names)
                rows = []
        if now:
            rows.append(end(now))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in zip(names, kinds, strict=True)], names)

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return digests(formatted(rows.union(extra)))


_PLAIN = r"replace(coalesce(text, ''), '\', '\\')"
_ESCAPED_CHARS = f"(length({_PLAIN}) + 2 * len(regexp_extract_all({_PLAIN}, '<<SYS>>|<</SYS>>|\\[/ROLE\\]|\\[/INST\\]|\\[ROLE\\]|\\[INST\\]|</s>|\\[=\\]|<s>|<\\|')))"
OP4_SQL = f"""
with rows as (
  select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, {_ESCAPED_CHARS} as chars,
    lag(role) over (partition by conv_id order by turn, role, text) as before,
    lead(1) over (partition by conv_id order by turn, role, text) is null as last
  from rows),
v as (
  select *, case role when 'system' then before is null when 'user' then before is null or before in ('system', 'assistant')
    when 'assistant' then before is not distinct from 'user' else false end
    and (not last or role = 'assistant') as fits
  from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars + case role when 'system' then 18 when 'user' then 18 when 'assistant' then 6 else 16 + length(role) end) as bigint) as formatted_chars,
  bool_and(fits) as valid
from v group by conv_id
"""
