"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_by, listed, release, scratch_path, small_batches, table

NO_ID = -(2**63)  # stands for a null doc_id in the files
SAFE = re.compile(r"(?<=\S) (?=\S)")
# More cuts, as a space and a mark that no space is meant: between a letter or digit and a stop, and
# around a lone line end. The public pattern has a boundary there whatever stands around it.
LETTER, STOP = r"0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}", ".,;:!?"
CUTS = ((rf"([{LETTER}])([{STOP}])", "\\1 \0\\2"), (rf"([{LETTER}{STOP}])\n([{LETTER}])", "\\1 \0\n \0\\2"))
TOGETHER = 64  # pieces that the library gets as one text
AT_ONCE = 4096  # pieces whose encodings, some kB a text, are held at a time
SLICE = 2_500_000  # bytes of text whose words are looked up together
LONG = 8_000_000  # characters; longer texts are encoded in parts
# Characters that are, or may be, white space to some pattern language.
WHITE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}"


@dataclass(frozen=True)
class Facts:
    """What the driver reads off a tokenizers file once, so that workers need not."""

    cuts: bool  # texts may be cut before single spaces
    size: int
    opens: bytes  # a bit for each id: its token starts with the byte-level sign of a space
    odd: str  # pattern of texts in which not every space may be a cut

    @classmethod
    def of(cls, path: str) -> Facts:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, added = told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
        cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True) and not told.get("normalizer") and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] for a in added)
        size = lib.get_vocab_size(with_added_tokens=True)
        opens = np.zeros(size, np.bool_)
        opens[[i for x, i in lib.get_vocab().items() if x.startswith("\u0120")]] = True
        odd = "|".join([rf"\x00|[{WHITE}] (?:[{WHITE}]|\z)", *(re.sub(r"([^\w\s])", r"\\\1", a["content"]) for a in added)])
        return cls(bool(cuts), size, np.packbits(opens).tobytes(), odd)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _strings(pieces: pa.Array) -> list[str]:
    """pieces (one at least, without spaces) as Python strings, some ten times faster than one by one."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
    return compute.binary_join(whole, " ")[0].as_py().split(" ")


class Encoder:
    """Whole texts to token ids with a tokenizers file.

    Where its pre-tokenizer is the public byte-level pattern, a token never spans a space whose
    neighbour on either side is not white space, so a text is the sequence of its pieces cut
    before such spaces. Pieces are found and numbered in Arrow; the library encodes each new one
    once, and the ids of all texts are one gather. Texts with a space inside other white space or
    with an added token take only the cuts between two other characters. Other files get whole texts.
    """

    def __init__(self, path: str, facts: Facts | None = None, hold: int = 4_000_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        facts, self.hold = facts or Facts.of(path), hold  # ids of known pieces, some 50 MB a million
        self.cuts, self.size, self.odd = facts.cuts, facts.size, facts.odd
        self.opens = np.unpackbits(np.frombuffer(facts.opens, np.uint8)).astype(np.bool_)
        self.clear()

    def clear(self) -> None:
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.start, self.length, self.hits = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def trim(self, least: int = 3) -> None:
        """Forget the pieces that came less than least times since the last trim."""
        old, start, length, flat, hits = self.known, self.start, self.length, self.flat, self.hits
        self.clear()
        for k in (0, 1):
            kept = [(p, i) for p, i in old[k].items() if hits[i] >= least]
            if kept:
                at = np.array([i for _, i in kept])
                n = length[at]
                self._keep(k, [p for p, _ in kept], flat[_ranges(start[at], n)], n)

    def _keep(self, k: int, pieces: list[str], flat: np.ndarray, length: np.ndarray) -> None:
        n = len(self.known[0]) + len(self.known[1])
        while n + len(pieces) > len(self.start):
            self.start, self.length, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.hits))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(pieces)] = self.used + np.cumsum(length) - length
        self.length[n : n + len(pieces)] = length
        self.used += len(flat)
        self.known[k].update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _learn(self, k: int, pieces: list[str]) -> None:
        """Encode new pieces; k: 1 if a space goes before each.

        Pieces that start and end with other than white space are joined by their spaces and
        encoded together; their first tokens are those that start with the space's sign.
        """
        apart = [p for p in pieces if not k or not p or p[0] == "\0" or p[0].isspace() or p[-1].isspace() or " " in p]
        if len(apart) < len(pieces):
            other = set(apart)
            plain = [p for p in pieces if p not in other] if other else pieces
            for j in range(0, len(plain), AT_ONCE):
                some = plain[j : j + AT_ONCE]
                found = self.lib.encode_batch_fast([" " + " ".join(some[i : i + TOGETHER]) for i in range(0, len(some), TOGETHER)], add_special_tokens=False)
                flat = np.array([i for e in found for i in e.ids], np.uint32)
                first = np.flatnonzero(self.opens[flat])
                if len(first) != len(some):
                    raise RuntimeError("tokens and pieces do not match")
                self._keep(k, some, flat, np.diff(np.append(first, len(flat))))
        if apart:
            ids = [e.ids for e in self.lib.encode_batch_fast([p[1:] if k and p[:1] == "\0" else " " * k + p for p in apart], add_special_tokens=False)]
            self._keep(k, apart, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    def _numbers(self, k: int, pieces: list[str]) -> np.ndarray:
        """The places of pieces, new ones encoded."""
        known = self.known[k]
        at = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            missing = [pieces[i] for i in new]
            self._learn(k, list(dict.fromkeys(missing)))
            at[new] = list(map(known.__getitem__, missing))
        return at

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after another, and how many each has."""
        texts = texts.fill_null("")
        none = np.zeros(0, np.uint32)
        if not self.cuts:
            ids = [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([none, *ids]), np.array([len(x) for x in ids], np.int64)
        if not len(texts):
            return none, np.zeros(0, np.int64)
        if self.used > self.hold:
            self.trim()
        odd = compute.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        some = bool(odd.any())
        even = texts.filter(pa.array(~odd)) if some else texts
        for pattern, cut in CUTS:
            even = compute.replace_substring_regex(even, pattern, cut)
        split = compute.split_pattern(even, " ")
        pieces, n = split.flatten(), np.diff(split.offsets.to_numpy()).astype(np.int64)
        heads = np.cumsum(n) - n
        rest = np.ones(len(pieces), np.bool_)
        rest[heads] = False
        at = np.empty(len(pieces), np.int64)
        at[heads] = self._numbers(0, pieces.take(pa.array(heads)).to_pylist())
        coded = pieces.filter(pa.array(rest)).dictionary_encode()
        if len(coded):
            at[rest] = self._numbers(1, _strings(coded.dictionary))[coded.indices.to_numpy()]
        if some:  # their pieces come behind, then all go back to the order of the texts
            cut = [[t] if "\0" in t else SAFE.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            at = np.concatenate([at, *[self._numbers(k, x) for head, *tail in cut for k, x in ((0, [head]), (1, tail))]])
            n = np.concatenate([n, [len(x) for x in cut]])
            place = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
            at, n = at[_ranges((np.cumsum(n) - n)[place], n[place])], n[place]
        count = np.bincount(at)
        self.hits[: len(count)] += count
        length = self.length[at]
        return self.flat[_ranges(self.start[at], length)], np.add.reduceat(length, np.cumsum(n) - n)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, n = self.encoded(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(n)[:-1]) if len(n) else []


def _encoder(path: str, facts: Facts) -> Encoder:
    held = kept_by("token_files")  # later tasks know the frequent pieces
    if path not in held:
        held[path] = Encoder(path, facts)
    return held[path]


def _cut_long(text: str) -> list[str]:
    """A long text in parts of about LONG characters, each but the first from a space between two other characters on."""
    at = [0]
    while m := SAFE.search(text, at[-1] + LONG):
        at.append(m.start())
    return [text[i:j] for i, j in zip(at, [*at[1:], len(text)], strict=True)]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with some SLICE bytes of text, one row at least."""
    size = np.cumsum(compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE, "right")))
        yield i, j
        i = j


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(fs: pafs.FileSystem, path: str, writer) -> None:
    """Write beside the target, then rename: a task that is run again leaves whole files only."""
    task = TaskContext.get()
    own = f"{path}.{task.taskAttemptId() if task else 0}"
    with fs.open_output_stream(own) as out:
        writer(out)
    try:
        fs.move(own, path)  # a local store replaces the target
    except OSError:
        fs.delete_file(path)
        fs.move(own, path)


def _mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    if not fs.get_file_info(path).size:
        return np.zeros(0, kind)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows next to each other in a batch become one with their number."""
    from pyarrow import compute

    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        equal = np.ones(m - 1, np.bool_)
        for c in batch.columns:
            a, b = c.slice(1), c.slice(0, m - 1)
            same = compute.fill_null(compute.equal(a, b), False).to_numpy(zero_copy_only=False)
            equal &= same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
        new = np.concatenate([[True], ~equal])
        first = np.flatnonzero(new)
        kept = batch.take(pa.array(first))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(np.diff(np.append(first, m)))], ["doc_id", "text", "n"])


def write_tokens(docs: DataFrame, uri: str, *, tokenizer: str, end_id: int = 0, parts: int | None = None, runs: bool = False) -> dict:
    """Encode every whole text (null: empty), append end_id, and write in ascending doc_id order.

    docs needs doc_id (integer) and text; other columns are ignored. The folder uri, which all
    executors share, gets
    - tokens-NNNNN.bin: ids as little-endian uint16, or uint32 if the vocabulary needs it,
    - docs-NNNNN.bin: int64 doc_ids; lengths-NNNNN.bin: uint64 ids per document,
    - offsets-NNNNN.bin: uint64 global start of each document and the part's end,
    - index.json: dtype, parts, and for each part its documents, ids and base.
    Parts follow each other in doc_id order; equal doc_ids are ordered by a hash of the text, a
    null doc_id comes first. Bases are prefix sums of the parts' sizes (one row a part reaches
    the driver). runs: rows that repeat stand next to each other in the input (as a mixture's epochs
    do); each run of equal rows is shuffled and encoded once and written as often as it occurs.
    Long texts are encoded in parts whose ids are those of the whole. An empty table gives an
    index without ids. Returns the index.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    facts = Facts.of(tokenizer)
    kind = "<u2" if facts.size <= 1 << 16 else "<u4"
    fs, root = _store(uri)
    fs.create_dir(root, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(uri)
        part, code = TaskContext.get().partitionId(), _encoder(tokenizer, facts)
        ids, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def long_text(text: str, again: int, out) -> int:
            """In parts, as often as the row occurs."""
            for _ in range(again):
                n = 1
                for x in _cut_long(text):
                    found, _ = code.encoded(pa.array([x]))
                    out.write(found.astype(kind).tobytes())
                    n += len(found)
                out.write(np.array([end_id], kind).tobytes())
            return n

        def tokens(out) -> None:
            for batch in batches:
                times, texts = batch.column(2).to_numpy(), batch.column(1)
                ids.append(np.repeat(batch.column(0).fill_null(NO_ID).to_numpy(), times))
                for i, j in _slices(texts):
                    own = texts.slice(i, j - i)
                    if j == i + 1 and len(text := own[0].as_py() or "") > LONG:
                        n = np.array([long_text(text, int(times[i]), out)])
                    else:
                        found, n = code.encoded(own)
                        n = n + 1
                        end = np.cumsum(n) - 1
                        flat = np.empty(len(found) + len(n), kind)
                        inner = np.ones(len(flat), np.bool_)
                        inner[end] = False
                        flat[inner], flat[end] = found, end_id
                        if (times[i:j] > 1).any():
                            flat = flat[_ranges(np.repeat(end + 1 - n, times[i:j]), np.repeat(n, times[i:j]))]
                        out.write(flat)
                    lengths.append(np.repeat(n, times[i:j]))

        name = f"{root}/%s-{part:05d}.bin"
        _put(fs, name % "tokens", tokens)
        release()
        ids, lengths = np.concatenate(ids), np.concatenate(lengths)
        _put(fs, name % "docs", lambda out: out.write(ids.astype("<i8").tobytes()))
        _put(fs, name % "lengths", lambda out: out.write(lengths.astype("<u8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())], ["part", "docs", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    rows = rows.mapInArrow(_runs, "doc_id long, text string, n long") if runs else rows.withColumn("n", F.lit(1).cast("long"))
    # equal rows may lie in any order: the place in the input lets them lie in several parts
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), tie, "at").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie).drop("at")
    made = sorted(dealt.mapInArrow(encode, "part int, docs long, ids long").collect())
    base = [0, *accumulate(r["ids"] for r in made)]
    index = {"dtype": kind, "end_id": end_id, "parts": [{"part": r["part"], "docs": r["docs"], "ids": r["ids"], "base": b} for r, b in zip(made, base, strict=False)]}

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(uri)
        for batch in batches:
            for r in batch.to_pylist():
                length = _mapped(fs, f"{root}/lengths-{r['part']:05d}.bin", "<u8")
                at = np.concatenate([[0], np.cumsum(length, dtype=np.uint64)]).astype(np.uint64) + np.uint64(r["base"])
                _put(fs, f"{root}/offsets-{r['part']:05d}.bin", lambda out, at=at: out.write(at.astype("<u8").tobytes()))
            yield batch

    if made:
        bases = listed(spark, {"part": pa.array([r["part"] for r in made], pa.int32()), "base": pa.array(base[:-1], pa.int64())})
        bases.repartition(min(len(made), parts)).mapInArrow(offsets, "part int, base long").count()
    with fs.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, part: from the mapped files, one row a document."""
    fs, root = _store(uri)
    with fs.open_input_stream(f"{root}/index.json") as f:
        index = json.loads(f.read())
    kind = index["dtype"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(uri)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                name = f"{root}/%s-{part:05d}.bin"
                ids, docs, at = _mapped(fs, name % "tokens", kind), _mapped(fs, name % "docs", "<i8"), _mapped(fs, name % "offsets", "<u8")
                own = (at - at[0]).astype(np.int64)
                for i in range(0, len(docs), 10_000):
                    n = min(len(docs), i + 10_000)
                    crc = [zlib.crc32(ids[own[j] : own[j + 1]].astype("<u4").tobytes()) for j in range(i, n)]
                    doc = pa.array(np.asarray(docs[i:n]), pa.int64(), mask=np.asarray(docs[i:n]) == NO_ID)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(at[i:n].astype(np.int64)), pa.array(np.diff(own[i : n + 1])), pa.array(crc, pa.int64()), pa.array([part] * (n - i), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "part"])

    parts = listed(spark, {"part": pa.array([p["part"] for p in index["parts"]], pa.int32())})
    return parts.repartition(max(1, len(index["parts"]))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), uri, tokenizer=default_tokenizer())
    return read_tokens(spark, uri)
