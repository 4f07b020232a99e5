"""Operator 12: chat formatting by columnar byte assembly.

Turns are dealt by ranges of (conversation, turn) and sorted, so a long
conversation is many tasks and its parts stay in order. A batch of turns is
assembled at once: the lengths of all segments (header, content, footer), their
running offsets, and scatter indices in numpy; headers and contents are copied
into one preallocated Arrow buffer, of which the turns, the parts of
conversations and the spans that bear loss are slices.

The template gives each role its marks, which begin or end in white space next to
a text. A mark inside a text gets a backslash behind its first character (one more
where there are some already), so a formatted text holds no mark that is not
the template's, and reading back takes one backslash away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obspark.llm import common

# Marks of the template.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<TURN>>", "<</TURN>>")
HEADERS = {"user": "[INST] ", "assistant": "<s> ", "system": "<<SYS>>\n"}
FOOTERS = {"user": " [/INST]\n", "assistant": " </s>\n", "system": "\n<</SYS>>\n"}
OTHER_HEADER, OTHER_ROLE_END, OTHER_FOOTER = "<<TURN>> ", " <s>\n", "\n<</TURN>>\n"
BEARS = "assistant"

_INNER = "|".join(f"{re.escape(m[1:])}" for m in MARKS)
#: A mark with any backslashes behind its first character; the same pattern for Arrow's regular expressions and Python's.
ESCAPABLE = rf"([<\[])(\\*)({_INNER})"
ESCAPED = re.compile(rf"([<\[])\\(\\*)({_INNER})")
#: Bytes of content whose scatter indices are made at once; longer texts are copied as slices.
STRETCH = 1 << 20
#: Bytes after which a part of a conversation ends.
PART = 1 << 20


def escape(texts: pa.Array) -> pa.Array:
    """Marks inside texts made harmless; only texts that hold some are rewritten."""
    hit = pc.match_substring_regex(texts, ESCAPABLE)
    if not pc.any(hit).as_py():
        return texts
    return pc.if_else(hit, pc.replace_substring_regex(texts, ESCAPABLE, r"\1\\\2\3"), texts)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of an array of large strings without nulls."""
    texts = pa.concat_arrays([texts])  # from offset 0
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at[:-1], np.diff(at)


def scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Copies the segments of ``data`` to the places ``at`` of ``out``: by index arrays for short ones, a stretch of them at a time."""
    ends = np.cumsum(size)
    first = 0
    while first < len(size):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + STRETCH, "right")))
        n, k = size[first:last], np.arange(int(ends[last - 1] - base))
        if last == first + 1:
            out[at[first] : at[first] + n[0]] = data[start[first] : start[first] + n[0]]
        else:
            before = np.cumsum(n) - n
            out[k + np.repeat(at[first:last] - before, n)] = data[k + np.repeat(start[first:last] - before, n)]
        first = last


@dataclass
class Assembled:
    """Formatted turns in one buffer: where each begins (and the last ends), and where its content lies."""

    buffer: pa.Buffer
    turn_at: np.ndarray
    text_at: np.ndarray
    text_size: np.ndarray


def assemble(roles: pa.Array, texts: pa.Array) -> Assembled:
    """Formats a batch of turns: arrays of strings in, one Arrow buffer out. Nulls count as empty."""
    roles, texts = (pc.fill_null(x.cast(pa.large_string()), "") for x in (roles, texts))
    kinds = roles.dictionary_encode()
    names = kinds.dictionary.to_pylist()
    safe = escape(pa.array(names, pa.large_string())).to_pylist()
    heads = [HEADERS.get(n, f"{OTHER_HEADER}{s}{OTHER_ROLE_END}") for n, s in zip(names, safe, strict=True)]
    feet = [FOOTERS.get(n, OTHER_FOOTER) for n in names]
    code = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    marks, mark_at, mark_size = _parts(pa.array(heads + feet, pa.large_string()))
    data, start, size = _parts(escape(texts))
    head, foot = mark_size[code], mark_size[code + len(names)]
    turn_at = np.concatenate([[0], np.cumsum(head + size + foot)])
    buffer = pa.allocate_buffer(int(turn_at[-1]))
    out = np.frombuffer(buffer, np.uint8)
    begin = turn_at[:-1]
    scatter(out, begin, marks, mark_at[code], head)
    scatter(out, begin + head, data, start, size)
    scatter(out, begin + head + size, marks, mark_at[code + len(names)], foot)
    return Assembled(buffer, turn_at, begin + head, size)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text (or of a part of one): the template's marks are the only ones in it."""
    at = 0
    while at < len(text):
        role = next((r for r, h in HEADERS.items() if text.startswith(h, at)), None)
        if role is None:
            begin = at + len(OTHER_HEADER)
            cut = text.index(OTHER_ROLE_END, begin)
            role, begin, foot = unescape(text[begin:cut]), cut + len(OTHER_ROLE_END), OTHER_FOOTER
        else:
            begin, foot = at + len(HEADERS[role]), FOOTERS[role]
        end = text.index(foot, begin)
        yield role, unescape(text[begin:end])
        at = end + len(foot)


@dataclass
class Digest:
    """What is read back of a conversation, part by part."""

    turns: int = 0
    loss_chars: int = 0
    chars: int = 0
    turn_hash: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    loss_hash: "hashlib._Hash" = field(default_factory=hashlib.sha256)

    def add(self, text: str, spans: list[tuple[int, int]]) -> None:
        for role, said in read_turns(text):
            self.turns += 1
            self.turn_hash.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        self.chars += len(text)
        raw = text.encode("utf-8", "surrogatepass")
        for a, b in spans:
            borne = unescape(raw[a:b].decode("utf-8", "surrogatepass"))
            self.loss_chars += len(borne)
            self.loss_hash.update(borne.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


PARTS = "conv_id long, task long, part long, turns long, text string, loss array<struct<start:long,stop:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _chunks(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, str, list[tuple[int, int]]]]:
    """Parts (conv_id, turns, text, loss spans in bytes) of the sorted turns of a task; a part ends with its conversation, a batch, or after PART bytes."""
    for batch in frames:
        done = assemble(batch.column("role"), batch.column("text"))
        ids, roles = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
        view, at = memoryview(done.buffer), 0
        for i in range(1, len(ids) + 1):
            if i < len(ids) and ids[i] == ids[at] and done.turn_at[i] - done.turn_at[at] < PART:
                continue
            zero = int(done.turn_at[at])
            spans = [(int(done.text_at[k]) - zero, int(done.text_at[k] + done.text_size[k]) - zero) for k in range(at, i) if roles[k] == BEARS]
            yield ids[at], i - at, bytes(view[zero : int(done.turn_at[i])]).decode("utf-8", "surrogatepass"), spans
            at = i


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS)
    spans = [[{"start": a, "stop": b} for a, b in s] for s in c[5]]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((*c[:5], spans), kinds, strict=True)], names=[x.split()[0] for x in PARTS.split(", ")[:6]])


def in_order(conversations: DataFrame) -> DataFrame:
    """Turns dealt by ranges of (conv_id, turn) and sorted; rows of one turn number (null first) by role and text."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")


def _in_batches(rows: Iterator[tuple], sizes, batch) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each of a few megabytes of text at most (or one row)."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sizes(r)
        if size > 4 * PART or len(held) >= 5000:
            yield batch(held)
            held, size = [], 0
    yield batch(held)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted conversations as parts in the order (task, part): conv_id, turns, text, and the byte spans of the text that bear loss.

    Parts end with turns, and hold about a megabyte at most unless one turn is
    longer. Null roles and texts count as empty; a null turn comes first, equal
    turn numbers go by role and text, repeated rows are turns of their own. Rows
    without a conv_id are one conversation without an id. Other columns are
    ignored; an empty table gives no rows.
    """

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        rows = ((c, own, k, n, text, spans) for k, (c, n, text, spans) in enumerate(_chunks(frames)))
        yield from _in_batches(rows, lambda r: len(r[4]), _part_batch)

    return in_order(conversations).mapInArrow(task, PARTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
#: Bytes of a conversation that wait until the next one shows that it has ended within its task.
WAITING = 4 * PART


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, _KINDS, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])


def _digested(parts: Iterator[tuple]) -> Iterator[tuple]:
    """Digest rows of parts (conv_id, text, spans) that come conversation by conversation."""
    now, digest = None, None
    for c, text, spans in parts:
        if digest is None or c != now:
            if digest is not None:
                yield (now, *digest.row())
            now, digest = c, Digest()
        digest.add(text, spans)
    if digest is not None:
        yield (now, *digest.row())


def digests(parts: DataFrame) -> DataFrame:
    """What is read back of each conversation from its parts. A conversation's parts go to one task, which reads them one after the other."""

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((c, t, [(x["start"], x["stop"]) for x in spans]) for b in common.sliced(frames, 8) for c, t, spans in zip(*(b.column(k).to_pylist() for k in ("conv_id", "text", "loss")), strict=True))
        yield from _in_batches(_digested(each), lambda _: 0, _digest_batch)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "task", "part").mapInArrow(task, DIGESTS)


def read_back(conversations: DataFrame) -> DataFrame:
    """Formats ``conversations`` (see ``format_conversations``) and reads n_turns, loss and hashes back from what was formatted.

    A conversation that lies within one task is read there. Only those that a
    task begins or ends with, or that are very long, have their formatted parts
    brought together, so the texts are shuffled once.
    """
    names = [x.split()[0] for x in PARTS.split(", ")]

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            held, size, open_, count, now = [], 0, True, 0, None
            for k, (c, n, text, spans) in enumerate(_chunks(frames)):
                if k and c != now:
                    if held:
                        (d,) = _digested((x[0], x[4], x[5]) for x in held)
                        yield None, d
                    held, size, open_, count = [], 0, False, count + 1
                now, size = c, size + len(text)
                held.append((c, own, k, n, text, spans))
                if count == 0 or open_ or size > WAITING:
                    open_ = True
                    yield from ((x, None) for x in held)
                    held = []
            yield from ((x, None) for x in held)

        def batch(both: list[tuple]) -> pa.RecordBatch:
            parts = _part_batch([p or (d[0], None, None, None, None, []) for p, d in both])
            told = _digest_batch([d or (None,) * 6 for _, d in both])
            return pa.RecordBatch.from_arrays([*parts.columns, *told.columns[1:]], names=[*names, *told.schema.names[1:]])

        yield from _in_batches(rows(), lambda r: len(r[0][4]) if r[0] else 0, batch)

    both = common.stash(in_order(conversations).mapInArrow(task, f"{PARTS}, {DIGESTS.partition(', ')[2]}"), "chat")
    told = both.filter("part IS NULL").select(*[x.split()[0] for x in DIGESTS.split(", ")])
    return told.unionByName(digests(both.filter("part IS NOT NULL").select(*names)))


def with_marked(conversations: DataFrame, conv_id: int, text: str) -> DataFrame:
    """``conversations`` and one more of a user's and an assistant's turn that say ``text``."""
    more = conversations.sparkSession.createDataFrame([(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted, and read back from what was formatted."""
    rows = with_marked(spark.read.parquet(f"{sf_dir}/conversations.parquet"), -1, "</s>[INST] ok [/INST]")
    return read_back(rows)
