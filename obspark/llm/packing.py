"""Operator 4: vector bin packing of tokenised examples into fixed-length sequences.

Examples are placed by the dot-product heuristic: an open sequence and an
example are vectors over three resources (tokens, segments, loss-bearing
tokens); of the examples that fit a sequence, the one whose demand has the
largest dot product with the remaining capacity (each scaled by its limit) goes
in. Whole sequences are cut off long documents first; what is left of each
document is an example. Where no example fits, one is cut to fill the sequence.

A task packs its own documents in blocks of bounded size, so nothing is
shuffled, and a retried task reads the same split and builds the same
sequences. The unfilled sequences of one block are carried to the next; at most
one sequence a task is short in the end, unless the segment limit binds.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obspark.llm import common

LENGTH = 1024
SEGMENTS = 256
BLOCK = 512
SPECIAL = "<|endoftext|>"
#: Fixed value: how byte-level vocabularies of this kind split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them.

    tiktoken merges by the same vocabulary read as ranks and is several times
    faster; the special token's string, which the library takes as one id, sends
    a text to the library itself. Tests hold the two against each other.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        bytes_of = {c: b for b, c in enumerate_bytes().items()}
        ranks = {bytes(bytes_of[c] for c in token): i for token, i in self.library.get_vocab(False).items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if SPECIAL in text:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def enumerate_bytes() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Open:
    """A sequence that is being filled."""

    __slots__ = ("pieces", "room")

    def __init__(self, limits: np.ndarray):
        self.pieces, self.room = [], limits.astype(np.float64)


def place(demand: np.ndarray, limits: np.ndarray, bins: list[Open], cut: bool) -> tuple[list[tuple[int, int, int, Open]], list[Open]]:
    """Dot-product placement of examples under simultaneous limits.

    ``demand`` has a row (tokens, segments, loss tokens) for each example; each
    demand alone must fit. Open ``bins`` are filled first. With ``cut``, an
    example is cut where no other fits, the first part filling the sequence (a
    token of a part's start bears no loss). Returns the placements (example,
    first token in it, tokens, bin) and the bins that still have room.
    """
    left = demand.astype(np.float64).copy()
    bears = left[:, 2] > 0
    begun = np.zeros(len(left), np.int64)
    alive = np.ones(len(left), bool)
    out: list[tuple[int, int, int, Open]] = []
    queue, short = list(bins), []
    while True:
        box = queue.pop() if queue else None
        if box is None:
            if not alive.any():
                break
            box = Open(limits)
        while alive.any():
            fits = alive & (left <= box.room).all(axis=1)
            if fits.any():
                score = np.where(fits, (left / limits) @ (box.room / limits), -1.0)
                i = int(score.argmax())
                n = int(left[i, 0])
                used = left[i].copy()
                alive[i] = False
            else:
                if not cut or box.room[0] < 1 or box.room[1] < 1:
                    break
                # the largest example of those of which the most fits: what bears no loss is held back by tokens alone
                whole = np.where(alive, np.minimum(np.where(bears, np.minimum(box.room[0], box.room[2] + 1), box.room[0]), left[:, 0] - 1), 0)
                i = int((whole * 1e7 + left[:, 0] * alive).argmax())
                n = int(whole[i])
                if n < 1:
                    break
                used = np.array([n, 1, n - 1 if bears[i] else 0], np.float64)
                left[i, 0] -= n
                left[i, 2] = left[i, 0] - 1 if bears[i] else 0
            out.append((i, int(begun[i]), n, box))
            begun[i] += n
            box.room = box.room - used
            if box.room[0] < 1:
                break
        if box.room[0] >= 1 and box.room[1] >= 1:
            short.append(box)
        if not alive.any():
            short += queue
            break
    return out, short


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, end_id: int = 0, bears: str | None = None) -> DataFrame:
    """Packs all rows of ``docs`` (doc_id, text; others are ignored) into sequences of at most ``length`` tokens, ``segments`` pieces and ``loss`` loss-bearing tokens.

    A piece bears loss on every token but its first; with ``bears``, a boolean
    column, only pieces of rows where it is true do (an answer, not a prompt).
    Without ``loss`` that limit is the length and cannot bind.

    One row per piece: doc_id, start (ids of its document before it), length,
    ids_crc32, doc_tokens (with the closing ``end_id``), sequence_id, offset,
    loss_tokens. A null or empty text is the
    closing id alone; equal doc_ids are separate documents; an empty table gives
    no rows.
    """
    limits = np.array([length, segments, length if loss is None else loss], np.float64)
    tail = np.array([end_id], "<u4").tobytes()

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, serial = encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        state: dict[int, list] = {}  # open sequence: id, filled
        bins: list[Open] = []
        waiting: list[tuple[int, int, bytes, int, bool]] = []

        def put(doc, start, ids, total, seq, at, bearing):
            n = len(ids) // 4
            rows.append((doc, start, n, zlib.crc32(ids), total, seq, at, n - 1 if bearing else 0))

        def settle():
            nonlocal bins, serial, waiting
            if not waiting:
                return
            sizes = np.array([len(w[2]) // 4 for w in waiting], np.float64)
            bearing = np.array([w[4] for w in waiting])
            placed, bins = place(np.stack([sizes, np.ones_like(sizes), np.where(bearing, sizes - 1, 0)], 1), limits, bins, True)
            for i, first, n, box in placed:
                if id(box) not in state:
                    state[id(box)] = [serial, 0, box]
                    serial += 1
                known = state[id(box)]
                doc, start, ids, total, bearing_ = waiting[i]
                put(doc, start + first, ids[4 * first : 4 * (first + n)], total, known[0], known[1], bearing_)
                known[1] += n
            live = {id(b) for b in bins}
            for k in [k for k in state if k not in live]:
                del state[k]
            waiting = []

        def flush():
            nonlocal rows
            cols = list(zip(*rows, strict=True)) or [()] * 8
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for ids_, texts, flags in common.batches(frames, "doc_id", "text", "bears"):
            for doc, text, bearing in zip(ids_, texts, flags, strict=True):
                ids = encode(text) + tail
                total = len(ids) // 4
                most = int(min(limits[0], limits[2] + 1) if bearing else limits[0])
                whole = total // most
                for k in range(whole):
                    part = ids[4 * k * most : 4 * (k + 1) * most]
                    if most < limits[0]:
                        waiting.append((doc, k * most, part, total, bearing))
                        continue
                    put(doc, k * most, part, total, serial, 0, bearing)
                    serial += 1
                if total > whole * most:
                    waiting.append((doc, whole * most, ids[4 * whole * most :], total, bearing))
                if len(waiting) >= BLOCK:
                    settle()
            if len(rows) > 5_000:
                yield flush()
        settle()
        yield flush()

    flag = F.coalesce(F.col(bears), F.lit(False)) if bears else F.lit(True)
    return docs.select("doc_id", "text", flag.alias("bears")).mapInArrow(task, SCHEMA)


def pack_turns(conversations: DataFrame, tokenizer_path: str, length: int = LENGTH, segments: int = 8, loss: int = 512) -> DataFrame:
    """Instruction data: packs the turns of ``conversations`` (conv_id, turn, role, text), of which those of the assistant bear loss.

    As ``pack``, with the columns conv_id, turn and bears for doc_id. A null
    role bears none. Repeated rows of a turn are examples of their own, each with
    the loss of its own role; other columns are ignored, and an empty table gives no rows.
    """
    bears = F.coalesce(F.col("role") == "assistant", F.lit(False))
    turns = conversations.select(F.xxhash64("conv_id", "turn", bears).alias("doc_id"), "conv_id", "turn", "text", bears.alias("bears"))
    names = turns.select("doc_id", "conv_id", "turn", "bears").dropDuplicates(["doc_id"])
    return pack(turns, tokenizer_path, length, segments, loss, bears="bears").join(names, "doc_id").drop("doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    import public_tokenizers

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations packed under limits on tokens, pieces and loss-bearing tokens."""
    import public_tokenizers

    return pack_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
