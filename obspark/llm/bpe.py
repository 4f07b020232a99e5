"""Operator 6: byte-pair encoding with a priority queue, and decoding.

A word is a doubly linked list of symbols; a heap holds (merge rank, position)
of adjacent pairs. The lowest rank is merged first, leftmost among equals;
entries whose symbols have changed since are stale and skipped. Decoding
concatenates the vocabulary's strings.

The vocabulary file says how text is normalised and split; each task keeps the
pieces it has encoded, so a word is merged once for every few hundred thousand
distinct words. Rows are independent: no shuffle, and a lost task is redone.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex
from tokenizers.normalizers import Lowercase
from tokenizers.pre_tokenizers import Split

from obspark.llm import common
from obspark.llm.packing import enumerate_bytes

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
KEEP = 400_000
CONTROL = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\p{White_Space}+")


@functools.lru_cache(1)
def recent() -> list[str]:
    """Letters and numbers that the regular expressions know and Python's character data don't."""
    return regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"))


def unlettered(splitter, split: regex.Pattern) -> re.Pattern | None:
    """Characters that the regular expressions take for letters or numbers, and the library's splitter doesn't: it knows another version of Unicode.

    Only characters that Python's data don't know either can differ; the library is asked about each of them, once for a process.
    """
    found = [ord(c) for c in recent() if len(splitter.pre_tokenize_str(f"a{c}b")) != len(split.findall(f"a{c}b")) or len(splitter.pre_tokenize_str(f"1{c}2")) != len(split.findall(f"1{c}2"))]
    starts = [c for i, c in enumerate(found) if not i or found[i - 1] != c - 1]
    ends = [c for i, c in enumerate(found) if i + 1 == len(found) or found[i + 1] != c + 1]
    return re.compile("[" + "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in zip(starts, ends, strict=True)) + "]") if found else None


class Codec:
    """Encoder and decoder of a vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.unknown: str | None = model["unk_token"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: pair of ids -> (rank, id of the merged symbol)
        self.merges = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        splits = [Split(Regex(p["pattern"]["Regex"]), p["behavior"].lower(), p["invert"]) for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.marks = unlettered(splits[0], self.split)
        #: capitals that only the library knows
        self.small = {c: x for c in recent() if (x := Lowercase().normalize_str(c)) != c}
        self.capitals = re.compile("[" + "".join(self.small) + "]") if self.small else None
        self.letters = enumerate_bytes()
        self.kept: dict[str, tuple[str, str, int]] = {}

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece by a heap of merge ranks over a linked list."""
        chars = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        chars[-1] += self.end
        sym = [self.vocab[c] if c in self.vocab else self.vocab[self.unknown] for c in chars]
        n = len(sym)
        if n == 1:
            return sym
        merges = self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, m[1], sym[i], sym[i + 1]) for i in range(n - 1) if (m := merges.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # stale
            sym[i], sym[j] = new, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if m := merges.get((new, sym[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, sym[k]))
            h = left[i]
            if h >= 0 and (m := merges.get((sym[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], sym[h], new))
        return [s for s in sym if s >= 0]

    def pieces(self, text: str) -> list[str]:
        """Pieces of a normalised text; what only the library knows of characters comes in here, so that it is asked once for each word."""
        if text.isascii():
            return self.split.findall(text)
        if self.capitals:
            text = self.capitals.sub(lambda m: self.small[m[0]], text)
        if self.marks is None or not self.marks.search(text):
            return self.split.findall(text)
        return [text[m.start() : m.end()] for m in self.split.finditer(self.marks.sub("\u2020", text))]

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if CONTROL.search(text):
            text = "".join(SPACE.sub(" ", text))
        # the library lower-cases letter by letter, so a final sigma is no case of its own
        return text.replace("Σ", "σ").lower()

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the special tokens' strings give their ids."""
        out: list[int] = []
        for part in self.special_split.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                for p in self.pieces(self.normal(part)):
                    out += self.merge(p)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings; the file names no decoder, so one space stands between them."""
        return " ".join(self.strings[i] for i in ids)

    def unit(self, word: str) -> tuple[str, str, int]:
        """Ids and strings of a word without white space, both joined by spaces, and how many."""
        if (known := self.kept.get(word)) is None:
            ids = [i for p in self.pieces(word) for i in self.merge(p)]
            known = (" ".join(map(str, ids)), self.decode(ids), len(ids))
            if len(self.kept) >= KEEP:
                self.kept.clear()
            self.kept[word] = known
        return known

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal and the decoded text."""
        text = text or ""
        if "<|" in text or CONTROL.search(text):
            ids = self.encode(text)
            return len(ids), " ".join(map(str, ids)), self.decode(ids)
        get = self.kept.get
        parts = [get(w) or self.unit(w) for w in self.normal(text).split()]
        if not parts:
            return 0, "", ""
        ids, strings, counts = zip(*parts, strict=True)
        return sum(counts), " ".join(ids), " ".join(strings)


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digest of the ids and of the decoded text for each row of ``docs`` (doc_id, text; others are ignored).

    A null or empty text has no ids and decodes to an empty text; repeated rows
    each give a row; an empty table gives none.
    """

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for ids, texts in common.batches(frames, "doc_id", "text"):
            done = [(n, sha(a), sha(b)) for n, a, b in map(c.digest, texts)]
            n, a, b = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the 49k word vocabulary."""
    import public_tokenizers

    return encode_decode(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
