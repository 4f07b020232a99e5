"""Functions that Spark has no built-in for, as Arrow-batched UDFs."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from obspark.functions.text import HIDDEN_KEYS, HIDDEN_PATH, MOST_SHOWN


def embed_text(text: str | None, dimension: int = 64) -> list[float]:
    """deterministic unit vector from SHA-256 blocks of a text, 16 bits a coordinate."""
    out: list[float] = []
    block = 0
    while len(out) < dimension:
        digest = hashlib.sha256(f"{text or ''}#{block}".encode()).digest()
        out += [v / 32767.5 - 1.0 for v in struct.unpack(">16H", digest)]
        block += 1
    v = np.array(out[:dimension])
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


@F.pandas_udf(ArrayType(DoubleType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    return texts.map(embed_text)


def sign(payload: str, secret: str) -> str:
    """URL-safe HMAC-SHA256 of a payload."""
    return base64.urlsafe_b64encode(hmac.new(secret.encode(), payload.encode(), hashlib.sha256).digest()).decode().rstrip("=")


def verified_payload(token: str | None, secret: str, now: float) -> str | None:
    """the payload of a token ``subject:expiry.signature`` that is genuine and has not lapsed, else None."""
    payload, _, signature = (token or "").rpartition(".")
    if not payload or not hmac.compare_digest(signature, sign(payload, secret)):
        return None
    expiry = payload.rpartition(":")[2]
    return payload if expiry.isdigit() and int(expiry) > now else None


def playback_token(secret: str):
    @F.pandas_udf(StringType())
    def token(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda p: None if p is None else f"{p}.{sign(p, secret)}")

    return token


def playback_subject(secret: str, now: float):
    """The subject of a genuine token ``subject:expiry.signature`` that has not lapsed, else null."""

    @F.pandas_udf(StringType())
    def subject(tokens: pd.Series) -> pd.Series:
        held = tokens.map(lambda t: verified_payload(t, secret, now))
        return held.map(lambda p: None if p is None else p.rpartition(":")[0])

    return subject


def hide(value, key: str = ""):
    """a JSON value as an export shows it, at any depth."""
    if re.search(HIDDEN_KEYS, key):
        return "[redacted]"
    if isinstance(value, dict):
        return {k: hide(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [hide(v, key) for v in value]
    if isinstance(value, str):
        if value.startswith("data:") or re.match(HIDDEN_PATH, value):
            return "[redacted]"
        return "[redacted-long-string]" if len(value) > MOST_SHOWN else value
    return value


@F.pandas_udf(StringType())
def redacted_json(payloads: pd.Series) -> pd.Series:
    """JSON texts as an export shows them; null for what is no JSON."""

    def one(p):
        try:
            return None if p is None else json.dumps(hide(json.loads(p)), separators=(",", ":"))
        except ValueError:
            return None

    return payloads.map(one)


#: Bytes of frames that are looked at together.
FRAMES = 1 << 22


def frames_by_size(frames: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Frames (binary) of equal size, some megabytes at a time: their places and a row of bytes for each; null and empty ones are left out."""
    sizes = pc.fill_null(pc.binary_length(frames), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]):
        of = np.flatnonzero(sizes == n)
        step = max(1, FRAMES // int(n))
        for at in (of[i : i + step] for i in range(0, len(of), step)):
            yield at, np.frombuffer(b"".join(frames.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), n)


def frame_statistics(frames: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Brightness, sharpness (variance of the Laplacian) and histogram (32 bins, shares) of gray frames, a row of bytes for each."""
    x = frames.reshape(len(frames), -1, width).astype(np.float64)
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="reflect" if min(x.shape[1:]) > 1 else "edge")
    laplacian = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * x
    bins = np.arange(len(frames))[:, None] * 32 + frames // 8
    return x.mean(axis=(1, 2)), laplacian.var(axis=(1, 2)), np.bincount(bins.ravel(), minlength=32 * len(frames)).reshape(-1, 32) / frames.shape[1]


def listed(like: pa.ListArray, values: pa.Array) -> pa.ListArray:
    """Values in lists as long as those of ``like``, null where it is."""
    ends = np.cumsum(pc.fill_null(like.value_lengths(), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values, mask=like.is_null())


def followers(lists: pa.ListArray) -> np.ndarray:
    """Places, in the flat values, that are not the first of their list."""
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    later = np.ones(int(sizes.sum()), bool)
    later[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    return np.flatnonzero(later)


def frame_features(width: int):
    """Brightness, sharpness and the change of scene (1 less the correlation of histograms with the frame before) of each frame of a list."""

    @F.arrow_udf("array<struct<brightness:double,sharpness:double,scene:double>>")
    def features(frames: pa.Array) -> pa.Array:
        flat, after = frames.flatten(), followers(frames)
        light, sharp, bins = np.full(len(flat), np.nan), np.full(len(flat), np.nan), np.full((len(flat), 32), np.nan)
        for at, rows in frames_by_size(flat):
            light[at], sharp[at], bins[at] = frame_statistics(rows, width)
        a = bins - bins.mean(axis=1, keepdims=True)
        squares, scene = (a * a).sum(axis=1), np.zeros(len(flat))
        norm = np.sqrt(squares[after] * squares[after - 1])
        alike = np.divide((a[after] * a[after - 1]).sum(axis=1), norm, out=np.ones(len(after)), where=norm != 0)
        scene[after] = np.fmax(0.0, 1.0 - alike)
        return listed(frames, pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in (light, sharp, scene)], names=["brightness", "sharpness", "scene"]))

    return features


def motion_scores(frames: list[bytes]) -> list[float]:
    """Mean absolute difference of each gray frame from the one before, over 255 (the first: 0)."""
    arrays = [np.frombuffer(f, np.uint8).astype(np.int16) for f in frames]
    return [0.0, *[float(np.abs(b - a).mean() / 255) for a, b in zip(arrays, arrays[1:], strict=False)]] if arrays else []


@F.arrow_udf(ArrayType(DoubleType()))
def frame_motion(frames: pa.Array) -> pa.Array:
    """``motion_scores`` of each list of frames; frames of one size meet in one array, others one by one."""
    flat, after = frames.flatten(), followers(frames)
    sizes = pc.fill_null(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    out = np.zeros(len(flat))
    if (sizes[after] != sizes[after - 1]).any():
        values = [x for fs in frames.to_pylist() for x in motion_scores(fs or [])]
        return listed(frames, pa.array(values, pa.float64()))
    for n in np.unique(sizes[after]):
        of = after[sizes[after] == n]
        step = max(1, FRAMES // max(1, int(n)))
        for at in (of[i : i + step] for i in range(0, len(of), step)):
            now, was = (np.frombuffer(b"".join(flat.take(pa.array(x)).to_pylist()), np.uint8).reshape(len(at), n).astype(np.int16) for x in (at, at - 1))
            out[at] = np.abs(now - was).mean(axis=1) / 255
    return listed(frames, pa.array(out))
