"""Patched frame-of-reference files of token ids.

File: b"PFOR", version 1, then as little-endian numbers: documents (uint32), ids (uint64), blocks (uint32), doc_id (int64
each; the least int64 stands for null), ids per document (uint64 each), place of each block's start (uint64 each). A block
holds BLOCK ids: minimum (uint32), width (uint8), exceptions (uint8), the differences to the minimum packed at that width
in uint64 words, positions of exceptions (uint8 each), their differences (uint32 each). The width fits PERCENT of a
block's differences; larger ones are exceptions. The last block is filled up with its minimum."""

from __future__ import annotations

import numpy as np

BLOCK, PERCENT = 128, 90
NULL_ID = np.iinfo(np.int64).min
_HEAD = np.dtype([("magic", "S4"), ("version", "<u4"), ("docs", "<u4"), ("ids", "<u8"), ("blocks", "<u4")])
_BLOCK_HEAD = 6


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(BLOCK, g) uint64 below 2**width to (2 * width, g) words."""
    out = np.zeros((2 * width, values.shape[1]), dtype=np.uint64)
    for j in range(BLOCK if width else 0):
        k, s = divmod(j * width, 64)
        out[k] |= values[j] << np.uint64(s)
        if s + width > 64:
            out[k + 1] |= values[j] >> np.uint64(64 - s)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((BLOCK, words.shape[1]), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK if width else 0):
        k, s = divmod(j * width, 64)
        out[j] = words[k] >> np.uint64(s)
        if s + width > 64:
            out[j] |= words[k + 1] << np.uint64(64 - s)
        out[j] &= mask
    return out


def write(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    n = -(-len(ids) // BLOCK)
    rows = np.zeros((n, BLOCK), dtype=np.uint32)
    rows.reshape(-1)[: len(ids)] = ids
    if n and len(ids) % BLOCK:
        rows[-1, len(ids) % BLOCK :] = rows[-1, : len(ids) % BLOCK].min()
    low = rows.min(axis=1) if n else np.zeros(0, dtype=np.uint32)
    rest = rows - low[:, None]
    bits = np.zeros((n, BLOCK), dtype=np.uint8)
    for b in range(int(rest.max()).bit_length() if n else 0):
        bits += rest >> np.uint32(b) > 0
    width = np.partition(bits, BLOCK * PERCENT // 100, axis=1)[:, BLOCK * PERCENT // 100] if n else np.zeros(0, dtype=np.uint8)
    odd = bits > width[:, None]
    exceptions = odd.sum(axis=1)
    length = _BLOCK_HEAD + 16 * width.astype(np.int64) + 5 * exceptions
    starts = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    body = np.zeros(starts[-1], dtype=np.uint8)
    fixed = np.zeros((n, _BLOCK_HEAD), dtype=np.uint8)
    fixed[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    fixed[:, 4], fixed[:, 5] = width, exceptions
    body[(starts[:-1, None] + np.arange(_BLOCK_HEAD)).ravel()] = fixed.ravel()
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        if w:
            packed = _pack((rest[which].T & np.uint32((1 << w) - 1)).astype(np.uint64), w)
            raw = np.ascontiguousarray(packed.T).astype("<u8").view(np.uint8).reshape(len(which), 16 * w)
            body[(starts[which, None] + _BLOCK_HEAD + np.arange(16 * w)).ravel()] = raw.ravel()
    block, place = np.nonzero(odd)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = starts[block] + _BLOCK_HEAD + 16 * width[block].astype(np.int64)
        body[base + nth] = place
        body[((base + exceptions[block] + 4 * nth)[:, None] + np.arange(4)).ravel()] = rest[block, place].astype("<u4").view(np.uint8)
    head = np.array([(b"PFOR", 1, len(doc_ids), len(ids), n)], dtype=_HEAD)
    return b"".join([head.tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), starts[:-1].astype("<u8").tobytes(), body.tobytes()])


def read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids for each document, all ids."""
    head = np.frombuffer(data, dtype=_HEAD, count=1)[0]
    if head["magic"] != b"PFOR" or head["version"] != 1:
        raise ValueError("not a PFOR file of version 1")
    docs, total, n, at = int(head["docs"]), int(head["ids"]), int(head["blocks"]), _HEAD.itemsize
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
    starts = np.frombuffer(data, "<u8", n, at + 16 * docs).astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=at + 16 * docs + 8 * n)
    fixed = body[(starts[:, None] + np.arange(_BLOCK_HEAD)).ravel()].reshape(n, _BLOCK_HEAD)
    low = np.ascontiguousarray(fixed[:, :4]).view("<u4")[:, 0]
    width, exceptions = fixed[:, 4].astype(np.int64), fixed[:, 5].astype(np.int64)
    rest = np.zeros((n, BLOCK), dtype=np.uint32)
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        if w:
            raw = body[(starts[which, None] + _BLOCK_HEAD + np.arange(16 * w)).ravel()].reshape(len(which), 16 * w)
            rest[which] = _unpack(np.ascontiguousarray(raw.view("<u8").T), w).T
    block = np.repeat(np.arange(n), exceptions)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = starts[block] + _BLOCK_HEAD + 16 * width[block]
        value = body[((base + exceptions[block] + 4 * nth)[:, None] + np.arange(4)).ravel()].view("<u4")
        rest[block, body[base + nth]] = value
    return doc_ids, counts, (rest + low[:, None]).reshape(-1)[:total]
