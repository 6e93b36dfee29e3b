"""Canonical length-limited Huffman codes over integer ids, with numpy."""

from __future__ import annotations

import numpy as np

#: Longest code, in bits; the decoding table has 2 ** LIMIT entries.
LIMIT = 16
#: Ids between two checkpoints: 64 codes of 16 bits keep the step below 2 ** 16.
STEP = 64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge).

    Ids that do not occur get length 0.  A single id gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    # how many of the first k leaves each list of packages takes, level by level
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        merged = merged[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * (n - 1)
    depth = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, before = 0, 0
    for length in np.unique(lengths[order]):
        ids = order[lengths[order] == length]
        code <<= int(length) - before
        codes[ids] = code + np.arange(len(ids))
        code, before = code + len(ids), int(length)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each LIMIT bits ahead: the id they start with, and its code's length."""
    codes = canonical_codes(lengths)
    ids, sizes = np.zeros(1 << LIMIT, np.uint16), np.ones(1 << LIMIT, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((codes[used], lengths[used]))]
    spread = 1 << (LIMIT - lengths[order].astype(np.int64))
    ids[: spread.sum()] = np.repeat(order, spread)
    sizes[: spread.sum()] = np.repeat(lengths[order], spread)
    return ids, sizes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """The ids' codes as bits, and the bits from each checkpoint to the next."""
    if not len(ids):
        return b"", b""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word, shift = at >> 5, at & 31
    wide = codes[ids].astype(np.uint64) << (64 - shift - size).astype(np.uint64)
    out = np.zeros(int(ends[-1] >> 5) + 3, np.uint32)
    firsts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out[word[firsts]] = np.add.reduceat((wide >> np.uint64(32)).astype(np.uint32), firsts)
    over = np.flatnonzero(shift + size > 32)
    out[word[over] + 1] |= (wide[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    steps = np.diff(np.append(at[::STEP], ends[-1])).astype("<u2")
    return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], steps.tobytes()


def unpack(bits: bytes, steps: bytes, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Decodes from all checkpoints at once."""
    if not n:
        return np.zeros(0, np.uint16)
    ids, sizes = table
    data = np.frombuffer(bits + b"\0\0\0", np.uint8).astype(np.uint32)
    ahead = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    step = np.frombuffer(steps, "<u2").astype(np.int64)
    at = np.cumsum(step) - step
    out = np.zeros((STEP, len(step)), np.uint16)
    last = len(ahead) - 1
    for i in range(STEP):
        window = (ahead[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[i] = ids[window]
        at += sizes[window]
    return out.T.reshape(-1)[:n]
