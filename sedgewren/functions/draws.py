"""md5 of numbered keys for whole batches: the draws of resamples and perturbations, worked out in numpy within tasks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

#: Of each of the 64 steps: the constant, and how far it turns; and the first state (RFC 1321).
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages worked on at once, so that all numbers stay near the processor.
CHUNK = 16384
#: Longest message of one md5 block.
LONGEST = 55


def md5_blocks(words: list[np.ndarray | None], size: int) -> np.ndarray:
    """(4, size) unsigned 32-bit words of the digests of ``size`` padded one-block messages; ``words`` are their 16 words, None for zeros."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in _FIRST)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        np.add(f, a, out=f)
        np.add(f, np.uint32(_SINES[i]), out=f)
        if words[g] is not None:
            np.add(f, words[g], out=f)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=t)
        np.left_shift(f, np.uint32(_TURNS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)  # a's old value is used up
        a, b, c, d = d, a, b, c
    return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), _FIRST, strict=True)])


def numbered_md5(keys: Sequence[bytes], row: np.ndarray, number: np.ndarray) -> np.ndarray:
    """(4, n) big-endian 32-bit words of the md5 of ``keys[row]`` followed by the decimal ``number`` (0 or more)."""
    out = np.empty((4, len(row)), np.uint32)
    lengths = np.array([len(k) for k in keys], np.int64)[row] if len(row) else np.empty(0, np.int64)
    top = int(number.max(initial=0))
    digits = len(str(top))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        if length + digits > LONGEST:
            for i in at.tolist():
                out[:, i] = np.frombuffer(hashlib.md5(keys[row[i]] + b"%d" % number[i], usedforsecurity=False).digest(), ">u4")
            continue
        # A message is its key's words and its number's words, which has its place, end mark and length.
        tails = b"".join((b"\0" * length + b"%d\x80" % i).ljust(56, b"\0") + (8 * (length + len(b"%d" % i))).to_bytes(8, "little") for i in range(top + 1))
        tails = np.ascontiguousarray(np.frombuffer(tails, "<u4").reshape(-1, 16).T)
        own = [k if len(k) == length else b"" for k in keys]
        heads = np.ascontiguousarray(np.frombuffer(b"".join(k.ljust(64, b"\0") for k in own), "<u4").reshape(-1, 16).T)
        live = [(bool(heads[j].any()), bool(tails[j].any())) for j in range(16)]
        for start in range(0, len(at), CHUNK):
            part = at[start : start + CHUNK]
            r, n = row[part], number[part]
            words = [(heads[j][r] | tails[j][n] if t else heads[j][r]) if h else tails[j][n] if t else None for j, (h, t) in enumerate(live)]
            out[:, part] = md5_blocks(words, len(part)).byteswap()
    return out


def bernoulli_bound(p: float) -> int:
    """What a draw of 32 bits must stay under to happen with probability ``p``."""
    return min(1 << 32, max(0, round(p * (1 << 32))))
