"""Word shingles of texts as sets of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Bytes of a text whose words are split at once, cut at a blank.
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(29), np.uint64(32)
_BLANKS = b" \t\n\x0b\x0c\r"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _B)) * _ODD
    return h ^ (h >> _A)


def _pieces(raw: bytes):
    """Parts of about CHUNK bytes that end at blanks."""
    start = 0
    while start < len(raw):
        end = start + CHUNK
        while end < len(raw) and raw[end] not in _BLANKS:
            end += 1
        yield raw[start:end]
        start = end


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of lower-cased bytes, in order. `bytes.split` splits at the ASCII blanks.

    Half of XXH3 with 128 bits, which unlike polynomial hashes has no sums of letters by which texts collide.
    """
    pieces = (raw,) if len(raw) <= CHUNK else _pieces(raw)
    return np.frombuffer(b"".join(b"".join(map(xxhash.xxh3_128_digest, piece.split())) for piece in pieces), np.uint64)[::2]


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of `width` words; fewer words are one shingle, none an empty set.

    Words are runs of anything but ASCII blanks, with A-Z lower-cased, as `bytes.lower` does.
    """
    hashes = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ (h >> _A)) * _ODD + hashes[k : k + n]
    h = np.sort(_mixed(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    raw = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)
