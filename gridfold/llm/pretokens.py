"""Pre-tokens of byte-level BPE, cut from overlapping chunks, and the merge loop.

The cut of a text into pre-tokens depends, from any cut onwards, on the text after it alone (the
pattern looks ahead but never back). So a chunk that starts anywhere gives wrong cuts only until its
first cut that is a true one; from there on it agrees with the whole text, up to its last pre-token,
which the chunk's end may have shortened. Neighbouring chunks overlap, and are stitched at the first
cut of the later chunk that is a cut of the earlier one.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import regex

#: Chunk and overlap in code points; texts of at most CHUNK are one chunk.
CHUNK, OVERLAP = 1 << 15, 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=8)
def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def cuts(pattern: regex.Pattern, text: str, start: int, end: int, final: bool) -> list[int]:
    """Starts of the pre-tokens of text[start:end] that can be trusted; with `final`, also the end.

    Without `final` the last pre-token is left out: more text could lengthen it, or, for white space,
    change where it ends.
    """
    found = [m.start() for m in pattern.finditer(text, start, end)]
    return [*found, end] if final else found


def stitch(chunks: list[list[int]]) -> list[int] | None:
    """The true cuts, from the cuts of overlapping chunks in order; None where two don't resynchronise."""
    result = list(chunks[0])
    for later in chunks[1:]:
        known = set(result[-(len(later) + OVERLAP) :])
        at = next((k for k, cut in enumerate(later) if cut in known), None)
        if at is None:
            return None
        while result and result[-1] >= later[at]:
            result.pop()
        result += later[at:]
    return result


def windows(n: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Starts and ends of the overlapping chunks of a text of n code points."""
    found = [(0, min(n, chunk))]
    while found[-1][1] < n:
        start = found[-1][1] - overlap
        found.append((start, min(n, start + chunk)))
    return found


def boundaries(pattern: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """All cuts of a text, its end included, by overlapping chunks.

    Chunks that don't resynchronise (a run of one kind longer than the overlap) are cut anew as one.
    """
    n = len(text)
    result: list[int] = []
    for start, end in windows(n, chunk, overlap):
        own = cuts(pattern, text, start, end, end == n)
        if not result:
            result = own
            continue
        joined = stitch([result, own])
        result = joined if joined is not None else [*result[:-1], *cuts(pattern, text, result[-1], end, end == n)]
    return result


def pretokens(pattern: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """Lists of the pre-tokens of a text, in order."""
    if len(text) <= chunk:
        yield pattern.findall(text)
        return
    at = boundaries(pattern, text, chunk, overlap)
    for k in range(0, len(at) - 1, 1 << 16):
        part = at[k : k + (1 << 16) + 1]
        yield [text[a:b] for a, b in zip(part, part[1:], strict=False)]


#: Up to so many bytes a plain scan for the lowest rank beats the heap; NEVER is over any rank.
SHORT, NEVER = 48, 1 << 60


def _merge_short(rank, parts: list[bytes]) -> list[bytes]:
    ranks = [NEVER if r is None else r for r in map(rank, parts, parts[1:])]
    while ranks and (least := min(ranks)) < NEVER:
        i = ranks.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i:
            r = rank(parts[i - 1], parts[i])
            ranks[i - 1] = NEVER if r is None else r
        if i < len(ranks):
            r = rank(parts[i], parts[i + 1])
            ranks[i] = NEVER if r is None else r
    return parts


def merge(rank, piece: bytes) -> list[bytes]:
    """Parts of one pre-token: the neighbours with the lowest rank merge first, the leftmost on a tie.

    rank(a, b) is the rank of joining two neighbouring parts, or None if they don't join.
    """
    n = len(piece)
    if n <= SHORT:
        return _merge_short(rank, [piece[i : i + 1] for i in range(n)])
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    live = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 1], piece[i + 1 : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not live[i] or end[i] != mid or end[mid] != stop or not live[mid]:
            continue  # one of the two parts has merged meanwhile
        end[i], live[mid] = stop, False
        if stop < n:
            before[stop] = i
            if (r := rank(piece[i:stop], piece[stop : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (p := before[i]) >= 0 and (r := rank(piece[p:i], piece[i:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    return [piece[i : end[i]] for i in range(n) if live[i]]
