"""Sorted arrays of hashes in files that workers map into memory."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlsplit

import numpy as np
from pyspark.sql import SparkSession

#: Files that a worker keeps mapped; mapped pages belong to the system's cache, not to the worker.
MAPPED = 256


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that all workers map, within the session's checkpoint folder, which all of them share.

    That folder has to be mounted (a plain path or a file: one), since only mounted files can be mapped.
    """
    from gridfold.session import checkpoint_folder

    parts = urlsplit(checkpoint_folder(spark))
    if parts.scheme not in ("", "file"):
        raise ValueError("files are mapped into memory: spark.checkpoint.dir has to be a folder that is mounted on all machines")
    folder = os.path.join(unquote(parts.path), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder


def remove(folder: str) -> None:
    shutil.rmtree(folder, ignore_errors=True)


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file, put in its place as a whole, so that a task that is run again or twice leaves the same."""
    ordered = sorted(arrays.items(), key=lambda x: -x[1].itemsize)  # so that each array is aligned
    head = json.dumps([[name, a.dtype.str, len(a)] for name, a in ordered]).encode()
    head += b" " * (-(len(head) + 8) % 64)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for _, a in ordered:
            f.write(np.ascontiguousarray(a).data)
    os.replace(own, path)


@lru_cache(maxsize=MAPPED)
def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file; none where there is no file, since nothing was to be written."""
    if not os.path.exists(path):
        return {}
    raw = np.memmap(path, np.uint8, "r")
    at = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    found = {}
    for name, kind, n in json.loads(raw[8:at].tobytes()):
        size = n * np.dtype(kind).itemsize
        found[name] = raw[at : at + size].view(kind)
        at += size
    return found


def within(values: np.ndarray, low: np.ndarray, high: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """For each k the first place in values[low[k]:high[k]], which is sorted, that isn't less than sought[k]; high[k] if there is none."""
    low, high = low.astype(np.int64), high.astype(np.int64)
    left = np.flatnonzero(low < high)
    while len(left):
        middle = (low[left] + high[left]) >> 1
        less = values[middle] < sought[left]
        low[left[less]] = middle[less] + 1
        high[left[~less]] = middle[~less]
        left = left[low[left] < high[left]]
    return low


def cuts(first: np.ndarray, second: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where rows sorted by (first, second) pass each of the bounds: part k lies between places k and k + 1 of the result."""
    low, high = np.searchsorted(first, bounds[0], "left"), np.searchsorted(first, bounds[0], "right")
    return np.concatenate([[0], within(second, low, high, bounds[1]), [len(first)]])
