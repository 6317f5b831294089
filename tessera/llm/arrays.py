"""Sorted arrays in the shared folder: written in segments by tasks,
memory-mapped by workers.

A level's keys have up to 64 bits and are spread evenly, so the segment of a
key is given by its top bits.  A file appears under its name only when it is complete, and
a task that runs twice writes the same file again.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import SparkFiles


def _local(folder: str) -> str | None:
    """The folder as a mounted path, or None if only a store client reaches it."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return folder if "://" not in folder else None


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    data, temporary = np.ascontiguousarray(values).tobytes(), f"{name}.{uuid.uuid4().hex}"
    here = _local(folder)
    if here is not None:
        os.makedirs(here, exist_ok=True)
        Path(here, temporary).write_bytes(data)
        os.replace(Path(here, temporary), Path(here, name))
        return
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{temporary}") as out:
        out.write(data)
    fs.move(f"{path}/{temporary}", f"{path}/{name}")


def map_array(folder: str, name: str, dtype) -> np.ndarray:
    """Read-only view of a written array; empty if there is no such file.  From
    a store without a mounted path the file is first copied, once, into the
    executor's own Spark folder."""
    here = _local(folder)
    if here is None:
        fs, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
        copy = Path(SparkFiles.getRootDirectory(), path.strip("/").replace("/", "_"))
        if not copy.exists() and fs.get_file_info(path).type == pafs.FileType.File:
            with fs.open_input_stream(path) as source:
                part = copy.with_suffix(f".{uuid.uuid4().hex}")
                with part.open("wb") as out:
                    while block := source.read(8 << 20):
                        out.write(block)
                os.replace(part, copy)
        file = copy
    else:
        file = Path(here, name)
    if not file.exists() or not file.stat().st_size:
        return np.zeros(0, dtype)
    return np.memmap(file, dtype, "r")


def segment_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Segment number of signed keys: monotone in the key."""
    return ((keys >> np.int64(63 - bits + 1)) + (1 << bits >> 1)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes as the largest needs, first the low
    bytes of all, then the next: bytes that are mostly alike stand together,
    and Spark's compression of shuffled rows takes them out."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """Inverse of packed."""
    width, n = data[0], (len(data) - 1) // data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, n).T
    return out.view(np.uint64).ravel()


def steps(x: np.ndarray) -> bytes:
    """Sorted numbers packed as the steps between them."""
    return packed(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


_LARGE = 255


def write_rows(folder: str, name: str, rows: np.ndarray) -> None:
    """Rows of counts (two dimensions), a byte each; a row with a count of
    ``_LARGE`` or more is all ``_LARGE`` and stands in a table of its own."""
    large = np.flatnonzero((rows >= _LARGE).any(axis=1))
    small = np.minimum(rows, _LARGE).astype(np.uint8)
    small[large] = _LARGE
    write_array(folder, f"{name}.rows", small)
    if len(large):
        write_array(folder, f"{name}.at", large.astype(np.int64))
        write_array(folder, f"{name}.large", rows[large].astype(np.int64))


class Rows:
    """Rows of ``width`` counts as write_rows wrote them."""

    def __init__(self, folder: str, name: str, width: int):
        self.rows = map_array(folder, f"{name}.rows", np.uint8).reshape(-1, width)
        self.at = map_array(folder, f"{name}.at", np.int64)
        self.large = map_array(folder, f"{name}.large", np.int64).reshape(-1, width)

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, places) -> np.ndarray:
        out = self.rows[places].astype(np.int64)
        here = np.flatnonzero(out[:, 0] == _LARGE)
        if len(here):
            at = (np.arange(len(self.rows))[places] if isinstance(places, slice) else places)[here]
            out[here] = self.large[np.searchsorted(self.at, at)]
        return out


def _low_type(width: int):
    """Type of what is left of a key below its top 32 bits."""
    return None if width <= 32 else np.uint8 if width <= 40 else np.uint16 if width <= 48 else np.uint32


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


class Keys:
    """A level of keys of ``width`` bits, spread evenly, each with a count:
    2**bits segments by the top bits; of the other bits the 32 highest and the
    lower ones are arrays of their own."""

    def __init__(self, folder: str, level: str, bits: int, width: int):
        n, self.rest, low = 1 << bits, width - bits, _low_type(width - bits)
        self.high = [map_array(folder, f"{level}-{i}.high", np.uint32) for i in range(n)]
        self.low = [map_array(folder, f"{level}-{i}.low", low) for i in range(n)] if low else None
        self.counts = [Rows(folder, f"{level}-{i}", 1) for i in range(n)]
        self.offsets = np.concatenate([[0], np.cumsum([len(k) for k in self.high])])

    @staticmethod
    def write(folder: str, level: str, i: int, rest: int, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys: sorted, without the bits that number the segment."""
        low, below = _low_type(rest), np.uint64(max(rest - 32, 0))
        write_array(folder, f"{level}-{i}.high", (keys >> below).astype(np.uint32))
        if low:
            write_array(folder, f"{level}-{i}.low", (keys & _mask(max(rest - 32, 0))).astype(low))
        write_rows(folder, f"{level}-{i}", counts[:, None])

    def segment(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts) of a segment."""
        keys = self.high[i].astype(np.uint64)
        if self.low:
            keys = (keys << np.uint64(self.rest - 32)) | self.low[i].astype(np.uint64)
        return keys | (np.uint64(i) << np.uint64(self.rest)), self.counts[i][:][:, 0]

    def find(self, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(global position or -1, count or 0) of each of the sorted keys."""
        place, count = np.full(len(sorted_keys), -1, np.int64), np.zeros(len(sorted_keys), np.int64)
        ends = np.searchsorted(sorted_keys >> np.uint64(self.rest), np.arange(len(self.high), dtype=np.uint64), side="right")
        keys, below = sorted_keys & _mask(self.rest), np.uint64(max(self.rest - 32, 0))
        high, start = (keys >> below).astype(np.uint32), 0
        low = (keys & _mask(self.rest - 32)).astype(self.low[0].dtype) if self.low else None
        for i, end in enumerate(ends):
            if end > start and len(self.high[i]):
                table, q, last = self.high[i], high[start:end], len(self.high[i]) - 1
                at = np.searchsorted(table, q)
                if low is not None:
                    # keys alike in their 32 high bits stand side by side
                    here = np.arange(len(q))
                    while len(here):
                        a = at[here]
                        here = here[(a <= last) & (table[np.minimum(a, last)] == q[here]) & (self.low[i][np.minimum(a, last)] < low[start:end][here])]
                        at[here] += 1
                at = np.minimum(at, last)
                hit = table[at] == q
                if low is not None:
                    hit &= self.low[i][at] == low[start:end]
                found = np.flatnonzero(hit)
                place[start + found] = at[found] + self.offsets[i]
                count[start + found] = self.counts[i][at[found]][:, 0]
            start = end
        return place, count


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)
