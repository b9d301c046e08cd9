"""Array arithmetic over Arrow text columns: words, span hashes, window hashes.

These helpers see one slice of a batch inside a task.  Texts are handled as the
concatenated UTF-8 bytes of the slice; ``offsets`` has the document bounds.
Hashes are polynomials modulo 2**64 over random codes, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 2 << 20
#: bytes outside words made of ``[^\x20\x09-\x0D]``
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: bytes of words made of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every other."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Poly:
    """One polynomial hash family; two families together make a 128-bit hash."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, 1 << 63)) * 2 + 1
        self.codes = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 1 << 16)
            for name, base in (("up", self.base % (1 << 64)), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(n + 1, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums; of bytes by their codes, of 64-bit hashes as they are."""
        self.powers(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((self.codes[values] if values.dtype == np.uint8 else values) * self.up[: len(values)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


A, B = Poly(20240101), Poly(20240202)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their bounds; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows of about ``limit`` text bytes; a longer text is a run of its own."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(row, end - row), data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
            row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of ``inside`` bytes; runs end with their document."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    member = inside[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = member[:-1], member[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def windows(hashes: np.ndarray, doc: np.ndarray, n: int, poly: Poly = A) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of ``n`` words inside one document."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1:])
    return first, poly.span(poly.prefix(hashes), first, first + n)


def covered(length: int, starts: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Mask of positions inside any run ``[start, start + width)``."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, length), -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True."""
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
