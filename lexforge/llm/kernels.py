"""Vectorised text kernels: words, shingles and polynomial prefix hashes over Arrow string buffers."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel handles at once; one longer text is handled alone.
SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def byte_values(fold_case: bool) -> np.ndarray:
    """A fixed random 64-bit odd value for each byte; with fold_case, A-Z count as a-z."""
    values = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold_case:
        values[65:91] = values[97:123]
    return values


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def running(h: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values, modulo 2 ** 64."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=out[1:])
    return out


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> "Powers":
        if len(self.up) < n:
            self.up, self.down = powers(n, BASE), powers(n, BASE_INVERSE)
        return self


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES, rows: int = 50_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to), at + rows)
        yield at, to
        at = to


def byte_class(member) -> np.ndarray:
    return np.array([bool(member(b)) for b in range(256)])


#: [^\x20\x09-\x0D]+
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased
ALNUM = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (none crosses a row), and the index of each row's first word, with a last entry."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    left = inside[1:-1] & (~inside[:-2] | edge[:-1])
    right = inside[1:-1] & (~inside[2:] | edge[1:])
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hashes(data: np.ndarray, values: np.ndarray, pw: Powers) -> np.ndarray:
    """c with c[j] - c[i], times BASE ** -i, the polynomial hash of bytes i..j."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * pw.upto(len(data) + 1).up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, pw: Powers) -> np.ndarray:
    return (prefix[ends] - prefix[starts]) * pw.down[starts]


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, values: np.ndarray, pw: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the index of each row's first word, with a last entry."""
    starts, ends, first = word_bounds(data, offsets, table)
    return mix(span_hashes(prefix_hashes(data, values, pw), starts, ends, pw)), first


def shingle_sets(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and where each row begins, with a last entry.
    A row of fewer words, but not none, has its whole sequence as one."""
    n = len(words)
    coefficients = powers(width + 1, np.uint64(0xD6E8FEB86659FD93))[1:]
    grams = np.zeros(max(0, n - width + 1), np.uint64)
    for i in range(width):
        grams += words[i : i + len(grams)] * coefficients[i]
    grams = mix(grams)
    parts, at = [], np.zeros(len(first), np.int64)
    for row in range(len(first) - 1):
        lo, hi = int(first[row]), int(first[row + 1])
        if hi - lo >= width:
            own = np.sort(grams[lo : hi - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif hi > lo:
            own = mix(np.array([int((words[lo:hi] * coefficients[: hi - lo]).sum()) ^ (hi - lo)], np.uint64))
        else:
            own = np.zeros(0, np.uint64)
        parts.append(own)
        at[row + 1] = at[row] + len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), at
