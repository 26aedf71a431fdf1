"""Words of whole record batches as arrays: no Python object for each word.

Texts are taken in blocks of about ``BLOCK`` units, so memory stays bounded; a longer text is cut between words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
STEP = 0x9E3779B97F4A7C15
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of an odd number and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (STEP, pow(STEP, -1, 2**64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers of an odd number; ``spans`` takes hashes of slices from them."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the values from starts to ends, wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + np.uint64(STEP) * (ends - starts).astype(np.uint64))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the unbroken runs of ``inside`` units, none of which crosses a text's border."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(inside)]
    first[at] = inside[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each one starts (and the last one ends); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"") if texts.null_count else texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(units: np.ndarray, offsets: np.ndarray, inside: Callable[[np.ndarray], np.ndarray], size: int = BLOCK) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first text, text after the last, pieces) of about ``size`` units; a piece is its units and the texts' offsets.

    A text of more units stands alone, in several pieces, and is cut only where ``inside`` says that no word is.
    """
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[end])
        if hi - lo <= size:
            yield at, end, [(units[lo:hi], offsets[at : end + 1] - lo)]
        else:
            pieces = []
            while lo < hi:
                cut = min(lo + size, hi)
                while cut < hi and (word := inside(units[cut : min(cut + 4096, hi)])).all():
                    cut += len(word)
                if cut < hi:
                    cut += int(np.argmin(word))
                pieces.append((units[lo:cut], np.array([0, cut - lo])))
                lo = cut
            yield at, end, pieces
        at = end
