"""Hashes of words and word shingles of whole Arrow columns, without a loop over words.

Words are runs of bytes other than the ASCII white space 9-13 and 32 of the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are taken in slices of about this many bytes, one text at least; words are hashed in pieces of PIECE bytes.
SLICE, PIECE = 1 << 20, 1 << 19
#: Places in a word whose weights are looked up; those beyond are computed.
PLACES = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser of each number."""
    x = x.astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _weight(place: np.ndarray) -> np.ndarray:
    return mix((place.astype(_U) + _U(1)) * _U(0xD1342543DE82EF95)) | _U(1)


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_PLACE = _weight(np.arange(PLACES))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the offsets of its rows; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    col = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _pieces(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that no word crosses: they end with a row, before white space, or where a longer word ends."""
    begin, n = 0, len(raw)
    while begin < n:
        end = begin + PIECE
        if end < n:
            row = int(np.searchsorted(at, end, "right")) - 1
            if at[row] > begin:
                end = int(at[row])
            else:
                stop = int(at[row + 1])
                while end < stop and not (space := _SPACE[raw[end : min(end + PLACES, stop)]]).any():
                    end += len(space)
                end += int(space.argmax()) if end < stop else 0
                end = min(end, stop)
        end = min(end, n)
        yield begin, end
        begin = end


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and for each row the index of its first word (one more at the end).

    A word's hash is a sum over its bytes, each weighted by its place in the word, so equal words have
    equal hashes wherever they stand, and no number depends on how long a text is.
    """
    if not len(raw):
        return np.zeros(0, _U), np.zeros(len(at), np.int64)
    hashes, starts = [], []
    for low, high in _pieces(raw, at):
        part = raw[low:high]
        inside = ~_SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        rows = at[np.searchsorted(at, low) : np.searchsorted(at, high)] - low
        first[rows] |= inside[rows]
        begin = np.flatnonzero(first)
        if not len(begin):
            continue
        letters = part[inside]
        spot = np.flatnonzero(first[inside])
        length = np.diff(np.append(spot, len(letters)))
        place = np.arange(len(letters)) - np.repeat(spot, length)
        weight = _PLACE[np.minimum(place, PLACES - 1)]
        if len(far := np.flatnonzero(place >= PLACES)):
            weight[far] = _weight(place[far])
        hashes.append(mix(np.add.reduceat(_BYTE[letters] * weight, spot) + length.astype(_U)))
        starts.append(begin + low)
    if not hashes:
        return np.zeros(0, _U), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


def shingle_hashes(raw: np.ndarray, at: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle of k words, and the row offsets. A row of 1 to k - 1 words has one shingle of them all; a row without words has none."""
    words, first = word_hashes(raw, at)
    count = np.diff(first)
    step = mix(np.arange(101, 101 + k, dtype=_U) * _U(_BASE)) | _U(1)
    out_count = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(out_count)))
    row = np.repeat(np.arange(len(count)), out_count)
    begin = first[:-1][row] + np.arange(len(row)) - out_at[:-1][row]
    total = np.zeros(len(row), _U)
    length = np.minimum(count, k)[row]
    for j in range(k):
        some = slice(None) if j == 0 else j < length
        total[some] += words[begin[some] + j] * step[j]
    return mix(total + length.astype(_U)), out_at


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about SLICE bytes."""
    raw, at = bytes_of(texts)
    begin = 0
    while begin < len(at) - 1:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + SLICE, "right")) - 1)
        yield begin, end, raw[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        begin = end


def counted(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct hashes in order with their counts: (row, hash, count)."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    begin = np.flatnonzero(new)
    return row[begin], hashes[begin], np.diff(np.append(begin, len(row)))
