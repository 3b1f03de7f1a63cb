"""Words of whole Arrow string columns, found and hashed with numpy over the raw UTF-8.

``SPACE`` words are ``[^\\x20\\x09-\\x0D]+``; ``ALNUM`` words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. No per-word Python object
is made. Word hashes are 64-bit: the sum of a random value for each byte at its place in the word,
mixed; equal words have equal hashes everywhere, and no pattern of letters makes different words
meet (a polynomial modulo 2**64 gives long Thue-Morse words one hash).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
#: Places of a word whose values are tabulated; later ones are computed.
PLACES = 64
_AT_PLACE = _rng.integers(0, 2**64, PLACES * 256, dtype=np.uint64)
_WBASE = 0xD6E8FEB86659FD93 | 1
_lower = np.arange(256)
_lower[65:91] += 32
LOWER = _lower.astype(np.uint8)

_is_space = np.zeros(256, bool)
_is_space[[32, 9, 10, 11, 12, 13]] = True
_is_alnum = np.zeros(256, bool)
_is_alnum[48:58] = _is_alnum[65:91] = _is_alnum[97:123] = _is_alnum[128:] = True
SPACE, ALNUM = ~_is_space, _is_alnum


class _Powers:
    """Powers of an odd base and of its inverse mod 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, 2**64))])
                self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 2**64))])
        return self.up, self.down


_words_pow, _second_pow = _Powers(_WBASE), _Powers(0xA24BAED4963EE407)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some documents: ``first[d]:first[d+1]`` are document d's."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def raw(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def _hashes(buf: np.ndarray, inside: np.ndarray, sizes: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of the words whose bytes are ``inside``, of these sizes."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    own = buf[inside]
    heads = np.cumsum(sizes) - sizes
    place = np.arange(len(own)) - np.repeat(heads, sizes)
    place *= 256
    place += LOWER[own] if lower else own
    if int(sizes.max()) <= PLACES:
        value = _AT_PLACE[place]
    else:
        far = place >= len(_AT_PLACE)
        value = _AT_PLACE[np.where(far, 0, place)]
        value[far] = mix(place[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(value, heads))


def words(texts: pa.Array | pa.ChunkedArray, kind: np.ndarray = SPACE, lower: bool = False) -> Words:
    buf, at = raw(texts)
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(buf, none, none, np.zeros(len(at), np.int64), np.zeros(0, np.uint64))
    inside = kind[buf]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    opens[cuts] = inside[cuts]
    starts = np.flatnonzero(opens)
    shut = inside.copy()
    shut[:-1] &= ~inside[1:]
    shut[cuts - 1] = inside[cuts - 1]
    ends = np.flatnonzero(shut) + 1
    first = np.searchsorted(starts, at)
    return Words(buf, starts, ends, first, _hashes(buf, inside, ends - starts, lower))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of k words inside one document."""
    n = len(w)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _words_pow.upto(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hashes * up[:n], out=total[1:])
    h = mix((total[k:] - total[:-k]) * down[: n - k + 1])
    whole = np.ones(n - k + 1, bool)
    crossing = (w.first[1:-1, None] - np.arange(1, k)).ravel()
    whole[crossing[(crossing >= 0) & (crossing < len(whole))]] = False
    at = np.flatnonzero(whole)
    return at, h[at]


def second_windows(w: Words, k: int, at: np.ndarray) -> np.ndarray:
    """32 bits of another hash of the windows that begin at ``at``."""
    up, down = _second_pow.upto(len(w))
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(mix(w.hashes ^ np.uint64(0x5851F42D4C957F2D)) * up[: len(w)], out=total[1:])
    return (mix((total[at + k] - total[at]) * down[at]) >> np.uint64(32)).astype(np.uint32)


def sequence_hash(hashes: np.ndarray) -> int:
    """The hash that ``windows`` gives to exactly these words."""
    up, _ = _words_pow.upto(max(1, len(hashes)))
    return int(mix(np.array([np.sum(hashes * up[: len(hashes)], dtype=np.uint64)]))[0])


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again in slices of about ``most`` bytes of text, one document at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            j = min(j, batch.num_rows)
            yield batch.slice(i, j - i)
            i = j
