"""Word shingles as fingerprints of 64 or twice 64 bits, computed for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

#: Lower-cases A-Z; space, tab, line feed, vertical tab, form feed and carriage return separate words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
#: Multipliers of the two fingerprints (odd, of even bit patterns).
_FACTORS = (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 64


def _mix(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    """In place, one to one on 64-bit numbers; every bit of x reaches every bit of the result."""
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= factor
    x ^= x >> np.uint64(32)
    return x


def _words(data: bytes, begin: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
    """Fingerprints of the words data[begin:end]: eight bytes at a time are mixed in, after the length."""
    every = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    factor, size = np.uint64(_FACTORS[lane]), end - begin
    out = size.astype(np.uint64) * factor
    own, k = np.arange(len(size)), 0
    while len(own):
        out[own] = _mix(out[own] ^ (every[begin[own] + k] & _BYTES[np.minimum(size[own] - k, 8)]), factor)
        k += 8
        own = np.flatnonzero((size > k) & (size <= _LONG))
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]], digest_size=8, salt=bytes([lane])).digest(), "little")
    return out


def sequences(words: np.ndarray, first: np.ndarray | None, width: int, lane: int = 0) -> np.ndarray:
    """Fingerprints of ``width`` words from each given place on, or from every place."""
    factor = np.uint64(_FACTORS[lane])
    out = np.full(len(words) - width + 1 if first is None else len(first), width, np.uint64)
    for j in range(width):
        out ^= words[j : len(words) - width + 1 + j] if first is None else words[first + j]
        out *= factor
        out ^= out >> np.uint64(29)
    return _mix(out, factor)


class Words:
    """The words of many texts: the texts folded (see FOLD) one after the other, where each word begins and ends, and for
    each text the number of its first word, with the number of all words at the end."""

    def __init__(self, texts: list[bytes | None], fold: bytes = FOLD) -> None:
        folded = [(t or b"").translate(fold) for t in texts]
        self.data = b" " + b" ".join(folded) + b" " * 8
        gap = np.frombuffer(self.data, np.uint8) == 32
        self.begin, self.end = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        self.base = np.searchsorted(self.begin, np.cumsum([1, *(len(t) + 1 for t in folded)]))
        self.count = np.diff(self.base)

    def prints(self, lane: int = 0) -> np.ndarray:
        return _words(self.data, self.begin, self.end, lane)

    def places(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The words at which runs of ``width`` words of one text begin, and their texts."""
        text = np.repeat(np.arange(len(self.count)), self.count)
        at = np.flatnonzero(np.arange(len(text)) + width <= self.base[1:][text])
        return at, text[at]


def shingle_sets(texts: list[bytes | None], width: int = 5, lanes: int = 1) -> list[np.ndarray]:
    """For each text the sorted distinct fingerprints of its shingles of ``width`` words; of all its words as one, if they
    are fewer; none, if it has no words. With two lanes a row holds the second fingerprint after the first."""
    own = Words(texts)
    base, count, got = own.base, own.count, []
    for lane in range(lanes):
        words = own.prints(lane)
        rows = sequences(words, None, width, lane) if len(words) >= width else np.empty(0, np.uint64)
        few = {n: sequences(words, base[:-1][count == n], n, lane) for n in range(1, width)}
        got.append((rows, few))
    out = []
    at = dict.fromkeys(range(1, width), 0)
    for n, b in zip(count.tolist(), base.tolist(), strict=False):
        if not n:
            out.append(np.empty((0, 2) if lanes == 2 else 0, np.uint64))
            continue
        if n < width:
            own = [few[n][at[n] : at[n] + 1] for _, few in got]
            at[n] += 1
        else:
            own = [rows[b : b + n - width + 1] for rows, _ in got]
        if lanes == 1:
            out.append(np.unique(own[0]))
        else:
            order = np.lexsort((own[1], own[0]))
            both = np.stack([own[0][order], own[1][order]], axis=1)
            out.append(both[np.concatenate(([True], (both[1:] != both[:-1]).any(1)))])
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles two sets with two fingerprints a shingle have in common."""
    both = np.concatenate((a, b))
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    return int((both[1:] == both[:-1]).all(1).sum())


def set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity_bits(hashes: np.ndarray) -> bytes:
    """For each of b buckets (a power of two, twice the set's size or more) the parity of the hashes in it. Two sets
    differ in at least as many elements as their bits differ."""
    b = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits that differ, after the longer is folded to the shorter's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
