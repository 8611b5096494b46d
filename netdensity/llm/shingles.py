"""Sets of word shingles as 64-bit hashes, for many texts at a time.

Words are parted by ASCII white space and compared without the case of A-Z. A word's hash is a polynomial over its bytes,
mixed; a shingle's is a sum of its words' hashes, each times a factor of its place, mixed again.

Defined results: a text with fewer words than a shingle has one shingle, of all its words; a null or blank text has none;
a long text is one entry like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SHINGLE = 5
#: Bytes of text, about, that are hashed together.
PIECE = 1 << 19
#: Bytes beyond which a word's hash is taken by itself.
LONG_WORD = 4096
U = np.uint64
_FACTOR = U(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(LONG_WORD, _FACTOR))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, in order of value."""
    raw = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    solid = ~_BLANK[data]
    first = np.flatnonzero(solid & np.append(True, ~solid[:-1]))
    n = np.flatnonzero(solid & np.append(~solid[1:], True)) + 1 - first
    if not len(first):
        return [np.zeros(0, U) for _ in texts]
    kept, begin = data[solid], np.cumsum(n) - n
    place = np.minimum(np.arange(len(kept)) - np.repeat(begin, n), LONG_WORD - 1)
    word = mixed(np.add.reduceat((kept.astype(U) + U(1)) * _POWERS[place], begin))
    for w in np.flatnonzero(n > LONG_WORD).tolist():
        word[w] = xxhash.xxh64_intdigest(kept[begin[w] : begin[w] + n[w]].tobytes(), 42)
    factors = mixed(np.arange(1, size + 1, dtype=U)) | U(1)
    total = np.zeros(len(word), U)
    for k in range(min(size, len(word))):
        total[: len(word) - k] += word[k:] * factors[k]
    whole, out, a = mixed(total), [], 0
    for z in np.searchsorted(first, np.cumsum([len(r) + 1 for r in raw])).tolist():
        if z - a >= size:
            out.append(np.unique(whole[a : z - size + 1]))
        else:
            out.append(mixed((word[a:z] * factors[: z - a]).sum(keepdims=True) + U(z - a)) if z > a else np.zeros(0, U))
        a = z
    return out


def of_all(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """``sets`` of a list of any length, a piece at a time."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "")
        if n >= PIECE:
            yield from sets(held, size)
            held, n = [], 0
    if held:
        yield from sets(held, size)


def parity(members: np.ndarray, per: int = 4) -> bytes:
    """A bitmap whose bit b is the parity of the members equal to b modulo its length, a power of two of about ``per`` bits a member.

    The symmetric difference of two sets is never smaller than the number of bits in which their bitmaps of one length differ.
    """
    bits = 1 << max(6, int(per * len(members) - 1).bit_length())
    return np.packbits(np.bincount((members % U(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(bitmap: np.ndarray, length: int) -> np.ndarray:
    """Rows of bitmaps shortened to so many bytes: the parities of a smaller modulus."""
    while bitmap.shape[1] > length:
        half = bitmap.shape[1] // 2
        bitmap = bitmap[:, :half] ^ bitmap[:, half:]
    return bitmap
