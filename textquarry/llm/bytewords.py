"""Words of many texts at once, as numbers: one pass of array operations over the joined bytes.

A word's number is a polynomial over its bytes (each byte first mapped to a
random 64-bit number), taken from running sums over pieces of PIECE bytes, so
that no Python object is made for a word, and a text of any length takes a few
bytes a byte. A word across pieces gets its number from those of its parts.
Numbers are mixed before use. Two of a corpus's words share a number with a
chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are joined into blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes that are numbered at once.
PIECE = 1 << 18

U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def _powers(base: int) -> np.ndarray:
    out = np.ones(PIECE, np.uint64)
    n, step = 1, base
    while n < PIECE:
        out[n : 2 * n] = out[:n] * U(step)
        n, step = 2 * n, step * step % 2**64
    return out


#: Powers of the multiplier and of its inverse, 4 MB of both.
_PLUS, _MINUS = _powers(_MULT), _powers(pow(_MULT, -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first text, encoded texts), about BLOCK_BYTES at a time; null is empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if held and size + len(b) > BLOCK_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


class Words:
    """The words of a block of texts. number: of each word; bounds: words[bounds[i]:bounds[i+1]] are those of text i; offset: where texts begin in joined, and the end."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.joined = joined = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        self.offset = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offset[1:])
        self.offset += 1
        numbers, bounds = [], np.zeros(len(texts) + 1, np.int64)
        # The word that the last piece left open: its number so far, and its length.
        open_value, open_length, n = U(0), 0, 0
        for begin in range(0, len(joined), PIECE):
            x = joined[begin : begin + PIECE]
            x = _LOWER[x] if lower else x
            word = ~IS_SPACE[x]
            edge = np.flatnonzero(word[1:] != word[:-1]) + 1
            edge = np.concatenate([[0] if word[0] else [], edge, [len(x)] if word[-1] else []]).astype(np.int64)
            start, stop = edge[::2], edge[1::2]
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(_BYTE[x] * _PLUS[: len(x)], out=total[1:])
            value, length = (total[stop] - total[start]) * _MINUS[np.minimum(start, PIECE - 1)], stop - start
            if open_length and word[0]:
                value[:1] = open_value + value[:1] * U(pow(_MULT, open_length, 2**64))
                length[0] += open_length
            elif open_length:
                value, length = np.concatenate([[open_value], value]), np.concatenate([[open_length], length])
            # Words that begin before a text does, the open one among them.
            here = slice(*np.searchsorted(self.offset, [begin, begin + len(x)]))
            behind = int(open_length > 0 and not word[0])
            bounds[here] = n + behind + np.searchsorted(start, self.offset[here] - begin)
            open_length = int(length[-1]) if word[-1] else 0
            if open_length:
                open_value, value, length = value[-1], value[:-1], length[:-1]
            n += len(value)
            numbers.append(mixed(value + length.astype(np.uint64)))
        bounds[self.offset >= len(joined)] = n
        self.number, self.bounds = np.concatenate(numbers) if numbers else np.zeros(0, np.uint64), bounds

    def triples(self) -> np.ndarray:
        """A number for each word and the two after it, also where these are of the next text."""
        n = self.number
        out = np.zeros(max(len(n) - 2, 0), np.uint64)
        for i in range(0, len(out), PIECE):
            x = n[i : i + PIECE + 2]
            out[i : i + PIECE] = mixed(x[:-2] * U(0xD6E8FEB86659FD93) + mixed(x[1:-1] + U(0xA0761D6478BD642F)) * U(0xE7037ED1A0B428DB) + mixed(x[2:] ^ U(0x8EBC6AF09C88C6E3)))
        return out
