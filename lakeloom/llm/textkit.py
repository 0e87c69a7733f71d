"""Vectorised byte, word and window hashing over batches of texts.

All hashes are computed with numpy over one byte buffer that holds many documents, so that no
Python code runs per word. A buffer holds at most about ``CHUNK`` bytes, which bounds the memory of a worker: runs()
groups short texts and leaves a longer one alone, and pieces() cuts that between words into pieces that overlap by as many words
as a window needs. A single word that is longer is hashed chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C17 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words ``[^\x20\x09-\x0D]+``
BLANK_WORD = np.ones(256, dtype=bool)
BLANK_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z)
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse; grown when asked for more."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, _U), np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(_inverse(self.base), k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_P), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (new array)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Grams:
    """Hash of any byte range of a buffer, from prefix sums of a polynomial hash."""

    def __init__(self, buf: np.ndarray, salt: int = 0):
        up, self.down = _BYTES.upto(len(buf) + 1)
        table = BYTE if not salt else mix(BYTE + _U(salt)) | _U(1)
        self.sums = np.zeros(len(buf) + 1, _U)
        np.cumsum(table[buf] * up[: len(buf)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(_U))

    def every(self, n: int) -> np.ndarray:
        """Of all ranges of n bytes, by start."""
        k = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:k]) * self.down[:k] + _U(n))


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Grams(buf).of(starts, ends) for ascending starts and ends, with CHUNK prefix sums at a time."""
    table, size = BYTE, CHUNK
    up, down = _BYTES.upto(size + 1)
    at_start, at_end, back = np.zeros(len(starts), _U), np.zeros(len(ends), _U), np.ones(len(starts), _U)
    total, step, undo = 0, 1, 1
    for a in range(0, len(buf) + 1, size):
        part = buf[a : a + size]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(table[part] * up[: len(part)] * _U(step), out=sums[1:])
        sums += _U(total)
        for at, out in ((starts, at_start), (ends, at_end)):
            here = slice(*np.searchsorted(at, [a, a + size]))
            out[here] = sums[at[here] - a]
            if at is starts:
                back[here] = down[at[here] - a] * _U(undo)
        total = int(sums[-1])
        step, undo = step * pow(_P, size, 1 << 64) % (1 << 64), undo * pow(_inverse(_P), size, 1 << 64) % (1 << 64)
    return mix((at_end - at_start) * back + (ends - starts).astype(_U))


def block_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0, step: int = 1 << 18) -> np.ndarray:
    """Hashes of byte ranges from non-linear mixes of their 8-byte blocks, `step` blocks at a time. Unlike polynomials modulo 2**64 they have no
    structured words that collide whatever the base; hashes of two salts are independent."""
    size = ends - starts
    counts = -(-size // 8)
    first = np.cumsum(counts) - counts
    out = np.zeros(len(starts), _U)
    if not len(starts):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    for a in range(0, int(counts.sum()), step):
        k = np.arange(a, min(a + step, int(counts.sum())))
        own = np.searchsorted(first, k, "right") - 1 if a or len(k) == step else np.repeat(np.arange(len(starts)), counts)
        j = k - first[own]
        left = np.minimum(size[own] - 8 * j, 8).astype(_U)
        block = words[starts[own] + 8 * j] & (~_U(0) >> (_U(64) - left * _U(8)))
        block = mix(block + (j + 1).astype(_U) * _U(_P) + _U(salt * 0x5851F42D4C957F2D % (1 << 64)))
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[new]] += np.add.reduceat(block, new)
    return mix(out + size.astype(_U) * _U(_Q))


class Words:
    """The words of some texts: byte ranges, hashes, and the first word of each text (``first``, one more than texts)."""

    def __init__(self, texts: list[bytes], kind: np.ndarray, lower: bool = False):
        self.buf = np.frombuffer(b"\n".join(texts), np.uint8) if texts else np.zeros(0, np.uint8)
        data = LOWER[self.buf] if lower else self.buf
        self.data = data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_start = np.cumsum(lengths + 1) - lengths - 1
        self.text_end = self.text_start + lengths
        self.first = np.append(np.searchsorted(self.starts, self.text_start), len(self.starts))
        self._hash: np.ndarray | None = None
        self._grams: Grams | None = None

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, both ascending."""
        if len(self.data) > 2 * CHUNK:
            return range_hashes(self.data, starts, ends)
        if self._grams is None:
            self._grams = Grams(self.data)
        return self._grams.of(starts, ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.ranges(self.starts, self.ends)
        return self._hash

    def text_of(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def _window_words(self, salt: int) -> np.ndarray:
        return mix(self.hash ^ _U(salt * 0x5851F42D4C957F2D)) if salt else self.hash

    def windows(self, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Starts (numbers of words) and hashes of the n-word windows that lie in one text. Another salt gives hashes that are independent
        but for words with equal hashes."""
        h = self._window_words(salt)
        m = len(h)
        if m < n:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        up, down = _WORDS.upto(m + 1)
        sums = np.zeros(m + 1, _U)
        np.cumsum(h * up[:m], out=sums[1:])
        k = m - n + 1
        at = np.arange(k)
        end = np.repeat(self.first[1:], self.counts)[:k]
        at = at[at + n <= end]
        return at, mix((sums[at + n] - sums[at]) * down[at] + _U(n))

    def whole(self, which: np.ndarray) -> np.ndarray:
        """Hash of the whole word sequence of the texts numbered in which, as windows() has for that length."""
        h = self.hash
        up, down = _WORDS.upto(len(h) + 1)
        sums = np.zeros(len(h) + 1, _U)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        a, b = self.first[which], self.first[which + 1]
        return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(_U))


class MixedWords(Words):
    """Words hashed by block_hashes(): different words have different hashes but for chance, and two salts are independent."""

    def __init__(self, texts: list[bytes], kind: np.ndarray, lower: bool = False):
        super().__init__(texts, kind, lower)
        self._salted: dict[int, np.ndarray] = {}

    def _of(self, salt: int) -> np.ndarray:
        if salt not in self._salted:
            self._salted[salt] = block_hashes(self.data, self.starts, self.ends, salt)
        return self._salted[salt]

    @property
    def hash(self) -> np.ndarray:
        return self._of(0)

    def _window_words(self, salt: int) -> np.ndarray:
        return self._of(salt)


def runs(texts: Iterable[bytes], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts in groups of up to about `most` bytes, each with the number of its first text."""
    group: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        if group and size + len(t) > most:
            yield first, group
            group, first, size = [], i, 0
        group.append(t)
        size += len(t) + 1
    if group:
        yield first, group


def pieces(group: list[bytes], kind: np.ndarray, after: int, lower: bool = False, most: int | None = None) -> Iterator[tuple[list[bytes], int | None]]:
    """A group of runs() as it is, with None; or its one long text cut between words: each piece with `after` more words, and the number of
    its bytes that no later piece has. A window of after + 1 words lies in exactly one piece."""
    most = CHUNK if most is None else most
    if len(group) != 1 or len(group[0]) <= most:
        yield group, None
        return
    text = group[0]
    buf = np.frombuffer(text, np.uint8)
    inside = kind[LOWER] if lower else kind

    def gap(at: int) -> int:
        """The first place from `at` on that is in no word."""
        while at < len(buf):
            out = np.flatnonzero(~inside[buf[at : at + (1 << 16)]])
            if len(out):
                return at + int(out[0])
            at += 1 << 16
        return len(buf)

    def beyond(at: int) -> int:
        """Where `after` more words have ended."""
        reach = 64 * (after + 1)
        while after and at + reach < len(buf):
            edge = np.flatnonzero(np.diff(inside[buf[at : at + reach]].astype(np.int8), prepend=0) == -1)
            if len(edge) >= after:
                return at + int(edge[after - 1])
            reach *= 4
        return len(buf) if after else at

    a = 0
    while a < len(text):
        cut = gap(a + most)
        yield [text[a : beyond(cut)]], cut - a
        a = cut


def word_counts(group: list[bytes], kind: np.ndarray = BLANK_WORD, lower: bool = False) -> list[int]:
    """Words of each text of a group of runs()."""
    found = [(Words(part, kind, lower).counts, cut) for part, cut in pieces(group, kind, 0, lower)]
    return found[0][0].tolist() if found[0][1] is None else [int(sum(n[0] for n, _ in found))]


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 byte strings; null counts as empty."""
    return list(each_bytes(column))


def each_bytes(column) -> Iterator[bytes]:
    """as_bytes() one by one."""
    import pyarrow as pa

    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for k in range(0, len(column), 64):
        yield from (x or b"" for x in column[k : k + 64].to_pylist())


SLICE = 8 << 20


def slices(batches, column: str = "text", most: int | None = None):
    """Record batches cut into such of at most about `most` bytes of text, which bounds what a worker holds of them."""
    import pyarrow.compute as pc

    most = SLICE if most is None else most
    for b in batches:
        if b.num_rows:
            at = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                yield b.slice(i, j - i)
        else:
            yield b


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    if w == 1 or n <= 0:
        return x[: max(n, 0)]
    full = np.full(-(-len(x) // w) * w, ~_U(0), _U)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Boolean mask of the places that lie in any range [start, end)."""
    if not len(starts):
        return np.zeros(size, bool)
    return np.cumsum(np.bincount(starts, minlength=size + 1)[:size] - np.bincount(ends, minlength=size + 1)[:size]) > 0
