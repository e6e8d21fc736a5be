"""Word and word-shingle hashes of UTF-8 texts, vectorised over many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at a time; a longer text is cut at white space, so memory follows this and the longest word.
CHUNK = 1 << 20
_LENGTH = np.uint64(0xA24BAED4963EE407)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_VALUE[_SPACE] = 0
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Also turns ASCII punctuation into spaces, for term features.
TERMS = bytes(_LOWER[b] if b >= 128 or chr(b).isalnum() or chr(b) in "'_" else 0x20 for b in range(256))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(size, base & _MASK, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _powers = made[0], made[1]
    return _powers


def _words(buffer: bytes, prefixes=()) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a buffer; then also of the first so many bytes of longer words."""
    a = np.frombuffer(buffer, np.uint8)
    space = _SPACE[a]
    before = np.empty_like(space)
    before[:1], before[1:] = True, space[:-1]
    starts = np.flatnonzero(before & ~space)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    after = np.empty_like(space)
    after[-1:], after[:-1] = True, space[1:]
    lengths = np.flatnonzero(after & ~space) + 1 - starts
    up, down = _power_tables(len(a) + 1)
    sums = np.add.reduceat(_VALUE[a] * up[: len(a)], starts)
    found = [(starts, mix(sums * down[starts] + lengths.astype(np.uint64) * _LENGTH))]
    at, sums = starts, np.zeros(len(starts), np.uint64)
    for i in range(max(prefixes, default=0)):
        long = lengths > i
        at, lengths, sums = at[long], lengths[long], sums[long]
        sums = sums + _VALUE[a[at + i]] * up[i]
        if i + 1 in prefixes:
            found.append((at, mix(sums ^ mix(np.full(1, i + 1, np.uint64)))))
    return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if prefixes else found[0]


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > CHUNK:
        cut = max(text.rfind(c, at, at + CHUNK) for c in (b" ", b"\n"))
        if cut <= at:
            cut = min((x for x in (text.find(c, at + CHUNK) for c in (b" ", b"\n")) if x >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def words(texts, table: bytes = _LOWER) -> Iterator[np.ndarray]:
    """For each text (None: no words) the hashes of its words, in order."""
    held: list[bytes] = []
    size = 0

    def flush():
        starts, hashes = _words(b" ".join(held))
        ends = np.cumsum([len(t) + 1 for t in held])
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").translate(table) if not isinstance(text, bytes) else text.translate(table)
        if len(data) > CHUNK:
            if held:
                yield from flush()
                held, size = [], 0
            yield np.concatenate([_words(p)[1] for p in _pieces(data)])
            continue
        if size + len(data) > CHUNK and held:
            yield from flush()
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield from flush()


def buckets(texts, bits: int, prefixes=(), slot: np.ndarray | None = None, table: bytes = TERMS) -> Iterator[np.ndarray]:
    """For each text the distinct hash buckets of its words and their beginnings, or the slots that slot gives them (negative: none)."""
    held: list[bytes] = []
    size = 0

    def of(buffer: bytes, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, hashes = _words(buffer, prefixes)
        found = (hashes >> np.uint64(64 - bits)).astype(np.int32)
        text = np.searchsorted(heads, starts, side="right") - 1
        if slot is not None:
            found = slot[found]
            text, found = text[found >= 0], found[found >= 0]
        return text, found

    def flush():
        heads = np.cumsum([0] + [len(t) + 1 for t in held[:-1]])
        text, found = of(b" ".join(held), heads)
        both = (text.astype(np.int64) << 32) | found  # sorted at once over all texts, and each pair once
        both.sort()
        both = both[np.diff(both, prepend=-1) != 0]
        yield from np.split((both & 0xFFFFFFFF).astype(np.int32), np.searchsorted(both >> 32, np.arange(1, len(held))))

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").translate(table)
        if held and size + len(data) > CHUNK:
            yield from flush()
            held, size = [], 0
        if len(data) > CHUNK:
            yield np.unique(np.concatenate([of(p, np.zeros(1, np.int64))[1] for p in _pieces(data)]))
            continue
        held.append(data)
        size += len(data) + 1
    if held:
        yield from flush()


_STEP = mix(np.arange(11, 75, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes; fewer words are one shingle, none is empty."""
    for w in words(texts):
        n = len(w)
        if not n:
            yield w
        elif n < k:
            yield mix((w * _STEP[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            s = w[: n - k + 1] * _STEP[0]
            for i in range(1, k):
                s = s + w[i : n - k + 1 + i] * _STEP[i]
            yield np.unique(mix(s))
