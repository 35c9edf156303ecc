"""Word shingles and dart signatures over arrays (runs inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5  # words of a shingle
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789_", *range(0x80, 0x100)]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: np.uint64, count: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < count:
        have = np.full(max(count, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(have)
    return have[:count]


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(element, text number), sorted by text: the multiset of five-word shingles.

    A word is a run of letters, digits, underscores and non-ASCII characters of the
    lowered text.  The n-th occurrence of a shingle is an element of its own, so a set
    similarity of elements is the weighted similarity of shingle counts.  A text of one
    to four words is one shingle.
    """
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    starts_of = np.zeros(len(raw), np.int64)
    np.cumsum([len(r) + 1 for r in raw[:-1]], out=starts_of[1:])
    word = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    begin, end = edge[::2], edge[1::2]
    if len(begin) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * _powers("up", _BASE, len(data)), out=sums[1:])
    words = mix((sums[end] - sums[begin]) * _powers("down", _INVERSE, len(data) + 1)[begin] + np.uint64(1))
    of = np.searchsorted(starts_of, begin, "right") - 1
    counts = np.bincount(of, minlength=len(raw))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    factors = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
    parts = []
    n = len(words) - WORDS + 1
    if n > 0:
        total = np.zeros(n, np.uint64)
        for j in range(WORDS):
            total += words[j : j + n] * factors[j]
        inside = of[:n] == of[WORDS - 1 :]
        parts.append((total[inside], of[:n][inside]))
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
        own = words[first[i] : first[i] + counts[i]]
        parts.append((np.array([(own * factors[: len(own)]).sum(dtype=np.uint64)]) + np.uint64(len(own)), np.array([i])))
    shingle, of = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.lexsort((shingle, of))
    shingle, of = mix(shingle[order]), of[order]
    at = np.arange(len(shingle))
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(shingle + occurrence.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), of


def _throw(cells: np.ndarray, owner: np.ndarray, limit: np.ndarray, width: np.ndarray | None, block: int):
    """Darts (owner, hash, rank) in the regions [0, width) x [0, limit) of the cells.

    Ranks of a cell's darts are the arrivals of a Poisson process of rate 1, so any
    two texts see the same darts in the region that they share.
    """
    base = np.zeros(len(cells))
    step = 0
    out = []
    while len(cells):
        number = np.arange(step + 1, step + block + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        hashed = mix(cells[:, None] + number[None, :])
        rank = base[:, None] + np.cumsum(-np.log(((hashed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1)
        hit = rank < limit[:, None]
        row, col = np.nonzero(hit)
        dart = mix(hashed[row, col] ^ np.uint64(0x5851F42D4C957F2D))
        who, ranks = owner[row], rank[row, col]
        if width is not None:
            across = (mix(dart + np.uint64(1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            inside = across < width[row]
            who, dart, ranks = who[inside], dart[inside], ranks[inside]
        out.append((who, dart, ranks))
        going = hit[:, -1]
        cells, owner, limit, base = cells[going], owner[going], limit[going], rank[going, -1]
        width = None if width is None else width[going]
        step += block
    return out


def signatures(cells: np.ndarray, owner: np.ndarray, count: int, k: int, width: np.ndarray | None = None) -> np.ndarray:
    """(count, k) array of 32-bit coordinates; rows of owners without cells are 0.

    ``width`` gives cells a weight below 1 (a weight of 2.5 is two whole cells and one of
    width 0.5).  Darts are thrown until every coordinate of an owner has one; a
    coordinate keeps the dart of the lowest rank.
    """
    out = np.zeros((count, k), np.uint32)
    weight = np.bincount(owner, weights=width, minlength=count)
    todo = weight > 0
    darts = k * (np.log(k) + 4)
    while todo.any():
        mine = todo[owner]
        own_cells, own = cells[mine], owner[mine]
        limit = darts / weight[own]
        own_width = None if width is None else width[mine]
        many = limit > 8
        thrown = []
        for part, block in ((~many, 2), (many, 64)):
            part_width = None if own_width is None else own_width[part]
            thrown += _throw(own_cells[part], own[part], limit[part], part_width, block)
        who, dart, rank = (np.concatenate([t[i] for t in thrown]) for i in (0, 1, 2))
        place = who * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        late_first = np.argsort(-rank, kind="stable")
        flat, filled = np.zeros(count * k, np.uint32), np.zeros(count * k, bool)
        flat[place[late_first]] = dart[late_first].astype(np.uint32)
        filled[place] = True
        ready = filled.reshape(count, k).all(axis=1) & todo
        out[ready] = flat.reshape(count, k)[ready]
        todo &= ~ready
        darts *= 2
    return out


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) in parts of bounded length."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]
