"""Plain Python forms of the operators, for small tables."""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None, lower: bool = True) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text: str | None) -> frozenset:
    w = words(text)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def component_rows(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int, int | None]]:
    """(doc_id, set size, smallest linked id) of each row; all pairs that share a shingle are tried."""
    last = 1 << 63
    lowest: dict[frozenset, int] = {}
    for doc_id, text in rows:
        s = shingles(text)
        lowest[s] = min(last if doc_id is None else doc_id, lowest.get(s, last))
    sets = [s for s in lowest if s]
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in at[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, s in enumerate(sets):
        least[find(i)] = min(lowest[s], least.get(find(i), last))
    which = {s: least[find(i)] for i, s in enumerate(sets)}
    out = []
    for doc_id, text in rows:
        c = which.get(shingles(text), doc_id)
        out.append((doc_id, len(shingles(text)), None if c == last else c))
    return out


def components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest linked id), of rows whose ids differ or repeat with equal texts."""
    return {i: (n, c) for i, n, c in component_rows(rows)}


def hash_long(value: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed=seed & (1 << 64) - 1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None) -> list[int]:
    """The 5-word shingles' hashes in order, as Spark's xxhash64 gives them."""
    split = [w for w in re.split("[ \t-\r]+", (text or "").lower()) if w]
    h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in split]
    out = []
    for i in range(len(h) - 4):
        seed = 42
        for x in h[i : i + 5]:
            seed = hash_long(x, seed)
        out.append(signed(seed))
    return out


def simhash(items: list[int]) -> int:
    return sum(1 << b for b in range(64) if sum(1 if x >> b & 1 else -1 for x in items) > 0)


def fingerprint(items: list[int]) -> int:
    """128 bits: the hashes' own and those of their hashes."""
    return simhash(items) | simhash([hash_long(x, 42) for x in items]) << 64


def leaks(docs, items, percent: int, radius: int) -> tuple[dict, dict]:
    """{(doc_id, item_id): best similarity} over all windows of each document: those with a fingerprint in the radius, and all."""
    wanted = [(i, ys := shingle_hashes(t), Counter(ys), fingerprint(ys)) for i, t in items if len(words(t)) >= 5]
    near, every = {}, {}
    for doc_id, text in docs:
        xs = shingle_hashes(text)
        for item, ys, weights, fp in wanted:
            if len(set(xs) & set(ys)) * 100 < percent * len(set(ys)) * 0.5:
                continue
            for first in range(1 - len(ys), len(xs)):
                w = xs[max(first, 0) : first + len(ys)]
                c = sum((Counter(w) & weights).values())
                if c * 100 >= (len(w) + len(ys) - c) * percent:
                    every[doc_id, item] = max(every.get((doc_id, item), 0), c / (len(w) + len(ys) - c))
                    if (fingerprint(w) ^ fp).bit_count() <= radius:
                        near[doc_id, item] = max(near.get((doc_id, item), 0), c / (len(w) + len(ys) - c))
    return near, every


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text, lower=False)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    inside = {i + j for i, g in enumerate(windows) if often[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def best_fit_bins(lengths: list[int], capacity: int) -> int:
    """Bins that best-fit decreasing opens, one piece after the other."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def held_out(doc_id: int | None, mod: int, rest: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % mod == rest


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
