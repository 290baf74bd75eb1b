"""Pairs of similar names of two blocks, as a helper of the joins in operators/matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from rosterlake.functions.similarity import _of_pairs

#: Rows of the walk's front that are grown at once, and entries of a table of masks.
FRONT, MASKS = 1 << 18, 1 << 22
_LOW = np.array([(1 << i) - 1 for i in range(65)], np.uint64)


def _letters(names: list[str]) -> np.ndarray:
    return np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)


def _prefixes(letters: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of distinct sorted names of one length, a row each: the first rows of the distinct prefixes of every length,
    and where among the prefixes one letter longer those of each prefix begin."""
    n, size = letters.shape
    differs = letters[1:] != letters[:-1]
    shared = np.concatenate([[-1], differs.argmax(1)]) if n > 1 else np.array([-1])
    starts = [np.flatnonzero(shared < d) for d in range(size + 1)]
    return starts, [np.searchsorted(starts[d + 1], np.append(starts[d], n)) for d in range(size)]


def _common(v: np.ndarray, width: np.ndarray) -> np.ndarray:
    """How many of the lowest width bits of each row of words are zero."""
    total = np.zeros(len(v), np.int64)
    for w in range(v.shape[1]):
        total += np.bitwise_count(~v[:, w] & _LOW[np.clip(width - 64 * w, 0, 64)])
    return total


def _grown(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The bit vectors of the common subsequences after one more letter, whose places are m."""
    u, out, carry = v & m, np.empty_like(v), np.zeros(len(v), np.uint64)
    for w in range(v.shape[1]):
        part = v[:, w] + u[:, w]
        total = part + carry
        carry = ((part < u[:, w]) | (total < part)).astype(np.uint64)
        out[:, w] = total | (v[:, w] & ~m[:, w])
    return out


def _walk(letters: np.ndarray, masks: np.ndarray, sizes: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asked, row, common) where the name of a row has a common subsequence of need letters or more with an asked one.

    All asked names go down the prefixes of the rows together. One leaves a prefix when not even all letters that
    follow could bring it to its need. The front is grown a bounded number of rows at a time, deepest first.
    """
    starts, first = _prefixes(letters)
    size = letters.shape[1]
    here = np.flatnonzero(need <= np.minimum(sizes, size))
    stack = [(0, here, np.zeros(len(here), np.int64), np.full((len(here), masks.shape[2]), ~np.uint64(0)), np.zeros(len(here), np.int64))]
    while stack:
        depth, asked, node, v, reach = stack.pop()
        if depth == size or not len(asked):
            if len(asked):
                yield asked, node, reach
            continue
        lo = first[depth][node]
        n = first[depth][node + 1] - lo
        if len(asked) > 1 and n.sum() > FRONT:
            half = len(asked) // 2
            stack += [(depth, asked[s], node[s], v[s], reach[s]) for s in (slice(half), slice(half, None))]
            continue
        at = np.repeat(np.arange(len(asked)), n)
        child = np.arange(len(at)) + np.repeat(lo - np.cumsum(n) + n, n)
        asked = asked[at]
        v = _grown(v[at], masks[asked, letters[starts[depth + 1][child], depth]])
        rest = size - depth - 1
        # the most that can come of it: the letters that follow match the end of the asked name
        head = np.maximum(0, sizes[asked] - rest)
        reach = _common(v, head) + sizes[asked] - head
        stay = np.flatnonzero(reach >= need[asked])
        stack.append((depth + 1, asked[stay], child[stay], v[stay], reach[stay]))


def pairs(asked: pd.DataFrame, known: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asked row, known row, score) of the pairs whose score reaches the asked name's floor.

    Both have n, not empty, and tokens, n with its words in order; known names are distinct. For asked names with whole,
    the shorter name is also to stand in the longer one as a whole, as a subsequence.
    """
    names, tokens = known["n"].to_numpy(object), known["tokens"].to_numpy(object)
    alphabet = np.unique(_letters(list(names)))
    length = np.fromiter(map(len, names), np.int64, len(names))
    rows_of = {size: np.array(sorted(np.flatnonzero(length == size), key=names.__getitem__)) for size in np.unique(length).tolist()}
    letters_of = {size: np.searchsorted(alphabet, _letters(list(names[rows]))).reshape(len(rows), size) for size, rows in rows_of.items()}
    of, of_tokens, floors, whole = asked["n"].to_numpy(object), asked["tokens"].to_numpy(object), asked["floor"].to_numpy(float), asked["whole"].to_numpy(bool)
    sizes = np.fromiter(map(len, of), np.int64, len(of))
    of_in_order, in_order = (np.fromiter((x == y for x, y in zip(*both)), bool) for both in ((of, of_tokens), (names, tokens)))
    by_size = np.argsort(sizes, kind="stable")  # names of like length share the number of words
    lo = 0
    while lo < len(of):
        words = int(sizes[by_size[min(len(of) - 1, lo + 1023)]] + 63) // 64
        some = by_size[lo : lo + max(1, min(1024, MASKS // (len(alphabet) * words)))]
        lo += len(some)
        masks = np.zeros((len(some), len(alphabet), words), np.uint64)
        each = np.repeat(np.arange(len(some)), sizes[some])
        place = np.arange(len(each)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        letter = _letters(list(of[some]))
        found = np.minimum(np.searchsorted(alphabet, letter), len(alphabet) - 1)
        ok = alphabet[found] == letter
        np.bitwise_or.at(masks, (each[ok], found[ok], place[ok] // 64), np.uint64(1) << (place[ok] % 64).astype(np.uint64))
        for size, rows in rows_of.items():
            both = sizes[some] + size
            need = np.maximum(np.ceil(both * floors[some] / 200 - 1e-9).astype(np.int64), np.where(whole[some], np.minimum(sizes[some], size), 0))
            for a, r, common in _walk(letters_of[size], masks, sizes[some], need):
                score = 200.0 * common / both[a]
                a, r = some[a], rows[r]
                mixed = np.flatnonzero(~(of_in_order[a] & in_order[r]))
                if len(mixed):
                    score[mixed] = np.minimum(score[mixed], _of_pairs(pd.Series(of_tokens[a[mixed]], dtype=object), pd.Series(tokens[r[mixed]], dtype=object)))
                reached = np.flatnonzero(score >= floors[a])
                yield a[reached], r[reached], score[reached]


def all_pairs(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """scope, n, other, score of the pairs that reach the floor."""
    a, r, score = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *pairs(asked, known)))
    return pd.DataFrame({"scope": asked["scope"].to_numpy(object)[a], "n": asked["n"].to_numpy(object)[a], "other": known["n"].to_numpy(object)[r], "score": score})


def best_pairs(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """scope, n, score, id of the best pair of each asked name; equal scores go to the smaller id."""
    ids = known["id"].to_numpy(np.int64)
    top, best = np.full(len(asked), -1.0), np.zeros(len(asked), np.int64)
    for a, r, score in pairs(asked, known):
        order = np.lexsort((ids[r], -score, a))
        a, score, id_ = a[order], score[order], ids[r][order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        a, score, id_ = a[first], score[first], id_[first]
        better = (score > top[a]) | ((score == top[a]) & (id_ < best[a]))
        top[a[better]], best[a[better]] = score[better], id_[better]
    hit = np.flatnonzero(top >= 0)
    return pd.DataFrame({"scope": asked["scope"].to_numpy(object)[hit], "n": asked["n"].to_numpy(object)[hit], "score": top[hit], "id": best[hit]})
