"""Suffix arrays by induced sorting, and permuted common prefixes, on arrays.

A suffix is smaller (S) or larger (L) than the one after it; the leftmost S suffixes after an L one
order all others. The substrings between them are sorted by inducing from their first letters and
named by rank. If names repeat, the string of names is sorted by joining names, of one substring, of
two, of four and so on: there are about as many names as places, and inducing over a bucket for each
would move nothing at once. Inducing walks over the buckets of letters, and moves whole batches of a
bucket at a time.
"""

from __future__ import annotations

import numpy as np

LETTERS = 256
SHORT = 512


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last is."""
    up = np.ones(len(text), dtype=bool)
    up[:-1] = text[:-1] < text[1:]
    decided = np.ones(len(text), dtype=bool)
    decided[:-1] = text[:-1] != text[1:]
    # Equal letters have the type of the next place where letters differ.
    at = np.where(decided, np.arange(len(text), dtype=np.int32), np.int32(len(text)))
    return up[np.minimum.accumulate(at[::-1])[::-1]]


class _Sorter:
    def __init__(self, text: np.ndarray):
        self.text, self.small = text, _types(text)
        self.sizes = np.bincount(text, minlength=LETTERS)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.leftmost = self.small.copy()
        self.leftmost[0] = False
        self.leftmost[1:] &= ~self.small[:-1]
        self.used = np.flatnonzero(self.sizes).tolist()

    def _grouped(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places by letter in their order, the letters, counts, and places among the same letter."""
        letters = self.text[before]
        order = np.argsort(letters, kind="stable")
        letters = letters[order]
        counts = np.bincount(letters, minlength=LETTERS)
        return before[order], letters, counts, np.arange(len(order)) - (np.cumsum(counts) - counts)[letters]

    def induced(self, leftmost: np.ndarray) -> np.ndarray:
        """All suffixes in order, if the leftmost small ones are given in order."""
        text, small = self.text, self.small
        out = np.empty(len(text), dtype=np.int32)
        seeds, letters, counts, rank = self._grouped(leftmost)
        seed_starts = self.ends - counts
        out[seed_starts[letters] + rank] = seeds
        seed_starts, ends = seed_starts.tolist(), self.ends.tolist()
        # Larger suffixes, from the left.
        fill, starts = self.starts.copy(), self.starts.tolist()
        for c in self.used:
            done = starts[c]
            while True:
                upto = int(fill[c])
                batch = out[done:upto] if done < upto else out[seed_starts[c] : ends[c]]
                before = batch - 1
                before = before[(batch > 0) & ~small[before]]
                if len(before):
                    before, letters, counts, rank = self._grouped(before)
                    out[fill[letters] + rank] = before
                    fill += counts
                if done >= upto:
                    break
                done = upto
        larger_ends = fill.tolist()
        # Smaller suffixes, from the right; they replace the seeds.
        fill = self.ends.copy()
        for c in reversed(self.used):
            done = ends[c]
            while True:
                downto = int(fill[c])
                batch = out[downto:done] if downto < done else out[starts[c] : larger_ends[c]]
                batch = batch[::-1]
                before = batch - 1
                before = before[(batch > 0) & small[before]]
                if len(before):
                    before, letters, counts, rank = self._grouped(before)
                    out[fill[letters] - 1 - rank] = before
                    fill -= counts
                if downto >= done:
                    break
                done = downto
        return out


def _names(text: np.ndarray, ordered: np.ndarray, leftmost: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the substrings between leftmost small suffixes, in text order; equal ones share a rank."""
    following = np.append(leftmost[1:], len(text) - 1)
    length = np.zeros(len(text), dtype=np.int32)
    length[leftmost] = following - leftmost + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    at = np.flatnonzero(same)
    left, last, k = a[at], length[a[at]], 0
    right = b[at]
    while len(at):  # letter by letter, while pairs still agree
        equal = text[left + k] == text[right + k]
        same[at[~equal]] = False
        go = equal & (last > k + 1)
        at, left, right, last, k = at[go], left[go], right[go], last[go], k + 1
    rank = np.empty(len(text), dtype=np.int32)
    rank[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return rank[leftmost], int(len(ordered) - same.sum())


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names.

    Names of single substrings are joined to names of two, of four and so on; each round orders
    only what still shares a name. (Going down by inducing again would need a bucket for each
    name, of which there are too many to move batches.)
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    sorted_ = names[order]
    head = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    tied = np.repeat(np.diff(np.append(head, n)) > 1, np.diff(np.append(head, n)))
    at = np.flatnonzero(tied)  # places in the order that are still shared
    step = 1
    while len(at):
        own = order[at]
        key = rank[own] * (n + 1) + rank[np.minimum(own + step, n)] + 1
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[at] = own
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        rank[own] = np.repeat(at[first], sizes)
        at = at[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order; its letters are ``uint8``, the last a 0 and no other."""
    if len(text) <= SHORT:
        whole = text.tobytes()
        return np.array(sorted(range(len(text)), key=lambda i: whole[i:]), dtype=np.int32)
    sorter = _Sorter(text)
    leftmost = np.flatnonzero(sorter.leftmost).astype(np.int32)
    ordered = sorter.induced(leftmost)
    ordered = ordered[sorter.leftmost[ordered]]
    names, different = _names(text, ordered, leftmost)
    if different < len(leftmost):
        ordered = leftmost[_order_of_names(names)]
    return sorter.induced(ordered)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """By place in the text: the suffix before it in order, and the prefix they share, up to ``most`` letters.

    Where the letters in front agree as well, a prefix is one shorter than that of the place in
    front; only the other places are compared, eight letters at a time.
    """
    n = len(text)
    before = np.empty(n, dtype=np.int32)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    here = np.arange(n)
    compared = (before <= 0) | (here == 0)
    rest = ~compared
    compared[rest] = text[here[rest] - 1] != text[before[rest] - 1]
    # The first suffix in order has no neighbour, and the place behind it starts anew.
    compared[1:] |= before[:-1] < 0
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(n,), strides=(1,))
    at = np.flatnonzero(compared & (before >= 0))
    shared = np.zeros(n, dtype=np.int32)
    shared[at] = _agreeing(words, at, before[at], np.zeros(len(at), np.int64), most)
    # Behind a prefix that reached ``most`` it is open how much longer it is.
    start = np.maximum.accumulate(np.where(compared, here, 0))
    open_ = ~compared & (shared[start] >= most)
    shared = np.maximum(shared[start] - (here - start), 0).astype(np.int32)
    shared[before < 0] = 0
    at = np.flatnonzero(open_)
    shared[at] = _agreeing(words, at, before[at], shared[at].astype(np.int64), most)
    return before, shared


def _agreeing(words: np.ndarray, one: np.ndarray, two: np.ndarray, k: np.ndarray, most: int) -> np.ndarray:
    """Letters that agree from pairs of places on, ``k`` of which are known to, up to ``most``."""
    out = np.minimum(k, most)
    left = np.arange(len(k))
    one, two, n = one.astype(np.int64), two.astype(np.int64), len(words)
    while len(left):
        inside = (np.maximum(one, two) + k < n) & (k < most)
        left, one, two, k = left[inside], one[inside], two[inside], k[inside]
        differ = words[one + k] ^ words[two + k]
        whole = differ == 0
        lowest = differ & (~differ + np.uint64(1))
        out[left] = np.minimum(k + np.where(whole, 8, np.bitwise_count(lowest - np.uint64(1)) // 8), most)
        left, one, two, k = left[whole], one[whole], two[whole], k[whole] + 8
    return out
