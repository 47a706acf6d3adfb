"""Links within a group of sets, by dual traversal of a signature tree.

Sets are ordered by size and smallest element, so that like sets stand together. A leaf node covers ``FAN`` sets, an
inner node ``FAN`` nodes; each holds the OR of its sets' token bitmaps, the range of their sizes and the most elements a
bitmap lost to equal bits. A pair of nodes is left when no two of their sets can overlap enough: by sizes, or because
the common bits (plus what equal bits may hide) are too few. Pairs of sets that are left are intersected exactly. Sets
already joined by a chain of links are not compared again.
"""

from __future__ import annotations

import numpy as np

FAN = 8
#: Bytes of the bitmaps of a tree's sets, about, at most: beyond that bitmaps are shorter and lose more to equal bits.
HELD = 64_000_000


class SignatureTree:
    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        self.sets = [sets[i] for i in self.order]
        n = np.array([len(s) for s in self.sets])
        room = 1 << max(1, 8 * HELD // len(n)).bit_length() - 1
        bits = max(256, min(1 << int(4 * n.max() - 1).bit_length(), room))
        maps = np.zeros((len(n), bits // 8), np.uint8)
        for row, s in zip(maps, self.sets, strict=True):
            on = np.zeros(bits, bool)
            on[(s & np.uint64(bits - 1)).astype(np.int64)] = True
            row[:] = np.packbits(on)
        maps = maps.view(np.uint64)
        lost = n - np.bitwise_count(maps).sum(1, dtype=np.int64)
        #: from the sets up to the root: bitmaps, smallest and largest size, most lost
        self.levels = [(maps, n, n, lost)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, lost = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at)))


def _fit(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps folded to ``words`` 64-bit words; bits are laid out so that equal low hash bits stay together."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def links(one: SignatureTree, two: SignatureTree, labels_one: np.ndarray, labels_two: np.ndarray, percent: int):
    """Yield (i, j) of linked sets with different labels, as they stand in the order of the trees; joins their labels.

    Two sets link when 100 x intersection >= ``percent`` x union. Give a tree twice to link a group with itself. The
    labels are joined in place in both arrays.
    """
    same = one is two
    words = min(one.levels[0][0].shape[1], two.levels[0][0].shape[1])
    a_levels = [(_fit(m, words), *rest) for m, *rest in one.levels]
    b_levels = a_levels if same else [(_fit(m, words), *rest) for m, *rest in two.levels]
    if words < one.levels[0][0].shape[1]:
        a_levels[0] = _relost(a_levels[0])
        a_levels = _spread_lost(a_levels)
    if not same and words < two.levels[0][0].shape[1]:
        b_levels[0] = _relost(b_levels[0])
        b_levels = _spread_lost(b_levels)
    stack = [(len(a_levels) - 1, 0, len(b_levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if la == 0 and lb == 0:
            if labels_one[i] != labels_two[j] and _linked(one.sets[i], two.sets[j], percent):
                old, new = max(labels_one[i], labels_two[j]), min(labels_one[i], labels_two[j])
                labels_one[labels_one == old] = new
                if not same:
                    labels_two[labels_two == old] = new
                yield i, j
            continue
        own = labels_one[i * FAN**la:(i + 1) * FAN**la]
        other = labels_two[j * FAN**lb:(j + 1) * FAN**lb]
        if own[0] == other[0] and (own == own[0]).all() and (other == own[0]).all():
            continue
        down_a, down_b = la >= lb, lb >= la
        ia = np.arange(i * FAN, min((i + 1) * FAN, len(a_levels[la - 1][1]))) if down_a else np.array([i])
        jb = np.arange(j * FAN, min((j + 1) * FAN, len(b_levels[lb - 1][1]))) if down_b else np.array([j])
        la, lb = la - down_a, lb - down_b
        (ma, lo_a, hi_a, lost_a), (mb, lo_b, hi_b, lost_b) = ([x[ia] for x in a_levels[la]], [x[jb] for x in b_levels[lb]])
        common = np.bitwise_count(ma[:, None, :] & mb[None, :, :]).sum(2, dtype=np.int64) + np.minimum(lost_a[:, None], lost_b[None, :])
        most = np.minimum(np.minimum(hi_a[:, None], hi_b[None, :]), common)
        need = -(-percent * (lo_a[:, None] + lo_b[None, :]) // (100 + percent))
        open_ = (most >= need) & (100 * hi_a[:, None] >= percent * lo_b[None, :]) & (100 * hi_b[None, :] >= percent * lo_a[:, None])
        pairs = [(la, int(ia[x]), lb, int(jb[y])) for x, y in zip(*np.nonzero(open_), strict=True) if not same or la != lb or ia[x] < jb[y] or (la and ia[x] == jb[y])]
        # pairs near the diagonal come first: they join most sets
        stack += sorted(pairs, key=lambda p: -abs(p[1] - p[3]))


def _relost(level):
    maps, low, high, _ = level
    return maps, low, high, low - np.bitwise_count(maps).sum(1, dtype=np.int64)


def _spread_lost(levels):
    out = [levels[0]]
    for maps, low, high, _ in levels[1:]:
        out.append((maps, low, high, np.maximum.reduceat(out[-1][3], np.arange(0, len(out[-1][3]), FAN))))
    return out


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)
