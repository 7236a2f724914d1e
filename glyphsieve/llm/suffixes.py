"""Hash-compared suffix sorting over a byte buffer.

Suffixes are compared by their longest common prefix, which a binary search over prefix polynomial hashes finds in a
logarithmic number of steps; a vectorised bottom-up mergesort orders them. What the hashes call equal is verified byte
by byte, and a group in which a hash lied is sorted by its bytes instead.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x5851F42D4C957F2D)
_TABLE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _POWERS[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


class Buffer:
    """Bytes with prefix hashes S[i] = sum of t(byte j) * BASE**j over j < i, modulo 2**64. BASE is odd, so a substring's sum can be brought to exponent 0."""

    def __init__(self, data: np.ndarray):
        self.data = data
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * _powers(n, BASE), out=self.sums[1:])
        self.back = _powers(n + 1, np.uint64(pow(int(BASE), -1, 1 << 64)))

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the hashes of size bytes from a and from b are equal."""
        s = self.sums
        return (s[a + size] - s[a]) * self.back[a] == (s[b + size] - s[b]) * self.back[b]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The longest common prefix of suffixes a and b, most at most, by binary search."""
        low = np.where(self.same(a, b, most), most, 0)
        high = most.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_] + 1) >> 1
            eq = self.same(a[open_], b[open_], mid)
            low[open_] = np.where(eq, mid, low[open_])
            high[open_] = np.where(eq, high[open_], mid - 1)
            open_ = open_[low[open_] < high[open_]]
        return low

    def before(self, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the string of la bytes from a sorts before that of lb bytes from b; for equal strings, ties."""
        most = np.minimum(la, lb)
        k = self.common(a, b, most)
        end = len(self.data) - 1
        x, y = self.data[np.minimum(a + k, end)], self.data[np.minimum(b + k, end)]
        return np.where(k < most, x < y, np.where(la == lb, ties, la < lb))

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether size bytes from a and from b are the same, byte by byte."""
        out = np.ones(len(a), bool)
        for at in range(0, len(a), 4096):
            p, q, n = a[at : at + 4096], b[at : at + 4096], size[at : at + 4096]
            step = np.arange(int(n.max(initial=0)))
            inside = step < n[:, None]
            end = len(self.data) - 1
            out[at : at + 4096] = ((self.data[np.minimum(p[:, None] + step, end)] == self.data[np.minimum(q[:, None] + step, end)]) | ~inside).all(1)
        return out

    def lead(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first 8 bytes of each string as a number that sorts as they do; missing bytes count as 0."""
        key = np.zeros(len(start), np.uint64)
        for k in range(8):
            byte = np.where(size > k, self.data[np.minimum(start + k, len(self.data) - 1)], 0)
            key = (key << np.uint64(8)) | byte.astype(np.uint64)
        return key


def mergesort(buf: Buffer, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order of strings (start, size) by group, then bytes, then length; stable."""
    n = len(start)
    lead = buf.lead(start, size)
    order = np.lexsort((lead, group))
    if n < 2:
        return order
    g, p = group[order], lead[order]
    fresh = np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1])]
    first = np.flatnonzero(fresh)
    count = np.diff(np.r_[first, n])
    block = np.repeat(np.arange(len(first)), count)
    longest, run = int(count.max()), 1
    while run < longest:
        # the elements of blocks that hold more than a run; each finds its rank among the sibling run
        at = np.flatnonzero(count[block] > run)
        base, own = first[block[at]], at - first[block[at]]
        right = (own // run) % 2 == 1
        pair = base + own // (2 * run) * (2 * run)
        stop = base + count[block[at]]
        lo = np.where(right, pair, np.minimum(pair + run, stop))
        hi = np.where(right, np.minimum(pair + run, stop), np.minimum(pair + 2 * run, stop))
        sibling, me = lo.copy(), order[at]
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            other = order[mid]
            # sibling elements that come before this one: of equal strings, those of the left run
            less = buf.before(start[other], size[other], start[me[live]], size[me[live]], right[live])
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        place = pair + (own - np.where(right, run, 0)) % (2 * run) + (lo - sibling)
        moved = order.copy()
        moved[place] = me
        order = moved
        run *= 2
    return order


def equal_runs(buf: Buffer, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each string: equal numbers for strings of one group that are the same, byte by byte."""
    n = len(start)
    out = np.empty(n, np.int64)
    if not n:
        return out
    order = mergesort(buf, group, start, size)
    a, b = order[:-1], order[1:]
    near = (group[a] == group[b]) & (size[a] == size[b])
    near[near] = buf.same(start[a[near]], start[b[near]], size[a[near]])
    truth = buf.equal(start[a[near]], start[b[near]], size[a[near]])
    if not truth.all():  # a hash lied: its groups are sorted by their bytes
        return _by_bytes(buf, group, start, size)
    out[order] = np.cumsum(np.r_[True, ~near])
    return out


def _by_bytes(buf: Buffer, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    raw, numbers = buf.data.tobytes(), {}
    keys = ((int(g), raw[s : s + k]) for g, s, k in zip(group.tolist(), start.tolist(), size.tolist(), strict=True))
    return np.array([numbers.setdefault(k, len(numbers)) for k in keys], np.int64)
