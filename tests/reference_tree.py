"""RFC 6962 in plain Python, straight from its recursive definitions: what Spark results are held against."""

import hashlib


def leaf(value: bytes) -> bytes:
    return hashlib.sha256(b"\x00" + value).digest()


def node(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def _split(n: int) -> int:
    k = 1
    while k * 2 < n:
        k *= 2
    return k


class Brute:
    def __init__(self, hashes):
        self.hashes = hashes
        self.memo = {}

    def root(self, lo: int, hi: int) -> bytes:
        if hi == lo:
            return hashlib.sha256(b"").digest()
        if hi - lo == 1:
            return self.hashes[lo]
        if (lo, hi) not in self.memo:
            k = _split(hi - lo)
            self.memo[lo, hi] = node(self.root(lo, lo + k), self.root(lo + k, hi))
        return self.memo[lo, hi]

    def path(self, m: int, lo: int, hi: int) -> list[bytes]:
        if hi - lo == 1:
            return []
        k = _split(hi - lo)
        if m < k:
            return self.path(m, lo, lo + k) + [self.root(lo + k, hi)]
        return self.path(m - k, lo + k, hi) + [self.root(lo, lo + k)]

    def inclusion(self, m: int, n: int) -> list[bytes]:
        return self.path(m, 0, n)

    def consistency(self, m: int, n: int) -> list[bytes]:
        return self._sub(m, 0, n, True)

    def _sub(self, m: int, lo: int, hi: int, whole: bool) -> list[bytes]:
        n = hi - lo
        if m == n:
            return [] if whole else [self.root(lo, hi)]
        k = _split(n)
        if m <= k:
            return self._sub(m, lo, lo + k, whole) + [self.root(lo + k, hi)]
        return self._sub(m - k, lo + k, hi, False) + [self.root(lo, lo + k)]
