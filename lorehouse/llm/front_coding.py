"""Sorted runs of byte rows: front coding, and merging them by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Per row (n x width bytes, sorted) the bytes it shares with the row before; 0 for the first."""
    n, width = rows.shape
    if not n:
        return np.zeros(0, np.uint8)
    other = rows[1:] != rows[:-1]
    shared = np.where(other.any(1), other.argmax(1), width)
    return np.concatenate(([0], shared)).astype(np.uint8)


def encode_rows(rows: np.ndarray) -> bytes:
    """A sorted run: the shared lengths, then what each row has beyond them."""
    shared = common_prefixes(rows)
    tails = rows[np.arange(rows.shape[1])[None, :] >= shared[:, None]]
    return zstandard.compress(shared.tobytes() + tails.tobytes(), 3)


def decode_rows(data: bytes, n: int, width: int) -> tuple[list[bytes], list[int]]:
    """The rows of a run and their shared lengths."""
    raw = zstandard.decompress(data)
    shared, at, row, rows = list(raw[:n]), n, b"", []
    for h in shared:
        to = at + width - h
        row = row[:h] + raw[at:to]
        rows.append(row)
        at = to
    return rows, shared


def encode_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, byte plane by byte plane."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def decode_keys(data: bytes) -> np.ndarray:
    """The keys of ``encode_keys``."""
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _further(a: bytes, b: bytes, h: int) -> tuple[int, bool]:
    """Length of the common prefix of two rows that share ``h`` bytes, and whether a is the smaller or equal."""
    x = int.from_bytes(a[h:], "big") ^ int.from_bytes(b[h:], "big")
    if not x:
        return len(a), True
    at = len(a) - 1 - (x.bit_length() - 1) // 8
    return at, a[at] < b[at]


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, bytes shared with the row before) of all rows in order.

    A loser tree over the runs. Every waiting row knows what it shares with the
    last row that came out; of two rows the one that shares more is the smaller,
    and only where both share the same are bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    rows: list[bytes] = [r[0][0] if r[0] else b"" for r in runs] + [b""] * (k - len(runs))
    shared = [0 if r[0] else -1 for r in runs] + [-1] * (k - len(runs))
    place = [0] * k
    losers = [0] * k

    def first(node: int) -> int:
        if node >= k:
            return node - k
        a, b = first(2 * node), first(2 * node + 1)
        if shared[a] == shared[b]:
            if shared[a] < 0:
                losers[node] = b
                return a
            h, less = _further(rows[a], rows[b], shared[a])
            winner, loser = (a, b) if less else (b, a)
            shared[loser] = h
        else:
            winner, loser = (a, b) if shared[a] > shared[b] else (b, a)
        losers[node] = loser
        return winner

    winner = first(1)
    while shared[winner] >= 0:
        yield winner, place[winner], shared[winner]
        texts, lengths = runs[winner]
        place[winner] += 1
        at = place[winner]
        if at < len(texts):
            rows[winner], shared[winner] = texts[at], lengths[at]
        else:
            shared[winner] = -1
        node = (winner + k) >> 1
        while node:
            other = losers[node]
            mine, its = shared[winner], shared[other]
            if its > mine:
                losers[node], winner = winner, other
            elif its == mine and mine >= 0:
                h, less = _further(rows[winner], rows[other], mine)
                if less:
                    shared[other] = h
                else:
                    shared[winner] = h
                    losers[node], winner = winner, other
            node >>= 1
