"""Context-triggered piecewise hashes: a text's digest changes only near where the text changes.

A window of seven bytes rolls over the text; where its hash hits a value that one in ``block`` positions hits, a piece
ends and adds one character, six bits of the piece's hash. Digests read block:pieces:pieces of the doubled block.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LENGTH, LEAST_BLOCK = 7, 64, 3
FIRST, FACTOR = 0x28021967, 0x01000193
#: Changing a character costs as much as leaving one out and putting one in.
CHANGE = 2

_NEXT = [[((h * (FACTOR & 63)) ^ c) & 63 for c in range(64)] for h in range(64)]  # six bits of a hash depend on six bits only


def rolling(data: bytes) -> np.ndarray:
    """The window's hash after each byte: the sum of its bytes, their sum weighted by age and a shifted exclusive or."""
    b = np.concatenate([np.zeros(WINDOW - 1, np.uint64), np.frombuffer(data, np.uint8).astype(np.uint64)])
    n = len(data)
    plain, weighted, shifted = (np.zeros(n, np.uint64) for _ in range(3))
    for age in range(WINDOW):
        c = b[WINDOW - 1 - age : WINDOW - 1 - age + n]
        plain += c
        weighted += c * np.uint64(WINDOW - age)
        shifted ^= (c << np.uint64(5 * age)) & np.uint64(0xFFFFFFFF)
    return (plain + weighted + shifted) & np.uint64(0xFFFFFFFF)


def _pieces(low: bytes, ends: np.ndarray, most: int, tail: bool) -> str:
    """One character for each piece; pieces beyond ``most`` run together into the last one, which ``tail`` adds."""
    out, at = [], 0
    for end in [*ends[:most].tolist(), len(low) - 1] if tail else ends[:most].tolist():
        h = FIRST & 63
        for c in low[at : end + 1]:
            h = _NEXT[h][c]
        out.append(ALPHABET[h])
        at = end + 1
    return "".join(out)


def digest(text: str) -> str | None:
    """The digest of the text's UTF-8 bytes; none for an empty text."""
    data = text.encode()
    if not data:
        return None
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    roll, low = rolling(data), bytes(c & 63 for c in data)
    while True:
        ends = np.flatnonzero(roll % np.uint64(block) == block - 1)
        if block > LEAST_BLOCK and min(len(ends), LENGTH - 1) < LENGTH // 2:
            block //= 2
            continue
        twice = np.flatnonzero(roll % np.uint64(2 * block) == 2 * block - 1)
        tail = bool(roll[-1])
        return f"{block}:{_pieces(low, ends, LENGTH - 1, tail)}:{_pieces(low, twice, LENGTH // 2 - 1, tail)}"


def squeezed(pieces: str) -> str:
    """At most three equal characters in a row."""
    return "".join(c for i, c in enumerate(pieces) if pieces[max(0, i - 3) : i] != c * 3)


def keys(digested: str) -> list[str]:
    """What two digests must share to score above 0: a block size and seven characters in a row, or the whole pieces."""
    block, one, two = digested.split(":")
    out = {f"{block}={one}"}
    for size, pieces in ((int(block), squeezed(one)), (2 * int(block), squeezed(two))):
        out |= {f"{size}:{pieces[i : i + WINDOW]}" for i in range(len(pieces) - WINDOW + 1)}
    return sorted(out)


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y) * CHANGE)
    return row[-1]


def _alike(a: str, b: str, block: int) -> int:
    if not {a[i : i + WINDOW] for i in range(len(a) - WINDOW + 1)} & {b[i : i + WINDOW] for i in range(len(b) - WINDOW + 1)}:
        return 0
    score = 100 - 100 * (_distance(a, b) * LENGTH // (len(a) + len(b))) // LENGTH
    if block >= (99 + WINDOW) // WINDOW * LEAST_BLOCK:
        return score
    return min(score, block // LEAST_BLOCK * min(len(a), len(b)))


def compare(a: str | None, b: str | None) -> int:
    """0 to 100; digests compare where block sizes are equal or one is twice the other."""
    if not a or not b:
        return 0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    m, n, a1, a2, b1, b2 = int(m), int(n), squeezed(a1), squeezed(a2), squeezed(b1), squeezed(b2)
    if m == n:
        return 100 if a1 == b1 else max(_alike(a1, b1, m), _alike(a2, b2, 2 * m))
    if m == 2 * n:
        return _alike(a1, b2, m)
    return _alike(a2, b1, n) if n == 2 * m else 0
