"""Frozen constants of the data model, and the rules that build the larger tables from them."""

from __future__ import annotations

from fractions import Fraction

# The integer transform's rows (u), columns (x).
M = (
    (13, 13, 13, 13, 13, 13, 13, 13),
    (13, 11, 7, 1, -1, -7, -11, -13),
    (12, 5, -5, -12, -12, -5, 5, 12),
    (11, -4, -13, -8, 8, 13, 4, -11),
    (9, -9, -9, 9, 9, -9, -9, 9),
    (8, -13, 4, 11, -11, -4, 13, -8),
    (5, -12, 12, -5, -5, 12, -12, 5),
    (1, -7, 11, -13, 13, -11, 7, -1),
)
#: Squared norms of the rows.
E = tuple(sum(c * c for c in row) for row in M)

QP_MAX = 95
MAX_COEFFICIENT = 1 << 25


def weight(u: int, v: int) -> int:
    """The inverse transform's weight: 2^32 over the norms, rounded."""
    d = E[u] * E[v]
    return ((1 << 32) + d // 2) // d


def zigzag() -> list[int]:
    """The natural index (8u + v) at each scan position: a walk along the diagonals, up and down in turn."""
    cells = [(u, v) for u in range(8) for v in range(8)]
    return [8 * u + v for u, v in sorted(cells, key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))]


def qp_scale(qp: int, refined: bool = False) -> int:
    """2^((qp - 4) / 4), rounded half up, at least 1. The value at 63 is frozen one above the rule. The refined table
    doubles every six steps from 64 on."""
    if qp == 63:
        return 27555
    if refined and qp >= 64:
        return int(32768 * 2 ** ((qp - 64) / 6) + 0.5)
    return max(1, int(2 ** ((qp - 4) / 4) + 0.5))


def _even(x: Fraction) -> int:
    return round(x)


#: Entries of the quantiser matrices by u + v (0 to 14): flat, standard, 4:4:4 compact, 4:2:2 low, edge-balanced;
#: luma and chroma. The first four follow from rules, the last is frozen.
def _standard(ratio: Fraction) -> list[int]:
    return [_even(16 * ratio**s) for s in range(15)]


def _scaled(base: list[int], by: Fraction) -> list[int]:
    return [16, *[_even(by * x) for x in base[1:]]]


_LUMA, _CHROMA = _standard(Fraction(5, 4)), _standard(Fraction(118, 100))
MATRICES = {
    0: ([16] * 15, [16] * 15),
    1: (_LUMA, _CHROMA),
    2: (_scaled(_LUMA, Fraction(18, 10)), _scaled(_CHROMA, Fraction(15, 10))),
    3: (_scaled(_LUMA, Fraction(108, 100)), _scaled(_CHROMA, Fraction(105, 100))),
    # Fixed values.
    4: ([20, 19, 18, 17, 16, 15, 14, 13, 12, 11, 11, 10, 9, 9, 8], [18, 17, 16, 16, 15, 14, 13, 13, 12, 11, 11, 10, 10, 9, 9]),
}


def step(matrix: int, chroma: bool, i: int, qp: int, refined: bool = False) -> int:
    """The quantiser step of the natural index i."""
    return max(1, (MATRICES[matrix][chroma][i // 8 + i % 8] * qp_scale(qp, refined) + 128) >> 8)


def flat_step(qp: int) -> int:
    """The quantiser step under the flat matrix (16 everywhere)."""
    return step(0, False, 0, qp)
