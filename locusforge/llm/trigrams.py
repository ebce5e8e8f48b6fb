"""Boolean trigram queries of regular expressions."""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from collections.abc import Sequence

#: Ways of a pattern that are followed; beyond them a part is treated as unknown, which only weakens the query.
MAX_WAYS = 64
MAX_CLASS = 8


def _with(ways: list[tuple[str, ...]], tails: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Every way followed by every tail; touching literal runs are joined."""
    out = dict.fromkeys((*a[:-1], a[-1] + b[0], *b[1:]) for a in ways for b in tails)
    return list(out) if len(out) <= MAX_WAYS else _with(ways, [("", "")])


def _ways(items: Sequence) -> list[tuple[str, ...]]:
    """Runs of literal characters that a match has to hold, for each way to match."""
    ways: list[tuple[str, ...]] = [("",)]
    for kind, arg in items:
        tails = [("", "")]
        if kind is op.LITERAL:
            tails = [(chr(arg).lower(),)]
        elif kind is op.IN and len(arg) <= MAX_CLASS and all(k is op.LITERAL for k, _ in arg):
            tails = [(chr(c).lower(),) for _, c in arg]
        elif kind is op.SUBPATTERN:
            tails = _ways(arg[-1])
        elif kind is op.BRANCH:
            tails = [w for branch in arg[1] for w in _ways(branch)]
        elif kind is op.MAX_REPEAT:
            least, most, inner = arg
            once = _ways(inner)
            if (least, most) == (0, 1):
                tails = [("",), *once]
            elif least:
                tails = _with(once, [("", "")])
        elif kind is op.AT:
            tails = [("",)]
        ways = _with(ways, tails)
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigram sets: a text with a match holds, lowered, all trigrams of one alternative.

    Empty if some way to match needs no trigram; such a pattern has to be
    looked for in every text.
    """
    found = {
        frozenset(run[i : i + 3] for run in way for i in range(len(run) - 2)) for way in _ways(parser.parse(pattern))
    }
    if frozenset() in found:
        return []
    return sorted((a for a in found if not any(b < a for b in found)), key=sorted)
