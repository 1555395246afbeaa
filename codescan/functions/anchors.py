"""Plain substrings a regular expression cannot match without.

``contains`` on a lower-cased text is far cheaper than a regular expression, so every
rule is guarded by the literals its pattern requires.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from functools import lru_cache


@lru_cache(maxsize=4096)
def required_groups(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Groups of lower-case strings: a match holds at least one string of every group.

    Longest first; blanks and single letters tell too little and are left out.
    """
    groups = {tuple(sorted(_minimal(g))) for g in _groups(rp.parse(pattern)) if all(map(_telling, g))}
    return tuple(sorted(groups, key=lambda g: (-min(map(len, g)), len(g), g)))


def _telling(text: str) -> bool:
    return len(text) > 1 or not (text.isalnum() or text.isspace())


def _minimal(texts: set[str]) -> set[str]:
    return {a for a in texts if not any(b != a and b in a for b in texts)}


def _best(groups: list[set[str]]) -> set[str] | None:
    telling = [g for g in groups if all(map(_telling, g))]
    return max(telling, key=lambda g: (min(map(len, g)), -len(g)), default=None)


def _groups(items) -> list[set[str]]:
    found, run = [], ""
    for op, arg in [*items, (None, None)]:
        if op is rc.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            found.append({run})
            run = ""
        if op is rc.SUBPATTERN:
            found += _groups(arg[3])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:
            found += _groups(arg[2])
        elif op is rc.BRANCH:
            branches = [_best(_groups(b)) for b in arg[1]]
            if all(branches):
                found.append(set().union(*branches))
    return found
