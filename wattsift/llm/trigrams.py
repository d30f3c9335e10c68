"""Boolean trigram queries of regular expressions: what every match must contain, whatever else it holds.

A query is a list of clauses, all of which hold for a match; a clause is a list of alternatives, each a set of
trigrams of which all occur. An empty query says nothing: such a rule has to read every text. Letters count without
case.
"""

from re import _constants as op
from re import _parser

MOST_STRINGS = 64

Query = list[list[frozenset[str]]]


def _letters(items) -> set[str] | None:
    """The characters of a class, or None where they are many."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 4:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out


class _Reader:
    """Walks a pattern from left to right with the exact strings read so far; unknown parts flush them to clauses."""

    def __init__(self):
        self.clauses: Query = []
        self.now: set[str] = {""}

    def flush(self) -> None:
        alternatives = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(self.now)]
        if all(alternatives):
            least = [a for a in alternatives if not any(b < a for b in alternatives)]
            self.clauses.append(list(dict.fromkeys(least)))
        self.now = {""}

    def add(self, strings: set[str] | None) -> None:
        if strings is not None and len(self.now) * len(strings) <= MOST_STRINGS:
            self.now = {a + b for a in self.now for b in strings}
        else:
            self.flush()
            self.now = strings if strings is not None and len(strings) <= MOST_STRINGS else {""}

    def read(self, items) -> None:
        for kind, value in items:
            if kind is op.LITERAL:
                self.add({chr(value).lower()})
            elif kind is op.IN:
                self.add(_letters(value))
            elif kind is op.SUBPATTERN:
                self.read(value[-1])
            elif kind is op.BRANCH:
                self.add(_branches(value[1]))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                low, high, inner = value
                one = _branches([inner])
                if one is not None and (low, high) == (0, 1):
                    self.add(one | {""})
                else:
                    for _ in range(min(low, 8)):
                        self.read(inner)
                    if low != high or low > 8:
                        self.flush()
            else:
                self.flush()


def _branches(branches) -> set[str] | None:
    """All strings of the branches, if they are a few."""
    out: set[str] = set()
    for items in branches:
        reader = _Reader()
        reader.read(items)
        if reader.clauses or reader.now == {""}:
            return None
        out |= reader.now
    return out


def trigram_query(regex: str) -> Query:
    reader = _Reader()
    reader.read(_parser.parse(regex))
    reader.flush()
    return reader.clauses
