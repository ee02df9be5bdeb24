"""Which patterns can match a text: one scan for the literal cues that their matches can't be without."""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as op
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iu)"


def needed(pattern: str) -> frozenset[str]:
    """Strings of which every match of a pattern holds at least one, lower case; of the choices the longest, then fewest.

    A Java pattern without look-around. Empty if there are none: a single ASCII letter is none.
    """
    tree = _parser.parse(pattern.replace(r"\p{L}", "a-z").replace(r"\p{M}", "").replace(r"\p{N}", "0-9"), re.IGNORECASE)
    return frozenset(_of(list(tree)) or ())


def _of(tree: list) -> set[str] | None:
    options, run = [], ""
    for kind, value in [*tree, (None, None)]:
        if kind is op.LITERAL:
            run += chr(value).lower()
            continue
        if len(run) > 1 or run > "\x7f":
            options.append({run})
        run = ""
        if kind is op.SUBPATTERN:
            options.append(_of(list(value[-1])))
        elif kind is op.BRANCH:
            each = [_of(list(b)) for b in value[1]]
            options.append(None if any(x is None for x in each) else set().union(*each))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0]:
            options.append(_of(list(value[2])))
    return max((o for o in options if o), key=lambda o: (min(min(map(len, o)), 4), -len(o), min(map(len, o))), default=None)


def trie(words: Iterable[str]) -> str:
    """An alternation of words with shared beginnings, which matches the longest that fits."""
    by_first: dict[str, set[str]] = {}
    for w in words:
        if w:
            by_first.setdefault(w[0], set()).add(w[1:])
    branches = [re.escape(c) + (f"(?:{trie(rest)})" + ("?" if "" in rest else "") if rest - {""} else "") for c, rest in sorted(by_first.items())]
    return "|".join(branches)


class Scan:
    """The cues of named groups of patterns, in one pattern, and the groups that each cue stands for."""

    def __init__(self, groups: dict[str, tuple[str, ...]]):
        self.names = sorted(groups)
        own: dict[str, int] = {}
        self.always = 0
        for i, name in enumerate(self.names):
            for p in groups[name]:
                words = needed(p)
                self.always |= 0 if words else 1 << i
                for w in words:
                    own[w] = own.get(w, 0) | 1 << i
        self.cues = {w: sum(1 << i for i in range(len(self.names)) if any(own[x] >> i & 1 for x in own if w.startswith(x))) for w in own}
        self.pattern = FLAGS + f"(?=({trie(self.cues)}))"

    def groups(self, text: Column) -> Column:
        """Names of the groups of which a pattern may match, ascending: the text is read once, whatever their number. Null for null.

        A cue is looked for at every place, so none hides another; a longer one stands for those it begins with. What is
        found in a casing that lower case doesn't give back stands for all.
        """
        bit = lambda n: F.lit(n).cast("long")
        table = F.create_map(*[x for w, n in sorted(self.cues.items()) for x in (F.lit(w), bit(n))])
        found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(self.pattern), 1), F.lower))
        mask = F.aggregate(found, bit(self.always), lambda m, w: m.bitwiseOR(F.coalesce(F.element_at(table, w), bit((1 << len(self.names)) - 1))))
        named = F.array(*[F.struct(bit(1 << i).alias("bit"), F.lit(n).alias("name")) for i, n in enumerate(self.names)])
        of = lambda m: F.transform(F.filter(named, lambda x: x["bit"].bitwiseAND(m) != 0), lambda x: x["name"])
        return F.get(F.transform(F.array(mask), of), F.lit(0))
