"""Many keywords found by one pass over a text, in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: signs that are told together
GROUP = 5


class Keywords:
    """A fixed set of substrings to look for.

    The pattern is a look-ahead, so it is tried at every place of the text and takes nothing away; its alternatives branch sign by sign, and
    at each place the longest keyword is found.  A keyword that begins a longer one ("app" in "application") is present wherever that is, one
    inside it is found at its own place.
    """

    def __init__(self, *groups: Iterable[str]) -> None:
        self.words = sorted({w for g in groups for w in g})
        assert all(self.words)
        self.pattern = f"(?=({_branches(self.words)}))"

    def found(self, text: Column | str) -> Column:
        """The distinct keywords that are the longest somewhere; put it into a column of its own before it is asked several times."""
        return F.array_distinct(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(1)))

    def telling(self, word: str) -> list[str]:
        """The keywords whose being found tells that ``word`` is present."""
        return [w for w in self.words if w.startswith(word)]

    def any_of(self, found: Column | str, words: Sequence[str]) -> Column:
        """Is one of the words present?"""
        telling = sorted({w for word in words for w in self.telling(word)})
        return F.exists(found, lambda w: w.isin(telling))

    def mask(self, found: Column | str, words: Sequence[str]) -> Column:
        """One bit per distinct word present (at most 62).

        A bit mask makes "count of distinct keywords over all pages of a site" a plain ``bit_or`` aggregate: fixed width, combined on the map
        side, whatever the size of the site.
        """
        assert len(words) < 63
        bits: dict[str, int] = {}
        for i, word in enumerate(words):
            for w in self.telling(word):
                bits[w] = bits.get(w, 0) | 1 << i
        table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("bigint") for w in sorted(bits) for x in (w, bits[w])])
        none = F.lit(0).cast("bigint")
        return F.aggregate(found, none, lambda so_far, w: so_far.bitwiseOR(F.coalesce(F.try_element_at(table, w), none)))


def _branches(words: Sequence[str]) -> str:
    """A pattern that matches the longest of the words at a place."""
    after: dict[str, list[str]] = {}
    for w in words:
        if w:
            after.setdefault(w[0], []).append(w[1:])
    if not after:
        return ""
    signs = sorted(after)
    ways = [re.escape(sign) + _branches(after[sign]) for sign in signs]
    if len(ways) > 2 * GROUP:
        # most places of a text begin no keyword: they are told by a few groups of signs instead of by sign after sign
        parts = [slice(i, i + GROUP) for i in range(0, len(ways), GROUP)]
        ways = [f"(?=[{''.join(map(re.escape, signs[p]))}])(?:{'|'.join(ways[p])})" for p in parts]
    pattern = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
    return f"(?:{pattern})?" if "" in words else pattern
