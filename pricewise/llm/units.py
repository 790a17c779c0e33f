"""Values of text units (words) remembered per Python worker and made in bulk.

Tokenizers whose merges never cross white space give a text's ids as the
concatenation of its units' ids, and natural text repeats its units, so each
distinct unit of a batch is looked up once and only unknown ones are computed.
Two generations of at most ``keep`` units each bound the memory: when the newer
one is full it becomes the older one. Long units are never kept.
"""

from __future__ import annotations

LONGEST = 64                     # bytes or characters of a unit that is kept


class Units:
    """``make_many(list of units) -> list of values`` behind a bounded memory."""

    def __init__(self, make_many, keep: int = 150_000):
        self.make_many, self.keep = make_many, keep
        self.new: dict = {}
        self.old: dict = {}

    def rows(self, units: list) -> list:
        """The value (never None) of every unit, in order."""
        new, old = self.new, self.old
        out = list(map(new.get, units))
        missed = [i for i, v in enumerate(out) if v is None]
        if missed:
            unknown = {units[i] for i in missed}
            seen = old.keys() & unknown
            new.update((u, old[u]) for u in seen)
            fresh = list(unknown.difference(seen))
            new.update(zip(fresh, self.make_many(fresh)))
            for i in missed:
                out[i] = new[units[i]]
            for u in fresh:
                if len(u) > LONGEST:
                    del new[u]
            if len(new) > self.keep:
                self.old, self.new = new, {}
        return out
