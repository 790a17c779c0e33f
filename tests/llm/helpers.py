"""Plain-Python counterparts used by the tests."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def resemblance(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def document_rows(texts):
    return [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def groups(rows):
    """{id: (set size, smallest id reachable)} over links of 0.75 and more."""
    sets = {d: shingles(t) for d, t in rows}
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}
