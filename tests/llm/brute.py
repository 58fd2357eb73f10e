"""Plain versions of the operators, one document at a time."""

import re
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size):
    w = words(text)
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def similar(a, b, threshold):
    both = len(a & b)
    return bool(a) and bool(b) and both >= threshold * (len(a) + len(b) - both)


def groups(docs, size=4, threshold=Fraction(85, 100)):
    """(doc_id, n_shingles, component) of (doc_id, text) rows with different ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if similar(sets[a], sets[b], threshold):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def without_similar_lines(docs, threshold=Fraction(4, 5), least=5):
    earlier, out = [], []
    for doc_id, text in sorted(docs):
        stay, lines = [], [] if text is None else text.split("\n")
        for line in lines:
            s = frozenset(words(line))
            if len(s) >= least and any(similar(s, o, threshold) for o in earlier):
                pass
            else:
                stay.append(line)
            if len(s) >= least:
                earlier.append(s)
        out.append((doc_id, len(lines), len(lines) - len(stay), None if text is None else "\n".join(stay)))
    return out


def leaks(docs, items, size=5, similarity=0.8):
    """(doc_id, item_id) pairs: some window of an item's length holds enough of its shingles."""
    from collections import Counter

    def norm(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    found = set()
    for item_id, item in items:
        w = norm(item)
        goal = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
        total = sum(goal.values())
        for doc_id, text in docs:
            d = norm(text)
            for at in range(max(1, len(d) - len(w) + 1)):
                part = d[at : at + len(w)]
                have = Counter(tuple(part[i : i + size]) for i in range(len(part) - size + 1))
                if total and sum((goal & have).values()) >= similarity * total:
                    found.add((doc_id, item_id))
    return found
