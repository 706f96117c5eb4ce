"""Helpers of the brute-force versions."""

import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, size=5):
    """The distinct five-word shingles, ASCII letters in lower case; of fewer words the one of all."""
    found = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def near_roots(texts):
    """The smallest number of each group of texts with a five-word Jaccard similarity of at least 0.8."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                one, two = find(a), find(b)
                root[max(one, two)] = min(one, two)
    return [find(i) for i in range(len(texts))]
