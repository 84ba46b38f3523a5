"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict


def components(texts, threshold=0.8):
    """(index of the first text of each text's class) by all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and both >= threshold * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def cut_lines(texts, least=50):
    """Texts, in order of the sequence, without lines covered by a run of
    ``least`` words or more that stands earlier."""
    docs = [t.split("\n") for t in texts]
    runs = []
    first = {}
    for d, lines in enumerate(docs):
        words = [max(1, len(x.split())) for x in lines]
        for i in range(len(lines)):
            total = 0
            for j in range(i, len(lines)):
                total += words[j]
                if total >= least:
                    key = tuple(lines[i : j + 1])
                    first.setdefault(key, (d, i))
                    runs.append((d, i, j, key))
    gone = defaultdict(set)
    for d, i, j, key in runs:  # every run, not only the shortest ones
        if first[key] < (d, i):
            gone[d].update(range(i, j + 1))
    return ["\n".join(x for k, x in enumerate(lines) if k not in gone[d]) for d, lines in enumerate(docs)]


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")
