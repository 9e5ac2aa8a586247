"""Plain versions of what the operators compute."""

import collections
import math
import re
import string

#: Columns of the odd rows; all but two clash with names that operators use.
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, predicted string, ids string, "
          "matches int, n_words string, hits int, class string, part string, k string, accepted string, _label string, `odd name` int")

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, kind=SPACED):
    return kind.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def components(docs, percent=80):
    """{row number: least key reachable} of (key, text) rows."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return {i: least.get(find(i)) if sets[i] else docs[i][0] for i in range(len(docs))}, [len(s) for s in sets]


def katz(training, texts, order=5, rest=0.05):
    """[(base, score, known)] of texts (lists of words), learned from lists of words."""
    end, start = object(), object()
    one, two = collections.Counter(), collections.Counter()
    for t in training:
        t = [*t, end]
        one.update(t)
        two.update(zip([start, *t], t))
    n, v = sum(one.values()), len(one)

    def discount(counts):
        met = collections.Counter(counts.values())
        for cut in range(order, 1, -1):
            if all(met[r] for r in range(1, cut + 2)):
                common = (cut + 1) * met[cut + 1] / met[1]
                turing = [(r + 1) * met[r + 1] / met[r] for r in range(1, cut + 1)]
                if common < 1:
                    out = [(t - r * common) / (1 - common) for r, t in enumerate(turing, 1)]
                    if all(0 < x < r for r, x in enumerate(out, 1)):
                        return out + [r - rest for r in range(cut + 1, order + 1)]
        return [r - 0.5 for r in range(1, order + 1)]

    d1, d2 = discount(one), discount(two)
    lower = lambda c: d1[c - 1] if c <= order else c - rest
    higher = lambda c: d2[c - 1] if c <= order else c - rest
    total, kept, low = collections.Counter(), collections.Counter(), collections.Counter()
    for (a, w), c in two.items():
        total[a] += c
        kept[a] += higher(c)
        low[a] += lower(one[w]) / n
    unknown = 1 - sum(map(lower, one.values())) / n if n else 1.0

    def p(a, w):
        if (a, w) in two:
            return higher(two[a, w]) / total[a]
        weight = (1 - kept[a] / total[a]) / (1 - low[a]) if a in total else 1.0
        return weight * (lower(one[w]) / n if w in one else unknown)

    out = []
    for t in texts:
        t = [*t, end]
        base = sum(math.log10((one.get(w, 0) + 1) / (n + v + 1)) for w in t)
        out.append((base, sum(math.log10(p(a, w)) for a, w in zip([start, *t], t)), sum(w in one for w in t)))
    everything = [sum(p(a, w) for w in one) + p(a, object()) for a in [*list(total)[:5], object()]]
    return out, n, everything


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
