"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import regex

from quillstack.llm import pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def invented(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def near_components(docs):
    """doc_id -> (set size, least id of the component)."""
    sets = {i: shingle_set(t) for i, t in docs}
    groups = Union()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


def without_repeats(docs, window=35):
    """In the order of docs: words, words removed, digest of what is left."""
    split = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        out.append((len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def personal_data(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            bad = kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15
            if not bad:
                out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(out)


def normal_line(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def dedup_lines(docs):
    """docs (id, text), unique ids. Returns id -> text that is left, by edit similarity alone."""
    places = defaultdict(list)
    for i, t in sorted(docs):
        for k, line in enumerate((t or "").split("\n")):
            if n := normal_line(line):
                places[n].append((i, k))
    lines, groups = sorted(places), Union()
    for k, a in enumerate(lines):
        groups.find(a)
        for b in lines[k + 1 :]:
            longest = max(len(a), len(b))
            if min(len(a), len(b)) >= 0.9 * longest and distance(a, b) <= int(longest * 0.1 + 1e-9):
                groups.join(a, b)
    first = {}
    for n in lines:
        root = groups.find(n)
        first[root] = min(first.get(root, min(places[n])), min(places[n]))
    keep = {}
    for i, t in docs:
        if t is not None:
            keep[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if not (n := normal_line(x)) or first[groups.find(n)] == (i, k))
    return keep


def weighted_shingles(words):
    """Five-word shingles, as often as they occur; each weighs as many letters as it has."""
    n = min(5, len(words))
    out = Counter()
    for k in range(len(words) - n + 1 if n else 0):
        out[tuple(words[k : k + n])] += sum(map(len, words[k : k + n]))
    return out


def resemblance(a, b):
    both = sum(min(w, b[s]) for s, w in a.items())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def contaminated(text, items):
    """Ids of the items that some window of their length, or a shorter text as a whole, resembles."""
    words = re.findall(r"\w+", (text or "").lower())
    out = set()
    for item_id, item in items:
        own = re.findall(r"\w+", item.lower())
        n = min(len(own), len(words))
        if n and (n == len(own) or n >= 5):
            goal = weighted_shingles(own)
            if any(resemblance(weighted_shingles(words[k : k + n]), goal) >= 0.75 for k in range(len(words) - n + 1)):
                out.add(item_id)
    return out
