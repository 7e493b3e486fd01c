"""Plain versions of the operators, straight from their contracts."""

from __future__ import annotations

import random
import re
from collections import Counter

BLANKS = " \t\n\x0b\x0c\r"
ASSIGN = re.compile(
    r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])"
    r"|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def secrets(text):
    t = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    def valid(kind, v):
        digits = re.sub("[^0-9]", "", v)
        if kind == "email":
            return True
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15

    return {
        k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PERSONAL.items()
    }


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def lower_ascii(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(w):
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def components(sets):
    """A label per set; equal labels are linked."""
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(sets))]


def contained(documents, items):
    """Pairs (doc_id, item_id, shared, n_item)."""
    wanted = []
    for item_id, text in set(items):
        item = words((text or "").lower())
        if item:
            wanted.append((item_id, min(5, len(item)), shingles(item)))
    out = set()
    for doc_id, body in documents:
        held = words((body or "").lower())
        runs = {k: {tuple(held[i : i + k]) for i in range(len(held) - k + 1)} for k in {k for _, k, _ in wanted}}
        for item_id, width, want in wanted:
            shared = len(want & runs[width])
            if 100 * shared >= 80 * len(want):
                out.add((doc_id, item_id, shared, len(want)))
    return out


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
