"""Plain Python definitions that the operators' results are held against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def exact(docs):
    """{doc_id: (keep_id, group_size, kept, sha)} of rows (doc_id, text)."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i))
    out = {}
    for text, rows in groups.items():
        keep = min(rows)[1]
        for _, i in rows:
            out[i] = (keep, len(rows), i == keep, sha(text))
    return out


def shingle_set(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near(docs, k, percent):
    """{doc_id: (n_shingles, component_id, kept)}: all pairs that share a shingle are compared."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    head = {i: i for i in sets}

    def find(i):
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    index = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in index[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                head[b] = a
        for s in sets[i]:
            index[s].append(i)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(8)}
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), failed


def mix_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    """{source: target} of {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = budget * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        w = sum(weight[s] for s in rest)
        if not w:
            return {s: float(most * sizes[s]) for s in order}
        share = (total - sum(most * sizes[s] for s in full)) / w
        above = {s for s in rest if weight[s] * share >= most * sizes[s]}
        if not above:
            return {s: float(most * sizes[s]) if s in full else weight[s] * share for s in order}
        full |= above


SECRET_KINDS, PII_KINDS = ("assign", "access", "hex"), ("email", "ip", "card", "phone")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    """Base spans (start, kind number, end)."""
    text = text or ""
    found = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def secrets(text):
    text = text or ""
    found = []
    rule = r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for m in re.finditer(rule, text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end()))
    return sorted(found)


def spans_text(found, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found)


PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels = [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, bench, n=10):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)] of rows (id, text)."""
    windows = defaultdict(set)
    for item, text in bench:
        w = PLAIN_WORD.findall((text or "").translate(LOWER))
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w = PLAIN_WORD.findall((text or "").translate(LOWER))
        hit, items = set(), set()
        for size in {len(k) for k in windows}:
            for at in range(len(w) - size + 1):
                found = windows.get(tuple(w[at : at + size]))
                if found:
                    hit |= set(range(at, at + size))
                    items |= found
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


def infill(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) of one row."""
    text = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def prefix_tree(rows):
    """Rows of op11 from (conv_id, turn, role, text)."""
    import zlib

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, sha(f"{len(role)}:{role}{text}"), text))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    total = {p: [0, 0] for p in members}
    kids = Counter(p[:-1] for p in members if p)
    for p, m in members.items():
        own_saved = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            total[p[:d]][0] += not kids[p]
            total[p[:d]][1] += own_saved
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(made[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], *total[p], sha(",".join(map(str, ends)))))
    return out
