"""Plain Python versions of the operators' exact results."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def shingles(text: str | None, k: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*[w[i:] for i in range(k)]))


def near_groups(docs: dict[int, str | None], k: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest id reachable)."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    inv = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inv[x].append(i)
    up = {i: i for i in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in inv[x] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i)) for i in docs}


def line_dedup(docs: dict[int, str | None]) -> dict[int, tuple[int, int, str]]:
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = collections.defaultdict(set)
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def contamination(docs: dict[int, str | None], items: dict[int, str | None]) -> dict[int, tuple]:
    words = lambda t: BENCH_WORD.findall((t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items.items():
        w = words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[a : a + n])].add(i)
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in docs.items():
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if got := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= got
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def luhn(s: str) -> bool:
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[ -]", "", s)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]
SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]


def spans(text: str | None, kinds: list, whole: bool) -> tuple:
    """Counts by kind and the digest of the base spans."""
    found = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "", re.A) if ok(m[0] if whole else m))
    return (*(sum(f[1] == k for f in found) for k in range(len(kinds))), sha(",".join(f"{n}:{a}:{z}" for a, _, n, z in found)))


def unigram_scores(docs: dict[int, str | None]) -> dict[int, tuple]:
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = collections.Counter(w for i, t in docs.items() if not held[i] for w in tokens(t))
    n, v = c.total(), len(c)
    return {i: (held[i], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, t in docs.items() if (w := tokens(t))}


def bigram_scores(docs: dict[int, str | None]) -> dict[int, float]:
    """Scores of the mixed model with exact unigram counts and bigram counts that are rounded to their levels only."""
    from tapewright.llm.bloom_lm import level_of, level_values

    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    pairs = lambda w: list(zip([w[-1], *w[:-1]], w))
    learned = [w for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [tokens(t)]]
    uni = collections.Counter(x for w in learned for x in w)
    bi = collections.Counter(x for w in learned for x in pairs(w))
    values = level_values()
    rounded = {x: values[int(level_of(n))] for x, n in bi.items()}
    weight = sum(n for n in bi.values() if n > 1) / 2 / uni.total()
    norm = uni.total() + len(uni) + 1
    p = lambda u, w: weight * min(rounded.get((u, w), 0), uni[u]) / max(uni[u], 1) + (1 - weight) * (uni[w] + 1) / norm
    return {i: sum(math.log10(p(*x)) for x in pairs(tokens(t))) for i, t in docs.items()}
