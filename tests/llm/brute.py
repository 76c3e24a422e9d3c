"""Plain versions of the corpus operators for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal_data(text: str) -> list[str]:
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def without_repeats(docs: list[tuple[int, str]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(docs):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            if x in seen:
                gone[s : s + length] = b"\x01" * length
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def fingerprint(text: str) -> int:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items: list[tuple[int, int]], radius: int = 3) -> dict[int, int]:
    """Least id reachable over links of at most `radius` bits."""
    comp = {i: i for i, _ in items}
    changed = True
    while changed:
        changed = False
        for i, a in items:
            for j, b in items:
                if bin(a ^ b).count("1") <= radius and comp[j] > comp[i]:
                    comp[j], changed = comp[i], True
    return comp


def item_words(text: str) -> tuple[str, ...]:
    return tuple(x for x in re.split(r"[\W_]+", text.lower()) if x)


def item_similarity(text: str, item: str) -> float:
    def shingles(t: str) -> list[tuple[str, ...]]:
        w = item_words(t)
        return [w[i : i + 5] for i in range(len(w) - 4)]

    s, c = shingles(text), Counter(shingles(item))
    m, best = sum(c.values()), 0.0
    for a in range(len(s)):
        w = Counter(s[a : a + m])
        both = sum((w & c).values())
        best = max(best, both / (sum(w.values()) + m - both))
    return best
