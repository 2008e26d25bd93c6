"""Plain versions of the operators, in quadratic time, to hold the Spark ones against."""

from __future__ import annotations

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def classes(sets: dict, percent: int) -> dict:
    """Smallest key that each key is connected with by likeness of at least ``percent``."""
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(k for k in sets if sets[k])
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def dedup_lines(rows: dict[int, str | None]) -> dict[int, tuple[str, int, int]]:
    """``id: (kept text, lines, dropped)``."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders: dict[str, set[int]] = {}
    for i, text in rows.items():
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def words(text):
    return [w.decode() for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").translate(LOWER).encode())] if text else []


def least_edits(item: list, text: list) -> int:
    """Word edits between an item and the nearest stretch of a text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()
