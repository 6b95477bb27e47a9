"""Plain single-machine versions of the contracts, to hold query results against."""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def passes_luhn(number: str) -> bool:
    total = 0
    for place, char in enumerate(reversed(number)):
        value = int(char) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def pii_base(text: str) -> dict[str, list[tuple[int, int]]]:
    only_digits = lambda m: re.sub("[^0-9]", "", m.group())
    spans = lambda pattern, keep: [m.span() for m in re.finditer(pattern, text) if keep(m)]
    return {
        "email": spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        "card": spans(r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(only_digits(m)) <= 19 and passes_luhn(only_digits(m))),
        "phone": spans(r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(only_digits(m)) <= 15)}


ASSIGN = (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_base(text: str) -> list[tuple[int, int, str, int]]:
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, text, re.ASCII) if len(m.group(1)) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def quality_base(text: str) -> tuple[int, int, int, int, int]:
    words = re.findall(SPACE, text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines, seen, repeated = [x for x in text.split("\n") if re.search(SPACE, x)], set(), 0
    for line in lines:
        repeated += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def shingle_set(text: str) -> frozenset:
    words = re.findall(SPACE, text.translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def link_classes(sets: list[frozenset]) -> list[int]:
    """Index of the first set that each set is linked with, over any number of links."""
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(sets))]


AFTER = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
READS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def turns_after_damage(rows: list[tuple]) -> dict:
    """Turns by conversation, in order, after the contract's damage."""
    talk = defaultdict(list)
    for conv, turn, role, text in rows:
        own = talk[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in talk.values():
        own.sort(key=lambda z: ((z[0] is not None, z[0] or 0), z[1].encode(), z[2].encode()))
    return talk


def repaired(rows: list[tuple]) -> list[tuple]:
    """Every conversation's result, by trying all edits at every turn."""
    sys.setrecursionlimit(20_000)
    out = []
    for conv, own in turns_after_damage(rows).items():
        seen, faults = set(), []
        for _, role, text in own:
            chars = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not chars else "d" if (role, text) in seen else "t" if chars[-1] not in ".!?" else "")
            seen.add((role, text))

        @functools.cache
        def best(i: int, state: int, inserts: int) -> tuple[int, str]:
            options, then = [(10 ** 9, "")], lambda paid, edit, rest: (rest[0] + paid, edit + rest[1])
            if i == len(own) and state in (0, 3):
                options.append((0, ""))
            if inserts < 2:
                options.append(then(5, "I", best(i, AFTER[state][0], inserts + 1)))
            if i < len(own):
                options.append(then(2, "D", best(i + 1, state, 0)))
                if faults[i] not in ("b", "d"):
                    more, kept = 5 * (faults[i] == "t"), READS.get((state, own[i][1][:1]))
                    options.append(then(1 + more, "R", best(i + 1, AFTER[state][0], 0)))
                    if kept is not None:
                        options.append(then(more, "K", best(i + 1, kept, 0)))
            return min(options)

        cost, audit = best(0, 0, 0)
        state, i, said = 0, 0, []
        for edit in audit:
            nxt, needed = AFTER[state]
            role, text = own[i][1:] if edit != "I" else ("", "")
            i += edit != "I"
            if edit != "D":
                said.append(f"{role if edit == 'K' else needed}:{text}")
                state = READS[state, role[:1]] if edit == "K" else nxt
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def cosine_links(vectors: list, cosine: float = 0.9) -> tuple[list[int], list[int]]:
    """Number of links of each vector and the index of the first one that it reaches; unusable vectors are None."""
    import numpy as np

    width = max((len(v) for v in vectors if v is not None), default=0)
    own = [i for i, v in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = np.array([np.pad(np.array(vectors[i], float), (0, width - len(vectors[i]))) for i in own]).reshape(len(own), width)
    units /= np.sqrt((units * units).sum(1))[:, None]
    near, counts, first = units @ units.T >= cosine, [0] * len(vectors), list(range(len(vectors)))
    for a, i in enumerate(own):
        counts[i] = int(near[a].sum()) - 1
    for a, i in enumerate(own):
        if first[i] == i:
            queue, seen = [a], {a}
            while queue:
                for b in np.nonzero(near[queue.pop()])[0].tolist():
                    if b not in seen:
                        seen.add(b)
                        queue.append(b)
            for b in seen:
                first[own[b]] = min(first[own[b]], i)
    return counts, first
