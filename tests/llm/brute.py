"""Plain Python versions of the corpus operators; each takes a list of (doc_id, text) rows."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
Rows = list[tuple[int | None, str | None]]


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def shingles(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def op1(rows: Rows) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    seen = set()
    for i, s in enumerate(sets):
        overlap = Counter(j for g in s for j in holders[g] if j > i)
        for j, both in overlap.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    seen = defaultdict(list)
    for i in range(len(rows)):
        seen[root(i)].append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(seen[root(i)])) for i in range(len(rows)))


def op2(rows: Rows) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = WORD.findall(text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = Counter(grams)
        repeat = set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                repeat.update((i, i + 1, i + 2))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed))
    return sorted(out)


def op3(rows: Rows, encoding) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        ids = encoding.encode_ordinary(text or "")
        out.append((doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(encoding.decode_bytes(ids))))
    return sorted(out)


def op4(rows: Rows) -> list[tuple]:
    """doc_id, n_chars, edited_sha256 (ids must be distinct)."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        out.append((doc_id, len(text), sha(text[: len(text) - n] + after[:n])))
    return sorted(out)


def op5(rows: Rows, length: int = 200) -> list[tuple]:
    data = [(t or "").encode() for _, t in rows]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(d), sum(gone), spans, sha(bytes(b for b, g in zip(d, gone) if not g))))
    return sorted(out)


def op6(rows: Rows, tokenizer, capacity: int = 4096) -> tuple[list[tuple], int]:
    """Pieces (doc_id, piece, start, length, ids_crc32), and the fewest sequences that length allows."""
    out, total = [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for k, low in enumerate(range(0, len(ids), capacity)):
            part = ids[low : low + capacity]
            out.append((doc_id, k, low, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out), -(-total // capacity)


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    """Sequences that plain best-fit decreasing needs."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        k = bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else capacity
        rooms.insert(bisect_left(rooms, room - n), room - n)
    return len(rooms)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def op7(rows: Rows) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        text, found = text or "", []
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
            found.append((m.start(), 0, "email", m.end()))
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            if all(int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, "ip", m.end()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, "card", m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found.append((m.start(), 3, "phone", m.end()))
        found.sort()
        kinds = Counter(f[2] for f in found)
        out.append((doc_id, kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found))))
    return sorted(out)


def op8(rows: Rows, length: int = 35) -> list[tuple]:
    data = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if count[tuple(d[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((doc_id, len(d), sum(gone), sha(" ".join(w for w, g in zip(d, gone) if not g))))
    return sorted(out)


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op10(rows: Rows) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in PHRASES.items():
            want = phrase.split()
            for i in range(len(words) - len(want) + 1):
                if words[i : i + len(want)] == want:
                    places.append(i)
                    labels.add(label)
        out.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return sorted(out)


def license_detections(text: str, rules) -> list[tuple[int, int, int, str]]:
    """(start, end, priority, label) by every rule on the whole text; what lies in another of no lower priority goes."""
    raw = (text or "").translate(LOWER).encode()
    found = [(m.start(), m.end(), p, label) for p, label, _, pattern in rules for m in pattern.finditer(raw)]
    found = sorted(set(found), key=lambda d: (d[0], -d[1], -d[2], d[3]))
    kept = []
    for i, d in enumerate(found):
        inside = [e for j, e in enumerate(found) if e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and (e[:3] != d[:3] or j < i)]
        if not inside:
            kept.append(d)
    return kept


def spots(text: str, common: set[str], digest) -> set[tuple[str, ...]]:
    """(anchor, next two content words): anchors are common words, words with digest 0 and the first word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    out = set()
    for i, w in enumerate(words):
        if i == 0 or w in common or digest(w) % 4 == 0:
            after = [x for x in words[i + 1 :] if x not in common][:2]
            out.add((w, *after, *[""] * (2 - len(after))))
    return out


def em(votes, rounds: int = 50):
    """Posterior of each row of votes (-1, 0, 1) by EM over the rows, with the operator's start and bounds."""
    import numpy as np

    v = np.array(votes, float)
    k = v.shape[1]
    good, bad, prior = np.full(k, 0.95), np.full(k, 0.4), 0.85

    def posterior():
        z = np.log(prior / (1 - prior)) + (v > 0) @ np.log(good / (1 - bad)) + (v < 0) @ np.log((1 - good) / bad)
        return 1 / (1 + np.exp(-z))

    for _ in range(rounds):
        p = posterior()
        cast = v != 0
        good_new = (9.5 + p @ (v > 0)) / (10 + p @ cast)
        bad_new = (4 + (1 - p) @ (v < 0)) / (10 + (1 - p) @ cast)
        prior = min(0.98, max(0.02, p.mean()))
        good = np.clip(good_new, 0.55, 0.999)
        bad = np.minimum(0.999, np.maximum(1.5 * (1 - good), bad_new))
    return posterior()


def without_repeats(rows: Rows, length: int = 200) -> list[tuple]:
    """Texts without characters all of whose bytes lie in a string that starts twice."""
    data = [(t or "").encode() for _, t in rows]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, text), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        at, kept = 0, []
        for c in text or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append((doc_id, "".join(kept)))
    return out


def op11(rows: list[tuple[str | None, str | None]], least: int = 100, top: int = 2000) -> list[tuple]:
    """Rows are (lang, text); gives lang, rank, phrase, a, l, r, n, score."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 6):
                counts["und" if lang is None else lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        candidates = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        gone = set()
        for k, v in candidates.items():
            for i in range(len(k)):
                for j in range(i + 2, len(k) + 1):
                    if j - i < len(k) and 100 * v >= 100 * f[k[i:j]]:
                        gone.add(k[i:j])
        found = []
        for k, a in candidates.items():
            if k not in gone:
                score, _, left, right = min((1000 * a * n // (f[k[:c]] * f[k[c:]]), c, f[k[:c]], f[k[c:]]) for c in range(1, len(k)))
                found.append((-score, -a, " ".join(k).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """All maximal stretches of max(24, 3 q) words and more with smallest period q, by start, then period."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.append((i, j + q - i, q))
            i = j + 1
    smallest = {}
    for s, n, q in sorted(out, key=lambda r: r[2]):  # a stretch with a period below q too lies in a longer or equal one
        if not any(a <= s and s + n <= a + m for a, m, _ in smallest):
            smallest[s, n, q] = True
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def op12(rows: Rows, loops: bool = True) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if loops and doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = runs_of(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        out.append((doc_id, len(runs), *best, milli, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


def simhash(text: str | None, n: int = 3) -> str:
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return format(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)), "016x")


def op13(rows: Rows) -> list[tuple]:
    prints = [simhash(t) for _, t in rows]
    parent = {p: p for p in prints}

    def root(p: str) -> str:
        while parent[p] != p:
            p = parent[p]
        return p

    distinct = [(int(p, 16), p) for p in parent]
    for i, (a, p) in enumerate(distinct):
        for b, o in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(p)] = root(o)
    least: dict[str, int] = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return sorted(((i, p, least.get(root(p))) for (i, _), p in zip(rows, prints)), key=lambda r: tuple((v is None, v) for v in r))
