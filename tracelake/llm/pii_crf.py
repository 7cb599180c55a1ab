"""Personal data by patterns and a linear-chain conditional random field.

Four patterns with checks (digit counts, ranges, Luhn) give the base spans.  The field labels every
word with a kind or none, from word-shape features of the word and its neighbours; it is trained on
a small labelled table made from templates, and decoded by Viterbi in numpy batches.  A chain is a
stretch of words with digits or signs, with the plain words next to it; two plain words in a row
separate chains.  Spans of the field that touch a base span are dropped, so base spans stay as they
are.

Offsets are code points, ends exclusive.  Defined results: a null or empty text has no spans (the
digest of the empty string); overlapping base kinds are both listed, by start and kind order;
repeated rows each get a row; a null ``doc_id`` is passed through; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices, word_bounds

KINDS = ("email", "ip", "card", "phone", "secret")
# The base patterns (the local part is matched backwards from the sign).
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]").search


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            done = domain.end()
            yield start, done
        sign = text.find("@", max(sign + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns whose checks hold."""
    found = [(a, b, 0) for a, b in _emails(text)]
    if _DIGIT(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


# --- word shapes -----------------------------------------------------------------------------
_BIT = np.zeros(256, np.uint16)
_BIT[0x61:0x7B] = 1
_BIT[0x41:0x5B] = 2
_BIT[0x30:0x3A] = 4
for _i, _chars in ((3, b"@"), (4, b"."), (5, b"+"), (6, b"()[]"), (7, b"-_"), (8, b"\"'=:"), (9, b",;!?#*$%&|<>/\\~^`{}")):
    _BIT[list(_chars)] = 1 << _i
_BIT[0x80:] = 1 << 10
LUHN_BIT = 1 << 11  # the word's digits, 12 to 19 of them, pass Luhn's check
N_BITS = 12
DIGITS = np.array([1, 3, 4, 5, 7, 9, 11, 12, 20])  # bucket edges of digit counts
LENGTHS = np.array([2, 4, 7, 11, 16, 20, 33])
N_DIGITS, N_LENGTHS = len(DIGITS) + 1, len(LENGTHS) + 1
PLAIN_BITS = 1 | 2 | (1 << 4) | (1 << 9) | (1 << 10)  # letters and sentence punctuation


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(set of character classes, bucket of digits, bucket of length) of each word."""
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    bits = _BIT[data]
    bits[(data == 0x20) | ((data >= 9) & (data <= 13))] = 0
    classes = np.bitwise_or.reduceat(bits, starts).astype(np.int64)
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 0x30) & (data < 0x3A), out=digits[1:])
    count = digits[ends] - digits[starts]
    for i in np.flatnonzero((count >= 12) & (count <= 19)):
        if luhn("".join(chr(c) for c in data[starts[i] : ends[i]].tolist() if 0x30 <= c < 0x3A)):
            classes[i] |= LUHN_BIT
    return classes, np.searchsorted(DIGITS, count, side="right"), np.searchsorted(LENGTHS, ends - starts, side="right")


N_SHAPE = N_BITS + N_DIGITS + N_LENGTHS + N_DIGITS * 4


def _expand(classes: np.ndarray, digits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """0/1 features: classes, digit and length buckets, and digit buckets by kind of other sign."""
    n = len(classes)
    out = np.zeros((n, N_SHAPE), np.float32)
    out[:, :N_BITS] = (classes[:, None] >> np.arange(N_BITS)) & 1
    rows = np.arange(n)
    out[rows, N_BITS + digits] = 1
    out[rows, N_BITS + N_DIGITS + lengths] = 1
    letters, dots, dashes = (classes & 3) > 0, (classes & 16) > 0, (classes & (64 | 128 | 32)) > 0
    out[rows, N_BITS + N_DIGITS + N_LENGTHS + digits * 4 + np.where(letters, 3, np.where(dots, 2, np.where(dashes, 1, 0)))] = 1
    return out


@dataclass(frozen=True)
class Field:
    """Weights of the own, previous and next word's shape, and of label pairs."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    pairs: np.ndarray

    def emissions(self, classes: np.ndarray, digits: np.ndarray, lengths: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        x = _expand(classes, digits, lengths)
        e = x @ self.own
        left, right = x[:-1] @ self.before, x[1:] @ self.after
        left[opens[1:]] = 0
        right[closes[:-1]] = 0
        e[1:] += left
        e[:-1] += right
        return e


def viterbi(e: np.ndarray, first: np.ndarray, size: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Best label of each word; chains are rows ``first`` to ``first + size`` of ``e``."""
    labels = np.zeros(len(e), np.int64)
    if not len(first):
        return labels
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    back = np.zeros(e.shape, np.int8)
    best = e[first].copy()
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -t, side="left"))
        step = best[:live, :, None] + pairs[None]
        back[first[:live] + t] = step.argmax(axis=1)
        best[:live] = step.max(axis=1) + e[first[:live] + t]
    label = best.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))
        at = first[:live] + t
        labels[at] = label[:live]
        label[:live] = back[at, label[:live]] if t else label[:live]
    return labels


# --- training --------------------------------------------------------------------------------
def labelled_table(rows: int = 1500, seed: int = 11) -> list[list[tuple[str, int]]]:
    """Small labelled table: rows of (word, label), label 0 none, else 1 + kind number."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnoprstuvwyéüöñ"
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))

    def plain() -> list[tuple[str, int]]:
        w = word()
        w = rng.choice([w, w, w.capitalize(), w.upper()]) + rng.choice(["", "", "", ".", ",", "!!", "&&&", "***", "$$$", "%%%", "###", "|", "."])
        return [(w, 0)]

    def number() -> list[tuple[str, int]]:
        w = rng.choice([digits(1), digits(2), "19" + digits(2), "20" + digits(2), f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}",
                        f"{digits(2)}:{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.20{digits(2)}", f"${digits(2)}.{digits(2)}",
                        f"{digits(3)}", f"{digits(4)}", f"{digits(5)}", f"{digits(1)},{digits(3)}", f"{digits(2)}%", f"v{digits(1)}.{digits(1)}", f"({digits(1)})", f"{word()}{digits(1)}", f"{word()}-{word()}"])
        return [(w + rng.choice(["", "", ".", ","]), 0)]

    def email() -> list[tuple[str, int]]:
        sign = rng.choice(["@", "@", "[at]", "(at)"])
        return [(f"{word()}{rng.choice(['.', '_', ''])}{digits(rng.randint(0, 3))}{sign}{word()}{digits(rng.randint(0, 1))}.{rng.choice(['com', 'org', 'example.com', 'de'])}{rng.choice(['', '', '.', ','])}", 1)]

    def ip() -> list[tuple[str, int]]:
        return [(".".join(str(rng.randint(1, 255)) for _ in range(4)) + rng.choice(["", "", ":80", "/24", ".", ","]), 2)]

    def long_number(valid: bool) -> str:
        """Digits that pass Luhn's check, or fail it."""
        w = digits(rng.choice([12, 13, 14, 15, 15, 16, 16, 16, 16, 19]))
        return w[:-1] + rng.choice([c for c in "0123456789" if luhn(w[:-1] + c) == valid])

    def card() -> list[tuple[str, int]]:
        w, sign = long_number(True), rng.choice(["", "", "", "-", ".", "_", "/"])
        return [(sign.join(w[k : k + 4] for k in range(0, len(w), 4)) + rng.choice(["", ".", ","]), 3)]

    def serial() -> list[tuple[str, int]]:
        """Long numbers that are no cards: they fail the check, or stand in groups."""
        w, sign = long_number(False), rng.choice(["", "", "", "-", ".", "_", " "])
        return [(x, 0) for x in (sign.join(w[k : k + 4] for k in range(0, len(w), 4)) + rng.choice(["", ".", ","])).split(" ")]

    def phone() -> list[tuple[str, int]]:
        form = rng.randint(0, 4)
        tail = rng.choice(["", "", ".", ","])
        if form == 0:
            return [(f"+{rng.randint(1, 99)}", 4), (f"({digits(3)})", 4), (f"{digits(3)}-{digits(4)}{tail}", 4)]
        if form == 1:
            return [(f"({digits(3)})", 4), (f"{digits(3)}-{digits(4)}{tail}", 4)]
        if form == 2:
            return [(f"{digits(3)}-{digits(3)}-{digits(4)}{tail}", 4)]
        if form == 3:
            return [(f"+{digits(rng.choice([10, 11, 12]))}{tail}", 4)]
        return [(f"+{rng.randint(1, 99)}", 4), (digits(3), 4), (digits(3), 4), (f"{digits(4)}{tail}", 4)]

    def secret() -> list[tuple[str, int]]:
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 40, 64])))
        if rng.random() < 0.5:
            hexes = hexes.upper()
        return [(rng.choice(["token", "TOKEN", "key", "secret"]), 0), ("=", 0), (f'"{hexes}"{rng.choice(["", ".", ",", "###"])}', 5)]

    table = []
    for i in range(rows):
        row: list[tuple[str, int]] = []
        for _ in range(rng.randint(1, 4)):
            row += plain() if rng.random() < 0.75 else number()
        kind = [email, ip, card, phone, secret, number, serial, serial, plain][i % 9]
        row += kind()
        for _ in range(rng.randint(1, 4)):
            row += plain() if rng.random() < 0.75 else number()
        table.append(row)
    return table


def fit_field(table: list[list[tuple[str, int]]], steps: int = 150, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; forward-backward runs over all rows at once, padded."""
    raw = [" ".join(w for w, _ in row).encode() for row in table]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    size = np.array([len(row) for row in table])
    y = np.array([label for row in table for _, label in row])
    x = _expand(*shapes(data, starts, ends)).astype(np.float64)
    first = np.cumsum(size) - size
    opens, closes = np.zeros(len(y), bool), np.zeros(len(y), bool)
    opens[first], closes[first + size - 1] = True, True
    prev, nxt = np.zeros_like(x), np.zeros_like(x)
    prev[1:], nxt[:-1] = x[:-1], x[1:]
    prev[opens], nxt[closes] = 0, 0
    big = np.hstack([x, prev, nxt])
    k, n, t_max = len(KINDS) + 1, len(table), int(size.max())
    index = np.minimum(first[:, None] + np.arange(t_max), len(y) - 1)
    mask = np.arange(t_max) < size[:, None]
    gold = np.eye(k)[y]
    pair_gold = np.zeros((k, k))
    np.add.at(pair_gold, (y[:-1][~opens[1:]], y[1:][~opens[1:]]), 1)
    w, pairs = np.zeros((big.shape[1], k)), np.zeros((k, k))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pairs), np.zeros_like(pairs)]
    log_sum = lambda a, axis: np.log(np.exp(a - a.max(axis=axis, keepdims=True)).sum(axis=axis)) + a.max(axis=axis)
    for step in range(1, steps + 1):
        e = (big @ w)[index]
        alpha, beta = np.zeros((n, t_max, k)), np.zeros((n, t_max, k))
        alpha[:, 0] = e[:, 0]
        for t in range(1, t_max):
            new = log_sum(alpha[:, t - 1, :, None] + pairs, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        z = log_sum(alpha[:, -1], 1)
        pair_sum = np.zeros((k, k))
        for t in range(t_max - 2, -1, -1):
            through = pairs + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            beta[:, t] = np.where(mask[:, t + 1, None], log_sum(through, 2), 0)
            p = np.exp(alpha[:, t, :, None] + through - z[:, None, None])
            pair_sum += p[mask[:, t + 1]].sum(axis=0)
        marginal = np.exp(alpha + beta - z[:, None, None])[mask]
        for grad, value, a, b in (
            (big.T @ (marginal - gold) / n + ridge * w, w, moments[0], moments[1]),
            ((pair_sum - pair_gold) / n + ridge * pairs, pairs, moments[2], moments[3]),
        ):
            a *= 0.9
            a += 0.1 * grad
            b *= 0.99
            b += 0.01 * grad**2
            value -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    m = x.shape[1]
    return Field(*(v.astype(np.float32) for v in (w[:m], w[m : 2 * m], w[2 * m :], pairs)))


@cache
def default_field() -> Field:
    return fit_field(labelled_table())


def field_spans(column: pa.Array, field: Field) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind number) in code points that the field finds in each text."""
    out: list[list[tuple[int, int, int]]] = []
    for _, _, data, offsets in slices(column):
        n = len(offsets) - 1
        spans: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        out += spans
        starts, ends, first = word_bounds(data, offsets)
        classes, digits, lengths = shapes(data, starts, ends)
        owner = np.repeat(np.arange(n), np.diff(first))
        marked = (classes & ~PLAIN_BITS) != 0
        if not marked.any():
            continue
        same_next = np.append(owner[1:] == owner[:-1], False)
        near = marked.copy()
        near[:-1] |= marked[1:] & same_next[:-1]
        near[1:] |= marked[:-1] & same_next[:-1]
        at = np.flatnonzero(near)
        joined = np.append(False, (np.diff(at) == 1) & same_next[at[:-1]])
        begin = np.flatnonzero(~joined)
        size = np.diff(np.append(begin, len(at)))
        opens, closes = ~joined, np.append(~joined[1:], True)
        e = field.emissions(classes[at], digits[at], lengths[at], opens, closes)
        labels = viterbi(e, begin, size, field.pairs)
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        hit = np.flatnonzero(labels)
        if not len(hit):
            continue
        # Only a phone number goes on over several words.
        new = np.append(True, (np.diff(hit) != 1) | (labels[hit[1:]] != labels[hit[:-1]]) | opens[hit[1:]] | (labels[hit[1:]] != 1 + KINDS.index("phone")))
        edge = np.flatnonzero(new)
        for a, z in zip(hit[edge], hit[np.append(edge[1:], len(hit)) - 1]):
            lo, hi = int(starts[at[a]]), int(ends[at[z]])
            raw = data[lo:hi].tobytes()
            lo, hi = lo + len(raw) - len(raw.lstrip(_TRIM)), hi - (len(raw) - len(raw.rstrip(_TRIM)))
            if lo < hi:
                doc = int(owner[at[a]])
                origin = points[offsets[doc]]
                spans[doc].append((int(points[lo] - origin), int(points[hi] - origin), int(labels[a]) - 1))
    return out


_TRIM = b"\"'`.,;:!?#*$%&|<>[]{}="


def all_spans(column: pa.Array, field: Field) -> Iterator[tuple[str, list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(text, base spans, base and added spans) of each text."""
    for text, extra in zip(column.to_pylist(), field_spans(column, field)):
        base = base_spans(text or "")
        taken = [(a, b) for a, b, _ in base]
        added = [s for s in extra if not any(s[0] < b and a < s[1] for a, b in taken)] if len(taken) < 50 else _apart(extra, taken)
        yield text or "", base, sorted(base + added, key=lambda s: (s[0], s[2]))


def _apart(extra: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The spans that touch none of the taken ones (sorted by start; the furthest end so far is kept)."""
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate([b for _, b in taken])
    out = []
    for s in extra:
        i = int(np.searchsorted(starts, s[1], side="left"))  # taken spans that begin before s ends
        if i == 0 or reach[i - 1] <= s[0]:
            out.append(s)
    return out


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_personal_data(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts of base spans, their digest, and all spans, per document."""
    model = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(low, 500) for b in batches for low in range(0, b.num_rows, 500)):
            rows = []
            for _, base, spans in all_spans(b.column("text"), model):
                kinds = [k for _, _, k in base]
                rows.append((*[kinds.count(k) for k in range(4)], hashlib.sha256(_line(base).encode()).hexdigest(), _line(spans)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"]).mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one mark."""
    out, done = [], 0
    for a, b, k in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:] if spans else text


def mask_personal_data(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents, all columns, with spans masked and ``n_chars`` (if there) brought up to date."""
    model = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(low, 500) for b in batches for low in range(0, b.num_rows, 500)):
            column = b.column("text")
            texts = [mask(t, s) for t, _, s in all_spans(column, model)]
            texts = [t if known else None for t, known in zip(texts, column.is_valid().to_pylist())]
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    masked = documents.mapInArrow(run, documents.schema)
    if "n_chars" in documents.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(documents.schema["n_chars"].dataType))
    return masked
