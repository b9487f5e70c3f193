"""Personal data: rules for four kinds of spans, and a linear-chain conditional random field that adds more.

The rules are regular expressions, found by positions of their rare bytes
(digits, @, +) over the bytes of many texts at once, so that a text costs its
length whatever it repeats.

The field reads sequences of neighbouring words that hold a digit or an @; any
other word can only be outside a span, so that cutting there changes no best
path. Features are word shapes, those of the neighbours, and the word before. It
is trained on a small labelled table: SEEDS, and at most SAMPLE different
sequences of each kind from the corpus, labelled by the rules. Viterbi runs over
all sequences of a batch at once. What it finds is added where it passes its
kind's check and overlaps no span of the rules.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, whole

KINDS = ("email", "ip", "card", "phone")
#: Of the corpus, different sequences that hold a kind, and as many that hold none; those with the smallest hashes.
SAMPLE = 400
#: Words of a sequence that are learned from.
LEARNED = 64
SLICE = 4 << 20
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_CARD = LABELS.index("B-card")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_ALNUM = bytes([*range(48, 58), *range(65, 91), *range(97, 123)])
_LOCAL, _PHONE, _SPACE = _table(_ALNUM + b"._%+-"), _table(b" ().-0123456789"), _table(b" \t\n\v\f\r")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def luhn(digits: bytes) -> bool:
    n = [d - 48 for d in reversed(digits)]
    return (sum(n[::2]) + sum(2 * d - 9 * (d > 4) for d in n[1::2])) % 10 == 0


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _chains(linked: np.ndarray) -> np.ndarray:
    """For n runs, of which linked (n - 1) says whether one goes on in the next: the first run of each run's chain."""
    return np.maximum.accumulate(np.where(np.concatenate(([True], ~linked)), np.arange(len(linked) + 1), 0))


def base_spans(raw: bytes, buf: np.ndarray) -> dict[str, list[tuple[int, int]]]:
    """The rules' spans, as byte offsets. raw and buf are the same bytes."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, done = np.flatnonzero(buf == 64), 0
    if len(at):
        stops = np.concatenate(([-1], np.flatnonzero(~_LOCAL[buf])))
        for a, s in zip(at.tolist(), (stops[np.searchsorted(stops, at) - 1] + 1).tolist(), strict=True):
            s = max(s, done)
            found = _DOMAIN.match(raw, a + 1) if s < a else None
            if found:
                done = found.end()
                out["email"].append((s, done))
    digit = (buf >= 48) & (buf <= 57)
    start, end = _runs(digit)
    if len(start):
        gap, between = start[1:] - end[:-1], buf[end[:-1]]
        dotted = (gap == 1) & (between == 46)
        first = _chains(dotted)
        four = dotted[:-2] & dotted[1:-1] & dotted[2:]
        for i in np.flatnonzero(four & ((np.arange(len(start)) - first)[: len(four)] % 4 == 0)).tolist():
            parts = [raw[start[j] : end[j]].lstrip(b"0") for j in range(i, i + 4)]
            if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
                out["ip"].append((int(start[i]), int(end[i + 3])))
        spaced = (gap == 1) & ((between == 32) | (between == 45))
        heads = np.unique(_chains(spaced))
        sizes = np.add.reduceat(end - start, heads)
        tails = np.concatenate((heads[1:], [len(start)])) - 1
        for h, t in zip(heads[(sizes >= 16) & (sizes <= 19)].tolist(), tails[(sizes >= 16) & (sizes <= 19)].tolist(), strict=True):
            if luhn(b"".join(raw[start[j] : end[j]] for j in range(h, t + 1))):
                out["card"].append((int(start[h]), int(end[t])))
        plus = np.flatnonzero(buf[:-1] == 43)
        plus = plus[digit[plus + 1]]
        if len(plus):
            places, stops = np.flatnonzero(digit), np.concatenate((np.flatnonzero(~_PHONE[buf]), [len(buf)]))
            stop = stops[np.searchsorted(stops, plus + 2)]
            last = places[np.searchsorted(places, stop) - 1]
            n = np.searchsorted(places, last) - np.searchsorted(places, plus) + 1
            ok = (last >= plus + 3) & (n >= 8) & (n <= 15)
            out["phone"] = list(zip(plus[ok].tolist(), (last[ok] + 1).tolist(), strict=True))
    return out


# Words and sequences


class Words(NamedTuple):
    """Words with a digit or an @: byte offsets of what is left of them without outer punctuation, and whether a sequence begins."""

    start: np.ndarray
    end: np.ndarray
    begins: np.ndarray
    before: list[bytes]  # for each sequence the word before it, in lower case


_INNER, _OPENS = _table(_ALNUM + bytes(range(128, 256))), _table(b"(+")


def words(raw: bytes, buf: np.ndarray) -> Words:
    space = np.concatenate(([-1], np.flatnonzero(_SPACE[buf]), [len(buf)]))
    hit = np.unique(np.searchsorted(space, np.flatnonzero(((buf >= 48) & (buf <= 57)) | (buf == 64))))
    a, b = space[hit - 1] + 1, space[hit]
    joined = np.concatenate(([False], (a[1:] - b[:-1] == 1) & ((buf[np.minimum(b[:-1], len(buf) - 1)] == 32) | (buf[np.minimum(b[:-1], len(buf) - 1)] == 9)))) if len(hit) else np.zeros(0, bool)
    inner = np.flatnonzero(_INNER[buf])
    start = inner[np.searchsorted(inner, a).clip(max=max(0, len(inner) - 1))] if len(inner) else a
    bare = (start < a) | (start >= b)  # without a letter or digit: only an @
    start = np.where(bare, a, start)
    opened = (start > a) & _OPENS[buf[np.maximum(start - 1, 0)]]
    end = np.where(bare, b, inner[np.searchsorted(inner, b) - 1] + 1 if len(inner) else b)
    before = []
    for i, h in zip(np.flatnonzero(~joined).tolist(), hit[~joined].tolist(), strict=True):
        near = h > 1 and a[i] - 1 - space[h - 2] <= 24 and buf[a[i] - 1] != 10
        before.append(re.sub(rb"[^a-z]+", b"", raw[space[h - 2] + 1 : max(a[i] - 1, 0)].lower()) if near else b"")
    return Words(start - opened, end, ~joined, before)


_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 else 57 if 48 <= b <= 57 else 117 if b > 127 else b for b in range(256))


def _shapes(word: bytes) -> tuple[bytes, bytes]:
    """A word's shape with equal neighbours made one, and with the lengths of its digits."""
    letters = word.translate(_SHAPE)
    short = re.sub(rb"(.)\1+", rb"\1", letters, flags=re.S)
    return short[:24], re.sub(rb"([^9])\1+", rb"\1", letters, flags=re.S)[:24]


def features(sequence: list[bytes], before: bytes) -> Iterator[list[bytes]]:
    """What the field knows of each word of a sequence."""
    shapes = [_shapes(w) for w in sequence]
    for i, (word, (short, long)) in enumerate(zip(sequence, shapes, strict=True)):
        digits = bytes(c for c in word if 48 <= c <= 57)
        out = [b"c" + short, b"l" + long, b"n%d" % min(len(digits), 20), b"p" + (shapes[i - 1][1] if i else b""), b"q" + (shapes[i + 1][1] if i + 1 < len(sequence) else b""), b"."]
        if 13 <= len(digits) <= 19:
            out.append(b"luhn%d" % luhn(digits))
        if b"@" in word:
            out.append(b"@%d%d" % (word.count(b"@"), word.rpartition(b"@")[2].count(b".")))
        if i == 0:
            out.append(b"w" + before)
        yield out


# The field


class Field(NamedTuple):
    """names: feature to row of weights, whose last row is zero; steps[a, b]: weight of label b after a; starts: of the first."""

    names: dict[bytes, int]
    weights: np.ndarray
    steps: np.ndarray
    starts: np.ndarray


_WIDTH = 10
#: I of a kind only follows B or I of that kind.
_ALLOWED = np.array([[not b.startswith("I") or a[1:] == b[1:] for b in LABELS] for a in LABELS])
_FIRST = np.array([not b.startswith("I") for b in LABELS])
_NEVER = -1e9


def _rows(names: dict[bytes, int], sequence: list[bytes], before: bytes) -> list[list[int]]:
    none = len(names)
    return [([names.get(f, none) for f in fs] + [none] * _WIDTH)[:_WIDTH] for fs in features(sequence, before)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(table: Iterable[tuple[list[bytes], bytes, list[int]]], rounds: int = 80, rate: float = 0.3, shrink: float = 0.02) -> Field:
    """The field of the largest likelihood, less shrink times the squared weights, by AdaGrad. table: (words, word before, labels)."""
    table = [t for t in table if t[0]]
    counts: dict[bytes, int] = {}
    for sequence, before, _ in table:
        for fs in features(sequence, before):
            for f in fs:
                counts[f] = counts.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= 2))}
    k = len(LABELS)
    weights, steps, starts = np.zeros((len(names) + 1, k)), np.where(_ALLOWED, 0.0, _NEVER), np.where(_FIRST, 0.0, _NEVER)
    groups = []
    for n in sorted({len(s) for s, _, _ in table}):
        part = [t for t in table if len(t[0]) == n]
        groups.append((np.array([_rows(names, s, b) for s, b, _ in part]), np.array([y for _, _, y in part])))
    seen = [np.full_like(v, 1e-8) for v in (weights, steps, starts)]
    for _ in range(rounds):
        grad = [-2 * shrink * np.where(v > _NEVER / 2, v, 0) for v in (weights, steps, starts)]
        for ids, labels in groups:
            m, n = labels.shape
            scores = weights[ids].sum(axis=2)
            ahead, back = np.empty((m, n, k)), np.zeros((m, n, k))
            ahead[:, 0] = starts + scores[:, 0]
            for t in range(1, n):
                ahead[:, t] = _lse(ahead[:, t - 1, :, None] + steps, 1) + scores[:, t]
            for t in range(n - 2, -1, -1):
                back[:, t] = _lse(steps + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            total = _lse(ahead[:, -1], 1)
            share = np.eye(k)[labels] - np.exp(ahead + back - total[:, None, None])
            np.add.at(grad[0], ids.reshape(m * n, -1), share.reshape(m * n, 1, k))
            grad[2] += share[:, 0].sum(axis=0)
            for t in range(1, n):
                both = np.exp(ahead[:, t - 1, :, None] + steps + (scores[:, t] + back[:, t])[:, None, :] - total[:, None, None])
                np.add.at(grad[1], (labels[:, t - 1], labels[:, t]), 1.0)
                grad[1] -= both.sum(axis=0)
        grad[1][~_ALLOWED], grad[2][~_FIRST] = 0, 0
        for v, g, h in zip((weights, steps, starts), grad, seen, strict=True):
            h += g * g
            v += rate * g / np.sqrt(h)
        weights[-1] = 0
    return Field(names, weights, steps, starts)


def viterbi(field: Field, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The best label of each word; rows: its features' numbers, begins: whether a sequence starts. All sequences advance together, the long ones alone at the end."""
    n = len(rows)
    labels = np.zeros(n, np.int8)
    heads = np.flatnonzero(begins)
    sizes = np.diff(np.append(heads, n))
    order = np.argsort(-sizes, kind="stable")
    heads, sizes = heads[order], sizes[order]
    active = [int(np.searchsorted(-sizes, -t)) for t in range(int(sizes[0]) if len(sizes) else 0)]  # sequences longer than t
    came = np.zeros((n, len(LABELS)), np.int8)
    best = np.zeros((len(heads), len(LABELS)))
    for t, m in enumerate(active):
        at = heads[:m] + t
        score = field.weights[rows[at]].sum(axis=1)
        if t == 0:
            best[:m] = field.starts + score
            continue
        ways = best[:m, :, None] + field.steps
        came[at] = ways.argmax(axis=1)
        best[:m] = ways.max(axis=1) + score
    now = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = heads[:m] + t
        labels[at] = now[:m]
        now[:m] = came[at, now[:m]]
    return labels


def _holds(kind: str, found: bytes) -> bool:
    """Whether an added span can be what the field takes it for."""
    digits = bytes(c for c in found if 48 <= c <= 57)
    if kind == "email":
        return bool(re.fullmatch(rb"[A-Za-z0-9._%+-]+@\[?[A-Za-z0-9.:-]+", found))
    if kind == "ip":
        try:
            ipaddress.ip_address(found.decode("ascii"))
        except ValueError:
            return False
        return True
    if kind == "card":
        return 15 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(rb"[0-9 -]+", found))
    return 7 <= len(digits) <= 15 and bool(re.fullmatch(rb"[0-9 ().+/-]+", found))


# The labelled table

#: Fixed text: forms of each kind that the rules don't know, and of none. A 9 stands for any digit.
FORMS = {
    "email": ("user9@localhost", "ann.lee@intranet", "ops@[99.9.9.99]"),
    "ip": ("2001:db8::9", "fe80::9:2ff:fe99:9", "2001:db8:99:9::9a"),
    "card": ("3999 999999 99999", "3999-999999-99999", "399999999999999"),
    "phone": ("(999) 555-9999", "999-555-9999", "999.555.9999", "999 555 9999", "0999 555 9999", "(999) 555 9999"),
    "": ("2099-09-19", "99:99", "99,999", "9.9.9", "v9.99", "$99.99", "99%", "9999999", "999999", "99/99/2099", "No. 999", "9-9", "999 999", "x=99 y=99", "9999999999999999", "a9f9c9e9d9b9a9f9", "A9", "@user9", "9 + 9 = 9", "Q9 2099", "chapter 9 999", "99 99 99"),
}
CUES = {
    "email": ("mail", "email", "write to", "contact"), "ip": ("ip", "host", "from", "address"), "card": ("card", "amex", "pay with", "visa"),
    "phone": ("call", "phone", "tel", "mobile", "fax"), "": ("on", "see", "the", "of", "order", "about", "total"),
}
VARIANTS = 6


def _filled(form: str, seed: str, kind: str) -> str:
    digits = iter(hashlib.sha256(seed.encode()).hexdigest().translate(str.maketrans("abcdef", "123456")))
    out = [next(digits) if c == "9" else c for c in form]
    if kind == "card":  # the last digit makes the sum right
        last = max(i for i, c in enumerate(out) if c.isdigit())
        out[last] = next(d for d in "0123456789" if luhn("".join(c for c in [*out[:last], d] if c.isdigit()).encode()))
    return "".join(out)


def seeds() -> Iterator[tuple[str, str, int, int]]:
    """(text, kind or empty, start, end) of the fixed examples."""
    for kind, forms in FORMS.items():
        for form in forms:
            for cue in CUES[kind]:
                for i in range(VARIANTS):
                    value = _filled(form, f"{kind}:{form}:{cue}:{i}", kind)
                    yield f"please {cue} {value} then go on", kind, 7 + len(cue) + 1, 7 + len(cue) + 1 + len(value)


def label_words(found: Words, spans: dict[str, list[tuple[int, int]]]) -> np.ndarray:
    """The label of each word by the spans that it overlaps; of several kinds the first listed counts."""
    labels = np.zeros(len(found.start), np.int8)
    for k in range(len(KINDS) - 1, -1, -1):
        some = sorted(spans[KINDS[k]])
        if some and len(labels):
            a, b = np.array(some).T
            i = np.searchsorted(b, found.start, side="right")  # the first span that ends after the word's start
            j = i.clip(max=len(a) - 1)
            in_span = (i < len(a)) & (a[j] < found.end)
            same = np.concatenate(([False], in_span[1:] & in_span[:-1] & (j[1:] == j[:-1]) & ~found.begins[1:]))
            labels[in_span] = np.where(same, 2 + 2 * k, 1 + 2 * k)[in_span]
    return labels


def _seed_rows() -> list[tuple[list[bytes], bytes, list[int]]]:
    out = []
    for text, kind, start, end in seeds():
        raw = text.encode()
        buf = np.frombuffer(raw, np.uint8)
        found = words(raw, buf)
        labels = label_words(found, {k: [(start, end)] if k == kind else [] for k in KINDS})
        heads = [*np.flatnonzero(found.begins).tolist(), len(labels)]
        for i, (a, b) in enumerate(zip(heads, heads[1:], strict=False)):
            out.append(([raw[x:y] for x, y in zip(found.start[a:b], found.end[a:b], strict=True)], found.before[i], labels[a:b].tolist()))
    return out


# Over a corpus

SCANNED = "base array<struct<kind:int,start:int,end:int>>, starts array<int>, ends array<int>, begins array<boolean>, labels array<tinyint>, words array<binary>, before array<binary>"


def _scan(batches):
    """Each text's spans by the rules, and its words with digits or @; offsets in code points."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, side="right")))
            part = [t or b"" for t in texts.slice(at, stop - at).to_pylist()]
            raw = b"\n".join(part) + b"\n"
            buf = np.frombuffer(raw, np.uint8)
            points = np.cumsum((buf & 0xC0) != 0x80, dtype=np.int32) - 1  # the code point that each byte starts or goes on with
            begin = np.cumsum([0, *[len(t) + 1 for t in part]])
            zero = points[begin[:-1]]
            spans, found = base_spans(raw, buf), words(raw, buf)
            labels = label_words(found, spans)
            flat = [(int(np.searchsorted(begin, a, side="right")) - 1, k, a, b) for k, kind in enumerate(KINDS) for a, b in spans[kind]]
            base: list[list[dict]] = [[] for _ in part]
            for i, k, a, b in flat:
                base[i].append({"kind": k, "start": int(points[a] - zero[i]), "end": int(points[b] - zero[i])})
            cut = np.searchsorted(found.start, begin)
            owner = np.searchsorted(begin, found.start, side="right") - 1
            starts, ends = points[found.start] - zero[owner], points[found.end] - zero[owner]
            heads = np.searchsorted(np.flatnonzero(found.begins), cut)
            lists = lambda values, kind, offsets=cut: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(at, stop - at), pa.array(base, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))), lists(starts, pa.int32()), lists(ends, pa.int32()), lists(found.begins, pa.bool_()), lists(labels, pa.int8()),
                    lists([raw[a:b] for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)], pa.binary()), lists(found.before, pa.binary(), heads),
                ],
                ["doc_id", "base", "starts", "ends", "begins", "labels", "words", "before"],
            )
            at = stop


def _sequences(words_: list[bytes], begins: list[bool], before: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    heads = [i for i, b in enumerate(begins) if b]
    yield from zip(heads, [*heads[1:], len(words_)][: len(heads)], before, strict=True)


def _examples(most: int):
    """Of a partition's different sequences of each kind the `most` with the smallest hashes."""

    def run(batches):
        held: list[dict[bytes, tuple]] = [{} for _ in range(len(KINDS) + 1)]
        for batch in batches:
            for i in range(batch.num_rows):
                found, begins, labels, before = (batch.column(c)[i].as_py() for c in ("words", "begins", "labels", "before"))
                for a, b, word in _sequences(found, begins, before):
                    b = min(b, a + LEARNED)
                    # A word that is a card's number by itself is one, even where the rules reject the longer number that it stands in.
                    of = [_CARD if not y and 16 <= len(w) <= 19 and w.isdigit() and luhn(w) else y for w, y in zip(found[a:b], labels[a:b], strict=True)]
                    key = hashlib.blake2b(b"\0".join([word, *found[a:b]]), digest_size=8).digest()
                    for kind in {(x + 1) // 2 for x in of}:
                        some = held[kind]
                        some[key] = (found[a:b], word, of)
                        if len(some) > 4 * most:
                            held[kind] = {k: some[k] for k in sorted(some)[:most]}
        rows = [(kind, k, *some[k]) for kind, some in enumerate(held) for k in sorted(some)[:most]]
        kinds = (pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.int8()))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], ["kind", "key", "words", "before", "labels"])

    return run


def learn(scanned: DataFrame, most: int = SAMPLE) -> Field:
    """The field of SEEDS and of `most` sequences of each kind: with the smallest hashes, so that reruns agree."""
    some = staged(scanned.mapInArrow(_examples(most), "kind int, key binary, words array<binary>, before binary, labels array<tinyint>"), "examples")
    one = some.groupBy("kind", "key").agg(F.first(F.struct("words", "before", "labels")).alias("row"))
    parts = [one.where(F.col("kind") == k).orderBy("key").limit(most) for k in range(len(KINDS) + 1)]
    rows = [r["row"] for p in parts for r in p.collect()]
    return train([*_seed_rows(), *[([bytes(w) for w in r["words"]], bytes(r["before"]), list(r["labels"])) for r in rows]])


def _decode(field: Field):
    """All spans of each row: the rules', and those of the field that overlap none of them."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                held = [part.column(c).to_pylist() for c in ("words", "begins", "before", "starts", "ends", "base")]
                rows, begins = [], []
                for found, starts, before, *_ in zip(*held, strict=True):
                    for a, b, word in _sequences(found, starts, before):
                        rows += _rows(field.names, found[a:b], word)
                        begins += [True] + [False] * (b - a - 1)
                labels = viterbi(field, np.array(rows, np.int32).reshape(-1, _WIDTH), np.array(begins, bool))
                out, offset = [], 0
                for found, first, _, starts, ends, base in zip(*held, strict=True):
                    own = labels[offset : offset + len(found)]
                    offset += len(found)
                    out.append(_merged(own, found, first, starts, ends, base))
                counts = [pa.array([sum(s["kind"] == k for s in base) for base in held[5]], pa.int64()) for k in range(len(KINDS))]
                base_text = [_written((s["kind"], s["start"], s["end"]) for s in base) for base in held[5]]
                digests = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base_text])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digests, pa.array([_written(s) for s in out], pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return run


def _written(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _merged(labels: np.ndarray, found: list[bytes], begins: list[bool], starts: list[int], ends: list[int], base: list[dict]) -> list[tuple[int, int, int]]:
    out = [(s["kind"], s["start"], s["end"]) for s in base]
    hit = np.flatnonzero(labels)
    if not len(hit):
        return out
    bounds = sorted((a, b) for _, a, b in out)
    tops = np.maximum.accumulate(np.array([b for _, b in bounds])) if bounds else np.zeros(0, int)
    lows = np.array([a for a, _ in bounds])
    for i in hit[labels[hit] % 2 == 1].tolist():
        kind, j = int(labels[i] - 1) // 2, i + 1
        while j < len(labels) and labels[j] == 2 * kind + 2 and not begins[j]:
            j += 1
        a, b = starts[i], ends[j - 1]
        before = int(np.searchsorted(lows, b))  # spans that start before this one's end
        if (not before or tops[before - 1] <= a) and _holds(KINDS[kind], b" ".join(found[i:j])):
            out.append((kind, a, b))
    return out


@whole
def personal_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs (doc_id, text).

    Null text counts as empty: no spans. Counts and base_sha256 are the rules'
    alone; spans holds all, by kind, then start. Offsets are code points. Every
    row gets a result, repeated ones and those without id too. A corpus without
    any span is decoded by what SEEDS teach; an empty table gives an empty one.
    Texts are scanned whole, in slices of about SLICE bytes, a longer text alone.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select("doc_id", "text")
    head = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"
    scanned = staged(rows.mapInArrow(_scan, f"{head}, {SCANNED}"), "scanned")
    return scanned.mapInArrow(_decode(learn(scanned)), ", ".join([head, *[f"n_{k} bigint" for k in KINDS], "base_sha256 string", "spans string"]))
