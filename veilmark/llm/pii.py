"""Personal data by patterns and a semi-Markov conditional random field.

Base patterns find e-mail addresses, IP addresses, card and phone numbers.  A semi-Markov
CRF then looks at the places with digits or address signs: every run of tokens up to
``MAX_TOKENS`` is a candidate span of each type, scored by features of the whole span
(length in digits, grouping, separators, check digit, neighbours), and a dynamic program
over the places chooses boundaries and types jointly.  Its spans are added where no base
span stands; base spans always stay.

The weights are fitted by conditional likelihood on a bounded sample of stretches: base
spans are the labels, and each also appears with other separators, without its plus sign
or with its signs spelled out, so that forms beyond the base patterns are learned.

Defined results: a null or empty text has no spans; repeated rows give equal rows; if the
sample holds no personal data at all, there is no model and only base spans are found.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from veilmark.llm.common import Spans, boxed, per_text, pick, releasing, slices, texts, written

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  Each begins where no earlier match of its kind could
# go on, so that a failing run of digits is read once only.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")

#: Stretches of text around base spans that the weights are fitted on.
SAMPLE = 2000
#: Longer stretches, around spans of nearly so many characters, are not learned from; their
#: spans are found all the same.
LONGEST = 1000
#: Longest candidate span in tokens, and characters around a seed that are looked at.
MAX_TOKENS = 24
AROUND = 48
#: Least posterior probability of an added span.
LEAST = 0.8


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text):
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part):
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text):
    """Leftmost, non-overlapping; walks left from each @ as far as the last match."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            out.append((start, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text):
    """(start, kind number, end) of all base matches, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(_small(p) for p in m.group().split(".")):
                    out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _digits(m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the semi-Markov model -------------------------------------------------
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\S\n]+|.", re.S)
_NUMBER = re.compile(r"[0-9](?:[^\w\n]{0,2}[0-9]){5,}+")
_SPELLED = re.compile(r"@|[\[({]\s?at\s?[\])}]|\bat\s+[\w-]+\s+dot\b", re.I)
_AT = re.compile(r"^(?:@|[\[({]?at[\])}]?)$", re.I)


def regions(text):
    """Stretches around seeds, joined where they overlap, as (start, end)."""
    seeds, out = [], []
    if _DIGIT.search(text):
        seeds += [m.span() for m in _NUMBER.finditer(text)]
    seeds += [m.span() for m in _SPELLED.finditer(text)]
    for first, last in sorted(seeds):
        a, b = max(0, first - AROUND), min(len(text), last + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def tokens(text, start, end):
    """Token spans of a region without tokens that its edges cut."""
    spans = [m.span() for m in _TOKEN.finditer(text, start, end)]
    if spans and start and text[start - 1].isalnum() and text[start].isalnum():
        spans = spans[1:]
    if spans and end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        spans = spans[:-1]
    return spans


def _near(text, at):
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def features(text, start, end, kind):
    """Features of a whole span as a type, or None if it can't be one."""
    value = text[start:end]
    numbers = re.findall(r"[0-9]+", value)
    n = sum(map(len, numbers))
    left, right = _near(text, start - 1), _near(text, end)
    out = [f"{kind}", f"{kind} left {left}", f"{kind} right {right}"]
    if kind == "email":
        parts = re.split(r"@|\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+", value, flags=re.I)
        if len(parts) != 2:
            return None
        host = re.split(r"\.|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+", parts[1], flags=re.I)
        if len(host) < 2 or not all(re.fullmatch(r"[A-Za-z0-9-]+", p) for p in host):
            return None
        if not re.fullmatch(r"[A-Za-z0-9._%+-]+", parts[0]) or not host[-1].isalpha():
            return None
        sign = "@" if "@" in value else "at"
        out += [f"email sign {sign}", f"email host {min(len(host), 4)}", f"email tld {min(len(host[-1]), 7)}"]
        out.append("email spelled dot" if "." not in parts[1] else "email dot")
        return out
    if any(c.isalpha() for c in value):
        return None
    marks = "".join(sorted(set(re.sub(r"[0-9]", "", value))))
    shape = "-".join(str(len(x)) for x in numbers) if len(numbers) < 7 else "many"
    out += [f"{kind} digits {n}", f"{kind} marks {marks}", f"{kind} shape {shape}"]
    if kind == "card":
        if not 12 <= n <= 19:
            return None
        out.append(f"card check {luhn(''.join(numbers))}")
    elif kind == "phone":
        if not 7 <= n <= 15 or value.count("(") != value.count(")"):
            return None
        out.append(f"phone first {value[0] if not value[0].isdigit() else 'digit'}")
    else:
        if len(numbers) != 4 or not all(len(x) <= 3 and int(x) <= 255 for x in numbers):
            return None
    return out


def candidates(text, spans):
    """(first token, token after the last, kind, features) of each candidate span."""
    out = []
    for i, (start, _) in enumerate(spans):
        c = text[start]
        if not (c.isalnum() or c in "+("):
            continue
        digits, signs = 0, False
        for j in range(i, min(i + MAX_TOKENS, len(spans))):
            a, b = spans[j]
            value = text[a:b]
            if "\n" in value:
                break
            digits += b - a if "0" <= value[0] <= "9" else 0
            signs = signs or _AT.match(value) is not None
            if not (value[-1].isalnum() or value == ")"):
                continue
            kinds = ["email"] if signs else []
            if 4 <= digits <= 19:
                kinds += ["ip", "card", "phone"]
            for kind in kinds:
                found = features(text, start, b, kind)
                if found:
                    out.append((i, j + 1, kind, found))
    return out


class SemiMarkov:
    """Segments of the four types, and single tokens of none."""

    def __init__(self, weights=None):
        self.weights = dict(weights or {})

    def score(self, found):
        return sum(self.weights.get(f, 0.0) for f in found)

    def passes(self, n, scored):
        """Logs of the sums over all segmentations of each prefix and each suffix."""
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        ends, begins = defaultdict(list), defaultdict(list)
        for i, j, s in scored:
            ends[j].append((i, s))
            begins[i].append((j, s))
        for j in range(1, n + 1):
            ahead[j] = _logsum([ahead[j - 1]] + [ahead[i] + s for i, s in ends[j]])
        for i in range(n - 1, -1, -1):
            behind[i] = _logsum([behind[i + 1]] + [behind[j] + s for j, s in begins[i]])
        return ahead, behind

    def fit(self, sequences, rounds=8, rate=0.5, decay=1e-3, seed=7):
        """``sequences``: (number of tokens, candidates, set of true (i, j, kind))."""
        squares, order = defaultdict(lambda: 1e-6), list(sequences)
        shuffle = random.Random(seed).shuffle
        for _ in range(rounds):
            shuffle(order)
            for n, found, truth in order:
                scored = [(i, j, self.score(f)) for i, j, _, f in found]
                ahead, behind = self.passes(n, scored)
                slope = defaultdict(float)
                for (i, j, kind, names), (_, _, s) in zip(found, scored):
                    p = math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[n]))
                    change = ((i, j, kind) in truth) - p
                    if abs(change) > 1e-4:
                        for name in names:
                            slope[name] += change
                for name, g in slope.items():
                    g -= decay * self.weights.get(name, 0.0)
                    squares[name] += g * g
                    self.weights[name] = self.weights.get(name, 0.0) + rate * g / math.sqrt(squares[name])
        return self

    def decode(self, text, spans, least=LEAST):
        """The best segmentation's entities with posterior at least ``least``."""
        found = candidates(text, spans)
        if not found:
            return []
        n = len(spans)
        scored = [(i, j, self.score(f)) for i, j, _, f in found]
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        ends = defaultdict(list)
        for k, (_, j, _) in enumerate(scored):
            ends[j].append(k)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for k in ends[j]:
                total = best[scored[k][0]] + scored[k][2]
                if total > best[j]:
                    best[j], back[j] = total, k
        ahead, behind = self.passes(n, scored)
        out, j = [], n
        while j:
            k = back[j]
            if k is None:
                j -= 1
                continue
            i, _, s = scored[k]
            if math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[n])) >= least:
                out.append((spans[i][0], KINDS.index(found[k][2]), spans[j - 1][1]))
            j = i
        return out[::-1]


def _logsum(values):
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _variants(kind, value, rng):
    """Other ways to write a value of a kind."""
    if kind == 0:
        at, dot = rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("@", ".")])
        local, host = value.split("@")
        return local + at + host.replace(".", dot)
    digits = _digits(value)
    if kind == 2 and len(digits) == 16:
        mark = rng.choice([".", " ", "-", ""])
        return mark.join(digits[i : i + 4] for i in range(0, 16, 4))
    if kind == 3 and len(digits) >= 10:
        head, a, b, c = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{head}-{a}-{b}-{c}", f"00{head} {a} {b} {c}"])
    return value


def _distractor(rng):
    """Numbers that are no personal data: dates, amounts, versions, plain counts."""
    r = rng.randint
    return rng.choice([
        f"{r(1900, 2099)}-{r(1, 12):02}-{r(1, 28):02}", f"{r(1, 28):02}.{r(1, 12):02}.{r(1900, 2099)}",
        f"{r(1, 999)},{r(0, 999):03}.{r(0, 99):02}", f"{r(1, 9)}.{r(0, 30)}.{r(0, 30)}", str(r(10**5, 10**11)),
        f"{r(0, 23):02}:{r(0, 59):02}:{r(0, 59):02}", f"{r(1, 300)}-{r(301, 600)}", str(r(10**15, 10**16)),
        f"{r(100000, 999999)} {r(100000, 999999)}", f"{r(1, 99)} {r(1, 99)} {r(1, 99)} {r(1, 99)} {r(1, 99)}",
        f"ISBN 978-{r(0, 9)}-{r(100, 999)}-{r(10000, 99999)}-{r(0, 9)}", f"{r(1, 12)} at {r(1, 12)}.30",
    ])


def training(text, rng):
    """Sequences from one document: each base span as it is, rewritten, and a number that
    is none in its place."""
    out = []
    for start, kind, end in base_spans(text):
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        for value, true in ((text[start:end], True), (_variants(kind, text[start:end], rng), True), (_distractor(rng), False)):
            local = before + value + after
            at = len(before)
            spans = tokens(local, 0, len(local))
            found = candidates(local, spans)
            begins = {a: i for i, (a, _) in enumerate(spans)}
            ends = {b: i + 1 for i, (_, b) in enumerate(spans)}
            stop = at + len(value)
            wanted = [(at, kind, stop)] if true else []
            wanted += [(a, k, b) for a, k, b in base_spans(local) if b <= at or a >= stop]
            truth = {(begins.get(a), ends.get(b), KINDS[k]) for a, k, b in wanted}
            if found and not any(i is None or j is None for i, j, _ in truth):
                out.append((len(spans), found, truth))
    return out


def fit(docs, sample=SAMPLE, id_col="doc_id", text_col="text"):
    """Weights from a sample of the stretches around base spans: the ``sample`` first by
    the hash of the stretch, so that the choice is the same however the rows lie."""

    def run(batches):
        for batch in slices(batches):
            cut = []
            for text in texts(batch):
                for start, _, end in base_spans(text):
                    cut.append(text[max(0, start - AROUND) : end + AROUND])
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string())], names=["text"])

    found = pick(docs, id_col, text_col).select("text").mapInArrow(releasing(run), "text STRING")
    found = found.where(F.length("text") < LONGEST).select("text", F.xxhash64("text").alias("h"))
    found = written(found, "stretches")
    # Hashes are even, so the least of them, in this share, hold the sample; the others need
    # not leave their tasks.
    count = found.count()
    if count > 4 * sample:
        least = found.where(F.col("h") < (2 * sample << 64) // count - (1 << 63))
        found = least if least.count() >= sample else found
    chosen = found.orderBy("h", "text").limit(sample)
    rng = random.Random(11)
    sequences = [s for row in chosen.collect() for s in training(row.text, rng)]
    return SemiMarkov().fit(sequences).weights


def find(text, model):
    """(base spans, all spans) of a text, each (start, kind number, end) in order."""
    base = base_spans(text)
    if model is None:
        return base, base
    more, known = [], Spans((a, b) for a, _, b in base)
    for start, end in regions(text):
        spans = tokens(text, start, end)
        more += [span for span in model.decode(text, spans) if not known.touch(span[0], span[2])]
    return base, sorted({*base, *more})


def described(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


COLUMNS = (
    "n_email BIGINT, n_ip BIGINT, n_card BIGINT, n_phone BIGINT, base STRING, spans STRING"
)


def detect(docs, weights, id_col="doc_id", text_col="text", least=LEAST):
    """``doc_id``, base counts, base spans and all spans of every whole text."""
    model = SemiMarkov(weights) if weights else None

    def run(batch):
        rows = []
        for text in texts(batch):
            base, spans = find(text, model)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
            rows.append((*counts, described(base), described(spans)))
        parts = zip(*rows)
        return [pa.array(p, t) for p, t in zip(parts, [pa.int64()] * 4 + [pa.string()] * 2)]

    return per_text(pick(docs, id_col, text_col), run, COLUMNS)


def masked(text, spans):
    """The text with each span replaced by its kind; overlapping spans as one."""
    out, free = [], 0
    for start, kind, end in spans:
        if start >= free:
            out += [text[free:start], f"[{KINDS[kind].upper()}]"]
        free = max(free, end)
    return "".join(out) + text[free:]


def mask_documents(docs, weights, text_col="text"):
    """The documents with all their columns, personal data replaced in the text."""
    model = SemiMarkov(weights) if weights else None

    def run(batches):
        for batch in slices(batches):
            place = batch.schema.get_field_index("text")
            there = batch.column(place).is_valid().to_pylist()
            new = [masked(t, find(t, model)[1]) if v else None for t, v in zip(texts(batch), there)]
            columns = list(batch.columns)
            columns[place] = pa.array(new, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    inner, back = boxed(docs, text_col)
    return back(inner.mapInArrow(releasing(run), inner.schema))
