"""Personal data: base patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

Base spans are exact pattern matches with their checks (octets, Luhn, digit counts). The field is trained on a small
labelled table of tagged sentences, made by rule below; its features are the shape of a token, of what stands beside it
and of its run, and the word before.
A token without a digit or ``@`` can't be part of any kind, so its label is fixed; the chain then falls apart into runs
of the other tokens, and equally long runs of a batch are decoded together by Viterbi. Spans that the field finds are
added where they touch no base span.

Offsets are code points, ends exclusive. A null or empty text has no spans. Rows are judged one by one and where they
stand: repeated rows get equal results, null ids stay null, an empty table gives no rows. Every step takes time in
proportion to the text, so very long texts and very long tokens are no special case.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocore.llm import textops
from chronocore.llm.shared import documents, given_id, row_id
from chronocore.plans.storage import lean

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin within a run of digits: it would have begun at the run's first digit.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
NEEDED = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, in the order of ``KINDS`` and then of start."""
    found: list[Span] = []
    at = text.find("@")
    free = 0  # the end of the last match
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def written(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- the field ---------------------------------------------------------------------------------------------------------

LABELS = ("O", "email", "ip", "card", "card+", "phone", "phone+")  # "+": goes on with the token before
FORBIDDEN = -1e4

#: How values are written: ``#`` is a digit, ``h`` a hexadecimal one, ``a`` a name, ``o`` an octet; the check digit of every other card fits.
VALUES = {
    "email": ("a.a@a.com", "a##@a.org", "a_a@mail.a.co.uk", "a+a@a-a.net", "A.a####@a.edu", "a@localhost", "a-a@a.io", "a.##@a#.a.com"),
    "ip": ("o.o.o.o",),
    "card": ("4### #### #### ####", "5###-####-####-####", "4###############", "5###############", "3### ###### #####", "6###############", "34#############", "2### #### #### ####"),
    "phone": (
        "+1 (###) 555-01##", "+49 30 #######", "+44 20 #### ####", "+33 1 ## ## ## ##", "(###) 555-01##", "###-555-01##", "1-800-###-####", "+1.###.555.01##", "+34 (91) ###-####",
        "+1555#######", "+49151########", "0### ### ####", "+39 06 ########", "+## ### ### ####",
    ),
    "": (
        "#.#.#", "v#.##.#", "20##-0#-1#", "1#/0#/20##", "1#:3#", "$##.99", "#,###", "##%", "978-3-16-######-#", "isbn 978##########", "isbn 978-0-##-######-#", "invoice ##############",
        "invoice 20############", "order ########", "order #################", "serial ###############", "tracking ################", "ref ###-##-####", "###-##-####", "ssn ###-##-####", "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh",
        "hhhhhhhh-hhhh-4hhh-hhhh-hhhhhhhhhhhh", "chapter #, page ###", "@a", "@a##", "5 @ ##", "19## and 20##", "### ### ###", "#.#####", "1 2 3 4 5 6 7 8 9", "room ###b", "H#O", "a#", "(##)", "12#,### euros", "#th of ####",
    ),
}
#: What values stand in, in the table and in what is held out from it.
LINES = {
    "email": ("write to {} today", "mail {}, please", "{}", "from {} on Monday", "<{}>", "{}### and more", "ask {}; then wait"),
    "ip": ("host {} is down", "{}", "ping {}, then wait", "from {}*** today", "({})", "{}:8080 open"),
    "card": ("paid with {} in May", "{}", "card {}.", "visa {} expires soon", "{}!! thanks", "in {}$$$ lost", "numbers {} there"),
    "phone": ("call {} now", "{}", "reach {} or wait", "tel {}.", "{}%%% today", "dial {}, ext", "fax {}"),
    "": ("see {} here", "{}", "the {} was set", "of {}, then", "it has {}.", "({})"),
}
HELD = {
    "email": ("send it over to {} by noon", "contact: {}", "{}, or come by", "[{}]"),
    "ip": ("server {} answered", "blocked {} again", "at {};", "[{}]"),
    "card": ("charged to card {} twice", "my number is {}, thanks", "{} was stolen", "[{}]"),
    "phone": ("my number: {} at home", "ring {} after five", "{}, evenings", "[{}]"),
    "": ("they wrote {} in the book", "about {} of them", "[{}]", "with {}; next"),
}
_NAMES = "anna ben carla dora emil fritz gina hugo ines jonas karl lena marta nils olga paul rosa sven tina ulla vera willi".split()


def _value(kind: str, pattern: str, r: random.Random) -> str:
    made = {"#": lambda: r.choice("0123456789"), "h": lambda: r.choice("0123456789abcdef"), "a": lambda: r.choice(_NAMES), "A": lambda: r.choice(_NAMES).title(), "o": lambda: str(r.randrange(1, 256))}
    if kind == "email":
        user, _, host = pattern.partition("@")
        end = re.search(r"\.(com|org|co\.uk|net|edu|io)$|localhost$|^mail\.", host)
        parts = re.split(r"(\.(?:com|org|co\.uk|net|edu|io)$|localhost$|^mail\.)", host) if end else [host]
        fill = lambda x: "".join(made[c]() if c in "#aA" else c for c in x)
        return fill(user) + "@" + "".join(x if i % 2 else fill(x) for i, x in enumerate(parts))
    keys = {"ip": "o", "": "#h" if "hhhh" in pattern else "#a" if pattern[0] in "@a" else "#"}.get(kind, "#")
    text = "".join(made[c]() if c in keys else c for c in pattern)
    if kind == "card" and r.random() < 0.5:
        while not luhn(NOT_DIGIT.sub("", text)):
            text = text[:-1] + r.choice("0123456789")
    return text


def sentences(lines: Mapping[str, Sequence[str]], each: int, seed: int) -> list[str]:
    """``each`` sentences for every way to write a value; spans are in braces, with their kind."""
    r, out = random.Random(seed), []
    for kind, patterns in VALUES.items():
        for pattern in patterns:
            for _ in range(each * (6 if kind == "ip" else 1)):
                value = _value(kind, pattern, r)
                out.append(r.choice(lines[kind]).format(f"{{{kind}:{value}}}" if kind else value))
    for _ in range(20 * each):  # values of two kinds side by side
        out.append(" ".join(f"{{{kind}:{_value(kind, r.choice(VALUES[kind]), r)}}}" for kind in r.sample(KINDS, 2)))
    return out


#: The labelled table, and sentences of other lines and values that the field never sees.
TABLE, HELD_OUT = sentences(LINES, 4, 1), sentences(HELD, 6, 2)


def shape(token: str) -> list[str]:
    """The features of a token by its shape alone: classes of characters, their counts and the order in which they come."""
    digits = sum(c.isdecimal() and c.isascii() for c in token)
    core = token.strip("\"'<>[]{}*%$&#!?,;:.=|")
    short = re.sub(r"(.)\1+", r"\1", "".join("9" if c in "0123456789" else "a" if c.isalpha() else c for c in core))[:24]
    count = digits if digits <= 4 else 5 if digits <= 6 else 7 if digits <= 8 else 9 if digits <= 12 else 13 if digits <= 19 else 20
    found = [f"digits={count}", f"shape={short}" if len(short) <= 8 else "shape=long", f"letters={any(c.isalpha() for c in core)}"]
    found += [f"has{c}" for c in "@.-+(/:_" if c in core]
    left, at, right = core.partition("@")
    found += ["user@host"] * bool(left and at and right) + ["user@host.end"] * bool(left and "." in right)
    found += ["quad"] * bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?", core)) + ["plain digits"] * bool(re.fullmatch(r"[0-9]+", core))
    found += [f"plain{len(core)}"] * bool(re.fullmatch(r"[0-9]{1,6}", core)) + ["plain card"] * bool(re.fullmatch(r"[0-9]{13,19}", core)) + ["grouped"] * bool(re.fullmatch(r"[0-9]{2,4}(-[0-9]{2,4}){1,4}", core))
    found += ["closed"] * (core != token and token[-1:] in ",;:!?.")
    return found


def word_before(text: str, at: int) -> str:
    """The word that ends before the run of tokens at ``at``, in lower case and without signs."""
    words = text[max(0, at - 24) : at].split()
    return words[-1].strip("\"'<>[](){}*%$&#!?,;:.=|").lower() if words else ""


def _run_features(run: Sequence[str], before: str) -> list[list[str]]:
    """Features of each token of a run, with the shape of the neighbours, or the word before the run."""
    own = [shape(x) for x in run]
    whole = [f"digits in run={min(sum(c.isdecimal() for x in run for c in x), 20)}", f"tokens={min(len(run), 6)}"]
    out = []
    for i, f in enumerate(own):
        f = [*f, *whole, *([f"word={before}"] if not i else [])]
        left = [f"left {x}" for x in own[i - 1][:2]] if i else ["left none"]
        right = [f"right {x}" for x in own[i + 1][:2]] if i + 1 < len(own) else ["right none"]
        out.append([*f, *left, *right])
    return out


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that hold a digit or ``@``."""
    found: list[list[tuple[int, int]]] = []
    near = False
    for m in TOKEN.finditer(text):
        if NEEDED.search(text, m.start(), m.end()):
            if near:
                found[-1].append(m.span())
            else:
                found.append([m.span()])
            near = True
        else:
            near = False
    return found


def parsed(line: str) -> tuple[str, list[Span]]:
    """The text of a sentence of the table, and its spans."""
    text, spans = "", []
    for part in re.split(r"(\{\w+:[^}]*\})", line):
        m = re.fullmatch(r"\{(\w+):([^}]*)\}", part)
        if m:
            spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2] if m else part
    return text, spans


def labelled_runs(table: Sequence[str] = TABLE) -> list[tuple[list[str], str, list[int]]]:
    """(tokens, the word before, labels) of every run of the table."""
    out = []
    for line in table:
        text, spans = parsed(line)
        for run in runs(text):
            labels = []
            for a, b in run:
                hit = next(((k, s) for k, s, e in spans if a < e and s < b), None)
                first = hit and a <= hit[1]
                labels.append(LABELS.index("O") if not hit else LABELS.index(hit[0] if first else hit[0] + "+") if hit[0] + "+" in LABELS else LABELS.index(hit[0]))
            out.append(([text[a:b] for a, b in run], word_before(text, run[0][0]), labels))
    return out


def allowed() -> np.ndarray:
    """Transition scores of zero, and ``FORBIDDEN`` where a continued span would not go on."""
    t = np.zeros((len(LABELS) + 1, len(LABELS)))  # the last row: from the start of a run
    for j, name in enumerate(LABELS):
        if name.endswith("+"):
            t[:, j] = FORBIDDEN
            t[LABELS.index(name), j] = t[LABELS.index(name[:-1]), j] = 0
    return t


class Field:
    """Weights of features by label, and of transitions."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves

    def emissions(self, run: Sequence[str], before: str = "") -> np.ndarray:
        return np.stack([self.weights[[self.names[f] for f in fs if f in self.names]].sum(axis=0) for fs in _run_features(run, before)])


def train(table: Sequence[str] = TABLE, steps: int = 250, rate: float = 0.3, decay: float = 2e-3) -> Field:
    """Full-gradient training of the log-likelihood by forward and backward sums, all runs at once."""
    rows = labelled_runs(table)
    features = [_run_features(r, before) for r, before, _ in rows]
    names: dict[str, int] = {}
    for fs in features:
        for f in fs:
            for x in f:
                names.setdefault(x, len(names))
    n, longest, k = len(rows), max((len(r) for r, *_ in rows), default=1), len(LABELS)
    x = np.zeros((n, longest, len(names)))
    y, live = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (fs, (*_, labels)) in enumerate(zip(features, rows, strict=True)):
        for j, f in enumerate(fs):
            x[i, j, [names[a] for a in f]] = 1
        y[i, : len(labels)], live[i, : len(labels)] = labels, True
    gold = np.eye(k)[y] * live[..., None]
    fixed = allowed()
    free = fixed == 0
    weights, moves = np.zeros((len(names), k)), np.zeros_like(fixed)
    sums = [np.zeros_like(weights), np.zeros_like(moves)]

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return np.squeeze(top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True)), axis)

    for _ in range(steps):
        score, t = x @ weights, moves + fixed
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = score[:, 0] + t[-1]
        for j in range(1, longest):
            alpha[:, j] = np.where(live[:, j, None], lse(alpha[:, j - 1, :, None] + t[:-1], 1) + score[:, j], alpha[:, j - 1])
        for j in range(longest - 2, -1, -1):
            beta[:, j] = np.where(live[:, j + 1, None], lse(t[:-1] + (score[:, j + 1] + beta[:, j + 1])[:, None, :], 2), 0)
        total = lse(alpha[:, -1], 1)
        here = np.exp(alpha + beta - total[:, None, None]) * live[..., None]
        dw = np.einsum("njf,njk->fk", x, gold - here) / n - decay * weights
        dm = np.zeros_like(moves)
        dm[-1] = (gold[:, 0] - here[:, 0]).sum(axis=0)
        for j in range(1, longest):
            both = np.exp(alpha[:, j - 1, :, None] + t[:-1] + (score[:, j] + beta[:, j])[:, None, :] - total[:, None, None]) * live[:, j, None, None]
            dm[:-1] += np.einsum("na,nb->ab", gold[:, j - 1], gold[:, j]) - both.sum(axis=0)
        dm = np.where(free, dm / n, 0) - decay * moves
        for g, s, w in ((dw, sums[0], weights), (dm, sums[1], moves)):
            s += g * g
            w += rate * g / (np.sqrt(s) + 1e-6)
    return Field(names, weights, moves + fixed)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of equally long runs; scores: runs x tokens x labels. Ties go to the first label."""
    n, longest, _ = scores.shape
    best, back = scores[:, 0] + moves[-1], []
    for j in range(1, longest):
        step = best[:, :, None] + moves[:-1]
        back.append(step.argmax(axis=1))
        best = step.max(axis=1) + scores[:, j]
    labels = np.empty((n, longest), int)
    labels[:, -1] = best.argmax(axis=1)
    for j in range(longest - 2, -1, -1):
        labels[:, j] = back[j][np.arange(n), labels[:, j + 1]]
    return labels


def field_spans(texts: Sequence[str], field: Field) -> list[list[Span]]:
    """The spans that the field finds in each text."""
    by_length: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    for i, text in enumerate(texts):
        for run in runs(text):
            by_length[len(run)].append((i, run))
    found: list[list[Span]] = [[] for _ in texts]
    for length, group in by_length.items():
        step = max(1, 20_000 // length)
        for at in range(0, len(group), step):
            part = group[at : at + step]
            scores = np.stack([field.emissions([texts[i][a:b] for a, b in run], word_before(texts[i], run[0][0])) for i, run in part])
            for (i, run), labels in zip(part, viterbi(scores, field.moves), strict=True):
                open_kind = ""
                for (a, b), label in zip(run, labels, strict=True):
                    name = LABELS[label]
                    a, b = _trimmed(texts[i], a, b, name)
                    if name == "O":
                        open_kind = ""
                    elif name.endswith("+") and open_kind == name[:-1]:
                        kind, first, _ = found[i][-1]
                        found[i][-1] = (kind, first, b)
                    else:
                        open_kind = name.rstrip("+")
                        found[i].append((open_kind, a, b))
    return found


def _trimmed(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """A token without the signs around it that are no part of the kind."""
    lead = "+(" if kind == "phone" else ""
    first, last = a, b
    while first < last - 1 and not (text[first].isalnum() or text[first] in lead):
        first += 1
    while last > first + 1 and not text[last - 1].isalnum():
        last -= 1
    return first, last


def all_spans(base: Sequence[Span], added: Sequence[Span]) -> list[Span]:
    """Base spans, and those added that touch none of them, by kind and start."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    spans = list(base)
    for kind, a, b in added:
        before = bisect_left(starts, b)
        if not before or reach[before - 1] <= a:
            spans.append((kind, a, b))
    return sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(docs: DataFrame, table: Sequence[str] = TABLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, base, spans) of every row: arrays of (kind, start, end)."""
    lean(docs.sparkSession)
    field = train(table)
    shared = docs.sparkSession.sparkContext.broadcast((field.names, field.weights, field.moves))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        needed = np.zeros(256, np.uint8)
        needed[[*range(48, 58), 64]] = 1
        rows = lambda spans: [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
        for b in batches:
            base: list[list[Span]] = [[] for _ in range(len(b))]
            every: list[list[Span]] = [[] for _ in range(len(b))]
            for first, part in textops.blocks(pc.fill_null(b.column(1), "")):
                data, offsets = textops.buffers(part)
                sums = np.concatenate([[0], np.cumsum(needed[data], dtype=np.int64)])
                some = np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]])
                texts = part.take(pa.array(some)).to_pylist()
                for i, t, added in zip(some, texts, field_spans(texts, field), strict=True):
                    base[first + i] = base_spans(t)
                    every[first + i] = all_spans(base[first + i], added)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows(base), span), pa.array(rows(every), span)], ["id", "base", "spans"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(row_id(docs, key), docs[text].cast("string").alias("text")).mapInArrow(run, f"id long, base {kind}, spans {kind}")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select(given_id().alias("doc_id"), *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
