"""Personal data: patterns, and a linear-chain CRF over word shapes that adds to them.

Patterns give the base spans of e-mail and IP addresses, card and phone numbers. The CRF reads words
(what white space parts) and labels each as outside, first or inside a span of a kind, from hashed
features of its shape and its neighbours'. It is trained in numpy on a small labelled table (rows of
text with marked spans; a default one is made here from written examples and a fixed seed) and decoded
by Viterbi, a batch of texts at a time. Every labelled word holds a digit or an @, so words without
either are outside by rule; a run of words between two such is decoded by itself, which changes
nothing, as the chain's two sides are independent there. CRF spans that touch a base span are left out.

Defined results: null texts are empty; offsets count code points, ends are exclusive; texts without
digits and @ have no spans; long texts are read whole; repeated rows get the same result each; an empty
table gives no rows. Columns named like the results are replaced; all others stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf as C
from . import kernels as K
from .shared import free, small_batches

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Possessive, and never begun inside a run of digits, so that long runs cost no more than their length.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGITS = re.compile(r"[0-9]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """Whether ASCII digits write a number up to 255; leading zeros, however many, don't count."""
    short = digits.lstrip("0") or "0"
    return len(short) <= 3 and int(short) <= 255


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start, then kind."""
    found = [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# The CRF.

_SIZE = 1 << 13
_LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_SHAPE = str.maketrans({**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), **dict.fromkeys("0123456789", "0")})
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_KEY = re.compile(r"[0-9@]")
_RUN = re.compile(r"(.)\1+")
_OPEN, _CLOSE = "\"'([{<", "\"')]}>.,;:!?*#%&$"


def _bare(word: str) -> str:
    return word.lstrip("\"'[{<").rstrip(_CLOSE)


def _features(words: list[str], i: int) -> list[int]:
    """Ids of the features of word i: its own shape and its neighbours'."""
    w = _bare(words[i])
    digits = _NOT_DIGIT.sub("", w)
    shape = w.translate(_SHAPE)
    short = _RUN.sub(r"\1", shape)
    before = words[i - 1] if i else ""
    after = words[i + 1] if i + 1 < len(words) else ""
    hexes = len(w) >= 16 and all(c in "0123456789abcdefABCDEF" for c in w)
    mixed = bool(digits) and any(c.isalpha() for c in w)
    parts = w.split(".")
    address = len(parts) == 4 and all(len(p) <= 3 and _DIGITS.fullmatch(p) and _octet(p) for p in parts)
    raw = (
        f"short {short[:16]}",
        f"shape {shape if len(shape) <= 14 else 'long'}",
        f"size {min(len(w), 40) // 4}",
        f"digits {min(len(digits), 20)}",
        f"digits only {w == digits} {min(len(digits), 20)}",
        f"at {'@' in w} {w.count('.')}",
        f"hex {hexes} {mixed}",
        f"check {len(digits) >= 14 and luhn(digits)} {len(digits)}" if len(digits) >= 14 else "check no",
        f"address {address}",
        f"first {w[:1].translate(_SHAPE)} {words[i][:1]}",
        f"before {_bare(before).lower() if len(before) < 10 and before.isascii() else ''}",
        f"before shape {_RUN.sub(r'\1', before.translate(_SHAPE))[:10]}",
        f"before key {bool(_KEY.search(before))} {len(_NOT_DIGIT.sub('', before))}",
        f"after key {bool(_KEY.search(after))} {len(_NOT_DIGIT.sub('', after))}",
        f"secret word {any(x in ' '.join(words[max(0, i - 2) : i]).lower() for x in ('token', 'secret', 'key', 'password'))}",
        f"call word {any(x in ' '.join(words[max(0, i - 3) : i]).lower() for x in ('call', 'phone', 'tel', 'fax', 'mobile'))}",
    )
    return [zlib.crc32(f"{k} {x}".encode()) % _SIZE for k, x in enumerate(raw)]


def _runs(text: str) -> tuple[list[str], list[tuple[int, int]], list[tuple[int, int]]]:
    """Words, their spans, and the runs (first, end) of words with a digit or @."""
    words, places, runs, last = [], [], [], -2
    for i, m in enumerate(_WORD.finditer(text)):
        words.append(m.group())
        places.append(m.span())
        if _KEY.search(words[-1]):
            if last == i - 1:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((i, i + 1))
            last = i
    return words, places, runs


#: Written examples: a row a text, with a place for each kind.
EXAMPLES = (
    "write to {email} before noon", "mail {email}, or call {phone}.", "contact: {email}", "the address {email} is out of use", "{email} wrote:",
    "the host {ip} did not answer", "from {ip} to {ip}", "server at {ip}.", "blocked {ip}, then {ip}",
    "paid with {card} on the day", "card number {card}.", "the card {card} was lost", "charge {card}, please",
    "phone {phone} in the morning", "call {phone}", "tel. {phone} or fax {phone}.", "reach me at {phone}, thanks", "the number is {phone}",
    'token = "{secret}"', "the key {secret} was found", 'password: "{secret}"', "secret {secret} in the file", 'with token = "{secret}" set',
    "in {year} there were {small} of them", "chapter {small}, page {small}", "version {version} came out in {year}", "a price of {price} for {small} pieces",
    "on {date} at {time}", "order {id} has {small} parts", "about {small} % of {large} people", "see section {version} and table {small}", "the years {year}-{year}",
    "room {small}a, floor {small}", "id {id}", "it weighs {price} kg", "{large} units since {date}", "{bad}", "number {bad} in the list",
)


def examples(rows: int = 600, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """The default labelled table: texts with their spans."""
    rng = np.random.default_rng(seed)
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("aeiounrstlmdkp"), int(rng.integers(2, 9))))

    def card(good: bool) -> str:
        body = str(rng.integers(1, 7)) + num(14)
        last = next(c for c in "0123456789" if luhn(body + c) == good)
        n = body + last
        return f"{n[:4]} {n[4:8]} {n[8:12]} {n[12:]}" if good and rng.random() < 0.3 else n

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return str(rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+44 {num(4)} {num(6)}", f"{a}.{b}.{c}", f"+49 {num(3)} {num(7)}"]))

    make = {
        "email": lambda: f"{word()}{rng.choice(['', '.', '_'])}{rng.choice(['', num(2)])}@{word()}{rng.choice(['', num(1)])}.{rng.choice(['com', 'example.com', 'org', 'net', 'de'])}",
        "ip": lambda: ".".join(map(str, rng.integers(0, 256, 4))), "card": lambda: card(True), "phone": phone,
        "secret": lambda: "".join(rng.choice(list("0123456789abcdef"), int(rng.choice([32, 40, 40, 64])))),
        "year": lambda: str(rng.integers(1800, 2030)), "small": lambda: str(rng.integers(1, 100)), "large": lambda: f"{rng.integers(1, 900)},{num(3)}",
        "version": lambda: ".".join(map(str, rng.integers(0, 20, int(rng.integers(2, 4))))), "price": lambda: f"${rng.integers(1, 900)}.{num(2)}",
        "date": lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", "time": lambda: f"{rng.integers(0, 24)}:{rng.integers(0, 60):02d}",
        "id": lambda: num(int(rng.integers(3, 10))), "bad": lambda: card(False),
    }
    out = []
    for k in range(rows):
        text, spans = " ".join(word() for _ in range(int(rng.integers(0, 5)))) + " ", []
        for part in re.split(r"(\{\w+\})", EXAMPLES[k % len(EXAMPLES)]):
            value = make[part[1:-1]]() if part.startswith("{") else part
            if part[1:-1] in KINDS:
                spans.append((len(text), len(text) + len(value), part[1:-1]))
            text += value
        out.append((text + rng.choice(["", ".", " " + word()]), spans))
    return out


def train(rows: list[tuple[str, list[Span]]]) -> C.Crf:
    """A CRF from labelled texts."""
    features, labels, offs = [], [], [0]
    for text, spans in rows:
        words, places, runs = _runs(text)
        for a, b in runs:
            for i in range(a, b):
                inside = next((s for s in spans if s[0] < places[i][1] and places[i][0] < s[1]), None)
                first = inside and not any(inside[0] < places[j][1] and places[j][0] < inside[1] for j in range(a, i))
                labels.append(_LABELS.index(f"{'B' if first else 'I'}-{inside[2]}") if inside else 0)
                features.append(_features(words, i))
            offs.append(len(labels))
    ruled = np.zeros((len(_LABELS), len(_LABELS)))
    for i, x in enumerate(_LABELS):
        if x[0] == "I":  # only after the same kind
            ruled[[j for j, y in enumerate(_LABELS) if y[2:] != x[2:] or y == "O"], i] = -np.inf
    crf = C.train(np.array(features), np.array(labels), np.array(offs), _SIZE, len(_LABELS), rounds=120, rate=0.1, l2=1e-4, fixed=ruled)
    crf.start[[i for i, x in enumerate(_LABELS) if x[0] == "I"]] = -1e4
    return crf


@cache
def default_model() -> C.Crf:
    return train(examples())


def crf_spans(texts: list[str], crf: C.Crf) -> list[list[Span]]:
    """Spans that the CRF finds in each text."""
    features, offs, of = [], [0], []
    for t, text in enumerate(texts):
        words, places, runs = _runs(text)
        for a, b in runs:
            features += [_features(words, i) for i in range(a, b)]
            offs.append(len(features))
            of.append((t, places[a:b]))
    out: list[list[Span]] = [[] for _ in texts]
    if not features:
        return out
    labels = crf.viterbi(crf.scores(np.array(features)), np.array(offs)).tolist()
    for (t, places), a in zip(of, offs, strict=False):
        span: list | None = None
        for k, place in enumerate([*places, (0, 0)]):
            label = _LABELS[labels[a + k]] if k < len(places) else "O"
            if span and label[0] != "I":
                start, end, kind = span
                while start < end and texts[t][start] in _OPEN and not (kind == "phone" and texts[t][start] == "("):
                    start += 1
                while start < end and texts[t][end - 1] in _CLOSE:
                    end -= 1
                if start < end:
                    out[t].append((start, end, kind))
                span = None
            if label[0] == "B":
                span = [*place, label[2:]]
            elif label[0] == "I" and span:
                span[1] = place[1]
    return out


_WATCHED = np.zeros(256, bool)
_WATCHED[[*range(0x30, 0x3A), 0x40]] = True


def find(column: pa.Array, crf: C.Crf):
    """(row, text, base spans, all spans) of each text with a digit or an @."""
    for at, _, data, offs in K.slices(column):
        marks = np.concatenate(([0], np.cumsum(_WATCHED[data])))
        rows = np.flatnonzero(marks[offs[1:]] > marks[offs[:-1]])
        texts = [data[offs[i] : offs[i + 1]].tobytes().decode() for i in rows]
        for i, text, more in zip(rows.tolist(), texts, crf_spans(texts, crf), strict=True):
            base = base_spans(text)
            extra = [s for s in more if not any(s[0] < b and a < s[1] for a, b, _ in base)]
            yield at + i, text, base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detect(text: Column, crf: C.Crf) -> Column:
    """struct<n_email, n_ip, n_card, n_phone, base_sha256, spans> of each text."""

    @F.arrow_udf("struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>")
    def found(column: pa.Array) -> pa.Array:
        counts = np.zeros((4, len(column)), np.int64)
        sums, spans = [hashlib.sha256(b"").hexdigest()] * len(column), [""] * len(column)
        for i, _, base, every in find(column, crf):
            for _, _, kind in base:
                counts[BASE.index(kind), i] += 1
            sums[i], spans[i] = hashlib.sha256(_written(base).encode()).hexdigest(), _written(every)
        return pa.StructArray.from_arrays([*map(pa.array, counts), pa.array(sums, pa.string()), pa.array(spans, pa.string())], [*(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return found(text)


def redact(text: Column, crf: C.Crf) -> Column:
    """The text with every span (those that overlap as one) as its kind in brackets; null stays null."""

    @F.arrow_udf("string")
    def hidden(column: pa.Array) -> pa.Array:
        new: dict[int, str] = {}
        for i, t, _, every in find(column, crf):
            if every:
                joined: list[list] = []
                for a, b, kind in every:
                    if joined and a < joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b, kind])
                out, at = [], 0
                for a, b, kind in joined:
                    out += [t[at:a], f"[{kind.upper()}]"]
                    at = b
                new[i] = "".join(out) + t[at:]
        if not new:
            return column.cast(pa.string())
        return pa.array([new.get(i, x) for i, x in enumerate(column.to_pylist())], pa.string())

    return hidden(text)


def scan(docs: DataFrame, text: str = "text", labelled: list[tuple[str, list[Span]]] | None = None) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all)."""
    names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans"]
    kept = docs.drop(*names)
    crf = default_model() if labelled is None else train(labelled)
    small_batches(docs.sparkSession)
    new = free(docs, "_pii")
    return docs.withColumn(new, detect(F.col(text), crf)).select(*kept.columns, *(f"{new}.{n}" for n in names))


def hide(docs: DataFrame, text: str = "text", labelled: list[tuple[str, list[Span]]] | None = None) -> DataFrame:
    """docs with every span of the text replaced."""
    small_batches(docs.sparkSession)
    return docs.withColumn(text, redact(F.col(text), default_model() if labelled is None else train(labelled)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
