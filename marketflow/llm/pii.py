"""Personal data: exact patterns, plus spans found by a character BiLSTM-CRF.

The patterns give the base spans (email, ip, card, phone), which always stay. They also label the training
windows of the tagger: a bounded sample (``TRAIN_WINDOWS`` windows in hash order, drawn from all documents),
half of it with the separators of labelled spans rewritten (no plus sign, ``[.]`` for dots, ``(at)`` for @,
digit groups), so that the tagger learns forms the patterns do not list. For a text, the windows of
``WINDOW`` characters, every ``STRIDE`` characters, that hold a trigger (a digit, @, (at) or [at]; every
kind needs one) get emissions; where windows overlap these are averaged by distance from the window's
edge, and each covered stretch is decoded once as a whole by the CRF. A decoded span is added when it
overlaps no base span and passes the check of its kind.

Defined cases: null and empty texts have no spans; texts are read to their end; rows are judged one by one;
with no text at all nothing is trained and nothing added. Input columns stay, except that columns with the
names of ``COLUMNS`` are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm import common
from marketflow.llm.char_tagger import Tagger, char_codes

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
TRAIN_WINDOWS = 3000
TRAIN_STEPS = 260
COLUMNS = ("spans", "base_spans")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the patterns' matches, by kind and start."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    out += [(1, m.start(), m.end()) for m in IP.finditer(text)
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def plausible(kind: int, s: str) -> bool:
    """The check an added span has to pass."""
    digits = _digits(s)
    if kind == 0:
        return re.fullmatch(r"[A-Za-z0-9._%+-]+\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\[\.\])\s?[A-Za-z0-9-]+)+", s) is not None
    if kind == 1:
        parts = re.split(r"\s?(?:\[\.\]|\(\.\)|\.)\s?", s)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and re.fullmatch(r"[0-9]+(?:[ .-][0-9]+)*", s) is not None and luhn(digits)
    return 7 <= len(digits) <= 15 and re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|00[0-9 ().-]+[0-9]", s) is not None


def _variant(kind: int, s: str, n: int) -> str:
    if kind == 0:
        return s.replace("@", (" (at) ", "[at]", " [at] ")[n % 3])
    if kind == 1:
        return s.replace(".", "[.]")
    if kind == 2:
        return (" ", "-", ".")[n % 3].join(_digits(s)[k:k + 4] for k in range(0, len(_digits(s)), 4))
    return re.sub(r"^\+[0-9]+[ .-]?", "", s) if n % 2 else s.replace("(", "").replace(") ", (".", "-")[n // 2 % 2])


def _windows(text: str) -> list[int]:
    """Starts of the windows that hold a trigger (touching windows on both sides of a trigger)."""
    numbers = {k for m in TRIGGER.finditer(text) for k in (m.start() // STRIDE - 1, m.start() // STRIDE, (m.end() - 1) // STRIDE)}
    return [k * STRIDE for k in sorted(numbers) if k >= 0]


def _tags(spans, start: int) -> np.ndarray:
    tags = np.zeros(WINDOW, np.int64)
    for kind, a, b in spans:
        for p in range(max(a, start), min(b, start + WINDOW)):
            tags[p - start] = 1 + 2 * kind + (p > a)
    return tags


def _padded(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    part = codes[start:start + WINDOW]
    out[:len(part)] = part
    return out


def training_windows(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of the bounded training sample."""

    def cut(batches):
        for piece in common.slices(batches, text_col):
            rows = []
            for text in piece.column(0).to_pylist():
                if not text or not TRIGGER.search(text):
                    continue
                spans = sorted(base_spans(text), key=lambda s: s[1])
                for start in _windows(text):
                    part = text[start:start + WINDOW]
                    inside = [s for s in spans if s[1] < start + WINDOW and s[2] > start]
                    rows.append((part, _tags(inside, start).astype(np.int8).tobytes(), bool(inside)))
                last = 0
                for n, (kind, a, b) in enumerate(spans):
                    if a < last:
                        continue
                    last = b
                    lead = (a * 7 + n) % 20
                    left, mid = text[max(0, a - lead):a], _variant(kind, text[a:b], a + n)
                    if TRIGGER.search(left):
                        left = ""
                    part = left + mid + re.split(r"[0-9@]", text[b:b + WINDOW])[0]
                    tags = _tags([(kind, len(left), len(left) + len(mid))], 0)
                    rows.append((part[:WINDOW], tags.astype(np.int8).tobytes(), True))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows])],
                    names=["part", "tags", "some"])

    windows = docs.select(text_col).mapInArrow(cut, "part string, tags binary, some boolean").withColumn("h", F.xxhash64("part", "tags"))
    # two parts with spans to one without, each in hash order
    some = windows.where("some").orderBy("h", "part").limit(TRAIN_WINDOWS * 2 // 3)
    none = windows.where("not some").orderBy("h", "part").limit(TRAIN_WINDOWS // 3)
    rows = sorted(some.unionByName(none).select("h", "part", "tags").collect())
    codes = np.array([_padded(char_codes(r[1]), 0) for r in rows], np.int64).reshape(-1, WINDOW)
    return codes, np.array([np.frombuffer(r[2], np.int8) for r in rows], np.int64).reshape(-1, WINDOW)


def fit(docs: DataFrame, text_col: str = "text") -> Tagger | None:
    codes, tags = training_windows(docs, text_col)
    if not len(codes):
        return None
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.train(codes, tags, TRAIN_STEPS)
    for k, v in tagger.p.items():
        tagger.p[k] = v.astype(np.float32)
    return tagger


#: Weight of a window's emission by place: small at its edges, where one side of the context is missing.
EDGE = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float64)


def tagged_spans(tagger: Tagger, texts: list[str | None], batch: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger decodes in each text."""
    places, codes = [], []
    for k, text in enumerate(texts):
        starts = _windows(text) if text else []
        if starts:
            code = char_codes(text)
            for s in starts:
                if s < len(code):
                    places.append((k, s))
                    codes.append(_padded(code, s))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not places:
        return out
    emitted = np.concatenate([tagger.emissions(np.array(codes[a:a + batch])) for a in range(0, len(codes), batch)])
    stretches, owners, a = [], [], 0
    while a < len(places):
        z = a + 1
        while z < len(places) and places[z][0] == places[a][0] and places[z][1] - places[z - 1][1] <= STRIDE:
            z += 1
        k, first = places[a]
        size = min(len(texts[k]) - first, places[z - 1][1] - first + WINDOW)
        total, weight = np.zeros((size, tagger.tags)), np.zeros((size, 1))
        for j in range(a, z):
            at = places[j][1] - first
            n = min(WINDOW, size - at)
            total[at:at + n] += emitted[j, :n] * EDGE[:n, None]
            weight[at:at + n, 0] += EDGE[:n]
        stretches.append(total / weight)
        owners.append((k, first))
        a = z
    for (k, first), tags in zip(owners, tagger.decode(stretches)):
        begin = np.flatnonzero(tags % 2 == 1)
        for b in begin.tolist():
            end = b + 1
            while end < len(tags) and tags[end] == tags[b] + 1:
                end += 1
            out[k].append((int(tags[b]) // 2, first + b, first + end))
    return out


def all_spans(text: str, base: list, tagged: list) -> list[tuple[int, int, int]]:
    """Base spans and the tagged ones that overlap none of them and are plausible, by kind and start."""
    added = []
    for kind, a, b in tagged:
        while a < b and text[a].isspace():
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
            b -= 1
        if all(b <= s or a >= e for _, s, e in base) and plausible(kind, text[a:b]):
            added.append((kind, a, b))
    return sorted({*base, *added})


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus spans and base_spans: arrays of (kind, start, end) by kind and start, in code points."""
    spark = docs.sparkSession
    common.prepare(spark)
    model = spark.sparkContext.broadcast(fit(docs, text_col))
    base_cols = docs.drop(*COLUMNS)
    names = base_cols.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base_cols.schema.fields)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for piece in common.slices(batches, text_col):
            texts = piece.column(names.index(text_col)).to_pylist()
            base = [base_spans(t) if t and TRIGGER.search(t) else [] for t in texts]
            tagged = tagged_spans(model.value, texts) if model.value is not None else [[] for _ in texts]
            spans = [all_spans(t, b, g) if b or g else [] for t, b, g in zip(texts, base, tagged)]
            cols = [pa.array([[{"kind": KINDS[k], "start": a, "end": z} for k, a, z in x] for x in rows], kind) for rows in (spans, base)]
            yield pa.RecordBatch.from_arrays([*piece.columns, *cols], names=[*names, *COLUMNS])

    element = "array<struct<kind:string,start:bigint,end:bigint>>"
    return base_cols.mapInArrow(run, f"{schema}, spans {element}, base_spans {element}")


def digests(found: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base_spans").cast("binary"), 256).alias("base_sha256"),
                        text("spans").alias("spans"))
