"""Byte-pair encoding without merging: dynamic programming over prefixes.

For every prefix of a piece there is at most one last token that byte-pair encoding can end it with. The
tokens that end at each byte come from an automaton of the vocabulary (goto edges plus suffix links); of
these, the one that may follow the last token of the prefix before it (pair-compatibility test) is stored.
Back-pointers from the end give the ids. Distinct pieces are encoded once per worker and kept in a table
of bounded size.

Defined cases: null and empty texts have no ids and decode to an empty text; special tokens written in a
text become their id, as in the tokenizers library; rows are encoded one by one.
"""

from __future__ import annotations

import json
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.llm import common

#: How byte-level vocabularies split a text before merging (a fixed value), with white space written out.
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _S + r"\p{L}\p{N}]+|[" + _S + r"]+(?![^" + _S + r"])|["
           + _S + "]+")
#: Distinct pieces, and token pairs, that a worker keeps.
KEPT_PIECES = 500_000
COLUMNS = ("ids", "decoded")


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves, the
    others take the code points from 256 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level tokenizer file (its content, not its path)."""

    def __init__(self, content: str):
        data = json.loads(content)
        letters = _byte_letters()
        model = data["model"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for word, i in model["vocab"].items():
            if word not in self.special:
                self.tokens[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.tokens[i] = word.encode()
        ids = model["vocab"]
        self.rank, self.parts = {}, {}
        for r, pair in enumerate(model["merges"]):
            left, right = (ids[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[left, right] = r
            self.parts.setdefault(ids["".join(pair) if isinstance(pair, list) else pair.replace(" ", "", 1)], (r, left, right))


class Pieces(dict):
    """Encoded pieces (ids as bytes of int32), made on first use; emptied when it has KEPT_PIECES of them."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT_PIECES:
            self.clear()
        ids = self[piece] = array("i", self.encode(piece.encode())).tobytes()
        return ids


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        import regex

        self.v = vocabulary
        self.rank, self.parts = vocabulary.rank, vocabulary.parts
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")"
                                 ).split if vocabulary.special else None
        self.automaton = ahocorasick.Automaton()
        special = set(vocabulary.special.values())
        for i, token in enumerate(vocabulary.tokens):
            if token and i not in special:
                self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.kept = Pieces(self.encode_piece)
        self.alone: dict[int, bool] = {}

    def compatible(self, left: int, right: int, whole: bool = False) -> bool:
        """Whether byte-pair encoding of the two tokens' bytes is the two tokens.

        Undo the merges of both tokens, latest first. While the piece at the right edge of ``left`` and
        the piece at the left edge of ``right`` stand side by side, a merge of the two would be done if it
        comes before the merges that use these pieces up (of equal merges, the one further left is first).
        ``whole``: the merge of ``left`` and ``right`` themselves is allowed.
        """
        never = len(self.rank)
        a, b, a_used, b_used = left, right, never, never
        while True:
            across = self.rank.get((a, b), never)
            if across < a_used and across <= b_used and across < never and not (whole and (a, b) == (left, right)):
                return False
            made_a, made_b = self.parts.get(a), self.parts.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                a_used, _, a = made_a
            else:
                b_used, b, _ = made_b

    def stands(self, token: int) -> bool:
        """Whether the token is what byte-pair encoding makes of its own bytes."""
        ok = self.alone.get(token)
        if ok is None:
            made = self.parts.get(token)
            ok = made is None or (self.stands(made[1]) and self.stands(made[2])
                                  and self.compatible(made[1], made[2], whole=True))
            self.alone[token] = ok
        return ok

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        n = len(data)
        last, pairs = [-1] * (n + 1), self.pairs
        size = [0] * (n + 1)
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - length
            if begin:
                before = last[begin]
                if before < 0:
                    continue
                ok = pairs.get(before << 32 | token)
                if ok is None:
                    if len(pairs) >= KEPT_PIECES:
                        pairs.clear()
                    ok = pairs[before << 32 | token] = self.stands(token) and self.compatible(before, token)
                if not ok:
                    continue
            elif not self.stands(token):
                continue
            last[end], size[end] = token, length
        out = []
        while n:
            if last[n] < 0:
                raise ValueError("a byte of the text is in no token")
            out.append(last[n])
            n -= size[n]
        return tuple(out[::-1])

    def encode_bytes(self, text: str) -> bytes:
        """Token ids of a text, as bytes of int32."""
        if self.cut is None:
            return b"".join(map(self.kept.__getitem__, self.find(text)))
        out = []
        for k, part in enumerate(self.cut(text)):
            if k & 1:
                out.append(array("i", [self.v.special[part]]).tobytes())
            else:
                out += map(self.kept.__getitem__, self.find(part))
        return b"".join(out)

    def encode(self, text: str) -> array:
        return array("i", self.encode_bytes(text))


_ENCODERS: dict[str, Encoder] = {}


def load_vocabulary(spark: SparkSession, path: str):
    """Broadcast of the vocabulary file's content, read once on the driver (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoder(vocabulary) -> Encoder:
    if vocabulary.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.id] = Encoder(Vocabulary(vocabulary.value))
    return _ENCODERS[vocabulary.id]


class _Shared:
    """Broadcast plus a number that tells vocabularies apart within a worker."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def encode_decode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` plus ids (array of token ids) and decoded (the text these ids stand for)."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = _Shared(load_vocabulary(spark, path))
    base = docs.drop(*COLUMNS)
    names = base.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", ids array<int>, decoded string"

    def run(batches):
        encoder = _encoder(shared)
        tokens = pa.array(encoder.v.tokens, pa.binary())
        for piece in common.slices(batches, text_col, 1 << 20):
            texts = piece.column(names.index(text_col)).to_pylist()
            parts = [encoder.encode_bytes(text) if text else b"" for text in texts]
            offsets = np.cumsum([0, *(len(x) // 4 for x in parts)])
            values = pa.array(np.frombuffer(b"".join(parts), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            bytes_of = pa.ListArray.from_arrays(ids.offsets, tokens.take(values))
            decoded = pc.binary_join(bytes_of, pa.scalar(b"", pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, ids, pa.array([x.decode("utf-8", "replace") for x in decoded.to_pylist()], pa.string())],
                names=[*names, "ids", "decoded"])

    return base.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
