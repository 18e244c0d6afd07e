"""SentencePiece encoding and decoding without the library's encoder.

An Aho-Corasick automaton over the pieces reads a text once. At each position its output links give
every piece that ends there, and each such piece relaxes the position's best path: a single-pass
Viterbi. The transition depends on the model:

* unigram models add the piece's score to the best score at the piece's start;
* byte-pair models allow a piece after another one exactly if merging their concatenation gives the
  two back. A sequence is the model's encoding if and only if all its neighbours are allowed, so one
  path survives, and it equals the encoder's output. Summing the merge ranks as if they were unigram
  scores gives other pieces; see the README.

No piece crosses from a word into the next space, so a text falls into chunks (spaces, then other
characters) that are encoded once per task and remembered in a bounded table.

Characters without a piece become byte pieces, or the unknown piece where the model has none. Null and
empty texts have no pieces. Texts are encoded whole; repeated rows give repeated results; an empty
table gives no rows; a text without any space is one chunk, in linear time. Other columns are kept by
``encode_texts`` and ``decode_ids``, which name the new column ``into``, and left out by ``piece_digests``. Texts are put through the
model's own identity normalisation only: models with other normalisers are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm.common import read_table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Characters that may be cut off the end of a word where the model has no piece across the cut.
TAIL = ".,;:!?|%&$*#"
#: Chunks that a task remembers, twice: the newest ones and those before.
MEMORY = 150_000


class PieceModel:
    """The pieces of a model and its encoder and decoder."""

    def __init__(self, serialized: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        spec = sentencepiece_spec(serialized)
        if spec["normalizer"] not in ("", "identity"):
            raise ValueError(f"unsupported normaliser {spec['normalizer']}")
        self.unigram = spec["model_type"] == 1
        self.dummy_prefix, self.squeeze, self.escape = spec["add_dummy_prefix"], spec["remove_extra_whitespaces"], spec["escape_whitespaces"]
        self.unk = sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.scores = [sp.get_score(i) for i in range(len(self.pieces))]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        byte_of = {i: b for b, i in self.byte_ids.items()}
        self.raw = [bytes((byte_of[i],)) if i in byte_of else p.encode() for i, p in enumerate(self.pieces)]
        self.plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(len(self.pieces))]
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.plain[i]}
        # Two characters that stand side by side in no piece always fall apart.
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        lone = "\n" if not any("\n" in pair for pair in self.inner) else ""
        self.chunks = re.compile(rf"{SPACE_MARK}*[^{SPACE_MARK}{lone}]+|{SPACE_MARK}+" + (f"|{lone}" if lone else ""))
        self.whole_chunks = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids)
        self.lengths = [len(p) for p in self.pieces]
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.allowed: dict[int, bool] = {}
        self.seen: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def _merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the best-scored, then leftmost, pair first."""
        parts = list(text)
        while True:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _may_follow(self, a: int, b: int) -> bool:
        if len(self.allowed) > 2_000_000:
            self.allowed.clear()
        found = self.allowed[a * len(self.pieces) + b] = self._merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return found

    def _fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unk]

    def _chunk(self, text: str) -> list[int]:
        """Best path through one chunk. ``last[p]`` is the piece that ends at p on the best path to p.

        Output links come in the order of their ends, so all that ends before a piece's start is settled
        when the piece is relaxed; -1 is left where only the character itself leads to a position.
        """
        last = [-1] * (len(text) + 1)
        if self.unigram:
            self._relax_scores(text, last)
        else:
            allowed, size = self.allowed, len(self.pieces)
            for end, (piece, length) in self.automaton.iter(text):
                if last[end + 1] < 0:
                    before = last[end + 1 - length]
                    if before < 0:
                        last[end + 1] = piece
                    elif (ok := allowed.get(before * size + piece)) or (ok is None and self._may_follow(before, piece)):
                        last[end + 1] = piece
        out: list[int] = []
        at = len(text)
        lengths = self.lengths
        while at:
            piece = last[at]
            if piece < 0:
                at -= 1
                out += self._fallback(text[at])[::-1]
            else:
                out.append(piece)
                at -= lengths[piece]
        out.reverse()
        return out

    def _relax_scores(self, text: str, last: list[int]) -> None:
        scores, best, settled = self.scores, [0.0], 0

        def settle(upto: int) -> None:
            # A character without a piece costs as much as the unknown piece does.
            for p in range(len(best), upto + 1):
                best.append(best[p - 1] + self.unknown_score)

        for end, (piece, length) in self.automaton.iter(text):
            at = end + 1
            if at > settled:
                settle(at)
                settled = at
            s = best[at - length] + scores[piece]
            if s > best[at] or (last[at] < 0 and s == best[at]):
                best[at], last[at] = s, piece

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        if self.dummy_prefix:
            text = " " + text
        text = text.replace(" ", SPACE_MARK)
        if not self.whole_chunks:
            return self._chunk(text)
        out: list[int] = []
        seen, inner = self.seen, self.inner
        for chunk in self.chunks.findall(text):
            ids = seen.get(chunk)
            if ids is None:
                core = chunk.rstrip(TAIL)
                if 0 < len(core) < len(chunk) and core[-1] + chunk[len(core)] not in inner:
                    ids = self._known(core) + self._known(chunk[len(core) :])
                else:
                    ids = self._known(chunk)
                seen = self.seen
            out += ids
        return out

    def _known(self, chunk: str) -> list[int]:
        ids = self.seen.get(chunk)
        if ids is None:
            ids = self.older.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
            if len(chunk) < 64:
                if len(self.seen) >= MEMORY:
                    self.older, self.seen = self.seen, {}
                self.seen[chunk] = ids
        return ids

    def decode(self, ids) -> str:
        """The text of the pieces; runs of byte pieces are read as UTF-8."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE_MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def sentencepiece_spec(serialized: bytes) -> dict:
    """The few settings of the model's protobuf that encoding depends on."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                b = data[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while at < len(data):
            key = varint()
            kind = key & 7
            if kind == 0:
                yield key >> 3, varint()
            else:
                size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
                yield key >> 3, data[at : at + size]
                at += size

    spec = {"model_type": 1, "normalizer": "", "add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}
    for number, value in fields(serialized):
        if number == 2:  # trainer
            spec |= {"model_type": v for k, v in fields(value) if k == 3}
        elif number == 3:  # normaliser
            names = {1: "normalizer", 3: "add_dummy_prefix", 4: "remove_extra_whitespaces", 5: "escape_whitespaces"}
            spec |= {names[k]: v.decode() if k == 1 else bool(v) for k, v in fields(value) if k in names}
    return spec


@lru_cache(maxsize=2)
def _model(serialized: bytes) -> PieceModel:
    return PieceModel(serialized)


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model's bytes, read once through Spark or from the driver's disk; they travel with the tasks."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model: bytes, text: str = "text", into: str = "piece_ids") -> DataFrame:
    """``docs`` with the column ``into`` (array of int) at its end, in place of a column of that name."""
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for b in batches:
            for part in _small(b):
                ids = [m.encode(t) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, into])

    return docs.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model: bytes, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the column ``into`` (string; null ids: empty) at its end, in place of a column of that name."""
    rows = rows.drop(into)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for b in batches:
            for part in _small(b):
                texts = [m.decode(x or ()) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, into])

    return rows.mapInArrow(run, schema)


def _small(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows, so that long texts don't fill the worker's memory."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def piece_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian int32), the decoded text's digest, round_trip."""
    schema = "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    kept = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for b in batches:
            for part in _small(b):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [m.encode(t) for t in texts]
                back = [m.decode(x) for x in ids]
                sha = lambda b: hashlib.sha256(b).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(np.array(x, "<i4").tobytes()) for x in ids]),
                        pa.array([sha(t.encode()) for t in back]), pa.array([a == t for a, t in zip(back, texts, strict=True)]),
                    ],
                    ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"],
                )

    return kept.mapInArrow(run, schema)


def op1_pieces(spark: SparkSession, folder: str, model: str = MODEL) -> DataFrame:
    return piece_digests(read_table(spark, folder, "documents"), read_model(spark, model))


QUERIES = {"op1_pieces": op1_pieces}
ORACLES: dict[str, str] = {}
