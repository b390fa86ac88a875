"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces drives one Viterbi pass: each position's matches, found by
following output links, relax the best score there. No piece has a space behind another character,
so a text falls apart at spaces into units whose segmentations don't depend on each other; units
that a task has met before come from a bounded memo.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._text import strings

SPACE = "▁"
MEMO_UNITS = 400_000
#: Stands where a character that is no piece was stepped over: size, piece, score.
SKIPPED = (1, -1, 0.0)
UNIT = re.compile(r" +[^ ]*")

_codecs: dict[str, Codec] = {}


def vocabulary(path: str) -> dict:
    """Pieces, scores and kinds of a model file, in plain lists."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kind = lambda i: "byte" if model.is_byte(i) else "none" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "text"
    return {"key": f"{path}:{len(ids)}", "pieces": [model.id_to_piece(i) for i in ids], "scores": [model.get_score(i) for i in ids], "kinds": [kind(i) for i in ids], "unknown": model.unk_id()}


class Codec:
    """Encoder and decoder for one vocabulary; spaces stand for the piece mark throughout."""

    def __init__(self, vocab: dict, memo_units: int = MEMO_UNITS):
        self.trie = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.byte: dict[int, int] = {}
        self.out: list[bytes] = []
        self.memo: dict[str, bytes] = {}
        self.memo_units, self.unknown, lowest, self.split = memo_units, vocab["unknown"], 0.0, True
        for i, (piece, score, kind) in enumerate(zip(vocab["pieces"], vocab["scores"], vocab["kinds"], strict=True)):
            text = piece.replace(SPACE, " ")
            if kind == "byte":
                self.byte[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
                continue
            self.out.append(text.encode() if kind == "text" else b"")
            if kind == "text" and text:
                self.trie.add_word(text, (len(text), i, score))
                if len(text) == 1:
                    self.single.add(text)
                if score > -1e8:
                    lowest = min(lowest, score)
                self.split &= " " not in text.lstrip(" ")
        self.penalty = lowest - 10.0
        self.trie.make_automaton()

    def viterbi(self, unit: str) -> list[int]:
        """Best-scoring pieces; a character that is no piece costs more than any and becomes its bytes.

        Of equal scores the piece that is longest at the position wins.
        """
        n, low = len(unit), float("-inf")
        best, back = [low] * (n + 1), [SKIPPED] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(unit):
            for end, found in self.trie.iter(unit):
                end += 1
                total = best[end - found[0]] + found[2]
                if total > best[end]:
                    best[end], back[end] = total, found
        else:
            at = 0
            for end, found in [*self.trie.iter(unit), (n, SKIPPED)]:
                for i in range(at, end):  # all that ends here is known: step over what is no piece
                    if unit[i] not in self.single and best[i] + self.penalty > best[i + 1]:
                        best[i + 1], back[i + 1] = best[i] + self.penalty, SKIPPED
                at = max(at, end)
                if end < n and best[end + 1 - found[0]] + found[2] > best[end + 1]:
                    best[end + 1], back[end + 1] = best[end + 1 - found[0]] + found[2], found
        ids: list[int] = []
        while n:
            size, piece, _ = back[n]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.byte.get(b, self.unknown) for b in reversed(unit[n - 1].encode("utf-8", "surrogatepass"))]
            n -= size
        return ids[::-1]

    def unit(self, unit: str) -> bytes:
        found = array("i", self.viterbi(unit)).tobytes()
        if len(self.memo) < self.memo_units and len(unit) < 64:
            self.memo[unit[1:]] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text, which gets a space before it; empty stays empty."""
        if not text:
            return b""
        if not self.split:
            return np.array(self.viterbi(" " + text), np.int32).tobytes()
        if "  " in text or text[0] == " " or text[-1] == " ":
            return b"".join(self.unit(u) for u in UNIT.findall(" " + text))
        parts = text.split(" ")
        found = list(map(self.memo.get, parts))
        if None in found:
            found = [self.unit(" " + p) if f is None else f for p, f in zip(parts, found, strict=True)]
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space before it goes, and broken bytes are replaced."""
        return b"".join(map(self.out.__getitem__, ids))[1:].decode("utf-8", "replace") if ids else ""


def _codec(vocab: dict) -> Codec:
    if vocab["key"] not in _codecs:
        _codecs.clear()
        _codecs[vocab["key"]] = Codec(vocab)
    return _codecs[vocab["key"]]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ids for every row: the Viterbi segmentation of the whole text.

    Null text stays null and has no ids, as an empty text has none. Identifiers may be null or
    repeat. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model_path))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cells = [codec.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in cells]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(cells), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids], names=["doc_id", "text", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encoded, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the text that their ids stand for (null ids: null).

    A column that is called ``decoded`` already makes way; all others come back as they were. Repeated
    rows are decoded each; an empty table gives an empty result.
    """
    encoded = encoded.drop("decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(model_path))
    ids_at = encoded.columns.index("ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column(ids_at)
                ids, sizes = lists.flatten().to_numpy().tolist(), lists.value_lengths().to_pylist()
                cut = np.cumsum([0, *(s or 0 for s in sizes)]).tolist()
                texts = [None if s is None else codec.decode(ids[a:b]) for s, a, b in zip(sizes, cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(decoded, schema)
