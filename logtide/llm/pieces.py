"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

A text is first normalised: at each place the longest entry of the model's compiled character map (a double-array
trie) is replaced, anything else is copied character by character, and blanks become the model's blank mark.
Beside the normalised bytes runs an alignment: for each of them the byte of the original where its source begins.
The normalised text goes through a processor of the same model whose own normaliser is switched off, and the
lengths of the pieces it gives, laid along the alignment, project every piece to its span of original bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb

from logtide.llm.batches import slices

BLANK = "▁".encode()
_BYTE, _CONTROL, _UNKNOWN = 6, 3, 2
#: Bytes of text that are encoded at once; places and ids of a text take some ten times its bytes.
ENCODED_BYTES = 250_000


class CharacterMap:
    """Compiled character map: four bytes of trie size, the trie's 32-bit units, then the replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size:]

    def longest(self, text: bytes, start: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest entry that begins at ``start``."""
        units, found, node = self.units, None, 0
        if not units:
            return None
        unit = units[0]
        node ^= unit >> 10 << ((unit & 512) >> 6)
        for at in range(start, len(text)):
            node ^= text[at]
            unit = units[node]
            if unit & 0x800000FF != text[at]:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, at + 1 - start
        if found is None:
            return None
        return self.texts[found[0]:self.texts.index(b"\0", found[0])], found[1]


@dataclass
class Encoded:
    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


class PieceEncoder:
    """Encoder and decoder for one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        proto = model_pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.trim, self.mark = spec.remove_extra_whitespaces, BLANK if spec.escape_whitespaces else b" "
        self.prefix = spec.add_dummy_prefix and not proto.trainer_spec.treat_whitespace_as_suffix
        self.suffix = spec.add_dummy_prefix and proto.trainer_spec.treat_whitespace_as_suffix
        self.own = [p.piece.encode() for p in proto.pieces if p.type == 4]
        self.lengths = np.array([
            1 if p.type == _BYTE else 0 if p.type == _CONTROL else len(p.piece.encode()) for p in proto.pieces])
        self.open_unknown = not proto.trainer_spec.byte_fallback
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.begin, self.end = self.decoder.bos_id(), self.decoder.eos_id()
        spec.precompiled_charsmap, spec.add_dummy_prefix = b"", False
        spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised text, and for each of its bytes (and its end) the place in the original."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.trim and not self.own:
            return self._mark_blanks(text)
        out, source, at, n = bytearray(), [], 0, len(text)
        if self.trim:
            while at < n:
                new, size = self._next(text, at)
                if new != b" ":
                    break
                at += size
            if at == n:
                return b"", np.array([at])
        if self.prefix:
            out += self.mark
            source += [at] * len(self.mark)
        after_blank = self.trim
        while at < n:
            new, size = self._next(text, at)
            while after_blank and new.startswith(b" "):
                new = new[1:]
            if new:
                marked = new.replace(b" ", self.mark)
                out += marked
                source += [at] * len(marked)
                after_blank = new.endswith(b" ")
            at += size
            after_blank = after_blank and self.trim
        if self.trim:
            while out.endswith(self.mark):
                at = source[len(out) - len(self.mark)]
                del out[-len(self.mark):], source[-len(self.mark):]
        if self.suffix:
            out += self.mark
            source += [at] * len(self.mark)
        return bytes(out), np.array([*source, at])

    def _next(self, text: bytes, at: int) -> tuple[bytes, int]:
        own = max((p for p in self.own if text.startswith(p, at)), key=len, default=None)
        if own:
            return own, len(own)
        found = self.map.longest(text, at)
        if found:
            return found
        first = text[at]
        size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return text[at:at + size], size

    def _mark_blanks(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The same for a model without a character map: only blanks change."""
        data = np.frombuffer(text, dtype=np.uint8)
        place = np.arange(len(data))
        place = np.maximum.accumulate(np.where(data & 0xC0 != 0x80, place, 0))
        source = np.repeat(place, np.where(data == 0x20, len(self.mark), 1))
        marked, edge = text.replace(b" ", self.mark), np.zeros(len(self.mark), np.int64)
        if self.prefix:
            marked, source = self.mark + marked, np.concatenate([edge, source])
        if self.suffix:
            marked, source = marked + self.mark, np.concatenate([source, edge + len(text)])
        return marked, np.append(source, len(text))

    def encode(self, text: str) -> Encoded:
        """Ids with begin and end id, and the original bytes [begin, end) of each."""
        normal, source = self.normalise(text.encode())
        inner = np.array(self.plain.encode(normal, num_threads=1), dtype=np.int64)
        lengths = self.lengths[inner]
        if self.open_unknown and (inner == self.unknown).any():
            lengths = np.array([len(p.encode()) for p in self.plain.encode(normal, out_type=str)])
        stops = np.concatenate([[0], np.cumsum(lengths)])
        if stops[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        places = source[stops]
        return Encoded(np.concatenate([[self.begin], inner, [self.end]]),
                       np.concatenate([[0], places[:-1], places[-1:]]),
                       np.concatenate([[0], places[1:], places[-1:]]))

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode(ids)


def encode_documents(docs: DataFrame, model: bytes, packed: bool = False, decode: bool = False) -> DataFrame:
    """``docs`` with ``ids``, ``begins`` and ``ends`` (arrays of int), and with ``decode`` the text of the ids.

    Spans are bytes of the UTF-8 text, ends exclusive; the begin and end ids have empty spans, and bytes of one
    unknown character give empty spans but for the last, which has the whole character. ``packed`` gives the three
    columns as little-endian 32-bit binary instead. A null text counts as empty. ``model`` is the model file's
    content, which travels with the tasks (500 KB for 32,000 pieces). Columns named like the new ones are replaced,
    all others stay; repeated rows get the same result; an empty table gives no rows.
    """
    new = ["ids", "begins", "ends"] + ["decoded"] * decode
    docs = docs.drop(*new)
    width, at = len(docs.columns), docs.columns.index("text")

    def column(arrays):
        flat = np.concatenate(arrays).astype("<i4") if arrays else np.empty(0, "<i4")
        bounds = np.cumsum([0, *map(len, arrays)])
        if packed:
            return pa.array([a.astype("<u4").tobytes() for a in arrays], pa.binary())
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))

    def run(batches):
        encoder = PieceEncoder(model)
        for batch in batches:
            for part in slices(batch, at, ENCODED_BYTES):
                found = [encoder.encode(t or "") for t in part.column(at).to_pylist()]
                made = [column([getattr(f, name) for f in found]) for name in new[:3]]
                if decode:
                    made.append(pa.array([encoder.decode(f.ids.tolist()) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(width)], *made],
                                                 names=[*part.schema.names, *new])

    array = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    fields = [T.StructField(name, T.StringType() if name == "decoded" else array) for name in new]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
