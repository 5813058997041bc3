"""SentencePiece encoding that keeps source offsets, and decoding.

A text is first normalised here, by longest-prefix matches in the model's compiled character map (a double-array trie over
UTF-8 bytes and the replacements it points at), with the source position of every normalised byte recorded. The normalised
text is segmented by the sentencepiece library under the same pieces with an identity normaliser, and each piece's byte
range is carried back through the alignment to a byte span of the source.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from graftline.llm.common import keyed

SPACE = "▁"
#: Texts are handed to the library in chunks of so many characters, or one text if that is longer.
CHUNK_CHARS = 1 << 20


class CharacterMap:
    """The compiled map: longest prefix of a byte string that has a replacement."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = memoryview(blob[4 : 4 + n]).cast("I") if n else None
        self.texts = blob[4 + n :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, text: bytes, start: int = 0) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest rule that text has at start; the trie ends the search, however long its rules are."""
        units, found = self.units, None
        if units is None:
            return None
        at = self._offset(units[0])
        for place in range(start, len(text)):
            byte = text[place]
            at ^= byte
            if at >= len(units):
                break
            unit = units[at]
            if unit & 0x800000FF != byte:
                break
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                found = place + 1 - start, units[at] & 0x7FFFFFFF
        if found is None:
            return None
        n, start = found
        return n, self.texts[start : self.texts.index(b"\0", start)]


class OffsetEncoder:
    """Encodes and decodes with a model file, and gives the source byte span of every piece."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model_file, "rb") as f:
            raw = f.read()
        proto = pb.ModelProto()
        proto.ParseFromString(raw)
        spec = proto.normalizer_spec
        self.map = CharacterMap(bytes(spec.precompiled_charsmap))
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.symbols = sorted((p.piece for p in proto.pieces if p.type == pb.ModelProto.SentencePiece.USER_DEFINED), key=len, reverse=True)
        self.direct = self.map.units is None and not self.squeeze and self.escape and not self.suffix and not self.symbols
        self.widths = np.array([1 if p.type == pb.ModelProto.SentencePiece.BYTE else 0 if p.type == pb.ModelProto.SentencePiece.CONTROL else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        self.unk = proto.trainer_spec.unk_id
        self.source = sentencepiece.SentencePieceProcessor(model_proto=raw)
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte it comes from."""
        raw = text.encode("utf-8", "replace")
        if self.direct:
            return self._direct(raw)
        symbols = re.compile("|".join(re.escape(s) for s in self.symbols).encode()) if self.symbols else None
        out, origin, at = bytearray(), [], 0
        while at < len(raw):  # one character or rule at a time
            if symbols and (m := symbols.match(raw, at)):
                n, new = len(m[0]), m[0]
            elif hit := self.map.longest(raw, at):
                n, new = hit
            else:
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                new = raw[at : at + n]
            out += new
            origin += [at] * len(new)
            at += n
        start = np.array([*origin, len(raw)], dtype=np.int64)
        body = bytes(out)
        if self.squeeze:
            keep = np.frombuffer(body, np.uint8) != 0x20
            keep[1:] |= keep[:-1]  # the first space of a run stays
            lead, tail = len(body) - len(body.lstrip(b" ")), len(body.rstrip(b" "))
            keep[:lead] = False
            keep[tail:] = False
            start = np.append(start[:-1][keep], start[tail] if tail else len(raw))
            body = np.frombuffer(body, np.uint8)[keep].tobytes()
        if not body:
            return "", np.array([0], dtype=np.int64)
        if self.prefix:
            body = body + b" " if self.suffix else b" " + body
            start = np.append(start, start[-1]) if self.suffix else np.insert(start, 0, start[0])
        if self.escape:
            wide = np.where(np.frombuffer(body, np.uint8) == 0x20, 3, 1)
            start = np.append(np.repeat(start[:-1], wide), start[-1])
            body = body.replace(b" ", SPACE.encode())
        return body.decode(), start

    def _direct(self, raw: bytes) -> tuple[str, np.ndarray]:
        """No rule can match: only spaces change, so the alignment is one vector operation."""
        if not raw:
            return "", np.array([0], dtype=np.int64)
        wide = np.where(np.frombuffer(raw, np.uint8) == 0x20, 3, 1)
        start = np.append(np.repeat(np.arange(len(raw)), wide), len(raw))
        body = raw.replace(b" ", SPACE.encode()).decode()
        return (SPACE + body, np.concatenate([np.zeros(3, np.int64), start])) if self.prefix else (body, start)

    def encode(self, texts: list[str], begin: bool = True, end: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and, for each id, the (start, end) source bytes; begin and end ids have empty spans."""
        pairs = [self.normalise(t) for t in texts]
        out = []
        for (norm, start), ids in zip(pairs, self.plain.encode([n for n, _ in pairs], num_threads=1), strict=True):
            ids = np.array(ids, dtype=np.uint32)
            width = self.widths[ids]
            if (ids == self.unk).any():  # the width of an unknown piece is that of its own text
                width = np.array([len(p.surface.encode()) for p in self.plain.encode(norm, out_type="immutable_proto").pieces], dtype=np.int64)
            stop = np.cumsum(width)
            if (stop[-1] if len(stop) else 0) != len(start) - 1:
                raise ValueError("pieces do not add up to the normalised text")
            spans = np.stack([start[stop - width], start[stop]], axis=1)
            if begin:
                ids, spans = np.insert(ids, 0, self.source.bos_id()), np.concatenate([[[0, 0]], spans])
            if end:
                last = spans[-1, 1] if len(spans) else 0
                ids, spans = np.append(ids, np.uint32(self.source.eos_id())), np.concatenate([spans, [[last, last]]])
            out.append((ids.astype(np.uint32), spans))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.source.decode(ids, num_threads=1)


#: Columns that may be asked for, and their types.
ARRAYS = {"ids": "array<int>", "starts": "array<long>", "ends": "array<long>", "decoded": "string"}
_LOADED: dict[str, OffsetEncoder] = {}


def encoder(model_file: str) -> OffsetEncoder:
    """One encoder for each model and process."""
    if model_file not in _LOADED:
        _LOADED[model_file] = OffsetEncoder(model_file)
    return _LOADED[model_file]


def chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= chars or len(part) >= 1024:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = tuple(ARRAYS)) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, n_bytes, covered_bytes, and also ids, starts, ends
    (source byte spans) and decoded, as asked for.

    ids has begin and end ids; ids_sha256 is of the ids as little-endian unsigned 32-bit integers. A null text counts as
    empty and, like it, encodes to begin and end alone. covered_bytes counts source bytes that lie in a piece's span: for a
    map that drops nothing it equals n_bytes. Repeated rows and ids each give their row; other columns are not read. The
    model file must exist at that path on every executor.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(model_file)
        for batch in batches:
            at = 0
            for part in chunks([t or "" for t in batch["text"].where(batch["text"].notna(), "")]):
                done = coder.encode(part)
                texts = coder.decode([ids.tolist() for ids, _ in done])
                out = pd.DataFrame({"id": batch["id"].iloc[at : at + len(part)].values})
                at += len(part)
                out["n_tokens"] = [len(ids) for ids, _ in done]
                out["ids_sha256"] = [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids, _ in done]
                out["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                out["n_bytes"] = [len(t.encode()) for t in part]
                out["covered_bytes"] = [covered(spans) for _, spans in done]
                made = {"ids": [ids.astype(np.int32) for ids, _ in done], "starts": [s[:, 0] for _, s in done], "ends": [s[:, 1] for _, s in done], "decoded": texts}
                yield out.assign(**{c: made[c] for c in also})

    slim = keyed(docs, id_col, text_col).toDF("id", "text")
    schema = f"id {slim.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, covered_bytes long"
    schema += "".join(f", {c} {ARRAYS[c]}" for c in also)
    return slim.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def covered(spans: np.ndarray) -> int:
    """Bytes in the union of spans that are in source order; pieces of one replaced character share its bytes."""
    if not len(spans):
        return 0
    start, end = spans[:, 0], np.maximum.accumulate(spans[:, 1])
    return int(np.maximum(0, end - np.maximum(start, np.concatenate([[0], end[:-1]]))).sum())
