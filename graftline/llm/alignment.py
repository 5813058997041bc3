"""Alignment of two tokenizers' tokens on the bytes of a text, and corpus-wide counts of linked id pairs.

Texts are cut before spaces that follow a character other than white space: neither tokenizer has a token over such a place,
so each distinct piece of a batch is encoded once. The pieces' bytes lie end to end; two packed bitsets mark where tokens
end. Their AND is the shared cuts; the popcount ranks of a cut in either set are the token ranges up to it. Each segment
between neighbouring bits of their OR is one link, whose tokens are the ranks of its start.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graftline.llm.common import keyed, stored
from graftline.llm.token_counts import Numbers, byte_alphabet, ragged_sums
from graftline.llm.token_counts import batches as batches_of

SPACE = "▁"
#: Texts are aligned in batches of so many characters, or one text if that is longer, and their pieces in slices of so many characters.
BATCH_CHARS, SLICE_CHARS = 1 << 24, 1 << 17
#: A place where both tokenizers always end a token: Python's white space includes all that the byte-level pattern has. A last lone space
#: stays with what it follows, since the model adds no space to an empty text.
CUT = re.compile(r"(?<=\S)(?= [\s\S])")
WIDE = re.compile(r"\s ")
#: A link's key is its A id times this plus its B id.
SIDE = 1 << 32


class Bits:
    """A packed bitset with the ranks of its words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, n: int) -> Bits:
        flags = np.zeros(-(-n // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def places(self) -> np.ndarray:
        """Select: the places of all set bits, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set below each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        at = np.minimum(word, len(self.words) - 1)
        part = np.bitwise_count(self.words[at] & ((np.uint64(1) << bit) - np.uint64(1)))
        return np.where(word < len(self.words), self.before[at] + part, self.before[-1])


class Aligner:
    """A byte-level tokenizers file (A) and a sentencepiece model (B)."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        with open(a_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.a_bytes = self._table({i: bytes(map(byte.__getitem__, t)) for t, i in spec["model"]["vocab"].items()})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        proto = pb.ModelProto()
        with open(b_file, "rb") as f:
            proto.ParseFromString(f.read())
        kind = pb.ModelProto.SentencePiece
        self.b_bytes = self._table({i: bytes([int(p.piece[3:-1], 16)]) if p.type == kind.BYTE else p.piece.replace(SPACE, " ").encode() for i, p in enumerate(proto.pieces)})
        norm = proto.normalizer_spec
        inner = any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED, kind.UNUSED))
        whole = norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or inner
        split = spec["pre_tokenizer"]
        #: Whether a cut text's pieces have the tokens of the whole: known of byte-level splits and of models without rules in which white space only begins a piece.
        self.cuts = not whole and not spec["normalizer"] and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.a_words, self.b_words = (np.array([str(i) for i in range(len(t))], object) for t in (self.a_bytes, self.b_bytes))
        self.a_widths, self.b_widths = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))

    @staticmethod
    def _table(entries: dict[int, bytes]) -> list[bytes]:
        return [entries.get(i, b"") for i in range(max(entries) + 1)]

    def pieces(self, text: str) -> list[str]:
        """A text cut where both tokenizers always end a token; each piece stands without the space that it begins with."""
        if not self.cuts:
            return [text]
        if not text.startswith(" ") and not text.endswith(" ") and not WIDE.search(text):
            return text.split(" ")
        return [p[1:] for p in CUT.split(" " + text)]

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)], self.b.encode(pieces, num_threads=1)

    def align(self, pieces: list[str]) -> Alignment:
        return Alignment(self, pieces)


class Alignment:
    """For each of some pieces: whether its bytes agree, and its tokens, groups and links where they do.

    ok, n_a, n_b, n_groups, n_links and shown (the groups as text) hold one value a piece; links holds the keys of all links,
    piece after piece. The pieces stand without their leading space.
    """

    def __init__(self, coder: Aligner, pieces: list[str]):
        found, n = coder.encode(pieces), len(pieces)
        raw = (" " + " ".join(pieces)).encode() if n else b""
        wide = np.fromiter(map(len, map(str.encode, pieces)), np.int64, n) + 1
        self.ok, flat, sizes = np.ones(n, bool), [], []
        for ids, table, widths in zip(found, (coder.a_bytes, coder.b_bytes), (coder.a_widths, coder.b_widths), strict=True):
            sizes.append(np.fromiter(map(len, ids), np.int64, n))
            flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(sizes[-1].sum())))
            same = ragged_sums(widths[flat[-1]], sizes[-1]) == wide
            if not (same.all() and b"".join(map(table.__getitem__, flat[-1].tolist())) == raw):
                self.ok &= same & np.array([b"".join(map(table.__getitem__, i)) == b" " + p.encode() for i, p in zip(ids, pieces, strict=True)], dtype=bool)
        (flat_a, flat_b), (self.n_a, self.n_b) = ([f[np.repeat(self.ok, s)] for f, s in zip(flat, sizes, strict=True)], [np.where(self.ok, s, 0) for s in sizes])
        end_a, end_b = np.cumsum(coder.a_widths[flat_a]), np.cumsum(coder.b_widths[flat_b])
        size = int(end_a[-1]) if len(end_a) else 0
        self.n_groups = self.n_links = np.zeros(n, np.int64)
        self.links, self.shown = np.zeros(0, np.int64), [""] * n
        if not size:
            return
        # a bit stands for the last byte of a token
        a, b = Bits.of(end_a - 1, size), Bits.of(end_b - 1, size)
        shared, either = Bits(a.words & b.words), Bits(a.words | b.words)
        ends = np.cumsum(np.where(self.ok, wide, 0))
        upto = lambda bits: np.diff(bits.rank(ends), prepend=0)
        self.n_groups, self.n_links = upto(shared), upto(either)
        stops = either.places()
        starts = np.concatenate([[0], stops[:-1] + 1])
        self.links = flat_a[a.rank(starts)] * SIDE + flat_b[b.rank(starts)]
        cuts = shared.places() + 1
        self.shown = self._shown(coder, flat_a, flat_b, a.rank(cuts), b.rank(cuts))

    def _shown(self, coder: Aligner, flat_a: np.ndarray, flat_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each piece, from the token ranges that end at each shared cut."""
        from_a, from_b = np.concatenate([[0], upto_a[:-1]]), np.concatenate([[0], upto_b[:-1]])
        n = len(flat_a) + len(flat_b)
        group_a, group_b = (np.repeat(np.arange(len(upto_a)), u - f) for u, f in ((upto_a, from_a), (upto_b, from_b)))
        at_a, at_b = np.arange(len(flat_a)) + from_b[group_a], np.arange(len(flat_b)) + upto_a[group_b]
        words, marks = np.empty(n, object), np.full(n, ",", object)
        words[at_a], words[at_b] = coder.a_words[flat_a], coder.b_words[flat_b]
        marks[from_a + from_b] = ";"
        marks[upto_a + from_b] = "|"
        parts = np.empty(2 * n, object)
        parts[::2], parts[1::2] = marks, words
        parts, stop, out = parts.tolist(), 2 * np.cumsum(self.n_a + self.n_b), []
        for start, end in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True):
            out.append("".join(parts[start + 1 : end]))
        return out


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """One aligner for each pair of files and process."""
    if (a_file, b_file) not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _LOADED[a_file, b_file] = Aligner(a_file, b_file)
    return _LOADED[a_file, b_file]


def aligned_batch(coder: Aligner, texts: list[str]) -> dict:
    """One batch: per text n_a, n_b, n_groups, n_links, groups_sha256 and pieces (the numbers of its pieces, in order); per
    piece sizes (its links); links (for each, the number of its key among keys); keys, distinct and ascending, and docs, in
    how many of the texts each is linked."""
    known, found = Numbers(), []
    for t in texts:
        found.append(np.array(list(map(known.__getitem__, coder.pieces(t))) if t else [], dtype=np.int32))
    slices = [coder.align(part) for part in batches_of(list(known), SLICE_CHARS)]
    each = {c: np.concatenate([np.zeros(0, bool if c == "ok" else np.int64), *(getattr(s, c) for s in slices)]) for c in ("ok", "n_a", "n_b", "n_groups", "n_links", "links")}
    shown = [text for s in slices for text in s.shown]
    del known, slices
    for i, f in enumerate(found):
        if not each["ok"][f].all():
            found[i] = f[:0]
    sha = [hashlib.sha256(";".join(map(shown.__getitem__, f.tolist())).encode()).hexdigest() if len(f) else "" for f in found]
    seen, sizes = np.concatenate([np.zeros(0, np.int32), *found]), np.fromiter(map(len, found), np.int64, len(found))
    keys, links = np.unique(each["links"], return_inverse=True)
    docs = np.zeros(len(keys), np.int64)
    n_links = each["n_links"]
    start = np.cumsum(n_links) - n_links
    for f in found:  # each text's distinct links
        own = np.unique(f)
        n = n_links[own]
        at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        docs[np.unique(links[at])] += 1
    used = docs > 0  # links of a piece all of whose texts are without tokens are of no key: the place after the last
    links = np.where(used, np.cumsum(used) - 1, used.sum())[links]
    out = {c: ragged_sums(each[c][seen], sizes) for c in ("n_a", "n_b", "n_groups", "n_links")}
    return out | {"groups_sha256": sha, "pieces": found, "sizes": n_links, "links": links, "keys": keys[used], "docs": docs[used]}


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a pair of token occurrences whose byte ranges overlap; a pair of ids counts the rows that hold it linked, and
    a link is best where no pair of its A id counts more rows. A text that is null, empty or not given back byte for byte by
    both tokenizers has no tokens: zeros and ''. Repeated rows and ids are rows of their own; other columns are not read; an
    empty table gives no row. Every pair is counted and met by a join, so counts grow with the input; the files must exist
    at these paths on every executor.

    One pass stores each batch's numbered pieces and its distinct pairs with their counts; only those pairs are exchanged, to
    be added up over batches and to bring the sums back.
    """
    spark = docs.sparkSession
    slim = keyed(docs, id_col, text_col).toDF("id", "text")
    schema = StructType.fromDDL("batch long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pieces binary, sizes binary, key long, place int, docs long")
    schema = StructType([slim.schema["id"], *schema.fields])
    arrow = to_arrow_schema(schema)

    def rows(n: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = aligner(a_file, b_file), TaskContext.get().partitionId() << 32
        for ids, texts in batches(frames):
            found = aligned_batch(coder, texts)
            own = pa.array([number], pa.int64())
            batch = lambda n, own=own: pa.concat_arrays([own]).take(pa.array(np.zeros(n, np.int64)))
            n, k = len(texts), len(found["keys"])
            cols = {c: pa.array(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            yield rows(n, id=ids, batch=batch(n), pieces=pa.array([f.astype("<i4").tobytes() for f in found["pieces"]], pa.binary()), **cols)
            yield rows(1, batch=own, pieces=pa.array([found["links"].astype("<i4").tobytes()], pa.binary()), sizes=pa.array([found["sizes"].astype("<i4").tobytes()], pa.binary()))
            if k:
                yield rows(k, batch=batch(k), key=pa.array(found["keys"]), place=pa.array(np.arange(k, dtype=np.int32)), docs=pa.array(found["docs"]))
            number += 1

    made = stored(slim.mapInArrow(run, schema), "aligned")
    asked = made.where("key IS NOT NULL").select("batch", "key", "place", "docs")
    counts = stored(asked.groupBy("key").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("key", 32)), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row an A id: the tokenizer's vocabulary bounds it
    counts = counts.join(F.broadcast(best), "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.select("batch", "key", "place").join(counts, "key").select(F.col("batch").alias("asker"), "place", "n", "best")
    texts = made.where("key IS NULL").drop("key", "place", "docs")
    final = StructType([slim.schema["id"], *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])
    final_arrow = to_arrow_schema(final)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right["place"].to_numpy()
        n, best = np.zeros(len(place) + 1, np.int64), np.zeros(len(place) + 1, np.int64)
        n[place], best[place] = right["n"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        of_batch = pc.is_valid(left["sizes"])
        book, left = left.filter(of_batch), left.filter(pc.invert(of_batch))
        links, sizes = (np.frombuffer(book[c][0].as_py(), "<i4") for c in ("pieces", "sizes"))
        per_piece = [ragged_sums(v[links], sizes) for v in (best, n)]
        packed = left["pieces"].to_pylist()
        seen, lengths = np.frombuffer(b"".join(packed), "<i4"), np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
        left = left.append_column("n_best", pa.array(ragged_sums(per_piece[0][seen], lengths))).append_column("count_sum", pa.array(ragged_sums(per_piece[1][seen], lengths)))
        return left.select(final_arrow.names).cast(final_arrow)

    return texts.groupBy("batch").cogroup(answers.groupBy("asker")).applyInArrow(meet, final).withColumnRenamed("id", id_col)


def batches(frames: Iterator[pa.RecordBatch], chars: int = BATCH_CHARS) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of so many characters, or one row; a null text as an empty one."""
    ids, texts, n = [], [], 0
    for frame in frames:
        start = 0
        for at, t in enumerate(frame["text"].to_pylist()):
            texts.append(t or "")
            n += len(texts[-1])
            if n >= chars:
                yield pa.concat_arrays([*ids, frame["id"][start : at + 1]]), texts
                ids, texts, n, start = [], [], 0, at + 1
        ids.append(frame["id"][start:])
    if texts:
        yield pa.concat_arrays(ids), texts
