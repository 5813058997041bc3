"""Quality classification by compression: a text is compressed in short chunks under a zstandard dictionary of good and one of
bad labelled text. The difference of the two sizes, divided by the text's own, is the only thing that a score depends on: one monotone
map, fitted on labelled rows that built neither dictionary, makes it the probability of a good label.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import keyed, sample_by_hash

#: Bytes of a chunk, so few that a text gains nothing by repeating itself; bytes of a dictionary and of its pieces; the level of compression.
CHUNK, DICTIONARY, PIECE, LEVEL = 64, 262_144, 256, 3
#: Bounds of the training sample: labelled documents of smallest hash, and bytes of all their whole texts. Scoring knows no such bound.
FIT_DOCS, FIT_BYTES = 6_000, 96_000_000


def pieces(raw: bytes, n: int) -> list[bytes]:
    return [raw[i : i + n] for i in range(0, len(raw), n)]


def dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    """Raw dictionary content: pieces of all the texts in order of their hash, as many as it holds."""
    found = sorted({p for t in texts for p in pieces(t.encode("utf-8", "replace"), PIECE)}, key=lambda p: (xxhash.xxh3_64_intdigest(p), p))
    return b"".join(found[: -(-size // PIECE) * 2])[:size]


class CompressionClassifier:
    """Two dictionaries and the calibration (slope, offset) of the size difference under them."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, offset: float = 0.0):
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset
        self._ready = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def sizes(self, text: str) -> tuple[int, int, int]:
        """Bytes, and compressed bytes under either dictionary, of the whole text."""
        if self._ready is None:
            self._ready = []
            form = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            for raw in (self.good, self.bad):
                kept = {"dict_data": zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if raw else {}
                self._ready.append(zstandard.ZstdCompressor(compression_params=form, **kept))
        raw = text.encode("utf-8", "replace")
        parts = pieces(raw, CHUNK)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self._ready)
        return len(raw), good, bad

    def difference(self, text: str) -> float:
        """Bytes that the good dictionary saves more than the bad one, for each byte of text, as a signed square root; 0 for an empty text."""
        n, good, bad = self.sizes(text)
        return math.copysign(math.sqrt(abs(bad - good) / n), bad - good) if n else 0.0

    def calibrate(self, texts: list[str], labels: list[int], ridge: float = 1e-3, steps: int = 60) -> CompressionClassifier:
        """Logistic calibration by Newton steps; the slope doesn't fall below zero."""
        x, y = np.array([[self.difference(t), 1.0] for t in texts]).reshape(-1, 2), np.array(labels, float)
        w = np.zeros(2)
        for _ in range(steps if len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
            step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
            w += step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        self.slope, self.offset = max(0.0, float(w[0])), float(w[1])
        return self

    def score(self, text: str) -> float:
        z = self.slope * self.difference(text) + self.offset
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> CompressionClassifier:
    """A classifier from labelled rows whose crc32(id as text) mod 5 is not 0: two thirds of them build the dictionaries, the
    rest calibrate. At most fit_docs of them, of smallest hash, are taken, and fewer where their whole texts come to more than fit_bytes. Null labels
    and texts are left out. With one class only, or no rows, every score follows from what there is (0.5 with none)."""
    i, y = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    chosen = sample_by_hash(labels.where(y.isNotNull() & (F.crc32(i.cast("string")) % 5 != 0)).select(i.alias("id"), y.cast("int").alias("y")), "id", fit_docs)
    texts = keyed(docs, id_col, text_col).toDF("id", "text").where("text is not null")
    sample = texts.join(F.broadcast(chosen), "id")
    sizes = sample.groupBy("id").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).orderBy(F.xxhash64("id"), "id").collect()
    if sum(r.bytes for r in sizes) > fit_bytes:
        room = np.cumsum([r.bytes for r in sizes]) <= fit_bytes
        sample = sample.where(F.col("id").isin([r.id for r, fits in zip(sizes, room, strict=True) if fits]))
    rows = sample.select("id", "y", "text").collect()
    rows = sorted({(r.id, r.y, r.text) for r in rows})
    part = lambda r: zlib.crc32(f"part{r[0]}".encode()) % 3
    build, rest = [r for r in rows if part(r)], [r for r in rows if not part(r)]
    model = CompressionClassifier(*(dictionary([t for _, y, t in build if y == q]) for q in (1, 0)))
    return model.calibrate([t for _, _, t in rest], [y for _, y, _ in rest])


def classify(docs: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row per input row: id, held_out (crc32 of the id as text, mod 5, is 0), score (0 to 1) and predicted (score >= cut).

    Whole texts are compressed, chunk by chunk, in constant memory beside the text. A null or empty text has no difference
    and gets the score of one. Repeated rows score alike; other columns are not read; no row gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "score": [own.score(t) for t in b["text"].where(b["text"].notna(), "")]})

    slim = keyed(docs, id_col, text_col).toDF("id", "text")
    scored = slim.mapInPandas(run, f"id {slim.schema['id'].dataType.simpleString()}, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: CompressionClassifier, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose text scores cut or more. Null and empty texts stay if the base score does."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # so that few texts are held twice
                b = whole.slice(at, 500)
                yield b.filter(pa.array([own.score(t or "") >= cut for t in b.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
