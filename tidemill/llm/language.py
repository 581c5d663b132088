"""Language ID by error-correcting output codes.

Texts become counts of hashed byte n-grams. Each language has a codeword; for each bit of the code a logistic classifier
over the n-grams learns to predict it. Decoding weighs every bit by the loss that its margin gives against the codeword's
bit, and takes the language with the smallest sum; the score is that language's share after exponentiating the negative
sums, and a text whose best share stays below ``clear`` is flagged as ambiguous.

The classifiers are fitted on the driver from a sample of at most about ``per_class`` labelled documents a language, and
``most`` in all, chosen by a hash of id and text, as vectors of fixed size. Predictions read whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import small, stored
from .textkit import SEGMENT, slices

DIM = 4096
#: The longest n-gram, in bytes; all have two at least.
LONGEST = 3
#: Rows whose vectors are held at a time.
PIECE_ROWS = 128
UNKNOWN = "und"
#: Bytes that tell no language, digits and ASCII punctuation, count as a space.
PLAIN = np.arange(256, dtype=np.uint32)
PLAIN[[*range(0, 97), *range(123, 128)]] = 32


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of n-gram counts (square roots), and whether each text has a letter. Long texts are counted by
    segments."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], np.uint8) if low.buffers()[2] else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(low)
    counts, ascii_letter = np.zeros(n * DIM, np.float32), np.zeros(n, bool)
    for at in range(0, len(data), SEGMENT):
        part = data[at : at + SEGMENT + LONGEST - 1]
        low_row, high_row = np.searchsorted(offsets, (at, at + len(part) - 1), side="right") - 1
        row = np.repeat(np.arange(low_row, high_row + 1), np.diff(np.clip(offsets[low_row : high_row + 2], at, at + len(part))))
        ascii_letter[row[(part >= 97) & (part <= 122)]] = True
        b = gram = PLAIN[part]
        for size in range(2, LONGEST + 1):
            gram = gram[:-1] * np.uint32(257) + b[size - 1 :] if len(b) >= size else np.zeros(0, np.uint32)
            own = min(len(gram), SEGMENT)  # those that begin in this segment
            same = row[:own] == row[size - 1 :][:own]
            place = ((gram[:own][same] * np.uint32(2654435761) + np.uint32(size)) >> np.uint32(20)).astype(np.int64)
            counts[low_row * DIM : (high_row + 1) * DIM] += np.bincount((row[:own][same] - low_row) * DIM + place, minlength=(high_row - low_row + 1) * DIM)
    letter = np.array([a or any(map(str.isalpha, low[i].as_py())) for i, a in enumerate(ascii_letter.tolist())], dtype=bool)
    x = np.sqrt(counts.reshape(n, DIM))
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    return x, letter


def pieces(batch: pa.RecordBatch):
    for piece in slices(batch, "text", SEGMENT):
        for at in range(0, piece.num_rows, PIECE_ROWS):
            yield piece.slice(at, PIECE_ROWS)


def codewords(classes: int, seed: int = 6) -> np.ndarray:
    """A row of +1 and -1 per class: every split of up to five classes into two, and a seeded random code beyond, drawn
    until no two rows agree and no column is constant."""
    if classes <= 5:
        columns = range(1, 2 ** (classes - 1))
        return np.array([[1 if c == 0 or not (j >> (c - 1)) & 1 else -1 for j in columns] for c in range(classes)], dtype=np.float32).reshape(classes, -1)
    bits, rng = 10 * int(np.ceil(np.log2(classes))), np.random.default_rng(seed)
    while True:
        code = rng.choice(np.array([-1, 1], np.float32), (classes, bits))
        if len({tuple(r) for r in code}) == classes and (np.abs(code.sum(axis=0)) < classes).all():
            return code


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 150, rate: float = 0.3, decay: float = 1e-5):
    """Weights (DIM x bits) and offsets of all bits' logistic classifiers: Adam on the whole sample, classes weighing alike."""
    share = 1.0 / np.bincount(y, minlength=len(code)).clip(1)
    weight = (share[y] / len(code)).astype(np.float32)[:, None]
    sign = code[y]
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        g = -sign / (1 + np.exp(np.clip(sign * (x @ w + b), -30, 30))) * weight
        for k, grad in enumerate((x.T @ g + decay * w, g.sum(axis=0))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            step = rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
            if k == 0:
                w -= step
            else:
                b -= step
    return w, b


def held_out():
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_class: int = 500, most: int = 10_000, seed: int = 6) -> dict:
    """The model: languages in code-point order, their codewords, weights and offsets.

    Rows without text, label or id teach nothing, nor do held-out ones, texts without a letter and further columns; repeated
    rows count once. The model of an empty table has no languages.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("n")), "labels")
    each = min(float(per_class), most / max(1, counts.count()))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(small(counts), "lang").where(place * F.col("n") < each).select("lang", "text").distinct()

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                x, letter = vectors(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("lang"), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["lang", "x"]).filter(pa.array(letter))

    rows = sample.mapInArrow(run, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r.lang, r.x))
    langs = sorted({r.lang for r in rows})
    if not rows:
        return {"langs": [], "code": None, "w": None, "b": None}
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32)
    y = np.array([langs.index(r.lang) for r in rows])
    code = codewords(len(langs))
    w, b = fit(x, y, code)
    return {"langs": langs, "code": code, "w": w, "b": b}


def decode(model: dict, texts: pa.Array, clear: float) -> tuple[list, np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    x, letter = vectors(texts)
    if not model["langs"]:
        return [UNKNOWN] * len(x), np.zeros(len(x)), np.ones(len(x), bool)
    margin = (x @ model["w"] + model["b"]).astype(np.float64)
    loss = np.logaddexp(0, -margin[:, None, :] * model["code"][None]).sum(axis=2)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share /= share.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    score = np.where(letter, share[np.arange(len(x)), best], 0.0)
    return [model["langs"][k] if a else UNKNOWN for k, a in zip(best.tolist(), letter.tolist())], score, ~letter | (score < clear)


def identify(docs: DataFrame, model: dict, clear: float = 0.5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row of docs; other columns are ignored.

    A text that is null or has no letter is ``und`` with score 0 and ambiguous, as is every text when nothing could be
    learned. With one language learned, all texts with letters are of it. Labels, sources and ids are not looked at. Equal
    losses go to the first language by code point. Repeated rows stay. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                lang, score, unsure = decode(model, piece.column("text"), clear)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def known_language(docs: DataFrame, model: dict, clear: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is told without ambiguity. See identify: texts that are null or
    have no letter go, repeated rows are judged alike, and an empty table gives no rows."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            plain = batch.rename_columns([str(i) if i != at else "text" for i in range(len(names))])
            for piece in pieces(plain):
                _, _, unsure = decode(model, piece.column("text"), clear)
                yield piece.filter(pa.array(~unsure)).rename_columns(names)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
