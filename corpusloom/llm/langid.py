"""Language identification with error-correcting output codes.

Every language has a codeword; a binary classifier over hashed character n-grams
predicts each bit.  Decoding takes the codeword with the least logistic loss
over the predicted margins, where bits that were learnt better weigh more, and
flags a text as ambiguous if the runner-up is close.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.sampling import hash_sample

FEATURES = 8192
GRAMS = (1, 2, 3)
UNKNOWN = "und"
#: Bound of the learning sample: rows in all, and rows of one language.
SAMPLE_ROWS = 2400
SAMPLE_PER_LANGUAGE = 300
_OTHER = re.compile(r"[\W\d_]+")
_PRIMES = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)
#: Characters hashed at once, to bound memory on very long texts.
_BLOCK = 1 << 20


def gram_vector(text: str | None) -> np.ndarray | None:
    """Square roots of hashed n-gram frequencies, of length 1; None without a letter."""
    clean = f" {_OTHER.sub(' ', (text or '').lower()).strip()} "
    if not any(map(str.isalpha, clean)):
        return None
    codes = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = np.zeros(FEATURES)
    for n in GRAMS:
        for at in range(0, len(codes) - n + 1, _BLOCK):
            part = codes[at : at + _BLOCK + n - 1]
            mixed = np.full(len(part) - n + 1, n * 40503, dtype=np.uint32)
            for k in range(n):
                mixed = (mixed ^ part[k : len(part) - n + 1 + k]) * _PRIMES[k]
            counts += np.bincount((mixed >> np.uint32(19)).astype(np.int64), minlength=FEATURES)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """``k`` codewords of -1 and 1: all splits for up to five classes, else random distinct ones."""
    if k < 2:
        return np.zeros((k, 0), dtype=np.float32)
    if k <= 5:
        columns = [[1 if c == k - 1 or b >> c & 1 == 0 else -1 for c in range(k)] for b in range(1, 2 ** (k - 1))]
    else:
        draw, columns = np.random.default_rng(seed), []
        while len(columns) < 4 * math.ceil(math.log2(k)) + 11:
            bit = draw.choice([-1, 1], k).tolist()
            if abs(sum(bit)) < k and bit not in columns and [-x for x in bit] not in columns:
                columns.append(bit)
    return np.array(columns, dtype=np.float32).T


@dataclass
class OutputCode:
    """The learnt model: languages, their codewords, and a linear classifier a bit."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, score of the runner-up) of each row."""
        margins = vectors @ self.weights + self.bias
        losses = np.logaddexp(0, -margins[:, None, :] * self.codes[None]) @ self.trust
        shares = np.exp(losses.min(axis=1, keepdims=True) - losses)
        shares /= shares.sum(axis=1, keepdims=True)
        order = np.argsort(-shares, axis=1, kind="stable")
        rows = np.arange(len(vectors))
        second = shares[rows, order[:, 1]] if shares.shape[1] > 1 else np.zeros(len(vectors))
        return order[:, 0], shares[rows, order[:, 0]], second


def fit_output_code(vectors: np.ndarray, languages: list[str], rounds: int = 80, rate: float = 0.5, decay: float = 1e-5) -> OutputCode:
    """Learn a logistic classifier for every bit by gradient descent with momentum."""
    names = sorted(set(languages))
    of = np.array([names.index(x) for x in languages], dtype=int)
    codes = codewords(len(names))
    target = codes[of] if len(of) else np.zeros((0, codes.shape[1]), dtype=np.float32)
    share = np.bincount(of, minlength=len(names))
    each = (1 / (share[of] * max(len(names), 1)))[:, None].astype(np.float32) if len(of) else np.zeros((0, 1), dtype=np.float32)
    weights, bias = np.zeros((FEATURES, codes.shape[1]), dtype=np.float32), np.zeros(codes.shape[1], dtype=np.float32)
    m_w, v_w, m_b, v_b = (np.zeros_like(x) for x in (weights, weights, bias, bias))
    for step in range(1, rounds + 1):
        pull = -target * each / (1 + np.exp(target * (vectors @ weights + bias)))
        for x, g, m, v in ((weights, vectors.T @ pull + decay * weights, m_w, v_w), (bias, pull.sum(axis=0), m_b, v_b)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    wrong = ((vectors @ weights + bias) * target <= 0).mean(axis=0) if len(of) else np.zeros(codes.shape[1])
    trust = np.log((1.01 - wrong) / (wrong + 0.01))
    return OutputCode(names, codes, weights, bias, np.maximum(trust, 0.05) / max(trust.max(initial=0.05), 0.05))


def learn_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> OutputCode:
    """Fit on a bounded sample of labelled rows, the same number of each language.

    Rows without text, letter or label are left out.  A language gives at most
    ``SAMPLE_PER_LANGUAGE`` rows, chosen by a hash of the id, and all languages
    ``SAMPLE_ROWS``.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vector = gram_vector(text)
                if vector is not None:
                    at = np.flatnonzero(vector)
                    rows.append((lang, at.astype(np.int16), vector[at]))
            names, kinds = ["lang", "at", "value"], [pa.string(), pa.list_(pa.int16()), pa.list_(pa.float32())]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang is not null and length(text) > 0")
    languages = rows.select("lang").distinct().count()
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // max(languages, 1)))
    chosen = hash_sample(rows.select("id", "lang"), each, ("lang",)).select("id").distinct()  # at most SAMPLE_ROWS, or one a language
    texts = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("lang", "text")).alias("row"))
    sample = texts.select("row.lang", "row.text")
    found = sample.mapInArrow(run, "lang string, at array<smallint>, value array<float>").toArrow().to_pylist()
    found.sort(key=lambda r: (r["lang"], r["at"], r["value"]))
    vectors = np.zeros((len(found), FEATURES), dtype=np.float32)
    for k, r in enumerate(found):
        vectors[k, r["at"]] = r["value"]
    return fit_output_code(vectors, [r["lang"] for r in found])


def identify_language(df: DataFrame, model: OutputCode, id_col: str = "doc_id", text_col: str = "text", close: float = 0.2) -> DataFrame:
    """``id, lang_pred, score, ambiguous`` for every row, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0, and so is every
    text if the model knows no language.  Null ids and repeated rows stay; an
    empty table gives an empty result; further columns are ignored.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # FEATURES x bits numbers

    def run(batches):
        code = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores, close_by = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
            for at in range(0, len(texts), 256):
                vectors = {k: v for k in range(at, min(at + 256, len(texts))) if (v := gram_vector(texts[k])) is not None}
                if vectors and code.languages:
                    best, score, second = code.decode(np.stack(list(vectors.values())))
                    for k, b, s, t in zip(vectors, best, score, second, strict=True):
                        langs[k], scores[k], close_by[k] = code.languages[b], float(min(s, 1.0)), bool(s - t < close)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores, pa.float64()), pa.array(close_by)], ["id", "lang_pred", "score", "ambiguous"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)
