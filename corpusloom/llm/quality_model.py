"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded; gated attention
weights, learnt from document labels alone, say how much each passage counts;
the weighted passage representation is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import log1p
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.sampling import hash_sample

PASSAGE_WORDS = 96
SHAPES = 48
HIDDEN, GATE = 24, 16
#: Bound of the learning sample, in documents.
SAMPLE_ROWS = 3000
#: Score from which a document is predicted to be good.
THRESHOLD = 0.7
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_UPPER = re.compile(r"[A-Z]")
_SYMBOL = re.compile(r"[#*$%&|<>=@^~{}\[\]\\_/]")
_STOP = re.compile(r"[.?](?=\s|$)")


def _bucket(shape: str, known: dict[str, int]) -> int:
    if shape not in known:
        if len(known) > 20_000:
            known.clear()
        known[shape] = crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES
    return known[shape]


def passage_features(words: list[str], known: dict[str, int]) -> list[float]:
    """Surface statistics and hashed word shapes of one passage."""
    text = " ".join(words)
    n, chars = len(words), max(len(text), 1)
    counts = Counter(words)
    shapes = [0.0] * SHAPES
    for shape, k in Counter(_DIGITS.sub("0", _LETTERS.sub("a", text)).split(" ")).items():
        shapes[_bucket(shape, known)] += k / max(n, 1)
    letters = sum(map(len, _LETTERS.findall(text)))
    upper = len(_UPPER.findall(text))
    return [
        log1p(n) / 5,
        chars / max(n, 1) / 10,
        letters / chars,
        upper / max(letters, 1),
        len(_SYMBOL.findall(text)) / chars,
        text.count("!") / chars,
        len(_STOP.findall(text)) / max(n, 1),
        text.count(",") / max(n, 1),
        len(counts) / max(n, 1),
        max(counts.values(), default=0) / max(n, 1),
        sum(map(eq, words, words[1:])) / max(n, 1),
        sum(map(len, _DIGITS.findall(text))) / chars,
        *shapes,
    ]


FEATURES = 12 + SHAPES


def bag(text: str | None, known: dict[str, int]) -> np.ndarray:
    """One row of features per passage; an empty text is one empty passage."""
    words = (text or "").split()
    parts = [words[i : i + PASSAGE_WORDS] for i in range(0, len(words), PASSAGE_WORDS)] or [[]]
    return np.array([passage_features(p, known) for p in parts], dtype=np.float32)


@dataclass
class AttentionModel:
    """Gated attention over encoded passages."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """All steps for passages ``x`` of documents that begin at ``starts``."""
        w = self.weights
        sizes = np.diff([*starts, len(x)])
        h = np.tanh(((x - self.mean) / self.scale) @ w["encode"] + w["encode_b"])
        v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        raw = (v * u) @ w["attend"]
        e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "sizes": sizes, "score": 1 / (1 + np.exp(-(z @ w["out"] + w["out_b"])))}


    def gradients(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Slopes of the mean logistic loss in every weight."""
        w, s = self.weights, self.forward(x, starts)
        d_out = (s["score"] - labels) / len(labels)
        d_z = np.repeat(d_out[:, None] * w["out"], s["sizes"], axis=0)
        d_a = (d_z * s["h"]).sum(axis=1)
        d_raw = s["a"] * (d_a - np.repeat(np.add.reduceat(s["a"] * d_a, starts), s["sizes"]))
        d_gate = d_raw[:, None] * w["attend"]
        d_v, d_u = d_gate * s["u"] * (1 - s["v"] ** 2), d_gate * s["v"] * s["u"] * (1 - s["u"])
        d_h = s["a"][:, None] * d_z + d_v @ w["v"].T + d_u @ w["u"].T
        d_in = d_h * (1 - s["h"] ** 2)
        return {
            "out": s["z"].T @ d_out,
            "out_b": d_out.sum(keepdims=True),
            "attend": (s["v"] * s["u"]).T @ d_raw,
            "v": s["h"].T @ d_v,
            "u": s["h"].T @ d_u,
            "encode": ((x - self.mean) / self.scale).T @ d_in,
            "encode_b": d_in.sum(axis=0),
        }


def fit_attention(bags: list[np.ndarray], labels: np.ndarray, rounds: int = 60, size: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> AttentionModel:
    """Learn from bags and their labels (0 or 1) with Adam; deterministic for a seed."""
    draw = np.random.default_rng(seed)
    everything = np.concatenate(bags) if bags else np.zeros((1, FEATURES), dtype=np.float32)
    shapes = {"encode": (FEATURES, HIDDEN), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "attend": (GATE,), "out": (HIDDEN,)}
    weights = {k: (draw.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for k, s in shapes.items()}
    weights |= {"encode_b": np.zeros(HIDDEN, dtype=np.float32), "out_b": np.zeros(1, dtype=np.float32)}
    model = AttentionModel(everything.mean(axis=0), everything.std(axis=0) + 0.05, weights)
    if not bags:
        return model
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    step = 0
    for _ in range(rounds):
        order = draw.permutation(len(bags))
        for at in range(0, len(order), size):
            chosen = order[at : at + size]
            x = np.concatenate([bags[i] for i in chosen])
            starts = np.cumsum([0, *[len(bags[i]) for i in chosen[:-1]]])
            step += 1
            for k, g in model.gradients(x, starts, labels[chosen]).items():
                g = g + decay * weights[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AttentionModel:
    """Fit on at most ``SAMPLE_ROWS`` labelled documents, chosen by a hash of the id.

    Labels other than 0 and 1 are left out.  The model sees whole texts only.
    """

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            bags = [bag(t, known).ravel() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.list_(pa.float32()))], ["id", "label", "bag"])

    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chosen = hash_sample(marks.join(texts.select("id"), "id", "left_semi").select("id"), SAMPLE_ROWS)
    marked = marks.join(F.broadcast(chosen), "id")  # at most SAMPLE_ROWS rows
    # of rows that share an id, the least text; its features are made where it is, and only they are collected
    sample = texts.join(F.broadcast(marked), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "label", "text")
    rows = sample.mapInArrow(run, "id long, label int, bag array<float>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"], r["label"], r["bag"]))
    bags = [np.array(r["bag"], dtype=np.float32).reshape(-1, FEATURES) for r in rows]
    return fit_attention(bags, np.array([r["label"] for r in rows], dtype=np.float32))


def score_quality(df: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, score, predicted, n_passages, top_passage, top_weight`` for every row.

    ``top_passage`` is the passage with the largest attention weight; ``keep``
    names columns that stay, in place of the id alone.  Null and empty texts are
    one empty passage and get a score as well; null ids and repeated rows stay; an
    empty table gives an empty result; other columns are ignored.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            scores, sizes, tops, peaks = [], [], [], []
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, len(texts), 256):
                bags = [bag(t, known) for t in texts[at : at + 256].to_pylist()]
                starts = np.cumsum([0, *map(len, bags[:-1])])
                s = sent.value.forward(np.concatenate(bags), starts)
                scores += s["score"].astype(float).tolist()
                for k, b in zip(starts, bags, strict=True):
                    top = int(s["a"][k : k + len(b)].argmax())
                    sizes.append(len(b))
                    tops.append(top)
                    peaks.append(float(s["a"][k + top]))
            made = [pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(tops, pa.int64()), pa.array(peaks, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "score", "n_passages", "top_passage", "top_weight"])

    picked = df.select(*([F.col(c) for c in keep] or [F.col(id_col)]), F.col(text_col).alias("__text"))
    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    scored = picked.mapInArrow(run, f"{shown}, score double, n_passages long, top_passage long, top_weight double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
