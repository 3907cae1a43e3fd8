"""Quality classification: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` bytes. Each is encoded as character-class shares and the share
of different 4-byte sequences. A hidden layer embeds each passage; gated attention (tanh times sigmoid) weighs
the embeddings; the weighted sum gives the score. All weights are learned from document labels alone, by full
batches over a bounded sample of labelled documents (``SAMPLE`` rows, ``SAMPLE_PASSAGES`` evenly spaced passages
of each). Scoring uses every passage of every text.

Defined cases: null text is empty; an empty text scores 0. Without labels of both classes, every other text
scores the share of label 1 (0.5 without labels). Several labels of one id count as their mean, rounded half up;
null labels are ignored. A null ``doc_id`` has no label; of the rows of a repeated id one is learned from, the one with
the least hash of its text, and all are scored row by row. An empty table gives
no rows. ``score_quality`` reads doc_id and text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binwright.llm.common import held_out, id_and_text, ship

PASSAGE = 512
SAMPLE = 3000
SAMPLE_PASSAGES = 64
HIDDEN = 16
STEPS = 300
THRESHOLD = 0.7

# Fixed classes of bytes; a byte in none of them (beyond ASCII) is in the last class.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\v\f", ".", ",", "!?", "|", "#$%&*", "@_/\\=<>", "\"'`()[]{}:;-+^~")
N_FEATURES = len(CLASSES) + 2
BUCKETS = 1024


def _class_table() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.int64)
    for i, chars in enumerate(CLASSES):
        for c in chars:
            out[ord(c)] = i
    return out


CLASS_OF = _class_table()


def encode(text: str) -> np.ndarray:
    """A row of features per passage of the text; none for an empty text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = -(-len(data) // PASSAGE)
    if not n:
        return np.zeros((0, N_FEATURES), np.float32)
    passage = np.arange(len(data)) // PASSAGE
    width = len(CLASSES) + 1
    counts = np.bincount(passage * width + CLASS_OF[data], minlength=n * width).reshape(n, width)
    sizes = counts.sum(1, keepdims=True)
    wide = data.astype(np.uint32)
    four = np.zeros(len(data), np.uint32)
    if len(data) > 3:
        four[:-3] = (wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24) * np.uint32(2654435761) >> np.uint32(22)
    seen = np.zeros(n * BUCKETS, bool)
    seen[passage * BUCKETS + four] = True
    expected = BUCKETS * (1 - (1 - 1 / BUCKETS) ** np.maximum(sizes[:, 0], 1))
    distinct = seen.reshape(n, BUCKETS).sum(1) / expected
    return np.hstack([np.sqrt(counts / sizes), distinct[:, None]]).astype(np.float32)


@dataclass
class Model:
    """Weights; ``parts`` maps names to arrays. ``share`` is the score when there is nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]
    share: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of bags of passages; bag i holds sizes[i] rows of x from starts[i] on, at least one."""
        p, bag = self.parts, np.repeat(np.arange(len(sizes)), sizes)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["embed"] + p["embed_0"])
        t, g = np.tanh(h @ p["tanh"]), _sigmoid(h @ p["gate"])
        logits = (t * g) @ p["attend"]
        e = np.exp(logits - np.maximum.reduceat(logits, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "y": _sigmoid(z @ p["out"] + p["out_0"])}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(bags))
        full = [i for i, b in enumerate(bags) if len(b)]
        if full and self.share is not None:
            out[full] = self.share
        elif full:
            sizes = np.array([len(bags[i]) for i in full])
            out[full] = self.forward(np.vstack([bags[i] for i in full]), np.cumsum(sizes) - sizes, sizes)["y"]
        return out


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def fit(bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Model:
    """Learn all weights together by Adam on the cross-entropy of document labels."""
    keep = [i for i, b in enumerate(bags) if len(b)]
    bags, labels = [bags[i] for i in keep], labels[keep].astype(float)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, float(labels.mean()) if len(labels) else 0.5)
    x, sizes = np.vstack(bags).astype(float), np.array([len(b) for b in bags])
    starts, rng = np.cumsum(sizes) - sizes, np.random.default_rng(seed)
    shapes = {"embed": (N_FEATURES, HIDDEN), "embed_0": (HIDDEN,), "tanh": (HIDDEN, HIDDEN), "gate": (HIDDEN, HIDDEN), "attend": (HIDDEN,), "out": (HIDDEN,), "out_0": ()}
    model = Model(x.mean(0), x.std(0) + 1e-3, {k: np.asarray(rng.normal(0, 0.3, s)) for k, s in shapes.items()})
    first = {k: np.zeros(s) for k, s in shapes.items()}
    second = {k: np.zeros(s) for k, s in shapes.items()}
    for step in range(1, steps + 1):
        f, p = model.forward(x, starts, sizes), model.parts
        d_out = (f["y"] - labels) / len(labels)
        d_z = d_out[:, None] * p["out"]
        along = (d_z[f["bag"]] * f["h"]).sum(1)  # by the attention weight of each passage
        d_logit = f["a"] * (along - np.add.reduceat(f["a"] * along, starts)[f["bag"]])
        d_tg = d_logit[:, None] * p["attend"]
        d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h = f["a"][:, None] * d_z[f["bag"]] + d_t @ p["tanh"].T + d_g @ p["gate"].T
        d_pre = d_h * (1 - f["h"] ** 2)
        grads = {
            "embed": f["x"].T @ d_pre, "embed_0": d_pre.sum(0), "tanh": f["h"].T @ d_t, "gate": f["h"].T @ d_g,
            "attend": (f["t"] * f["g"]).T @ d_logit, "out": f["z"].T @ d_out, "out_0": d_out.sum(),
        }
        for k, g in grads.items():
            g = g + 1e-4 * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - 0.03 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows outside the held-out fold; a hash of the id picks at most about ``sample`` of them."""
    ship(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")
    )
    share = min(1.0, sample / max(1, known.count()))
    rank = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(2**31)) / 2**31
    picked = known.where(rank < share).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    rows = id_and_text(docs).join(F.broadcast(picked), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    rows = rows.groupBy("doc_id", "label").agg(one).select("doc_id", "label", "one.text")  # about ``sample`` rows, by the share above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for text in batch.column("text").to_pylist():
                bag = encode(text)
                if len(bag) > SAMPLE_PASSAGES:
                    bag = bag[np.linspace(0, len(bag) - 1, SAMPLE_PASSAGES).astype(int)]
                bags.append(bag.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    got = sorted(rows.mapInArrow(run, "doc_id long, label int, bag binary").collect())
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in got]
    return fit(bags, np.array([r["label"] for r in got], float))


def scored(rows: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``rows`` with one more column: the score of ``text``. Every other column passes unchanged."""
    ship(rows.sparkSession)
    if column in rows.columns:
        raise ValueError(f"column {column} exists already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                score = model.score([encode(t or "") for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{column}` double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = learn_quality(docs, labels)
    return scored(id_and_text(docs), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected."""
    rows = scored(docs, learn_quality(docs, labels), "_quality_score")
    return rows.where(F.col("_quality_score") >= THRESHOLD).drop("_quality_score")
