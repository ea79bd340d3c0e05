"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become small learned vectors; learned filters of 16 bytes slide over the text in
steps of 8, in overlapping chunks that cover the whole document. Each chunk keeps every
filter's largest answer; their mean over the chunks and their maximum over the document
are combined into one probability. Nothing but the text is an input.

The fit takes at most ``fit_docs`` labelled documents, and of those at most ``fit_bytes`` of
text, in the order of a hash of the id (a text larger than what is left of that is passed
over); it runs in the driver. Weights of a few tens of kilobytes go to the tasks, which
score whole texts in one pass without a shuffle, a long one piece by piece: mean and
maximum over chunks need no more than one piece at a time.

Defined cases: null and empty texts have one chunk of padding and get its score; very long
texts are scored whole, in bounded memory; without labels of both classes every score is
the share of label 1 (0.5 without any label); several labels of one document count by
their largest, and of several texts of one id the largest teaches; a score of 0.5 counts as
1; repeated rows are scored alike; an empty table gives an empty result; extra columns are
ignored by ``classify`` and kept by ``scored``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_DOCS, FIT_BYTES = 3000, 12 << 20
WIDTH, BLOCK, CHUNK = 6, 8, 64  # of a byte's vector; bytes a step; steps a chunk
#: Bytes of text scored at once.
PIECE = 1 << 18
FILTERS, EPOCHS, BATCH_BYTES, RATE, SEED = 32, 8, 96 << 10, 0.008, 7


def _chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as [chunk, steps + 1, BLOCK], each step's mask, each chunk's document, chunks of each document.

    A chunk's last block is also the first of the next, so filters that lie across
    two chunks are not lost.
    """
    steps = [max(1, -(-len(t) // BLOCK)) for t in texts]
    counts = np.array([-(-n // CHUNK) for n in steps])
    firsts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros((firsts[-1] * CHUNK + 1, BLOCK), dtype=np.uint8)
    mask = np.zeros(firsts[-1] * CHUNK, dtype=bool)
    view = flat.reshape(-1)
    for t, n, k in zip(texts, steps, firsts):
        at = k * CHUNK * BLOCK
        view[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        mask[k * CHUNK : k * CHUNK + n] = True
    blocks = flat[(np.arange(firsts[-1]) * CHUNK)[:, None] + np.arange(CHUNK + 1)]
    # the block after a document's end belongs to the next document
    blocks[firsts[1:] - 1, CHUNK] = 0
    return blocks, mask.reshape(-1, CHUNK), np.repeat(np.arange(len(texts)), counts), counts


class Network:
    def __init__(self, prior: float = 0.5, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        fan = 2 * BLOCK * WIDTH
        self.w = {
            "bytes": draw(256, WIDTH, scale=0.5), "filters": draw(fan, FILTERS, scale=1.4 / fan**0.5), "bias": np.zeros(FILTERS, np.float32),
            "mean": draw(FILTERS, scale=0.2), "top": draw(FILTERS, scale=0.2), "shift": np.full(1, np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0, np.float32),
        }
        self.constant: float | None = None if 0 < prior < 1 else prior

    def peaks(self, texts: list[bytes]):
        """The largest answer of every chunk and filter, with what the gradients need."""
        w, half = self.w, BLOCK * WIDTH
        blocks, mask, owner, counts = _chunks(texts)
        n = len(blocks)
        vectors = w["bytes"][blocks].reshape(n, CHUNK + 1, half)
        answers = (vectors[:, :-1].reshape(-1, half) @ w["filters"][:half] + vectors[:, 1:].reshape(-1, half) @ w["filters"][half:]).reshape(n, CHUNK, FILTERS)
        answers[~mask] = -np.inf
        return answers.max(axis=1) + w["bias"], (blocks, owner, counts, vectors, answers)

    def logit(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        return mean @ self.w["mean"] + top @ self.w["top"] + self.w["shift"][0]

    def forward(self, texts: list[bytes]):
        peak, (blocks, owner, counts, vectors, answers) = self.peaks(texts)
        kept = np.maximum(peak, 0)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(kept, starts, axis=0) / counts[:, None]
        top = np.maximum.reduceat(kept, starts, axis=0)
        return self.logit(mean, top), (blocks, owner, counts, vectors, answers, peak, kept, mean, top)

    def long_logit(self, text: bytes) -> float:
        """The logit of one text, a piece at a time."""
        step, total, top, count = PIECE // (BLOCK * CHUNK) * BLOCK * CHUNK, np.zeros(FILTERS), np.zeros(FILTERS, np.float32), 0
        for at in range(0, max(len(text), 1), step):
            # the block after a piece belongs to its last chunk; the chunk that it starts is the next piece's
            kept = np.maximum(self.peaks([text[at : at + step + BLOCK]])[0], 0)[: step // (BLOCK * CHUNK)]
            total += kept.sum(axis=0, dtype=np.float64)
            top = np.maximum(top, kept.max(axis=0))
            count += len(kept)
        return float(self.logit((total / count).astype(np.float32), top))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        logits, part, places, size = np.zeros(len(texts)), [], [], 0

        def run():
            if part:
                logits[places] = self.forward(part)[0]
            part.clear(), places.clear()

        for k, text in enumerate(texts):
            if len(text) > PIECE:
                logits[k] = self.long_logit(text)
                continue
            if size + len(text) > PIECE:
                run()
                size = 0
            part.append(text)
            places.append(k)
            size += len(text) + BLOCK * CHUNK
        run()
        # rounded, so that a text scores alike in every batch
        return np.round(1 / (1 + np.exp(-np.clip(logits, -40, 40))), 5)

    def gradients(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        w, half = self.w, BLOCK * WIDTH
        logit, (blocks, owner, counts, vectors, answers, peak, kept, mean, top) = self.forward(texts)
        error = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels) * weights / len(texts)).astype(np.float32)
        out = {"mean": error @ mean, "top": error @ top, "shift": error.sum(keepdims=True)}
        winner = kept == top[owner]
        ties = np.add.reduceat(winner, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0, dtype=np.float32)  # equal chunks share
        per_chunk = (error / counts)[owner][:, None] * w["mean"] + winner / ties[owner] * error[owner][:, None] * w["top"]
        per_chunk = np.where(peak > 0, per_chunk, 0).astype(np.float32)
        out["bias"] = per_chunk.sum(axis=0)
        # only the winning step of each chunk and filter learns
        step = answers.argmax(axis=1)
        rows = np.arange(len(blocks))[:, None]
        pair = np.concatenate([vectors[rows, step], vectors[rows, step + 1]], axis=2)
        out["filters"] = np.einsum("cf,cfk->kf", per_chunk, pair)
        back = per_chunk[:, :, None] * w["filters"].T[None]
        seen = np.concatenate([blocks[rows, step], blocks[rows, step + 1]], axis=2).reshape(-1)
        back = back.reshape(-1, WIDTH)
        out["bytes"] = np.stack([np.bincount(seen, back[:, k], minlength=256) for k in range(WIDTH)], axis=1).astype(np.float32)
        return out

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> "Network":
        if self.constant is not None:
            return self
        rng = np.random.default_rng(SEED)
        share = labels.mean()
        weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        sizes = np.array([len(t) + 512 for t in texts])
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        total = epochs * max(1, int(sizes.sum() // BATCH_BYTES) + 1)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // BATCH_BYTES)) + 1):
                step += 1
                rate = RATE * max(0.05, 1 - step / (total + 1))
                for k, g in self.gradients([texts[i] for i in part], labels[part], weights[part]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
        return self


def fit_network(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> Network:
    """A network from a bounded sample of the labelled rows."""
    order = F.xxhash64(F.col("__id").cast("string"), F.lit("fit"))
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__label IS NOT NULL AND __id IS NOT NULL")
    marks = marks.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(order).limit(fit_docs)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    # at most ``fit_docs`` texts: one of each id
    found = texts.join(F.broadcast(marks), "__id").groupBy("__id").agg(F.max("__text").alias("__text"), F.max("__label").alias("__label"))
    sized = found.withColumn("__n", F.octet_length("__text")).withColumn("__o", order)
    taken, left = [], fit_bytes
    for r in sized.select("__id", "__n", "__o").orderBy("__o", "__n", "__id").collect():
        if r["__n"] <= left:
            taken.append(r["__id"])
            left -= r["__n"]
    chosen = docs.sparkSession.createDataFrame([(i,) for i in taken], "__id long")
    rows = sorted((r["__id"], r["__label"], r["__text"]) for r in found.join(F.broadcast(chosen), "__id", "left_semi").collect()) if taken else []
    if not rows:
        return _constant(0.5)
    marks_ = np.array([r[1] for r in rows], dtype=np.float32)
    prior = float(marks_.mean())
    if prior in (0.0, 1.0):
        return _constant(prior)
    return Network(0.5).fit([r[2].encode() for r in rows], marks_)


def _constant(score: float) -> Network:
    network = Network(0.5)
    network.constant = score
    return network


def scored(docs: DataFrame, network: Network, text_col: str = "text", out: str = "__score") -> DataFrame:
    """``docs`` with a column ``out``."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores([(t or "").encode() for t in texts]))

    return docs.withColumn(out, score(F.col(f"`{text_col}`")))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels of held-out rows are not learned from."""
    network = fit_network(docs, labels.where(~held_out(id_col)), id_col, **options)
    rows = scored(docs.select(F.col(id_col).alias("doc_id"), "text"), network)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
