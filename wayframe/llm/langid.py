"""Language identification with words first and shorter and shorter n-grams after.

The model holds, for each language, log frequencies of words and of character n-grams
of 4, 3, 2 and 1 characters (word ends included). A word the model knows is scored by
its own log frequencies; an unseen one by the mean over its longest n-grams that the
model knows any of, then by shorter ones. A text's language has the largest sum over
all its words.

The fit takes a sample of the labelled texts, for each language an equal part of
``fit_docs`` in expectation (a hash of the id decides), counts in the tasks, and keeps of
each language the most frequent words and n-grams, an equal part of ``vocabulary``
divided by ``SHARES``: a rare language has as many as a common one. That table, whose
size is bounded, is sent to the tasks that score every whole text; the distinct words of
a batch are looked up once.

Defined cases: null texts, and texts without a letter, are ``und`` with score 0; ties
go to the language first in order; without any labelled text all are ``und``; very long
texts are scored whole, in one row; repeated rows are scored alike; an empty table gives
an empty result; extra columns, whatever their names, are kept by ``keep_known``.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, kept, unused

FIT_DOCS, VOCABULARY, ORDERS = 10_000, 100_000, (4, 3, 2, 1)
#: A document whose best language has less of the probability is rejected in the pipeline.
MIN_SCORE = 0.5
SMOOTHING = 0.5
#: Parts of the vocabulary for words and for n-grams of each order.
SHARES = {0: 0.4, 4: 0.3, 3: 0.2, 2: 0.08, 1: 0.02}
#: Languages whose shares may be broadcast; characters of text scored at once; distinct words counted at once.
BROADCAST_LANGUAGES, PART_CHARS, FIT_WORDS = 10_000, 1 << 19, 50_000
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def core(word: str) -> str:
    """A lower-cased word without signs and digits at its ends; empty if it has no letter."""
    word = word.lower()
    return word if word.isalpha() else EDGES.sub("", word)


def grams(word: str, order: int) -> list[str]:
    line = f"<{word}>" if order > 1 else word
    return [line[i : i + order] for i in range(len(line) - order + 1)]


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS, vocabulary: int = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, int, str, int]]:
    """Counts ``(language, order, token, n)``; order 0 is the word itself."""
    rows = labelled.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = checkpointed(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")))
    languages = max(sizes.count(), 1)
    # never none of a language: the threshold is at least one of the hash's values for each document wanted
    space = 1 << 62
    least = sizes.select("lang", F.ceil(F.lit(float(space)) * F.least(F.lit(1.0), F.lit(max(1.0, fit_docs / languages)) / F.col("docs"))).alias("below"))
    rows = rows.join(F.broadcast(least) if languages <= BROADCAST_LANGUAGES else least, "lang")
    rows = rows.where(F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("fit")), F.lit(space)) < F.col("below")).select("lang", "text")

    def run(frames):
        counts: dict[str, Counter] = defaultdict(Counter)

        def flush():
            out = []
            for lang, found in counts.items():
                tokens: Counter = Counter()
                for word, n in found.items():
                    tokens[0, word] += n
                    for order in ORDERS:
                        for g in grams(word, order):
                            tokens[order, g] += n
                out += [(lang, order, token, n) for (order, token), n in tokens.items()]
            counts.clear()
            return pd.DataFrame(out, columns=["lang", "kind", "token", "n"]).astype({"kind": "int32"})

        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                counts[lang].update(w for w in map(core, text.split()) if w)
                if sum(map(len, counts.values())) > FIT_WORDS:
                    yield flush()
        yield flush()

    found = rows.mapInPandas(run, "lang string, kind int, token string, n long").groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))
    quota = F.greatest(F.lit(1), F.floor(_share(F.col("kind")) * (vocabulary / languages)))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "token")))
    return sorted(tuple(r) for r in ranked.where(F.col("rank") <= quota).select("lang", "kind", "token", "n").collect())


class Model:
    """Scores texts by the counts ``(language, order, token, n)``."""

    def __init__(self, counts: list[tuple[str, int, str, int]]):
        self.languages = sorted({c[0] for c in counts})
        at = {lang: k for k, lang in enumerate(self.languages)}
        by_kind: dict[int, dict[str, np.ndarray]] = defaultdict(dict)
        for lang, kind, token, n in counts:
            by_kind[kind].setdefault(token, np.zeros(len(at)))[at[lang]] = n
        # each kind's tokens, words as text and n-grams as sorted hashes, with a row of log frequencies for each
        self.words, self.grams, self.logs = pa.array([], pa.string()), {}, {}
        for kind, tokens in by_kind.items():
            names, total = sorted(tokens), sum(tokens.values())
            logs = np.array([np.log((tokens[t] + SMOOTHING) / (total + SMOOTHING * len(tokens))) for t in names])
            if kind == 0:
                self.words = pa.array(names, pa.string())
            else:
                hashes = gram_hashes(np.frombuffer("".join(names).encode("utf-32-le"), dtype="<u4"), kind)[::kind]
                order = np.argsort(hashes)
                self.grams[kind], logs = hashes[order], logs[order]
            self.logs[kind] = logs

    def of_words(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word, by itself or by its longest known n-grams; zeros without any."""
        cores = list(map(core, words))
        out = np.zeros((len(words), len(self.languages)))
        known = pc.index_in(pa.array(cores, pa.string()), value_set=self.words).fill_null(-1).to_numpy()
        if 0 in self.logs:
            out[known >= 0] = self.logs[0][known[known >= 0]]
        left = [k for k in np.flatnonzero(known < 0).tolist() if cores[k]]
        for order in ORDERS:
            if not left or order not in self.grams:
                continue
            line = [f"<{cores[k]}>" if order > 1 else cores[k] for k in left]
            sizes = np.array([len(x) for x in line])
            hashes = gram_hashes(np.frombuffer("".join(line).encode("utf-32-le", "surrogatepass"), dtype="<u4"), order)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            counts = np.maximum(sizes - order + 1, 0)
            owner = np.repeat(np.arange(len(line)), counts)
            place = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            seeds = self.grams[order]
            row = np.minimum(np.searchsorted(seeds, hashes[place]), len(seeds) - 1)
            hit = seeds[row] == hashes[place]
            owner, row = owner[hit], row[hit]
            found = np.bincount(owner, minlength=len(line))
            some = np.flatnonzero(found)
            for lang in range(len(self.languages)):
                sums = np.bincount(owner, weights=self.logs[order][row, lang], minlength=len(line))
                out[np.array(left)[some], lang] = sums[some] / found[some]
            left = [k for k, n in zip(left, found.tolist()) if not n]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its probability for each text."""
        out, part, size = [("und", 0.0)] * len(texts), [], 0
        for k, text in enumerate(texts):
            if text and self.languages and any(c.isalpha() for c in text):
                part.append(k)
                size += len(text)
            if part and (size >= PART_CHARS or k == len(texts) - 1):
                for place, result in zip(part, self._part([texts[i] for i in part])):
                    out[place] = result
                part, size = [], 0
        if part:
            for place, result in zip(part, self._part([texts[i] for i in part])):
                out[place] = result
        return out

    def _part(self, texts: list[str]) -> list[tuple[str, float]]:
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        sizes = pc.list_value_length(lists).to_numpy()
        flat = lists.flatten().dictionary_encode()
        scores = self.of_words(flat.dictionary.to_pylist())
        places, owner = flat.indices.to_numpy(), np.repeat(np.arange(len(texts)), sizes)
        totals = np.stack([np.bincount(owner, weights=scores[:, k][places], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        best = totals.argmax(axis=1)
        chance = 1.0 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        return [(self.languages[b], c) for b, c in zip(best.tolist(), chance.tolist())]


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of the n-gram that starts at each character; the last ones are cut off."""
    n = max(0, len(points) - order + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(order):
        out = out * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n].astype(np.uint64) + np.uint64(1)
    return out


def _share(kind):
    out = F.lit(0.0)
    for k, share in SHARES.items():
        out = F.when(kind == k, share).otherwise(out)
    return out


def predictor(spark, counts: list[tuple[str, int, str, int]]):
    """A column function from texts to ``lang_pred, score``."""
    packed = zlib.compress(pickle.dumps(counts))  # about ``vocabulary`` rows; workers keep what is sent besides the model
    sent = spark.sparkContext.broadcast(packed)
    name = ("language", zlib.crc32(packed), len(packed))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = kept(name, lambda: Model(pickle.loads(zlib.decompress(sent.value))))
        return pd.DataFrame(model.predict(texts.tolist()), columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, train: DataFrame, text_col: str = "text", out: str = "language", **options) -> DataFrame:
    """``docs`` with a struct column ``out`` (lang_pred, score), learned from ``train``."""
    counts = fit(train, text_col=text_col, **options)
    return docs.withColumn(out, predictor(docs.sparkSession, counts)(F.col(f"`{text_col}`").cast("string")))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predictions(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; rows held out are not learned from."""
    rows = identify(docs.select(F.col(f"`{id_col}`").alias("doc_id"), "text"), docs.where(~held_out(id_col)), id_col=id_col, **options)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))


def keep_known(docs: DataFrame, train: DataFrame, min_score: float = MIN_SCORE, **options) -> DataFrame:
    """``docs`` without rows whose language is undetermined or scores less than ``min_score``; columns unchanged."""
    out = unused(docs, "language")
    rows = identify(docs, train, out=out, **options)
    return rows.where((F.col(f"`{out}`.lang_pred") != "und") & (F.col(f"`{out}`.score") >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
