"""Language ID by nearest centroid.

A text becomes counts of hashed byte 2- and 3-grams of its lower-cased letters;
square-rooted, idf-weighted and scaled to length 1 they are its vector.  Each
language has up to ``CENTROIDS`` centroids from spherical k-means; a text takes
the language of the centroid with the largest cosine.  It is rejected when that
cosine is below the centroid language's floor for texts of its length: ``SLACK``
times the ``FLOOR``-quantile of the cosines of its own training texts whose
number of n-grams has the same power of two.  Lengths with fewer than ``LEAST``
training texts share the floor of the next longer ones.  Short texts agree little
with any centroid, so one floor for all lengths would reject either them or
nothing.

The classifier is fitted on ``PER_LANG`` labelled texts of each language, give or
take the scatter of the hash of the text that chooses them, at a rate taken from
the counts of all labels; a text that repeats is learned once.  Whole texts are
used there and in prediction.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and rejected; null labels and null texts teach nothing; without any labelled
text every text with a letter is ``und`` with score 0 and not rejected; repeated
rows are each predicted; ties go to the first language by code point; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, small_batches, stage, unclaimed
from .embeddings import spherical_kmeans

BITS, CENTROIDS, PER_LANG, FLOOR, SLACK, LEAST, FIT_TASKS, _PIECE = 13, 4, 1000, 0.01, 0.5, 40, 8, 1 << 20
DIM, SCALES = 1 << BITS, 40
_FOLD = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def grams(text: str) -> np.ndarray:
    """Counts of the text's hashed byte 2- and 3-grams; runs of other characters are one space."""
    out = np.zeros(DIM, np.int64)
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, max(1, len(raw) - 2), _PIECE):
        b = _FOLD[raw[at : at + _PIECE + 2]].astype(np.uint32)
        two = b[:-1] << 8 | b[1:]
        three = two[:-1] << 8 | b[2:]
        whole = len(b) <= _PIECE + 1 or at + _PIECE + 2 >= len(raw)
        two = two if whole else two[:-1]
        for g, salt in ((two[two != 0x2020], 0x9E3779B1), (three[(three >> 8 != 0x2020) & (three & 0xFFFF != 0x2020)], 0x85EBCA6B)):
            out += np.bincount((g * np.uint32(salt)) >> np.uint32(32 - BITS), minlength=DIM)
    return out


def scales(counts: np.ndarray) -> np.ndarray:
    """Power of two of each row's number of n-grams."""
    return np.log2(np.maximum(counts.sum(axis=1, dtype=np.float64), 1)).astype(int)


def floors(scale: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """A floor for each power of two; lengths without enough texts take the next longer ones in, the last the shorter ones."""
    out, low = np.zeros(SCALES), 0
    for high in range(1, SCALES + 1):
        left = (scale >= high).sum()
        some = cosines[(scale >= low) & (scale < high)]
        if high == SCALES or (len(some) >= LEAST and left >= LEAST):
            if len(some):
                out[low:high] = SLACK * np.quantile(some, FLOOR)
            low = high
    return out


@dataclass
class Model:
    langs: list[str]
    of: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # by language and power of two of the number of n-grams

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts) * self.idf
        return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, out = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        due = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for at in range(0, len(due), 128):
            part = due[at : at + 128]
            if not self.langs:
                for i in part:
                    out[i] = False
                continue
            counts = np.array([grams(texts[i]) for i in part], np.float32)
            sims = self.vectors(counts) @ self.centroids.T
            best = sims.argmax(axis=1)
            for i, c, s, scale in zip(part, best, sims.max(axis=1), scales(counts)):
                lang = self.of[c]
                langs[i], scores[i], out[i] = self.langs[lang], float(min(max(s, 0), 1)), bool(s < self.floors[lang, scale])
        return langs, scores, out


def _counts(frames):
    for f in frames:
        for at in range(0, len(f), 256):
            part = f.iloc[at : at + 256]
            yield pd.DataFrame({"lang": part["lang"], "v": [grams(t).astype("<f4").tobytes() for t in part["text"]]})


def _frequencies(frames):
    total, n = np.zeros(DIM, np.int64), 0
    for f in frames:
        for v in f["v"]:
            total += np.frombuffer(v, "<f4") > 0
            n += 1
    yield pd.DataFrame({"df": [total.tobytes()], "n": [n]})


def _fit_one(idf: np.ndarray, centroids: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("v")  # so that the seeds do not depend on the order of arrival
        counts = np.stack([np.frombuffer(v, "<f4") for v in f["v"]])
        x = np.sqrt(counts) * idf
        x = (x / np.maximum(np.sqrt((x**2).sum(axis=1)), 1e-12)[:, None]).astype(np.float64)
        c = spherical_kmeans(x, centroids)
        own = floors(scales(counts), (x @ c.T).max(axis=1)).astype("<f8").tobytes()
        return pd.DataFrame({"lang": f["lang"].iloc[0], "c": [r.astype("<f4").tobytes() for r in c], "floors": own})

    return run


def fit(docs: DataFrame, train: Column | None = None, text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, centroids: int = CENTROIDS) -> Model:
    """Learn from the rows where ``train`` holds."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (train if train is not None else F.lit(True)))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang)).count().collect()}  # one row for each label
    if not counts:
        return Model([], np.zeros(0, int), np.zeros((0, DIM), np.float32), np.ones(DIM, np.float32), np.zeros((0, SCALES)))
    scale = 1 << 30
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, int(scale * per_lang / n)))]), F.col(lang))
    sample = rows.where(F.pmod(F.xxhash64(F.col(text), F.lit("fit")), F.lit(scale)) < rate)
    vectors = stage(sample.select(F.col(lang).alias("lang"), F.col(text).alias("text")).distinct().mapInPandas(_counts, "lang string, v binary"), "langfit")
    parts = vectors.coalesce(FIT_TASKS).mapInPandas(_frequencies, "df binary, n long").collect()
    df, n = sum(np.frombuffer(p["df"], np.int64) for p in parts), sum(p["n"] for p in parts)
    idf = np.log1p(n / (1.0 + df)).astype(np.float32)
    got = vectors.groupBy("lang").applyInPandas(_fit_one(idf, centroids), "lang string, c binary, floors binary").collect()
    got.sort(key=lambda r: (r["lang"], r["c"]))
    langs = sorted({r["lang"] for r in got})
    lows = {r["lang"]: np.frombuffer(r["floors"], "<f8") for r in got}
    return Model(langs, np.array([langs.index(r["lang"]) for r in got], int), np.array([np.frombuffer(r["c"], "<f4") for r in got], np.float32).reshape(-1, DIM), idf, np.array([lows[x] for x in langs]).reshape(-1, SCALES))


def predict(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` plus ``into``: struct of lang, score and rejected; a column of ``docs`` already called ``into`` is an error."""
    unclaimed(docs, into)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids: CENTROIDS rows of 32 kB for each label

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score, rejected = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    return docs.withColumn(into, run(F.col(text)))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    held = crc_fold("doc_id", 4) == 2
    got = predict(docs.select("doc_id", "text"), fit(docs, ~held), into="_lang")
    return got.select("doc_id", held.alias("held_out"), F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"), F.col("_lang.rejected").alias("rejected"))
