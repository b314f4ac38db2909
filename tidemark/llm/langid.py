"""Language identification in two levels: the language family first, then one-versus-one linear support vector machines within it.

Features are hashed byte 1- to 3-grams of the lower-cased text: shares of each
gram under square root, of unit length. The machines are trained by dual
coordinate descent on a bounded sample of labelled rows, each machine in a task
of its own; predictions read whole texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrowio import slices
from tidemark.llm.files import each_item

WIDTH, EPOCHS, COST = 4096, 12, 4.0
#: The sample: rows of a language, rows in all (their vectors are 16 KB each on the driver), languages. With many
#: languages each has fewer rows, MOST_ROWS / MOST_LANGS at least; beyond MOST_LANGS the rarest labels do not teach.
SAMPLE_PER_LANG, MOST_ROWS, MOST_LANGS = 500, 4000, 1000
#: Texts whose score is lower fit no learned language; clean prose scores about 0.5 and more.
MIN_SCORE = 0.2
UNKNOWN = "und"
#: Families of closely related languages by ISO 639-1 code; a language in none of them is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv", "celtic": "br cy ga gd", "uralic": "et fi hu", "turkic": "az kk ky tr tt ug uz",
    "iranian": "fa ku ps tg", "indic": "as bn gu hi mr ne or pa sa si ur", "dravidian": "kn ml ta te",
    "semitic": "am ar he mt", "malayic": "id jv ms su", "sinitic": "zh", "japonic": "ja", "koreanic": "ko",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang, f"own:{lang}")


def _grams(raw: bytes) -> np.ndarray:
    """Counts of hashed byte 1- to 3-grams, in pieces of a megabyte that overlap by two bytes."""
    out = np.zeros(WIDTH, dtype=np.int64)
    for i in range(0, len(raw), 1 << 20):
        b = np.frombuffer(raw[i:i + (1 << 20) + 2], dtype=np.uint8).astype(np.uint32)
        n = min(1 << 20, len(raw) - i)
        out += np.bincount(b[:n] * np.uint32(2654435761) >> np.uint32(20), minlength=WIDTH)
        two = b[:-1] << np.uint32(8) | b[1:]
        out += np.bincount(((two + np.uint32(77)) * np.uint32(2246822519) >> np.uint32(20))[:n], minlength=WIDTH)
        if len(b) > 2:
            three = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
            out += np.bincount(((three + np.uint32(1234567)) * np.uint32(3266489917) >> np.uint32(20))[:n], minlength=WIDTH)
    return out


def features(text: str | None) -> np.ndarray | None:
    """The text's feature vector, or None if it is null or has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    x = np.sqrt(_grams(text.lower().encode("utf-8", "replace")).astype(np.float32))
    return x / np.sqrt(np.dot(x, x))


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights of a linear machine for y = +1 or -1 by dual coordinate descent with squared hinge loss; classes weigh the same."""
    w, alpha = np.zeros(x.shape[1], dtype=np.float64), np.zeros(len(y))
    each = {v: cost * len(y) / (2 * max(1, np.sum(y == v))) for v in (1, -1)}
    soft = np.array([1 / (2 * each[v]) for v in y])
    norm = np.einsum("ij,ij->i", x, x) + soft
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            step = max(alpha[i] - (y[i] * np.dot(w, x[i]) - 1 + soft[i] * alpha[i]) / norm[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


class Model:
    """Family machines (one against the rest) and, in each family, a machine for each pair of languages.

    weights: a row a machine, the bias last, in the order of machines().
    """

    def __init__(self, langs: set[str], weights: np.ndarray):
        self.langs, self.weights = sorted(langs), weights
        self.families, self.members, self.pairs = _levels(self.langs)
        first = len(self.families) if len(self.families) > 1 else 0
        self.places: dict[str, list[tuple[int, str, str]]] = defaultdict(list)
        for k, (a, b) in enumerate(self.pairs):
            self.places[family(a)].append((first + k, a, b))
        self.first = first

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) of each row of features; the score is the family's times the vote's confidence, 0 to 1.

        Ties: the family first by name, then the language of most votes, then
        of most trust, then last by name.
        """
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1] if len(self.weights) else np.zeros((len(x), 0))
        sure = 1 / (1 + np.exp(-np.clip(4 * margins, -30, 30)))
        out = []
        for row in sure:
            k = int(np.argmax(row[:self.first])) if self.first else 0
            name, score = self.families[k], float(row[k]) if self.first else 1.0
            if len(self.members[name]) > 1:
                votes, trust = defaultdict(int), defaultdict(float)
                for i, a, b in self.places[name]:
                    p = float(row[i])
                    votes[a if p >= 0.5 else b] += 1
                    trust[a] += p
                    trust[b] += 1 - p
                best = max(self.members[name], key=lambda c: (votes[c], trust[c], c))
                out.append((best, score * trust[best] / (len(self.members[name]) - 1)))
            else:
                out.append((self.members[name][0], score))
        return out


def _levels(langs: list[str]) -> tuple[list[str], dict[str, list[str]], list[tuple[str, str]]]:
    """(families, members of each, pairs to tell apart) of sorted languages."""
    families = sorted({family(c) for c in langs})
    members = {f: [c for c in langs if family(c) == f] for f in families}
    return families, members, [(a, b) for f in families for a, b in combinations(members[f], 2)]


def machines(langs: list[str]) -> list[tuple[str, ...]]:
    """What is trained: (family,) against the rest where there are two or more, then (language, language)."""
    families, _, pairs = _levels(langs)
    return [(f,) for f in families if len(families) > 1] + pairs


def train(x: np.ndarray, labels: np.ndarray, machine: tuple[str, ...]) -> np.ndarray:
    """Weights of one machine, bias last, from rows of features and their languages."""
    if len(machine) == 1:
        some, y = slice(None), np.where(np.array([family(c) for c in labels]) == machine[0], 1, -1)
    else:
        some = np.isin(labels, machine)
        y = np.where(labels[some] == machine[0], 1, -1)
    own = x[some]
    return train_svm(np.concatenate([own, np.ones((len(own), 1), dtype=own.dtype)], axis=1), y).astype(np.float32)


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """(lang, h, text): the rows that teach. Only rows with a label and a letter are counted and taken, equal ones once.

    Of each language those with the smallest hashes of id and text. What is
    read of a language is about twice its sample, by hash, so neither a hot
    language nor a hot id is gathered.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11)).alias("h"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGS).collect()
    each = min(per_lang, MOST_ROWS // max(1, len(counts)))
    shares = spark.createDataFrame([(r.lang, min(1.0, 2 * each / r["count"])) for r in counts], "l string, share double")  # MOST_LANGS rows at most
    place = F.shiftrightunsigned("h", 12) / F.lit(2.0**52)
    some = rows.join(F.broadcast(shares), (F.col("lang") == F.col("l")) & (place < F.col("share"))).drop("l", "share")
    few = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each)
    return few.dropDuplicates(["lang", "h"]).drop("k")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """Train on a bounded sample of labelled rows; None if no row teaches.

    What reaches the driver is a vector of WIDTH numbers for each sampled row,
    MOST_ROWS at most; machines are trained by tasks and come back as a vector
    each. Any labels will do: a language with one row teaches too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, hashes, texts in slices(batches):
            got = [(c, h, v.astype("<f4").tobytes()) for c, h, t in zip(langs, hashes, texts) if (v := features(t)) is not None]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.int64(), pa.binary()))], names=["lang", "h", "v"])

    spark = labelled.sparkSession
    taught = sample(labelled, id_col, text_col, lang_col, per_lang).mapInArrow(run, "lang string, h long, v binary").toArrow()
    if not taught.num_rows:
        return None
    langs = np.array(taught["lang"].to_pylist(), dtype=object)
    order = np.lexsort((taught["h"].to_numpy(), langs))
    x = np.empty((len(langs), WIDTH), dtype=np.float32)
    for k, i in enumerate(order.tolist()):
        x[k] = np.frombuffer(taught["v"][i].as_buffer(), dtype="<f4")
    del taught
    langs = langs[order].astype(str)
    known = sorted(set(langs.tolist()))
    todo = machines(known)
    held = spark.sparkContext.broadcast((x, langs))

    def learn(item: tuple[int, tuple[str, ...]]) -> Iterator[pa.RecordBatch]:
        w = train(*held.value, item[1])
        yield pa.RecordBatch.from_arrays([pa.array([item[0]], pa.int32()), pa.array([w.tobytes()], pa.binary())], names=["k", "w"])

    weights = np.zeros((len(todo), WIDTH + 1), dtype=np.float32)
    if todo:
        for r in each_item(spark, list(enumerate(todo)), learn, "k int, w binary").collect():
            weights[r.k] = np.frombuffer(r.w, dtype=np.float32)
    held.destroy()
    return Model(set(known), weights)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept out of training: crc32 of its id as text, modulo 3, is 1 (a null id: that of an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text where nothing could be learned. A null id is kept, repeated rows give
    repeated results, other columns are ignored, an empty table gives an empty
    result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for ids, texts in slices(batches):
            vectors = [features(t) if m else None for t in texts]
            some = [v for v in vectors if v is not None]
            found = iter(m.predict(np.array(some)) if some else [])
            said = [next(found) if v is not None else (UNKNOWN, 0.0) for v in vectors]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x[0] for x in said]), pa.array([min(1.0, max(0.0, x[1])) for x in said], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = MIN_SCORE) -> DataFrame:
    """docs without those that fit no learned language: ``und``, or a score below ``least``.

    Null texts and texts without a letter always go. Where no row is labelled
    nothing can be learned, and every text with a letter stays. Null ids and
    repeated rows are decided like others, an empty table gives an empty
    result, clashing columns stay. Decided in the scan of docs, so no text is
    shuffled. Columns are those of docs.
    """
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    if model is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        m, out = held.value, []
        for i in range(0, len(texts), 256):
            vectors = [features(t) if isinstance(t, str) else None for t in texts.iloc[i:i + 256]]
            some = [v for v in vectors if v is not None]
            found = iter(m.predict(np.array(some)) if some else [])
            out += [next(found)[1] if v is not None else -1.0 for v in vectors]
        return pd.Series(out, dtype="float64")

    return docs.where(score(F.col(text_col)) >= least)
