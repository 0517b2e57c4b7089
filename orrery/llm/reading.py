"""Reading level of each document: regularised ordinal regression, calibrated to graded text.

Features of the author's own words: lexical diversity, word rarity (over the whole corpus, per language), connectives,
a clause-depth proxy, lengths, and the profile of the vocabulary in graded text.  They are standardised per language
and enter a proportional-odds model with an L2 penalty.  The model is fitted on the driver from at most
``MAX_LABELLED`` labelled documents (a documented bound); counts, features and scores cover every document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.owntext import own_text
from orrery.plans.sizing import BROADCAST_BYTES, measured_bytes, tasks_for
from orrery.plans.staging import stage

LANGS = ("en", "de", "fr", "es")
MAX_LABELLED = 6000
FOLDS = 5
SCALED = 40  #: labels from which a language has a scale of its own
UNIT = 12  #: words of a unit whose vocabulary is graded, where sentences are longer or have no end

#: connectives and subordinators per language: our own choice of common ones, no part of any format
CONNECTIVES = {
    "en": "although because since unless whereas whether while hence therefore thereby thus however moreover insofar notwithstanding albeit whence ergo which whose whom upon that",
    "de": "obwohl weil sofern während wenn dass daher mithin gleichwohl jedoch ungeachtet indem insofern weshalb wodurch deren dessen welche bevor nachdem ohne",
    "fr": "quoique parce puisque lorsque tandis donc partant cependant nonobstant dont lequel laquelle avant afin quand que qui bien",
    "es": "aunque porque cuando mientras luego empero obstante cuya cuyo cual antes sino pues que",
}
_WORDS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_ENDS = re.compile(r"[.!?…]+|\n+")
_CONN = {k: frozenset(v.split()) for k, v in CONNECTIVES.items()}
_EVERY = frozenset().union(*_CONN.values())
STYLE = ["log_words", "word_length", "long_words", "very_long", "sentence", "longest", "clauses", "deepest", "connectives", "diversity", "types", "hapax"]
RARITY = ["rarity", "rare", "rare_spread"]
GRADED = ["grade", "g1", "g2", "g3", "g4", "top1", "top2", "top3", "top4", "known"]


def sentences(text: str) -> tuple[str, list[int]]:
    """Lower-case words of a text, a line a sentence with blanks between them, and by sentence the number of commas,
    semicolons and colons.
    """
    lines, marks = [], []
    for s in _ENDS.split(text.lower()):
        w = _WORDS.findall(s)
        if w:
            lines.append(" ".join(w))
            marks.append(s.count(",") + s.count(";") + s.count(":"))
    return "\n".join(lines), marks


def _split(cut: str) -> tuple[list[str], list[int]]:
    """Words of a text cut by :func:`sentences`, and their number by sentence."""
    words: list[str] = []
    sizes = []
    for line in cut.split("\n") if cut else []:
        w = line.split(" ")
        words += w
        sizes.append(len(w))
    return words, sizes


def _types(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Distinct words in order of first use, and the place of each word among them."""
    seen: dict[str, int] = {}
    at = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return list(seen), at


def style(cut: str, marks: list[int], lang: str | None) -> tuple[list[float], list[str]]:
    """Style features of a text cut by :func:`sentences`, and its distinct words; all zero for a text without words."""
    words, sizes = _split(cut)
    if not words:
        return [0.0] * len(STYLE), []
    conn = _CONN.get(lang or "", _EVERY)
    types, at = _types(words)
    n, per = len(words), np.array(sizes)
    of_type = np.fromiter(map(len, types), np.int64, len(types))
    lengths, counts = of_type[at], np.bincount(at)
    linked = np.fromiter((w in conn for w in types), np.int64, len(types))[at]
    depth = np.array(marks) + np.add.reduceat(linked, np.cumsum(per) - per)
    order = np.argsort(at, kind="stable")
    again = np.diff(order)[np.diff(at[order]) == 0]
    fresh = len(types) + int((again > 50).sum())  # words not met among the 50 before
    once = int((counts == 1).sum())
    return [
        math.log(n), float(lengths.mean()), float((lengths >= 8).mean()), float((lengths >= 12).mean()), math.log(per.mean()), math.log(per.max()),
        float(depth.mean()), math.log1p(depth.max()), int(linked.sum()) / n, fresh / n, math.log(len(types)) / math.log(n + 1), once / n,
    ], sorted(types)


def unit_sizes(sizes: list[int]) -> list[int]:
    """Words of each unit: sentences, of which the long ones are cut into units of about UNIT words."""
    out: list[int] = []
    for n in sizes:
        parts = max(1, round(n / UNIT)) if n > 2 * UNIT else 1
        size = -(-n // parts)
        out += [min(size, n - i) for i in range(0, n, size)]
    return out


def graded(cut: str, table: tuple[dict[str, int], np.ndarray] | None) -> list[float]:
    """Profile of a text in a graded vocabulary: mean band, mean and majority share of each band over its units.

    ``table`` holds the place of each word and, by place, the log-odds of the four bands.
    """
    places, odds = table or ({}, np.zeros((1, 4)))
    words, sizes = _split(cut)
    types, at = _types(words)
    place = np.fromiter((places.get(w, -1) for w in types), np.int64, len(types))[at]
    known = place >= 0
    if not known.any():
        return [2.5, 0.25, 0.25, 0.25, 0.25, 0.25, 0.25, 0.25, 0.25, 0.0]
    units = np.array(unit_sizes(sizes))
    own = np.repeat(np.arange(len(units)), units)[known]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    s = np.add.reduceat(odds[place[known]], first, axis=0)
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    w = units[own[first]].astype(float)[:, None]
    w /= w.sum()
    soft = (p * w).sum(0)
    hard = ((p == p.max(1, keepdims=True)) * w).sum(0)
    return [float(soft @ np.arange(1, 5)), *map(float, soft), *map(float, hard), int(known.sum()) / len(words)]


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, parents, langs = (b.column(c).to_pylist() for c in ("text", "parent_text", "lang"))
        cut = [sentences(own_text(t, p)) for t, p in zip(texts, parents)]
        made = [style(*c, g) for c, g in zip(cut, langs)]
        yield pa.record_batch(
            [b.column("doc_id"), b.column("lang"), b.column("n_chars"), pa.array([c[0] for c in cut], pa.string()), pa.array([m[0] for m in made], pa.list_(pa.float64())), pa.array([m[1] for m in made], pa.list_(pa.string()))],
            names=["doc_id", "lang", "n_chars", "own", "style", "types"],
        )


def own_words(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, n_chars, own, style, types) of every document of one of LANGS; own has its words by sentence.

    Only posts that open with a quote lacking an end need their parent's text; they alone are joined with it.
    """
    docs = documents.select("doc_id", "parent_id", "lang", "n_chars", "text")
    loose = F.coalesce(F.col("text").rlike(r'^\s*\[quote="[^"\]]*"\]\r?\n'), F.lit(False))
    parents = docs.select(F.col("doc_id").alias("parent_id"), F.col("text").alias("parent_text"))
    docs = docs.filter(F.col("lang").isin(*LANGS))  # other languages have neither bands nor a share in any frequency used
    need = docs.filter(loose)
    wanted = need.select("parent_id").distinct()
    need = need.join(parents.join(wanted, "parent_id", "left_semi"), "parent_id", "left").select("doc_id", "lang", "n_chars", "text", "parent_text")
    rest = docs.filter(~loose).select("doc_id", "lang", "n_chars", "text", F.lit(None).cast("string").alias("parent_text"))
    return need.unionByName(rest).repartition(tasks_for(documents), "doc_id").mapInArrow(
        _own, "doc_id bigint, lang string, n_chars int, own string, style array<double>, types array<string>"
    )


def rarity(own: DataFrame, eligible: DataFrame) -> DataFrame:
    """(doc_id, rare array<double>): rarity of the words of eligible documents among all documents of their language."""
    words = own.filter("lang IS NOT NULL").select("lang", F.explode("types").alias("word"))
    df = stage(words.groupBy("lang", "word").agg(F.count("*").alias("df")), "frequencies")
    total = own.groupBy("lang").agg(F.count("*").alias("docs"))  # one row a language
    scaled = df.join(F.broadcast(total), "lang").select("lang", "word", (-F.log(F.col("df") / F.col("docs"))).alias("r"))
    if measured_bytes(df) <= BROADCAST_BYTES:
        scaled = F.broadcast(scaled)
    at = eligible.select("doc_id", "lang", F.explode("types").alias("word")).join(scaled, ["lang", "word"])
    return at.groupBy("doc_id").agg(F.array(F.avg("r"), F.avg((F.col("r") > 4).cast("double")), F.coalesce(F.stddev_pop("r"), F.lit(0.0))).alias("rare"))


def grade_tables(rows: pd.DataFrame) -> dict[int, dict[str, tuple[dict[str, int], np.ndarray]]]:
    """Per fold (-1: none) and language: words and their smoothed log-odds of the four bands, from the other folds.

    ``rows`` has lang, word, fold, band, n: documents of a fold and band that hold the word, and '' for all documents.
    """
    out: dict = {}
    for fold in range(-1, FOLDS):
        use = rows[rows["fold"] != fold]
        out[fold] = {}
        for lang, part in use.groupby("lang"):
            p = part.pivot_table(index="word", columns="band", values="n", aggfunc="sum", fill_value=0).reindex(columns=[1, 2, 3, 4], fill_value=0)
            if "" not in p.index:
                continue
            docs = p.loc[""].to_numpy() + 1.0
            p = p.drop("")
            odds = np.log((p.to_numpy() + 0.3) / docs)
            odds -= odds.mean(1, keepdims=True)
            weight = np.minimum(1.0, p.to_numpy().sum(1, keepdims=True) / 4)
            out[fold][lang] = ({w: k for k, w in enumerate(p.index)}, odds * weight)
    return out


class Ordinal:
    """Proportional odds with an L2 penalty, fitted by gradient steps (Adam) in numpy."""

    def __init__(self, bands: int = 4, penalty: float = 1e-3, steps: int = 1500):
        self.bands, self.penalty, self.steps = bands, penalty, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> Ordinal:
        """``y`` holds 1..bands."""
        k = self.bands - 1
        theta = np.zeros(x.shape[1] + k)
        theta[-k:] = [-1.0] + [0.3] * (k - 1)  # first cut, then log steps
        m = v = np.zeros_like(theta)
        for t in range(1, self.steps + 1):
            cuts = np.cumsum(np.append(theta[-k], np.exp(theta[-k + 1 :])))
            f = x @ theta[:-k]
            c = np.concatenate([np.zeros((len(y), 1)), 1 / (1 + np.exp(-np.clip(cuts - f[:, None], -30, 30))), np.ones((len(y), 1))], 1)
            up, lo = c[np.arange(len(y)), y], c[np.arange(len(y)), y - 1]
            p = np.maximum(up - lo, 1e-9)
            gu, gl = up * (1 - up) / p, lo * (1 - lo) / p
            g = np.zeros_like(theta)
            g[:-k] = x.T @ (gu - gl) / len(y) + self.penalty * theta[:-k]
            gc = np.array([-(gu[y == j + 1].sum() - gl[y == j + 2].sum()) / len(y) for j in range(k)])
            g[-k] = gc.sum()
            for j in range(1, k):
                g[-k + j] = gc[j:].sum() * np.exp(theta[-k + j])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weights, self.cuts = theta[:-k], np.cumsum(np.append(theta[-k], np.exp(theta[-k + 1 :])))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The most probable band."""
        c = 1 / (1 + np.exp(-np.clip(self.cuts - (x @ self.weights)[:, None], -30, 30)))
        p = np.diff(np.concatenate([np.zeros((len(x), 1)), c, np.ones((len(x), 1))], 1), axis=1)
        return p.argmax(1) + 1


def _features(batches: Iterator[pa.RecordBatch], tables) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, folds = b.column("lang").to_pylist(), b.column("fold").to_pylist()
        g = [graded(o, tables.value[f].get(l)) for o, l, f in zip(b.column("own").to_pylist(), langs, folds)]
        x = [s + (r or [0.0] * len(RARITY)) + k for s, r, k in zip(b.column("style").to_pylist(), b.column("rare").to_pylist(), g)]
        yield pa.record_batch([b.column("doc_id"), b.column("lang"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "lang", "x"])


def design(x: np.ndarray, lang: np.ndarray, scale: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Features standardised within their language (within all labelled text where a language has no scale)."""
    out = np.zeros_like(x)
    for i, g in enumerate(lang):
        mean, sd = scale.get(g, scale[""])
        out[i] = (x[i] - mean) / sd
    return np.clip(out, -6, 6)


def bands(
    documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, least: int = 300, held_out: bool = False, use: Sequence[str] = (*STYLE, *RARITY, *GRADED)
) -> DataFrame:
    """(doc_id, band int) of every document whose lang is one of LANGS and whose n_chars is at least ``least``.

    Null bands are no labels; several ratings of a document are averaged (a tie goes to the lower band), copies of a
    rating count once.  Features are scaled within their language, within all languages together where one has fewer
    than ``SCALED`` labels.  ``use`` names the features of the regression.  No document to judge gives no rows; documents
    without any usable label are an error, since there is no scale.  ``held_out`` returns instead, for labelled
    documents, (doc_id, band, label, lang) with each fold predicted by a model of the other folds.
    """
    spark = documents.sparkSession
    own = stage(own_words(documents), "own")
    eligible = own.filter(F.col("lang").isin(*LANGS) & (F.col("n_chars") >= least))
    rated = labels.filter("band BETWEEN 1 AND 4").select("doc_id", "rater", "band", "rated_at").distinct().groupBy("doc_id")
    rated = rated.agg(F.ceil(F.avg("band") - 0.5).cast("int").alias("label"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).withColumn("fold", fold)
    rated = stage(rated, "labels")
    rare = rarity(own, eligible)
    base = stage(eligible.join(rare, "doc_id", "left").drop("types", "n_chars"), "features")
    graded_words = eligible.join(rated, "doc_id").select("lang", "fold", F.col("label").alias("band"), F.explode(F.concat("types", F.array(F.lit("")))).alias("word"))
    counts = graded_words.groupBy("lang", "word", "fold", "band").agg(F.count("*").alias("n")).toPandas()  # words of max_labelled texts
    if not len(counts):
        if eligible.isEmpty():
            return eligible.select("doc_id", F.lit(None).cast("int").alias("band"))
        raise ValueError("no usable label: the bands have no scale")
    kept = np.array([k for k, name in enumerate((*STYLE, *RARITY, *GRADED)) if name in use])
    tables = spark.sparkContext.broadcast(grade_tables(counts))
    run = lambda df: df.mapInArrow(lambda it: _features(it, tables), "doc_id bigint, lang string, x array<double>")
    train = base.join(rated, "doc_id")
    sample = run(train.select("doc_id", "lang", "own", "style", "rare", "fold")).join(rated, "doc_id").orderBy("doc_id").toPandas()
    x, y = np.stack(sample["x"].to_list()), sample["label"].to_numpy().astype(int)
    lang, folds = sample["lang"].to_numpy(), sample["fold"].to_numpy()
    scale = {g: (x[lang == g].mean(0), x[lang == g].std(0) + 1e-6) for g in np.unique(lang) if (lang == g).sum() >= SCALED} | {"": (x.mean(0), x.std(0) + 1e-6)}
    z = design(x, lang, scale)[:, kept]
    if held_out:
        got = np.zeros(len(y), int)
        for f in range(FOLDS):
            if (folds == f).any() and (folds != f).any():
                got[folds == f] = Ordinal().fit(z[folds != f], y[folds != f]).predict(z[folds == f])
        return spark.createDataFrame(pd.DataFrame({"doc_id": sample["doc_id"], "band": got, "label": y, "lang": lang}))
    model = Ordinal().fit(z, y)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _features(batches, tables):
            if b.num_rows:
                z = design(np.stack(b.column("x").to_pylist()), np.array(b.column("lang").to_pylist()), scale)[:, kept]
                yield pa.record_batch([b.column("doc_id"), pa.array(model.predict(z).astype(np.int32))], names=["doc_id", "band"])

    return base.select("doc_id", "lang", "own", "style", "rare", F.lit(-1).alias("fold")).mapInArrow(score, "doc_id bigint, band int")
