"""Problem 9: abusive, hateful and sexual content, by multiple-instance learning.

A document is a bag of sentences. Each sentence has a score for each category from hashed features of its
words as they read once disguises are undone; the document's score is the noisy-or of its sentences, and the
weights are trained from document labels through it. The same scores then point out the sentences.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("abusive", "hateful", "sexual")
#: Labelled documents the model is fitted on, at most (those with the least hash of their id).
FIT_ROWS = 12_000
SLOTS = 1 << 17
EPOCHS = 90
#: Shares of labels that raters get wrong (yes for no, no for yes), which the training allows for instead of learning them by
#: heart: what is assumed where no document has several raters, and how many labels that assumption weighs.
WRONG_YES, WRONG_NO, WEIGHT = 0.02, 0.05, 200

#: Letters of other alphabets that look like Latin ones, and digits and signs used for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмнтвзϲοαερικντυ", "aeopcyxijsdhkmhtb3coaepiktvu"))
DIGITS = dict(zip("0134578@$", "oieastbas"))

_TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]*+>")
#: What looks like a tag or comment of more characters may be text between two signs: it is read as sentences of its own.
LONG_TAG = 200
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_SPELLED = re.compile(r"(?<![^\W_])([^\W\d_](?:(?:[ .·_\-*]| )[^\W\d_]){2,})(?![^\W_])")
_STARRED = re.compile(r"(?<!\w)([^\W\d_])(\*{2,})([^\W\d_])(?!\w)")
_TOKEN = re.compile(r"[^\W_]+\*[^\W_]+\d*|[^\W_]+|[@$]")
_MIXED = re.compile(r"(?<![^\W_])(?=[\w@$]*[^\W\d_])(?=[\w@$]*[\d@$])[\w@$]{3,}")
_END = re.compile(r"[.!?…]+(?=\s|$|[\"'”»])|\n+|;")
_RUN = re.compile(r"(.)\1+")
_LOOK = str.maketrans(LOOKALIKES)
_LEET = str.maketrans(DIGITS)


def _without_markup(text: str) -> str:
    """Tags and comments of any length taken out of the running text; the inside of long ones follows on lines of its own."""
    inside, out, at = [], [], 0
    while (lo := text.find("<!--", at)) >= 0 and (hi := text.find("-->", lo + 4)) >= 0:
        out.append(text[at:lo])
        if hi - lo > LONG_TAG:
            inside.append(text[lo + 4 : hi])
        at = hi + 3
    text = " ".join([*out, text[at:]])
    inside += [m[0][1:-1] for m in _TAG.finditer(text) if len(m[0]) > LONG_TAG]
    return "\n".join([_TAG.sub(" ", text), *inside])


def readable(text: str) -> str:
    """The text in lower case with markup, accents, invisible signs and disguised spellings undone."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _without_markup(text)
    text = _INVISIBLE.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c)).casefold().translate(_LOOK)
    else:
        text = text.lower()
    # letters set apart by single blanks or points are one word; wider gaps part the words
    text = _SPELLED.sub(lambda m: re.sub(r"[ .·_\-* ]", "", m[1]), text)
    text = _STARRED.sub(lambda m: f"{m[1]}*{m[3]}{len(m[2]) + 2}", text)
    return _MIXED.sub(lambda m: m[0] if m[0][:-1].isdigit() else m[0].translate(_LEET), text)


def sentences(text: str | None) -> list[str]:
    """Sentences of the readable text; none of a null, empty or blank one."""
    if not text:
        return []
    return [s for s in (p.strip() for p in _END.split(readable(text))) if s]


def _words(sentence: str) -> list[str]:
    return _TOKEN.findall(sentence)


def features(sentence: str) -> np.ndarray:
    """Slots of the sentence's words, pairs, gapped pairs, outlines (first letter, length, last letter) and word beginnings."""
    out = set()
    plain = []
    for w in _words(sentence):
        if "*" in w:
            out.add("o" + w)
            plain.append("*")
        elif w.isdigit():
            plain.append("0")
        else:
            if len(w) >= 4:
                if len(w) <= 12:
                    out.add(f"o{w[0]}*{w[-1]}{len(w)}")
                out.add("b" + _RUN.sub(r"\1", w)[:5])
            plain.append(_RUN.sub(r"\1", w))
    for i, w in enumerate(plain):
        out.add(w)
        if i + 1 < len(plain):
            out.add(f"{w} {plain[i + 1]}")
        if i + 2 < len(plain):
            out.add(f"{w} _ {plain[i + 2]}")
            out.add(f"{w} {plain[i + 1]} {plain[i + 2]}")
    return np.array([zlib.crc32(f.encode("utf-8", "replace")) & (SLOTS - 1) for f in out], dtype=np.int32)


class NoisyOr:
    """Sentence logits from hashed features; documents by noisy-or. ``weights`` is (SLOTS, 3), ``bias`` (3,)."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def sentence_scores(self, sentence: str) -> np.ndarray:
        f = features(sentence)
        z = self.bias + (self.weights[f].sum(axis=0) / np.sqrt(len(f)) if len(f) else 0)
        return 1 / (1 + np.exp(-z))

    @classmethod
    def fit(cls, texts: list[str | None], labels: np.ndarray, wrong: np.ndarray | None = None, epochs: int = EPOCHS, rate: float = 0.15, decay: float = 8e-6) -> NoisyOr:
        """Adam on the noisy-or's log loss. ``labels`` are (n, 3) in 0..1, NaN where unknown; ``wrong`` (2, 3) the raters' errors."""
        wrong_yes, wrong_no = np.array([[WRONG_YES] * 3, [WRONG_NO] * 3]) if wrong is None else wrong
        slot, sent, owner, scale = [], [], [], []
        n_sent = 0
        for d, t in enumerate(texts):
            for s in sentences(t):
                f = features(s)
                if len(f):
                    slot.append(f)
                    sent.append(np.full(len(f), n_sent, np.int32))
                    scale.append(1 / np.sqrt(len(f)))
                    owner.append(d)
                    n_sent += 1
        weights, bias = np.zeros((SLOTS, 3), np.float64), np.full(3, -3.0)
        if not n_sent:
            return cls(weights.astype(np.float32), bias)
        slot, sent, owner, scale = np.concatenate(slot), np.concatenate(sent), np.array(owner), np.array(scale)
        used, place = np.unique(slot, return_inverse=True)
        known = ~np.isnan(labels)
        y = np.nan_to_num(labels)
        n_docs = len(texts)
        w = np.zeros((len(used), 3))
        m, v = np.zeros((len(used) + 1, 3)), np.zeros((len(used) + 1, 3))
        per = scale[sent]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(sent)) + 1])
        for epoch in range(1, epochs + 1):
            z = np.add.reduceat(w[place] * per[:, None], starts, axis=0) + bias
            p = 1 / (1 + np.exp(-z))
            log_none = np.stack([np.bincount(owner, np.log1p(-np.minimum(p[:, c], 1 - 1e-9)), n_docs) for c in range(3)], axis=1)
            whole = np.clip(-np.expm1(log_none), 1e-9, 1 - 1e-9)
            # the label is seen through the raters' errors: P' = wrong_yes + (1 - wrong_yes - wrong_no) * P
            k = 1 - wrong_yes - wrong_no
            seen = wrong_yes + k * whole
            g_doc = np.where(known, k * (1 - whole) * ((1 - y) / (1 - seen) - y / seen), 0.0)
            g_z = g_doc[owner] * p
            g_w = np.stack([np.bincount(place, g_z[sent, c] * per, len(used)) for c in range(3)], axis=1) / n_docs + decay * w
            g = np.vstack([g_w, g_z.sum(axis=0) / n_docs])
            m = 0.9 * m + 0.1 * g
            v = 0.98 * v + 0.02 * g * g
            step = rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.98**epoch)) + 1e-7)
            w -= step[:-1]
            bias -= step[-1] * 0.3
        weights[used] = w
        return cls(weights.astype(np.float32), bias)


def labelled_texts(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> pd.DataFrame:
    """At most ``rows`` labelled documents with the mean of their raters' labels for each category (null where none)."""
    mean = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.avg(F.when(F.col(c).isin(0, 1), F.col(c).cast("double"))).alias(f"_{c}") for c in CATEGORIES])
    d = documents.select(F.col("doc_id"), F.col("text").alias("_text"))
    return mean.join(d, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas()


def rater_errors(labels: DataFrame) -> np.ndarray:
    """(2, 3): for each category the share of yes labels for documents without it and of no labels for documents with it.

    How often two raters of one document disagree tells how large both shares are, not which of them: with two raters any mix of
    both explains the counts. So their proportion stays as assumed and only their size is estimated, over all pairs of labels of a document; the
    assumption weighs as ``WEIGHT`` pairs. Raters of one document can be wrong together, so disagreement is a lower bound: the
    estimate can raise the assumed shares, not lower them. Only sums leave the cluster.
    """
    out = np.array([[WRONG_YES] * 3, [WRONG_NO] * 3])
    for c, name in enumerate(CATEGORIES):
        good = labels.where(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1))
        per = good.groupBy("doc_id").agg(F.sum(name).cast("double").alias("k"), F.count("*").cast("double").alias("m"))
        r = per.agg(F.sum("k").alias("k"), F.sum("m").alias("m"), F.sum(F.col("k") * (F.col("m") - F.col("k"))).alias("d"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs")).first()
        if not r["pairs"]:
            continue

        def disagreement(f: float, mean: float = r["k"] / r["m"]) -> float:
            yes, no = f * WRONG_YES, f * WRONG_NO
            share = np.clip((mean - yes) / max(1 - yes - no, 1e-9), 0, 1)
            return 2 * (share * no * (1 - no) + (1 - share) * yes * (1 - yes))

        seen = (r["d"] + WEIGHT * disagreement(1.0)) / (r["pairs"] + WEIGHT)
        lo, hi = 0.0, 0.45 / max(WRONG_YES, WRONG_NO)
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if disagreement(mid) < seen else (lo, mid)
        out[:, c] *= max(1.0, lo)
    return out


def fitted(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> NoisyOr:
    f = labelled_texts(documents, labels, rows)
    return NoisyOr.fit(list(f["_text"]), f[[f"_{c}" for c in CATEGORIES]].to_numpy(float).reshape(-1, 3), rater_errors(labels))


def scored(documents: DataFrame, model: NoisyOr) -> DataFrame:
    """Every document: ``doc_id``, ``source``, a score for each category, and ``worst_<category>``: the sentence with the highest.

    Null, empty and blank texts score 0 and have no sentence. Whole texts, one narrow pass; the model sent along has a fixed size.
    """
    weights, bias = model.weights, model.bias

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = NoisyOr(weights, bias), {}
        for f in frames:
            rows = []
            for t in f["_text"]:
                none, best, worst = np.ones(3), np.zeros(3), [None] * 3
                for s in sentences(t):
                    p = known.get(s)
                    if p is None:
                        if len(known) > 100_000:
                            known.clear()
                        p = known[s] = model.sentence_scores(s)
                    none = none * (1 - p)
                    for c in range(3):
                        if p[c] > best[c]:
                            best[c], worst[c] = p[c], s
                rows.append((*(1 - none), *worst))
            names = [*CATEGORIES, *(f"worst_{c}" for c in CATEGORIES)]
            yield pd.concat([f[["doc_id", "source"]], pd.DataFrame(rows, columns=names, index=f.index)], axis=1)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", " + ", ".join(f"worst_{c} string" for c in CATEGORIES)
    return documents.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").alias("_text")).mapInPandas(run, schema)


def flagged(scores: DataFrame, threshold: float = 0.38) -> DataFrame:
    """(``doc_id``, ``category``), a row for each category whose score reaches the threshold."""
    each = F.array(*[F.when(F.col(c) >= threshold, F.lit(c)) for c in CATEGORIES])
    return scores.select("doc_id", F.explode(F.array_compact(each)).alias("category")).distinct()


def source_rates(scores: DataFrame, threshold: float = 0.38) -> DataFrame:
    """For each source: documents, and the share flagged in each category. Null sources are counted as ``(none)``."""
    rate = [F.round(F.avg((F.col(c) >= threshold).cast("double")), 6).alias(f"{c}_rate") for c in CATEGORIES]
    return scores.groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count("*").alias("n_docs"), *rate)
