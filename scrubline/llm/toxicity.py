"""Toxicity: noisy-channel deobfuscation, then scores of the restored text.

A writer hides a word by look-alikes (1d10t), by spacing (i d i o t, i.d.i.o.t) or by repetition
(idiooot). Spans that look so become lattices of what each character may stand for, with a cost
for each reading, and the Viterbi path under a character trigram model gives the restored text.
The model's counts come from all documents.

Words of restored labelled texts, and their beginnings, get log odds between toxic and other texts, drawn
two standard errors towards zero; those that aren't by chance are the model. A text's evidence is the sum of
its words' log odds, over the root of how many words it has (as chance makes sums grow), and its strongest
word. A logistic curve fitted to labelled texts turns both into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, mapped, staged, text_of, without
from .pretokens import Memo

#: Labelled rows that the classifier is fitted on: all up to so many, else those with the least hash of their number.
TRAINING_ROWS = 20_000
#: A feature is in the model if its likelihood ratio statistic is over 2 ln(features tested) + MARGIN: of that many, chance
#: alone brings e^(-MARGIN / 2) in. The margin is for families of near copies, which give all their words some.
MARGIN = 10.0
#: The log odds from which a word can be a text's strongest.
STRONG = 2.5
BEGINNINGS = (4, 5, 6)
MEMO_PIECES = 100_000

# What a character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"

SYMBOLS = len(LETTERS) + 1  # 0 is what stands between words
INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_CODES = np.zeros(0x250, dtype=np.int64)
for _c, _i in INDEX.items():
    _CODES[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x250:
        _CODES[ord(_c.upper())] = _i

_LETTER = r"[^\W\d_]"
#: A piece with look-alikes beside letters, letters between dots, or a letter three times.
HIDDEN = re.compile(rf"{_LETTER}[0-9@$!|+]+{_LETTER}|^[0-9@$!|+]+{_LETTER}{{2}}|{_LETTER}{{2}}[0-9]$|(?:(?<!\w)\w[._*\-]){{3,}}|({_LETTER})\1\1", re.I)
#: Single characters with something between them, four at least.
SPACED = re.compile(r"(?<!\S)(?:[^\W_][ ._*\-]+){3,}[^\W_](?![^\W_])")
_TAIL = re.compile(r"[^\w]+$")
_WORD = re.compile(rf"{_LETTER}+")


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of letter trigrams, flat; before a word's first letter stand two gaps."""
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for text in texts:
        chars = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = np.where(chars < 0x250, _CODES[np.minimum(chars, 0x24F)], 0)
        a, b, d = c[:-2], c[1:-1], c[2:]
        first = np.concatenate([[0], np.where(b == 0, 0, a)]) if len(c) > 1 else np.empty(0, np.int64)
        codes = (first[1:] * SYMBOLS + b) * SYMBOLS + d
        codes = codes[(b > 0) | (d > 0)]
        # the text's own first letter has no trigram with two before it
        if len(c) > 1 and c[1]:
            codes = np.append(codes, c[1])
        total += np.bincount(codes, minlength=SYMBOLS**3)
    return total


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            total += trigram_counts(batch.column(0)[k : k + 256].to_pylist())
    code = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"code": pa.array(code, pa.int32()), "n": pa.array(total[code], pa.int64())})


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(letter | two before), SYMBOLS x SYMBOLS x SYMBOLS, from all texts (at most SYMBOLS**3 counts reach the driver)."""
    rows = mapped(docs.select(text_of().alias("text")), _count_trigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for r in rows:
        counts[r["code"]] = r["n"]
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    # two letters before, backed off to one, backed off to none
    one = counts.sum(axis=(0, 1)) + 1
    two = counts.sum(axis=0) + 5 * one / one.sum()
    two = two / two.sum(axis=1, keepdims=True)
    three = counts + 5 * two[None, :, :]
    return np.log(three / three.sum(axis=2, keepdims=True)).astype(np.float32)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each step of a span its readings with their log costs; a blank is a gap between words, nothing a deletion."""
    steps, i = [], 0
    low = span.lower()
    while i < len(low):
        c, run = low[i], 1
        while i + run < len(low) and low[i + run] == c:
            run += 1
        if c in INDEX:
            if run < 3:
                steps += [[(c, 0.0)]] * run
            else:
                steps.append([(c, -0.3), (c * 2, -0.6), (c * 3, -6.0)])
        elif c in LOOKALIKES:
            steps += [[(x, -0.7) for x in LOOKALIKES[c]] + [(" ", -8.0)]] * min(run, 3)
        else:
            steps.append([("", -0.3), (" ", -3.0)])
        i += run
    return steps


def viterbi(span: str, model: np.ndarray) -> str:
    """The likeliest reading of a span."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for step in lattice(span):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in best.items():
            for reading, cost in step:
                x, y, s = a, b, score + cost
                for c in reading:
                    k = INDEX.get(c, 0)
                    if k or y:
                        s += float(model[x, y, k])
                    x, y = (y, k) if k else (0, 0)
                if (x, y) not in new or new[x, y][0] < s:
                    new[x, y] = (s, (path, reading) if reading else path)
        best = new
    ends = [(s + (float(model[a, b, 0]) if b else 0.0), p) for (a, b), (s, p) in best.items()]
    path, out = max(ends, key=lambda e: e[0])[1], []
    while path:
        path, reading = path
        out.append(reading)
    return "".join(reversed(out)).strip()


class Restorer:
    """Restores texts and pieces of text under a character model."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def piece(self, piece: str) -> str:
        bare = _TAIL.sub("", piece)
        return viterbi(bare, self.model) + piece[len(bare) :] if HIDDEN.search(bare) else piece

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Spaced words with their places; one has four characters or more."""
        return [(m.start(), m.end(), viterbi(m.group(), self.model)) for m in SPACED.finditer(text)]

    def text(self, text: str) -> str:
        """The whole text restored; white space between pieces stays."""
        for start, end, restored in reversed(self.spans(text)):
            text = text[:start] + restored + text[end:]
        return re.sub(r"\S+", lambda m: self.piece(m.group()), text)


def features(word: str) -> list[str]:
    """A lower-cased word, marked by a $ behind it, and its beginnings."""
    return [word + "$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def restored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, text) with every text restored; null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Restorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fix.text(t) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return mapped(docs.select("doc_id", text_of().alias("text")), run, "doc_id long, text string")


def _features_of(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Restorer(model)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces = set(text.split()) | {r for _, _, r in fix.spans(text)}
                found = list({f for p in pieces for w in words_of(fix.piece(p)) for f in features(w)})
                yield pa.RecordBatch.from_pydict({"feature": pa.array(found, pa.string()), "y": pa.array([y] * len(found), pa.int32())})

    return run


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(text, y) of at most ``rows`` labelled rows outside the held-out fifth; equal texts once, toxic if any is."""
    told = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 <> 0")
    keep = staged(told.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "told")
    pairs = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(keep), "doc_id")
    return pairs.groupBy("text").agg(F.max("y").alias("y"))


#: The evidence of most words, made once.
NOTHING = (0.0, 0.0)


class Scorer:
    """The evidence of a text, from weights of features; remembers pieces."""

    def __init__(self, model: np.ndarray, weights: dict[str, float]):
        self.fix, self.weights, self.memo = Restorer(model), weights, Memo(MEMO_PIECES)
        self.starts = {f.removesuffix("$")[: BEGINNINGS[0]] for f in weights}

    def of_words(self, text: str) -> tuple[float, float]:
        """(strongest, sum) over words of restored text; a word counts by the feature that is farthest from zero."""
        words = [w for w in words_of(text) if w[: BEGINNINGS[0]] in self.starts]
        if not words:
            return NOTHING
        get, top, total = self.weights.get, 0.0, 0.0
        for word in words:
            best = get(word + "$", 0.0)
            for n in BEGINNINGS:
                if len(word) >= n and abs(w := get(word[:n], 0.0)) > abs(best):
                    best = w
            total += best
            top = max(top, best)
        return (top if top >= STRONG else 0.0), total

    def evidence(self, text: str) -> tuple[float, float]:
        """(strongest word, sum over distinct pieces by the root of their number)."""
        pieces = set(text.split())
        if not pieces:
            return NOTHING
        for p in self.memo.wanted(pieces):
            self.memo[p] = self.of_words(self.fix.piece(p))
        tops, sums = zip(*map(self.memo.__getitem__, pieces), strict=True)
        top, total = max(tops), sum(sums)
        for _, _, r in self.fix.spans(text):
            t, s = self.of_words(r)
            top, total = max(top, t), total + s
        return top, total / math.sqrt(len(pieces))


def _curve(points: list[tuple[float, float, int, float]]) -> tuple[float, ...]:
    """Intercept and slopes of a logistic curve through (strongest, sum, label, how many), with a little ridge."""
    top, total, y, n = (np.array(c, dtype=float) for c in zip(*points, strict=True))
    z = np.stack([np.ones_like(top), top, total], axis=1)

    def loss(beta: np.ndarray) -> float:
        m = z @ beta
        return float((n * (np.logaddexp(0, m) - y * m)).sum() + 0.05 * (beta**2).sum())

    beta = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(z @ beta)))
        slope = z.T @ (n * (y - p)) - 0.1 * beta
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(3), slope)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def probability(evidence: tuple[float, float], curve: tuple[float, ...]) -> float:
    at = curve[0] + curve[1] * evidence[0] + curve[2] * evidence[1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, at))))


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float], tuple[float, ...]]:
    """The character model, the features' weights, and the curve. Without both labels among the rows, no feature has weight."""
    model = character_model(docs)
    train = staged(training_rows(docs, labels), "training").repartition(32)
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    ill, fine = sizes.get(1, 0), sizes.get(0, 0)
    if not ill or not fine:
        return model, {}, (math.log((ill + 0.5) / (fine + 0.5)) if ill + fine else -2.0, 0.0, 0.0)
    by = mapped(train, _features_of(model), "feature string, y int").groupBy("feature").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("n"))
    by = staged(by, "features")
    odds = F.log((F.col("t") + 0.5) / (ill + 1)) - F.log((F.col("n") + 0.5) / (fine + 1))
    error = 2 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") + 0.5))
    weight = F.signum(odds) * F.greatest(F.abs(odds) - error, F.lit(0.0))
    # 2 sum O ln(O/E) over the two classes of texts with the feature
    share, seen = ill / (ill + fine), F.col("t") + F.col("n")
    part = lambda c, s: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (seen * s))).otherwise(0.0)
    least = 2 * math.log(max(1, by.count())) + MARGIN
    strong = by.where(2 * (part("t", share) + part("n", 1 - share)) >= least).select("feature", weight.alias("w")).where("w <> 0")
    weights = {r["feature"]: r["w"] for r in strong.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model, weights)
        for batch in batches:
            found = [[round(x, 1) for x in score.evidence(t)] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)), batch.column(1)], ["top", "total", "y"])

    points = mapped(train, run, "top double, total double, y int").groupBy("top", "total", "y").count().collect()
    return model, weights, _curve([(r["top"], r["total"], r["y"], r["count"]) for r in points])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null and empty texts get the score of no evidence. ``labels`` (doc_id, toxic) teaches with rows whose
    crc32(doc_id as text) mod 5 is not 0, TRAINING_ROWS of them at most; null labels teach nothing, of several
    for one doc_id the largest counts. held_out of a null doc_id is false. Equal rows stay apart, rows with null or
    repeated doc_ids too; other columns are ignored; an empty table gives an empty table.
    """
    model, weights, curve = fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model, weights)
        for batch in batches:
            found = [probability(score.evidence(t), curve) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = mapped(docs.select("doc_id", text_of().alias("text")), run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(F.expr("crc32(CAST(doc_id AS STRING)) % 5 = 0"), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without the rows whose text scores 0.5 or more; all columns pass, whatever their names (but those that begin with two underscores).

    Each row is judged by its own text (told by 128 bits of hashes): null and repeated doc_ids don't matter, equal rows
    go or stay together. Null and empty texts score as without evidence; an empty table gives an empty table.
    """
    model, weights, curve = fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model, weights)
        for batch in batches:
            yield batch.filter(pa.array([probability(score.evidence(t), curve) >= 0.5 for t in batch.column(2).to_pylist()], pa.bool_())).select(["a", "b"])

    keys = {"a": F.xxhash64(text_of()), "b": F.xxhash64(text_of(), F.lit(1))}
    judged = docs.select(*[c.alias(k) for k, c in keys.items()], text_of().alias("text"))
    return without(docs, staged(mapped(judged, run, "a long, b long").distinct(), "toxic"), broadcast_rows, **keys)
