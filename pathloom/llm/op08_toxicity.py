"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over the words of all documents, of
whatever script. A word that may be disguised becomes a lattice: digits and signs
stand for letters, repeated letters for one or two, signs between letters for
nothing, and letters standing alone in a row for words. Viterbi decoding finds
its likeliest spelling; a plain word with a doubled letter counts as it stands
and as decoded. A logistic regression with an L1 penalty over words and
beginnings of words (weights not negative), fitted on a bounded sample of
labelled rows, scores the restored words. Fitting and scoring restore words by
the same function.

Scoring passes over words that cannot stand for anything the classifier weighs:
those whose first two characters, neither of which can be dropped, don't begin it
in any reading.

Defined results: a null or empty text has no evidence, probability 0 and is not
toxic; repeated rows are scored alike; a probability is rounded before it is held
against the threshold, which it may equal; with no labels of both kinds nothing
is toxic; an empty table gives an empty result. Other columns, whatever their
names, are ignored by score and kept by the filter.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import field, map_batches, materialize, name_of, table

#: Most labelled rows that the classifier is fitted on (those least by hash of id).
SAMPLE_ROWS = 6000
#: Letters, bigrams and trigrams with a lesser share of all share a place, so there are at most 1/SHARE of each.
SHARE = 1e-6
#: Log probabilities and words that a task remembers before it starts afresh.
REMEMBERED = 200_000
PREFIXES = range(3, 9)
L1 = 0.0005
THRESHOLD = 0.5

LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l"}
SUBST, DROP, FOLD, GAP = 1.5, 1.0, 1.5, 4.0
ALONE = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
PLAIN = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"(.)\1*", re.S)
LONG = re.compile(r"(.)\1\1")
DOUBLED = re.compile(r"(.)\1")
STRIPPED = ".,;:?\"'()"


class CharModel:
    """Trigram log probabilities over the letters, place 1 for all others and 0 for
    a word's ends; interpolated with the lower orders. cells are numbers of
    trigrams (three places in base of all places), counts theirs."""

    def __init__(self, letters: str, cells: np.ndarray, counts: np.ndarray):
        n = self.n = len(letters) + 2
        self.at = {c: i + 2 for i, c in enumerate(letters)}
        self.tri = dict(zip(cells.tolist(), counts.tolist()))
        self.context: Counter = Counter()
        self.bi: Counter = Counter()
        self.before: Counter = Counter()
        uni = np.ones(n)
        for cell, m in self.tri.items():
            b, c = divmod(cell % (n * n), n)
            self.context[cell // n] += m
            self.bi[b * n + c] += m
            self.before[b] += m
            uni[c] += m
        self.uni = (uni / uni.sum()).tolist()
        self.known: dict[int, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def log_p(self, a: int, b: int, c: int) -> float:
        """Of place c after places a and b."""
        n = self.n
        cell = (a * n + b) * n + c
        lp = self.known.get(cell)
        if lp is None:
            p2 = (self.bi.get(b * n + c, 0) + 20 * self.uni[c]) / (self.before.get(b, 0) + 20)
            lp = math.log((self.tri.get(cell, 0) + 20 * p2) / (self.context.get(cell // n, 0) + 20))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[cell] = lp
        return lp

    def decode(self, word: str, alone: bool = False) -> list[str]:
        """The likeliest words for a token, or for letters that stand alone."""
        beam: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        lp = self.log_p
        runs = [(m[1], m.end() - m.start()) for m in RUN.finditer(word)]
        for k, (c, r) in enumerate(runs):
            options = []
            if c.isalpha():
                options.append((c, 0.0))
            for x in LEET.get(c, ""):
                options.append((x, SUBST))
            if not c.isalnum():
                options.append(("", DROP))
            if not options:
                options.append((c, 0.0))
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (s, out) in beam.items():
                for x, cost in options:
                    for times in (1, 2) if r > 1 and x else (1,):
                        fold = 0.0 if times == min(r, 2) and r < 3 else FOLD * (times if r > 2 else 1)
                        for gap in (False, True) if alone and b and x and k else (False,):
                            t, p, q, o = s - cost - fold, a, b, out
                            if gap:
                                t, p, q, o = t - GAP + lp(p, q, 0), 0, 0, o + " "
                            if x:
                                i = self.at.get(x, 1)
                                for _ in range(times):
                                    t, p, q = t + lp(p, q, i), q, i
                                o += x * times
                            if (p, q) not in new or t > new[p, q][0]:
                                new[p, q] = (t, o)
            beam = new
        best = max(((s + lp(a, b, 0), out) for (a, b), (s, out) in beam.items()), default=(0, ""))
        return best[1].split()


def char_model(df: DataFrame, text: str = "text") -> CharModel:
    """Counted over the words of every row. What reaches the driver is a number for
    each letter and each trigram with a share of SHARE; the first letter of a rarer
    trigram, and the second of one that is rare even so, count as others."""
    text = name_of(df, text)

    def make():
        def fn(b: pa.RecordBatch):
            words: Counter = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    words.update(t.lower().split())
            tri: Counter = Counter()
            for w, n in words.items():
                w = w.strip(".,;:!?\"'()")
                if w.isalpha():
                    tri[w] += n
            # every trigram of a word with two starts before and an end after
            joined = "\0\0" + "\0\0".join(tri) + "\0"
            code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            sizes = np.fromiter(map(len, tri), dtype=np.int64, count=len(tri))
            weights = np.repeat(np.fromiter(tri.values(), dtype=np.int64, count=len(tri)), sizes + 2)[: max(0, len(code) - 2)]
            key = (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]
            if len(key) == 0 or not tri:
                return
            # the window that starts on the gap between two words is no trigram
            keep = ~((code[1:-1] == 0) & (code[2:] == 0))
            u, at = np.unique(key[keep], return_inverse=True)
            n = np.bincount(at, weights=weights[: len(key)][keep]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(n)], ["key", "n"])

        return fn

    counts = map_batches(df.select(field(df, text).alias("t")), make, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "char_trigrams")
    spark = df.sparkSession
    least = SHARE * (counts.agg(F.sum("n")).first()[0] or 0)

    def code(shift: int):
        return F.expr(f"cast(shiftright(key, {shift}) & 2097151 as int)")

    letter = counts.groupBy(code(0).alias("c")).agg(F.sum("n").alias("n")).where((F.col("c") != 0) & (F.col("n") >= least))
    letters = sorted(r.c for r in letter.collect())
    places = spark.createDataFrame([(0, 0), *((c, i + 2) for i, c in enumerate(letters))], "code int, place int")
    for name, shift in (("a", 42), ("b", 21), ("c", 0)):
        own = places.select(F.col("code").alias(f"{name}_code"), F.col("place").alias(name))
        counts = counts.join(F.broadcast(own), code(shift) == F.col(f"{name}_code"), "left").withColumn(name, F.coalesce(name, F.lit(1)))
    counts = counts.groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    for name in ("a", "b"):
        counts = counts.withColumn(name, F.when((F.col("n") < least) & (F.col("a") <= 1 if name == "b" else F.lit(True)) & (F.col(name) > 1), 1).otherwise(F.col(name)))
        counts = counts.groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    n = len(letters) + 2
    found = counts.select(F.expr(f"(cast(a as bigint) * {n} + b) * {n} + c").alias("cell"), "n").orderBy("cell").toArrow()
    return CharModel("".join(map(chr, letters)), found["cell"].to_numpy(), found["n"].to_numpy())


def restored(token: str, model: CharModel) -> list[str]:
    """The words that a token, already in small letters, stands for."""
    s = token.strip(STRIPPED)
    if not any(c.isalpha() for c in s):
        return [s]
    if PLAIN.fullmatch(s) and not LONG.search(s):
        again = model.decode(s) if DOUBLED.search(s) else [s]
        return [s] if again == [s] else [s, *again]
    return model.decode(s)


def restored_alone(low: str, model: CharModel) -> list[str]:
    """The words that letters standing alone spell."""
    return [w for m in ALONE.finditer(low) for w in model.decode("".join(m[0].split()), alone=True)]


def tokens(text: str, model: CharModel) -> list[str]:
    """All restored words of a text."""
    low = text.lower()
    known = {w: restored(w, model) for w in set(low.split())}
    return [x for w in low.split() for x in known[w]] + restored_alone(low, model)


def features(word: str) -> list[str]:
    return [word + "$"] + [word[:k] for k in PREFIXES if k <= len(word)]


class Classifier:
    def __init__(self, weights: dict[str, float], bias: float, by_length: float):
        self.weights, self.bias, self.by_length = weights, bias, by_length

    def probability(self, hits: Counter, n_words: int) -> float:
        if not hits:
            return 0.0
        z = self.bias + self.by_length * math.log1p(n_words) + sum(self.weights[f] * math.log1p(n) for f, n in sorted(hits.items()))
        return round(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), 6)


def fit(names: list[str], rows: list[tuple[dict[int, int], int, int]], l1: float = L1, steps: int = 400) -> Classifier:
    """rows: how often each feature of names occurs, number of words, label.
    Accelerated proximal gradient on the likelihood; classes weigh as they come."""
    y = np.array([r[2] for r in rows], dtype=np.float64)
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return Classifier({}, -50.0, 0.0)
    ii, jj, vv = [], [], []
    for i, r in enumerate(rows):
        for j, n in r[0].items():
            ii.append(i), jj.append(j), vv.append(math.log1p(n))
    ii, jj, vv = np.array(ii, dtype=np.int64), np.array(jj, dtype=np.int64), np.array(vv)
    length = np.log1p([r[1] for r in rows])
    w, free = np.zeros(len(names)), np.array([math.log(pos / neg), 0.0])
    v, vfree, t = w.copy(), free.copy(), 1.0
    norm = np.bincount(ii, vv * vv, len(rows))
    rate = 4.0 / (norm.max(initial=0) + 1 + (length**2).max())
    rate = max(rate, 4.0 / (np.percentile(norm, 99) + 1 + (length**2).max()))
    for _ in range(steps):
        z = vfree[0] + vfree[1] * length + np.bincount(ii, vv * v[jj], len(rows))
        g = (1 / (1 + np.exp(-z)) - y) / len(y)
        nw = np.maximum(0, v - rate * len(y) ** 0.25 * (np.bincount(jj, vv * g[ii], len(names)) + l1))
        nfree = vfree - rate * np.array([g.sum(), g @ length])
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vfree = nw + (t - 1) / nt * (nw - w), nfree + (t - 1) / nt * (nfree - free)
        w, free, t = nw, nfree, nt
    return Classifier({names[j]: float(w[j]) for j in np.nonzero(w > 1e-3)[0]}, float(free[0]), float(free[1]))


class Scorer:
    """Probabilities of texts. A word is looked at when its first two characters
    may stand for the beginning of something weighed, or one of them for nothing."""

    def __init__(self, model: CharModel, classifier: Classifier):
        self.model, self.classifier, self.known = model, classifier, {}
        forms: dict[str, set[str]] = {}
        for sign, letters in LEET.items():
            for c in letters:
                forms.setdefault(c, {c}).add(sign)
        self.heads: set[str] = set()
        for f in classifier.weights:
            f = f.removesuffix("$")
            if not f:  # of signs only, which are looked at anyway
                continue
            one, two = forms.get(f[0], {f[0]}), forms.get(f[1:2], {f[1:2]})
            # the first character may also stand for the first letter twice, or as one of several
            self.heads |= {a + b for a in one for b in two | one}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def _hits(self, token: str) -> list[str]:
        h = self.known.get(token)
        if h is None:
            h = [f for w in restored(token, self.model) for f in features(w) if f in self.classifier.weights]
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[token] = h
        return h

    def probability(self, text: str | None) -> float:
        if not text or not self.classifier.weights:
            return 0.0
        low, heads = text.lower(), self.heads
        words = low.split()
        hits: Counter = Counter()
        for w in words:
            if w[:2] in heads or not w[0].isalnum() or not w[1:2].isalnum():
                hits.update(self._hits(w))
        for w in restored_alone(low, self.model):
            hits.update(f for f in features(w) if f in self.classifier.weights)
        return self.classifier.probability(hits, len(words))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Scorer:
    """What reaches the driver is the sample's features that tell toxic from clean,
    and how often each row has them; restored texts stay in a written table."""
    model = char_model(docs, text)
    key, text = name_of(docs, key), name_of(docs, text)
    of, label = field(labels, name_of(labels, key)), field(labels, name_of(labels, label))
    pick = labels.where(label.isNotNull() & of.isNotNull()).groupBy(of.alias("of")).agg(F.max(label).cast("int").alias("y"))
    pick = materialize(pick.orderBy(F.xxhash64("of"), "of").limit(rows), "toxicity_sample")
    some = docs.select(field(docs, key).alias("key"), field(docs, text).alias("t")).join(F.broadcast(pick), F.col("key") == F.col("of")).where("t is not null")

    def restore():
        def fn(b: pa.RecordBatch):
            texts = b.column(0).to_pylist()
            found = [Counter(f for w in tokens(t, model) for f in features(w)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())), pa.array([len(t.lower().split()) for t in texts], pa.int32()), b.column(1)],
                ["features", "times", "words", "y"],
            )

        return fn

    read = materialize(map_batches(some.select("t", "y"), restore, "features array<string>, times array<int>, words int, y int", rows=50), "toxicity_words")
    kinds = {r.y: r["count"] for r in read.groupBy("y").count().collect()}
    pos, neg = kinds.get(1, 0), sum(n for y, n in kinds.items() if y != 1)
    if not pos or not neg:
        return Scorer(model, fit([], [({}, 0, y) for y in kinds]))
    seen = read.select((F.col("y") == 1).cast("int").alias("y"), F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("on"), F.sum(1 - F.col("y")).alias("off"))
    names = sorted(r.f for r in seen.where(F.expr(f"on >= 3 and (on + 0.5D) / {pos + 1} >= 4 * (off + 0.5D) / {neg + 1}")).select("f").collect())
    index = {f: i for i, f in enumerate(names)}

    def pick_out():
        def fn(b: pa.RecordBatch):
            hits = [[(index[f], n) for f, n in zip(fs, ns) if f in index] for fs, ns in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[i for i, _ in h] for h in hits], pa.list_(pa.int32())), pa.array([[n for _, n in h] for h in hits], pa.list_(pa.int32())), b.column(2), b.column(3)], ["which", "times", "words", "y"]
            )

        return fn

    got = map_batches(read, pick_out, "which array<int>, times array<int>, words int, y int").toArrow()
    rows_ = [(dict(zip(w, n)), m, int(y == 1)) for w, n, m, y in zip(*(got.column(i).to_pylist() for i in range(4)))]
    # the order of rows doesn't matter but for rounding
    return Scorer(model, fit(names, sorted(rows_, key=lambda r: (r[2], r[1], sorted(r[0].items())))))


def score(df: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, probability, toxic of every row."""
    key, text = name_of(df, key), name_of(df, text)

    def make():
        def fn(b: pa.RecordBatch):
            p = [scorer.probability(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array([x >= threshold for x in p], pa.bool_())], ["key", "probability", "toxic"])

        return fn

    kind = df.schema[key].dataType.simpleString()
    out = map_batches(df.select(field(df, key).alias("key"), field(df, text).alias("text")), make, f"key {kind}, probability double, toxic boolean")
    return out.withColumnRenamed("key", key)


def drop_toxic(df: DataFrame, scorer: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    where = df.columns.index(name_of(df, text))

    def make():
        def fn(b: pa.RecordBatch):
            yield b.filter(pa.array([scorer.probability(t) < threshold for t in b.column(where).to_pylist()], pa.bool_()))

        return fn

    return map_batches(df, make, df.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))
