"""Toxicity: a convolutional text classifier in numpy.

Words are hashed into an embedding table, each as a whole and by its beginnings, and the word's embedding is the sum of
those; filters of several widths slide over the whole text and their largest responses feed a logistic output. The fit
sees a bounded sample of labelled texts, whole ones (at most SAMPLE_TEXTS of each class, as expected, chosen by a hash of
the row), so it costs the same on any corpus. The
embedding's first coordinate starts at a quarter of the class log-odds of its bucket; all weights are then trained with Adagrad.
Every part of the sample is scored by a model of the other parts, and a threshold is set for each language on those scores; scores are stretched so that a language's
threshold stands at CUT. The language is guessed from the text's function words, never read from a column.

Scoring keeps the embeddings of the words a worker remembers, so a text costs lookups, one matrix product and maxima. The model's size is fixed (BUCKETS x DIM and the filters), and it is broadcast.

Defined results: null, empty and blank texts have no words, all features are 0, and they get the score of that; repeated
rows are scored alike; with labels of one class only, or none, every score is 0; an id that is labelled both ways
teaches nothing; texts of any length are scored whole; extra columns pass through, but one that has the result's name is
replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.common import ship
from vaultlens.llm.quality import STOP_WORDS

#: Labelled texts of each class that the fit sees, as expected.
SAMPLE_TEXTS = 2000
#: The model.
BUCKETS = 1 << 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
EPOCHS = 4
BATCH = 32
#: Parts of the sample; each is scored by a model of the others, which gives the thresholds.
FOLDS = 3
#: Where calibrated thresholds stand.
CUT = 0.3
CACHE_WORDS = 500_000
#: Bytes of the beginnings of words that are hashed beside whole words.
STARTS = (3, 4, 5, 6, 7, 8)
#: Words looked up at a time.
GROUP = 100_000
#: Words laid out at a time.
STRIDE = 100_000
_EDGE = ".,;:!?\"'()[]*$%&#|<>-"
_PAD = BUCKETS


class Lexicon:
    """Words to rows, and of each row the hashed parts of its word and the languages it is a function word of; row 0 is
    padding. It starts afresh when it is full."""

    LANGS = sorted(STOP_WORDS)

    def __init__(self, limit: int | None = None) -> None:
        self.limit, self.version = limit, 0
        self.function = {w: [int(w in STOP_WORDS[k]) for k in self.LANGS] for ws in STOP_WORDS.values() for w in ws}
        self.clear()

    def clear(self) -> None:
        self.version += 1
        self.known: dict[str, int] = {}
        self.subs = np.full((1, 1 + len(STARTS)), _PAD, np.int32)
        self.marks = np.zeros((1, len(self.LANGS)), np.int32)

    @staticmethod
    def _parts(word: str) -> list[int]:
        b = word.strip(_EDGE).encode("utf-8", "surrogatepass")
        n, crc = len(b), zlib.crc32
        return [crc(b, 1) % BUCKETS if n else _PAD] + [crc(b[:k]) % BUCKETS if n > k else _PAD for k in STARTS]

    def rows(self, words: list[str]) -> np.ndarray:
        at = list(map(self.known.get, words))
        if None in at:
            new = list({w for w, a in zip(words, at, strict=True) if a is None})
            if self.limit and len(self.known) + len(new) > self.limit:
                self.clear()
                new = list(set(words))
            start = len(self.subs)
            self.known.update(zip(new, range(start, start + len(new)), strict=True))
            self.subs = np.concatenate((self.subs, np.array([self._parts(w) for w in new], np.int32)))
            none = [0] * len(self.LANGS)
            self.marks = np.concatenate((self.marks, np.array([self.function.get(w, none) for w in new], np.int32)))
            at = list(map(self.known.get, words))
        return np.array(at, np.int32)

    def languages(self, docs: list[np.ndarray]) -> list[str]:
        """The language whose function words a document has most of; "" if it has none."""
        hits = np.array([self.marks[d].sum(axis=0) for d in docs])
        return [self.LANGS[int(h.argmax())] if h.any() else "" for h in hits]


def laid_out(docs: list[np.ndarray], places: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All words in a row, every document followed by padding; the places where the windows of each start and end, in turn.
    places: at how many of its words windows start, where a document is a part that another one continues."""
    gap = np.zeros(max(WIDTHS), np.int32)
    parts, at, edges = [], 0, []
    for k, d in enumerate(docs):
        edges += [at, at + (places[k] if places else len(d))]
        parts += [d, gap]
        at += len(d) + len(gap)
    return np.concatenate(parts), np.array(edges)


class Model:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        self.emb[_PAD] = 0
        self.filters = {w: rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(0)
        self.cuts: dict[str, float] = {}
        self.ready = False

    def embedded(self, subs: np.ndarray) -> np.ndarray:
        return self.emb[subs].sum(axis=1)

    def weights(self) -> np.ndarray:
        """All filters side by side: the columns of a width's first place, its second, and so on."""
        return np.concatenate([self.filters[w][k] for w in WIDTHS for k in range(w)], axis=1)

    @staticmethod
    def responses(products: np.ndarray, w: int) -> np.ndarray:
        """One row for each place at which a window of w words can start."""
        first = sum(v for v in WIDTHS if v < w) * FILTERS
        n = len(products) - w + 1
        out = products[:n, first : first + FILTERS].copy()
        for k in range(1, w):
            out += products[k : k + n, first + k * FILTERS : first + (k + 1) * FILTERS]
        return out

    def features(self, docs: list[np.ndarray], embedded: np.ndarray, weights: np.ndarray, places: list[int] | None = None) -> np.ndarray:
        """embedded: the embeddings of the lexicon's rows."""
        flat, edges = laid_out(docs, places)
        products = embedded[flat] @ weights
        empty = edges[::2] == edges[1::2]
        out = []
        for w in WIDTHS:
            top = np.maximum.reduceat(self.responses(products, w), edges, axis=0)[::2] + self.bias[w]
            top[empty] = 0
            out.append(np.maximum(top, 0))
        return np.concatenate(out, axis=1)

    def raw(self, docs: list[np.ndarray], embedded: np.ndarray) -> np.ndarray:
        """Probability of each document; long ones go in parts that overlap by the widest filter."""
        feats = np.zeros((len(docs), len(WIDTHS) * FILTERS), np.float32)
        group: list[np.ndarray] = []
        owners: list[int] = []
        places: list[int] = []
        held, weights = 0, self.weights()

        def flush() -> None:
            nonlocal held
            if group:
                np.maximum.at(feats, owners, self.features(group, embedded, weights, places))
            group.clear()
            places.clear()
            owners.clear()
            held = 0

        for k, d in enumerate(docs):
            for s in range(0, max(1, len(d)), STRIDE):
                group.append(d[s : s + STRIDE + max(WIDTHS) - 1])
                owners.append(k)
                places.append(min(STRIDE, len(d) - s))
                held += len(group[-1])
                if held >= STRIDE:
                    flush()
        flush()
        return 1 / (1 + np.exp(-np.clip(feats @ self.out + self.base, -30, 30)))

    def _step(self, docs: list[np.ndarray], subs: np.ndarray, y: np.ndarray, weight: np.ndarray, sums: dict, rate: float) -> None:
        flat, edges = laid_out(docs)
        rows, flat = np.unique(flat, return_inverse=True)
        own = subs[rows]
        embedded = self.embedded(own)
        products = (embedded @ self.weights())[flat]
        starts, ends = edges[::2], edges[1::2]
        feats, tops = [], {}
        for w in WIDTHS:
            r = self.responses(products, w)
            best = np.array([s + r[s:e].argmax(axis=0) if e > s else np.full(FILTERS, s) for s, e in zip(starts, ends, strict=True)])
            value = np.take_along_axis(r, best, axis=0) + self.bias[w]
            value[ends == starts] = 0
            tops[w] = (best, value > 0)
            feats.append(np.maximum(value, 0))
        x = np.concatenate(feats, axis=1)
        p = 1 / (1 + np.exp(-np.clip(x @ self.out + self.base, -30, 30)))
        d = ((p - y) * weight / len(docs)).astype(np.float32)

        def move(name, value: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:
            s = sums.setdefault(name, np.full(value.shape, 1e-4, np.float32))
            s[at] += grad**2
            value[at] -= rate * grad / np.sqrt(s[at])

        dx = d[:, None] * self.out
        grads = [("out", self.out, x.T @ d + 1e-4 * self.out)]
        touched, pulls = [], []
        for k, w in enumerate(WIDTHS):
            best, on = tops[w]
            g = np.where(on, dx[:, k * FILTERS : (k + 1) * FILTERS], 0)
            grads.append((("bias", w), self.bias[w], g.sum(axis=0)))
            df = np.empty_like(self.filters[w])
            for j in range(w):
                ids = flat[best + j]
                df[j] = np.einsum("nf,nfd->df", g, embedded[ids])
                touched.append(ids.ravel())
                pulls.append((g[:, :, None] * self.filters[w][j].T[None]).reshape(-1, DIM))
            grads.append((("filter", w), self.filters[w], df))
        base = np.array([self.base])
        move("base", base, np.array([d.sum()]))
        self.base = base[0]
        for name, value, grad in grads:
            move(name, value, grad)
        by_row = np.zeros((len(rows), DIM), np.float32)
        np.add.at(by_row, np.concatenate(touched), np.concatenate(pulls))
        moved = np.flatnonzero(by_row.any(axis=1))
        ids, inverse = np.unique(own[moved], return_inverse=True)
        grad = np.zeros((len(ids), DIM), np.float32)
        np.add.at(grad, inverse.ravel(), np.repeat(by_row[moved], own.shape[1], axis=0))
        keep = ids != _PAD
        move("emb", self.emb, grad[keep], ids[keep])

    def _train(self, docs: list[np.ndarray], subs: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        pos, neg = np.ones(BUCKETS + 1), np.ones(BUCKETS + 1)
        for d, label in zip(docs, y, strict=True):
            (pos if label else neg)[np.unique(subs[d])] += 1
        n_pos, n_neg = max(1, y.sum()), max(1, (1 - y).sum())
        odds = np.log((pos / n_pos) / (neg / n_neg)) * (pos + neg - 2) / (pos + neg + 8)
        self.emb[:, 0] += 0.25 * odds.astype(np.float32)
        self.emb[_PAD] = 0
        for w in WIDTHS:
            self.filters[w][:, 0, : FILTERS // 2] = np.abs(self.filters[w][:, 0, : FILTERS // 2]) + 0.3
        weight = np.where(y == 1, len(y) / (2 * n_pos), len(y) / (2 * n_neg))
        sums: dict = {}
        for epoch in range(EPOCHS):
            turn = rng.permutation(len(docs))
            for k in range(0, len(turn), BATCH):
                at = turn[k : k + BATCH]
                self._step([docs[i] for i in at], subs, y[at], weight[at], sums, 0.05 / (1 + 0.5 * epoch))
        self.ready = True

    def fit(self, docs: list[np.ndarray], subs: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 7) -> None:
        """Trains on all rows; the thresholds come from models that have not seen the row they score."""
        rng = np.random.default_rng(seed)
        fold = rng.permutation(len(docs)) % FOLDS
        p = np.zeros(len(docs))
        for f in range(FOLDS):
            seen, aside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(seen) and len(aside):
                part = Model(seed)
                part._train([docs[i] for i in seen], subs, y[seen], rng)
                p[aside] = part.raw([docs[i] for i in aside], part.embedded(subs))
        self._train(docs, subs, y, rng)
        of = np.array(langs, dtype=object)
        self.cuts = {"": self._threshold(p, y, 0.5)}
        for lang in STOP_WORDS:
            own = of == lang
            self.cuts[lang] = self._threshold(p[own], y[own], self.cuts[""])

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray, default: float) -> float:
        """The middle of the widest-margin cut with the best F1; default where a class is missing."""
        if y.sum() < 5 or (1 - y).sum() < 5:
            return default
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        k = int(f1.argmax())
        low = p[order[k + 1]] if k + 1 < len(p) else 0.0
        return float(np.clip((p[order[k]] + low) / 2, 0.02, 0.98))

    def stretched(self, p: np.ndarray, langs: list[str]) -> np.ndarray:
        cut = np.array([self.cuts.get(k, self.cuts[""]) for k in langs])
        return np.where(p < cut, CUT * p / cut, CUT + (1 - CUT) * (p - cut) / (1 - cut))


class Scorer:
    """A model with the embeddings of the words it has met; both are bounded."""

    def __init__(self, model: Model) -> None:
        self.model, self.lexicon, self.weights = model, Lexicon(CACHE_WORDS), model.weights()
        self.version, self.embedded = 0, np.zeros((0, DIM), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        rows = self.lexicon.rows(words)
        if self.version != self.lexicon.version:
            self.version, self.embedded = self.lexicon.version, self.embedded[:0]
        new = self.lexicon.subs[len(self.embedded) :]
        if len(new):
            self.embedded = np.concatenate((self.embedded, self.model.embedded(new)))
        return rows

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.model.ready:
            return np.zeros(len(texts))
        out = np.zeros(len(texts))
        group: list[list[str]] = []
        first = held = 0
        for k, t in enumerate(texts):
            group.append((t or "").lower().split())
            held += len(group[-1])
            if held > GROUP or k + 1 == len(texts):
                out[first : k + 1] = self._group(group)
                group, first, held = [], k + 1, 0
        return out

    def _group(self, docs: list[list[str]]) -> np.ndarray:
        """One group's words are looked up together, so that its rows stay valid."""
        flat = [w for d in docs for w in d]
        if len(flat) > CACHE_WORDS:  # with a very long text: one by one, in parts
            return np.array([self._long(d) for d in docs])
        rows = np.split(self._rows(flat), np.cumsum([len(d) for d in docs])[:-1])
        return self.model.stretched(self.model.raw(rows, self.embedded).astype(float), self.lexicon.languages(rows))

    def _long(self, words: list[str]) -> float:
        m = self.model
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        marks = np.zeros(len(Lexicon.LANGS), np.int64)
        for s in range(0, len(words), STRIDE):
            rows = self._rows(words[s : s + STRIDE + max(WIDTHS) - 1])
            best = np.maximum(best, m.features([rows], self.embedded, self.weights, [min(STRIDE, len(words) - s)])[0])
            marks += self.lexicon.marks[rows[:STRIDE]].sum(axis=0)
        p = 1 / (1 + np.exp(-np.clip(best @ m.out + m.base, -30, 30)))
        return float(m.stretched(np.array([float(p)]), [Lexicon.LANGS[int(marks.argmax())] if marks.any() else ""])[0])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from the labels' rows; docs hold their texts."""
    marked = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)").groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("i", "y")
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    model = Model()
    if len(sizes) < 2:
        return model
    chance = F.shiftrightunsigned(F.xxhash64("i"), 11) / F.lit(float(1 << 53))
    bound = F.when(F.col("y") == 1, min(1.0, SAMPLE_TEXTS / sizes[1])).otherwise(min(1.0, SAMPLE_TEXTS / sizes[0]))
    # At most some 2 x SAMPLE_TEXTS pairs of numbers, by the rates above, so they are broadcast.
    chosen = F.broadcast(marked.where(chance < bound))
    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    rows = sorted(texts.join(chosen, "i").select("i", "t", "y").collect(), key=lambda r: (r["i"], r["t"]))
    lexicon = Lexicon()
    split = [r["t"].lower().split() for r in rows]
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return model
    docs_rows = [lexicon.rows(ws) for ws in split]
    model.fit(docs_rows, lexicon.subs, y, lexicon.languages(docs_rows))
    return model


def score_texts(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of each text."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.scores(texts.tolist()))

    return df.withColumn(out, judge(F.col(text)))
