"""Language identification with segmentation-marginalised unigrams over a public piece vocabulary.

Each language has a probability for every piece of the vocabulary. A word's probability in a language is the sum, over
all ways to cut it into pieces, of the product of their probabilities (the forward algorithm); a text's is the product
over its words. Probabilities are fitted by expectation-maximisation on words counted in a bounded sample of labelled
texts: every language gets whole texts up to an expected SAMPLE_TEXTS, chosen by a hash of the row, so the fit costs
the same on any corpus. All their words teach; a word of more than PART letters teaches as consecutive parts of so many,
but is scored over all its segmentations like any other (in logarithms, a stretch of letters at a time). The model is
pieces x languages numbers, a bound that the vocabulary file and MAX_LANGS set (more languages are an error), and is
broadcast. Scoring goes over every whole text, row by row, without a shuffle.

A word is a run of letters (Unicode's category L), in the fit as in scoring; marks, digits and other numbers aren't letters.

Defined results: null texts and texts without a letter are "und" with score 0; ties go to the first language in name
order; rows without a language don't teach; if there is no labelled text every other text is "und" with score 0;
repeated rows are scored alike; extra columns pass through, and columns that have the results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.common import fresh, ship

#: Labelled texts of each language that the fit sees, as expected; languages it tells apart at most; rounds of the fit.
SAMPLE_TEXTS = 600
MAX_LANGS = 64
ROUNDS = 3
CACHE_WORDS = 600_000
#: Words whose lattices are laid out together.
TOGETHER = 20_000
#: Letters of a word that is scored in one piece; longer ones are scored STRETCH letters at a time, GROUP words together.
PART = 24
STRETCH = 512
GROUP = 1024
_WORD = regex.compile(r"\p{L}+")


class Pieces:
    """The vocabulary as sorted 64-bit hashes with a filter in front, so that all substrings of many words are looked up at once."""

    BASE, MIX, BITS = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(44)

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.powers = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                self.powers.append(self.powers[-1] * self.BASE)
            self.by_length = {}
            for n in range(1, self.longest + 1):
                own = [k for k, p in enumerate(pieces) if len(p) == n]
                if not own:
                    continue
                codes = np.array([pieces[k] for k in own], dtype=f"U{n}").view(np.uint32).reshape(-1, n).astype(np.uint64)
                h = np.zeros(len(own), np.uint64)
                for k in range(n):
                    h = h * self.BASE + codes[:, k]
                order = np.argsort(h)
                there = np.zeros(1 << 20, bool)
                there[(h * self.MIX) >> self.BITS] = True
                self.by_length[n] = (h[order], np.array(own)[order] + 1, there)

    def matches(self, words: list[str]) -> tuple[np.ndarray, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
        """Lengths of the words, and for each (end, length) the words and pieces that match there; piece 0 is any other letter."""
        size = np.array([len(w) for w in words], np.int64)
        most = max(1, int(size.max(initial=0)))
        codes = np.array(words, dtype=f"U{most}").view(np.uint32).reshape(-1, most).astype(np.uint64)
        out = {}
        with np.errstate(over="ignore"):
            sums = np.zeros((len(words), most + 1), np.uint64)
            for k in range(most):
                sums[:, k + 1] = sums[:, k] * self.BASE + codes[:, k]
            inside = [np.flatnonzero(size >= j) for j in range(most + 1)]
            for n in range(1, min(most, self.longest) + 1):
                table = self.by_length.get(n)
                if table is None and n > 1:
                    continue
                for j in range(n, most + 1):
                    own = inside[j]
                    piece = np.zeros(len(own), np.int64)
                    if table is not None:
                        hashes, ids, there = table
                        h = sums[own, j] - sums[own, j - n] * self.powers[n]
                        maybe = np.flatnonzero(there[(h * self.MIX) >> self.BITS])
                        at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                        piece[maybe] = np.where(hashes[at] == h[maybe], ids[at], 0)
                    keep = np.arange(len(own)) if n == 1 else np.flatnonzero(piece)
                    if len(keep):
                        out[j, n] = (own[keep], piece[keep])
        return size, out


def long_totals(words: list[str], pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """Log-probability of words of any length, all segmentations summed. Of the forward sums only those that a piece can still reach back to are held."""
    out = np.zeros((len(words), logs.shape[1]))
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    ring = pieces.longest + 1
    for first in range(0, len(order), GROUP):
        own = order[first : first + GROUP]
        group = [words[k] for k in own]
        size = np.array([len(w) for w in group])
        alpha = np.full((ring, len(group), logs.shape[1]), -np.inf)
        alpha[0] = 0
        for s in range(0, int(size.max()), STRETCH):
            lead = min(s, pieces.longest - 1)
            _, at = pieces.matches([w[s - lead : s + STRETCH] for w in group])
            by_end: dict[int, list[int]] = {}
            for j, n in at:
                by_end.setdefault(j, []).append(n)
            for j in range(lead + 1, lead + STRETCH + 1):
                if j not in by_end:
                    break
                end = s - lead + j
                now = np.full(alpha.shape[1:], -np.inf)
                for n in by_end[j]:
                    w, p = at[j, n]
                    now[w] = np.logaddexp(now[w], alpha[(end - n) % ring][w] + logs[p])
                alpha[end % ring] = now
                done = np.flatnonzero(size == end)
                out[np.array(own)[done]] = now[done]
    return out


class Lattice:
    """All ways to cut a list of words (of PART letters at most, so that no probability vanishes) into pieces."""

    def __init__(self, words: list[str], pieces: Pieces) -> None:
        self.size, self.at = pieces.matches(words)
        self.order = sorted(self.at)

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[word, place, language]."""
        alpha = np.zeros((len(self.size), max(1, int(self.size.max(initial=0))) + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for j, n in self.order:
            w, p = self.at[j, n]
            alpha[w, j] += alpha[w, j - n] * prob[p]
        return alpha

    def totals(self, prob: np.ndarray) -> np.ndarray:
        return self.forward(prob)[np.arange(len(self.size)), self.size]

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts, with counts[word, language] words."""
        alpha = self.forward(prob)
        rows = np.arange(len(self.size))
        total = alpha[rows, self.size]
        beta = np.zeros_like(alpha)
        beta[rows, self.size] = np.divide(counts, total, out=np.zeros_like(total), where=total > 0)
        out = np.zeros_like(prob)
        for j, n in reversed(self.order):
            w, p = self.at[j, n]
            after = beta[w, j] * prob[p]
            gain = alpha[w, j - n] * after
            for k in range(prob.shape[1]):
                out[:, k] += np.bincount(p, gain[:, k], len(out))
            beta[w, j - n] += after
        return out


def vocabulary(path: str) -> list[str]:
    """Pieces without their word-start mark, lower case, of letters only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (sp.id_to_piece(i).lstrip("▁").lower() for i in range(sp.get_piece_size()))
    return list(dict.fromkeys(p for p in every if _WORD.fullmatch(p)))


def parts(word: str) -> list[str]:
    """What a word teaches as."""
    return [word] if len(word) <= PART else [word[k : k + PART] for k in range(0, len(word), PART)]


class Model:
    def __init__(self, langs: list[str], pieces: list[str], prob: np.ndarray) -> None:
        self.langs, self.prob, self.pieces = langs, prob, Pieces(pieces)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)))

    def __getstate__(self):
        return self.langs, self.pieces.pieces, self.prob

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    @staticmethod
    def words(text: str) -> list[str]:
        return _WORD.findall(text.lower())

    def log_probs(self, words: list[str]) -> np.ndarray:
        """One row for each word; different words are scored once."""
        place: dict[str, int] = {}
        at = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
        each = np.zeros((len(place), len(self.langs)))
        todo = [w for w in place if len(w) <= PART]
        for k in range(0, len(todo), TOGETHER):
            some = todo[k : k + TOGETHER]
            each[[place[w] for w in some]] = np.log(Lattice(some, self.pieces).totals(self.prob))
        if len(todo) < len(place):
            long = [w for w in place if len(w) > PART]
            each[[place[w] for w in long]] = long_totals(long, self.pieces, np.log(self.prob))
        return each[at]

    def _learn(self, new: list[str]) -> None:
        """Runs without white space get a row of the score table; they are scored once while they are remembered."""
        words = [self.words(r) for r in new]
        flat = [w for ws in words for w in ws]
        rows = np.zeros((len(new), len(self.langs)))
        if flat:
            sizes = np.array([len(ws) for ws in words])
            some = np.flatnonzero(sizes)
            rows[some] = np.add.reduceat(self.log_probs(flat), np.concatenate(([0], np.cumsum(sizes[some])[:-1])))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.scores = np.concatenate((self.scores, rows))

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text in each language; texts are taken together up to some CACHE_WORDS / 2 runs."""
        out = np.zeros((len(texts), len(self.langs)))
        first, held, group = 0, 0, []
        for k, t in enumerate(texts):
            runs = t.split()
            if len(runs) > CACHE_WORDS // 2:  # one very long text
                out[k] = sum(self._sums([runs[i : i + CACHE_WORDS // 2]])[0] for i in range(0, len(runs), CACHE_WORDS // 2))
                runs = []
            group.append(runs)
            held += len(runs)
            if held > CACHE_WORDS // 2 or k + 1 == len(texts):
                out[first : k + 1] += self._sums(group)
                first, held, group = k + 1, 0, []
        return out

    def _sums(self, group: list[list[str]]) -> np.ndarray:
        flat = [r for runs in group for r in runs]
        at = list(map(self.known.get, flat))
        if None in at:
            new = list({r for r, a in zip(flat, at, strict=True) if a is None})
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known, self.scores = {}, np.zeros((0, len(self.langs)))
                new = list(set(flat))
            self._learn(new)
            at = list(map(self.known.get, flat))
        sizes = np.array([len(runs) for runs in group])
        some = np.flatnonzero(sizes)
        out = np.zeros((len(group), len(self.langs)))
        if len(some):
            out[some] = np.add.reduceat(self.scores[np.array(at, np.int64)], np.concatenate(([0], np.cumsum(sizes[some])[:-1])))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        logs = self.score([t or "" for t in texts])
        best = logs.argmax(axis=1)
        share = np.exp(logs - logs.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        ok = [bool(t) and _WORD.search(t) is not None for t in texts]
        return [self.langs[b] if o else "und" for b, o in zip(best, ok, strict=True)], [float(s[b]) if o else 0.0 for s, b, o in zip(share, best, ok, strict=True)]


def fit_counts(langs: list[str], counted: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """counted: word counts by language."""
    words = sorted({p for of in counted.values() for w in of for p in parts(w)})
    place = {w: k for k, w in enumerate(words)}
    counts = np.zeros((len(words), len(langs)))
    for k, lang in enumerate(langs):
        for w, n in counted.get(lang, {}).items():
            for p in parts(w):
                counts[place[p], k] += n
    size = len(pieces) + 1
    prob = np.full((size, len(langs)), 1 / size)
    known = Pieces(pieces)
    lattices = [(Lattice(words[k : k + TOGETHER], known), counts[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
    for _ in range(rounds):
        expected = sum((x.expected(prob, c) for x, c in lattices), np.zeros_like(prob)) + 0.05
        prob = expected / expected.sum(axis=0)
    return Model(langs, pieces, prob)


def fit(labelled: DataFrame, path: str, text: str = "text", lang: str = "lang", sample: int = SAMPLE_TEXTS) -> Model:
    """Learns from the rows of labelled whose text and language aren't null."""
    pieces = vocabulary(path)
    chance = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in labelled.columns]), 11) / F.lit(float(1 << 53))
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), chance.alias("c")).where("t IS NOT NULL AND l IS NOT NULL")
    sizes = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages; raise MAX_LANGS for a larger model")
    if not sizes:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["l"], min(1.0, sample / r["count"]))])
    chosen = rows.where(F.col("c") < share[F.col("l")])
    split = F.explode(F.regexp_extract_all(F.lower("t"), F.lit("(\\p{L}+)"), 1)).alias("w")
    langs = sorted(r["l"] for r in sizes)
    by: dict[str, dict[str, int]] = {k: {} for k in langs}
    for r in chosen.select("l", split).groupBy("l", "w").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        by[r["l"]][r["w"]] = r["n"]
    return fit_counts(langs, by, pieces)


def identify(df: DataFrame, model: Model, text: Column | str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the language of each text and its share among all languages."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            if not m.langs:
                yield pd.DataFrame({"lang": ["und"] * len(texts), "score": [0.0] * len(texts)})
                continue
            langs, scores = m.predict(texts.tolist())
            yield pd.DataFrame({"lang": langs, "score": scores})

    col = F.col(text) if isinstance(text, str) else text
    judged = fresh(df, "_judged")[0]
    return df.withColumn(judged, judge(col)).withColumns({pred: F.col(judged)["lang"], score: F.col(judged)["score"]}).drop(judged)
