"""BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a word there is exactly one token that ends the prefix's encoding. Going from left to right, the
tokens that end at a place (the automaton's matches: vocabulary entries that are suffixes of the prefix) are tried from
the longest; one is right if it is compatible with the token that ends the shorter prefix it leaves. Back-pointers
then give the ids of the word.

Two tokens are compatible if merging never crosses their border. Both are built by a tree of merges, so at any moment
the border lies between a node of the left token's right spine and a node of the right token's left spine. The walk
goes backwards in time from the two whole tokens, undoing the later of the two merges, and looks whether those two
nodes merge with each other before either one's parent takes it (with equal ranks the place further left goes first).

Texts are cut into words as the tokenizer file says: special tokens first, then normalisation, then its pattern. Texts
of plain characters take a fast pattern; others go through the tokenizer library's own normaliser and splitter.
Words repeat, so each worker keeps the results of words in two tables of bounded size, the newer and the older.

Defined results: a null text is encoded like an empty one, to no ids; texts of any length are encoded whole; repeated
rows are encoded alike; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.common import give_back, ship

#: Words and token pairs that a worker remembers.
CACHE_WORDS = 200_000
CACHE_PAIRS = 250_000
#: Letters of text whose new words are encoded together.
AHEAD = 3_000_000
#: The parts of the splitting pattern; letters and marks here are those of PLAIN texts.
_PLAIN = "\\t\\n\\r -~\\u00a1-\\u00ac\\u00ae-\\u00b1\\u00b4\\u00b6-\\u00b8\\u00bb\\u00bf-\\u017e\\u2010-\\u2027\\u2030-\\u203a\\u20ac"
_NOT_PLAIN = re.compile(f"[^{_PLAIN}]")
_FAST = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|\\d|(?:[^\\s\\w]|_)+")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Bpe:
    """A BPE vocabulary whose words end in a marked symbol."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.table = {b: c for b, c in self.letters.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, ab = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.rank[a, b] = rank
            if ab not in self.parts:
                self.parts[ab] = (a, b)
                self.made[ab] = rank
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._pairs: dict[int, bool] = {}
        # Tokens that their own text is encoded to; single symbols are, others if their two parts meet at last.
        self.whole = {t for t in self.tokens if t not in self.parts}
        for t in sorted(self.parts, key=self.made.get):
            a, b = self.parts[t]
            if a in self.whole and b in self.whole and self._meets(a, b, self.made[t]):
                self.whole.add(t)
        self.automata = self._suffixes()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

    def _meets(self, a: int, b: int, last: int | None = None) -> bool:
        """Whether a and b stay apart; with `last`, up to the merge of that rank, which joins them."""
        rank, made, parts = self.rank, self.made, self.parts
        x, y, x_taken, y_taken = a, b, None, None  # rank of the merge that takes x, y into its parent
        if last is not None:
            x_taken = y_taken = last
        top = last is not None
        while True:
            m = None if top else rank.get((x, y))
            top = False
            if m is not None and (x_taken is None or m < x_taken) and (y_taken is None or m <= y_taken):
                return False
            at_x, at_y = made.get(x, -1), made.get(y, -1)
            if at_x < 0 and at_y < 0:
                return True
            if at_x > at_y:
                x_taken, x = at_x, parts[x][1]
            else:
                y_taken, y = at_y, parts[y][0]

    def _suffixes(self) -> tuple[dict, dict]:
        """Automata over reversed tokens, for places inside a word and for its end; key "" holds the token's id."""
        inner: dict = {}
        final: dict = {}
        for t in self.whole:
            text = self.tokens[t]
            if self.special.get(text) == t:
                continue
            root = inner
            if self.end and text.endswith(self.end):
                root, text = final, text[: -len(self.end)]
            elif not self.end:
                root = inner
            node = root
            for c in reversed(text):
                node = node.setdefault(c, {})
            node[""] = t
        return inner, final if self.end else inner

    def encode_words(self, words: Iterable[str]) -> Iterator[list[int]]:
        """Ids of words that are given as byte letters. Sorted words go faster: what is known of a common start is kept."""
        last, size, before = [-1], [0], ""
        pairs, meets, (inner, final) = self._pairs, self._meets, self.automata
        for s in words:
            n, k = len(s), 0
            most = min(n, len(before)) - 1  # the end's symbol is another one than the same letter inside a word
            while k < most and s[k] == before[k]:
                k += 1
            del last[k + 1 :], size[k + 1 :]
            before = s
            for j in range(k + 1, n + 1):
                node, i = (final if j == n else inner), j
                found = []
                while i:
                    i -= 1
                    node = node.get(s[i])
                    if node is None:
                        break
                    t = node.get("")
                    if t is not None and last[i] != -2:
                        found.append((i, t))
                got = -2
                for i, t in reversed(found):
                    if not i:
                        got = t
                        break
                    a = last[i]
                    key = a << 17 | t
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) >= CACHE_PAIRS:
                            pairs.clear()
                        ok = pairs[key] = meets(a, t)
                    if ok:
                        got = t
                        break
                last.append(got)
                size.append(j - i)
            out, j = [], n
            while j:
                out.append(last[j])
                j -= size[j]
            out.reverse()
            yield out

    def encode_word(self, s: str) -> list[int]:
        return next(self.encode_words([s]))

    def spelled(self, word: str) -> str:
        return "".join(map(self.table.__getitem__, word.encode("utf-8")))

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens, as written."""
        if _NOT_PLAIN.search(text) is None:
            return _FAST.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def plain(self, text: str) -> bool:
        return _NOT_PLAIN.search(text) is None

    def segments(self, text: str) -> list[str]:
        if self.special_split is None or not any(t in text for t in self.special):
            return [text]
        return [x for x in self.special_split.split(text) if x]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.segments(text):
            if part in self.special:
                out.append(self.special[part])
                continue
            plain = self.plain(part)
            for w in self.pieces(part):
                out += self.encode_word(self.spelled(w) if plain else w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens, special ones too, joined by a space: this vocabulary's file names no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class Digests:
    """Counts and digests of texts; the written ids and tokens of a run without white space are made once while the
    worker remembers them. When the table of runs is full it becomes the old one, from which those in use move on to the new one."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe
        self.words: dict[str, tuple[str, str, int]] = {}
        self.old: dict[str, tuple[str, str, int]] = {}

    def _learn(self, runs: Iterable[str]) -> None:
        """Runs are split into words, and all new words are encoded in sorted order."""
        new = set(runs).difference(self.words)
        if not new:
            return
        if len(self.words) + len(new) > CACHE_WORDS:
            self.old, self.words = self.words, {}
            new = set(runs)
        old, bpe = self.old, self.bpe
        for r in [r for r in new if r in old]:
            self.words[r] = old[r]
            new.discard(r)
        split = {r: [bpe.spelled(w) for w in _FAST.findall(r)] for r in new}
        words = sorted({w for ws in split.values() for w in ws})
        known = {w: (" ".join(map(str, ids)), bpe.decode(ids), len(ids)) for w, ids in zip(words, bpe.encode_words(words), strict=True)}
        for r, ws in split.items():
            got = [known[w] for w in ws]
            self.words[r] = got[0] if len(got) == 1 else (" ".join(g[0] for g in got), " ".join(g[1] for g in got), sum(g[2] for g in got))

    def batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """of() for many texts, whose new runs are learned together, at most some AHEAD letters at a time."""
        out: list[tuple[int, str, str]] = []
        first = held = 0
        for k, t in enumerate(texts):
            held += len(t)
            if held >= AHEAD or k + 1 == len(texts):
                plain = [p for x in texts[first : k + 1] for p in self.bpe.segments(x) if p not in self.bpe.special and self.bpe.plain(p)]
                self._learn({r for p in plain for r in p.lower().split()})
                out += map(self.of, texts[first : k + 1])
                first, held = k + 1, 0
        return out

    def of(self, text: str) -> tuple[int, str, str]:
        bpe, n = self.bpe, 0
        ids: list[str] = []
        toks: list[str] = []
        for part in bpe.segments(text):
            if part in bpe.special:
                ids.append(str(bpe.special[part]))
                toks.append(part)
                n += 1
            elif bpe.plain(part):
                runs = part.lower().split()  # no word holds white space, so runs without it can be encoded alone
                if runs:
                    try:
                        got = list(map(self.words.__getitem__, runs))
                    except KeyError:
                        self._learn(runs)
                        got = list(map(self.words.__getitem__, runs))
                    a, b, c = zip(*got, strict=True)
                    ids += a
                    toks += b
                    n += sum(c)
            else:
                for w in bpe.pieces(part):
                    got = bpe.encode_word(w)
                    n += len(got)
                    ids += map(str, got)
                    toks.append(bpe.decode(got))
        return n, hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(toks).encode("utf-8")).hexdigest()


_LOADED: dict[str, Digests] = {}


def _digests(path: str) -> Digests:
    if path not in _LOADED:
        _LOADED[path] = Digests(Bpe(path))
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with an array of ids for each text."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _digests(path).bpe
        for texts in parts:
            yield pd.Series([bpe.encode(t or "") for t in texts], dtype=object)

    return docs.withColumn(out, encode(F.col(text)))


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the decoded text of each array of ids."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _digests(path).bpe
        for rows in parts:
            yield pd.Series([bpe.decode(list(r)) if r is not None else "" for r in rows], dtype=object)

    return docs.withColumn(out, decode(F.col(ids)))


def encoding_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the texts encoded and decoded word by word, only digests leave the workers."""
    ship(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        batch = _digests(path).batch
        for texts in parts:
            out = pd.DataFrame(batch([t or "" for t in texts]), columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            del texts
            yield out
        give_back()

    name = "_digest"
    return docs.select(F.col(doc_id), digest(F.col(text)).alias(name)).select(doc_id, f"{name}.*")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
