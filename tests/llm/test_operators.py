"""Operators of the subpackage: brute force, round trips and the edge cases that their docstrings define."""

import hashlib
import io
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vaultlens.llm import bpe, chat, components, decontam, langid, linededup, quality, simhash, tokenbin, toxicity, urlfilter

DOCS = "doc_id long, text string"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def prose(rng, n, words=None):
    words = words or ["the", "of", "and", "rain", "stone", "river", "walks", "under", "blue", "to", "in", "letter", "seven"]
    return " ".join(rng.choice(words) for _ in range(n))


# Quality


def brute_repeat(ws):
    where = {}
    for i in range(len(ws) - 2):
        where.setdefault(tuple(ws[i : i + 3]), []).append(i)
    return len({i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)})


def test_quality_measures(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "a b", "a a a a", "x y z x y z", "l1 w\nl1 w\n\n l1 w", "#*$ <b>", "é\u00a0ü  z"] + [prose(rng, n, ["a", "b", "c"]) for n in (3, 7, 40, 400)] + ["word " * 60_000]
    out = {r.doc_id: r for r in quality.judged(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        ws = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(ws), sum(map(len, ws)), brute_repeat(ws)), t and t[:30]
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(ws) < 50 or 100 * brute_repeat(ws) > 50 * len(ws))
        assert not (r.kept and r.base_failed)


def test_quality_filter_keeps_columns_and_clashes(spark):
    df = docs(spark, [(1, prose(random.Random(1), 80), 5), (2, "no", 6)], "doc_id long, text string, n_words int")
    out = quality.quality_filter(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] in ([1], [])
    assert quality.quality_filter(df.limit(0)).count() == 0


# SimHash


def brute_fp(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    rng = random.Random(5)
    for t in [None, "", "A", "a B", "A b C", "É ß x y", prose(rng, 500)]:
        assert simhash.fingerprint(t) == brute_fp(t)


@pytest.mark.parametrize("bucket", [2048, 4])
def test_links_are_whole(spark, monkeypatch, bucket):
    """Also with tiny buckets, when nodes go through the finer ones."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for base in fps[:6]:
        for _ in range(12):
            x = rng.choice([base, fps[-1]])
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, id long")
    got = {r.node: r.component for r in components.components(simhash.links(nodes)).collect()}
    want = classes([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], range(len(fps)))
    assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_near_duplicates_edges(spark):
    t = prose(random.Random(8), 300)
    rows = [(5, t), (3, t), (9, None), (8, ""), (4, "a b"), (4, "a b"), (None, "solo text here")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.id: r.component for r in got if r.id is not None} == {5: 3, 3: 3, 9: 8, 8: 8, 4: 4}
    kept = simhash.deduplicated(docs(spark, rows))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 4), (False, 8), (True, 0)]
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_near_duplicates_shared_ids(spark):
    """One row of each component stays, whether ids repeat or are missing."""
    rng = random.Random(13)
    a, b, c, d, e, f = (prose(rng, 200) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (1, c), (2, c), (2, d), (3, e), (None, e), (4, f), (4, f), (None, None)]
    kept = simhash.deduplicated(docs(spark, rows)).collect()
    assert sorted((r.text or "", r.doc_id or 0) for r in kept) == sorted([(a, 0), (b, 0), (c, 1), (d, 2), (e, 3), (f, 4), ("", 0)])
    near = next(t for k in range(1000) if 0 < (simhash.fingerprint(a) ^ simhash.fingerprint(t := f"{a} {k}")).bit_count() <= simhash.MAX_BITS)
    assert simhash.deduplicated(docs(spark, [(None, a), (None, near), (None, b)])).count() == 2


# BPE


@pytest.fixture(scope="module")
def word_bpe():
    path = public_tokenizers.path("word_bpe_49k.json")
    return path, bpe.Bpe(path), Tokenizer.from_file(path)


def odd_texts(n, seed):
    rng = random.Random(seed)
    units = ["the", "'s", "'re", "<|endoftext|>", "<|startoftext|>", "aaaa", "hello", "  ", "\n", "123", "__", "!!", *"aaabcdethernoi 'ÉéßäÀΣςİIıſK\u0301\u00a0\x85\x1c²½Ⅷ٣漢🙂\u200bªºµ·_-.,"]
    return ["".join(rng.choice(units) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def test_bpe_is_the_library(word_bpe):
    _, own, lib = word_bpe
    digests = bpe.Digests(own)
    rng = random.Random(2)
    for t in odd_texts(3000, 1) + ["".join(rng.choice("aaeinrstohdl") for _ in range(k)) for k in range(1, 120)]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert digests.of(t) == want


def test_bpe_small_tables(word_bpe, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 7)
    _, own, lib = word_bpe
    texts = [prose(random.Random(k), 40) for k in range(5)] + [None and "", "x" * 3000]
    d = bpe.Digests(own)
    for t, got in zip(texts, d.batch([t or "" for t in texts]), strict=True):
        assert got[0] == len(lib.encode(t or "", add_special_tokens=False).ids)


def test_bpe_frames(spark, word_bpe):
    path, own, lib = word_bpe
    df = docs(spark, [(1, "Hello world's end"), (2, None), (3, "")])
    enc = bpe.encode_texts(df, path)
    assert {r.doc_id: r.ids for r in enc.collect()} == {1: lib.encode("Hello world's end", add_special_tokens=False).ids, 2: [], 3: []}
    assert {r.doc_id: r.decoded for r in bpe.decode_ids(enc, path).collect()}[1] == lib.decode(lib.encode("Hello world's end", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encoding_digests(df.limit(0), path).count() == 0


# Chat


def test_chat_round_trip(spark):
    hostile = ["\\### Assistant: </turn> ok", "<|turn|>user<|text|>x<|end|>\n", "<<||", "\\s\\c\\\\", "é🙂", "", None, "a\nb", "<|"]
    rows = [(1, k, role, t) for k, (role, t) in enumerate(zip(["user", "assistant", "assistant", "user", "assistant", "<|odd", "\\c", "user", "assistant"], hostile, strict=True))]
    rows += [(2, None, "user", "first"), (2, 1, None, "x"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("ts"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].ts] == [(r[2], r[3] or "") for r in rows[:9]]
    assert got[1].loss == "".join(r[3] or "" for r in rows[:9] if r[2] == "assistant")
    assert [(t.role, t.text) for t in got[2].ts] == [("user", "first"), ("", "x"), ("assistant", "y"), ("assistant", "y")]
    assert got[1].formatted.count("<|turn|>assistant") == 3  # two neighbours share one header
    assert [(t.role, t.text) for t in got[None].ts] == [("user", "z")]
    assert chat.format_chats(df.limit(0)).count() == 0


# Language ID


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba"]
    prob = np.array([[0.01], [0.3], [0.2], [0.1], [0.25], [0.05]])
    of = {p: prob[k + 1, 0] for k, p in enumerate(pieces)}

    def brute(w):
        return 1.0 if not w else sum((of.get(w[:k]) or (0.01 if k == 1 else 0)) * brute(w[k:]) for k in range(1, len(w) + 1))

    words = ["a", "ab", "abab", "bcab", "ababababab"]
    got = langid.Lattice(words, langid.Pieces(pieces)).totals(prob)[:, 0]
    assert np.allclose(got, [brute(w) for w in words])


def test_languages(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    en, de = "the river and the stone walk under blue rain", "der fluss und die steine gehen unter blauem regen"
    rows = [(k, en if k % 2 else de, "en" if k % 2 else "de") for k in range(40)] + [(90, None, "en"), (91, en, None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path)
    test = docs(spark, [(1, "The stone walks"), (2, "die STEINE gehen"), (3, None), (4, ""), (5, "123 !!"), (6, "漢字"), (7, "the " * 400_000), (8, "x" * 5000)])
    got = {r.doc_id: r for r in langid.identify(test, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[6].lang_pred in ("en", "de")
    none = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"), path)
    assert {r.lang_pred for r in langid.identify(test, none).collect()} == {"und"}


# Line dedup


def brute_lines(rows, least=5):
    first = {}
    for d, t in rows:
        for i, line in enumerate(t.split("\n")):
            w = tuple(line.split())
            if w:
                first[w] = min(first.get(w, (d, i)), (d, i))

    def near(x, y):
        if max(len(x), len(y)) < least or abs(len(x) - len(y)) > 1:
            return False
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
        long, short = (x, y) if len(x) > len(y) else (y, x)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    gone = {x for x in first for y in first if first[y] < first[x] and near(x, y)}
    return {(d, i) for d, t in rows for i, line in enumerate(t.split("\n")) if (w := tuple(line.split())) and (first[w] != (d, i) or w in gone)}


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(11)
    lines = [prose(rng, rng.randint(1, 12), ["a", "b", "c", "d", "ee"]) for _ in range(60)]
    lines += [prose(rng, 30) for _ in range(4)]
    for line in lines[-4:]:
        ws = line.split()
        for k in (0, 15, 29):
            lines += [" ".join(ws[:k] + ["new"] + ws[k + 1 :]), " ".join(ws[:k] + ws[k + 1 :]), " ".join(ws[:k] + ["more"] + ws[k:])]
    rows = [(d, "\n".join(rng.choice(lines) + rng.choice(["", " "]) for _ in range(rng.randint(0, 6)))) for d in range(60)]
    got = {(r.d, r.i) for r in linededup.removals(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_edges(spark):
    one = "one two three four five six"
    rows = [(1, f"{one}\n\n{one}"), (2, None), (3, ""), (4, " \n "), (5, f"tail\n{one.replace('six', 'seven')}"), (7, "word " * 3000), (8, "word " * 3001)]
    df = docs(spark, [(d, t, 9) for d, t in rows], "doc_id long, text string, n_lines int")
    out = linededup.dedup_lines(df)
    got = {r[0]: r for r in out.collect()}
    assert [got[d].text for d in (1, 2, 3, 4, 5, 8)] == [f"{one}\n", None, "", " \n ", "tail", ""]
    assert got[7].text == "word " * 3000 and set(df.columns) < set(out.columns)
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    again = linededup.dedup_lines(docs(spark, [(1, "a b c"), (1, "a b c"), (None, "z z z")])).collect()
    assert [r.n_removed for r in again] == [0, 0, 0]


def test_line_dedup_shared_ids(spark):
    """A line goes only from rows that hold it, whether ids repeat or are missing; each of the lines at one place is searched."""
    near = "one two three four five six"
    rows = [(0, "copied line"), (1, "copied line"), (1, "unique line"), (5, near), (6, near.replace("six", "ten")), (6, "zz " + near), (6, "aa bb cc dd ee ff")]
    rows += [(None, f"clean {k}") for k in range(30)] + [(None, "x\nlast"), (None, "y\nlast"), (7, "last"), (8, "x")]
    out = linededup.dedup_lines(docs(spark, [(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, row int"))
    got = {r["row"]: (r.text, r.n_lines, r.n_removed) for r in out.collect()}
    gone = {1, 4, 5, len(rows) - 2, len(rows) - 1}
    assert got == {k: ("", 1, 1) if k in gone else (t, t.count("\n") + 1, 0) for k, (_, t) in enumerate(rows)}


# Decontamination


def test_containment_is_exact(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, prose(rng, n, vocab)) for k, n in enumerate([3, 5, 6, 9, 15, 40, 57])] + [(20, None), (21, " ")]
    rows = [(k, prose(rng, 60, vocab)) for k in range(30)] + [(100, None), (101, "")]
    for k, (i, t) in enumerate(items[:7]):
        ws = t.split()
        for cut in (0, 1, len(ws) // 4):
            rows.append((200 + 10 * k + cut, prose(rng, 20, vocab) + "\n" + " ".join(ws[cut:]).upper() + " " + prose(rng, 20, vocab)))
        rows.append((400 + k, t))

    def shingles(t):
        ws = (t or "").lower().split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    want = {(d, i, len(shingles(t) & s), len(s)) for d, t in rows for i, u in items if (s := shingles(u)) and 5 * len(shingles(t) & s) >= 4 * len(s)}
    got = {tuple(r) for r in decontam.contained(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and want
    left = decontam.decontaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    sets = [s for _, u in items if (s := shingles(u))]
    clean = [(d, t) for d, t in rows if not any(5 * len(shingles(t) & s) >= 4 * len(s) for s in sets)]
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, clean))  # 260 has a text that goes and one that stays
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained(docs(spark, rows), empty).count() == 0


def test_containment_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    got = decontam.contained(docs(spark, [(1, "x a b c d e f y")]), spark.createDataFrame([(7, "a b c d e f")], "item_id long, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, 7, 2, 2)]


def test_containment_of_null_ids(spark):
    """Rows without an id are searched and filtered each by its own text; items without an id are searched for."""
    one, two = "a b c d e f", "u v w x y z"
    rows = [(None, f"x {one} y"), (None, "nothing of it here at all"), (1, f"{two} q"), (2, "clean as can be so far")]
    items = spark.createDataFrame([(7, one), (None, two)], "item_id long, text string")
    got = decontam.contained(docs(spark, rows), items).collect()
    assert {tuple(r) for r in got} == {(None, 7, 2, 2), (1, None, 2, 2)} and len(got) == 2
    left = decontam.decontaminated(docs(spark, rows), items)
    assert {tuple(r) for r in left.collect()} == {rows[1], rows[3]}


# URLs


def test_url_trie_is_longest_match(spark):
    rng = random.Random(6)
    rules = [urlfilter.UrlRule(h, p, v) for h, p, v in [("com", "/", "allow"), ("a.com", "/x/", "block"), ("b.a.com", "/x/", "allow"), ("a.com", "/x/y/z", "allow"), ("net", "/q", "block"), ("com", "", "block")]]
    urls = [None, "", "nothing", "http://", "http://A.com/x/y", "x://a.com", "http://a.com?x/", "http://b.a.com#/x/", "http://n.net/quick", "http://com/", "http://.com/x/", "http://a.com./x/"]
    urls += [f"https://{rng.choice(['', 'b.', 'c.b.'])}{rng.choice(['a.com', 'net', 'z.org', 'A.COM'])}{rng.choice(['', '/', '/x', '/x/', '/x/y/zz', '/q?u=://'])}" for _ in range(60)]
    got = urlfilter.url_verdicts(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "url", rules).collect()
    for r in got:
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: (len(x.host), len(x.path)), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.host + best.path, best.verdict if best else "allow"), r.url
    with pytest.raises(ValueError):
        urlfilter.build_trie(rules, limit=3)


# Token files


@pytest.mark.parametrize("bits", [1, 7, 9, 16, 17, 25, 31])
def test_packing(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype("<u4")
    assert (tokenbin.unpack(tokenbin.pack(x, bits), bits, len(x)) == x).all()
    f = io.BytesIO()
    w = tokenbin.Writer(f, bits, block=64)
    parts = [x[:0], x[:1], x[1:300], x[300:300], x[300:]]
    for k, p in enumerate(parts):
        w.add(k, p)
    w.close()
    r = tokenbin.Reader(f)
    assert all((r.read(s, n) == p).all() for (_, s, n), p in zip(r.docs.tolist(), parts, strict=True))
    assert (r.read(290, 20) == x[290:310]).all()


def test_token_encoder_is_the_library(monkeypatch):
    monkeypatch.setattr(tokenbin, "CACHE_RUNS", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, lib = tokenbin.Encoder(path), Tokenizer.from_file(path)
    for t in odd_texts(3000, 9) + ["a b", "a\nb", " a", "a ", "\n", "don't we'll"]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_token_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(5, "five"), (1, None), (3, "three three"), (3, "other"), (9, ""), (None, "no id"), (7, "word " * 5000)]
    lib = Tokenizer.from_file(path)
    got = tokenbin.read_tokens(tokenbin.write_tokens(docs(spark, rows), path, 50_257, 0)).collect()
    assert len(got) == len(rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 1, 3, 3, 5, 7, 9]
    assert {r.doc_id: r.n_tokens for r in got}[7] == len(lib.encode("word " * 5000).ids) + 1
    assert tokenbin.read_tokens(tokenbin.write_tokens(docs(spark, rows).limit(0), path, 50_257, 0)).count() == 0


# Toxicity


def test_toxicity(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 2000)
    rng = random.Random(12)
    clean = [prose(rng, 60) for _ in range(160)]
    bad = [f"{prose(rng, 30)} vile{rng.choice(['est', 'ness', ''])} {prose(rng, 30)}" for _ in range(80)]
    rows = list(enumerate(clean + bad))
    labels = spark.createDataFrame([(i, int(i >= 160)) for i, _ in rows if i % 4], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    test = rows + [(900, None), (901, ""), (902, "the " * 3000 + "vileness"), (903, "rain of stone " * 2000)]
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs(spark, test), model).collect()}
    assert len(got) == len(test) and all(0 <= s <= 1 for s in got.values())
    held = [(got[i] >= 0.3) == (i >= 160) for i, _ in rows if i % 4 == 0]
    assert sum(held) / len(held) > 0.9
    assert got[902] >= 0.3 > got[903] and got[900] == got[901]
    one = toxicity.fit(docs(spark, rows), labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score_texts(docs(spark, test), one).collect()} == {0.0}
