"""Whole operators against brute force, and the cases that every operator defines: clashing names, empty tables, repeated rows, long texts."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from test_operators import DOCS, brute_fp, brute_lines, brute_repeat, classes, docs, prose
from vaultlens.llm import bpe, chat, common, decontam, langid, linededup, quality, queries, simhash, tokenbin, toxicity, urlfilter

# SimHash


def test_simhash_query_is_brute_force(spark, sf):
    """Every document of a small table: fingerprints, and components over all pairs."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {d: brute_fp(t) for d, t in texts.items()}
    want = classes([(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 3], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, sf).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_simhash_fine_buckets_are_bounded():
    """Finer keys leave 12 bits free, so equal kept bits admit 4,096 fingerprints; every choice of three differing parts has a key."""
    masks = [m % (1 << 64) for m in simhash._masks(simhash.FINE)]
    assert {64 - m.bit_count() for m in masks} == {12} and len(masks) == 560
    rng = random.Random(1)
    for _ in range(200):
        flip = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not flip & m for m in masks)


def test_simhash_chunks_and_clashes(spark):
    """More shingles than are spread out at a time; names of helper columns in the input."""
    rng = random.Random(2)
    long = prose(rng, simhash._CHUNK + 3, [f"w{k}" for k in range(50)])
    assert simhash.fingerprint(long) == brute_fp(long)
    rows = [(2, "one two three four", "x", 1, 2), (1, "one two three four", "y", 3, 4), (3, "quite another text here", "z", 5, 6)]
    df = docs(spark, rows, DOCS + ", _id string, _t long, _gone long")
    out = simhash.deduplicated(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(rows[1:])
    assert {r.id: r.component for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


# Language ID


def cuts(word, pieces):
    """All ways to cut a word into pieces; a letter that isn't one stands for any other."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces or k == 1:
            for rest in cuts(word[k:], pieces):
                yield [word[:k] if word[:k] in pieces else None, *rest]


def test_language_fit_and_score_are_brute_force(spark, monkeypatch):
    pieces = ["a", "b", "ab", "ba", "aba", "bb"]
    monkeypatch.setattr(langid, "vocabulary", lambda path: pieces)
    rng = random.Random(3)
    rows = [(k, " ".join("".join(rng.choice("aab" if k % 2 else "abbc") for _ in range(rng.randint(1, 6))) for _ in range(9)), "xy"[k % 2]) for k in range(12)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "none")
    prob = {}
    for lang in "xy":
        words = [w for _, t, own in rows if own == lang for w in t.split()]
        p = dict.fromkeys([None, *pieces], 1 / (len(pieces) + 1))
        for _ in range(langid.ROUNDS):
            count = dict.fromkeys(p, 0.05)
            for w in words:
                ways = [(c, np.prod([p[x] for x in c])) for c in cuts(w, pieces)]
                total = sum(v for _, v in ways)
                for c, v in ways:
                    for x in c:
                        count[x] += v / total
            p = {k: v / sum(count.values()) for k, v in count.items()}
        prob[lang] = p
    assert model.langs == ["x", "y"]
    assert np.allclose(model.prob, [[prob[lang][x] for lang in "xy"] for x in [None, *pieces]])

    def score(text, lang):
        return sum(np.log(sum(np.prod([prob[lang][x] for x in c]) for c in cuts(w, pieces))) for w in re.findall("[a-z]+", text.lower()))

    texts = ["AB ab, a-b", "abbc cc", "bab", "c", "aaaaaaaaaaa bbbbb"]
    got = langid.identify(docs(spark, list(enumerate(texts))), model).collect()
    for r in got:
        both = np.array([score(texts[r.doc_id], lang) for lang in "xy"])
        share = np.exp(both - both.max()) / np.exp(both - both.max()).sum()
        assert r.lang_pred == "xy"[int(both.argmax())] and abs(r.score - share.max()) < 1e-9


@pytest.mark.parametrize("stretch", [3, 512])
def test_long_words_are_summed_over_all_segmentations(monkeypatch, stretch):
    monkeypatch.setattr(langid, "STRETCH", stretch)
    pieces = ["a", "b", "ab", "ba", "aba", "abababababababababababababab"]
    known, prob = langid.Pieces(pieces), np.random.default_rng(1).dirichlet(np.ones(7), 2).T
    words = ["ab" * 13, "abcba" * 12, "b" * 30, "a", "ab" * 200]

    def brute(w, k):
        alpha = [0.0] + [-np.inf] * len(w)
        for j in range(1, len(w) + 1):
            for n in range(1, min(j, 28) + 1):
                x = pieces.index(w[j - n : j]) + 1 if w[j - n : j] in pieces else 0
                if x or n == 1:
                    alpha[j] = np.logaddexp(alpha[j], alpha[j - n] + np.log(prob[x, k]))
        return alpha[-1]

    want = [[brute(w, k) for k in range(2)] for w in words]
    assert np.allclose(langid.long_totals(words, known, np.log(prob)), want)
    assert np.allclose(langid.Model(["x", "y"], pieces, prob).log_probs(words), want)


def test_language_edges(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    en, de = "the river and the stone walk under blue rain", "der fluss und die steine gehen unter blauem regen"
    rows = [(k, en if k % 2 else de, "en" if k % 2 else "de") for k in range(10)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path)
    df = docs(spark, [(1, "² ½ Ⅷ ① ٣", "k", 0.5), (2, en, "k", 0.5), (2, en, "k", 0.5), (3, "´ 12", "k", 0.5)], DOCS + ", _judged string, score double")
    got = langid.identify(df, model).collect()
    assert [(r.doc_id, r.lang_pred, r._judged) for r in got] == [(1, "und", "k"), (2, "en", "k"), (2, "en", "k"), (3, "und", "k")] and got[1].score == got[2].score
    assert langid.identify(df.limit(0), model).count() == 0
    many = spark.createDataFrame([(k, "x", f"l{k}") for k in range(langid.MAX_LANGS + 1)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(many, path)


# Toxicity


def small_model(monkeypatch, seed=1):
    monkeypatch.setattr(toxicity, "DIM", 3)
    monkeypatch.setattr(toxicity, "FILTERS", 4)
    m = toxicity.Model(seed)
    for w in toxicity.WIDTHS:
        m.bias[w] += np.random.default_rng(w).normal(0, 0.1, 4).astype(np.float32)
    m.emb[:-1] *= 20
    return m


def slow_features(m, embedded, doc):
    """Each filter at each place, one number at a time; windows may hang over the end, where nothing is added."""
    out = []
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            seen = [sum(float(embedded[doc[s + k]] @ m.filters[w][k][:, f]) for k in range(w) if s + k < len(doc)) for s in range(len(doc))]
            out.append(max(0.0, max(seen) + float(m.bias[w][f])) if seen else 0.0)
    return out


def test_convolution_is_brute_force(monkeypatch):
    m, lexicon, rng = small_model(monkeypatch), toxicity.Lexicon(), random.Random(4)
    texts = [[], ["one"], ["a", "b"], *(prose(rng, n).split() for n in (3, 9, 40))]
    rows = [lexicon.rows(t) for t in texts]
    embedded = m.embedded(lexicon.subs)
    want = [slow_features(m, embedded, r) for r in rows]
    assert np.allclose(m.features(rows, embedded, m.weights()), want, atol=1e-4)
    p = 1 / (1 + np.exp(-(np.array(want) @ m.out + m.base)))
    monkeypatch.setattr(toxicity, "STRIDE", 7)  # long texts go in parts
    assert np.allclose(m.raw(rows, embedded), p, atol=1e-4)


def test_step_follows_the_gradient(monkeypatch):
    """One step against the numeric gradient of the loss: Adagrad's first step has the gradient's sign and a length that the gradient gives."""
    m, lexicon, rng = small_model(monkeypatch, 3), toxicity.Lexicon(), random.Random(5)
    rows = [lexicon.rows(prose(rng, n).split()) for n in (4, 6, 9)]
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = m.raw(rows, m.embedded(lexicon.subs)).astype(float)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * weight).sum() / 3)

    spots = [(m.out, 2, 1e-4 * m.out[2]), (m.bias[1], 1, 0), (m.filters[2], (1, 2, 3), 0), (m.filters[3], (0, 1, 2), 0), (m.emb, (int(lexicon.subs[rows[0][0]][0]), 1), 0)]
    slopes = []
    for a, at, more in spots:
        a[at] += 1e-2
        up = loss()
        a[at] -= 2e-2
        slopes.append((up - loss()) / 2e-2 + more)
        a[at] += 1e-2
    before = [a[at] for a, at, _ in spots]
    m._step(rows, lexicon.subs, y, weight, {}, 0.05)
    for g, b, (a, at, _) in zip(slopes, before, spots, strict=True):
        assert abs((a[at] - b) + 0.05 * g / np.sqrt(1e-4 + g * g)) < 4e-3, (g, a[at] - b)


def test_threshold_is_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(20):
        p, y = 0.1 + 0.8 * rng.random(40), (rng.random(40) < 0.4).astype(float)  # thresholds stay within 0.02 and 0.98
        if min(y.sum(), 40 - y.sum()) < 5:
            continue

        def f1(cut, p=p, y=y):
            return 2 * y[p >= cut].sum() / ((p >= cut).sum() + y.sum())

        assert abs(f1(toxicity.Model._threshold(p, y, 0.5)) - max(f1(c) for c in p)) < 1e-12
    assert toxicity.Model._threshold(np.array([0.1, 0.9]), np.array([0.0, 1.0]), 0.5) == 0.5
    m = toxicity.Model()
    m.cuts = {"": 0.5, "en": 0.8}
    assert np.allclose(m.stretched(np.array([0.5, 0.8, 0.4, 1.0, 0.0]), ["", "en", "en", "", "de"]), [0.3, 0.3, 0.15, 1.0, 0.0])


def test_toxicity_edges(spark):
    rng = random.Random(7)
    rows = [(k, prose(rng, 30) + (" vileness" if k % 2 else "")) for k in range(80)] + [(200, "vileness " + prose(rng, 5000)), (200, "rain")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(0, 1), (0, 0), (200, 1), (None, 1)], "doc_id long, toxic int")
    one, two = (toxicity.fit(docs(spark, rows), x) for x in (labels, labels.orderBy(F.desc("doc_id"), "toxic").repartition(3)))
    assert (one.emb == two.emb).all() and one.cuts == two.cuts  # contradictory labels don't make fits differ
    df = docs(spark, [(1, "x", 9), (1, "x", 9)], DOCS + ", score int")
    out = toxicity.score_texts(df, one)
    assert out.columns == df.columns and len({r.score for r in out.collect()}) == 1
    assert toxicity.score_texts(df.limit(0), one).count() == 0


# URLs


def test_joined_rules_are_the_trie(spark, monkeypatch):
    rng = random.Random(8)
    labels, parts = ["a", "b", "com", "net", "x1"], ["", "x", "xy", "long", "q"]
    made = [(".".join(rng.choice(labels) for _ in range(rng.randint(1, 3))), "/" * rng.randint(0, 1) + "/".join(rng.choice(parts) for _ in range(rng.randint(0, 3)))) for _ in range(150)]
    rules = [urlfilter.UrlRule(h.upper() if k % 7 == 0 else h, p, rng.choice(["allow", "block"])) for k, (h, p) in enumerate(made)]
    urls = [None, "", "nothing", "http:///x"] + [f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randint(1, 4)))}/{'/'.join(rng.choice(parts) for _ in range(rng.randint(0, 4)))}" for _ in range(300)]
    df = spark.createDataFrame([(k, u, "mine", 1) for k, u in enumerate(urls)] + [(0, None, "mine", 1)], "page_id long, url string, _judged string, _host int")
    plain = sorted(map(str, urlfilter.url_verdicts(spark, df, "url", rules, "block").collect()))
    monkeypatch.setattr(urlfilter, "MAX_RULES", 3)
    joined = urlfilter.url_verdicts(spark, df, "url", rules, "block")
    assert sorted(map(str, joined.collect())) == plain and len(plain) == len(urls) + 1
    assert urlfilter.url_verdicts(spark, df.limit(0), "url", rules).count() == 0
    assert {r.verdict for r in urlfilter.url_verdicts(spark, df, "url", []).collect()} == {"allow"}


def test_many_paths_of_one_host_are_looked_up(spark):
    trie = urlfilter.Trie([urlfilter.UrlRule("h.com", f"/p{k}", "block") for k in range(50_000)])
    assert trie.find("h.com", "/p49999/x") == ("h.com/p49999", "block") and trie.find("h.com", "/q") is None
    assert trie.root["com"]["h"][""][""][0] == [6, 5, 4, 3, 2]  # one lookup for each length
    long = docs(spark, [(1, "http://h.com/" + "a/" * 100_000)], "page_id long, url string")
    assert urlfilter.url_verdicts(spark, long, "url", [urlfilter.UrlRule("com", "/a/a", "block")]).first().verdict == "block"


# Chat


def test_long_conversation_spans(spark):
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["", "é" * k, "<|x", "plain words"])) for k in range(300)]
    df = spark.createDataFrame([(*r, "z", 5) for r in rows], "conv_id long, turn long, role string, text string, formatted string, ts int")
    out = chat.format_chats(df)
    r = out.select("formatted", "loss_spans", chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), chat.read_turns(F.col("formatted")).alias("ts")).first()
    assert r.loss == "".join(t for _, _, role, t in rows if role == "assistant")
    assert [(t.role, t.text) for t in r.ts] == [x[2:] for x in rows]
    raw = r.formatted.encode()
    assert [raw[s.start : s.start + s.length].decode().replace("\\c", "<|") for s in r.loss_spans] == [t for _, _, role, t in rows if role == "assistant" and t]


# Decontamination and line dedup


def test_contained_edges(spark):
    item = "a b c d e f g"
    rows = [(2, f"x {item} y", 1, 2), (2, "clean text of its own", 3, 4), (3, "word " * 30_000 + item, 5, 6), (2, f"x {item} y", 1, 2)]
    df, items = docs(spark, rows, DOCS + ", _held long, _t long"), spark.createDataFrame([(7, item), (8, item), (9, "p q")], "item_id long, text string")
    assert sorted(tuple(r) for r in decontam.contained(df, items).collect()) == [(2, 7, 3, 3), (2, 8, 3, 3), (3, 7, 3, 3), (3, 8, 3, 3)]
    left = decontam.decontaminated(df, items)
    assert left.columns == df.columns and [tuple(r) for r in left.collect()] == [rows[1]]
    assert decontam.contained(df.limit(0), items).count() == 0


def test_sizes_are_searched_apart(spark):
    """A short item's probes don't meet a long one's sketches, and every size finds its own."""
    rng, vocab = random.Random(10), [f"w{k}" for k in range(3000)]
    items = [(n, prose(rng, n, vocab)) for n in (2, 5, 6, 8, 12, 20, 40, 90, 200, 700)]
    rows = [(k, prose(rng, 50, vocab) + " " + t + " " + prose(rng, 50, vocab)) for k, t in items if k >= 5] + [(2, items[0][1])]
    got = {(r.doc_id, r.item_id) for r in decontam.contained(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k, _ in items}


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_results_do_not_depend_on_broadcasts(spark, sf, monkeypatch, limit):
    """Both sides of every choice between broadcast and shuffle, against brute force."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    rng = random.Random(11)
    lines = [prose(rng, rng.randint(3, 8), ["a", "b", "c"]) for _ in range(30)]
    rows = [(d, "\n".join(rng.choice(lines) for _ in range(4))) for d in range(25)]
    assert {(r.d, r.i) for r in linededup.removals(docs(spark, rows)).collect()} == brute_lines(rows)
    out = linededup.dedup_lines(docs(spark, rows)).collect()
    assert sum(r.n_removed for r in out) == len(brute_lines(rows))
    items = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    assert 0 not in {r.doc_id for r in decontam.decontaminated(docs(spark, rows), items).collect()}
    assert simhash.deduplicated(docs(spark, rows + rows[:5])).count() == len(simhash.near_duplicates(docs(spark, rows)).select("component").distinct().collect())


def test_line_dedup_stores_few_files(spark, monkeypatch):
    """A large aggregation that leaves few rows is not stored as a file for each of its partitions."""
    parts, store = [], common.cut

    def counted(df):
        out = store(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(common, "cut", counted)
    rng = random.Random(5)
    rows = [(d, "\n".join(prose(rng, 8, [f"w{k}" for k in range(300)]) for _ in range(20))) for d in range(100)]
    rows.append((100, rows[0][1]))
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    kept = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {(r.d, r.i) for r in linededup.removals(docs(spark, rows)).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {(100, i) for i in range(20)}
    assert len(parts) == 4 and max(parts[0], parts[2]) <= 6, parts


# BPE and token files


def test_encoders_ignore_extra_columns(spark):
    path, rows = public_tokenizers.path("word_bpe_49k.json"), [(1, "Hello there", 5, 6), (1, "Hello there", 5, 6), (2, None, 7, 8)]
    df = docs(spark, rows, DOCS + ", n_tokens long, _digest long")
    lib = Tokenizer.from_file(path)
    ids = lib.encode("Hello there", add_special_tokens=False).ids
    got = bpe.encoding_digests(df, path).collect()
    assert [(r.doc_id, r.n_tokens, r.ids_sha256) for r in got[:2]] == [(1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] * 2
    assert bpe.encode_texts(df, path).columns == [*df.columns, "ids"]
    tokens = tokenbin.read_tokens(tokenbin.write_tokens(df.withColumn("h", F.lit("x")).withColumn("start", F.lit(3)), public_tokenizers.path("byte_bpe_50k.json"), 50_257, 0))
    assert sorted(r.doc_id for r in tokens.collect()) == [1, 1, 2]


def test_token_checksums(spark, sf):
    """ids_crc32, starts and counts of every document of a small table, made with the library alone."""
    lib, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    lib.no_truncation()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_binary(spark, sf).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    for d, t in rows:
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes())), d
        at += len(ids)
    assert len(got) == len(rows)


def test_plain_runs_are_split_without_the_library():
    """Of plain texts only words go to the library, to its model; ids and tables are as if it had split them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, lib = tokenbin.Encoder(path), Tokenizer.from_file(path)
    texts = ["Don't we'll, it's' ''s _a_b x2y 33% l'été, c'est-à-dire.%%% naïve", " lead\nÀ la\ncarte! $5,00 'tis 'RE", "tail " + prose(random.Random(8), 200)]
    own.runs.update((r, own._ids(r)) for r in ("", "\n", " "))
    own.library = None
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_whole_bytes_are_packed_as_bits_are(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype("<u4")
    rows = np.unpackbits(x.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    assert tokenbin.pack(x, bits) == np.packbits(rows.reshape(-1), bitorder="little").tobytes()
    assert (tokenbin.unpack(tokenbin.pack(x, bits), bits, len(x)) == x).all() and not len(tokenbin.unpack(b"", bits, 0))


def test_workers_give_memory_back(spark, monkeypatch, tmp_path):
    """What a task's texts took is the system's again when the task ends, not when the worker goes."""
    mark, path = str(tmp_path / "given"), public_tokenizers.path("word_bpe_49k.json")

    def noted():
        open(mark, "a").close()

    monkeypatch.setattr(bpe, "give_back", noted)
    bpe.encoding_digests(docs(spark, [(1, "Hello there")]), path).collect()
    assert (tmp_path / "given").exists()

    def held():
        return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Private_Dirty")) / 1024

    texts = [bytes(600) for _ in range(200_000)]
    pins = texts[::1000] + [bytes(600)]
    del texts
    before = held()
    common.give_back()
    assert held() < before - 60 and len(pins) == 201


# Quality


def test_quality_filter_is_the_verdict(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = docs(spark, [(-1, None), (-2, ""), (-3, "The " * 80), (-3, "The " * 80), (-4, prose(random.Random(1), 70).title())])
    both = df.unionByName(odd)
    kept = sorted((r.doc_id, r.text) for r in quality.judged(both).where("kept").collect())
    assert sorted((r.doc_id, r.text) for r in quality.quality_filter(both).collect()) == kept
    assert {r.rule: r.n for r in quality.rejections(both).collect()}["too_short"] >= 2


def test_quality_filter_splits_a_text_once(spark):
    """The optimiser leaves the verdict whole: one split into words, one into lines."""
    plan = quality.quality_filter(docs(spark, [(1, "x")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2, plan


def test_common_folders_are_released(spark):
    import os

    mark = common.made()
    t = common.stored(spark.range(3))
    path = t.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert t.count() == 3 and os.path.isdir(path)
    common.release(spark, mark)
    assert not os.path.exists(path) and common.made() == mark


def test_stop_words_ignore_case(spark):
    got = quality.judged(docs(spark, [(1, "The AND, of zzz Of. É")])).first()
    assert got.n_words == 6 and brute_repeat("The AND, of zzz Of. É".split()) == got.n_repeat_words
    names = quality.measured(docs(spark, [(1, "The AND, of zzz Of. É")]))[0].first()
    assert names.n_stop_words == 4
