"""The metadata query language and its operators against values derived by hand, plain Python and DuckDB."""

import struct

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultlens.functions import patterns, scalar
from vaultlens.functions.predicates import Op, matches, parse_int
from vaultlens.operators import export, hierarchy, integrity, intervals, metadata, sectors, tags
from vaultlens.plans import catalogue, planner
from vaultlens.plans.query import QueryError, parse
from vaultlens.sources import binary, model
from vaultlens.streaming import ingest


@pytest.mark.parametrize(
    "text, filters, any0, any1, any_group",
    [
        ("a = b", 1, False, False, False),
        ("NOT a EXISTS", 1, False, False, False),
        ('(a = x OR a = y) AND b N> "5"', 3, False, True, False),
        ('a BETWEEN "1" "3"', 1, False, False, False),
        ("a = x AND", 1, False, False, False),
        ("a = x OR (b = y AND c EXISTS)", 3, True, False, True),
        ("not = x", 1, False, False, False),
    ],
)
def test_accepts(text, filters, any0, any1, any_group):
    q = parse(text)
    assert (len(q.filters), q.any0, q.any1, q.any_group) == (filters, any0, any1, any_group)


@pytest.mark.parametrize("text", ["", "a = 1 AND b = 2 AND c = 3 AND d = 4 AND e = 5", "((a = x))", "(a = x) AND (b = y)", "a = x AND b = y OR c = z", 'a = "x', "(a = x", "a ~ x", "a = x b", "a = x)"])
def test_rejects(text):
    with pytest.raises(QueryError):
        parse(text)


def test_escapes_and_signs():
    assert parse('a I!= "q\\"\\\\x"').filters[0].value == 'q"\\x'
    assert parse("a n>= 5").filters[0].op == Op.NGE
    assert parse('a BETWEEN "1,2" "3"').filters[0].value == "1,2,3"
    assert parse("NOT * CONTAINS x").filters[0].negate


#: value, strtoll, whole integer
NUMBERS = [("", 0, False), ("7", 7, True), (" +7", 7, True), ("12abc", 12, False), ("abc", 0, False), ("-", 0, False), ("0x10", 0, False), ("1.9", 1, False), ("99999999999999999999", 2**63 - 1, True), ("-" + "9" * 45, -(2**63), True), ("0" * 45 + "42", 42, True), ("5-LOW", 5, False), ("-9223372036854775808", -(2**63), True)]


def test_strtoll(spark):
    df = spark.createDataFrame([(v,) for v, _, _ in NUMBERS], "v string").select("v", scalar.strtoll(F.col("v")).alias("n"), scalar.is_whole_int(F.col("v")).alias("w"))
    assert {r.v: (r.n, r.w) for r in df.collect()} == {v: (n, w) for v, n, w in NUMBERS}
    assert all(parse_int(v) == n for v, n, _ in NUMBERS)


#: key, value, operator, literal, expected in scan mode
TRUTH = [
    ("k", "Rock\nMetal", Op.EQ, "Metal", True), ("k", "Rock\nMetal", Op.NE, "Metal", False), ("k", "Rock\nMetal", Op.NE, "Pop", True),
    ("k", "1\n2", Op.NNE, "1", True), ("k", "a\n", Op.EQ, "", False), ("k", "\nRock\n", Op.EQ, "", True), ("k", "", Op.EQ, "", True),
    ("Comments", "a\nb", Op.EQ, "a", False), ("Comments", "a\nb", Op.EQ, "a\nb", True), ("comments", "a\nb", Op.EQ, "a", True),
    ("k", "É", Op.IEQ, "é", False), ("k", "AbC", Op.IEQ, "aBc", True), ("k", "AbC", Op.INE, "abc", False), ("k", "xAbCx", Op.ICONTAINS, "abc", True),
    ("k", "x,y", Op.IN, "x,y", False), ("k", "", Op.IN, "x,", False), ("k", "", Op.IN, ",x", True), ("k", "F", Op.IIN, "f,p", True),
    ("k", "12abc", Op.NEQ, "12", True), ("k", "abc", Op.NEQ, "0", True), ("k", "5", Op.NBETWEEN, "1,9", True), ("k", "5", Op.NBETWEEN, "19", False),
    ("k", "b", Op.BETWEEN, "a,c", True), ("k", "b", Op.BETWEEN, "a", False), ("k", "abc", Op.GLOB, "a*c", True), ("k", "a/.c", Op.GLOB, "a*c", True), ("k", "ABC", Op.IGLOB, "a?c", True), ("k", "xbc", Op.GLOB, "[!x]*", False), ("k", "a*", Op.GLOB, "a\\*", True),
    ("k", "hello", Op.REGEX, "^[[:alpha:]]+$", True), ("k", "hello", Op.REGEX, "(", False), ("k", "HELLO", Op.IREGEX, "ell", True), ("Comments", "a\nb", Op.REGEX, "a.b", True), ("Comments", "a\n", Op.REGEX, "a$", False), ("k", "É", Op.IREGEX, "é", False), ("k", "]", Op.REGEX, "[]abc]", True), ("k", "a", Op.REGEX, "[^]a]", False),
    ("k", "abc", Op.STARTSWITH, "ab", True), ("k", "abc", Op.ENDSWITH, "bc", True), ("k", "ABC", Op.ISTARTSWITH, "ab", True), ("k", "ABC", Op.IENDSWITH, "bc", True), ("k", "abc", Op.CONTAINS, "", True), ("k", "x", Op.EXISTS, "", True),
    ("k", "b", Op.GT, "a", True), ("k", "b", Op.LT, "a", False), ("k", "b", Op.GE, "b", True), ("k", "b", Op.LE, "a", False), ("k", "9", Op.NGT, "10", False), ("k", "9", Op.NLT, "10", True), ("k", "9", Op.NGE, "9", True), ("k", "9", Op.NLE, "8", False),
]


def test_truth_table(spark):
    assert {op for _, _, op, _, _ in TRUTH} == set(Op)
    for k, v, op, f, want in TRUTH:
        got = spark.createDataFrame([(k, v)], "key string, value string").select(matches(F.col("key"), F.col("value"), op, f).alias("m")).first().m
        assert got is want, (k, v, op.name, f)


def test_index_mode(spark):
    rows = [("12", True), ("12abc", False), ("12\n13", False), (" +12", True), ("abc", False)]
    df = spark.createDataFrame([(v,) for v, _ in rows], "value string").withColumn("key", F.lit("k"))
    got = {r.value: r.m for r in df.select("value", matches(F.col("key"), F.col("value"), Op.NEQ, "12", indexed=True).alias("m")).collect()}
    assert got == dict(rows)


@settings(max_examples=25, deadline=None)
@given(st.text("ab*?[]!^-\\x", max_size=6), st.lists(st.text("abx-]*?", max_size=4), min_size=1, max_size=4))
def test_globs_like_fnmatch(pattern, values):
    import fnmatch
    import re

    if any(c in pattern for c in "[\\!^-"):
        return  # Python's own globs differ there
    java = patterns.glob_to_java(pattern).replace("\\z", "\\Z")
    for v in values:
        assert bool(re.search(java, v)) == fnmatch.fnmatchcase(v, pattern)


def test_patterns_that_do_not_compile():
    assert all(patterns.ere_to_java(p) is None for p in ("(", "[a", "a{2", "[z-a]", "[[:nope:]]", "[[.x.]]", "a)", "\\"))


def test_single_pass_is_set_form(spark, sf):
    meta = model.part_meta(spark, sf)
    for text in (catalogue.FLAGSHIP, "NOT type EXISTS", 'NOT NOT = "x" OR size N> 10', "brand STARTSWITH Brand AND NOT size N< 20", "* CONTAINS 1"):
        try:
            parse(text)
        except QueryError:
            continue
        a, b = planner.select(meta, text), planner.select_by_sets(meta, text)
        assert sorted(r.inode_id for r in a.collect()) == sorted(r.inode_id for r in b.collect()), text


def test_one_named_filter_needs_no_shuffle(spark, sf):
    plan = planner.select(model.part_meta(spark, sf), "size N> 10")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_queries_match_sql(spark, sf):
    import os

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    sql = catalogue.oracle_sql()
    assert set(sql) == set(catalogue.queries())
    for name in ("op_regex", "group_or_and", "explain_counts", "stats_lenient", "dedup_stats", "reconstruct", "range_lookup", "overlap", "refcount_check", "paths", "append_positions", "relocation_map"):
        got = catalogue.queries()[name](spark, sf)
        want = c.execute(sql[name]).fetch_df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        key = lambda rows: sorted((tuple(map(str, r)) for r in rows))
        assert key(got.select(cols).toPandas()[cols].values.tolist()) == key(want[cols].values.tolist()), name


def test_round_trip_and_new_sectors(spark):
    rows = [(1, 4, "abcdabcdab"), (2, 4, "abcd"), (3, 3, "abcabcx"), (4, 4, "")]
    cut = sectors.sliced(spark.createDataFrame(rows, "inode_id long, sector_size int, data string"))
    none = spark.createDataFrame([], "sector_size int, hash string")
    dictionary, smap = sectors.store(cut, none)
    assert {r.inode_id: r.data for r in sectors.rebuilt(smap, dictionary).collect()} == {1: "abcdabcdab", 2: "abcd", 3: "abcabcx"}
    assert dictionary.count() == 4
    assert sectors.new_sectors(cut, dictionary).count() == 0
    lost = sectors.rebuilt(smap, dictionary.where("data <> 'ab'"))
    assert lost.where("inode_id = 1").first().data is None


def test_cd_round_trip(spark):
    def raw(lba, mode):
        m = lba + 150
        head = b"\0" + b"\xff" * 10 + b"\0" + bytes(int(str(x), 16) for x in (m // 4500, m % 4500 // 75, m % 75)) + bytes([mode])
        return head + bytes((lba + k) % 256 for k in range(2336))

    rows = [(1, 0, 1, raw(0, 1), b"s" * 96), (1, 1, 1, raw(1, 1), b"s" * 96), (1, 3, 3, raw(3, 2), b"t" * 96), (1, 4, 0, bytes(2352), b"t" * 96), (1, 5, 1, b"bad" + raw(5, 1)[3:], b"t" * 96)]
    cut = sectors.cd_split(spark.createDataFrame(rows, "inode_id long, sector long, mode int, data binary, subchannel binary"))
    dicts = {p: sectors.dictionary(cut, p) for p in ("user_data", "prefix", "suffix", "subchannel")}
    assert dicts["prefix"].count() == 1 and dicts["subchannel"].count() == 2
    last = spark.createDataFrame([(1, 6)], "inode_id long, sectors int")
    back = {r.sector: bytes(r.data) for r in sectors.cd_rebuilt(cut, dicts["user_data"], dicts["prefix"], dicts["suffix"], last).collect()}
    assert back == {r[1]: r[3] for r in rows} | {2: bytes(2352)}
    parents = spark.createDataFrame([(9, 1)], "inode_id long, parent_inode_id long")
    assert sectors.subchannel_rebuilt(cut, dicts["subchannel"], parents).count() == 5


def test_catalogue_changes(spark):
    c = spark.createDataFrame([(2, 2, True, ""), (3, 2, True, "a"), (4, 3, True, "b"), (5, 4, False, "f"), (6, 2, False, "g")], "inode_id long, parent_id long, is_dir boolean, name string")
    p = hierarchy.paths(c)
    assert {r.inode_id: r.path for r in p.collect()} == {3: "/a", 4: "/a/b", 5: "/a/b/f", 6: "/g"}
    assert {(r.ancestor, r.inode_id) for r in hierarchy.ancestors(p).collect()} == {(3, 4), (3, 5), (4, 5)}
    with pytest.raises(ValueError):
        hierarchy.renamed(c, 2, "a", 4, "z", where=p)
    moved = hierarchy.renamed(c, 2, "g", 3, "h")
    assert {r.path for r in hierarchy.paths(moved).collect()} >= {"/a/h"}
    swapped = hierarchy.renamed(c, 2, "g", 4, "f", mode="exchange")
    assert {r.inode_id: r.path for r in hierarchy.paths(swapped).collect()}[6] == "/a/b/f"
    with pytest.raises(FileExistsError):
        hierarchy.renamed(c, 2, "g", 4, "f", mode="keep")
    with pytest.raises(OSError):
        hierarchy.unlinked(c, 2, "a")
    assert hierarchy.unlinked(c, 2, "g").count() == 4
    assert hierarchy.linked(c, 5, 2, "again").count() == 6


def test_intervals(spark):
    r = spark.createDataFrame([(1, 0, 5, 0), (1, 5, 5, 0), (1, 12, 3, 1)], "inode_id long, offset long, length long, seed int")
    assert {(x.offset, x.length) for x in intervals.merge_adjacent(r, ["seed"]).collect()} == {(0, 10), (12, 3)}
    p = spark.createDataFrame([(1, k) for k in range(16)], "inode_id long, at long")
    assert {x.at for x in intervals.outside(p, r, 4).collect()} == {10, 11, 15}
    one = spark.createDataFrame([(1, 3)], "inode_id long, lba long")
    assert intervals.fragmentation(one, ["inode_id"]).first().basis_points == 0


def test_relocation_chains(spark):
    m = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6)], "old long, new long")
    assert {(r.old, r.new) for r in integrity.relocation(m).collect()} == {(1, 9), (2, 9), (3, 9), (5, 6)}


def test_group_by_counts_objects_and_drops_empty(spark):
    m = spark.createDataFrame([(1, "g", "a\na\n\nb"), (2, "g", "a"), (3, "Comments", "a\nb")], "inode_id long, key string, value string")
    assert {(r.value, r.n) for r in metadata.group_by(m, "g").collect()} == {("a", 2), ("b", 1)}
    assert [r.value for r in metadata.distinct(m, "Comments").collect()] == ["a\nb"]
    s = metadata.stats(m, "none").first()
    assert (s.n, s.min, s.max, s.sum, s.avg_hundredths) == (0, 0, 0, "0", None)


def test_user_indexes(spark, tmp_path):
    ix = metadata.UserIndexes()
    ix.create("size")
    ix.create("name", "string")
    with pytest.raises(ValueError):
        ix.create("size")
    ix.drop("name")
    assert [tuple(r) for r in ix.show(spark).collect()] == [("size", 1)]
    m = spark.createDataFrame([(1, "size", "5"), (2, "size", "x"), (3, "name", "7")], "inode_id long, key string, value string")
    ix.materialise(m, str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix")).count() == 1


def test_tags(spark):
    rows = spark.createDataFrame([(1, 0, 3, "x"), (1, 1, 3, "x"), (2, 0, 4, "x")], "inode_id long, sector long, tag_type int, data string")
    refs, data = tags.normalised(rows)
    assert data.count() == 2
    assert sorted(tuple(r) for r in tags.resolved(refs, data).collect()) == sorted(tuple(r) for r in rows.collect())


def test_exports(spark):
    rows = spark.createDataFrame([("/a", {"k": "v"}), ("/b", {})], "path string, metadata map<string,string>")
    assert [r.value for r in export.text_lines(rows).collect()] == ["/a\n  k = v", "/b"]
    assert [r.value for r in export.json_lines(rows).collect()] == ['{"path":"/a","metadata":{"k":"v"}}', '{"path":"/b"}']
    assert "".join(export.json_document(rows)) == '{"count": 2, "results": [{"path":"/a","metadata":{"k":"v"}},"/b"]}'
    wide = spark.createDataFrame([("/a", 'x"y'), ("/b", "p,q"), ("/c", None)], "path string, k string")
    assert [r.value for r in export.csv_lines(wide).collect()] == ['/a,"x""y"', '/b,"p,q"', "/c,"]
    assert list(export.table_lines(wide)) == ["path  k", "----  ---", '/a    x"y', "/b    p,q", "/c"]


def test_binary_sources(spark, tmp_path):
    entries = [(b"TITLE\0", 0x0204, b"Name\0"), (b"LEVEL\0", 0x0404, struct.pack("<I", 7)), (b"ODD\0", 1, b"zz")]
    keys, vals, table = b"", b"", b""
    for k, kind, v in entries:
        table += struct.pack("<HHIII", len(keys), kind, len(v), len(v), len(vals))
        keys, vals = keys + k, vals + v
    at = 20 + len(table)
    sfo = b"\0PSF" + struct.pack("<IIII", 0x101, at, at + len(keys), len(entries)) + table + keys + vals
    assert binary.sfo_entries(sfo) == [("TITLE", "Name"), ("LEVEL", "7")]
    assert binary.sfo_entries(b"no") == [] and binary.ird_entries(b"no") == [] and binary.wux_sectors(b"no") == [] and binary.iso_entries(b"no") == []
    (tmp_path / "a.ISO").write_bytes(b"x" * 10)
    (tmp_path / ".iso").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    got = binary.image_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.sector_size) for r in got] == [("a.ISO", 2048)]
    (tmp_path / "p.sfo").write_bytes(sfo)
    kv = binary.key_values(spark.read.format("binaryFile").load(str(tmp_path / "p.sfo")), binary.sfo_entries)
    assert {(r.key, r.value) for r in kv.collect()} == {("TITLE", "Name"), ("LEVEL", "7")}


def test_streaming_ingest(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "inode_id long, sector_size int, data string"
    base, check = str(tmp_path / "out"), str(tmp_path / "check")
    for rows in ([(1, 4, "abcdabcd"), (2, 4, "abcdxy")], [(3, 4, "abcdnew!")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = ingest.ingest(spark.readStream.schema(schema).parquet(src), base, check)
        q.awaitTermination()
    d, m = ingest.stored(spark, base)
    assert sorted(r.data for r in d.collect()) == ["abcd", "new!", "xy"]
    assert {r.inode_id: r.data for r in sectors.rebuilt(m, d).collect()} == {1: "abcdabcd", 2: "abcdxy", 3: "abcdnew!"}


def test_stateful_ingest(spark, tmp_path):
    src, base, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "inode_id long, sector_size int, data string"
    for rows in ([(1, 4, "abcdabcd"), (2, 4, "abcdxy")], [(3, 4, "abcdnew!"), (4, 2, "xy")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for q in ingest.ingest_stateful(spark.readStream.schema(schema).parquet(src), base, check):
            q.awaitTermination()
    d, m = ingest.stored(spark, base)
    assert sorted((r.sector_size, r.data) for r in d.collect()) == [(2, "xy"), (4, "abcd"), (4, "new!"), (4, "xy")]
    assert {r.inode_id: r.data for r in sectors.rebuilt(m, d).collect()} == {1: "abcdabcd", 2: "abcdxy", 3: "abcdnew!", 4: "xy"}


@pytest.mark.parametrize("conf", [{}, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}])
def test_placed_loses_nothing(spark, tmp_path, conf):
    """Every sector comes back with its contents, at positions 0 .. n - 1, however Spark deals out and merges partitions."""
    n, before = 300_000, {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        new = spark.range(n).select(F.lit(64).alias("sector_size"), F.md5(F.col("id").cast("string").cast("binary")).alias("hash"), F.rpad(F.col("id").cast("string"), 64, "x").alias("data"))
        sectors.placed(new, 64, start=5).write.parquet(str(tmp_path / "p"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = spark.read.parquet(str(tmp_path / "p")).withColumn("at", F.col("lba") * 65536 + F.col("offset") / 64 - 5)
    whole = got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("at").alias("places"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.countDistinct("data").alias("texts")).first()
    assert tuple(whole) == (n, n, 0, n - 1, n)
    assert got.orderBy("at").select("hash").limit(50).collect() == new.select("hash").orderBy("hash").limit(50).collect()


def test_slicing_is_whole(spark):
    rng = __import__("random").Random(4)
    texts = ["".join(rng.choice("ab\n\r é🙂\u2028") for _ in range(k)) for k in (0, 1, 6, 7, 8, 100)]
    rows = [(k, s, t) for k, t in enumerate(texts) for s in (1, 7, 64)]
    want = sorted((k, s, i, t[i * s : i * s + s]) for k, s, t in rows for i in range(-(-len(t) // s)))
    got = sectors.sliced(spark.createDataFrame(rows, "inode_id long, sector_size int, data string"))
    assert sorted((r.inode_id, r.sector_size, r.sector, r.data) for r in got.collect()) == want
    raw = sectors.sliced(spark.createDataFrame([(1, 4, bytearray(range(10)))], "inode_id long, sector_size int, data binary"))
    assert [bytes(r.data) for r in raw.orderBy("sector").collect()] == [bytes(range(4)), bytes(range(4, 8)), bytes([8, 9])]


def test_new_places_sorts_nothing(spark, sf):
    cut = sectors.sliced(model.images(spark, sf))
    plan = sectors.new_places(cut, cut.where("inode_id % 2 = 0").select("sector_size", "hash").distinct())._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_missing_sectors_fail(spark):
    cut = sectors.sliced(spark.createDataFrame([(1, 4, "abcdef")], "inode_id long, sector_size int, data string"))
    lost, smap = cut.where("sector = 0").select("sector_size", "hash", "data"), sectors.sector_map(cut)
    assert [r.data for r in sectors.sectors_of(smap, lost).orderBy("sector").collect()] == ["abcd", None]
    for read in (sectors.streamed, sectors.rebuilt):
        with pytest.raises(Exception, match="sector 1 of object 1 is missing"):
            read(smap, lost, "error").collect()
    located = sectors.placed(cut.select("sector_size", "hash", "data"), 4)
    assert {(r.sector, r.lba) for r in sectors.backfilled(smap, located).collect()} == {(0, 0), (1, 0)}


@pytest.mark.parametrize("width", [1, 3, 10, 1 << 20])
def test_intervals_of_any_width(spark, width):
    """Buckets change the work, not the answers: against plain Python, with long and touching intervals."""
    rng = __import__("random").Random(width)
    spans = [(o, rng.randint(0, 3), at, rng.choice([0, 1, 2, 5, 40])) for o, at in enumerate(rng.sample(range(120), 40))]
    places = sorted({(rng.randint(0, 1), rng.randint(0, 90)) for _ in range(120)})
    r = spark.createDataFrame(spans, "id long, inode_id long, offset long, length long")
    p = spark.createDataFrame(places, "inode_id long, at long")
    inside = {(i, at, k) for i, at in places for k, j, lo, n in spans if i == j and lo <= at < lo + n}
    assert {(x.inode_id, x.at, x.id) for x in intervals.locate(p, r, width).collect()} == inside
    free = {(i, at) for i, at in places} - {x[:2] for x in inside}
    assert {tuple(x) for x in intervals.outside(p, r, width).select("inode_id", "at").collect()} == free
    left = intervals.locate(p, r, width, "left").collect()
    assert {(x.inode_id, x.at, x.id) for x in left} == inside | {(i, at, None) for i, at in free} and len(left) == len(inside) + len(free)
    both = {(a[0], b[0]) for a in spans for b in spans if a[1] == b[1] and a[3] and b[3] and a[2] < b[2] + b[3] and b[2] < a[2] + a[3]}
    got = [(x.a_id, x.b_id) for x in intervals.overlaps(r, r, width).collect()]
    assert set(got) == both and len(got) == len(both)
    starts = {i: sorted(lo for _, j, lo, _ in spans if j == i) for i in (0, 1)}
    as_of = {(x.inode_id, x.at): x.offset for x in intervals.as_of(p, r.select("inode_id", "offset"), width).collect()}
    assert as_of == {(i, at): max((s for s in starts[i] if s <= at), default=None) for i, at in places}
    lba = p.withColumnRenamed("at", "lba")
    runs = []
    for i, at in places:
        if runs and runs[-1][0] == i and runs[-1][2] == at - 1:
            runs[-1][2:] = [at, runs[-1][3] + 1]
        else:
            runs.append([i, at, at, 1])
    assert sorted(map(list, intervals.islands(lba, ["inode_id"], width=width).select("inode_id", "first", "last", "n").collect())) == runs
    holes = [(a[0], a[2] + 1, b[1] - 1) for a, b in zip(runs, runs[1:]) if a[0] == b[0]]
    assert sorted(map(tuple, intervals.gaps(lba, ["inode_id"], width=width).collect())) == holes
    kinds = p.withColumn("kind", F.floor(F.col("at") / 7) % 2)
    turns = []
    for i, at in places:
        if turns and turns[-1][0] == i and turns[-1][1] == at // 7 % 2:
            turns[-1][3:] = [at, turns[-1][4] + 1]
        else:
            turns.append([i, at // 7 % 2, at, at, 1])
    assert sorted(map(list, intervals.runs_of_equal(kinds, ["inode_id"], "at", "kind", width).collect())) == sorted(turns)
    before = {(x.inode_id, x.at): x.b for x in intervals.previous(p.withColumn("v", F.col("at") * 2), ["inode_id"], "at", "v", "b", width).collect()}
    assert before == {(i, at): max((2 * b for j, b in places if j == i and b < at), default=None) for i, at in places}
    blocks = sorted(tuple(x) for x in intervals.runs_within_blocks(p, r, ["inode_id"], 10, width).select("inode_id", "first", "last").collect())
    cut = []
    for i, at in sorted(free):
        if cut and cut[-1][0] == i and cut[-1][2] == at - 1 and at % 10:
            cut[-1][2] = at
        else:
            cut.append([i, at, at])
    assert blocks == sorted(map(tuple, cut))
    assert [tuple(x) for x in intervals.first_fit(intervals.gaps(lba.where("inode_id = 0"), ["inode_id"]), 1, 30).collect()] == [next(((a, a) for i, a, _ in holes if i == 0 and a >= 30), None)]


def test_document_metadata_is_whole(spark, tmp_path):
    """Matches, lines and groups that lie far behind the start of a text."""
    filler = "\n".join(f"word {k}" for k in range(400))
    texts = {1: f"{filler}\nNear the end", 2: filler, 3: f"{filler}\n7", 4: "the start", 5: None}
    spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    known, sf_dir = catalogue.queries(), str(tmp_path)
    lines = {d: t.split("\n") for d, t in texts.items() if t}
    assert {r.inode_id - model.DOCUMENTS_FROM for r in known["op_contains"](spark, sf_dir).collect()} == {d for d, ls in lines.items() if any("the" in x for x in ls)} == {1, 4}
    assert {r.value for r in known["distinct_key"](spark, sf_dir).collect()} == {x for ls in lines.values() for x in ls}
    assert {r.value for r in known["distinct_comments"](spark, sf_dir).collect()} == set(filter(None, texts.values()))
    got = {r.value: r.n for r in known["groupby_key"](spark, sf_dir).collect()}
    assert got == {x: sum(x in ls for ls in lines.values()) for x in got} and got["7"] == 1 and got["word 399"] == 3


def test_csv_export_is_whole(spark, tmp_path):
    """What Python's reader gets back is every text, also what needs quotes far behind the start."""
    import csv
    import io

    texts = {1: "x" * 200 + ', "quoted"\nnext line', 2: "short", 3: "y" * 5000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lines = [r.value for r in catalogue.queries()["export_csv"](spark, str(tmp_path)).collect()]
    assert {int(d): t for d, t in csv.reader(io.StringIO("\n".join(lines), newline=""))} == texts
