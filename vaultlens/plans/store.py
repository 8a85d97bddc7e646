"""Registered queries of the store: catalogue changes, attributes, CD sectors, blocks, exports, streaming. Each has the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.functions import digests, lagged, scalar
from vaultlens.functions.lineage import shared_dir, spread
from vaultlens.operators import blocks, export, hierarchy, inodes, integrity, intervals, junk, metadata, sectors, tags
from vaultlens.plans import planner, sqlgen
from vaultlens.plans.catalogue import _HOUR, _REGIONS, _SECTORS, FLAGSHIP, PARTS, registered
from vaultlens.sources import binary, model

# Catalogue and attributes

_ENTRIES = """e AS (SELECT CAST(r_regionkey + 10 AS BIGINT) AS inode_id, 2::BIGINT AS parent_id, true AS is_dir, r_name AS name FROM region
UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, true, n_name FROM nation UNION ALL SELECT c_custkey + 100000, c_nationkey + 100, false, c_name FROM customer)"""


@registered(f"WITH {_ENTRIES} SELECT * FROM e WHERE parent_id = 2 AND name = 'ASIA'")
def catalog_lookup(spark, sf_dir):
    return hierarchy.lookup(model.catalog(spark, sf_dir), 2, "ASIA")


def _linked(spark, sf_dir) -> DataFrame:
    """The catalogue with a second entry, in the first nation, for every thirteenth customer."""
    c = model.catalog(spark, sf_dir)
    more = c.where("NOT is_dir AND inode_id % 13 = 0").select("inode_id", F.lit(100).cast("long").alias("parent_id"), "is_dir", F.concat(F.lit("again "), "name").alias("name"))
    return c.unionByName(more)


_LINKED = f"{_ENTRIES}, l AS (SELECT * FROM e UNION ALL SELECT inode_id, 100, is_dir, 'again ' || name FROM e WHERE NOT is_dir AND inode_id % 13 = 0), f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY inode_id ORDER BY parent_id, name) = 1)"


@registered(f"WITH {_LINKED} SELECT * FROM f")
def reverse_lookup(spark, sf_dir):
    """Of several hard links the first in (parent, name) order names an object."""
    return hierarchy.first_entry(_linked(spark, sf_dir).where("inode_id <> 2")).select("inode_id", "parent_id", "is_dir", "name")


@registered(f"WITH RECURSIVE {_LINKED}, w(inode_id, path, depth) AS (SELECT 2::BIGINT, '', 0 UNION ALL SELECT f.inode_id, w.path || '/' || f.name, w.depth + 1 FROM w JOIN f ON f.parent_id = w.inode_id) SELECT inode_id, path, depth FROM w WHERE inode_id <> 2")
def paths_hard_links(spark, sf_dir):
    return hierarchy.paths(_linked(spark, sf_dir))


@registered("SELECT '/' || r_name || '/' || n_name AS path, CAST(n_nationkey + 100 AS BIGINT) AS inode_id FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0")
def path_to_inode(spark, sf_dir):
    c = model.catalog(spark, sf_dir)
    wanted = model.read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").join(model.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = wanted.select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"))
    return hierarchy.resolve_all(hierarchy.paths(c.where("is_dir")), asked.unionByName(spark.createDataFrame([("/no/where",)], "path string")))


@registered(f"""WITH {_ENTRIES} SELECT inode_id, CASE WHEN inode_id = 10 THEN 100 WHEN inode_id = 101 THEN 102 ELSE parent_id END AS parent_id, is_dir, CASE WHEN inode_id = 101 THEN 'moved' ELSE name END AS name FROM e WHERE inode_id NOT IN (10, 100001)
UNION ALL SELECT 10, 2, true, (SELECT r_name FROM region WHERE r_regionkey = 1) UNION ALL SELECT 5::BIGINT, 11::BIGINT, true, 'made' UNION ALL SELECT 100002, 5, false, 'hard link'""".replace("SELECT 10, 2, true, (SELECT r_name FROM region WHERE r_regionkey = 1)", "SELECT CAST(10 AS BIGINT), 2::BIGINT, true, 'exchanged'"))
def catalog_changes(spark, sf_dir):
    """mkdir, link, rename, unlink, one after another."""
    c = model.catalog(spark, sf_dir).where("inode_id <> 2")
    nation = {r["n_nationkey"]: r["n_name"] for r in model.read(spark, sf_dir, "nation").where("n_nationkey = 1").collect()}
    region = model.read(spark, sf_dir, "region").where("r_regionkey = 0").first()
    parent = model.read(spark, sf_dir, "nation").where("n_nationkey = 1").first()["n_regionkey"] + 10
    gone = model.read(spark, sf_dir, "customer").where("c_custkey = 1").first()
    c = hierarchy.linked(c, 5, 11, "made", is_dir=True)
    c = hierarchy.linked(c, 100002, 5, "hard link")
    c = hierarchy.renamed(c, parent, nation[1], 102, "moved")
    c = hierarchy.renamed(c, 2, region["r_name"], 2, "exchanged")
    return hierarchy.unlinked(c, gone["c_nationkey"] + 100, gone["c_name"])


@registered(f"WITH {_ENTRIES}, n AS (SELECT * FROM e WHERE inode_id IN (101, 102)) SELECT e.inode_id, CASE e.inode_id WHEN 101 THEN (SELECT parent_id FROM n WHERE inode_id = 102) WHEN 102 THEN (SELECT parent_id FROM n WHERE inode_id = 101) ELSE e.parent_id END AS parent_id, is_dir, CASE e.inode_id WHEN 101 THEN (SELECT name FROM n WHERE inode_id = 102) WHEN 102 THEN (SELECT name FROM n WHERE inode_id = 101) ELSE e.name END AS name FROM e")
def rename_exchange(spark, sf_dir):
    c = model.catalog(spark, sf_dir).where("inode_id <> 2")
    a, b = (c.where(F.col("inode_id") == k).first() for k in (101, 102))
    return hierarchy.renamed(c, a["parent_id"], a["name"], b["parent_id"], b["name"], mode="exchange")


def _inodes(spark, sf_dir) -> DataFrame:
    return model.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("inode_id"), (F.col("o_custkey") % 8).cast("long").alias("mode"), (F.col("o_custkey") * 10).cast("long").alias("file_size"))


_INODES = "i AS (SELECT o_orderkey AS inode_id, CAST(o_custkey % 8 AS BIGINT) AS mode, CAST(o_custkey * 10 AS BIGINT) AS file_size FROM orders)"


@registered(f"WITH {_INODES} SELECT * FROM i WHERE inode_id = 7")
def inode_get(spark, sf_dir):
    return inodes.get(_inodes(spark, sf_dir), 7)


@registered(f"WITH {_INODES} SELECT inode_id, CASE WHEN inode_id % 6 = 0 THEN 9 WHEN inode_id % 2 = 0 THEN 8 ELSE mode END AS mode, CASE WHEN inode_id % 6 = 0 THEN 2 WHEN inode_id % 2 = 0 THEN 1 ELSE file_size END AS file_size FROM i WHERE inode_id % 5 <> 0 UNION ALL SELECT -1, 8, 1")
def inode_put_delete(spark, sf_dir):
    """Of several changes of an object the latest counts; then every fifth goes."""
    t = _inodes(spark, sf_dir)
    first = t.where("inode_id % 2 = 0").selectExpr("inode_id", "8L AS mode", "1L AS file_size", "1L AS version")
    second = t.where("inode_id % 6 = 0").selectExpr("inode_id", "9L AS mode", "2L AS file_size", "2L AS version")
    new = spark.range(1).selectExpr("-1L AS inode_id", "8L AS mode", "1L AS file_size", "1L AS version")
    after = inodes.put(t, first.unionByName(second).unionByName(new))
    return inodes.delete(after, t.where("inode_id % 5 = 0"))


@registered(f"WITH {_INODES} SELECT inode_id, CASE WHEN inode_id = 7 THEN 420 ELSE mode END AS mode, CASE WHEN inode_id = 32 THEN 5 ELSE file_size END AS file_size FROM i")
def inode_update(spark, sf_dir):
    return inodes.truncated(inodes.updated(_inodes(spark, sf_dir), 7, mode=420), 32, 5)


def _media_tags(spark, sf_dir) -> DataFrame:
    return model.read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).cast("long").alias("inode_id"), F.col("label").alias("tag_type"), F.col("vec_id").cast("string").alias("data")).groupBy("inode_id", "tag_type").agg(F.max("data").alias("data"))


_MEDIA = "t AS (SELECT CAST(vec_id % 50 AS BIGINT) AS inode_id, label AS tag_type, max(CAST(vec_id AS VARCHAR)) AS data FROM embeddings GROUP BY 1, 2)"


@registered(f"WITH {_MEDIA} SELECT data FROM t WHERE inode_id = 7 AND tag_type = 0")
def media_tag_get(spark, sf_dir):
    return tags.get(_media_tags(spark, sf_dir), 7, 0)


_NAMES = "SELECT 'user.metadata.' || key AS name FROM m WHERE inode_id = 7 UNION ALL SELECT 'user.mediatag.' || tag_type FROM t WHERE inode_id = 7"


@registered(f"WITH m AS ({PARTS}), {_MEDIA} {_NAMES}")
def attribute_names(spark, sf_dir):
    return inodes.attribute_names(model.part_meta(spark, sf_dir), _media_tags(spark, sf_dir), 7)


@registered(f"WITH m AS ({PARTS}) SELECT value FROM m WHERE inode_id = 7 AND key = 'name'")
def attribute_get(spark, sf_dir):
    return inodes.attribute(model.part_meta(spark, sf_dir), _media_tags(spark, sf_dir), 7, "user.metadata.name").select(F.decode("value", "UTF-8").alias("value"))


@registered(f"""WITH m AS ({PARTS}), {_MEDIA} SELECT inode_id, key, value FROM m WHERE NOT (inode_id = 7 AND key IN ('brand', 'name'))
UNION ALL SELECT 7, 'name', 'new' UNION ALL SELECT inode_id, CAST(tag_type AS VARCHAR), data FROM t WHERE NOT (inode_id = 7 AND tag_type = 3) UNION ALL SELECT 7, '3', 'bytes'""")
def attribute_set_remove(spark, sf_dir):
    m, t = model.part_meta(spark, sf_dir), _media_tags(spark, sf_dir)
    m, t = inodes.with_attribute(m, t, 7, "user.metadata.name", b"new")
    m, t = inodes.without_attribute(m, t, 7, "user.metadata.brand")
    m, t = inodes.with_attribute(m, t, 7, "user.mediatag.3", b"bytes")
    return m.unionByName(t.select("inode_id", F.col("tag_type").cast("string").alias("key"), F.col("data").alias("value")))


# Results: order, pages, wide tables, texts

_FOUND = f"r AS ({sqlgen.select(PARTS, FLAGSHIP)})"


@registered(f"WITH {_FOUND} SELECT inode_id, row_number() OVER (ORDER BY inode_id) - 1 AS position FROM r")
def result_order(spark, sf_dir):
    return metadata.positions(planner.select(model.part_meta(spark, sf_dir), FLAGSHIP))


@registered(f"WITH {_FOUND} SELECT inode_id FROM r ORDER BY inode_id LIMIT 8 OFFSET 16")
def page_by_offset(spark, sf_dir):
    return metadata.page_at(planner.select(model.part_meta(spark, sf_dir), FLAGSHIP), 16)


@registered(f"WITH {_FOUND} SELECT inode_id FROM r WHERE inode_id > 40 ORDER BY inode_id LIMIT 8")
def page_by_cursor(spark, sf_dir):
    return metadata.paged(planner.select(model.part_meta(spark, sf_dir), FLAGSHIP), after=40)


@registered(f"WITH {_FOUND}, p AS (SELECT p_partkey AS inode_id, p_brand AS brand, p_name AS name, CAST(p_size AS VARCHAR) AS size, p_type AS type FROM part) SELECT p.* FROM p JOIN r USING (inode_id)")
def pivot_first_seen(spark, sf_dir):
    """Columns are the keys as they are met, not named ones."""
    meta = model.part_meta(spark, sf_dir)
    return metadata.wide(planner.select(meta, FLAGSHIP), meta)


def _mixed(spark, sf_dir) -> DataFrame:
    """Codes that are whole numbers, numbers with a tail, or several lines; and remarks, which are one value whatever their lines."""
    k = F.col("o_orderkey") % 4
    code = F.when(k == 0, "5").when(k == 1, F.col("o_orderpriority")).when(k == 2, "4\n5").otherwise(" +5")
    remark = F.when(k < 2, F.concat("o_orderpriority", F.lit("\nsecond line"))).otherwise("second line")
    return model.long_form(model.read(spark, sf_dir, "orders"), F.col("o_orderkey"), {"code": code, "Comments": remark})


_MIXED = """SELECT o_orderkey AS inode_id, 'code' AS key, CASE o_orderkey % 4 WHEN 0 THEN '5' WHEN 1 THEN o_orderpriority WHEN 2 THEN '4' || chr(10) || '5' ELSE ' +5' END AS value FROM orders
UNION ALL SELECT o_orderkey, 'Comments', CASE WHEN o_orderkey % 4 < 2 THEN o_orderpriority || chr(10) || 'second line' ELSE 'second line' END FROM orders"""
_MIXED_QUERIES = {"num_index_whole": ('code N= "5"', "index"), "num_scan_lines": ('code N= "5"', "scan"), "comments_whole": ('Comments = "second line"', "index"), "comments_part": ('Comments CONTAINS "second"', "index")}


def _mixed_query(name: str):
    def run(spark, sf_dir):
        return planner.select(_mixed(spark, sf_dir), *_MIXED_QUERIES[name])

    run.__name__ = name
    return run


for _name, (_text, _mode) in _MIXED_QUERIES.items():
    registered(sqlgen.select(_MIXED, _text, _mode))(_mixed_query(_name))


@registered(f"SELECT DISTINCT value FROM ({PARTS}) WHERE key = 'brand'")
def distinct_txt(spark, sf_dir):
    return export.distinct_lines(metadata.distinct(model.part_meta(spark, sf_dir), "brand"))


@registered(f"""SELECT DISTINCT '"' || value || '"' AS value FROM ({PARTS}) WHERE key = 'brand'""")
def distinct_json(spark, sf_dir):
    return export.distinct_lines(metadata.distinct(model.part_meta(spark, sf_dir), "brand"), "json")


_GROUPS = f"g AS (SELECT value AS v, count(*) AS n FROM ({PARTS}) WHERE key = 'name' GROUP BY value)"


@registered(f"WITH {_GROUPS} SELECT '  ' || v || repeat(' ', CAST((SELECT max(strlen(v)) FROM g) - strlen(v) AS BIGINT)) || '  ' || n AS value FROM g")
def groupby_txt(spark, sf_dir):
    return export.group_lines(metadata.group_by(model.part_meta(spark, sf_dir), "name"))


@registered(f"""WITH {_GROUPS} SELECT '{{"value":"' || v || '","count":' || n || '}}' AS value FROM g""")
def groupby_json(spark, sf_dir):
    return export.group_lines(metadata.group_by(model.part_meta(spark, sf_dir), "name"), "json")


_SIZES = "s AS (SELECT count(*) AS n, min(p_size) AS lo, max(p_size) AS hi, sum(p_size) AS t, CAST(CAST(round(sum(p_size) * 100 / count(*), 0) AS BIGINT) AS VARCHAR) AS a FROM part), x AS (SELECT *, lpad(a, CAST(greatest(length(a), 3) AS INTEGER), '0') AS d FROM s), y AS (SELECT *, left(d, CAST(length(d) - 2 AS INTEGER)) || '.' || right(d, 2) AS avg FROM x)"


@registered(f"WITH {_SIZES} SELECT 'Statistics for ''size'':' || chr(10) || '  Count: ' || n || chr(10) || '  Min:   ' || lo || chr(10) || '  Max:   ' || hi || chr(10) || '  Sum:   ' || t || chr(10) || '  Avg:   ' || avg AS value FROM y")
def stats_txt(spark, sf_dir):
    return export.stats_text(metadata.stats(model.part_meta(spark, sf_dir), "size"), "size")


@registered(f"""WITH {_SIZES} SELECT '{{"key": "size", "count": ' || n || ', "min": ' || lo || ', "max": ' || hi || ', "sum": ' || t || ', "avg": ' || avg || '}}' AS value FROM y""")
def stats_json(spark, sf_dir):
    return export.stats_text(metadata.stats(model.part_meta(spark, sf_dir), "size"), "size", "json")


_TABLE = "t AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_name AS n, p_brand AS b FROM part)"


@registered(f"WITH {_TABLE} SELECT rtrim(rpad(k, CAST((SELECT greatest(max(length(k)), 8) FROM t) AS INTEGER), ' ') || '  ' || rpad(n, CAST((SELECT greatest(max(length(n)), 4) FROM t) AS INTEGER), ' ') || '  ' || rpad(b, CAST((SELECT greatest(max(length(b)), 5) FROM t) AS INTEGER), ' ')) AS value FROM t")
def export_table(spark, sf_dir):
    return export.table_rows(model.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("inode_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")))


@registered("""WITH p AS (SELECT * FROM part WHERE p_type = 'PROMO' AND p_partkey < 200)
SELECT '{"count": ' || count(*) || ', "results": [' || string_agg('{"path":"/' || p_name || '/' || p_partkey || '","metadata":{"brand":"' || p_brand || '"}}', ',' ORDER BY p_partkey) || ']}' AS value FROM p""")
def export_json(spark, sf_dir):
    """One document, whose pieces stream through the driver."""
    meta = model.part_meta(spark, sf_dir).where("inode_id < 200")
    rows = metadata.with_metadata(planner.select(meta, "type = PROMO"), meta, ["brand", "name"]).orderBy("inode_id")
    named = rows.select(F.concat(F.lit("/"), F.col("metadata")["name"], F.lit("/"), F.col("inode_id").cast("string")).alias("path"), F.map_filter("metadata", lambda k, v: k == "brand").alias("metadata"))
    return spark.createDataFrame([("".join(export.json_document(named)),)], "value string")


@registered("""WITH t AS (SELECT p_partkey AS track, p_size % 3 AS mode, (p_partkey - 1) * 4500 AS start FROM part WHERE p_partkey BETWEEN 1 AND 20)
SELECT 'FILE "disc.bin" BINARY' || chr(10) || string_agg('  TRACK ' || lpad(track::VARCHAR, 2, '0') || ' ' || CASE mode WHEN 0 THEN 'AUDIO' WHEN 1 THEN 'MODE1/2352' ELSE 'MODE2/2352' END || chr(10) || '    INDEX 01 ' || lpad((start // 4500)::VARCHAR, 2, '0') || ':' || lpad((start % 4500 // 75)::VARCHAR, 2, '0') || ':' || lpad((start % 75)::VARCHAR, 2, '0'), chr(10) ORDER BY track) || chr(10) AS value FROM t""")
def cue_sheet(spark, sf_dir):
    tracks = model.read(spark, sf_dir, "part").where("p_partkey BETWEEN 1 AND 20").select(F.col("p_partkey").cast("int").alias("track"), (F.col("p_size") % 3).alias("mode"), ((F.col("p_partkey") - 1) * 4500).alias("start"))
    return export.cue_sheet(tracks, "disc.bin")


# Functions


@registered("SELECT doc_id, sha1(text) AS sha1 FROM documents")
def sha1_text(spark, sf_dir):
    return model.read(spark, sf_dir, "documents").select("doc_id", digests.sha1(F.col("text")).alias("sha1"))


@registered("""SELECT o_orderkey AS id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KiB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.2f MiB', n / 1048576.0) WHEN n < 1099511627776 THEN printf('%.2f GiB', n / 1073741824.0) ELSE printf('%.2f TiB', n / 1099511627776.0) END AS size FROM (SELECT o_orderkey, CAST(o_orderkey % 1024 AS BIGINT) << CAST(10 * (o_orderkey % 5) AS INTEGER) AS n FROM orders)""")
def human_size(spark, sf_dir):
    n = F.call_function("shiftleft", F.col("o_orderkey") % 1024, (10 * (F.col("o_orderkey") % 5)).cast("int"))
    return model.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), scalar.human_size(n).alias("size"))


@registered("""SELECT event_id, '00FFFFFFFFFFFFFFFFFFFF00' || lpad(((event_id + 150) // 4500)::VARCHAR, 2, '0') || lpad(((event_id + 150) % 4500 // 75)::VARCHAR, 2, '0') || lpad(((event_id + 150) % 75)::VARCHAR, 2, '0') || '0' || (1 + event_id % 2) AS prefix FROM events""")
def cd_prefix(spark, sf_dir):
    return model.read(spark, sf_dir, "events").select("event_id", F.hex(scalar.cd_prefix(F.col("event_id"), 1 + F.col("event_id") % 2)).alias("prefix"))


@registered("SELECT p_partkey AS id, p_name AS text FROM part")
def utf16_text(spark, sf_dir):
    raw = F.encode(F.concat("p_name", F.lit("\0rest")), "UTF-16LE")
    return model.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalar.utf16le(raw).alias("text"))


@registered("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'AUDIO' WHEN 1 THEN 'MODE1' WHEN 2 THEN 'MODE2' WHEN 3 THEN 'MODE2 FORM1' ELSE 'MODE2 FORM2' END AS mode FROM part")
def code_labels(spark, sf_dir):
    return model.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalar.labelled(F.col("p_size") % 5, {0: "AUDIO", 1: "MODE1", 2: "MODE2", 3: "MODE2 FORM1"}, "MODE2 FORM2").alias("mode"))


@registered("SELECT p_partkey AS id, p_name AS text FROM part")
def aes_round_trip(spark, sf_dir):
    """Encrypted by Spark with padding, decrypted here block by block, then the padding goes."""
    key, iv = F.unhex(F.md5("p_brand")), F.unhex(F.md5("p_type"))
    sealed = F.call_function("aes_encrypt", F.encode("p_name", "UTF-8"), key, F.lit("CBC"), F.lit("PKCS"), iv)
    opened = digests.aes(F.substring(sealed, F.lit(17), F.length(sealed) - 16), key, iv)
    rows = model.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), opened.alias("o"))
    last = F.conv(F.hex(F.substring("o", F.length("o"), F.lit(1))), 16, 10).cast("int")
    return rows.select("id", F.decode(F.substring("o", F.lit(1), F.length("o") - last), "UTF-8").alias("text"))


@registered("SELECT p_partkey AS sector, printf('%032x', p_partkey) AS iv FROM part")
def sector_start_values(spark, sf_dir):
    return model.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sector"), F.lower(F.hex(digests.sector_iv(F.col("p_partkey")))).alias("iv"))


@registered("SELECT p_size::BIGINT AS inode_id, p_partkey AS sector, rpad(p_name, 64, ' ') AS text FROM part")
def sector_cipher(spark, sf_dir):
    """Sectors enciphered outside plain regions under keys derived from what a disc's description holds, and opened again."""
    part = model.read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("inode_id"), F.col("p_partkey").alias("sector"), F.encode(F.rpad("p_name", 64, " "), "UTF-8").alias("data"))
    held = F.unhex(F.md5(F.col("inode_id").cast("string")))
    keys = part.select("inode_id").distinct().select("inode_id", digests.derived_key(held, F.unhex(F.md5(F.lit("key"))), F.unhex(F.md5(F.lit("start")))).alias("key"))
    regions = spark.range(1, 51).select(F.col("id").alias("inode_id"), F.lit(0).cast("long").alias("start_sector"), F.lit(99).cast("long").alias("end_sector"))
    closed = F.when(F.col("sector") <= 99, F.col("data")).otherwise(digests.aes(F.col("data"), F.col("key"), digests.sector_iv(F.col("sector")), decrypt=False))
    sealed = part.join(keys, "inode_id").select("inode_id", "sector", closed.alias("data"))
    return sectors.deciphered(sealed, regions, keys).select("inode_id", "sector", F.decode("data", "UTF-8").alias("text"))


# Sectors

_DICT = f"{_SECTORS}, d AS (SELECT DISTINCT sector_size, hash FROM s)"


@registered(f"WITH {_DICT} SELECT DISTINCT sector_size, hash FROM s WHERE inode_id % 3 = 0 AND sector < 5")
def dedup_lookup(spark, sf_dir):
    cut = sectors.sliced(model.images(spark, sf_dir))
    wanted = sectors.sector_map(cut).where("inode_id % 3 = 0 AND sector < 5")
    return sectors.lookup(wanted, cut.select("sector_size", "hash").distinct())


@registered(f"""WITH {_SECTORS}, i AS (SELECT sector_size, hash, min(inode_id) AS lba FROM s GROUP BY ALL)
SELECT inode_id, sector, sector_size, hash, CASE WHEN inode_id % 2 = 0 THEN -1 ELSE lba END AS lba, CASE WHEN inode_id % 2 = 0 THEN -2 ELSE 0 END AS "offset" FROM s JOIN i USING (sector_size, hash)""")
def location_backfill(spark, sf_dir):
    smap = sectors.sector_map(sectors.sliced(model.images(spark, sf_dir)))
    index = smap.groupBy("sector_size", "hash").agg(F.min("inode_id").alias("lba")).withColumn("offset", F.lit(0).cast("long"))
    known = F.col("inode_id") % 2 == 0
    cached = smap.withColumns({"lba": F.when(known, F.lit(-1).cast("long")), "offset": F.when(known, F.lit(-2).cast("long"))})
    return sectors.backfilled(cached, index)


@registered(f"WITH {_SECTORS} SELECT inode_id, sector, data FROM s")
def streamed_sectors(spark, sf_dir):
    dictionary, smap = sectors.store(sectors.sliced(model.images(spark, sf_dir)), spark.createDataFrame([], "sector_size int, hash string"))
    return sectors.streamed(smap, dictionary)


@registered(f"WITH {_SECTORS} SELECT inode_id, sector, sector_size, hash FROM s WHERE inode_id <> 3 OR sector < 4")
def truncate_sectors(spark, sf_dir):
    return sectors.truncated(sectors.sector_map(sectors.sliced(model.images(spark, sf_dir))), 3, 4)


#: Sectors that one task makes from its rows of a table, which holds far less than they do.
_TASK_SECTORS = 20_000

_CD = "c AS (SELECT p_partkey // 100 AS inode_id, p_partkey % 100 AS sector, p_partkey % 3 AS kind, md5(p_name) AS h FROM part)"


def _cd(spark, sf_dir) -> DataFrame:
    """Raw mode 1 sectors: a third with computed suffixes, a third with others, a third whose prefix is spoiled too."""
    part = spread(model.read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", _TASK_SECTORS)
    part = part.select(F.floor(F.col("p_partkey") / 100).alias("inode_id"), (F.col("p_partkey") % 100).alias("sector"), (F.col("p_partkey") % 3).alias("kind"), F.md5(F.col("p_name").cast("binary")).alias("h"))
    good = F.concat(scalar.cd_prefix(F.col("sector"), F.lit(1)), F.encode(F.repeat("h", F.lit(64)), "UTF-8"))
    rows = part.withColumn("head", good).withColumn("tail", F.when(F.col("kind") == 0, digests.mode1_suffix(F.when(F.col("kind") == 0, F.col("head")))).otherwise(F.encode(F.repeat(F.lit("t"), F.lit(288)), "UTF-8")))
    head = F.when(F.col("kind") == 2, F.concat(F.encode(F.lit("spoiled prefix.."), "UTF-8"), F.substring("head", F.lit(17), F.lit(2048)))).otherwise(F.col("head"))
    return rows.select("inode_id", "sector", F.lit(1).alias("mode"), F.concat(head, F.col("tail")).alias("data"), F.encode(F.concat(F.lit("sub"), (F.col("sector") % 7).cast("string")), "UTF-8").alias("subchannel"))


@registered(f"WITH {_CD} SELECT inode_id, sector, kind <> 2 AS generated_prefix, kind = 0 AS generated_suffix, md5(repeat(h, 64)) AS user_data_hash, CASE WHEN kind = 2 THEN md5('spoiled prefix..') END AS prefix_hash, CASE WHEN kind <> 0 THEN md5(repeat('t', 288)) END AS suffix_hash, md5('sub' || (sector % 7)) AS subchannel_hash FROM c")
def cd_split(spark, sf_dir):
    return sectors.cd_split(_cd(spark, sf_dir)).select("inode_id", "sector", "generated_prefix", "generated_suffix", "user_data_hash", "prefix_hash", "suffix_hash", "subchannel_hash")


@registered(f"WITH {_CD}, u AS (SELECT DISTINCT h FROM c) SELECT 'user_data' AS part, md5(repeat(h, 64)) AS hash, 2048 AS bytes FROM u UNION ALL SELECT 'prefix', md5('spoiled prefix..'), 16 UNION ALL SELECT 'suffix', md5(repeat('t', 288)), 288 UNION ALL SELECT DISTINCT 'subchannel', md5('sub' || (sector % 7)), 4 FROM c")
def cd_dictionaries(spark, sf_dir):
    cut, out = sectors.cd_split(_cd(spark, sf_dir)), None
    for part in ("user_data", "prefix", "suffix", "subchannel"):
        d = sectors.dictionary(cut, part).select(F.lit(part).alias("part"), "hash", F.length("data").alias("bytes"))
        out = d if out is None else out.unionByName(d)
    return out


def _cd_back(spark, sf_dir):
    cut = sectors.cd_split(_cd(spark, sf_dir))
    return cut, {p: sectors.dictionary(cut, p) for p in ("user_data", "prefix", "suffix", "subchannel")}


@registered(f"WITH {_CD}, p AS (SELECT i.inode_id, g.sector FROM (SELECT DISTINCT inode_id FROM c) i, (SELECT unnest(range(102)) AS sector) g) SELECT p.inode_id, p.sector, coalesce(md5(repeat(h, 64)), md5(repeat(chr(0), 2048))) AS user_data, coalesce(kind = 0, false) AS regenerated FROM p LEFT JOIN c USING (inode_id, sector)")
def cd_rebuild(spark, sf_dir):
    """Sectors put together again; those that the map lacks are zeros."""
    cut, d = _cd_back(spark, sf_dir)
    last = cut.select("inode_id").distinct().withColumn("sectors", F.lit(102))
    whole = sectors.cd_rebuilt(cut, d["user_data"], d["prefix"], d["suffix"], last)
    zero = F.col("data") == F.unhex(F.repeat(F.lit("00"), F.lit(2352)))
    return whole.select("inode_id", "sector", F.md5(F.substring("data", F.lit(17), F.lit(2048))).alias("user_data"), F.when(zero, False).otherwise(digests.suffix_is_regenerable(F.col("data"))).alias("regenerated"))


@registered(f"WITH {_CD} SELECT inode_id + 1000 AS inode_id, sector, 'sub' || (sector % 7) AS data FROM c WHERE inode_id < 5")
def cd_subchannel(spark, sf_dir):
    cut, d = _cd_back(spark, sf_dir)
    parents = spark.range(5).select((F.col("id") + 1000).alias("inode_id"), F.col("id").alias("parent_inode_id"))
    return sectors.subchannel_rebuilt(cut, d["subchannel"], parents).select("inode_id", "sector", F.decode("data", "UTF-8").alias("data"))


@registered(f"WITH {_CD} SELECT count(*) AS cd_sectors, count(DISTINCT sector % 7) AS unique_subchannels, count(*) * 100 // count(DISTINCT sector % 7) AS ratio_hundredths FROM c")
def subchannel_ratio(spark, sf_dir):
    return blocks.subchannel_ratio(sectors.cd_split(_cd(spark, sf_dir)))


@registered(f"WITH {_CD} SELECT DISTINCT md5('sub' || (sector % 7)) AS hash FROM c WHERE sector % 7 IN (3, 4)")
def cd_hash_verify(spark, sf_dir):
    """Dictionary entries whose contents no longer give their hash; one of the spoiled ones is deleted first."""
    _, d = _cd_back(spark, sf_dir)
    spoiled = F.decode("data", "UTF-8").isin("sub2", "sub3", "sub4")
    entries = d["subchannel"].withColumn("data", F.when(spoiled, F.concat("data", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("data")))
    return sectors.damaged_parts(sectors.dictionary_delete(entries, spark.range(1).select(F.md5(F.encode(F.lit("sub2"), "UTF-8")).alias("hash"))))


@registered("WITH t AS (SELECT p_partkey AS inode_id, p_size % 7 AS mode, p_size * 3 AS start, p_size * 3 + 10 AS stop FROM part) SELECT inode_id, mode, unnest(range(greatest(start - 5, 0), stop + 1))::BIGINT AS sector FROM t WHERE mode <= 4")
def track_sectors(spark, sf_dir):
    t = model.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("inode_id"), F.lit(1).alias("track"), (F.col("p_size") % 7).alias("mode"), (F.col("p_size") * 3).cast("long").alias("start"), (F.col("p_size") * 3 + 10).cast("long").alias("end"), F.lit(5).cast("long").alias("pregap"))
    return sectors.tracks_to_sectors(t).select("inode_id", "mode", "sector")


def _generator(seed: int, at: int, size: int) -> bytes:
    """A stand-in for a console's generator: any function of seed and place serves."""
    return bytes((seed * 7 + at + k) % 251 for k in range(size))


_JUNK = """WITH x AS (SELECT p_partkey // 100 AS inode_id, p_partkey % 100 AS sector FROM part WHERE p_size < 40 AND p_partkey % 100 >= 8),
g AS (SELECT *, sector - row_number() OVER (PARTITION BY inode_id ORDER BY sector) AS g FROM x)
SELECT inode_id, min(sector) * 16 AS "offset", count(*) * 16 AS length, inode_id + 3 AS seed FROM g GROUP BY inode_id, g"""


@registered(_JUNK)
def junk_regions(spark, sf_dir):
    """Sectors that the generator gives, outside the data region of the first eight, as intervals."""
    part = model.read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("inode_id"), (F.col("p_partkey") % 100).alias("sector"), "p_size", F.lit(16).alias("sector_size"))
    made = junk._made(part.withColumns({"at": F.col("sector") * 16, "seed": F.col("inode_id") + 3}), _generator)
    rows = part.join(made, ["inode_id", "sector"]).select("inode_id", "sector", "sector_size", F.when(F.col("p_size") < 40, F.col("made")).otherwise(F.encode(F.repeat(F.lit("d"), F.lit(16)), "UTF-8")).alias("data"))
    ids = part.select("inode_id").distinct()
    data_regions = ids.select("inode_id", F.lit(0).cast("long").alias("offset"), F.lit(128).cast("long").alias("length"))
    kept, runs = junk.elided(rows, data_regions, ids.withColumn("seed", F.col("inode_id") + 3), _generator, 1024)
    return runs.select("inode_id", "offset", "length", "seed")


def _lagged_rows(spark, sf_dir) -> DataFrame:
    """Blocks of 64 sectors of 64 bytes, each block the stream of a seed of its own, but data in its first four sectors and where p_size is 50."""
    # A block's sectors stay together, so its stream is made once.
    part = spread(model.read(spark, sf_dir, "part").select("p_partkey", "p_size", F.floor(F.col("p_partkey") / 64).alias("_piece")), "_piece", _TASK_SECTORS)
    part = part.select(F.floor(F.col("p_partkey") / 1024).alias("inode_id"), (F.col("p_partkey") % 1024).alias("sector"), "p_size", F.lit(64).alias("sector_size"))
    block = F.concat_ws("/", "inode_id", F.floor(F.col("sector") / 64))
    seed = F.unhex(F.substring(F.concat(*[F.md5(F.concat(block, F.lit(f"/{k}"))) for k in range(5)]), 1, 136))
    made = junk._made(part.withColumn("at", F.col("sector") * 64).withColumn("seed", seed), lagged.repeating(4096))
    data = F.when((F.col("p_size") < 50) & (F.col("sector") % 64 >= 4), F.col("made")).otherwise(F.encode(F.repeat(F.lit("d"), F.lit(64)), "UTF-8"))
    return part.join(made, ["inode_id", "sector"]).select("inode_id", "sector", "sector_size", data.alias("data"))


def _lagged_seeds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    regions = rows.select("inode_id", (F.floor(F.col("sector") / 64) * 4096).alias("offset"), F.lit(256).cast("long").alias("length")).distinct()
    return regions, junk.recovered_seeds(rows, regions, 4096, 4096)


#: A run of 33 sectors holds the 521 words that a seed takes. The seed's first word is left out: two of its bits are in no stream.
_LAGGED = """WITH x AS (SELECT p_partkey // 1024 AS inode_id, p_partkey % 1024 AS sector, p_partkey % 1024 // 64 AS block FROM part WHERE p_size < 50 AND p_partkey % 64 >= 4),
g AS (SELECT *, sector - row_number() OVER (PARTITION BY inode_id, block ORDER BY sector) AS g FROM x),
runs AS (SELECT inode_id, block, min(sector) AS first, count(*) AS n, inode_id || '/' || block AS b FROM g GROUP BY inode_id, block, g),
seeds AS (SELECT DISTINCT inode_id, block, substr(md5(b || '/0') || md5(b || '/1') || md5(b || '/2') || md5(b || '/3') || md5(b || '/4'), 9, 128) AS seed FROM runs WHERE n >= 33)
"""


@registered(_LAGGED + "SELECT inode_id, block, seed FROM seeds")
def junk_seeds(spark, sf_dir):
    """Seeds of blocks, found from their sectors."""
    _, seeds = _lagged_seeds(_lagged_rows(spark, sf_dir))
    return seeds.select("inode_id", "block", F.lower(F.hex(F.substring("seed", 5, 64))).alias("seed"))


@registered(_LAGGED + 'SELECT inode_id, first * 64 AS "offset", n * 64 AS length, seed FROM runs JOIN seeds USING (inode_id, block)')
def junk_of_blocks(spark, sf_dir):
    """Intervals of sectors that the seeds found give, block by block."""
    rows = _lagged_rows(spark, sf_dir)
    regions, seeds = _lagged_seeds(rows)
    _, runs = junk.elided(rows, regions, seeds, lagged.repeating(4096), 4096, 4096)
    return runs.select("inode_id", "offset", "length", F.lower(F.hex(F.substring("seed", 5, 64))).alias("seed"))


@registered(_JUNK + " HAVING inode_id % 2 = 1")
def junk_delete(spark, sf_dir):
    """Intervals after those of every second object are deleted."""
    runs = junk_regions(spark, sf_dir)
    return junk.delete(runs, runs.where("inode_id % 2 = 0").select("inode_id"))


@registered(f'WITH {_REGIONS}, f AS (SELECT DISTINCT inode_id, "at" // 60000 AS m, "at" // 3600000 AS h FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE p.inode_id = r.inode_id AND "at" // 60000 >= "offset" // 60000 AND "at" // 60000 < "offset" // 60000 + length // 60000)), g AS (SELECT *, m - row_number() OVER (PARTITION BY inode_id, h ORDER BY m) AS g FROM f) SELECT inode_id, h AS block, min(m) AS first, max(m) AS last, count(*) AS n FROM g GROUP BY inode_id, h, g')
def runs_within_blocks(spark, sf_dir):
    """Minutes outside every region, as runs that do not cross an hour."""
    minute = 60_000
    p = model.points(spark, sf_dir).select("inode_id", F.call_function("div", F.col("at"), F.lit(minute)).alias("at")).distinct()
    r = model.regions(spark, sf_dir).select("inode_id", F.call_function("div", F.col("offset"), F.lit(minute)).alias("offset"), F.call_function("div", F.col("length"), F.lit(minute)).alias("length"))
    return intervals.runs_within_blocks(p, r, ["inode_id"], _HOUR // minute, 1 << 16)


# Blocks

_BLOCKS = "b AS (SELECT l_orderkey * 10 + l_linenumber AS lba, CASE WHEN l_orderkey % 11 = 0 THEN 'NOPE' ELSE 'BLCK' END AS magic, 64::BIGINT AS header_bytes, CAST(l_partkey * 40 AS BIGINT) AS original_bytes, CAST(l_partkey * 40 - l_linenumber % 3 * l_partkey * 10 AS BIGINT) AS stored_bytes, md5(CAST(l_suppkey AS VARCHAR)) AS checksum, CAST(CASE WHEN l_orderkey % 7 = 0 THEN -1 ELSE l_suppkey END AS VARCHAR) AS payload FROM lineitem)"
_PHYSICAL = "p AS (SELECT count(*) AS blocks, count(*) FILTER (stored_bytes < original_bytes) AS compressed, count(*) FILTER (stored_bytes >= original_bytes) AS uncompressed, sum(original_bytes)::BIGINT AS original_bytes, sum(stored_bytes)::BIGINT AS stored_bytes, sum((header_bytes + stored_bytes + 4095) // 4096 * 4096)::BIGINT AS physical_bytes FROM (SELECT lba, max(header_bytes) AS header_bytes, max(original_bytes) AS original_bytes, max(stored_bytes) AS stored_bytes FROM b GROUP BY lba))"


def _blocks(spark, sf_dir) -> DataFrame:
    li = model.read(spark, sf_dir, "lineitem")
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    return li.select(
        (F.col("l_orderkey") * 10 + n).alias("lba"), F.when(F.col("l_orderkey") % 11 == 0, "NOPE").otherwise("BLCK").alias("magic"), F.lit(64).cast("long").alias("header_bytes"),
        (part * 40).cast("long").alias("original_bytes"), (part * 40 - n % 3 * part * 10).cast("long").alias("stored_bytes"),
        F.md5(F.col("l_suppkey").cast("string").cast("binary")).alias("checksum"), F.when(F.col("l_orderkey") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col("l_suppkey")).cast("string").alias("payload"),
    )


@registered(f"WITH {_BLOCKS}, {_PHYSICAL} SELECT * FROM p")
def physical_blocks(spark, sf_dir):
    return blocks.physical(_blocks(spark, sf_dir), 4096)


@registered(f"WITH {_BLOCKS}, {_PHYSICAL} SELECT original_bytes, stored_bytes, original_bytes * 100 // stored_bytes AS ratio_hundredths, (original_bytes - stored_bytes) * 10000 // original_bytes AS saved_basis_points FROM p")
def compression_ratio(spark, sf_dir):
    return blocks.compression(_blocks(spark, sf_dir), 4096)


@registered(f"WITH {_SECTORS}, {_BLOCKS}, {_PHYSICAL} SELECT 'logical' AS step, sum(length(text))::BIGINT AS bytes FROM documents UNION ALL SELECT 'deduplicated', sum(sector_size)::BIGINT FROM (SELECT DISTINCT sector_size, hash FROM s) UNION ALL SELECT 'compressed', stored_bytes FROM p UNION ALL SELECT 'physical', physical_bytes FROM p")
def savings_chain(spark, sf_dir):
    images = model.images(spark, sf_dir)
    unique = sectors.sector_map(sectors.sliced(images)).select("sector_size", "hash").distinct().select(F.col("sector_size").alias("bytes"))
    return blocks.savings_chain(images.select(F.length("data").alias("bytes")), unique, _blocks(spark, sf_dir), 4096)


@registered(f"WITH {_BLOCKS} SELECT lba, CASE WHEN magic <> 'BLCK' THEN 'magic' ELSE 'checksum' END AS fault FROM b WHERE magic <> 'BLCK' OR checksum <> md5(payload)")
def block_scrub(spark, sf_dir):
    return blocks.scrub(_blocks(spark, sf_dir), lambda c: F.md5(c.cast("binary")))


@registered("WITH e AS (SELECT DISTINCT l_suppkey AS inode_id, l_partkey AS lba FROM lineitem WHERE l_suppkey = 5), g AS (SELECT lba + 1 AS first, lead(lba) OVER (ORDER BY lba) - 1 AS last FROM e) SELECT first, first + 2 AS last FROM g WHERE last - first + 1 >= 3 ORDER BY first < 50, first LIMIT 1")
def block_alloc(spark, sf_dir):
    """Three free blocks, looked for from block 50 on."""
    places = model.read(spark, sf_dir, "lineitem").where("l_suppkey = 5").select(F.col("l_suppkey").alias("inode_id"), F.col("l_partkey").alias("lba"))
    return intervals.first_fit(intervals.gaps(places, ["inode_id"]), 3, 50)


@registered("""WITH x AS (SELECT l_orderkey AS inode_id, l_partkey AS logical_offset, l_suppkey + l_linenumber * 1000 AS start_block, CAST(l_linenumber * 3 AS BIGINT) AS count FROM lineitem),
s AS (SELECT * FROM x WHERE inode_id = 1), b AS (SELECT * FROM x WHERE inode_id <> 3 UNION ALL SELECT inode_id, logical_offset, start_block, least(logical_offset + count, 0) - logical_offset FROM x WHERE inode_id = 3 AND logical_offset < 0
UNION ALL SELECT inode_id, greatest(logical_offset, 3000), start_block + greatest(logical_offset, 3000) - logical_offset, logical_offset + count - greatest(logical_offset, 3000) FROM x WHERE inode_id = 3 AND logical_offset + count > 3000
UNION ALL SELECT 3, greatest(logical_offset, 0), start_block + greatest(logical_offset, 0) - logical_offset, least(logical_offset + count, 3000) - greatest(logical_offset, 0) FROM s WHERE logical_offset < 3000)
SELECT lba, count(*) AS ref_count FROM (SELECT unnest(range(start_block, start_block + count)) AS lba FROM b) GROUP BY lba HAVING count(*) > 1""")
def clone_refcounts(spark, sf_dir):
    """Reference counts after a range of whole blocks of one file is shared into another."""
    li = model.read(spark, sf_dir, "lineitem")
    x = li.select(F.col("l_orderkey").alias("inode_id"), F.col("l_partkey").alias("logical_offset"), (F.col("l_suppkey") + F.col("l_linenumber") * 1000).alias("start_block"), (F.col("l_linenumber") * 3).cast("long").alias("count"))
    after = sectors.cloned_extents(x, 1, 3, 0, 3000 * 4096, 4096)
    return integrity.refcounts(after.withColumnRenamed("count", "block_count"))


@registered("""WITH r AS (SELECT l_partkey AS lba, count(*) AS refs, count(*) FILTER (l_linenumber > 1) AS gone FROM lineitem GROUP BY 1) SELECT lba, refs - gone AS refs FROM r""")
def free_blocks(spark, sf_dir):
    """Blocks lose the references of released lines; those without any are free (refs 0)."""
    li = model.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("lba"), "l_linenumber")
    left, free = sectors.freed(li.groupBy("lba").agg(F.count(F.lit(1)).alias("refs")), li.where("l_linenumber > 1").select("lba"))
    return left.unionByName(free.withColumn("refs", F.lit(0).cast("long")))


_VOLUMES = "v AS (SELECT s_suppkey AS volume, CASE WHEN s_suppkey % 5 = 0 THEN 3000 ELSE 1024 << CAST(s_suppkey % 4 AS INTEGER) END AS block_size, CASE WHEN s_suppkey % 7 = 0 THEN 1024 ELSE 4194304 END AS dedup_block_size, 100000000 + s_suppkey % 2 AS total_bytes, s_suppkey % 6 AS next_inode_id, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE s_suppkey * 500 END AS bitmap_lba, 10 AS bitmap_blocks, CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE 'x' || chr(0) END AS label, CASE s_suppkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 2000000000 ELSE 1000 END AS created FROM supplier)"


@registered(f"""WITH {_VOLUMES} SELECT volume, 'block size is no power of two' AS fault FROM v WHERE block_size = 3000 UNION ALL SELECT volume, 'block size is below 4096' FROM v WHERE block_size IN (1024, 2048)
UNION ALL SELECT volume, 'dedup block size is below the block size' FROM v WHERE dedup_block_size < block_size UNION ALL SELECT volume, 'size is no multiple of the block size' FROM v WHERE total_bytes % block_size <> 0
UNION ALL SELECT volume, 'next inode is below 3' FROM v WHERE next_inode_id < 3 UNION ALL SELECT volume, 'bitmap is missing' FROM v WHERE bitmap_lba = 0 UNION ALL SELECT volume, 'bitmap is out of range' FROM v WHERE bitmap_lba > 0 AND bitmap_lba + 10 > total_bytes // block_size
UNION ALL SELECT volume, 'label has no end' FROM v WHERE label = 'x' UNION ALL SELECT volume, 'time is not set' FROM v WHERE created = 0 UNION ALL SELECT volume, 'time is in the future' FROM v WHERE created > 1700000000""")
def volume_check(spark, sf_dir):
    k = F.col("s_suppkey")
    v = model.read(spark, sf_dir, "supplier").select(
        k.alias("volume"), F.when(k % 5 == 0, F.lit(3000).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1024).cast("long"), (k % 4).cast("int"))).alias("block_size"), F.when(k % 7 == 0, 1024).otherwise(4194304).cast("long").alias("dedup_block_size"),
        (F.lit(100_000_000) + k % 2).cast("long").alias("total_bytes"), (k % 6).alias("next_inode_id"), F.when(k % 9 == 0, 0).otherwise(k * 500).cast("long").alias("bitmap_lba"), F.lit(10).cast("long").alias("bitmap_blocks"),
        F.when(k % 3 == 0, "x").otherwise("x\0").alias("label"), F.when(k % 8 == 0, 0).when(k % 8 == 1, 2_000_000_000).otherwise(1000).alias("created"),
    )
    return integrity.volume_faults(v, 1_700_000_000)


# Sources, indexes and streaming


@registered("SELECT CAST(p_partkey AS VARCHAR) AS path, 'TITLE' AS key, p_name AS value FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'SIZE', CAST(p_size AS VARCHAR) FROM part")
def sfo_metadata(spark, sf_dir):
    """Files of a text and a number, made here and read by the parser."""

    def little(c, n: int):
        return F.concat(*[F.lpad(F.hex(F.pmod(F.floor(c / F.lit(256**k)), F.lit(256))), 2, "0") for k in range(n)])

    size = F.octet_length("p_name")
    head = F.concat(F.lit("0050534601010000"), little(F.lit(52), 4), little(F.lit(63), 4), little(F.lit(2), 4))
    text = F.concat(little(F.lit(0), 2), F.lit("0402"), little(size, 4), little(size, 4), little(F.lit(0), 4))
    number = F.concat(little(F.lit(6), 2), F.lit("0404"), little(F.lit(4), 4), little(F.lit(4), 4), little(size, 4))
    raw = F.unhex(F.concat(head, text, number, F.lit("5449544C450053495A4500"), F.hex("p_name"), little(F.col("p_size"), 4)))
    return binary.key_values(model.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), raw.alias("data")), binary.sfo_entries)


@registered("""WITH g AS (SELECT CAST(p_partkey AS VARCHAR) AS path, 'G' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || CASE p_partkey % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'J' WHEN 2 THEN 'P' ELSE 'Z' END || '01' AS id, p_partkey % 4 AS k, p_size FROM part)
SELECT path, 'GameID' AS key, id AS value FROM g UNION ALL SELECT path, 'MakerCode', '01' FROM g UNION ALL SELECT path, 'DiscNumber', '1' FROM g UNION ALL SELECT path, 'DiscVersion', CAST(p_size AS VARCHAR) FROM g UNION ALL SELECT path, 'Region', CASE k WHEN 0 THEN 'USA' WHEN 1 THEN 'Japan' WHEN 2 THEN 'Europe' ELSE 'Unknown' END FROM g""")
def disc_identity(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.concat(F.lit("G"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.when(k == 0, "E").when(k == 1, "J").when(k == 2, "P").otherwise("Z"), F.lit("01"))
    raw = F.concat(F.encode(text, "UTF-8"), F.unhex(F.concat(F.lit("01"), F.lpad(F.hex("p_size"), 2, "0"), F.repeat(F.lit("00"), F.lit(24)))))
    return binary.disc_identity(model.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), raw.alias("data")))


@registered("SELECT CAST(p_partkey AS BIGINT) AS inode_id, CAST(p_size AS BIGINT) AS num FROM part WHERE p_size BETWEEN 10 AND 20")
def user_index(spark, sf_dir):
    """A numeric index, created, written clustered, and read by a range."""
    index = metadata.UserIndexes()
    index.create("size")
    index.create("name", "string")
    index.drop("name")
    path = f"{shared_dir(spark).rstrip('/')}/user-index-{spark.sparkContext.applicationId}-{sf_dir.rstrip('/').rsplit('/', 1)[-1]}"
    index.materialise(model.part_meta(spark, sf_dir), path)
    return spark.read.parquet(path).where("key = 'size' AND num BETWEEN 10 AND 20").select("inode_id", "num")


@registered(f"WITH {_SECTORS} SELECT DISTINCT sector_size, hash FROM s")
def stream_ingest(spark, sf_dir):
    """The documents as a stream of images, deduplicated batch by batch into a dictionary."""
    from uuid import uuid4

    from vaultlens.streaming import ingest

    base = f"{shared_dir(spark).rstrip('/')}/ingest-{uuid4().hex}"
    docs = spark.readStream.schema(model.read(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern, since a stream takes no path of a single file; it matches a folder of files, too
    images = docs.select(F.col("doc_id").alias("inode_id"), F.when(F.col("lang") == "en", 64).otherwise(128).alias("sector_size"), F.col("text").alias("data"))
    ingest.ingest(images, f"{base}/out", f"{base}/state").awaitTermination()
    return ingest.stored(spark, f"{base}/out")[0].select("sector_size", "hash")
