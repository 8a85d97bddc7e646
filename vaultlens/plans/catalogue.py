"""The engine's registered queries, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens.functions import scalar
from vaultlens.operators import export, hierarchy, integrity, intervals, metadata, sectors, tags
from vaultlens.plans import planner, sqlgen
from vaultlens.sources import model

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def _long_sql(table: str, inode: str, values: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT CAST({inode} AS BIGINT) AS inode_id, '{k}' AS key, CAST({v} AS VARCHAR) AS value FROM {table} WHERE {v} IS NOT NULL" for k, v in values.items())


PARTS = _long_sql("part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"})
ORDERS = _long_sql("orders", f"o_orderkey + {model.ORDERS_FROM}", {"status": "o_orderstatus", "priority": "o_orderpriority", "custkey": "o_custkey"})
_D = "(SELECT doc_id, lang, source, n_chars, text AS t, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
DOCUMENTS = _long_sql(_D, f"doc_id + {model.DOCUMENTS_FROM}", {"lang": "lang", "source": "source", "n_chars": "n_chars", "text": "t", "Comments": "t", "quality": "quality", "toxic": "toxic"})
ALL = f"{PARTS} UNION ALL {ORDERS} UNION ALL {DOCUMENTS}"
CUSTOMERS = _long_sql("customer", "CASE WHEN c_custkey % 11 = 0 THEN c_custkey + 900000000 ELSE c_custkey + 100000 END", {"segment": "c_mktsegment", "nation": "c_nationkey"})
_META = {"parts": (model.part_meta, PARTS), "orders": (model.order_meta, ORDERS), "documents": (model.document_meta, DOCUMENTS), "all": (model.all_meta, ALL)}

#: name: (metadata, query, numeric mode)
FILTER_QUERIES = {
    "op_eq": ("parts", 'brand = "Brand#12"', "index"),
    "op_ne": ("parts", 'type != "ECONOMY"', "index"),
    "op_gt": ("parts", 'name > "red"', "index"),
    "op_lt": ("parts", 'name < "green bolt"', "index"),
    "op_ge": ("parts", 'type >= "PROMO"', "index"),
    "op_le": ("parts", 'type <= "LARGE"', "index"),
    "op_contains": ("documents", 'text CONTAINS "the"', "index"),
    "op_startswith": ("parts", 'name STARTSWITH "blue"', "index"),
    "op_exists": ("documents", "quality EXISTS", "index"),
    "op_ieq": ("parts", 'type I= "economy"', "index"),
    "op_ine": ("documents", 'text I!= "of."', "index"),
    "op_icontains": ("documents", 'text ICONTAINS "É"', "index"),
    "op_istartswith": ("parts", 'name ISTARTSWITH "RED"', "index"),
    "op_neq": ("orders", 'custkey N= "12"', "index"),
    "op_nne": ("parts", 'size N!= "7"', "index"),
    "op_ngt": ("parts", 'size N> "30"', "index"),
    "op_nlt": ("parts", 'size N< " +7"', "index"),
    "op_nge": ("documents", 'n_chars N>= "5000abc"', "index"),
    "op_nle": ("orders", 'custkey N<= "99999999999999999999"', "index"),
    "op_regex": ("documents", 'text REGEX "^[[:upper:]][a-z]+ (the|of)[^[:space:]]* "', "index"),
    "op_iregex": ("parts", 'type IREGEX "^(economy|promo)$"', "index"),
    "op_endswith": ("parts", 'name ENDSWITH "widget"', "index"),
    "op_iendswith": ("parts", 'name IENDSWITH "WIDGET"', "index"),
    "op_in": ("orders", 'status IN "F,P,"', "index"),
    "op_iin": ("orders", 'status IIN "f,p"', "index"),
    "op_between": ("parts", 'name BETWEEN "blue bolt" "green ring"', "index"),
    "op_nbetween": ("parts", 'size NBETWEEN "10" "20"', "index"),
    "op_glob": ("documents", 'text GLOB "The *[.,] ?n*"', "index"),
    "op_iglob": ("parts", 'name IGLOB "RED*[!g]"', "index"),
    "num_scan_mode": ("orders", 'priority N= "5"', "scan"),
    "num_index_mode": ("orders", 'priority N= "5"', "index"),
    "num_scan_multi": ("documents", 'text N= "0"', "scan"),
    "num_index_multi": ("documents", 'text N= "0"', "index"),
    "mv_any": ("documents", 'text = "The and attion to thanedble the, anea. Eriner thanea."', "index"),
    "mv_all": ("documents", 'text != "The and attion to thanedble the, anea. Eriner thanea."', "index"),
    "comments_exempt": ("documents", 'Comments = "The and attion to thanedble the, anea. Eriner thanea."', "index"),
    "wild_contains": ("all", '* CONTAINS "ring"', "index"),
    "wild_numeric": ("all", '* N= "7"', "index"),
    "not_exists": ("documents", "NOT quality EXISTS", "index"),
    "not_wild": ("parts", 'NOT * CONTAINS "red"', "index"),
    "and2": ("parts", 'brand = "Brand#12" AND size N> "20"', "index"),
    "or3": ("parts", 'type = "ECONOMY" OR type = "PROMO" OR size N= "1"', "index"),
    "and4": ("orders", 'status = "F" AND priority STARTSWITH "2" AND custkey N> "10" AND custkey N< "900000"', "index"),
    "group_or_and": ("parts", '(type = "ECONOMY" OR size N>= "30") AND NOT * CONTAINS "red"', "index"),
    "group_and_or": ("parts", 'name STARTSWITH "blue" OR (type = "PROMO" AND size N< "10")', "index"),
    "not_in_group": ("documents", '(NOT toxic = "1" AND quality EXISTS) OR lang = "fr"', "index"),
    "two_nots": ("documents", 'NOT lang = "en" AND NOT toxic EXISTS', "index"),
}


def _filter_query(name: str) -> Query:
    meta, text, numeric = FILTER_QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return planner.select(_META[meta][0](spark, sf_dir), text, numeric)

    run.__name__ = name
    return run


for _name, (_meta, _text, _numeric) in FILTER_QUERIES.items():
    registered(sqlgen.select(_META[_meta][1], _text, _numeric))(_filter_query(_name))

FLAGSHIP = '(type = "ECONOMY" OR size N>= "30") AND NOT * CONTAINS "red"'


def _both(name: str, form: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return planner.select_by_sets(model.part_meta(spark, sf_dir), form)

    run.__name__ = name
    registered(sqlgen.select(PARTS, form))(run)


_both("set_intersect", 'type = "ECONOMY" AND size N>= "30"')
_both("set_union", 'type = "ECONOMY" OR size N>= "30"')
_both("set_except", 'NOT type = "ECONOMY" AND size N>= "30"')


@registered(f"WITH r AS ({sqlgen.select(PARTS, FLAGSHIP)}) SELECT count(*) AS n FROM r")
def count_only(spark, sf_dir):
    return planner.count(model.part_meta(spark, sf_dir), FLAGSHIP)


@registered(f"""WITH meta AS MATERIALIZED ({PARTS}),
f AS (SELECT inode_id, max(key = 'type' AND value = 'ECONOMY') AS a, max(key = 'size' AND CAST(try_cast(value AS BIGINT) AS BIGINT) >= 30) AS b, max(contains(value, 'red')) AS c FROM meta GROUP BY inode_id)
SELECT unnest(['filter0', 'filter1', 'filter2', 'not2', 'group0', 'group1', 'result']) AS step,
       unnest([count(*) FILTER (a), count(*) FILTER (coalesce(b, false)), count(*) FILTER (c), count(*) FILTER (NOT c), count(*) FILTER (NOT c), count(*) FILTER (a OR coalesce(b, false)), count(*) FILTER ((a OR coalesce(b, false)) AND NOT c)]) AS n FROM f""")
def explain_counts(spark, sf_dir):
    return planner.explain(model.part_meta(spark, sf_dir), FLAGSHIP)


def _distinct_sql(meta: str, key: str) -> str:
    return f"SELECT DISTINCT unnest({sqlgen.listed('key', 'value')}) AS value FROM ({meta}) WHERE key = '{key}'"


@registered(_distinct_sql(DOCUMENTS, "text"))
def distinct_key(spark, sf_dir):
    return metadata.distinct(model.document_meta(spark, sf_dir), "text")


@registered(_distinct_sql(DOCUMENTS, "Comments"))
def distinct_comments(spark, sf_dir):
    return metadata.distinct(model.document_meta(spark, sf_dir), "Comments")


@registered(f"SELECT value, count(DISTINCT inode_id) AS n FROM (SELECT inode_id, unnest({sqlgen.listed('key', 'value')}) AS value FROM ({DOCUMENTS}) WHERE key = 'text') GROUP BY value")
def groupby_key(spark, sf_dir):
    return metadata.group_by(model.document_meta(spark, sf_dir), "text")


def _stats_sql(meta: str, key: str) -> str:
    return f"""WITH v AS (SELECT {sqlgen.strtoll('x')} AS n FROM (SELECT unnest({sqlgen.listed('key', 'value')}) AS x FROM ({meta}) WHERE key = '{key}'))
SELECT count(*) AS n, coalesce(min(n), 0) AS min, coalesce(max(n), 0) AS max, CAST(coalesce(sum(n), 0) AS VARCHAR) AS sum,
       CASE WHEN count(*) > 0 THEN CAST(CAST(round(CAST(sum(n) AS DECIMAL(38,0)) * 100 / count(*), 0) AS HUGEINT) AS VARCHAR) END AS avg_hundredths FROM v"""


@registered(_stats_sql(PARTS, "size"))
def stats_key(spark, sf_dir):
    return metadata.stats(model.part_meta(spark, sf_dir), "size")


@registered(_stats_sql(ORDERS, "priority"))
def stats_lenient(spark, sf_dir):
    return metadata.stats(model.order_meta(spark, sf_dir), "priority")


@registered(_stats_sql(ORDERS, "nothing"))
def stats_empty(spark, sf_dir):
    return metadata.stats(model.order_meta(spark, sf_dir), "nothing")


@registered(f"SELECT key, {sqlgen.strtoll('value')} AS num, inode_id FROM ({ALL}) WHERE {sqlgen.whole('value')}")
def numeric_index(spark, sf_dir):
    return metadata.numeric_index(model.all_meta(spark, sf_dir))


@registered(f"SELECT DISTINCT inode_id FROM ({ALL}) WHERE key = 'n_chars' AND try_cast(value AS BIGINT) BETWEEN 1000 AND 2000")
def numeric_range(spark, sf_dir):
    return metadata.numeric_range(metadata.numeric_index(model.all_meta(spark, sf_dir)), "n_chars", 1000, 2000)


@registered(f"SELECT * FROM ({PARTS}) WHERE inode_id = 5 AND key = 'name'")
def point_lookup(spark, sf_dir):
    return metadata.point(model.part_meta(spark, sf_dir), 5, "name")


@registered(f"SELECT key FROM ({PARTS}) WHERE inode_id = 5")
def list_keys(spark, sf_dir):
    return metadata.keys_of(model.part_meta(spark, sf_dir), 5)


@registered(f"WITH r AS ({sqlgen.select(PARTS, FLAGSHIP)}), l AS (SELECT inode_id FROM r ORDER BY inode_id LIMIT 20) SELECT inode_id, p_name AS name FROM l JOIN part ON p_partkey = inode_id")
def limit_then_sort(spark, sf_dir):
    meta = model.part_meta(spark, sf_dir)
    rows = metadata.with_metadata(metadata.limited(planner.select(meta, FLAGSHIP), 20), meta, ["name"])
    return metadata.ordered(rows, "name").select("inode_id", F.col("metadata")["name"].alias("name"))


@registered("SELECT p_partkey AS inode_id, p_size AS size FROM part WHERE p_type = 'PROMO' ORDER BY p_size DESC, p_partkey LIMIT 25")
def sort_numeric_desc(spark, sf_dir):
    meta = model.part_meta(spark, sf_dir)
    rows = metadata.with_metadata(planner.select(meta, "type = PROMO"), meta, ["size"])
    return metadata.top(rows, "N:size", 25, reverse=True).select("inode_id", F.col("metadata")["size"].cast("int").alias("size"))


@registered(f"SELECT inode_id, string_agg(key || '=' || value, ';' ORDER BY key) AS metadata FROM ({PARTS}) WHERE inode_id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#12') GROUP BY inode_id")
def attach_metadata(spark, sf_dir):
    meta = model.part_meta(spark, sf_dir)
    rows = metadata.with_metadata(planner.select(meta, 'brand = "Brand#12"'), meta)
    return rows.select("inode_id", F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"))


@registered(f"SELECT doc_id + {model.DOCUMENTS_FROM} AS inode_id, lang, source, coalesce(CAST(quality AS VARCHAR), '') AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'de'")
def pivot_wide(spark, sf_dir):
    meta = model.document_meta(spark, sf_dir)
    return metadata.wide(planner.select(meta, "lang = de"), meta, ["lang", "source", "quality"])


_WALK = """WITH RECURSIVE e AS (SELECT r_regionkey + 10 AS inode_id, 2 AS parent_id, r_name AS name, true AS is_dir FROM region
UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, n_name, true FROM nation UNION ALL SELECT c_custkey + 100000, c_nationkey + 100, c_name, false FROM customer),
w(inode_id, path, depth) AS (SELECT CAST(2 AS BIGINT), '', 0 UNION ALL SELECT CAST(e.inode_id AS BIGINT), w.path || '/' || e.name, w.depth + 1 FROM w JOIN e ON e.parent_id = w.inode_id)"""


@registered(f"{_WALK} SELECT inode_id, path, depth FROM w WHERE inode_id <> 2")
def paths(spark, sf_dir):
    return hierarchy.paths(model.catalog(spark, sf_dir))


@registered(f"{_WALK} SELECT inode_id, path, depth FROM w WHERE inode_id <> 2")
def paths_recursive(spark, sf_dir):
    return hierarchy.paths_recursive(model.catalog(spark, sf_dir))


@registered(f"{_WALK}, m AS ({CUSTOMERS}) SELECT inode_id, path FROM w JOIN (SELECT DISTINCT inode_id FROM m WHERE key = 'segment' AND value = 'BUILDING') USING (inode_id)")
def query_paths(spark, sf_dir):
    ids = planner.select(model.customer_meta(spark, sf_dir), "segment = BUILDING")
    return hierarchy.resolved(ids, hierarchy.paths(model.catalog(spark, sf_dir)))


@registered("SELECT CAST(n_nationkey + 100 AS BIGINT) AS inode_id, 11::BIGINT AS parent_id, true AS is_dir, n_name AS name FROM nation WHERE n_regionkey = 1")
def dir_listing(spark, sf_dir):
    return hierarchy.listing(model.catalog(spark, sf_dir), 11)


@registered(f"{_WALK} SELECT inode_id, path, depth FROM w WHERE starts_with(path, '/ASIA/')")
def subtree(spark, sf_dir):
    return hierarchy.subtree(hierarchy.paths(model.catalog(spark, sf_dir)), "/ASIA")


@registered("""SELECT CAST(r_regionkey + 10 AS BIGINT) AS ancestor, CAST(n_nationkey + 100 AS BIGINT) AS inode_id FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), CAST(c_custkey + 100000 AS BIGINT) FROM nation JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT CAST(n_regionkey + 10 AS BIGINT), CAST(c_custkey + 100000 AS BIGINT) FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def ancestors(spark, sf_dir):
    return hierarchy.ancestors(hierarchy.paths(model.catalog(spark, sf_dir)))


@registered("SELECT CAST(c_custkey + 900000000 AS BIGINT) AS inode_id FROM customer WHERE c_custkey % 11 = 0")
def orphans(spark, sf_dir):
    return hierarchy.orphans(model.customer_meta(spark, sf_dir).select("inode_id").distinct(), model.catalog(spark, sf_dir)).select("inode_id")


@registered("SELECT CAST(c_custkey + 100000 AS BIGINT) AS inode_id, c_name AS name FROM customer WHERE c_custkey % 11 = 0")
def dangling(spark, sf_dir):
    inodes = model.customer_meta(spark, sf_dir).select("inode_id").distinct()
    return hierarchy.dangling(inodes, model.catalog(spark, sf_dir).where("NOT is_dir")).select("inode_id", "name")


@registered(f"SELECT inode_id, key, value, CASE WHEN value LIKE 'Brand#1%' THEN 'index' ELSE 'primary' END AS missing_from FROM ({PARTS}) WHERE key = 'brand' AND (value LIKE 'Brand#1%' OR value LIKE 'Brand#2%')")
def meta_index_diff(spark, sf_dir):
    meta = model.part_meta(spark, sf_dir)
    brand = F.col("key") == "brand"
    primary = meta.where(~(brand & F.col("value").startswith("Brand#2")))
    return metadata.index_differences(primary, meta.where(~(brand & F.col("value").startswith("Brand#1"))))


@registered("SELECT CAST(p_partkey AS BIGINT) AS inode_id, 'size' AS key, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size + 1000 ELSE p_size END AS VARCHAR) AS value FROM part UNION ALL SELECT CAST(p_partkey AS BIGINT), 'note', 'new' FROM part WHERE p_partkey % 5 = 0")
def upsert_latest(spark, sf_dir):
    part = model.read(spark, sf_dir, "part")
    meta = model.long_form(part, F.col("p_partkey"), {"size": F.col("p_size")})
    old = model.long_form(part.where("p_partkey % 4 = 0"), F.col("p_partkey"), {"size": F.lit(1)}).withColumn("version", F.lit(1).cast("long"))
    new = model.long_form(part.where("p_partkey % 2 = 0"), F.col("p_partkey"), {"size": F.col("p_size") + 1000}).withColumn("version", F.lit(2).cast("long"))
    more = model.long_form(part.where("p_partkey % 5 = 0"), F.col("p_partkey"), {"note": F.lit("new")}).withColumn("version", F.lit(2).cast("long"))
    return metadata.upsert(meta, old.unionByName(new).unionByName(more))


@registered(f"SELECT * FROM ({PARTS}) WHERE NOT (key = 'size' AND inode_id % 3 = 0) AND inode_id % 7 <> 0")
def delete_metadata(spark, sf_dir):
    meta = model.part_meta(spark, sf_dir)
    kept = metadata.delete(meta, meta.where("key = 'size' AND inode_id % 3 = 0").select("inode_id", "key"))
    return metadata.delete_all(kept, meta.where("inode_id % 7 = 0").select("inode_id").distinct())


# Sectors

_SECTORS = """s AS (SELECT inode_id, k AS sector, size AS sector_size, md5(substr(data, k * size + 1, size)) AS hash, substr(data, k * size + 1, size) AS data
FROM (SELECT inode_id, size, data, unnest(range(CAST(ceil(length(data) / size) AS BIGINT))) AS k FROM (SELECT doc_id AS inode_id, CASE WHEN lang = 'en' THEN 64 ELSE 128 END AS size, text AS data FROM documents)))"""


@registered(f"WITH {_SECTORS} SELECT inode_id, sector, sector_size, hash FROM s")
def sector_map(spark, sf_dir):
    return sectors.sector_map(sectors.sliced(model.images(spark, sf_dir)))


@registered(f"""WITH {_SECTORS}, u AS (SELECT sector_size, hash, count(*) AS n FROM s GROUP BY ALL)
SELECT sector_size, sum(n)::BIGINT AS refs, count(*) AS unique_sectors, floor(sum(n) * 100 / count(*))::BIGINT AS ratio_hundredths, (sum(n) - count(*))::BIGINT AS duplicates, count(*) * sector_size AS unique_bytes FROM u GROUP BY sector_size""")
def dedup_stats(spark, sf_dir):
    return sectors.statistics(sectors.sector_map(sectors.sliced(model.images(spark, sf_dir))))


@registered("SELECT doc_id AS inode_id, text AS data FROM documents WHERE length(text) > 0")
def reconstruct(spark, sf_dir):
    cut = sectors.sliced(model.images(spark, sf_dir))
    empty = spark.createDataFrame([], "sector_size int, hash string")
    dictionary, smap = sectors.store(cut, empty)
    return sectors.rebuilt(smap, dictionary)


@registered(f"""WITH {_SECTORS}, f AS (SELECT sector_size, hash, min((inode_id, sector)) AS f FROM s GROUP BY ALL)
SELECT sector_size, hash, f[1] AS first_inode, f[2] AS first_sector FROM f WHERE (sector_size, hash) NOT IN (SELECT (sector_size, hash) FROM s WHERE inode_id % 2 = 0)""")
def new_sectors(spark, sf_dir):
    cut = sectors.sliced(model.images(spark, sf_dir))
    index = cut.where("inode_id % 2 = 0").select("sector_size", "hash").distinct()
    return sectors.new_places(cut, index)


@registered(f"WITH {_SECTORS} SELECT DISTINCT sector_size, hash FROM s WHERE substr(hash, 1, 1) = 'a'")
def hash_verify(spark, sf_dir):
    dictionary, _ = sectors.store(sectors.sliced(model.images(spark, sf_dir)), spark.createDataFrame([], "sector_size int, hash string"))
    broken = dictionary.withColumn("data", F.when(F.col("hash").startswith("a"), F.concat("data", F.lit("!"))).otherwise(F.col("data")))
    return sectors.damaged(broken)


@registered("SELECT CASE WHEN lang = 'en' THEN 64 ELSE 128 END AS sector_size, count(*) AS files, sum(length(text))::BIGINT AS size, sum(ceil(length(text) / CASE WHEN lang = 'en' THEN 64 ELSE 128 END))::BIGINT AS sectors FROM documents GROUP BY 1")
def media_totals(spark, sf_dir):
    return sectors.media_totals(model.images(spark, sf_dir))


@registered(f"""WITH {_SECTORS}, u AS (SELECT sum(sector_size)::BIGINT AS uniq FROM (SELECT DISTINCT sector_size, hash FROM s)), l AS (SELECT sum(length(text))::BIGINT AS logical FROM documents)
SELECT logical, uniq AS unique, floor((logical - uniq) * 10000 / logical)::BIGINT AS saved_basis_points FROM u, l""")
def savings(spark, sf_dir):
    images = model.images(spark, sf_dir)
    return sectors.savings(images, sectors.sector_map(sectors.sliced(images)))


@registered(f"""WITH {_SECTORS} SELECT inode_id, sector, sector_size, hash FROM s WHERE NOT (inode_id = 4 AND sector BETWEEN 0 AND 4)
UNION ALL SELECT 4, sector - 2, sector_size, hash FROM s WHERE inode_id = 3 AND sector BETWEEN 2 AND 6""")
def clone_range(spark, sf_dir):
    return sectors.cloned(sectors.sector_map(sectors.sliced(model.images(spark, sf_dir))), source=3, target=4, first=2, count=5)


@registered(f"""WITH {_SECTORS}, u AS (SELECT DISTINCT hash FROM s WHERE sector_size = 64), p AS (SELECT hash, row_number() OVER (ORDER BY hash) - 1 AS r FROM u)
SELECT 64 AS sector_size, hash, r // 65536 AS lba, (r % 65536) * 64 AS "offset" FROM p""")
def append_positions(spark, sf_dir):
    dictionary, _ = sectors.store(sectors.sliced(model.images(spark, sf_dir)), spark.createDataFrame([], "sector_size int, hash string"))
    return sectors.placed(dictionary, 64).drop("data")


@registered("""SELECT DISTINCT 256 AS sector_size, md5(substr(html, k * 256 + 1, 256)) AS hash FROM (SELECT html, unnest(range(CAST(ceil(length(html) / 256) AS BIGINT))) AS k FROM pages)""")
def page_dictionary(spark, sf_dir):
    return sectors.new_places(sectors.sliced(model.page_images(spark, sf_dir)), spark.createDataFrame([], "sector_size int, hash string")).select("sector_size", "hash")


# Intervals

_REGIONS = """r AS (SELECT user_id AS inode_id, o AS "offset", least(coalesce(lead(o) OVER (PARTITION BY user_id ORDER BY o) - o, 3600000), 3600000) AS length, (e % 4)::INTEGER AS partition_index
FROM (SELECT user_id, epoch_us(ts) // 1000 AS o, min(event_id) AS e FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)),
p AS (SELECT event_id, user_id AS inode_id, epoch_us(ts) // 1000 AS "at" FROM events WHERE event_id % 3 <> 0)"""
_HOUR = 3_600_000


@registered(f'WITH {_REGIONS} SELECT event_id, p.inode_id, "at", "offset", length, partition_index FROM p JOIN r ON p.inode_id = r.inode_id AND "at" >= "offset" AND "at" < "offset" + length')
def range_lookup(spark, sf_dir):
    return intervals.locate(model.points(spark, sf_dir), model.regions(spark, sf_dir), _HOUR)


@registered(f'WITH {_REGIONS} SELECT event_id, inode_id, "at" FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE p.inode_id = r.inode_id AND "at" >= "offset" AND "at" < "offset" + length)')
def outside_regions(spark, sf_dir):
    return intervals.outside(model.points(spark, sf_dir), model.regions(spark, sf_dir), _HOUR)


@registered(f'WITH {_REGIONS} SELECT event_id, p.inode_id, "at", coalesce("offset", -1) AS "offset", coalesce(length, -1) AS length, coalesce(partition_index, -1) AS partition_index FROM p ASOF LEFT JOIN r ON p.inode_id = r.inode_id AND p."at" >= r."offset"')
def as_of_lookup(spark, sf_dir):
    return intervals.as_of(model.points(spark, sf_dir), model.regions(spark, sf_dir)).na.fill(-1)


@registered(f'WITH {_REGIONS} SELECT event_id, p.inode_id, "at", coalesce(partition_index, 0) AS partition_index FROM p LEFT JOIN r ON p.inode_id = r.inode_id AND "at" >= "offset" AND "at" < "offset" + length')
def partition_lookup(spark, sf_dir):
    return intervals.partition_or_first(model.points(spark, sf_dir), model.regions(spark, sf_dir), _HOUR).select("event_id", "inode_id", "at", "partition_index")


@registered("SELECT user_id AS inode_id, event_id AS at, user_id % 10 = 3 AND event_id BETWEEN 100 AND 5000 AS plain FROM events")
def plain_sectors(spark, sf_dir):
    events = model.read(spark, sf_dir, "events")
    spans = events.where("user_id % 10 = 3").select(F.col("user_id").alias("inode_id"), F.lit(100).cast("long").alias("start_sector"), F.lit(5000).cast("long").alias("end_sector")).distinct()
    return intervals.inside_any(events.select(F.col("user_id").alias("inode_id"), F.col("event_id").alias("at")), spans)


@registered(f'WITH {_REGIONS}, x AS (SELECT inode_id, "offset" AS ao, "offset" + length * 2 AS ae FROM r), y AS (SELECT inode_id, "offset" + 600000 AS bo, "offset" + 600000 + length AS be FROM r) SELECT x.inode_id, ao AS a_id, bo AS b_id, greatest(ao, bo) AS start, least(ae, be) AS stop FROM x JOIN y ON x.inode_id = y.inode_id AND ao < be AND bo < ae')
def overlap(spark, sf_dir):
    r = model.regions(spark, sf_dir)
    x = r.select("inode_id", F.col("offset").alias("id"), "offset", (F.col("length") * 2).alias("length"))
    y = r.select("inode_id", (F.col("offset") + 600_000).alias("id"), (F.col("offset") + 600_000).alias("offset"), "length")
    return intervals.overlaps(x, y, _HOUR)


@registered("""WITH e AS (SELECT DISTINCT l_orderkey AS inode_id, l_linenumber AS o, l_linenumber // 4 AS seed FROM lineitem),
m AS (SELECT *, sum(CASE WHEN lag_o = o - 1 AND lag_s = seed THEN 0 ELSE 1 END) OVER (PARTITION BY inode_id ORDER BY o) AS g FROM (SELECT *, lag(o) OVER w AS lag_o, lag(seed) OVER w AS lag_s FROM e WINDOW w AS (PARTITION BY inode_id ORDER BY o)))
SELECT inode_id, seed, min(o)::BIGINT AS "offset", count(*) AS length FROM m GROUP BY inode_id, seed, g""")
def merge_adjacent(spark, sf_dir):
    li = model.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("inode_id"), F.col("l_linenumber").cast("long").alias("offset"), F.floor(F.col("l_linenumber") / 4).cast("int").alias("seed"))
    return intervals.merge_adjacent(li.withColumn("length", F.lit(1).cast("long")), ["seed"], once=True)


@registered("""WITH e AS (SELECT DISTINCT l_suppkey AS inode_id, l_partkey AS lba FROM lineitem)
SELECT inode_id, min(lba) AS first, max(lba) AS last, count(*) AS n FROM (SELECT *, lba - row_number() OVER (PARTITION BY inode_id ORDER BY lba) AS g FROM e) GROUP BY inode_id, g""")
def islands(spark, sf_dir):
    return intervals.islands(_lines(spark, sf_dir), ["inode_id"])


def _lines(spark, sf_dir):
    return model.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("inode_id"), F.col("l_partkey").alias("lba"))


@registered("""WITH e AS (SELECT DISTINCT l_suppkey AS inode_id, l_partkey AS lba FROM lineitem)
SELECT inode_id, lba + 1 AS first, n - 1 AS last FROM (SELECT *, lead(lba) OVER (PARTITION BY inode_id ORDER BY lba) AS n FROM e) WHERE n > lba + 1""")
def gaps(spark, sf_dir):
    return intervals.gaps(_lines(spark, sf_dir), ["inode_id"])


@registered("""WITH e AS (SELECT DISTINCT l_suppkey AS inode_id, l_partkey AS lba FROM lineitem), r AS (SELECT inode_id, count(*) AS n FROM (SELECT *, lba - row_number() OVER (PARTITION BY inode_id ORDER BY lba) AS g FROM e) GROUP BY inode_id, g)
SELECT inode_id, sum(n)::BIGINT AS items, count(*) AS runs, CASE WHEN sum(n) <= 1 THEN 0 ELSE floor((count(*) - 1) * 10000 / (sum(n) - 1))::BIGINT END AS basis_points FROM r GROUP BY inode_id""")
def frag_pct(spark, sf_dir):
    return intervals.fragmentation(_lines(spark, sf_dir), ["inode_id"])


@registered("""WITH m AS (SELECT user_id, event_id, event_type, sum(CASE WHEN p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events))
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM m GROUP BY user_id, event_type, g""")
def runs_of_equal(spark, sf_dir):
    return intervals.runs_of_equal(model.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@registered("""WITH s AS (SELECT DISTINCT user_id AS inode_id, epoch_us(ts) // 1000 AS o FROM events) SELECT inode_id, o AS "offset", coalesce(lead(o) OVER (PARTITION BY inode_id ORDER BY o), 1800000000000) - o AS length FROM s""")
def ranges_from_starts(spark, sf_dir):
    starts = model.read(spark, sf_dir, "events").select(F.col("user_id").alias("inode_id"), model.millis("ts").alias("offset")).distinct()
    return intervals.ranges_from_starts(starts, F.lit(1_800_000_000_000))


@registered('SELECT l_orderkey AS inode_id, greatest(l_partkey, 100) AS logical_offset, l_suppkey + greatest(l_partkey, 100) - l_partkey AS start_block, least(l_partkey + l_linenumber * 50, 900) - greatest(l_partkey, 100) AS count FROM lineitem WHERE least(l_partkey + l_linenumber * 50, 900) > greatest(l_partkey, 100)')
def clip_extents(spark, sf_dir):
    li = model.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("inode_id"), F.col("l_partkey").alias("logical_offset"), F.col("l_suppkey").alias("start_block"), (F.col("l_linenumber") * 50).cast("long").alias("count"))
    return intervals.clipped(li, 100, 900)


# Integrity

_EXTENTS = "x AS (SELECT l_orderkey AS inode_id, l_partkey AS start_block, (l_linenumber % 4)::BIGINT AS block_count, ((l_linenumber + l_orderkey) % 5)::BIGINT AS logical_count FROM lineitem)"
_REFS = f"{_EXTENTS}, b AS (SELECT lba, count(*) AS refs FROM (SELECT unnest(range(start_block, start_block + block_count)) AS lba FROM x WHERE block_count > 0) GROUP BY lba)"


@registered(f"""WITH {_EXTENTS}, f AS (SELECT *, CASE WHEN block_count = 0 THEN 'empty' WHEN start_block = 0 THEN 'no start' WHEN start_block + block_count > 1500 THEN 'out of bounds' WHEN logical_count < block_count THEN 'logical below physical' END AS fault FROM x)
SELECT * FROM f WHERE fault IS NOT NULL AND NOT (start_block = 0 AND block_count = 0 AND logical_count = 0)""")
def extent_check(spark, sf_dir):
    return integrity.extent_faults(model.extents(spark, sf_dir), 1500)


@registered(f"WITH {_REFS} SELECT lba, refs AS ref_count FROM b WHERE refs > 1")
def refcounts(spark, sf_dir):
    return integrity.refcounts(model.extents(spark, sf_dir))


@registered(f"""WITH {_REFS}, s AS (SELECT lba, refs + (CASE WHEN lba % 10 = 0 THEN 1 ELSE 0 END) AS stored FROM b WHERE refs > 1 AND lba % 7 <> 0 UNION ALL SELECT 1000000, 3), e AS (SELECT lba, refs AS expected FROM b WHERE refs > 1)
SELECT coalesce(e.lba, s.lba) AS lba, coalesce(expected, 1) AS expected, coalesce(stored, 1) AS stored FROM e FULL JOIN s ON e.lba = s.lba WHERE expected IS DISTINCT FROM stored""")
def refcount_check(spark, sf_dir):
    x = model.extents(spark, sf_dir)
    kept = integrity.refcounts(x).where("lba % 7 <> 0").withColumn("ref_count", F.col("ref_count") + F.when(F.col("lba") % 10 == 0, 1).otherwise(0))
    stale = spark.range(1).select(F.lit(1_000_000).cast("long").alias("lba"), F.lit(3).cast("long").alias("ref_count"))
    return integrity.refcount_differences(x, kept.unionByName(stale))


@registered(f"WITH {_REFS} SELECT CAST(p_partkey AS BIGINT) AS lba, coalesce(refs, 1) AS ref_count FROM part LEFT JOIN (SELECT * FROM b WHERE refs > 1) ON lba = p_partkey")
def refcount_get(spark, sf_dir):
    blocks = model.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("lba"))
    return integrity.refcount_of(blocks, integrity.refcounts(model.extents(spark, sf_dir)))


@registered(f"WITH {_EXTENTS} SELECT * FROM (SELECT o_orderkey AS inode_id, CAST(o_custkey * 10 AS BIGINT) AS file_size, coalesce((SELECT sum(logical_count) * 4096 FROM x WHERE x.inode_id = o_orderkey), 0)::BIGINT AS held FROM orders) WHERE file_size > held")
def size_vs_extents(spark, sf_dir):
    inodes = model.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("inode_id"), (F.col("o_custkey") * 10).alias("file_size"))
    return integrity.size_mismatches(inodes, model.extents(spark, sf_dir), 4096)


@registered("""WITH o AS (SELECT DISTINCT l_partkey AS lba FROM lineitem WHERE l_partkey % 5 <> 0), u AS (SELECT CAST(p_partkey AS BIGINT) AS lba FROM part WHERE p_partkey % 3 <> 0)
SELECT coalesce(o.lba, u.lba) AS lba, CASE WHEN o.lba IS NULL THEN 'leaked' ELSE 'missing' END AS fault FROM o FULL JOIN u ON o.lba = u.lba WHERE o.lba IS NULL OR u.lba IS NULL""")
def bitmap_diff(spark, sf_dir):
    owned = model.read(spark, sf_dir, "lineitem").where("l_partkey % 5 <> 0").select(F.col("l_partkey").alias("lba"))
    return integrity.bitmap_differences(owned, model.read(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("lba")))


def _owned(spark, sf_dir):
    li = model.read(spark, sf_dir, "lineitem")
    return integrity.owners({"tree": li.where("l_linenumber = 1").select(F.col("l_partkey").alias("lba")), "dedup": li.where("l_linenumber = 2").select(F.col("l_partkey").alias("lba")), "meta": li.where("l_linenumber > 2").select(F.col("l_suppkey").alias("lba"))})


_OWNED = "o AS (SELECT l_partkey AS lba, 'tree' AS owner FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_partkey, 'dedup' FROM lineitem WHERE l_linenumber = 2 UNION ALL SELECT l_suppkey, 'meta' FROM lineitem WHERE l_linenumber > 2)"


@registered(f"WITH {_OWNED} SELECT owner, count(DISTINCT lba) AS blocks FROM o GROUP BY owner")
def block_classes(spark, sf_dir):
    return integrity.block_classes(_owned(spark, sf_dir))


@registered(f"WITH {_OWNED} SELECT lba, count(DISTINCT owner) AS owners FROM o GROUP BY lba HAVING count(DISTINCT owner) > 1")
def shared_blocks(spark, sf_dir):
    return integrity.shared_blocks(_owned(spark, sf_dir))


@registered("SELECT count(DISTINCT l_partkey) AS used, 1000000 - count(DISTINCT l_partkey) AS free FROM lineitem")
def space_used(spark, sf_dir):
    return integrity.space(model.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("lba")), 1_000_000)


@registered(f"""WITH {_SECTORS}, i AS (SELECT sector_size, hash, min(inode_id) AS lba FROM s GROUP BY ALL)
SELECT inode_id, sector, CASE WHEN sector % 5 = 0 THEN inode_id ELSE lba END AS lba, lba AS true_lba FROM s JOIN i USING (sector_size, hash) WHERE sector % 5 = 0 AND inode_id <> lba""")
def location_scrub(spark, sf_dir):
    smap = sectors.sector_map(sectors.sliced(model.images(spark, sf_dir)))
    index = smap.groupBy("sector_size", "hash").agg(F.min("inode_id").alias("lba")).withColumn("offset", F.lit(0).cast("long"))
    cached = smap.join(index, ["sector_size", "hash"]).withColumn("lba", F.when(F.col("sector") % 5 == 0, F.col("inode_id")).otherwise(F.col("lba")))
    return integrity.location_differences(cached, index)


@registered(f"WITH {_EXTENTS} SELECT inode_id, sum(logical_count)::BIGINT AS logical_blocks, count(*) AS extents FROM x GROUP BY inode_id")
def overflow_sums(spark, sf_dir):
    return integrity.overflow_sums(model.extents(spark, sf_dir))


@registered("SELECT max(o_orderkey) + 1 AS next_inode_id FROM orders")
def next_inode(spark, sf_dir):
    return integrity.next_inode(model.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("inode_id")))


@registered("SELECT * FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before >= value")
def order_check(spark, sf_dir):
    return integrity.order_faults(model.read(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


@registered("""WITH f AS (SELECT s_name AS name, s_suppkey % 60 * 79 - 20 AS lba FROM supplier), c AS (SELECT *, count(*) OVER (PARTITION BY lba) AS n FROM f)
SELECT name, lba, CASE WHEN lba < 1 OR lba >= 4000 THEN 'out of range' ELSE 'shared' END AS fault FROM c WHERE lba < 1 OR lba >= 4000 OR n > 1""")
def superblock_check(spark, sf_dir):
    fields = model.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 60 * 79 - 20).alias("lba"))
    return integrity.superblock_faults(fields, 4000)


@registered("SELECT CAST(p_partkey AS BIGINT) AS old, CAST(-(p_partkey // 16 * 16 + 16) AS BIGINT) AS new FROM part")
def relocation_map(spark, sf_dir):
    """Every block moves to its neighbour; the last of 16 leaves for a place of its own."""
    old = F.col("p_partkey")
    part = model.read(spark, sf_dir, "part")
    last = part.agg(F.max("p_partkey")).first()[0]
    new = F.when((old + 1) % 16 == 0, -(old + 1)).when(old == last, -(F.floor(old / 16) * 16 + 16)).otherwise(old + 1)
    return integrity.relocation(part.select(old.cast("long").alias("old"), new.cast("long").alias("new")))


# Tags

_TAG_ROWS = "t AS (SELECT user_id AS inode_id, event_id AS sector, (length(event_type) % 20)::INTEGER AS tag_type, props AS data FROM events)"


def _tag_rows(spark, sf_dir):
    return model.read(spark, sf_dir, "events").select(F.col("user_id").alias("inode_id"), F.col("event_id").alias("sector"), (F.length("event_type") % 20).alias("tag_type"), F.col("props").alias("data"))


@registered(f"WITH {_TAG_ROWS} SELECT inode_id, sector, tag_type, data FROM t")
def tag_lookup(spark, sf_dir):
    return tags.resolved(*tags.normalised(_tag_rows(spark, sf_dir)))


@registered(f"WITH {_TAG_ROWS} SELECT DISTINCT tag_type, data FROM t")
def tag_dictionary(spark, sf_dir):
    return tags.normalised(_tag_rows(spark, sf_dir))[1].select("tag_type", "data")


@registered(f"WITH {_TAG_ROWS} SELECT inode_id, array_to_string(list_sort(list(DISTINCT tag_type)), ',') AS tag_types FROM t GROUP BY inode_id")
def tag_types(spark, sf_dir):
    return tags.types_of(_tag_rows(spark, sf_dir)).select("inode_id", F.array_join(F.transform("tag_types", lambda x: x.cast("string")), ",").alias("tag_types"))


@registered("SELECT CAST(vec_id AS BIGINT) AS inode_id, label AS tag_type, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS data FROM embeddings WHERE vec_id % 5 <> 0")
def tag_put_delete(spark, sf_dir):
    e = model.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("inode_id"), F.col("label").alias("tag_type"))
    after = tags.put(e.withColumn("data", F.lit("old")), e.where("inode_id % 3 = 0").withColumn("data", F.lit("new")))
    return tags.delete(after, e.where("inode_id % 5 = 0"), ("inode_id",))


# Exports and scalars

@registered("""SELECT '/' || p_name || '/' || p_partkey || chr(10) || '  brand = ' || p_brand || chr(10) || '  size = ' || p_size AS value FROM part WHERE p_type = 'PROMO'""")
def export_txt(spark, sf_dir):
    return export.text_lines(_named(spark, sf_dir), ["brand", "size"])


def _named(spark, sf_dir):
    meta = model.part_meta(spark, sf_dir)
    rows = metadata.with_metadata(planner.select(meta, "type = PROMO"), meta)
    return rows.select(F.concat(F.lit("/"), F.col("metadata")["name"], F.lit("/"), F.col("inode_id").cast("string")).alias("path"), "metadata")


@registered("""SELECT '{"path":"/' || p_name || '/' || p_partkey || '","metadata":{"brand":"' || p_brand || '","size":"' || p_size || '"}}' AS value FROM part WHERE p_type = 'PROMO'""")
def export_jsonl(spark, sf_dir):
    return export.json_lines(_named(spark, sf_dir), ["brand", "size"])


@registered("""SELECT doc_id || ',' || CASE WHEN regexp_matches(t, '[,"\\n\\r]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS value FROM (SELECT doc_id, text AS t FROM documents)""")
def export_csv(spark, sf_dir):
    return export.csv_lines(model.read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t")))


@registered("""SELECT event_id, lpad(((event_id + 150) // 4500)::VARCHAR, 2, '0') || ':' || lpad(((event_id + 150) % 4500 // 75)::VARCHAR, 2, '0') || ':' || lpad(((event_id + 150) % 75)::VARCHAR, 2, '0') AS msf FROM events""")
def cd_address(spark, sf_dir):
    m = scalar.lba_to_msf(F.col("event_id"))
    return model.read(spark, sf_dir, "events").select("event_id", F.concat_ws(":", *[F.lpad(m[k].cast("string"), 2, "0") for k in ("minute", "second", "frame")]).alias("msf"))


@registered("""SELECT page_id, CASE WHEN instr(n, '.') > 0 AND length(n) - instr(reverse(n), '.') > 0 THEN translate(substr(n, length(n) - instr(reverse(n), '.') + 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS ext FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS n FROM pages)""")
def file_extension(spark, sf_dir):
    return model.read(spark, sf_dir, "pages").select("page_id", scalar.extension(scalar.basename(F.col("url"))).alias("ext"))


@registered(f"SELECT doc_id, {sqlgen.strtoll('v')} AS n, {sqlgen.whole('v')} AS whole FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN ' +7' WHEN 2 THEN '12abc' WHEN 3 THEN '99999999999999999999' WHEN 4 THEN '-99999999999999999999999999999999999999999999' WHEN 5 THEN '0x10' WHEN 6 THEN CAST(n_chars AS VARCHAR) ELSE '000000000000000000000000000000000000000042' END AS v FROM documents)")
def integer_parse(spark, sf_dir):
    k = F.col("doc_id") % 8
    v = F.when(k == 0, "").when(k == 1, " +7").when(k == 2, "12abc").when(k == 3, "99999999999999999999").when(k == 4, "-99999999999999999999999999999999999999999999").when(k == 5, "0x10").when(k == 6, F.col("n_chars").cast("string")).otherwise("000000000000000000000000000000000000000042")
    return model.read(spark, sf_dir, "documents").select("doc_id", scalar.strtoll(v).alias("n"), scalar.is_whole_int(v).alias("whole"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a grouped, negated query over metadata in one scan and one aggregation."""
    return planner.select(model.part_meta(spark, sf_dir), FLAGSHIP)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from vaultlens.plans import store  # noqa: E402, F401  its queries register themselves
