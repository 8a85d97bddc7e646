"""Sector deduplication: slice, hash, keep what is new, map, rebuild.

Images are (inode_id, sector_size, data). Data may be text or binary; a sector is a slice of sector_size characters or
bytes, the last one may be short and is hashed at its own length. Hashes are MD5, so equal hashes mean equal sectors for
practical purposes and both engines agree; the first sector of each (size, hash) is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vaultlens.functions import digests
from vaultlens.functions.lineage import cut, dealt, numbered
from vaultlens.operators import intervals

BLOCK_BYTES = 4 * 1024 * 1024


def sliced(images: DataFrame) -> DataFrame:
    """inode_id, sector, sector_size, data, hash for every sector of every image, made row by row without a shuffle.

    Text is cut by one pass of a pattern, since the place of a character is only found by counting from the start; bytes
    are cut by place. Either way the work is linear in an image's length.
    """
    size = F.col("sector_size")
    if isinstance(images.schema["data"].dataType, StringType):
        each = F.regexp_extract_all(F.col("data"), F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))
    else:
        count = F.ceil(F.length("data") / size).cast("int")
        at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        each = F.transform(at, lambda k: F.substring(F.col("data"), k * size + 1, size))
    rows = images.select("inode_id", "sector_size", F.posexplode(each).alias("sector", "data"))
    return rows.select("inode_id", F.col("sector").cast("long").alias("sector"), "sector_size", "data").withColumn("hash", F.md5(F.col("data").cast("binary")))


def sector_map(sectors: DataFrame) -> DataFrame:
    """One row for each sector in its original place, duplicate or not; contents stay behind."""
    return sectors.select("inode_id", "sector", "sector_size", "hash")


def new_places(sectors: DataFrame, index: DataFrame) -> DataFrame:
    """sector_size, hash, first_inode, first_sector of the sectors that the index doesn't know, each once.

    Known ones go before anything is grouped; groups hold numbers only, so they are combined in hash tables, in a fixed
    number of parts. An object's first sector comes first, then the first object.
    """
    unknown = sector_map(sectors).join(index.select("sector_size", "hash"), ["sector_size", "hash"], "left_anti")
    unknown = dealt(unknown, "hash", "sector_size")  # in the join's own order of keys it would be taken for the join's shuffle and dropped
    each = unknown.groupBy("sector_size", "hash", "inode_id").agg(F.min("sector").alias("sector"))
    return each.groupBy("sector_size", "hash").agg(F.min("inode_id").alias("first_inode"), F.min_by("sector", "inode_id").alias("first_sector"))


def new_sectors(sectors: DataFrame, index: DataFrame) -> DataFrame:
    """sector_size, hash, data, first_inode, first_sector of the sectors that the index doesn't know, each once; contents are fetched for those alone."""
    first = new_places(sectors, index)
    at = first.select("sector_size", "hash", "first_inode", "first_sector", F.col("first_inode").alias("inode_id"), F.col("first_sector").alias("sector"))
    # Both sides are sorted in a fixed number of parts; places are never broadcast, since Spark would judge their size by the files they come from.
    return dealt(at, "inode_id", "sector").join(dealt(sectors.select("inode_id", "sector", "data"), "inode_id", "sector").hint("merge"), ["inode_id", "sector"]).select("sector_size", "hash", "data", "first_inode", "first_sector")


def placed(new: DataFrame, sector_size: int, start: int = 0) -> DataFrame:
    """new sectors of one size with the block and offset they get when appended in hash order to blocks of 4 MiB.

    Hashes are numbered without their contents, which are joined to their places.
    """
    each = BLOCK_BYTES // sector_size
    ours = new.where(F.col("sector_size") == sector_size)
    at = F.col("row") + F.lit(start)
    located = numbered(ours.select("hash"), ["hash"], "row").select("hash", F.floor(at / each).alias("lba"), (F.pmod(at, F.lit(each)) * sector_size).alias("offset"))
    return ours.join(located, "hash").select("sector_size", "hash", "data", "lba", "offset") if "data" in new.columns else located.select(F.lit(sector_size).alias("sector_size"), "hash", "lba", "offset")


def backfilled(smap: DataFrame, located: DataFrame) -> DataFrame:
    """smap with lba and offset filled in from the index (sector_size, hash, lba, offset) where they are missing."""
    have = {"lba", "offset"} <= set(smap.columns)
    at = located.select("sector_size", "hash", F.col("lba").alias("_lba"), F.col("offset").alias("_offset"))
    both = smap.join(at, ["sector_size", "hash"], "left")
    lba, offset = (F.coalesce("lba", "_lba"), F.coalesce("offset", "_offset")) if have else (F.col("_lba"), F.col("_offset"))
    return both.select("inode_id", "sector", "sector_size", "hash", lba.alias("lba"), offset.alias("offset"))


def store(sectors: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new dictionary rows (sector_size, hash, data) and the sector map: what a write appends."""
    return new_sectors(sectors, index).select("sector_size", "hash", "data"), sector_map(sectors)


def sectors_of(smap: DataFrame, dictionary: DataFrame, missing: str = "null") -> DataFrame:
    """inode_id, sector, data of every mapped sector; one that the dictionary lacks is null, or with missing="error" ends the query."""
    if missing not in ("null", "error"):
        raise ValueError(missing)
    found = smap.join(dictionary.select("sector_size", "hash", "data"), ["sector_size", "hash"], "left")
    lost = F.raise_error(F.concat(F.lit("sector "), F.col("sector").cast("string"), F.lit(" of object "), F.col("inode_id").cast("string"), F.lit(" is missing")))
    return found.select("inode_id", "sector", F.coalesce("data", lost).alias("data") if missing == "error" else F.col("data"))


def rebuilt(smap: DataFrame, dictionary: DataFrame, missing: str = "null") -> DataFrame:
    """inode_id, data: images put together again, each one row, so for images that fit one; for larger ones take streamed(). A sector whose hash the dictionary lacks makes the result null, or ends the query."""
    found = sectors_of(smap, dictionary, missing)
    listed = found.groupBy("inode_id").agg(F.sort_array(F.collect_list(F.struct("sector", "data"))).alias("s"), F.count_if(F.col("data").isNull()).alias("lost"))
    return listed.select("inode_id", F.when(F.col("lost") == 0, F.array_join(F.transform("s", lambda x: x["data"]), "")).alias("data"))


def streamed(smap: DataFrame, dictionary: DataFrame, missing: str = "error") -> DataFrame:
    """inode_id, sector, data in order: images of any size, dealt out by ranges of (object, sector), so one image may span many tasks."""
    return sectors_of(smap, dictionary, missing).repartitionByRange("inode_id", "sector").sortWithinPartitions("inode_id", "sector")


def lookup(smap: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The wanted hashes that are known, each looked up once."""
    return smap.select("sector_size", "hash").distinct().join(dictionary, ["sector_size", "hash"])


def damaged(dictionary: DataFrame) -> DataFrame:
    """Dictionary rows whose contents no longer give their hash."""
    return dictionary.where(F.md5(F.col("data").cast("binary")) != F.col("hash")).select("sector_size", "hash")


def damaged_parts(entries: DataFrame) -> DataFrame:
    """The same for a dictionary of CD parts (hash, data)."""
    return entries.where(F.md5(F.col("data").cast("binary")) != F.col("hash")).select("hash")


def statistics(smap: DataFrame) -> DataFrame:
    """refs, unique, ratio in hundredths, duplicates and unique bytes for each sector size."""
    once = smap.groupBy("sector_size", "hash").agg(F.count(F.lit(1)).alias("n"))
    each = once.groupBy("sector_size").agg(F.sum("n").alias("refs"), F.count(F.lit(1)).alias("unique_sectors"))
    ratio = F.floor(F.col("refs") * 100 / F.col("unique_sectors"))
    return each.select("sector_size", "refs", "unique_sectors", ratio.cast("long").alias("ratio_hundredths"), (F.col("refs") - F.col("unique_sectors")).alias("duplicates"), (F.col("unique_sectors") * F.col("sector_size")).alias("unique_bytes"))


def media_totals(images: DataFrame) -> DataFrame:
    """files, bytes and sectors of the images of each sector size."""
    sectors = F.ceil(F.length("data") / F.col("sector_size"))
    return images.groupBy("sector_size").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("data").cast("long")).alias("size"), F.sum(sectors.cast("long")).alias("sectors"))


def savings(images: DataFrame, smap: DataFrame) -> DataFrame:
    """logical and deduplicated size in units of data, and the share saved in hundredths of a percent."""
    size = images.select(F.length("data").cast("long").alias("logical"), F.lit(0).cast("long").alias("uniq"))
    once = smap.groupBy("sector_size", "hash").agg(F.max(F.col("sector_size").cast("long")).alias("uniq")).select(F.lit(0).cast("long").alias("logical"), "uniq")
    both = size.unionByName(once).agg(F.sum("logical").alias("logical"), F.sum("uniq").alias("unique"))
    return both.select("logical", "unique", F.floor((F.col("logical") - F.col("unique")) * 10000 / F.col("logical")).cast("long").alias("saved_basis_points"))


def _check_clone(source: int, target: int) -> None:
    if source == target:
        raise ValueError("a range is cloned between different objects")


def cloned_extents(extents: DataFrame, source: int, target: int, first: int, count: int, block_size: int) -> DataFrame:
    """extents (inode_id, logical_offset, start_block, count; in blocks) after bytes first .. first + count - 1 of one file are shared into another at the same place. The range must be whole blocks; block references follow from the result (integrity.refcounts)."""
    from vaultlens.operators.intervals import clipped

    _check_clone(source, target)
    if first % block_size or count % block_size or count <= 0:
        raise ValueError("a range is cloned in whole blocks")
    lo, hi = first // block_size, (first + count) // block_size
    own = F.col("inode_id") == target
    every = ["inode_id", "logical_offset", "start_block", "count"]
    before = clipped(extents.where(own), -(1 << 62), lo)
    after = clipped(extents.where(own), hi, 1 << 62)
    shared = clipped(extents.where(F.col("inode_id") == source), lo, hi).withColumn("inode_id", F.lit(target).cast("long"))
    return extents.where(~own).select(*every).unionByName(before).unionByName(after).unionByName(shared)


def freed(refs: DataFrame, released: DataFrame) -> tuple[DataFrame, DataFrame]:
    """refs (lba, refs) after released blocks (lba, once for each reference) lose a reference each: what is left, and the blocks that nothing refers to any more."""
    gone = released.groupBy("lba").agg(F.count(F.lit(1)).alias("gone"))
    left = refs.join(gone, "lba", "left").select("lba", (F.col("refs") - F.coalesce("gone", F.lit(0))).alias("refs"))
    return left.where("refs > 0"), left.where("refs <= 0").select("lba")


def cloned(smap: DataFrame, source: int, target: int, first: int, count: int, to: int = 0) -> DataFrame:
    """smap with `count` sectors of one image shared into another: rows are copied, contents are not."""
    _check_clone(source, target)
    copied = smap.where((F.col("inode_id") == source) & F.col("sector").between(first, first + count - 1))
    moved = copied.select(F.lit(target).cast("long").alias("inode_id"), (F.col("sector") - first + to).alias("sector"), "sector_size", "hash")
    kept = smap.where((F.col("inode_id") != target) | ~F.col("sector").between(to, to + count - 1))
    return kept.unionByName(moved)


def truncated(smap: DataFrame, inode_id: int, sectors: int) -> DataFrame:
    return smap.where((F.col("inode_id") != inode_id) | (F.col("sector") < sectors))


# CD sectors: fixed values are the sizes of user data and where it starts in a raw sector of 2352 bytes.

RAW = 2352
#: mode: (first byte of data, bytes of data, bytes of subheader)
CD_MODES = {0: (0, 2352, 0), 1: (16, 2048, 0), 2: (16, 2336, 0), 3: (24, 2048, 8), 4: (24, 2328, 8)}
PREFIX, SUFFIX_AT, SUFFIX, SUBCHANNEL = 16, 2064, 288, 96


def cd_split(raw: DataFrame) -> DataFrame:
    """Raw sectors (inode_id, sector, mode, data, subchannel) as their parts and the parts' hashes.

    A prefix that can be computed from the address and mode isn't stored, nor is a suffix that can be computed from the
    rest of the sector (modes 1 and 2 form 1).
    """
    from vaultlens.functions.digests import form1_suffix_is_regenerable, suffix_is_regenerable
    from vaultlens.functions.scalar import cd_prefix

    def by_mode(k: int) -> Column:
        out = F.lit(CD_MODES[0][k])
        for m, v in CD_MODES.items():
            out = F.when(F.col("mode") == m, F.lit(v[k])).otherwise(out)
        return out

    d = F.col("data")
    prefix = F.when(F.col("mode") > 0, F.substring(d, F.lit(1), F.lit(PREFIX)))
    tail = by_mode(0) + by_mode(1)
    suffix = F.when((F.col("mode") > 0) & (tail < RAW), F.substring(d, tail + 1, F.lit(RAW) - tail))
    made = cd_prefix(F.col("sector"), F.when(F.col("mode") == 1, 1).otherwise(2))
    generated = F.coalesce(prefix == made, F.lit(False))
    # A suffix is computed from the whole sector, its own prefix included.
    # A function in Python sees every row, whatever condition stands around it, so rows of other modes are given as nulls.
    again = F.coalesce(suffix_is_regenerable(F.when(F.col("mode") == 1, d)), form1_suffix_is_regenerable(F.when(F.col("mode") == 3, d)))
    raw = raw.withColumn("_again", F.coalesce(again, F.lit(False)))
    return raw.select(
        "inode_id", "sector", "mode",
        F.substring(d, by_mode(0) + 1, by_mode(1)).alias("user_data"),
        F.when(by_mode(2) > 0, F.substring(d, F.lit(PREFIX + 1), by_mode(2))).alias("subheader"),
        generated.alias("generated_prefix"), F.when(~generated, prefix).alias("prefix"), F.col("_again").alias("generated_suffix"), F.when(~F.col("_again"), suffix).alias("suffix"), F.col("subchannel"),
    ).withColumns({f"{p}_hash": F.md5(F.col(p)) for p in ("user_data", "prefix", "suffix", "subchannel")})


def dictionary(rows: DataFrame, part: str) -> DataFrame:
    """hash, data: one of the dictionaries of parts; putting twice changes nothing."""
    return rows.where(F.col(part).isNotNull()).groupBy(F.col(f"{part}_hash").alias("hash")).agg(F.first(part).alias("data"))


def dictionary_delete(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """A dictionary of parts without the hashes of `gone`."""
    return entries.join(gone.select("hash"), "hash", "left_anti")


def cd_rebuilt(cd_map: DataFrame, data: DataFrame, prefixes: DataFrame, suffixes: DataFrame, last: DataFrame) -> DataFrame:
    """Raw sectors 0 .. last.sectors - 1 of each image; those that the map lacks are zeros."""
    from vaultlens.functions.digests import form1_suffix, mode1_suffix
    from vaultlens.functions.scalar import cd_prefix

    zeros = F.unhex(F.repeat(F.lit("00"), RAW))
    places = last.select("inode_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("sectors") - 1).cast("long"))).alias("sector"))
    known = cd_map.select("inode_id", "sector", "mode", "subheader", "generated_prefix", "generated_suffix", "user_data_hash", "prefix_hash", "suffix_hash")
    # The map is joined without contents. It is never broadcast: Spark would judge its size by the files it comes from.
    rows = places.join(known.hint("merge"), ["inode_id", "sector"], "left")
    for part, entries in (("user_data", data), ("prefix", prefixes), ("suffix", suffixes)):
        rows = _with_contents(rows, part, entries)
    none = F.lit("").cast("binary")
    head = F.when(F.col("generated_prefix"), cd_prefix(F.col("sector"), F.when(F.col("mode") == 1, 1).otherwise(2))).otherwise(F.coalesce("_prefix", none))
    rows = rows.withColumn("_head", F.concat(head, F.coalesce("subheader", none), F.col("_user_data")))
    again = F.col("generated_suffix")
    tail = F.when(again & (F.col("mode") == 1), mode1_suffix(F.when(again & (F.col("mode") == 1), F.col("_head")))).when(again, form1_suffix(F.when(again & (F.col("mode") == 3), F.col("_head")))).otherwise(F.coalesce("_suffix", none))
    return rows.select("inode_id", "sector", F.coalesce(F.concat(F.col("_head"), tail), zeros).alias("data"))


#: Bytes of a dictionary of parts up to which it is broadcast.
BROADCAST_BYTES = 8 << 20


def _with_contents(rows: DataFrame, part: str, entries: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """rows with the contents that a dictionary (hash, data) has for a part's hash, null where it has none.

    Entries are stored and measured first. A larger dictionary is sorted and merged; there rows without a hash, which match nothing,
    are dealt out by a key of their own, lest they all meet in one task.
    """
    kept = cut(entries.select("hash", "data"))
    small = kept.agg(F.coalesce(F.sum(F.octet_length("data") + 64), F.lit(0))).first()[0] <= most
    kept = kept.select(F.col("hash").alias("_hash"), F.col("data").alias(f"_{part}"))
    hash_ = F.col(f"{part}_hash")
    own = F.concat_ws("/", F.lit("none"), "inode_id", "sector")
    on = (hash_ if small else F.coalesce(hash_, own)) == F.col("_hash")
    return rows.join(F.broadcast(kept) if small else kept.hint("merge"), on, "left").drop("_hash")


def subchannel_rebuilt(cd_map: DataFrame, subchannels: DataFrame, parents: DataFrame) -> DataFrame:
    """The subchannel file of each parent image, sector by sector."""
    wanted = parents.select("inode_id", "parent_inode_id").join(cd_map.select(F.col("inode_id").alias("parent_inode_id"), "sector", "subchannel_hash"), "parent_inode_id")
    return wanted.join(subchannels.select(F.col("hash").alias("subchannel_hash"), "data"), "subchannel_hash").select("inode_id", "sector", "data")


def tracks_to_sectors(tracks: DataFrame) -> DataFrame:
    """Rows for every sector from start - pregap (0 at least) to end of tracks of a known kind."""
    known = tracks.where(F.col("mode").isin(list(CD_MODES)))
    return known.select("inode_id", "track", "mode", F.explode(F.sequence(F.greatest(F.col("start") - F.col("pregap"), F.lit(0)), F.col("end"))).alias("sector"))


def deciphered(sectors: DataFrame, regions: DataFrame, keys: DataFrame) -> DataFrame:
    """inode_id, sector, data of discs whose sectors outside plain regions (inode_id, start_sector, end_sector; both included) are enciphered one by one.

    keys: inode_id, key (16 bytes). The sector's number starts the chain, so sectors are independent of each other. Without a key a sector stays as it is.
    """
    marked = intervals.inside_any(sectors.withColumn("at", F.col("sector")), regions).join(keys.select("inode_id", "key"), "inode_id", "left")
    opened = digests.aes(F.when(~F.col("plain"), F.col("data").cast("binary")), F.col("key"), digests.sector_iv(F.col("sector")))
    return marked.select("inode_id", "sector", F.coalesce(opened, F.col("data").cast("binary")).alias("data"))
