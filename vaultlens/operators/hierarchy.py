"""The catalogue tree (inode_id, parent_id, is_dir, name) and what hangs on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.functions.lineage import cut
from vaultlens.sources.model import ROOT

MAX_DEPTH, MAX_PATH = 256, 4096


def lookup(catalog: DataFrame, parent_id: int, name: str) -> DataFrame:
    return catalog.where((F.col("parent_id") == parent_id) & (F.col("name") == name))


def resolve(catalog: DataFrame, path: str, root: int = ROOT) -> int | None:
    """The object that a path names, by one lookup a step; none if a step is missing or no directory."""
    at, is_dir = root, True
    for name in [p for p in path.split("/") if p]:
        found = lookup(catalog, at, name).select("inode_id", "is_dir").first() if is_dir else None
        if found is None:
            return None
        at, is_dir = found["inode_id"], found["is_dir"]
    return at


def resolve_all(where: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, inode_id of many paths (path) at once, by the table that paths() gives."""
    return wanted.select("path").join(where.select("path", "inode_id"), "path")


def listing(catalog: DataFrame, parent_id: int) -> DataFrame:
    """Entries of a directory; the root's entry for itself isn't one."""
    return catalog.where((F.col("parent_id") == parent_id) & (F.col("inode_id") != parent_id))


def first_entry(catalog: DataFrame) -> DataFrame:
    """The entry that names an object with several links: the first by parent, then name."""
    least = catalog.groupBy("inode_id").agg(F.min(F.struct("parent_id", "name", "is_dir")).alias("e"))
    return least.select("inode_id", "e.parent_id", "e.is_dir", "e.name")


def paths(catalog: DataFrame, root: int = ROOT) -> DataFrame:
    """inode_id, path, depth of everything that hangs on the root.

    Every directory starts with the step to its parent; each round joins the steps with themselves, which doubles them,
    so a tree of depth 256 takes eight equi-joins. Files are joined to their directory once, at the end. Directories that
    never reach the root (lost or in a circle) have no path.
    """
    named = first_entry(catalog).where(F.col("inode_id") != root)
    top = named.sparkSession.range(1).select(F.lit(root).cast("long").alias("inode_id"), F.lit(root).cast("long").alias("at"), F.lit("").alias("path"), F.lit(0).alias("depth"))
    steps = named.where("is_dir").select("inode_id", F.col("parent_id").alias("at"), F.concat(F.lit("/"), "name").alias("path"), F.lit(1).alias("depth")).unionByName(top)
    steps = cut(steps)
    for _ in range(MAX_DEPTH.bit_length() - 1):
        if steps.where(F.col("at") != root).isEmpty():
            break
        on = steps.select(F.col("inode_id").alias("at"), F.col("at").alias("_at"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        steps = cut(steps.join(on, "at").select("inode_id", F.col("_at").alias("at"), F.concat("_path", "path").alias("path"), (F.col("depth") + F.col("_depth")).alias("depth")))
    every = steps.where(F.col("at") == root).select("inode_id", "path", "depth")
    up = every.select(F.col("inode_id").alias("parent_id"), F.col("path").alias("above"), (F.col("depth") + 1).alias("depth"))
    files = named.where("NOT is_dir").join(up, "parent_id").select("inode_id", F.concat("above", F.lit("/"), "name").alias("path"), "depth")
    whole = every.where(F.col("inode_id") != root).unionByName(files)
    return whole.where((F.octet_length("path") < MAX_PATH) & (F.col("depth") <= MAX_DEPTH))


def paths_recursive(catalog: DataFrame, root: int = ROOT) -> DataFrame:
    """The same as one recursive query."""
    spark = catalog.sparkSession
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(MAX_DEPTH))
    first_entry(catalog).createOrReplaceTempView("_vaultlens_entries")
    return spark.sql(f"""
        WITH RECURSIVE walk(inode_id, path, depth) AS (
            SELECT CAST({root} AS BIGINT), '', 0
            UNION ALL
            SELECT e.inode_id, concat(w.path, '/', e.name), w.depth + 1 FROM walk w JOIN _vaultlens_entries e ON e.parent_id = w.inode_id WHERE e.inode_id <> {root})
        SELECT * FROM walk WHERE inode_id <> {root} AND octet_length(path) < {MAX_PATH}""")


def resolved(ids: DataFrame, where: DataFrame) -> DataFrame:
    """ids with their paths; objects that no entry names drop out."""
    return ids.join(where, "inode_id").select("inode_id", "path")


def subtree(where: DataFrame, path: str) -> DataFrame:
    return where.where(F.startswith("path", F.lit(path.rstrip("/") + "/")))


def ancestors(where: DataFrame) -> DataFrame:
    """ancestor, inode_id: every directory above an object, by its path's prefixes."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    below = where.where("depth > 1").select("inode_id", F.explode(prefixes).alias("path"))
    return below.join(where.select(F.col("inode_id").alias("ancestor"), "path"), "path").select("ancestor", "inode_id")


def orphans(inodes: DataFrame, catalog: DataFrame, root: int = ROOT) -> DataFrame:
    return inodes.where(F.col("inode_id") != root).join(catalog.select("inode_id"), "inode_id", "left_anti")


def dangling(inodes: DataFrame, catalog: DataFrame) -> DataFrame:
    return catalog.join(inodes.select("inode_id"), "inode_id", "left_anti")


def renamed(catalog: DataFrame, parent_id: int, name: str, new_parent: int, new_name: str, mode: str = "replace", where: DataFrame | None = None) -> DataFrame:
    """catalog after a rename. replace: an entry at the target goes; keep: it is an error; exchange: both swap places."""
    src = (F.col("parent_id") == parent_id) & (F.col("name") == name)
    dst = (F.col("parent_id") == new_parent) & (F.col("name") == new_name)
    moved = catalog.where(src).first()
    if moved is None:
        raise FileNotFoundError(name)
    if where is not None and moved["is_dir"]:
        below = ancestors(where).where((F.col("ancestor") == moved["inode_id"]) & (F.col("inode_id") == new_parent))
        if new_parent == moved["inode_id"] or not below.isEmpty():
            raise ValueError("a directory cannot move into its own subtree")
    target = catalog.where(dst).first()
    if mode == "keep" and target is not None:
        raise FileExistsError(new_name)
    if mode == "exchange" and target is None:
        raise FileNotFoundError(new_name)
    place = [F.when(src, F.lit(new_parent)).otherwise(F.col("parent_id")), F.when(src, F.lit(new_name)).otherwise(F.col("name"))]
    if mode == "exchange":
        place = [F.when(src, F.lit(new_parent)).when(dst, F.lit(parent_id)).otherwise(F.col("parent_id")), F.when(src, F.lit(new_name)).when(dst, F.lit(name)).otherwise(F.col("name"))]
        rows = catalog
    else:
        rows = catalog.where(src | ~dst)
    return rows.select("inode_id", place[0].cast("long").alias("parent_id"), "is_dir", place[1].alias("name"))


def linked(catalog: DataFrame, inode_id: int, parent_id: int, name: str, is_dir: bool = False) -> DataFrame:
    """catalog with one more entry: a new file, directory, hard link or symbolic link."""
    if not lookup(catalog, parent_id, name).isEmpty():
        raise FileExistsError(name)
    new = catalog.sparkSession.createDataFrame([(inode_id, parent_id, is_dir, name)], "inode_id long, parent_id long, is_dir boolean, name string")
    return catalog.unionByName(new)


def unlinked(catalog: DataFrame, parent_id: int, name: str) -> DataFrame:
    """catalog without an entry; a directory must be empty."""
    entry = lookup(catalog, parent_id, name).first()
    if entry is None:
        raise FileNotFoundError(name)
    if entry["is_dir"] and not listing(catalog, entry["inode_id"]).isEmpty():
        raise OSError("directory not empty")
    return catalog.where(~((F.col("parent_id") == parent_id) & (F.col("name") == name)))
