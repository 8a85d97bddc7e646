"""Result formats. Rows are (path, metadata map); formatting is done by Spark, so files are written in parallel."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_lines(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """value: a path, then one line of two spaces, key, " = " and value for each key (only those named, if any are)."""
    entries = F.map_entries("metadata")
    if keys is not None:
        entries = F.filter(entries, lambda e: e["key"].isin(keys))
    lines = F.transform(entries, lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = "), e["value"]))
    return rows.select(F.array_join(F.concat(F.array("path"), lines), "\n").alias("value"))


def json_lines(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """value: one object a line, with metadata only where there is some."""
    m = F.col("metadata")
    if keys is not None:
        m = F.map_filter(m, lambda k, v: k.isin(keys))
    return rows.select(F.to_json(F.struct(F.col("path"), F.when(F.size(m) > 0, m).alias("metadata"))).alias("value"))


def json_document(rows: DataFrame) -> Iterator[str]:
    """The pieces of {"count": n, "results": [...]}: a path alone where there is no metadata. Rows stream to the driver one partition at a time."""
    item = F.when(F.size("metadata") > 0, F.to_json(F.struct("path", "metadata"))).otherwise(F.substring(F.to_json(F.array("path")), F.lit(2), F.length(F.to_json(F.array("path"))) - 2))
    yield f'{{"count": {rows.count()}, "results": ['
    for i, r in enumerate(rows.select(item.alias("v")).toLocalIterator()):
        yield ("," if i else "") + r["v"]
    yield "]}"


def csv_field(c: Column) -> Column:
    """Quoted where a comma, quote or line break needs it; quotes are doubled."""
    c = F.coalesce(c, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[,"\\n\\r]'), quoted).otherwise(c)


def csv_lines(wide: DataFrame) -> DataFrame:
    """value: the fields of every row; the header is csv_header()."""
    return wide.select(F.concat_ws(",", *[csv_field(F.col(f"`{c}`").cast("string")) for c in wide.columns]).alias("value"))


def csv_header(wide: DataFrame) -> str:
    return ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in ',"\n\r') else c for c in wide.columns)


def table_lines(wide: DataFrame) -> Iterator[str]:
    """Aligned text, line by line. Widths are the only thing gathered before the rows stream through the driver a partition at a time."""
    text = wide.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in wide.columns])
    widths = text.agg(*[F.coalesce(F.max(F.length(F.col(f"`{c}`"))), F.lit(0)).alias(c) for c in text.columns]).first()
    size = {c: max(len(c), widths[c]) for c in text.columns}
    yield "  ".join(c.ljust(size[c]) for c in text.columns).rstrip()
    yield "  ".join("-" * size[c] for c in text.columns)
    for r in text.toLocalIterator():
        yield "  ".join(r[c].ljust(size[c]) for c in text.columns).rstrip()


def _width(df: DataFrame, c: str) -> int:
    return df.agg(F.coalesce(F.max(F.octet_length(c)), F.lit(0)).alias("n")).first()["n"]


def distinct_lines(values: DataFrame, form: str = "txt") -> DataFrame:
    """value: the lines of a DISTINCT result, in order of values; json: the entries of its list."""
    v = F.col("value") if form == "txt" else F.to_json(F.array("value"))
    return values.orderBy("value").select((v if form == "txt" else F.substring(v, F.lit(2), F.length(v) - 2)).alias("value"))


def group_lines(groups: DataFrame, form: str = "txt") -> DataFrame:
    """value: the lines of a GROUP BY result (value, n), values padded to the widest; json: the entries of its list."""
    if form == "txt":
        pad = F.repeat(F.lit(" "), F.lit(_width(groups, "value")) - F.octet_length("value"))
        return groups.orderBy("value").select(F.concat(F.lit("  "), "value", pad, F.lit("  "), F.col("n").cast("string")).alias("value"))
    return groups.orderBy("value").select(F.to_json(F.struct("value", F.col("n").alias("count"))).alias("value"))


def document(key: str, counted: str, listed: str, items: DataFrame) -> Iterator[str]:
    """The pieces of {"key": key, counted: n, listed: [...]} around json items, which stream to the driver a partition at a time."""
    yield f'{{"key": {json.dumps(key, ensure_ascii=False)}, "{counted}": {items.count()}, "{listed}": ['
    for i, r in enumerate(items.toLocalIterator()):
        yield ("," if i else "") + r["value"]
    yield "]}"


def stats_text(stats: DataFrame, key: str, form: str = "txt") -> DataFrame:
    """value: a STATS result as one text; the average has two decimals and is left out, or null, where nothing was counted."""
    sign = F.when(F.col("avg_hundredths").startswith("-"), "-").otherwise("")
    digits = F.lpad(F.ltrim(F.col("avg_hundredths"), F.lit("-")), F.greatest(F.length(F.ltrim(F.col("avg_hundredths"), F.lit("-"))), F.lit(3)), F.lit("0"))
    avg = F.concat(sign, F.substring(digits, F.lit(1), F.length(digits) - 2), F.lit("."), F.right(digits, F.lit(2)))
    four = [F.col(c).cast("string") for c in ("n", "min", "max", "sum")]
    if form == "txt":
        names = ["  Count: ", "  Min:   ", "  Max:   ", "  Sum:   "]
        rows = [F.concat(F.lit(n), c) for n, c in zip(names, four, strict=True)] + [F.concat(F.lit("  Avg:   "), avg)]
        return stats.select(F.concat(F.lit(f"Statistics for '{key}':\n"), F.concat_ws("\n", *rows)).alias("value"))
    named = [F.concat(F.lit(f'"{n}": '), c) for n, c in zip(("count", "min", "max", "sum"), four, strict=True)]
    whole = F.concat_ws(", ", F.concat(F.lit('"key": '), F.lit(json.dumps(key, ensure_ascii=False))), *named, F.concat(F.lit('"avg": '), F.coalesce(avg, F.lit("null"))))
    return stats.select(F.concat(F.lit("{"), whole, F.lit("}")).alias("value"))


def table_rows(wide: DataFrame) -> DataFrame:
    """value: the rows of table_lines() below its head, formatted by Spark, so they are written in parallel."""
    text = wide.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in wide.columns])
    widths = text.agg(*[F.coalesce(F.max(F.length(F.col(f"`{c}`"))), F.lit(0)).alias(c) for c in text.columns]).first()
    return text.select(F.rtrim(F.concat_ws("  ", *[F.rpad(F.col(f"`{c}`"), max(len(c), widths[c]), " ") for c in text.columns])).alias("value"))


def write(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def cue_sheet(tracks: DataFrame, image: str) -> DataFrame:
    """value: a cue sheet of tracks (track, mode, start) as one text."""
    from vaultlens.functions.scalar import lba_to_msf

    kind = F.when(F.col("mode") == 0, "AUDIO").when(F.col("mode") == 1, "MODE1/2352").otherwise("MODE2/2352")
    m = lba_to_msf(F.col("start") - 150)
    line = F.concat(F.format_string("  TRACK %02d ", "track"), kind, F.format_string("\n    INDEX 01 %02d:%02d:%02d", m["minute"], m["second"], m["frame"]))
    listed = tracks.select(F.struct("track", line.alias("line")).alias("t")).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select(F.concat(F.lit(f'FILE "{image}" BINARY\n'), F.array_join(F.transform("ts", lambda t: t["line"]), "\n"), F.lit("\n")).alias("value"))
