"""CSV ledgers in files: guards, delimiter, columns, one reader per kind of file."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import roles, text
from ..operators import clean
from ..session import cut_lineage

STEM = r"([^/]+?)(\.[^./]*)?$"


def inspect_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """One row per file: name, stem, size, delimiter, header, and the reason if the file is refused.

    No scan sees a file without a byte, so the names that Spark's own listing holds are joined, by whole path, to what the scan found.
    Nothing that grows with the files is collected. The first line of a file is that with the least place. Per file, only its hash and its place are
    kept while the lines pass by (fixed width, so nothing is sorted); the text of a header is fetched once for each
    distinct one, and these alone come to the driver. ``max_bytes`` refuses larger files; there is no
    bound unless the caller sets one.
    """
    scan = spark.read.text(path)
    # The listing and the scan spell the scheme in different ways, the rest of the path in the same.
    whole = lambda c: F.regexp_replace(c, "^[A-Za-z0-9]+:/+", "/").alias("whole")
    listing = spark.createDataFrame([(name,) for name in scan.inputFiles()], "listed string").select("listed", whole(F.col("listed")))
    lines = scan.select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    # Spark reads a block from its start: the first row of block 0 is the header.
    top = lines.filter(F.col("block") == 0)
    first = top.select("file_path", "file_size", F.xxhash64("value").alias("hash"), F.monotonically_increasing_id().alias("place"))
    first = cut_lineage(first.groupBy("file_path").agg(F.min_by("hash", "place").alias("hash"), F.max("file_size").alias("file_size")))
    hashes = [r["hash"] for r in first.select("hash").distinct().collect()]
    wanted = top.filter(F.xxhash64("value").isin(hashes)) if hashes else top.limit(0)
    headers = wanted.groupBy(F.xxhash64("value").alias("hash")).agg(F.min("value").alias("header"))
    found = first.join(headers, "hash").select("file_path", "file_size", "header", whole(F.col("file_path")))
    facts = listing.join(found, "whole", "left").withColumns({"file_path": F.coalesce("file_path", "listed"), "file_size": F.coalesce("file_size", F.lit(0))})
    header, size = F.col("header"), F.col("file_size")
    reason = F.when(header.isNull(), "empty file").when(F.trim(header) == "", "empty header")
    reason = reason.when(size > max_bytes, "file too large") if max_bytes is not None else reason
    stem = F.url_decode(F.replace(F.regexp_extract("file_path", STEM, 1), F.lit("+"), F.lit("%2B")))
    delimiter = F.when(header.contains(";"), ";").when(header.isNotNull(), ",")
    return facts.select("file_path", stem.alias("stem"), "file_size", delimiter.alias("delimiter"), "header", reason.alias("reason"))


def _readable(file_path: str) -> str:
    """The name of a file as a reader takes it: without URI escapes, and with the signs of patterns escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file_path))


def read_csv(spark: SparkSession, paths: str | list[str], delimiter: str, columns: list[str]) -> DataFrame:
    """Text columns only, named by the caller (no pass to infer them), and ``surplus``: the raw line where it has more cells
    than there are columns. Lines with fewer are kept as far as they can be read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_line"]])
    reader = spark.read.schema(schema).option("header", True).option("sep", delimiter).option("mode", "PERMISSIVE")
    # Without all columns the parser doesn't count the cells.
    rows = reader.option("columnNameOfCorruptRecord", "_line").option("columnPruning", False).option("encoding", "UTF-8").csv(paths)
    cells = F.size(F.split(F.regexp_replace("_line", f"[{delimiter}\\s]+$", ""), re.escape(delimiter)))
    return rows.withColumn("surplus", F.when(cells > len(columns), F.col("_line"))).drop("_line")


def read_ledger(
    spark: SparkSession,
    path: str,
    style: str = "service",
    date_order: str = "auto_month_first",
    positional: str | None = None,
    entity_from_file: bool = True,
    max_bytes: int | None = None,
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(tagged rows, refused files). Files of one header and one order of dates are read together, each by its name.

    So a row knows its columns, its order of dates and its entity where it's read; no row is joined to facts about its
    file, and nothing is exchanged before the first sum. Every file is scanned for its header, where
    the order of dates is found out for its dates, and for its rows, however many kinds of headers there are.

    With ``entity_from_file`` the entity is the stem of the file name, else the entity column of the ledger.
    A file whose columns cannot play the needed roles is refused, the others are read. A line with more cells than the
    header is rejected as ``surplus cells``, with the whole line as its amount.
    """
    files = sorted(inspect_files(spark, path, max_bytes).collect(), key=lambda f: (f["stem"], f["file_path"]))
    if limit is not None:
        stems = sorted({f["stem"] for f in files})[:limit]
        files = [f for f in files if f["stem"] in stems]
    refused = [(f["file_path"], f["stem"], f["file_size"], f["reason"]) for f in files if f["reason"] is not None]
    kinds: dict[tuple[str, str], list] = {}
    for file in files:
        if file["reason"] is None:
            kinds.setdefault((file["header"], file["delimiter"]), []).append(file)
    parts = []
    for (header, delimiter), same in kinds.items():
        columns = [c.strip().strip('"').strip().lower().lstrip("﻿") for c in header.split(delimiter)]
        try:
            role = roles.detect_roles(columns, style, positional)
        except roles.MissingColumn as problem:
            refused += [(f["file_path"], f["stem"], f["file_size"], str(problem)) for f in same]
            continue
        names = {f["file_path"]: _readable(f["file_path"]) for f in same}
        for day_first, paths in _by_order(spark, names, delimiter, _unique(columns), role, date_order).items():
            raw = read_csv(spark, paths, delimiter, _unique(columns))
            own = F.url_decode(F.replace(F.regexp_extract(F.col("_metadata.file_name"), STEM, 1), F.lit("+"), F.lit("%2B")))
            entity = own if entity_from_file or role.entity is None else None
            order = date_order.removeprefix("auto_") if day_first is None else "day_first" if day_first else "month_first"
            parts.append(clean.tag_rows(raw, role, order, entity, surplus=F.col("surplus")))
    if not parts:
        raise roles.MissingColumn(f"no readable ledger under {path}: {[(r[1], r[3]) for r in refused[:10]]}")
    refused_rows = spark.createDataFrame(refused, "file_path string, stem string, file_size long, reason string")
    return reduce(DataFrame.unionByName, parts), refused_rows


def _by_order(spark: SparkSession, names: dict[str, str], delimiter: str, columns: list[str], role: roles.Roles, date_order: str) -> dict[bool | None, list[str]]:
    """The files by their order of day and month; one group where the order is given."""
    if not date_order.startswith("auto_"):
        return {None: list(names.values())}
    keyed = read_csv(spark, list(names.values()), delimiter, columns).withColumn("file_path", F.col("_metadata.file_path"))
    decided = clean.source_day_first(keyed, role.date, date_order == "auto_day_first", "file_path").collect()
    orders = {r["source_key"]: r["day_first"] for r in decided}
    groups: dict[bool | None, list[str]] = {}
    for file_path, name in names.items():
        groups.setdefault(orders.get(file_path, date_order == "auto_day_first"), []).append(name)
    return groups


def _unique(names: list[str]) -> list[str]:
    """Column names of a header, made unique; a column without a name is called by its place."""
    out: list[str] = []
    for place, name in enumerate(names, start=1):
        name = name or f"column_{place}"
        out.append(f"{name}_{place}" if name in out else name)
    return out


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of the content of every file. A file is one value here, so files of 2 GB and more don't fit; those belong in smaller parts."""
    content = spark.read.format("binaryFile").load(path)
    return content.select(
        F.col("path").alias("file_path"),
        F.col("length").alias("file_size"),
        text.content_hash(F.col("content")).alias("file_hash"),
    )
