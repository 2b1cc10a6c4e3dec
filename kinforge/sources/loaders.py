"""Readers of raw corpora: verbatim CSV, Parquet, gated files, snapshot archives."""

from __future__ import annotations

import hashlib
import re
import zipfile
from collections.abc import Callable
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.sources.schema import CORPORA, DeclaredSchema

QUARANTINE = 1000


def read_csv_verbatim(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Every cell as text; empty cells are '', and NA or NULL stay as written."""
    df = spark.read.csv(path, header=True, inferSchema=False, sep=sep, nullValue="\u0000", emptyValue="", multiLine=True, escape='"')
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def sha256(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def checksum_gate(path: str | Path) -> str:
    """Record a file's digest beside it the first time; raise when it has changed since."""
    path = Path(path)
    side, now = path.with_name(path.name + ".sha256"), sha256(path)
    if side.exists():
        if side.read_text().strip() != now:
            raise ValueError(f"{path} changed since it was first read")
    else:
        side.write_text(now + "\n")
    return now


def gated_files(folder: str | Path, patterns: list[str], hint: str = "") -> list[Path]:
    """Files of a local folder (or one level down) that fit; raises when there are none."""
    folder = Path(folder)
    found = sorted({p for g in patterns for p in folder.glob(g)}) or sorted({p for g in patterns for p in folder.glob(f"*/{g}")})
    if not found:
        raise FileNotFoundError(f"no {patterns} in {folder}. {hint}")
    for p in found:
        checksum_gate(p)
    return found


def with_file_rows(spark: SparkSession, path: str, stem: str, sep: str = ",") -> DataFrame:
    """A file's rows with ``__rid`` = ``<stem>:<row>``, rows counted from 0 in file order."""
    df = read_csv_verbatim(spark, path, sep)
    schema = df.schema.add("__rid", "string")
    numbered = df.rdd.zipWithIndex().map(lambda x: (*x[0], f"{stem}:{x[1]}"))  # file order exists in the RDD only
    return spark.createDataFrame(numbered, schema)


def load_corpus(spark: SparkSession, name: str, path: str | list[str], schema: DeclaredSchema | None = None) -> tuple[DataFrame, DeclaredSchema]:
    """Canonical role table of a declared corpus from CSV or Parquet.

    Several files of a corpus without a record id are numbered one by one and put
    together, so an id does not depend on which files were chosen.
    """
    schema = schema or CORPORA[name]
    paths = [path] if isinstance(path, str) else list(path)
    if schema.record_id != "__row__":
        df = spark.read.parquet(*paths) if paths[0].endswith(".parquet") else read_csv_verbatim(spark, paths)
        return schema.to_canonical(df), schema
    numbered = DeclaredSchema(schema.name, "__rid", schema.roles, schema.entity_id, schema.extra_keep)
    out = None
    for p in paths:
        part = numbered.to_canonical(with_file_rows(spark, p, Path(p).name.split(".")[0]))
        out = part if out is None else out.unionByName(part)
    return out, schema


def transcode(archive: str | Path, out: str | Path) -> Path:
    """Unpack the text of a UTF-16 archive into a UTF-8 file, a piece at a time."""
    out = Path(out)
    with zipfile.ZipFile(archive) as z:
        name = next(n for n in z.namelist() if n.lower().endswith((".txt", ".tsv")))
        with z.open(name) as raw:
            import codecs

            part = out.with_suffix(out.suffix + ".part")
            decode = codecs.getincrementaldecoder("utf-16")()
            with part.open("w", encoding="utf-8", newline="") as f:
                while chunk := raw.read(1 << 20):
                    f.write(decode.decode(chunk))
                f.write(decode.decode(b"", True))
            part.rename(out)  # the name appears once the file is whole
    return out


def parse_snapshot(spark: SparkSession, text_path: str, counties: list[int] | None = None, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, quarantine, stats) of an unquoted tab-separated snapshot.

    Short rows are padded with empty text, rows longer than the header go to the
    quarantine, quotes are ordinary characters. ``counties`` keeps rows whose
    county_id is one of the numbers, whatever its padding.
    """
    lines = spark.read.text(text_path)
    # the header is the file's first line: a one-row read
    header = [c.strip().lstrip("﻿") for c in lines.first()[0].rstrip("\r").split("\t")]
    clean = F.regexp_replace(F.regexp_replace("value", r"\r$", ""), "^﻿", "")
    cells = lines.select(F.split(clean, "\t", -1).alias("c"), F.monotonically_increasing_id().alias("place")).where(F.array_join("c", "\t") != "\t".join(header)).where(F.array_join("c", "") != "")
    width = len(header)
    long, short = F.size("c") > width, F.size("c") < width
    stats = cells.agg(F.count("*").alias("n_rows"), F.count_if(short).alias("n_short"), F.count_if(long).alias("n_long"))
    padded = F.concat("c", F.array_repeat(F.lit(""), width))
    rows = cells.where(~long).select(*[F.get(padded, F.lit(i)).alias(h) for i, h in enumerate(header)])
    if counties is not None:
        rows = rows.where(F.trim("county_id").try_cast("int").isin(counties))
    if columns is not None:
        rows = rows.select(*columns)
    first = cells.where(long).orderBy("place").limit(QUARANTINE)  # a report of the first ones
    return rows, first.select(F.array_join("c", "\t").alias("line")), stats


def snapshot_name(date: str) -> str:
    """File name of a snapshot; the date must be eight digits."""
    if not (len(date) == 8 and date.isdigit()):
        raise ValueError(f"bad snapshot date {date!r}")
    return f"VR_Snapshot_{date}.zip"


_LISTING = "{http://s3.amazonaws.com/doc/2006-03-01/}"


def parse_listing(xml: str, base: str) -> tuple[list[tuple[str, str, int]], str | None]:
    """([(date, address, bytes)], continuation token) of one page of an object store's listing.

    Objects that are no snapshot are left out; the token is there while pages follow.
    """
    root = ElementTree.fromstring(xml)
    found = []
    for entry in root.iter(f"{_LISTING}Contents"):
        key = entry.findtext(f"{_LISTING}Key") or ""
        if m := re.search(r"VR_Snapshot_(\d{8})\.zip$", key):
            found.append((m[1], f"{base.rstrip('/')}/{key}", int(entry.findtext(f"{_LISTING}Size") or 0)))
    more = (root.findtext(f"{_LISTING}IsTruncated") or "").lower() == "true"
    return found, root.findtext(f"{_LISTING}NextContinuationToken") if more else None


def list_snapshots(fetch: Callable[[dict[str, str]], str], base: str, prefix: str = "data/Snapshots/") -> list[tuple[str, str, int]]:
    """All snapshots by date; ``fetch`` gives the page of a query's parameters."""
    found: list[tuple[str, str, int]] = []
    token: str | None = None
    while True:
        page, token = parse_listing(fetch({"list-type": "2", "prefix": prefix} | ({"continuation-token": token} if token else {})), base)
        found += page
        if token is None:
            return sorted(found)
