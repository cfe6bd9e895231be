"""Zip archives of books: entries as rows, the package inside them, and the way back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions.text import dirname, join_path, normpath

ENTRY = "book_id string, ordinal int, name string, content binary"
PACKAGE_TYPE = "application/oebps-package+xml"
XHTML = "application/xhtml+xml"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of every archive at ``path``; the book is the file's name without its suffix. A broken archive has no entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                names = [n for n in archive.namelist() if not n.endswith("/")]
                for i, n in enumerate(names):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int32()), pa.array([n]), pa.array([archive.read(n)], pa.binary())], ["book_id", "ordinal", "name", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("b"), "content").mapInArrow(run, ENTRY)


def package_paths(entries: DataFrame) -> DataFrame:
    """(book_id, opf_path): the one the container names, else the first file that looks like one."""
    box = entries.where("name = 'META-INF/container.xml'").select("book_id", F.from_xml(F.decode("content", "UTF-8"), "rootfiles struct<rootfile:array<struct<`_full-path`:string,`_media-type`:string>>>").alias("x"))
    named = box.select("book_id", F.get(F.filter("x.rootfiles.rootfile", lambda r: r["_media-type"] == PACKAGE_TYPE), F.lit(0))["_full-path"].alias("named"))
    found = entries.where("lower(name) like '%.opf'").groupBy("book_id").agg(F.min_by("name", "ordinal").alias("found"))
    return entries.select("book_id").distinct().join(named, "book_id", "left").join(found, "book_id", "left").select("book_id", F.coalesce("named", "found").alias("opf_path"))


OPF = "metadata struct<`dc:title`:array<string>,`dc:creator`:array<string>,`dc:language`:array<string>,meta:array<struct<_name:string,_content:string>>>, manifest struct<item:array<struct<_id:string,_href:string,`_media-type`:string,_properties:string>>>, spine struct<itemref:array<struct<_idref:string,_linear:string>>>"


def packages(entries: DataFrame) -> DataFrame:
    """(book_id, opf_path, x) with the parsed package."""
    at = package_paths(entries).where("opf_path is not null")
    return at.join(entries, (at.book_id == entries.book_id) & (at.opf_path == entries.name)).select(at.book_id, "opf_path", F.from_xml(F.decode("content", "UTF-8"), OPF).alias("x"))


def manifest_items(opened: DataFrame) -> DataFrame:
    """(book_id, ordinal, item_id, href, media_type, properties): paths from the archive's root; the last of equal ids counts."""
    each = opened.select("book_id", "opf_path", F.posexplode("x.manifest.item").alias("ordinal", "i")).where("i._id is not null")
    last = each.groupBy("book_id", F.col("i._id").alias("item_id")).agg(F.max_by(F.struct("opf_path", "i"), "ordinal").alias("l"), F.min("ordinal").alias("ordinal"))
    href = normpath(join_path(dirname(F.col("l.opf_path")), F.coalesce(F.col("l.i._href"), F.lit(""))))
    return last.select("book_id", "ordinal", "item_id", href.alias("href"), F.coalesce(F.col("l.i.`_media-type`"), F.lit("")).alias("media_type"), F.coalesce(F.col("l.i._properties"), F.lit("")).alias("properties"))


def spine_rows(opened: DataFrame) -> DataFrame:
    """(book_id, pos from 1, idref, linear) in reading order."""
    return opened.select("book_id", F.posexplode("x.spine.itemref").alias("pos", "r")).select("book_id", (F.col("pos") + 1).alias("pos"), F.col("r._idref").alias("idref"), F.coalesce("r._linear", F.lit("yes")).alias("linear"))


def metadata(opened: DataFrame) -> DataFrame:
    m = F.col("x.metadata")
    none = F.array().cast("array<string>")
    return opened.select("book_id", F.coalesce(F.get(m["dc:title"], F.lit(0)), F.col("book_id")).alias("title"), F.coalesce(m["dc:creator"], none).alias("authors"), F.coalesce(F.get(m["dc:language"], F.lit(0)), F.lit("und")).alias("language"))


def content_documents(entries: DataFrame, opened: DataFrame, include_nav: bool = False) -> DataFrame:
    """(book_id, pos, idref, linear, href, properties, content) of the XHTML pages in reading order; pages the archive lacks are left out."""
    items = manifest_items(opened).withColumnRenamed("item_id", "idref").where(F.col("media_type") == XHTML)
    if not include_nav:
        items = items.where(~F.array_contains(F.split("properties", r"\s+"), "nav"))
    pages = entries.select("book_id", F.col("name").alias("href"), "content")
    return spine_rows(opened).join(items, ["book_id", "idref"]).join(pages, ["book_id", "href"]).select("book_id", "pos", "idref", "linear", "href", "properties", "content")


def cover(entries: DataFrame, opened: DataFrame) -> DataFrame:
    """(book_id, name, content) of the cover: by property, else the item that the metadata names, else the first image whose id speaks of one."""
    named = opened.select("book_id", F.filter("x.metadata.meta", lambda m: (m["_name"] == "cover") & (F.coalesce(m["_content"], F.lit("")) != "")).alias("m"))
    items = manifest_items(opened).join(named.select("book_id", F.get("m", F.lit(0))["_content"].alias("meant")), "book_id", "left")
    rank = F.when(F.array_contains(F.split("properties", r"\s+"), "cover-image"), 0).when(F.col("item_id") == F.col("meant"), 1).when(F.lower("item_id").contains("cover") & F.col("media_type").startswith("image/"), 2)
    best = items.withColumn("rank", rank).where("rank is not null").join(entries.select("book_id", F.col("name").alias("href"), "content"), ["book_id", "href"])
    return best.groupBy("book_id").agg(F.min_by(F.struct(F.col("href").alias("name"), "content"), F.struct("rank", "ordinal")).alias("c")).select("book_id", "c.name", "c.content")


def under(entries: DataFrame, folder: str) -> DataFrame:
    """Entries below the package's ``folder``, in the order of their paths (css, fonts)."""
    at = package_paths(entries)
    root = F.concat(dirname(F.coalesce("opf_path", F.lit(""))), F.lit("/"))
    return entries.join(at, "book_id").where(F.col("name").startswith(F.concat(F.when(root == "/", "").otherwise(root), F.lit(f"{folder}/")))).select("book_id", "name", "content").orderBy("book_id", "name")


def image_files(entries: DataFrame) -> DataFrame:
    """(book_id, name, content) by bare name; the last of equal names counts."""
    base = F.element_at(F.split("name", "/"), -1)
    found = entries.where(F.lower("name").rlike(r"\.(?:jpg|jpeg|png|gif|svg|webp)$")).withColumn("base", base)
    return found.groupBy("book_id", F.col("base").alias("name")).agg(F.max_by("content", "ordinal").alias("content"))


def overlay(entries: DataFrame, replaced: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """Archive entries with others in their place: kept ones in order, then replacements by name, then additions not replaced."""
    kept = entries.join(replaced.select("book_id", "name"), ["book_id", "name"], "left_anti").select("book_id", F.struct(F.when(F.col("name") == "mimetype", 0).otherwise(1).alias("part"), "ordinal", "name").alias("o"), "name", "content")
    later = replaced.select("book_id", F.struct(F.lit(2).alias("part"), F.lit(0).alias("ordinal"), "name").alias("o"), "name", "content")
    rows = kept.unionByName(later)
    if added is not None:
        rest = added.join(replaced.select("book_id", "name"), ["book_id", "name"], "left_anti")
        rows = rows.unionByName(rest.select("book_id", F.struct(F.lit(3).alias("part"), F.lit(0).alias("ordinal"), "name").alias("o"), "name", "content"))
    return rows


def zipped(rows: DataFrame) -> DataFrame:
    """(book_id, content): one archive per book from (book_id, o, name, content) in the order of o; the mimetype first and stored. A book fits a task."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        order = pdf.assign(k=[tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in pdf["o"]]).sort_values("k")
        with zipfile.ZipFile(out, "w") as z:
            for name, content in zip(order["name"], order["content"], strict=True):
                z.writestr(zipfile.ZipInfo(name), bytes(content), zipfile.ZIP_STORED)
        return pd.DataFrame({"book_id": [pdf["book_id"].iloc[0]], "content": [out.getvalue()]})

    return rows.groupBy("book_id").applyInPandas(pack, "book_id string, content binary")
