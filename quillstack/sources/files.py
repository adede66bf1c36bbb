"""File-shaped sources: scans of images and texts that belong together by their stem, profiles, text and labels."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import text as T

# Suffixes that are pages, the rule between pages, and the namespace of word-processor text.
IMAGES, DOCUMENTS = (".jpg", ".jpeg", ".png", ".webp"), (".pdf",)
RULE = "───"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    """path, suffix, content of all page files; other suffixes are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.withColumn("suffix", suffix(F.col("path"))).where(F.col("suffix").isin(*IMAGES, *DOCUMENTS)).select("path", "suffix", "content")


def pairs_by_stem(images: DataFrame, texts: DataFrame) -> DataFrame:
    """images (path, ...), texts (path, text): images with the non-blank text of the same folder and stem."""
    place = F.regexp_replace("path", r"\.[^./]*$", "")
    named = texts.select(place.alias("_place"), "text").where(T.strip(F.col("text")) != "")
    return images.withColumn("_place", place).join(named, "_place").withColumn("stem", T.stem(F.col("path"))).drop("_place")


def few_shot(images: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """The first pairs by path; the limit counts pairs that were accepted."""
    return pairs_by_stem(images, texts).orderBy("path").limit(most)


def profile(c: Column) -> Column:
    """A profile text without blank lines and comments."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: (T.strip(x) != "") & ~T.strip(x).startswith("#")), "\n")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of the .txt files (whole) and .docx files (paragraphs, page rules left out) of a folder."""
    plain = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [docx_text(c) for c in batch["content"]]})

    return plain.unionByName(packed.mapInPandas(paragraphs, "path string, text string"))


def docx_text(content: bytes) -> str:
    """Body paragraphs of a word-processor file, not those in tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{WORD}body")
    said = ("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in body.findall(f"{WORD}p"))
    return "\n".join(p for p in said if not p.startswith(RULE))


def write_labels(rows: DataFrame, folder: str) -> None:
    """Training labels: file, tab, label, in UTF-8 without header or quoting; one part file for each task."""
    rows.select(F.concat_ws("\t", "file", "label").alias("value")).write.mode("overwrite").text(folder)


def write_blocks(blocks: DataFrame, folder: str) -> None:
    """The raw transcription dump in page order, blocks parted by a blank line."""
    blocks.repartitionByRange("page_number").sortWithinPartitions("page_number").select(F.concat("block", F.lit("\n")).alias("value")).write.mode("overwrite").text(folder)
