"""The entry of all sources: files, folders, URLs and inline text to cleaned blocks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.clean import clean
from foliospark.functions.text import has_content
from foliospark.session import cut
from foliospark.sources.fetch import fetch, public_addresses
from foliospark.sources.files import EXTRACTORS, extract, read_files

#: Fewer visible characters than this are no document; a single line under INLINE_BYTES with a known ending is a path.
MIN_CHARS, INLINE_BYTES = 20, 4096


def kind_of(spark: SparkSession, source: str) -> str:
    """url, folder, file, missing (looks like a file that is not there) or inline; what exists wins over inline text."""
    if re.match(r"(?i)https?://\S+$", source.strip()):
        return "url"
    one_line = "\n" not in source and len(source.encode()) < INLINE_BYTES
    if one_line and source.strip():
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(source)
            system = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if system.exists(path):
                return "folder" if system.getFileStatus(path).isDirectory() else "file"
        except Exception:  # not a path that any file system reads
            pass
        ending = source.rsplit(".", 1)[-1].lower() if "." in source else ""
        if ending in EXTRACTORS and not re.search(r"\s", source.rsplit("/", 1)[-1].strip()):
            return "missing"
    return "inline"


def ingest(spark: SparkSession, sources: list[str], preset: str = "standard", min_chars: int = MIN_CHARS, recursive: bool = True, options: dict | None = None, check=public_addresses) -> DataFrame:
    """blocks(document, block_id, text, page, section, kind, error) of a list of sources, cleaned under a preset.

    Folders are read for the files that an extractor claims, in order of path. Inline text is named inline-1, ... A
    source that is missing or cannot be read, and one that keeps fewer than ``min_chars`` visible characters, is a row
    with an error, so no source goes missing silently.
    """
    kinds = [(s, kind_of(spark, s)) for s in sources]
    files = None
    for source, kind in kinds:
        if kind in ("file", "folder"):
            found = read_files(spark, source, recursive).select("path", "content", F.lit(None).cast("string").alias("error"))
            files = found if files is None else files.unionByName(found)
    inline = [(f"inline-{n}.md", s.encode(), None) for n, s in enumerate((s for s, kind in kinds if kind == "inline"), 1)]
    inline += [(s, None, "FileNotFoundError: there is no such file") for s, kind in kinds if kind == "missing"]
    given = spark.createDataFrame(inline, "path string, content binary, error string")
    files = given if files is None else files.unionByName(given)
    urls = [(s.strip(),) for s, kind in kinds if kind == "url"]
    if urls:
        files = files.unionByName(fetch(spark.createDataFrame(urls, "url string"), check=check))
    files = cut(files)
    lost = files.filter("error is not null").select(F.col("path").alias("document"), "error")
    blocks = extract(files.filter("error is null"), options)
    read = cut(blocks.withColumn("text", clean(F.col("text"), preset)))
    kept = read.filter(has_content(F.col("text")))
    sizes = read.groupBy("document").agg(F.coalesce(F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""))), F.lit(0)).alias("n"), F.max("error").alias("error"))
    few = sizes.filter((F.col("n") < min_chars) & F.col("error").isNull()).select("document", F.lit("empty document").alias("error"))
    none = lambda kind: F.lit(None).cast(kind)
    told = lost.unionByName(few).select("document", F.lit(0).alias("block_id"), none("string").alias("text"), none("int").alias("page"), none("string").alias("section"), none("string").alias("kind"), "error")
    whole = kept.join(few.select("document"), "document", "left_anti").unionByName(read.filter("error is not null")).unionByName(told)
    return whole.withColumn("document", F.regexp_replace("document", r"^(inline-[0-9]+)\.md$", "$1"))
