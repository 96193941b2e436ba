"""Reading documents from files: expansion of inputs, decoding, format, guards. Bad files become rows, not failures."""

from __future__ import annotations

import os
from functools import reduce
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What counts as a document and where none are looked for.
SUFFIXES = (".md", ".markdown", ".mdx", ".mkd", ".txt")
MARKDOWN = SUFFIXES[:4]
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "venv")


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:md|markdown|mdx|mkd)$")


def guarded(path: Column, roots: list[str]) -> Column:
    """Whether a path is under one of the roots and has no hidden part below it."""
    bare = F.regexp_replace(path, "^file:/+", "/")
    out = F.lit(False)
    for root in roots:
        base = root.rstrip("/") + "/"
        out |= bare.startswith(base) & ~F.substring(bare, F.lit(len(base)), F.length(bare)).rlike(r"/\.")
    return out


def _found_in(path: Column, folder: str) -> Column:
    """Files that a folder's walk gives: known suffixes in any case, nothing hidden and no skipped folder below it."""
    below = F.split(F.substring(path, F.lit(len(folder) + 2), F.length(path)), "/")
    hidden = F.exists(below, lambda part: part.startswith(".")) | F.exists(F.slice(below, 1, F.greatest(F.lit(0), F.size(below) - 1)), lambda part: part.isin(*SKIPPED))
    return path.startswith(f"{folder}/") & ~hidden & F.lower(path).rlike(r"\.(?:" + "|".join(s[1:] for s in SUFFIXES) + ")$")


def read_documents(spark: SparkSession, paths: list[str], keep_bom: bool = False) -> DataFrame:
    """path, text, is_markdown, error: one row per different file, and one for each argument that names nothing.

    A folder is read recursively, for files of known suffixes; a file named as such has any suffix; a pattern (* ? [) gives the files
    that match. What an earlier argument gave is left out of the later ones by its path, so that no contents are shuffled."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = "path string, text string, is_markdown boolean, error string"
    out, taken, missing = [], F.lit(False), []
    for argument in paths:
        where = jvm.org.apache.hadoop.fs.Path(argument)
        fs = where.getFileSystem(conf)
        pattern = any(c in argument for c in "*?[") and not fs.exists(where)
        status = [] if not pattern and not fs.exists(where) else list(fs.globStatus(where) or []) if pattern else [fs.getFileStatus(where)]
        names = [s.getPath().toString() for s in status if not (pattern and s.isDirectory())]
        if not names:
            missing.append((argument, None, None, f"{'no files match' if pattern else 'not found'}: {argument}"))
            continue
        folder = not pattern and status[0].isDirectory()
        here = _found_in(F.col("path"), names[0].rstrip("/")) if folder else F.col("path").isin(*names)
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", folder).load(names)
        out.append(raw.filter(here & ~taken).select("path", "content"))
        taken = taken | here
    lost = spark.createDataFrame(missing, rows)
    if not out:
        return lost
    raw = reduce(DataFrame.unionByName, out)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(good, F.col("content").cast("string"))
    text = text if keep_bom else F.regexp_replace(text, "^\ufeff", "")
    read = raw.select("path", text.alias("text"), is_markdown(F.col("path")).alias("is_markdown"), F.when(~good, "not UTF-8").alias("error"))
    return read.unionByName(lost)


def read_suite(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A JSON document per file, with the schema given; `problem` names what is missing or that it isn't JSON."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return rows.withColumn("problem", F.when(F.col("_corrupt").isNotNull(), "not JSON").when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))).drop("_corrupt")


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of agent transcripts -> run_id (file), pos, type, message_id, tool_id, name, size, tokens."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("run_id"), F.monotonically_increasing_id().alias("pos"), "value")
    block = "array<struct<type string, id string, tool_use_id string, name string, content string>>"
    message = f"struct<id string, content {block}, usage struct<input_tokens bigint, output_tokens bigint>>"
    j = F.from_json("value", f"type string, result string, message {message}")
    rows = lines.withColumn("j", j).select("run_id", "pos", F.col("j.type").alias("event"), F.col("j.result").alias("result"), F.col("j.message.id").alias("message_id"), F.col("j.message.usage.input_tokens").alias("input_tokens"), F.col("j.message.usage.output_tokens").alias("output_tokens"), F.explode_outer("j.message.content").alias("b"))
    kind = F.coalesce(F.when(F.col("event") == "result", "result"), F.col("b.type"), F.col("event"))
    return rows.select("run_id", "pos", kind.alias("type"), "message_id", F.coalesce("b.tool_use_id", "b.id").alias("tool_id"), F.col("b.name").alias("name"), F.length(F.coalesce("b.content", "result")).alias("size"), "input_tokens", "output_tokens")


def read_tickets(spark: SparkSession, root: str) -> DataFrame:
    """Feedback tickets below submitters' folders: path (below the root), submitter (its first part; `unassigned` at the root), size, regular, content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    path = F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path"))

    @F.pandas_udf("boolean")
    def regular(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: not (p.startswith("file:") and os.path.islink(unquote(urlparse(p).path))))

    first = F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("unassigned")
    return raw.select(path.alias("path"), first.alias("submitter"), F.col("length").alias("size"), regular(F.col("path")).alias("regular"), "content")
