"""Listings of repositories' files: what is looked at, and how much of it."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.redact import redact
from ..functions.text import glob_pattern

MAX_BYTES, MAX_DEPTH, MAX_FILES = 512 * 1024, 4, 4000
# Directories of others' code and of build output.
SKIPPED_DIRECTORIES = ("node_modules", "vendor", "dist", "build", "target", "venv", "__pycache__", "site-packages")


def looked_at(path: Column, depth: int = MAX_DEPTH) -> Column:
    """Whether a path lies in no skipped or hidden directory (but .github), within ``depth`` directories, and does not leave its root."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(folders, lambda p: p.isin(*SKIPPED_DIRECTORIES) | (p.startswith(".") & (p != ".github")))
    out = ~hidden & ~path.startswith("/") & ~F.exists(parts, lambda p: p == "..")
    return out & (F.size(folders) <= depth)


def tracked(files: DataFrame) -> DataFrame:
    """The files of a version control listing that are looked at."""
    return files.filter(looked_at(F.col("path")))


def walked(files: DataFrame) -> DataFrame:
    """The files of a directory walk that are looked at: the first MAX_FILES of each repository, by path."""
    near = files.filter(looked_at(F.col("path")))
    nth = F.row_number().over(Window.partitionBy("repo").orderBy("path"))
    return near.withColumn("nth_file", nth).filter(F.col("nth_file") <= MAX_FILES).drop("nth_file")


def listed(from_control: DataFrame, from_walk: DataFrame) -> DataFrame:
    """Tracked files, and for repositories without any the walked ones."""
    known = tracked(from_control)
    return known.unionByName(walked(from_walk).join(known.select("repo").distinct(), "repo", "left_anti").select(*known.columns))


def named(files: DataFrame, names: Sequence[str]) -> DataFrame:
    """The files with one of the base names or shell patterns."""
    base = F.element_at(F.split("path", "/"), -1)
    exact = [n for n in names if not re.search(r"[*?]", n)]
    hit = base.isin(*exact) if exact else F.lit(False)
    for n in names:
        if n not in exact:
            hit = hit | base.rlike(glob_pattern(n))
    return files.filter(hit)


def capped(files: DataFrame, cap: int) -> DataFrame:
    """Redacted contents, cut to ``cap`` characters with a mark; files over MAX_BYTES go."""
    text = redact(F.col("content"))
    short = F.when(F.char_length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("\n... truncated"))).otherwise(text)
    return files.filter(F.col("size") <= MAX_BYTES).withColumn("content", short)


def named_apart(found: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """``found`` (path) with name: the base name, and where several share it, with the parent's before it; excluded names go.

    Where those still collide, the name is the whole path's letters and digits.
    """
    parts = F.split(F.rtrim(F.col("path"), F.lit("/")), "/")
    rows = found.withColumn("base", F.element_at(parts, -1))
    several = F.count("*").over(Window.partitionBy("base")) > 1
    rows = rows.withColumn("name", F.when(several, F.concat_ws("-", F.get(parts, F.size(parts) - 2), F.col("base"))).otherwise(F.col("base")))
    again = F.count("*").over(Window.partitionBy("name")) > 1
    slug = F.trim(F.regexp_replace("path", "[^A-Za-z0-9]+", "-"), F.lit("-"))
    rows = rows.withColumn("name", F.when(again, slug).otherwise(F.col("name")))
    return rows.filter(~F.col("name").isin(*excluded) & ~F.col("base").isin(*excluded)).drop("base") if excluded else rows.drop("base")


def required(repos: DataFrame) -> DataFrame:
    """``repos``, or an error where there is none: an unmounted root must not empty the output."""
    if repos.isEmpty():
        raise ValueError("no repository was found")
    return repos


def load_manifests(raw: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifests of known repositories, those of others) of well-formed rows (path, name, ...), by path; a null name is malformed."""
    sound = raw.filter(F.col("name").isNotNull())
    return sound.join(known.select("name"), "name", "left_semi").orderBy("path"), sound.join(known.select("name"), "name", "left_anti").orderBy("path")


def complete(meta: str = "_meta", fields: Sequence[str] = ("commit", "generated_at", "repo_path", "mode")) -> Column:
    """Whether a manifest's record has each needed field, and not empty."""
    out = F.lit(True)
    for f in fields:
        out = out & (F.coalesce(F.col(f"{meta}.{f}").cast("string"), F.lit("")) != "")
    return out
