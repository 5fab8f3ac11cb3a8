"""Project files as rows, and which of them are read.

Spark lists and reads the files; every rule is a predicate on path and size, so
contents are only read of files that stay.
"""

from __future__ import annotations

import fnmatch
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.folder import Folder

# What a scan leaves out.
MAX_KB = 512
SKIPPED_DIRS = ("node_modules", "__pycache__")
BINARY = "png jpg jpeg gif svg ico webp bmp woff woff2 ttf eot otf mp3 mp4 avi mov zip tar gz bz2 7z rar exe dll so dylib bin class jar pyc o a wasm sqlite db lock map".split()
MINIFIED = r"\.min\.(?:js|css)$"


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(keeps, pattern) of the lines of an ignore file, in order; a later rule wins."""
    rules = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        body = line[keeps:].rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/")
        pattern = glob_pattern(body)[1:-1]
        rules.append((keeps, f"^{pattern}(?:/.*)?$" if anchored else f"(?:^|/){pattern}(?:/.*)?$"))
    return rules


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the last rule that a relative path meets leaves it out."""
    out = F.lit(False)
    for keeps, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(not keeps)).otherwise(out)
    return out


def ignore_files(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """(file_path, text) of the files of these names in all folders under root.

    Their names mostly start with a dot, and such files Spark's readers pass over: the driver walks the listing, a file at a time, and reads those alone.
    """
    folder = Folder(spark, root)
    files, at = folder._at()
    base, rows = files.makeQualified(at).toUri().getPath().rstrip("/"), []
    walk = files.listFiles(at, True)
    while walk.hasNext():
        path = walk.next().getPath()
        if path.getName() in names:
            inside = path.toUri().getPath()[len(base) + 1 :]
            rows.append((inside, folder.text(inside)))
    return spark.createDataFrame(rows, "file_path string, text string")


def directory_rules(lists: DataFrame) -> DataFrame:
    """(dir, line, keeps, pattern) of all rules of ignore files (file_path, text): a rule holds for what is under its file's folder ('' is the root)."""

    def run(batches):
        for batch in batches:
            rows = [(path.rpartition("/")[0], n, keeps, pattern) for path, text in zip(batch["file_path"], batch["text"], strict=True) for n, (keeps, pattern) in enumerate(ignore_rules(text or ""))]
            yield pd.DataFrame(rows, columns=["dir", "line", "keeps", "pattern"])

    return lists.select("file_path", "text").mapInPandas(run, "dir string, line int, keeps boolean, pattern string")


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The files (file_path) that the ignore files of their folders keep: of the rules that a path meets, each relative to its own folder, the one of the deepest folder counts, and of that the last.

    A path is joined with the rules of each folder above it, by the folder; the join of all paths with the root's rules is
    one that adaptive execution can split or broadcast.  Equal paths are one file.
    """
    parts = F.split("file_path", "/")
    depths = F.sequence(F.lit(0), F.size(parts) - 1)
    above = files.select("file_path").distinct().select("file_path", F.explode(F.transform(depths, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("dir"), F.array_join(F.slice(parts, d + 1, F.size(parts)), "/").alias("rest")))).alias("x")).select("file_path", "x.*")
    met = above.join(rules, "dir").filter(F.expr("rest RLIKE pattern"))
    last = met.groupBy("file_path").agg(F.max_by("keeps", F.struct("depth", "line")).alias("_keeps")).filter("NOT _keeps").select("file_path")
    return files.join(last, "file_path", "left_anti").select(*files.columns)


def kept(path: Column, size: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), rules: list[tuple[bool, str]] | tuple = (), max_kb: int = MAX_KB) -> Column:
    """The rules in their order: excluded globs, built-in ones, ignore files, then the allowlist."""
    none_of = lambda globs: [path.rlike(glob_pattern(g)) for g in globs]
    test = F.lit(True)
    for hit in none_of(exclude):
        test = test & ~hit
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    test = test & (size <= max_kb * 1024) & ~ext.isin(*BINARY) & ~path.rlike(MINIFIED)
    test = test & ~path.rlike(r"(?:^|/)(?:\.[^/]*|" + "|".join(map(re.escape, SKIPPED_DIRS)) + ")/")
    if rules:
        test = test & ~ignored(path, list(rules))
    if include:
        some = F.lit(False)
        for hit in none_of(include):
            some = some | hit
        test = test & some
    return test


def scan(spark: SparkSession, root: str, contents: bool = False, ignore: tuple[str, ...] = (), locations: bool = False, only: list[str] | None = None, **filters) -> DataFrame:
    """(file_path, size, mtime_ns[, text, hash][, location]) of the files under root that the rules keep; paths are relative.

    Files named like one of ``ignore``, in whatever folder, are ignore files, and their rules hold for that folder.
    ``only`` names locations: other files are listed but not opened, and one that goes before it is opened is left out.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", str(only is not None).lower()).load(root)
    if only is not None:
        rows = rows.filter(F.col("_metadata.file_path").isin(only))  # decided on the listing
    if locations:
        rows = rows.withColumn("location", F.col("_metadata.file_path"))
    base = re.sub(r"^file:/*|/+$", "", root)
    relative = F.regexp_replace("path", "^(?:[a-z]+:/*)?/*" + re.escape(base.strip("/")) + "/", "")
    found = rows.withColumn("file_path", relative).filter(kept(F.col("file_path"), F.col("length"), **filters))
    if ignore:
        found = not_ignored(found, directory_rules(ignore_files(spark, root, ignore)))
    out = ["file_path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")]
    if contents:
        out += [F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("hash")]
    if locations:
        out.append("location")
    return found.select(*out)


def listing(files: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files whose name ends as one of ``include`` (like *.php) and of whose folders none is excluded."""
    if include:
        endings = [i.removeprefix("*") for i in include]
        test = F.lit(False)
        for e in endings:
            test = test | F.col("file_path").endswith(e)
        files = files.filter(test)
    return files.filter(~F.arrays_overlap(F.split("file_path", "/"), F.array(*map(F.lit, exclude)))) if exclude else files


def matches(name: str, glob: str) -> bool:
    """The same on the driver, for one name."""
    return bool(re.match(glob_pattern(glob), name)) if "/" in glob or "**" in glob else fnmatch.fnmatchcase(name, glob)
