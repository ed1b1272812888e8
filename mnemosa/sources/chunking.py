"""Sections of Markdown and symbols of Python sources, as chunks with byte spans; states of indexed files."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECTION = "source_path string, anchor string, title string, heading_path string, level int, byte_start long, byte_end long, body string"
SYMBOL = "source_path string, anchor string, kind string, signature string, doc string, byte_start long, byte_end long, body string"

_atx = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_fence = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_slug = re.compile("[^a-z0-9]+")


def headings(text: str) -> list[tuple[int, int, str]]:
    """Level, byte offset and title of each heading outside front matter and fences; underlined ones too."""
    found, fence, at, before = [], None, 0, None
    lines = text.split("\n")
    front = 0
    if lines and lines[0].strip() in ("---", "+++"):  # YAML or TOML; without an end it is text
        front = next((i + 1 for i, s in enumerate(lines[1:], 1) if s.strip() == lines[0].strip()), 0)
    for i, line in enumerate(lines):
        size = len(line.encode()) + 1
        if i >= front:
            mark = _fence.match(line)
            if fence:
                if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                    fence = None
            elif mark:
                fence = mark[1]
            elif m := _atx.match(line):
                found.append((len(m[1]), at, (m[2] or "").strip()))
            elif before and before[1].strip() and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line):
                found.append((1 if "=" in line else 2, before[0], before[1].strip()))
                before = None
                at += size
                continue
            before = None if fence or mark or _atx.match(line) else (at, line)
        at += size
    return found


def sections(path: str, text: str) -> list[tuple]:
    """One row for each heading, up to the next of any level; what stands before the first is a row of level 0."""
    data, found = text.encode(), headings(text)
    if not found:
        return [(path, "_root", path, "", 0, 0, len(data), text)] if data.strip() else []
    out, stack, seen = [], [], {}
    if data[: found[0][1]].strip():
        out.append((path, "_root", path, "", 0, 0, found[0][1], data[: found[0][1]].decode()))
    for (level, start, title), end in zip(found, [*(s for _, s, _ in found[1:]), len(data)], strict=True):
        stack = [x for x in stack if x[0] < level]
        slug = _slug.sub("-", title.lower()).strip("-") or "section"
        anchor = "/".join([*(s for _, s, _ in stack), slug])
        seen[anchor] = seen.get(anchor, 0) + 1
        if seen[anchor] > 1:
            slug = f"{slug}-{seen[anchor]}"
            anchor = "/".join([*(s for _, s, _ in stack), slug])
        out.append((path, anchor, title, " > ".join(t for _, _, t in stack), level, start, end, data[start:end].decode()))
        stack.append((level, slug, title))
    return out


def symbols(path: str, source: str) -> list[tuple]:
    """Functions, classes and methods with signature and docstring; none of a source that doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    data, starts = source.encode(), [0]
    for line in source.split("\n"):
        starts.append(starts[-1] + len(line.encode()) + 1)
    out = []

    def walk(body: list, above: str) -> None:
        for node in body:
            if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            name = f"{above}.{node.name}" if above else node.name
            is_class = isinstance(node, ast.ClassDef)
            head = f"class {node.name}" if is_class else f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)})"
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            begin, end = starts[first - 1], min(starts[node.end_lineno], len(data))
            out.append((path, name, "class" if is_class else "method" if above else "function", head, ast.get_docstring(node), begin, end, data[begin:end].decode()))
            if is_class:
                walk(node.body, name)

    walk(tree.body, "")
    return out


def _each(df: DataFrame, rows_of, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["source_path"], b["body"], strict=True) for r in rows_of(p, t or "")], columns=names)

    return df.select("source_path", "body").mapInPandas(run, schema)


def markdown_sections(files: DataFrame) -> DataFrame:
    """Sections of files (source_path, body)."""
    return _each(files, sections, SECTION)


def python_symbols(files: DataFrame) -> DataFrame:
    return _each(files, symbols, SYMBOL)


#: What gives the symbols of a source (rows of SYMBOL from path and text), by suffix; other languages are a parser away.
EXTRACTORS = {".py": symbols}


def code_symbols(files: DataFrame, extractors: dict = EXTRACTORS) -> DataFrame:
    """Symbols of files (source_path, body) whose suffix has an extractor; one that gives None, as a missing parser does, has none."""
    of = dict(extractors)

    def rows_of(path: str, body: str) -> list[tuple]:
        found = next((f for s, f in of.items() if path.endswith(s)), None)
        return (found(path, body) if found else None) or []

    return _each(files.where(F.col("source_path").rlike("(" + "|".join(map(re.escape, of)) + r")\z")), rows_of, SYMBOL)


def unique_anchors(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """anchor with ~2, ~3 after it where it repeats."""
    n = F.row_number().over(W.partitionBy(*by, "anchor").orderBy(order))
    return rows.withColumn("_n", n).withColumn("anchor", F.when(F.col("_n") == 1, F.col("anchor")).otherwise(F.concat("anchor", F.lit("~"), F.col("_n").cast("string")))).drop("_n")


def source_states(indexed: DataFrame, live: DataFrame) -> DataFrame:
    """path and state (fresh, changed, new, gone) of files by hash."""
    both = indexed.select("path", F.col("hash").alias("_old")).join(live.select("path", F.col("hash").alias("_new")), "path", "full")
    return both.select("path", F.when(F.col("_new").isNull(), "gone").when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("_new"), "fresh").otherwise("changed").alias("state"))


def replace_sources(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """chunks with the sources of new in their new form."""
    return chunks.join(new.select("project_key", "source_path").distinct(), ["project_key", "source_path"], "left_anti").unionByName(new, allowMissingColumns=True)


def discover(spark, root: str, suffixes: tuple[str, ...] = (".md", ".py"), most: int = 2_000_000) -> DataFrame:
    """source_path, body, hash of the files under root with these suffixes, outside hidden and vendor folders, of at most `most` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)
    skip = r"/(\.[^/]+|node_modules|__pycache__|venv|dist|build)/"
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", root).rstrip("/")
    relative = F.regexp_replace("path", "^.*?" + re.escape(plain) + "/", "")
    kept = files.where((F.col("length") <= most) & ~F.concat(F.lit("/"), relative).rlike(skip))
    return kept.select(relative.alias("source_path"), F.decode("content", "UTF-8").alias("body"), F.sha2("content", 256).alias("hash"))
