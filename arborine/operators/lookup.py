"""Lookups over the graph for many symbols or files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborine.functions.text import doc_summary, dotted_suffixes, line_slice, text_lines
from arborine.operators.skew import ranked
from arborine.operators.traverse import reverse_reach
from arborine.sources.scratch import Scratch

#: Rows of a report: the id as name where the name is absent.
REF = ("id", "name", "kind", "path", "start_line")


def match_symbols(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(query, id): nodes that a query names by id, name, qualified name or a dotted end of it.

    An equi-join on all ends of the qualified names takes the place of a suffix comparison.
    """
    keys = nodes.select("id", F.explode(F.array_distinct(F.concat(F.array("id", "name"), dotted_suffixes(F.col("qualified_name"))))).alias("query"))
    return keys.join(names.select("query").distinct(), "query").select("query", "id")


def _side(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.select(F.col("id").alias(key), F.coalesce(F.nullif("name", F.lit("")), "id").alias("name"), "kind", "path", "start_line")


def callees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_id, dst_id, name, kind, path, start_line): what each symbol calls, self-calls included, among real nodes."""
    calls = edges.where("kind = 'calls'").select("src_id", "dst_id").distinct()
    return calls.join(_side(nodes.where("path <> ''"), "dst_id"), "dst_id").select("src_id", "dst_id", "name", "kind", "path", "start_line")


def callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dst_id, src_id, name, kind, path, start_line): who calls each id, among real nodes."""
    calls = edges.where("kind = 'calls'").select("src_id", "dst_id").distinct()
    return calls.join(_side(nodes.where("path <> ''"), "src_id"), "src_id").select("dst_id", "src_id", "name", "kind", "path", "start_line")


def supertypes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(class_id, id, name, path): direct supertypes of each class; unresolved names are left out."""
    classes = nodes.where("kind = 'class'").select(F.col("id").alias("src_id"))
    up = edges.where("kind = 'inherits'").select("src_id", "dst_id").distinct().join(classes, "src_id", "left_semi")
    return up.join(_side(nodes, "dst_id"), "dst_id").select(F.col("src_id").alias("class_id"), F.col("dst_id").alias("id"), "name", "path")


def subtypes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(class_id, id, name, path): direct subtypes of each class."""
    classes = nodes.where("kind = 'class'").select(F.col("id").alias("dst_id"))
    down = edges.where("kind = 'inherits'").select("src_id", "dst_id").distinct().join(classes, "dst_id", "left_semi")
    return down.join(_side(nodes, "src_id"), "src_id").select(F.col("dst_id").alias("class_id"), F.col("src_id").alias("id"), "name", "path")


def file_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, id): what each file imports and is no file itself."""
    files = nodes.where("kind = 'file'")
    out = edges.where("kind = 'imports'").select(F.col("src_id").alias("path"), F.col("dst_id").alias("id")).distinct()
    return out.join(files.select(F.col("id").alias("path")), "path", "left_semi").join(files.select("id"), "id", "left_anti").select("path", "id")


def file_dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, id): who imports each file."""
    files = nodes.where("kind = 'file'").select(F.col("id").alias("path"))
    return edges.where("kind = 'imports'").select(F.col("dst_id").alias("path"), F.col("src_id").alias("id")).distinct().join(files, "path", "left_semi").select("path", "id")


def file_imports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(importer, imported): imports between files."""
    files = nodes.where("kind = 'file'").select("id")
    pairs = edges.where("kind = 'imports'").select("src_id", "dst_id").distinct()
    return pairs.join(files.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(files.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select(F.col("src_id").alias("importer"), F.col("dst_id").alias("imported"))


def neighbours(edges: DataFrame, seeds: DataFrame, kinds: tuple[str, ...] = (), direction: str = "both", depth: int = 1) -> DataFrame:
    """(seed, id, depth): ids within ``depth`` steps of each seed (id) along edges of ``kinds`` (all if empty)."""
    used = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    out = used.select(F.col("dst_id").alias("src"), F.col("src_id").alias("dst"))
    into = used.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return reverse_reach({"out": out, "in": into, "both": out.unionByName(into)}[direction], seeds, depth)


def all_neighbours(edges: DataFrame) -> DataFrame:
    """(seed, id, depth): ids one step from every id of the graph, placeholders included, along edges of any kind.

    As every end of an edge is a seed, the edges are the result and no join has to bring the rows of a heavy id together.
    """
    out = edges.where("src_id <> dst_id").select(F.col("src_id").alias("seed"), F.col("dst_id").alias("id"))
    return out.unionByName(out.select(F.col("id").alias("seed"), F.col("seed").alias("id"))).distinct().withColumn("depth", F.lit(1).cast("long"))


def file_outline(nodes: DataFrame) -> DataFrame:
    """(path, language, id, kind, name, signature, start_line, end_line, summary, place): the symbols of each file.

    ``language`` is that of the file's own row, '' where there is none; ``place`` is the 1-based place by line and id.
    """
    files = nodes.where("kind = 'file'").groupBy("path").agg(F.min("language").alias("language"))
    symbols = nodes.where("kind <> 'file'").select("path", "id", "kind", "name", "signature", "start_line", "end_line", F.coalesce(doc_summary(F.col("docstring")), F.lit("")).alias("summary"))
    met = symbols.join(files, "path", "left").withColumn("language", F.coalesce("language", F.lit("")))
    placed = ranked(met, "path", ["start_line", "id"], Scratch(nodes.sparkSession, "outline"))
    return placed.select("path", "language", "id", "kind", "name", "signature", "start_line", "end_line", "summary", F.col("rank").alias("place"))


def read_symbol(nodes: DataFrame, texts: DataFrame, newest: str | None = None) -> DataFrame:
    """(id, path, source): the lines of each symbol that is no file, '' where the text is missing.

    ``texts`` has (path, text); of several texts of a path the one with the latest ``newest`` is taken, of equals the greatest; null
    texts are none. Each text is cut into lines once, before the symbols of its file meet it.
    """
    order = [F.col(newest).alias("_at")] if newest else []
    known = texts.where(F.col("path").isNotNull() & F.col("text").isNotNull())
    one = known.groupBy("path").agg(F.max(F.struct(*order, F.col("text").alias("text"))).alias("t")).select("path", text_lines(F.col("t.text")).alias("lines"))
    cut = nodes.where("kind <> 'file'").select("id", "path", "start_line", "end_line").join(one, "path", "left")
    return cut.select("id", "path", line_slice(F.col("lines"), F.col("start_line"), F.col("end_line")).alias("source"))


def overview(nodes: DataFrame) -> DataFrame:
    """(files, symbols) of the graph."""
    return nodes.where("path <> ''").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") != "file").alias("symbols"))


def language_mix(nodes: DataFrame) -> DataFrame:
    """(language, files) of the files with a language."""
    return nodes.where("kind = 'file' and language <> ''").groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def hubs(nodes: DataFrame, edges: DataFrame, limit: int = 15) -> DataFrame:
    """(path, dependents): the files with most importing files."""
    pairs = file_imports(nodes, edges)
    return pairs.groupBy(F.col("imported").alias("path")).agg(F.count(F.lit(1)).alias("dependents")).orderBy(F.desc("dependents"), "path").limit(limit)
