"""One object with the questions that can be asked of a code graph; every answer is a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborine.operators import lookup as L
from arborine.operators import resolve as R
from arborine.operators import retrieve as V
from arborine.operators import snapshot as S
from arborine.operators import traverse as X
from arborine.sources.extract import extracted_edges, extracted_symbols, parse_files
from arborine.sources.scratch import Scratch


class CodeGraph:
    """A snapshot of symbols and edges with the texts they came from.

    ``symbols`` and ``edges`` have the columns of the tables of those names, ``texts`` has (path, text). Answers
    are lazy; calls with several names or files, or with a frame of them, answer all of them at once.
    """

    def __init__(self, spark: SparkSession, symbols: DataFrame, edges: DataFrame, texts: DataFrame | None = None) -> None:
        self.spark = spark
        self.nodes = S.upsert_nodes(S.migrated(symbols))
        self.edges = S.upsert_edges(edges, self.nodes)
        self.hashes = spark.createDataFrame([], "path string, content_hash string")
        self.texts = texts if texts is not None else spark.createDataFrame([], "path string, text string")

    @classmethod
    def from_texts(cls, spark: SparkSession, texts: DataFrame) -> CodeGraph:
        """Extract, resolve imports, supertypes and calls, and open the result."""
        scratch = Scratch(spark, "graph")
        parsed = scratch.save(parse_files(texts), "parsed")
        graph = cls(spark, extracted_symbols(parsed).withColumn("indexed_at", F.lit(0)), extracted_edges(parsed), texts)
        graph.hashes = scratch.save(parsed.where("error is null").groupBy("path").agg(F.max("content_hash").alias("content_hash")), "hashes")
        graph.nodes = scratch.save(graph.nodes, "nodes")
        graph.edges = scratch.save(S.upsert_edges(extracted_edges(parsed), graph.nodes), "edges")
        graph.edges = scratch.save(R.resolved(graph.nodes, graph.edges, scratch), "resolved")
        return graph

    def updated(self, texts: DataFrame, events: DataFrame) -> CodeGraph:
        """The graph after ``events`` (path, removed, seq), with ``texts`` (path, text) as the files are now.

        Only files with an event are read. Removed files go; a file whose parse fails keeps its old rows, one with
        the same content hash is skipped; all others are replaced, and then everything is resolved again.
        """
        scratch = Scratch(self.spark, "update")
        last = scratch.save(S.collapse_events(events), "events")
        now = texts.join(last.where("not removed").select("path"), "path", "left_semi").groupBy("path").agg(F.max("text").alias("text"))
        parsed = scratch.save(parse_files(now), "parsed")
        runs = parsed.select("path", "content_hash", "error")
        actions = scratch.save(S.update_actions(self.hashes, runs, last), "actions")
        fresh = S.upsert_nodes(extracted_symbols(parsed).withColumn("indexed_at", F.lit(0)))
        nodes, edges = S.apply_update(self.nodes, self.edges, fresh, extracted_edges(parsed), actions)
        graph = CodeGraph(self.spark, nodes.withColumn("indexed_at", F.lit(0)), edges, None)
        graph.nodes = scratch.save(nodes, "nodes")
        graph.edges = scratch.save(R.resolved(graph.nodes, scratch.save(edges, "edges"), scratch), "resolved")
        graph.hashes = scratch.save(S.updated_hashes(self.hashes, runs, actions), "hashes")
        gone = actions.where("action in ('delete', 'replace')").select("path")
        graph.texts = self.texts.select("path", "text").join(gone, "path", "left_anti").unionByName(now.join(actions.where("action = 'replace'").select("path"), "path", "left_semi").select("path", "text"))
        return graph

    def _asked(self, names: Sequence[str | DataFrame]) -> DataFrame:
        """The names as rows (query); a frame among them stands for its first column."""
        plain = self.spark.createDataFrame([(n,) for n in names if isinstance(n, str)], "query string")
        for frame in names:
            if not isinstance(frame, str):
                plain = plain.unionByName(frame.select(F.col(frame.columns[0]).cast("string").alias("query")))
        return plain

    def _ids(self, names: Sequence[str | DataFrame], path: str | None = None) -> DataFrame:
        asked = self._asked(names)
        found = L.match_symbols(self.nodes.where("kind <> 'file'"), asked)
        if path:
            found = found.join(self.nodes.where(F.col("path") == path).select("id"), "id", "left_semi")
        return found

    def _files(self, paths: Sequence[str | DataFrame]) -> DataFrame:
        return self._asked(paths).withColumnRenamed("query", "id")

    def get_file_dependencies(self, *paths: str | DataFrame, depth: int = 1) -> DataFrame:
        """(path, id, direction): what the files import and who imports them; deeper than 1 follows the imports on."""
        files = self._files(paths).withColumnRenamed("id", "path")
        if depth > 1:
            imports = self.edges.where("kind = 'imports'")
            sides = [L.neighbours(imports, self._files(paths), direction=d, depth=depth).select(F.col("seed").alias("path"), "id", F.lit(n).alias("direction")) for d, n in (("out", "dependency"), ("in", "dependent"))]
            return sides[0].unionByName(sides[1])
        out = L.file_dependencies(self.nodes, self.edges).withColumn("direction", F.lit("dependency"))
        return out.unionByName(L.file_dependents(self.nodes, self.edges).withColumn("direction", F.lit("dependent"))).join(files, "path", "left_semi")

    def analyze_blast_radius(self, *changed: str | DataFrame, max_depth: int = 3) -> DataFrame:
        return X.blast_radius(self.edges, self._files(changed), max_depth)

    def prune_context(self, *prompts: str | DataFrame, token_budget: int = 8000, top_k: int = 20) -> DataFrame:
        """The context of each prompt; ``prompt_id`` is the prompt itself, which a number stands for until the end."""
        number = F.monotonically_increasing_id().cast("string").alias("prompt_id")
        scratch = Scratch(self.spark, "asked")
        asked = scratch.save(self._asked(prompts).distinct().select(number, F.col("query").alias("prompt")), "prompts")
        nodes = scratch.save(self.nodes.select("id", "name", "qualified_name", "path", "signature"), "nodes")
        found = V.prune_context(nodes, self.edges, V.symbol_vectors(nodes), asked, token_budget, top_k)
        scratch.drop(nodes)
        return found.join(asked, "prompt_id").withColumn("prompt_id", F.col("prompt")).select(*found.columns)

    def search_architecture_graph(self, *queries: str | DataFrame, limit: int = 20) -> DataFrame:
        return self.prune_context(*queries, token_budget=100_000, top_k=limit)

    def read_symbol(self, *names: str | DataFrame, path: str | None = None, most: int = 5) -> DataFrame:
        """(query, id, path, source) of up to ``most`` matches per name, by path and line."""
        found = self._ids(names, path)
        return V.budget_prefix(found.join(self.nodes.select("id", "path", "start_line"), "id").withColumn("cost", F.lit(1)), "query", ["path", "start_line", "id"], "cost", most).select("query", "id").join(L.read_symbol(self.nodes, self.texts), "id")

    def file_outline(self, *paths: str | DataFrame) -> DataFrame:
        return L.file_outline(self.nodes).join(self._files(paths).select(F.col("id").alias("path")).distinct(), "path", "left_semi").orderBy("path", "place")

    def repo_overview(self, hub_limit: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Counts, files per language and the hub files."""
        return L.overview(self.nodes), L.language_mix(self.nodes), L.hubs(self.nodes, self.edges, hub_limit)

    def get_callers(self, *names: str | DataFrame, path: str | None = None) -> DataFrame:
        return L.callers(self.nodes, self.edges).join(self._ids(names, path).withColumnRenamed("id", "dst_id"), "dst_id").orderBy("query", "path", "start_line", "src_id")

    def get_callees(self, *names: str | DataFrame, path: str | None = None) -> DataFrame:
        return L.callees(self.nodes, self.edges).join(self._ids(names, path).withColumnRenamed("id", "src_id"), "src_id").orderBy("query", "path", "start_line", "dst_id")

    def class_hierarchy(self, *names: str | DataFrame, path: str | None = None) -> DataFrame:
        """(query, class_id, id, name, path, direction) of direct supertypes and subtypes."""
        both = L.supertypes(self.nodes, self.edges).withColumn("direction", F.lit("supertype")).unionByName(L.subtypes(self.nodes, self.edges).withColumn("direction", F.lit("subtype")))
        return both.join(self._ids(names, path).withColumnRenamed("id", "class_id"), "class_id")

    def analyze_symbol_impact(self, *names: str | DataFrame, path: str | None = None, max_depth: int = 4) -> DataFrame:
        return X.symbol_impact(self.nodes, self.edges, self._ids(names, path).select("id"), max_depth)

    def analyze_impacted_symbols(self, *changed: str | DataFrame) -> DataFrame:
        """(path, id, qualified_name) of what the changed files define."""
        return X.impacted_symbols(self.nodes, self._files(changed).withColumnRenamed("id", "path"))

    def query(self, sql: str, **args) -> DataFrame:
        """SQL over ``{symbols}`` and ``{edges}`` with named parameters."""
        return self.spark.sql(sql, args=args, symbols=self.nodes, edges=self.edges)
