"""Directed graphs: vertices (id, properties) and edges (source, dest, properties)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError


def last_of(rows: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else rows.distinct()


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def faults(self) -> DataFrame:
        """(fault, id, other): unset or repeated vertex ids, edges without a source or target, repeated edges."""
        v, e = self.vertices, self.edges
        row = lambda df, what, a, b="null": df.select(F.lit(what).alias("fault"), F.expr(a).cast("long").alias("id"), F.expr(b).cast("long").alias("other"))
        ids = v.select("id").distinct()
        parts = [
            row(v.where("id IS NULL OR id = 0"), "vertex id unset", "id"),
            row(v.groupBy("id").count().where("count > 1"), "vertex id repeated", "id"),
            row(e.join(ids, e["source"] == ids["id"], "left_anti"), "edge without source", "source", "dest"),
            row(e.join(ids, e["dest"] == ids["id"], "left_anti"), "edge without target", "source", "dest"),
            row(e.groupBy("source", "dest").count().where("count > 1"), "edge repeated", "source", "dest"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def checked(self) -> Graph:
        if bad := self.faults().head(1):
            raise GraphError(f"{bad[0]['fault']}: {bad[0]['id']}, {bad[0]['other']}")
        return self

    def upsert_vertices(self, rows: DataFrame) -> Graph:
        """Vertices by id: those known are replaced, others are new; of repeated ids the row that sorts last stays."""
        rows = last_of(rows, "id")
        kept = self.vertices.join(rows.select("id"), "id", "left_anti")
        return Graph(kept.unionByName(rows, allowMissingColumns=True), self.edges)

    def upsert_edges(self, rows: DataFrame) -> Graph:
        """Edges by (source, dest); of repeated ones the row that sorts last stays."""
        rows = last_of(rows, "source", "dest")
        kept = self.edges.join(rows.select("source", "dest"), ["source", "dest"], "left_anti")
        return Graph(self.vertices, kept.unionByName(rows, allowMissingColumns=True))

    def rename_vertex(self, old: int, new: int) -> Graph:
        """Another id for a vertex; its edges follow."""
        swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)).cast("long").alias(c)
        pick = lambda df, *names: df.select(*[swap(c) if c in names else F.col(c) for c in df.columns])
        return Graph(pick(self.vertices, "id"), pick(self.edges, "source", "dest"))

    def vertex(self, id_: int) -> dict | None:
        found = self.vertices.where(F.col("id") == id_).head(1)
        return found[0].asDict() if found else None

    def edge(self, source: int, dest: int) -> dict | None:
        found = self.edges.where((F.col("source") == source) & (F.col("dest") == dest)).head(1)
        return found[0].asDict() if found else None

    def degrees(self) -> DataFrame:
        """id, out_degree and in_degree of every vertex."""
        ends = self.edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(self.edges.select(F.col("dest").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        counted = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return self.vertices.select("id").join(counted, "id", "left").select("id", zero("out_degree"), zero("in_degree"))

    def lookup(self, edges: DataFrame, properties: dict[str, str]) -> DataFrame:
        """Edges with properties of their target's vertex, as {new name: property}."""
        v = self.vertices.select(F.col("id").alias("dest"), *[F.col(p).alias(n) for n, p in properties.items()])
        return edges.join(v, "dest", "left")

    def resized(self, vertices: int, edges: int) -> Graph:
        """Storage of these counts, reset: vertices without an id (0) and edges without ends, other values at 0."""
        spark = self.vertices.sparkSession

        def blank(df: DataFrame, n: int, keys: tuple[str, ...]) -> DataFrame:
            zero = lambda f: F.array().cast(f.dataType) if f.dataType.typeName() == "array" else F.lit(0).cast(f.dataType)
            return spark.range(n).select(*[(F.lit(0).cast("long") if f.name in keys else zero(f)).alias(f.name) for f in df.schema.fields])

        return Graph(blank(self.vertices, vertices, ("id",)), blank(self.edges, edges, ("source", "dest")))

    def counts(self) -> tuple[int, int]:
        return self.vertices.count(), self.edges.count()
