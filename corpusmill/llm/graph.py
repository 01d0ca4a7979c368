"""Connected components of a link table: union-find within each partition, then large-star and small-star steps in turn."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stored


#: Rows of small tables that one task works on: their partitions follow their size, whatever the session's number.
ROWS_A_TASK = 100_000
#: Nodes that a task's union-find holds; beyond, it hands on what it has and begins anew, and the steps join the parts.
HELD = 1_000_000


def tasks(n: int) -> int:
    """Partitions for a table that holds at most n rows."""
    return max(1, -(-n // ROWS_A_TASK))


def forests(links: DataFrame, held: int = HELD) -> DataFrame:
    """Rows (node, root) for every node of each partition's links (a, b): the smallest node that those reach from it."""
    kind = links.schema["a"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):  # noqa: ANN001, ANN202
            above.setdefault(x, x)
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        def rows() -> Iterator[pa.RecordBatch]:
            nodes = list(above)
            for i in range(0, len(nodes), ROWS_A_TASK):
                some = nodes[i : i + ROWS_A_TASK]
                yield pa.RecordBatch.from_arrays([pa.array(some, arrow.field(0).type), pa.array([top(x) for x in some], arrow.field(1).type)], schema=arrow)

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = top(a), top(b)
                above[max(a, b)] = min(a, b)
            if len(above) >= held:
                yield from rows()
                above.clear()
        yield from rows()

    return links.select("a", "b").mapInArrow(run, schema)


def components(links: DataFrame, n_links: int, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of the links (a, b): the smallest node that links reach from it.

    Links that fit one task are done with its union-find. Of more, each task's links are first made stars, which the
    steps then join.

    Each step groups by node with a map-side minimum and joins it back; no list of neighbours is ever collected. The join
    deals a node's links to one partition, which adaptive execution splits where it is skewed, as the other side has a row
    a node. It ends when a pass changes nothing, and raises if rounds run out first. No step makes more than twice n_links
    rows, which sets the number of tasks.
    """
    k = tasks(2 * n_links)
    own = stored(forests(links.where("a != b").coalesce(k)))
    if k == 1:
        return own
    edges = own.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(k)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").coalesce(k)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").coalesce(k)
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = stored(small.coalesce(k).distinct().coalesce(k))
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).coalesce(k)
