"""Ready-made graph predicates: rule texts that functors instantiate."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Closure, one edge a round: the work of a round is new pairs times a node's edges.
CLOSURE = """
@Recursive(ClosureOf, -1);
ClosureOf(x, y) distinct :- Graph(x, y);
ClosureOf(x, z) distinct :- ClosureOf(x, y), Graph(y, z);
"""

#: Closure by doubling: rounds are logarithmic in the longest path, but pairs meet pairs.
CLOSURE_BY_DOUBLING = """
@Recursive(ClosureOf, -1);
ClosureOf(x, y) distinct :- Graph(x, y);
ClosureOf(x, z) distinct :- ClosureOf(x, y), ClosureOf(y, z);
"""

#: Least number of steps between nodes.
DISTANCE = """
@Recursive(DistanceOf, -1);
DistanceOf(x, y) Min= 1 :- Graph(x, y), x != y;
DistanceOf(x, z) Min= DistanceOf(x, y) + 1 :- Graph(y, z), x != z;
"""

#: Pairs at the same depth below a common ancestor; Parent(child, parent).
SAME_GENERATION = """
@Recursive(SameGenerationOf, -1);
SameGenerationOf(x, y) distinct :- Parent(x, p), Parent(y, p);
SameGenerationOf(x, y) distinct :- Parent(x, a), SameGenerationOf(a, b), Parent(y, b);
"""

#: Component of every node, named by its least member, links taken both ways.
COMPONENTS = """
Linked(x, y) distinct :- Graph(x, y);
Linked(y, x) distinct :- Graph(x, y);
@Recursive(ComponentOf, -1);
ComponentOf(x) Min= x :- Linked(x, y);
ComponentOf(y) Min= ComponentOf(x) :- Linked(x, y);
"""

#: A shortest path as a list of nodes, by length, then by the nodes.
PATHS = DISTANCE + """
@Recursive(PathOf, -1);
PathOf(x, y) Min= [x, y] :- Graph(x, y), x != y;
PathOf(x, z) Min= PathOf(x, y) ++ [z] :- Graph(y, z), DistanceOf(x, z) == DistanceOf(x, y) + 1, DistanceOf(x, z) > 1;
"""


def _over(text: str, name: str, table: str, df: DataFrame) -> DataFrame:
    from ruleloom import Program

    a, b = df.columns[:2]
    return Program(text, df.sparkSession, tables={table: df.toDF(*df.columns).selectExpr(f"`{a}` as col0", f"`{b}` as col1")}).df(name)


def transitive_closure(edges: DataFrame, doubling: bool = False) -> DataFrame:
    """``(col0, col1)`` for all nodes joined by a path of one edge or more.

    ``doubling`` suits sparse graphs with long paths.
    """
    return _over(CLOSURE_BY_DOUBLING if doubling else CLOSURE, "ClosureOf", "Graph", edges)


def distances(edges: DataFrame) -> DataFrame:
    """``(col0, col1, value)``: least number of steps."""
    return _over(DISTANCE, "DistanceOf", "Graph", edges)


def same_generation(parents: DataFrame) -> DataFrame:
    """``(col0, col1)`` from ``(child, parent)`` rows."""
    return _over(SAME_GENERATION, "SameGenerationOf", "Parent", parents)


def components(edges: DataFrame) -> DataFrame:
    """``(col0, value)``: the least node of each node's component."""
    return _over(COMPONENTS, "ComponentOf", "Graph", edges)


def shortest_paths(edges: DataFrame) -> DataFrame:
    """``(col0, col1, value)``: one shortest path for every connected pair."""
    return _over(PATHS, "PathOf", "Graph", edges)
