"""Links between documents to classes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.graph import components


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, root), root being the least node reachable.

    Nodes without a link do not appear. Self links, repeated links and null ends are ignored; an empty
    table gives an empty one. Neither links nor classes ever reach the driver.
    """
    return components(edges, "u", "v")
