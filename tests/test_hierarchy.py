"""Merge trees: ancestors by doubling pointers are those that spotlights keep."""

from lacewing.operators import pooling
from lacewing.sources import collections as src

SF = "/root/testdata/sf0.001"


def test_ancestors_are_the_spotlights(spark):
    e = src.event_week(spark, SF)
    levels = pooling.pool(e, 3)
    assert len(levels) == 3
    tree = pooling.merge_tree(levels).cache()
    top = {(r.graph_id, r.node): r.top for r in pooling.ancestors(tree, 3).filter("level = 0").collect()}
    assert top == {(r.graph_id, r.base): r.node for r in levels[-1]["spot"].collect()}
    nodes, links = pooling.hierarchy(e, levels)
    # a tree: every node but the top has one link to the level above
    assert links.filter("merge").count() == nodes.filter("level < 3").count() == tree.filter("parent is not null").count()
