"""G area queries: graph build, reachability, components, levels, order."""

from corvid.operators import graph as G
from corvid.plans import views
from corvid.plans.catalog import register

_GE = views.GRAPH_EDGES_SQL


def _graph(spark, d):
    e = views.graph_edges(spark, d).checkpoint()
    return views.graph_nodes(e), e


@register("g2_build_graph", "G", oracle=f"""
WITH {_GE}
SELECT n.n,
       (SELECT count(*) FROM graph_edges e WHERE e.src = n.n) AS out_degree,
       (SELECT count(*) FROM graph_edges e WHERE e.dst = n.n) AS in_degree
FROM graph_nodes n""")
def g2(spark, d):
    nodes, edges = _graph(spark, d)
    return G.degrees(nodes, edges)


@register("g3_reachable", "G", oracle=f"""
WITH RECURSIVE {_GE},
r(n, depth) AS (SELECT '{views.GRAPH_ROOT}', 0
                UNION SELECT e.dst, r.depth + 1 FROM r JOIN graph_edges e ON e.src = r.n)
SELECT n, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY n""")
def g3(spark, d):
    nodes, edges = _graph(spark, d)
    return G.reachable(nodes, edges, views.GRAPH_ROOT)


@register("g4_weak_components", "G", oracle=f"""
WITH RECURSIVE {_GE},
und AS (SELECT src AS a, dst AS b FROM graph_edges UNION SELECT dst, src FROM graph_edges),
reach(n, m) AS (SELECT n, n FROM graph_nodes UNION SELECT r.n, u.b FROM reach r JOIN und u ON u.a = r.m)
SELECT n, min(m) AS label FROM reach GROUP BY n""")
def g4(spark, d):
    nodes, edges = _graph(spark, d)
    return G.weak_components(nodes, edges)


@register("g4_giant_component", "G", oracle=f"""
WITH {views.GIANT_SQL},
own AS (SELECT o_custkey AS k, least('c' || o_custkey, min('o' || o_orderkey)) AS label
        FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey),
joined AS (SELECT min(n) AS label FROM giant_nodes WHERE k IS NULL OR k NOT IN (SELECT k FROM own))
SELECT g.n, coalesce(own.label, joined.label) AS label FROM giant_nodes g LEFT JOIN own ON g.k = own.k, joined""")
def g4_giant(spark, d):
    """G4 on one component of all orders, customers, nations and regions."""
    nodes, edges = views.giant_graph(spark, d)
    return G.weak_components(nodes, edges)


_LEVELS_SQL = f"""{_GE},
h(n, lvl) AS (SELECT n, 0 FROM graph_nodes WHERE n NOT IN (SELECT src FROM graph_edges)
              UNION SELECT e.src, h.lvl + 1 FROM h JOIN graph_edges e ON e.dst = h.n),
levels AS (SELECT n, CAST(max(lvl) AS INTEGER) AS level FROM h GROUP BY n)"""


@register("g5_levels_callee_first", "G", oracle=f"""
WITH RECURSIVE {_LEVELS_SQL}
SELECT n, level FROM levels""")
def g5(spark, d):
    nodes, edges = _graph(spark, d)
    return G.levels_callee_first(nodes, edges)


@register("g1_callee_first_order", "G", oracle=f"""
WITH RECURSIVE {_LEVELS_SQL}
SELECT n, level, row_number() OVER (ORDER BY level, n) - 1 AS position FROM levels""")
def g1(spark, d):
    nodes, edges = _graph(spark, d)
    return G.callee_first_order(G.levels_callee_first(nodes, edges))
