"""The registered queries in SQL, each solved by other means than the library's: joins and recursion over all scales apart."""

from __future__ import annotations

from chronocore.operators.sweep import FACTORS, MODULUS
from chronocore.plans.queries import BATCH, DELTA, DMAX, HOUR, LEVEL, WIDE

_DAY = "date_diff('day', DATE '1970-01-01', {}::DATE)::BIGINT"
_SUPPLIER = f"raw AS (SELECT DISTINCT l_suppkey::BIGINT AS u, 1000000000 + l_partkey::BIGINT AS v, {_DAY.format('l_shipdate')} AS t FROM lineitem)"
_CUSTOMER = f"raw AS (SELECT DISTINCT o_custkey::BIGINT AS u, 1000000000 + l_suppkey::BIGINT AS v, {_DAY.format('o_orderdate')} AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
_EVENT = "raw AS (SELECT DISTINCT user_id::BIGINT AS u, 10000000000 + unicode(event_type)::BIGINT * 1000 + length(event_type) AS v, floor(epoch_us(ts) / 60000000)::BIGINT AS t FROM events)"
_SIDES = """edges AS (SELECT row_number() OVER (ORDER BY t, u, v) - 1 AS e, u, v, t FROM raw),
sides AS (SELECT e, 0::BIGINT AS s, u AS x, t FROM edges UNION ALL SELECT e, 1::BIGINT, v, t FROM edges)"""


def _graph(raw: str = _SUPPLIER, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{raw},\n{_SIDES}"


def _core(scales: str, reach: int) -> str:
    """core(d, e, c): the downward fixpoint of h-indexes, at each scale of ``scales`` apart.

    An edge alone in a window has 1 and adds to no h-index over 1, so rounds go over the others and leave out what falls to 1;
    a scale in which nothing has changed is done.
    """
    return f""",
scales AS ({scales}),
nb AS (SELECT a.e, a.s, b.e AS f, abs(a.t - b.t) AS gap FROM sides a JOIN sides b ON a.x = b.x AND abs(a.t - b.t) <= {reach}),
it AS (
  SELECT 0 AS i, d, e, min(n) AS c, 1 AS ch FROM (SELECT d, e, s, count(*) AS n FROM nb JOIN scales ON gap <= d GROUP BY d, e, s) GROUP BY d, e HAVING min(n) >= 2
  UNION ALL
  SELECT i, d, e, h, ch FROM (
    SELECT i, d, e, h, max(CASE WHEN h < c THEN 1 ELSE 0 END) OVER (PARTITION BY d) AS ch FROM (
      SELECT i, d, e, min(h) AS h, any_value(own) AS c FROM (
        SELECT i, d, e, s, own, count(*) FILTER (c >= rn) AS h FROM (
          SELECT o.i + 1 AS i, o.d, nb.e, nb.s, o.c AS own, n.c, row_number() OVER (PARTITION BY o.d, nb.e, nb.s ORDER BY n.c DESC) AS rn
          FROM it o JOIN nb ON o.e = nb.e AND nb.gap <= o.d JOIN it n ON n.e = nb.f AND n.d = o.d WHERE o.ch = 1)
        GROUP BY i, d, e, s, own) GROUP BY i, d, e)) WHERE h >= 2),
core AS (SELECT scales.d, edges.e, coalesce(c, 1) AS c FROM edges CROSS JOIN scales LEFT JOIN (SELECT d, e, c FROM it WHERE ch = 0) f ON f.d = scales.d AND f.e = edges.e)"""


_ALL = _core(f"SELECT unnest(range(0, {DMAX + 1})) AS d", DMAX)


def _at(delta: int) -> str:
    return _core(f"SELECT {delta}::BIGINT AS d", delta)


def _onsets() -> str:
    """onsets(k, e, delta)."""
    return """,
ks AS (SELECT unnest(range(1, (SELECT max(c) FROM core) + 1)) AS k),
onsets AS (SELECT k, e, min(d) AS delta FROM core, ks WHERE c >= k GROUP BY k, e)"""


_STEPS = """,
steps AS (SELECT e, d, c, lag(c) OVER (PARTITION BY e ORDER BY d) AS before FROM core),
bp AS (SELECT e, d AS delta, c AS value, before FROM steps WHERE before < c)"""

_DIRECTORY = "SELECT e, min(c) AS base, max(c) AS top FROM core GROUP BY e"


def _links(k: int, delta: int, core: str) -> str:
    """links(a, b) and act(e)."""
    return f"""{core},
act AS (SELECT e FROM core WHERE d = {delta} AND c >= {k}),
near AS (SELECT e, t, lag(e) OVER w AS a, lag(t) OVER w AS before FROM sides JOIN act USING (e) WINDOW w AS (PARTITION BY x ORDER BY t, e)),
links AS (SELECT DISTINCT a, e AS b FROM near WHERE t - before <= {delta})"""


_PARTS = """,
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
cc AS (
  SELECT 0 AS i, e, e AS l, 1 AS ch FROM act
  UNION ALL
  SELECT i, e, n, max(CASE WHEN n < l THEN 1 ELSE 0 END) OVER () FROM (
    SELECT o.i + 1 AS i, o.e, any_value(o.l) AS l, least(any_value(o.l), coalesce(min(n.l), any_value(o.l))) AS n
    FROM cc o LEFT JOIN both_ways ON a = o.e LEFT JOIN cc n ON n.e = b WHERE o.ch = 1 GROUP BY o.i, o.e)),
parts AS (SELECT e, l AS community FROM cc WHERE i = (SELECT max(i) FROM cc))"""


def oracle_sql() -> dict[str, str]:
    whole, rec = _graph(), _graph(recursive=True)
    degree = "SELECT e, min(n) AS degree FROM (SELECT e, s, count(*) OVER (PARTITION BY x ORDER BY t RANGE BETWEEN {d} PRECEDING AND {d} FOLLOWING) AS n FROM sides) GROUP BY e"
    one = f"SELECT e FROM parts WHERE community = (SELECT community FROM parts WHERE e = (SELECT min(e) FROM act))"
    small = _links(LEVEL, DMAX, rec + _ALL) + _PARTS
    wide = _links(LEVEL, WIDE, rec + _at(WIDE)) + _PARTS
    lists = "SELECT e, '0' || coalesce(string_agg(',' || delta, '' ORDER BY delta), '') AS deltas, (SELECT min(c) FROM core WHERE core.e = edges.e) || coalesce(string_agg(',' || value, '' ORDER BY delta), '') AS values FROM edges LEFT JOIN bp USING (e) GROUP BY e"
    named = f"{rec}{_ALL} SELECT e, u, v, t, base, top FROM edges JOIN ({_DIRECTORY}) USING (e)"
    a, b = FACTORS
    drawn = f"q AS (SELECT (i * {a} + {b}) % {MODULUS} % (SELECT max(e) + 1 FROM edges) AS e, (i * {b} + {a}) % {MODULUS} AS y FROM range(0, {BATCH}) r(i))"
    return {
        "graph_edges": f"{whole} SELECT e, u, v, t FROM edges",
        "text_edge_list": f"{whole} SELECT e, u, v, t FROM edges",
        "graph_sides": f"{whole} SELECT e, s, x, t FROM sides",
        "nodes_first_seen": "WITH l AS (SELECT l_orderkey * 100 + l_linenumber AS line, l_suppkey AS u, l_partkey + 1000000000 AS v FROM lineitem), n AS (SELECT u AS raw, line * 2 AS p FROM l UNION ALL SELECT v, line * 2 + 1 FROM l) SELECT raw, row_number() OVER (ORDER BY min(p), raw) - 1 AS x FROM n GROUP BY raw",
        "window_degrees": f"{whole} {degree.format(d=WIDE)}",
        "window_degrees_hub": f"{_graph(_EVENT)} {degree.format(d=HOUR)}",
        "h_round": f"""{whole}, deg AS ({degree.format(d=DELTA)}),
n AS (SELECT a.e, a.s, degree, row_number() OVER (PARTITION BY a.e, a.s ORDER BY degree DESC) AS rn FROM sides a JOIN sides b ON a.x = b.x AND abs(a.t - b.t) <= {DELTA} JOIN deg ON deg.e = b.e)
SELECT e, min(h) AS h FROM (SELECT e, s, count(*) FILTER (degree >= rn) AS h FROM n GROUP BY e, s) GROUP BY e""",
        "critical_radii": f"{whole} SELECT DISTINCT b.t - a.t AS delta FROM sides a JOIN sides b ON a.x = b.x AND b.t - a.t BETWEEN 1 AND {WIDE}",
        "graph_statistics": f"{whole}, v AS (SELECT x, count(*) AS degree, max(t) - min(t) AS span FROM sides GROUP BY x) SELECT (SELECT count(*) FROM edges) AS edges, (SELECT max(t) - min(t) FROM edges) AS span, (SELECT count(*) FROM v) AS nodes, (SELECT max(degree) FROM v) AS max_degree, (SELECT max(span) FROM v) AS max_vertex_span",
        "core_numbers": f"{rec}{_at(DELTA)} SELECT e, c FROM core",
        "core_numbers_wide": f"{rec}{_at(WIDE)} SELECT e, c FROM core",
        "core_numbers_customers": f"{_graph(_CUSTOMER, True)}{_at(DELTA)} SELECT e, c FROM core",
        "static_core": f"""{rec},
nb AS (SELECT a.x, b.x AS y, a.e FROM sides a JOIN sides b ON a.e = b.e AND a.s <> b.s),
it AS (
  SELECT 0 AS i, x, 1000000000::BIGINT AS c, 1 AS ch FROM (SELECT DISTINCT x FROM sides)
  UNION ALL
  SELECT i, x, h, max(CASE WHEN h < c THEN 1 ELSE 0 END) OVER () FROM (
    SELECT i, x, any_value(own) AS c, count(*) FILTER (c >= rn) AS h FROM (
      SELECT o.i + 1 AS i, o.x, o.c AS own, n.c, row_number() OVER (PARTITION BY o.x ORDER BY n.c DESC) AS rn FROM it o JOIN nb ON nb.x = o.x JOIN it n ON n.x = nb.y WHERE o.ch = 1)
    GROUP BY i, x)),
kappa AS (SELECT x, c FROM it WHERE i = (SELECT max(i) FROM it))
SELECT e, min(c) AS c FROM sides JOIN kappa USING (x) GROUP BY e""",
        "index_directory": f"{rec}{_ALL} {_DIRECTORY}",
        "index_breakpoints": f"{rec}{_ALL}{_STEPS} SELECT e, delta, value, (SELECT sum(c) FROM core WHERE core.e = bp.e AND d < delta)::BIGINT AS prefix FROM bp",
        "index_drops": f"{rec}{_ALL}{_STEPS} SELECT delta - 1 AS delta_below, e, before AS value_below FROM bp",
        "index_from_drops": f"{rec}{_ALL}{_STEPS} {lists}",
        "query_point": f"{rec}{_ALL} SELECT e, d AS delta, c FROM core WHERE d = e % {DMAX + 1}",
        "query_onset": f"{rec}{_ALL}, q AS (SELECT e, e % 3 + 1 AS k FROM edges) SELECT e, k, coalesce((SELECT min(d) FROM core WHERE core.e = q.e AND c >= k), -1) AS delta FROM q",
        "query_area": f"{rec}{_ALL} SELECT e, e % 2 AS a, {DMAX + 1}::BIGINT AS b, sum(c) FILTER (d >= e % 2)::BIGINT AS area FROM core GROUP BY e",
        "query_snapshot": f"{rec}{_ALL} SELECT e, c FROM core WHERE d = {DMAX}",
        "query_point_batch": f"{rec}{_ALL}, {drawn} SELECT q.e, y % {DMAX + 1} AS delta, c FROM q JOIN core ON core.e = q.e AND d = y % {DMAX + 1}",
        "query_onset_batch": f"{rec}{_ALL}, {drawn} SELECT e, y % 3 + 1 AS k, coalesce((SELECT min(d) FROM core WHERE core.e = q.e AND c >= y % 3 + 1), -1) AS delta FROM q",
        "level_sets": f"{rec}{_ALL}{_onsets()} SELECT k, e, delta FROM onsets",
        "level_sizes": f"{rec}{_ALL}{_onsets()} SELECT k, count(*) AS n FROM onsets GROUP BY k",
        "active_edges": f"{rec}{_ALL} SELECT e FROM core WHERE d = {DMAX} AND c >= {LEVEL}",
        "community_links": f"{_links(1, DMAX, rec + _ALL)} SELECT a, b FROM links",
        "community_labels": f"{wide} SELECT e, community FROM parts",
        "community_sizes": f"{wide} SELECT community, count(*) AS size FROM parts GROUP BY community",
        "community_of_edge": f"{small} {one}",
        "pairs_communities": f"{small} SELECT e, community FROM parts",
        "pairs_community_of_edge": f"{small} {one}",
        "forest_community_of_edge": f"{small} {one}",
        "merge_candidates": f"""{rec}{_ALL}{_onsets()},
o AS (SELECT k, x, t, e, delta, row_number() OVER (PARTITION BY k, x ORDER BY t, e) AS i FROM onsets JOIN sides USING (e)),
early AS (SELECT p.k, p.x, p.i, max(q.i) AS j FROM o p JOIN o q ON p.k = q.k AND p.x = q.x AND q.i < p.i AND q.delta <= p.delta GROUP BY ALL),
late AS (SELECT p.k, p.x, p.i, min(q.i) AS j FROM o p JOIN o q ON p.k = q.k AND p.x = q.x AND q.i > p.i AND q.delta <= p.delta GROUP BY ALL),
both_ways AS (SELECT * FROM early UNION ALL SELECT * FROM late)
SELECT DISTINCT k, greatest(p.delta, q.delta, abs(p.t - q.t)) AS w, least(p.e, q.e) AS a, greatest(p.e, q.e) AS b
FROM both_ways n JOIN o p USING (k, x, i) JOIN o q ON q.k = n.k AND q.x = n.x AND q.i = n.j""",
        "text_index": named,
        "parquet_index": named,
        "drop_log_faults": "SELECT NULL::BIGINT AS e, NULL::VARCHAR AS fault WHERE false",
    }
