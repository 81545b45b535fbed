"""Association between feature columns and with the label."""

from __future__ import annotations

from tallyrow.catalog.base import PLAN, query, rounded, rows, with_base
from tallyrow.operators import pairs
from tallyrow.plans.features import IntFeature

_USER = [f.column for f in PLAN.user_int]
_ITEM = [f.column for f in PLAN.item_int]
_CAP = 128

# user_int_feats_2 has more than 128 values and is hashed; the others are ranked densely.
_CODES = """, codes AS (SELECT
  dense_rank() OVER (ORDER BY user_int_feats_1) - 1 AS user_int_feats_1,
  CASE WHEN user_int_feats_2 > 0 THEN (user_int_feats_2 - 1) % 127 + 1 ELSE 0 END AS user_int_feats_2,
  dense_rank() OVER (ORDER BY CASE WHEN user_int_feats_3[1] > 0 THEN user_int_feats_3[1] ELSE 0 END) - 1 AS user_int_feats_3,
  dense_rank() OVER (ORDER BY item_int_feats_11) - 1 AS item_int_feats_11,
  dense_rank() OVER (ORDER BY item_int_feats_12) - 1 AS item_int_feats_12, y AS label FROM impressions),
sizes AS (SELECT max(user_int_feats_1) + 1 AS user_int_feats_1, CAST(128 AS BIGINT) AS user_int_feats_2,
  max(user_int_feats_3) + 1 AS user_int_feats_3, max(item_int_feats_11) + 1 AS item_int_feats_11,
  max(item_int_feats_12) + 1 AS item_int_feats_12, CAST(2 AS BIGINT) AS label FROM codes)"""


def _cells(found) -> str:
    return ", cells AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS BIGINT) AS code_a, CAST({b} AS BIGINT) AS code_b, count(*) AS n "
        f"FROM codes GROUP BY ALL"
        for a, b in found
    ) + ")"


def _dims(found) -> str:
    return ", dims AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS BIGINT) AS v_a, CAST({b} AS BIGINT) AS v_b FROM sizes" for a, b in found
    ) + ")"


# Straight from the definition, empty cells included: sum of (O - E)² / E over the full table.
_STATS = """, tot AS (SELECT a, b, sum(n)::DOUBLE AS t FROM cells GROUP BY 1, 2),
ra AS (SELECT a, b, code_a, sum(n)::DOUBLE AS ra FROM cells GROUP BY 1, 2, 3),
rb AS (SELECT a, b, code_b, sum(n)::DOUBLE AS rb FROM cells GROUP BY 1, 2, 3),
grid AS (SELECT ra.a, ra.b, ra, rb, t, coalesce(n, 0)::DOUBLE AS o FROM ra JOIN rb USING (a, b) JOIN tot USING (a, b)
  LEFT JOIN cells c ON c.a = ra.a AND c.b = ra.b AND c.code_a = ra.code_a AND c.code_b = rb.code_b),
stats AS (SELECT a, b, any_value(t) AS t, sum((o - ra * rb / t) * (o - ra * rb / t) / (ra * rb / t)) AS chi2,
  sum(CASE WHEN o > 0 THEN o / t * ln(o * t / (ra * rb)) ELSE 0 END) AS mi FROM grid GROUP BY 1, 2),
v AS (SELECT a, b, v_a, v_b, CAST(t AS BIGINT) AS n_rows, round(sqrt(chi2 / (t * greatest(least(v_a, v_b) - 1, 1))), 6) AS cramers_v, round(mi, 6) AS mi
  FROM stats JOIN dims USING (a, b))"""

_UU = pairs.user_user_pairs(_USER)
_UI = [(a, b) for a in _USER for b in _ITEM]
_LABEL = [(c, "label") for c in _USER + _ITEM]


@query("contingency", with_base(_CODES + _cells(_UI) + " SELECT * FROM cells"))
def _(spark, sf):
    coded, _sizes, _folded = pairs.encoded(rows(spark, sf), PLAN.int_features(), _CAP)
    return pairs.contingency(coded, _UI)


def _measured(spark, sf, found):
    coded, sizes, _folded = pairs.encoded(rows(spark, sf), PLAN.int_features(), _CAP)
    return pairs.association(pairs.contingency(coded, found), sizes)


@query(
    "cramers_v",
    with_base(_CODES + _cells(_UU + _UI) + _dims(_UU + _UI) + _STATS + " SELECT a, b, v_a, v_b, cramers_v FROM v"),
)
def _(spark, sf):
    return rounded(_measured(spark, sf, _UU + _UI), "cramers_v").select("a", "b", "v_a", "v_b", "cramers_v")


@query(
    "mutual_info",
    with_base(_CODES + _cells(_UU + _UI) + _dims(_UU + _UI) + _STATS + " SELECT a, b, n_rows, mi FROM v"),
)
def _(spark, sf):
    return rounded(_measured(spark, sf, _UU + _UI), "mi").select("a", "b", "n_rows", "mi")


def _pairwise(name: str, found) -> None:
    @query(
        name,
        with_base(_CODES + _cells(found) + _dims(found) + _STATS + " SELECT *, 'user_int_feats_2' IN (a, b) AS folded FROM v ORDER BY cramers_v DESC, a, b LIMIT 50"),
    )
    def _(spark, sf):
        return rounded(pairs.pairwise(rows(spark, sf), PLAN.int_features(), found, _CAP), "cramers_v", "mi")


_pairwise("pairwise_user_user", _UU)
_pairwise("pairwise_user_item", _UI)


@query(
    "label_mi",
    with_base(_CODES + _cells(_LABEL) + _dims(_LABEL) + _STATS + " SELECT a AS column_name, v_a AS v, mi FROM v"),
)
def _(spark, sf):
    return rounded(pairs.label_mi(rows(spark, sf), PLAN.int_features(), _CAP), "mi")


# As many columns as the impression tables have that this is made for: 46 of users, 14 of items.
_WIDE = [("user_int", fid, 3 + fid % 7) for fid in range(101, 147)] + [("item_int", fid, 4 + fid % 5) for fid in range(201, 215)]


def _wide_column(section: str, fid: int, size: int) -> str:
    source = "user_id" if section == "user_int" else "item_id"
    return f"({source} * {2 * fid + 1} + event_id * (event_id % {fid % 11 + 2})) % {size}"


def _wide(spark, sf):
    table = rows(spark, sf).selectExpr("label_type", *[f"{_wide_column(s, f, n)} AS {s}_feats_{f}" for s, f, n in _WIDE])
    return table, [IntFeature(s, f) for s, f, _ in _WIDE]


_WIDE_SQL = (
    ", long AS ("
    + " UNION ALL ".join(f"SELECT event_id, y, '{s}' AS s, {i} AS i, '{s}_feats_{f}' AS c, {_wide_column(s, f, n)} AS v FROM impressions" for i, (s, f, n) in enumerate(_WIDE))
    + """), sizes AS (SELECT c, count(DISTINCT v) AS size FROM long GROUP BY c),
ones AS (SELECT c, v, count(*)::DOUBLE AS n FROM long GROUP BY c, v)"""
)
_WIDE_STATS = """, t AS (SELECT count(*)::DOUBLE AS t FROM impressions),
m AS (SELECT cells.a, cells.b, sum(cells.n * cells.n / (p.n * q.n)) AS ratio, sum(cells.n / t * ln(cells.n * t / (p.n * q.n))) AS mi
  FROM cells JOIN ones p ON p.c = cells.a AND p.v = cells.va JOIN {other} q ON q.c = cells.b AND q.v = cells.vb, t GROUP BY 1, 2)"""


@query(
    "pairwise_wide",
    with_base(
        _WIDE_SQL
        + """, cells AS (SELECT x.c AS a, y.c AS b, x.v AS va, y.v AS vb, count(*)::DOUBLE AS n FROM long x JOIN long y ON x.event_id = y.event_id
  WHERE x.s = 'user_int' AND ((y.s = 'user_int' AND x.i < y.i) OR y.s = 'item_int') GROUP BY ALL)"""
        + _WIDE_STATS.format(other="ones")
        + """ SELECT a, b, p.size AS v_a, q.size AS v_b, CAST(t AS BIGINT) AS n_rows, round(sqrt(greatest(ratio - 1, 0) / greatest(least(p.size, q.size) - 1, 1)), 6) AS cramers_v,
  round(mi, 6) AS mi FROM m JOIN sizes p ON p.c = a JOIN sizes q ON q.c = b, t"""
    ),
)
def _(spark, sf):
    """All 1,035 pairs of user columns and 644 of a user and an item column, counted in one pass over the codes."""
    table, features = _wide(spark, sf)
    user, item = ([f.column for f in features if f.column.startswith(s)] for s in ("user", "item"))
    found = pairs.user_user_pairs(user) + [(a, b) for a in user for b in item]
    coded, sizes, _folded = pairs.encoded(table, features, _CAP)
    return rounded(pairs.association(pairs.contingency(coded, found), sizes), "cramers_v", "mi")


@query(
    "label_mi_wide",
    with_base(
        _WIDE_SQL
        + """, labels_ AS (SELECT 'y' AS c, y AS v, count(*)::DOUBLE AS n FROM impressions GROUP BY 2),
cells AS (SELECT c AS a, 'y' AS b, v AS va, y AS vb, count(*)::DOUBLE AS n FROM long GROUP BY ALL)"""
        + _WIDE_STATS.format(other="labels_")
        + " SELECT a AS column_name, size AS v, round(mi, 6) AS mi FROM m JOIN sizes ON c = a"
    ),
)
def _(spark, sf):
    table, features = _wide(spark, sf)
    return rounded(pairs.label_mi(table, features, _CAP), "mi")
