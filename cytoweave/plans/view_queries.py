"""Related-cell sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep, proto, rank, views
from . import tables as t
from .graph_queries import knn
from .prototype_queries import WITH_ASSIGNED
from .registry import query

N = 4  # views per anchor


def numbered_sql(src: str, pool: str, part: str | None = None, seed: int = 0, name: str = "num") -> str:
    order = f"{part}, " if part else ""
    length = f"count(*) OVER (PARTITION BY {pool}, {part})" if part else f"count(*) OVER (PARTITION BY {pool})"
    u = t.u_sql(f"'{seed}'", "'pool'", "cell_id")
    base = f"""{name}0 AS (SELECT cell_id, {pool}, {order}row_number() OVER (PARTITION BY {pool} ORDER BY {order}{u}, cell_id) - 1 AS idx,
      count(*) OVER (PARTITION BY {pool}) AS n, {length} AS len FROM {src})"""
    start = f"min(idx) OVER (PARTITION BY {pool}, {part})" if part else "0"
    return f"{base}, {name} AS (SELECT *, {start} AS start FROM {name}0)"


def draws_sql(ring: str, op: str, n_views: int, seed: int = 0, name: str = "vw", pool: str = "pool", num: str = "num", poolcol: str = "cell_type") -> str:
    """Distinct draws below ``size`` unrolled; ring(anchor_id, pool, n, base, size)."""
    m = n_views - 1
    u = lambda i: t.u_sql(f"'{seed}'", f"'{op}'", "anchor_id", f"'{i}'")
    out = [f"{name}d AS (SELECT *, least({m}, size) AS m FROM {ring})"]
    prev, cols = f"{name}d", []
    for i in range(m):
        last = f"(size - m + {i})"
        pick = f"floor({u(i)} * ({last} + 1))::BIGINT"
        seen = f"CASE WHEN {pick} IN ({', '.join(cols)}) THEN {last} ELSE {pick} END" if cols else pick
        out.append(f"{name}d{i} AS (SELECT *, {seen} AS p{i} FROM {prev})")
        prev, cols = f"{name}d{i}", cols + [f"p{i}"]
    rows = " UNION ALL ".join(
        f"SELECT anchor_id, pool, m, {i + 1} AS view_no, (base + p{i}) % n AS idx FROM {prev} WHERE {i} < m" for i in range(m)
    )
    out.append(f"{name}p AS ({rows})")
    out.append(
        f"""{name} AS (SELECT anchor_id, 0 AS view_no, anchor_id AS cell_id, m = {m} AS complete FROM {prev} UNION ALL
          SELECT anchor_id, view_no, x.cell_id, m = {m} FROM {name}p p JOIN {num} x ON x.{poolcol} = p.pool AND x.idx = p.idx)"""
    )
    return ", ".join(out)


def ring_sql(n_views: int, where: str = "true") -> str:
    return f"""ring AS (SELECT cell_id AS anchor_id, cell_type AS pool, n, CASE WHEN n - len > {n_views} THEN start + len ELSE 0 END AS base,
      CASE WHEN n - len > {n_views} THEN n - len ELSE n END AS size FROM num WHERE {where})"""


@query(
    "same_type_views",
    "I1",
    f"""{t.WITH_COUNTS}, {numbered_sql('cells', 'cell_type', 'study')}, {ring_sql(N)}, {draws_sql('ring', 'type', N)}
        SELECT anchor_id, view_no, cell_id, complete FROM vw""",
)
def same_type_views(spark, sf):
    return views.same_type_views(t.count_cells(spark, sf).select("cell_id", "cell_type", "study"), N)


@query(
    "one_partner",
    "I2",
    f"""{t.WITH_COUNTS}, {numbered_sql('cells', 'cell_type')}
        SELECT a.cell_id AS anchor_id, b.cell_id AS partner_id FROM num a JOIN num b ON a.cell_type = b.cell_type
          AND b.idx = floor({t.u_sql("'0'", "'partner'", 'a.cell_id')} * a.n)""",
)
def one_partner(spark, sf):
    return views.one_partner(t.count_cells(spark, sf).select("cell_id", "cell_type"))


def walk_sql(n_views: int, longest: int, seed: int = 0, where: str = "true") -> str:
    v = ", ".join(f"({i})" for i in range(1, n_views))
    out = [
        """adj AS (SELECT src, dst, rank, sum(dist) OVER w - dist AS lo, sum(dist) OVER w AS hi,
             sum(dist) OVER (PARTITION BY src) AS tot FROM knn WINDOW w AS (PARTITION BY src ORDER BY rank ROWS UNBOUNDED PRECEDING))""",
        f"""w0 AS (SELECT cell_id AS anchor_id, view_no, cell_id AS cur, floor({t.u_sql(f"'{seed}'", "'len'", 'cell_id', 'view_no')} * {longest}) + 1 AS len
             FROM emb, (VALUES {v}) q(view_no) WHERE {where})""",
    ]
    for i in range(longest):
        u = t.u_sql(f"'{seed}'", "'step'", "anchor_id", "view_no", f"'{i}'")
        out.append(
            f"""w{i + 1} AS (SELECT anchor_id, view_no, len, dst AS cur FROM w{i} JOIN adj ON cur = src AND lo <= {u} * tot AND {u} * tot < hi WHERE len > {i}
                UNION ALL SELECT anchor_id, view_no, len, cur FROM w{i} WHERE len <= {i})"""
        )
    out.append(
        f"""walks AS (SELECT anchor_id, view_no, cur AS cell_id, true AS complete FROM w{longest}
             UNION ALL SELECT cell_id, 0, cell_id, true FROM emb WHERE {where})"""
    )
    return ", ".join(out)


@query(
    "random_walk_views",
    "I3",
    f"WITH {t.EMB}, {t.knn_sql(5)}, {walk_sql(N, 3)} SELECT anchor_id, view_no, cell_id, complete FROM walks",
)
def random_walk_views(spark, sf):
    return views.random_walk_views(knn(spark, sf, 5), t.emb_cells(spark, sf).select("cell_id"), N, 3)


@query(
    "same_community_views",
    "I4",
    f"""{WITH_ASSIGNED}, mem AS (SELECT cell_id, proto_id AS community FROM assigned), {numbered_sql('mem', 'community')},
        ring AS (SELECT cell_id AS anchor_id, community AS pool, n, 0 AS base, n AS size FROM num),
        {draws_sql('ring', 'group', N, poolcol='community')} SELECT anchor_id, view_no, cell_id, complete FROM vw""",
)
def same_community_views(spark, sf):
    members = proto.nearest_prototype(t.emb(spark, sf), t.protos(spark, sf)).select(
        "cell_id", F.col("proto_id").alias("community")
    )
    return views.same_group_views(members, "community", N)


_MIX = t.u_sql("'0'", "'mix'", "cell_id")


@query(
    "mixed_views",
    "I5",
    f"""WITH {t.EMB}, {t.knn_sql(5)}, {numbered_sql('emb', 'cell_type', 'study')}, {ring_sql(N, f'{_MIX} < 0.5')}, {draws_sql('ring', 'type', N)},
        {walk_sql(N, 3, where=f'{_MIX} >= 0.5')}
        SELECT anchor_id, view_no, cell_id, complete FROM vw UNION ALL SELECT anchor_id, view_no, cell_id, complete FROM walks""",
)
def mixed_views(spark, sf):
    return views.mixed_views(t.emb_cells(spark, sf), knn(spark, sf, 5), N, 0.5, 3)


@query(
    "noise_views",
    "I6",
    f"""WITH {t.EVENT_GRID}, ix AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS i FROM (SELECT DISTINCT gene FROM ec)),
        mo AS (SELECT i, avg(x) AS mu, 1 / greatest((var_samp(x) - avg(x)) / (avg(x) * avg(x)), 0.01) AS r FROM grid JOIN ix USING (gene) GROUP BY 1),
        pm AS (SELECT i, k, exp(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * ln(mu / (mu + r)) + k * ln(r / (mu + r))) AS f FROM mo, range(0, 4000) k(k)),
        cd AS (SELECT i, k, sum(f) OVER (PARTITION BY i ORDER BY k) AS c FROM pm),
        dr AS (SELECT cell_id, view_no, i, x, {t.u_sql("'0'", "'noise'", 'cell_id', 'view_no', 'i')} AS u FROM grid JOIN ix USING (gene), (VALUES (0), (1)) v(view_no)),
        lo AS (SELECT cell_id, view_no, dr.i, min(k) AS n FROM dr JOIN cd ON cd.i = dr.i AND cd.c >= dr.u GROUP BY ALL)
        SELECT cell_id AS anchor_id, view_no, i::INT AS gene_no, x + coalesce(n, 4000) AS x FROM dr LEFT JOIN lo USING (cell_id, view_no, i)""",
)
def noise_views(spark, sf):
    """User x event-type counts with negative-binomial noise, dispersion from the table."""
    ec = t.event_counts(spark, sf)
    genes = sorted(r[0] for r in ec.select("gene").distinct().collect())
    dense = prep.dense_vectors(ec, "gene", genes, ec.select("cell_id").distinct())
    noisy = views.noise_views(dense, *views.gene_dispersion(dense, len(genes)), 2)
    return noisy.select("anchor_id", "view_no", F.posexplode("vec").alias("gene_no", "x"))


@query(
    "mask_views",
    "I7",
    f"""{t.WITH_COUNTS} SELECT cell_id, view_no, gene_id, x FROM counts, (VALUES (0), (1)) v(view_no)
        WHERE {t.u_sql("'0'", "'mask'", 'cell_id', 'view_no', 'gene_id')} >= 0.2""",
)
def mask_views(spark, sf):
    return views.mask_views(t.counts(spark, sf), 2)


@query(
    "gather_views",
    "I9",
    f"""{t.WITH_COUNTS}, {numbered_sql('cells', 'cell_type', 'study')}, {ring_sql(N)}, {draws_sql('ring', 'type', N)},
        tot AS (SELECT cell_id, sum(x) AS sizefactor FROM counts GROUP BY 1),
        lab AS (SELECT cell_type, row_number() OVER (ORDER BY cell_type) - 1 AS label_id FROM (SELECT DISTINCT cell_type FROM cells))
        SELECT view_no, anchor_id, cell_id, coalesce(sizefactor, 0) AS sizefactor, batch, cell_type, label_id
        FROM vw JOIN cells USING (cell_id) LEFT JOIN tot USING (cell_id) JOIN lab USING (cell_type)""",
)
def gather_views(spark, sf):
    cells = t.count_cells(spark, sf)
    v = views.same_type_views(cells.select("cell_id", "cell_type", "study"), N)
    totals = t.counts(spark, sf).groupBy("cell_id").agg(F.sum("x").alias("sizefactor"))
    labels = rank.label_index(cells.select("cell_type").distinct(), "cell_type")
    return views.view_major(views.gather_views(v, cells, totals, labels))


@query(
    "anchor_range",
    "I10",
    f"""{t.WITH_COUNTS}, {numbered_sql('cells', 'cell_type', 'study')}, {ring_sql(N)}, {draws_sql('ring', 'type', N)}
        SELECT anchor_id, view_no, cell_id FROM vw WHERE anchor_id >= 100 AND anchor_id < 200""",
)
def anchor_range(spark, sf):
    v = views.same_type_views(t.count_cells(spark, sf).select("cell_id", "cell_type", "study"), N)
    return views.anchor_range(v, 100, 200).select("anchor_id", "view_no", "cell_id")
