"""Quotas, orders, budgets and greedy selection over the embeddings and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicketry.functions import scores
from thicketry.operators import selection as S
from thicketry.plans.catalogue import query
from thicketry.plans.vectors import cos_sql
from thicketry.session import table

#: A value score for vectors that have none: plain arithmetic, the same in any engine.
VALUE = "(vec_id * 37 % 101) / 101.0"


def _scored(s, d):
    return table(s, d, "embeddings").withColumn("score", F.expr("cast(vec_id * 37 % 101 as double) / 101.0"))


def quota_sql(budget: int) -> str:
    return f"""WITH s AS (SELECT label, count(*) n FROM embeddings GROUP BY 1), t AS (SELECT label, n, {budget}.0*sqrt(n)/sum(sqrt(n)) OVER () AS raw, sum(n) OVER () AS total FROM s),
    q AS (SELECT *, least(n, floor(raw))::BIGINT q0, round(raw-floor(raw),12) frac FROM t), rem AS (SELECT least({budget}, max(total))-sum(q0) todo FROM q),
    u AS (SELECT label, frac, unnest(range(1, n-q0+1)) AS t FROM q WHERE n>q0), k AS (SELECT label, count(*) more FROM (SELECT label, row_number() OVER (ORDER BY t, frac DESC, label) r FROM u) WHERE r <= (SELECT todo FROM rem) GROUP BY 1)
    SELECT q.label, q.n, (q0+coalesce(more,0))::BIGINT AS quota FROM q LEFT JOIN k USING (label)"""


@query("quota_largest_remainder", quota_sql(137))
def quota_largest_remainder(s, d):
    return S.largest_remainder(table(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "n", 137)


@query("quota_top_selection", f"WITH q AS ({quota_sql(137)}), r AS (SELECT vec_id, label, cast(vec_id * 37 % 101 as double) / 101.0 AS score FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM r) SELECT vec_id, label, round(score,9) AS score, rank FROM k JOIN q USING (label) WHERE rank <= quota")
def quota_top_selection(s, d):
    e = _scored(s, d)
    q = S.largest_remainder(e.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "n", 137)
    return S.quota_top(e, "vec_id", "label", "score", q, 137).withColumn("score", F.round("score", 9))


_ROUND = """WITH k AS (SELECT sample_key, min(cluster_id) AS cluster_id, min(center_distance) AS dist FROM kmeans_result WHERE sample_key IS NOT NULL AND cluster_id IS NOT NULL AND center_distance IS NOT NULL GROUP BY 1),
    n AS (SELECT *, first_value(sample_key) OVER (PARTITION BY cluster_id ORDER BY dist, sample_key) who, md5('5|'||sample_key) < '05' AS seed FROM k),
    t AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, sample_key) turn FROM n WHERE NOT seed), o AS (SELECT sample_key, cluster_id, row_number() OVER (ORDER BY turn, who) AS step FROM t)"""


def _round(s, d):
    k = table(s, d, "kmeans_result").where("sample_key is not null and cluster_id is not null and center_distance is not null")
    k = k.groupBy("sample_key").agg(F.min("cluster_id").alias("cluster_id"), F.min("center_distance").alias("dist"))
    return k.withColumn("seed", S.md5_order("sample_key", "5") < "05")


@query("round_robin_order", f"{_ROUND} SELECT sample_key, cluster_id, step FROM o")
def round_robin_order(s, d):
    return S.round_robin(_round(s, d), "sample_key", "cluster_id", "dist", "seed").select("sample_key", "cluster_id", "step")


@query("nested_budgets", f"{_ROUND}, c AS (SELECT count(*) m FROM n WHERE seed) SELECT budget::INT AS budget, sample_key FROM (SELECT sample_key, step, unnest([100,400,1600]) AS budget FROM o), c WHERE step <= budget-m UNION ALL SELECT unnest([100,400,1600])::INT, sample_key FROM n WHERE seed")
def nested_budgets(s, d):
    k = _round(s, d)
    seeds = k.where("seed").select("sample_key")
    return S.nested_budgets(S.round_robin(k, "sample_key", "cluster_id", "dist", "seed"), seeds, "sample_key", [100, 400, 1600], seeds.count())


def greedy_sql(variant: str, steps: int) -> str:
    mode, kind = scores.VARIANTS[variant]
    value = "b*(1-w)" if mode == "smooth" else "greatest(0,b-w)*(1-w)"
    u = "val*(1-sim)" if kind == "product" else "val*(1+1-sim)"
    order = f"round({u},9) DESC, val DESC, round(1-sim,9) DESC, id"
    return f"""WITH RECURSIVE m AS (SELECT vec_id AS id, cast(vec_id*37%101 as double)/101.0 b, cast(vec_id*53%89 as double)/200.0 w, embedding e FROM embeddings), v AS (SELECT id, e, greatest(0,least(1,{value})) AS val, id>=10 AS free FROM m),
    s0 AS (SELECT a.id, a.val, max(greatest(0,least(1,{cos_sql('a.e', 'b.e')}))) AS sim FROM v a, v b WHERE a.free AND NOT b.free GROUP BY 1,2),
    r AS (SELECT 0 AS step, id, val, sim, first_value(id) OVER (ORDER BY {order}) AS pick FROM s0
      UNION ALL SELECT step+1, id, val, sim, first_value(id) OVER (ORDER BY {order}) FROM (SELECT r.step, r.id, r.val, greatest(r.sim, greatest(0,least(1,{cos_sql('x.e', 'y.e')}))) AS sim FROM r JOIN v x ON x.id=r.id JOIN v y ON y.id=r.pick WHERE r.id<>r.pick AND r.step<{steps - 1}))
    SELECT '{variant}' AS variant, step, id AS vec_id, round({u},6) AS utility, round(val,6) AS value, round(1-sim,6) AS novelty, round(sim,6) AS max_similarity FROM r WHERE id=pick"""


def _greedy(variant):
    def run(s, d):
        e = table(s, d, "embeddings").select("vec_id", "embedding", F.expr("cast(vec_id*37%101 as double)/101.0").alias("b"), F.expr("cast(vec_id*53%89 as double)/200.0").alias("w"))
        e = e.select(F.lit(variant).alias("variant"), "vec_id", "embedding", scores.value("b", "w", scores.VARIANTS[variant][0]).alias("value"), F.lit(True).alias("valid"), (F.col("vec_id") < 10).alias("seed"))
        g = S.greedy_acquisition(e, ["variant"], "vec_id", "embedding", "value", "valid", "seed", 20, variant)
        return g.select("variant", "step", "vec_id", *(F.round(c, 6).alias(c) for c in ("utility", "value", "novelty", "max_similarity")))

    return run


for _v in scores.VARIANTS:
    query(f"greedy_{_v}", greedy_sql(_v, 20))(_greedy(_v))


@query("kmeans_representatives")
def kmeans_representatives(s, d):
    """One representative a cluster of a seeded k-means; no two centres share one."""
    from thicketry.operators import clusters as C

    model, rows = C.kmeans(table(s, d, "embeddings"), "vec_id", "embedding", 12, seed=7)
    return C.unique_representatives(rows, model, "vec_id", "embedding")


@query("nested_selection")
def nested_selection(s, d):
    """Quotas without look-alikes; the vectors are far apart, so the threshold is low."""
    e = _scored(s, d).withColumn("run", F.lit(0)).withColumn("seed", F.col("vec_id") < 10)
    return S.nested_selection(e, ["run"], "vec_id", "label", "embedding", "score", "seed", [41, 102, 204], 0.3)


@query(
    "acquisition_utilities",
    """SELECT run_id, step_no, sample_key, round(1-greatest(0,least(1,CASE WHEN isnan(max_similarity) THEN 0 ELSE coalesce(max_similarity,0) END)),6) AS novelty,
    round(value_score*(1+1-greatest(0,least(1,CASE WHEN isnan(max_similarity) THEN 0 ELSE coalesce(max_similarity,0) END))),6) AS reward FROM (SELECT DISTINCT run_id, step_no, sample_key, value_score, max_similarity FROM acquisition) WHERE value_score IS NOT NULL""",
)
def acquisition_utilities(s, d):
    a = table(s, d, "acquisition").where("value_score is not null").select("run_id", "step_no", "sample_key", "value_score", "max_similarity").distinct()
    a = a.withColumn("n", scores.novelty(F.coalesce(F.nanvl("max_similarity", F.lit(0.0)), F.lit(0.0))))
    return a.select("run_id", "step_no", "sample_key", F.round("n", 6).alias("novelty"), F.round(scores.utility("value_score", "n", "reward"), 6).alias("reward"))


def _tokens_sql(up: bool) -> str:
    r = "ceil(round(n*0.12,9))" if up else "round_even(n*0.12,0)"
    return f"WITH x AS (SELECT vec_id, (generate_subscripts(embedding,1)-1)::INT AS cell, abs(CAST(unnest(embedding) AS DOUBLE)) AS score FROM embeddings), r AS (SELECT *, count(*) OVER (PARTITION BY vec_id) n, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cell) AS rank FROM x) SELECT vec_id, cell, rank FROM r WHERE rank <= least(greatest({r},4),10,n)"


def _cells(s, d):
    return table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("cell", "v")).select("vec_id", "cell", F.abs(F.col("v").cast("double")).alias("score"))


@query("bounded_top_cells", _tokens_sql(False))
def bounded_top_cells(s, d):
    return S.bounded_top(_cells(s, d), "vec_id", F.col("score"), "cell", 0.12, 4, 10).select("vec_id", "cell", "rank")


@query("bounded_top_cells_up", _tokens_sql(True))
def bounded_top_cells_up(s, d):
    return S.bounded_top(_cells(s, d), "vec_id", F.col("score"), "cell", 0.12, 4, 10, up=True).select("vec_id", "cell", "rank")
