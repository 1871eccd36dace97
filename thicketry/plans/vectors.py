"""Vector functions and clusters over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicketry.functions import vectors as V
from thicketry.operators import clusters as C
from thicketry.operators import metrics as M
from thicketry.plans.catalogue import query
from thicketry.session import table

DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
COS = f"({DOT} / sqrt({DOT.replace('{b}', '{a}')} * {DOT.replace('{a}', '{b}')}))"
#: Scores of a row as a distribution over four classes: positive parts of the first four values.
PROBS = "list_transform([e[1],e[2],e[3],e[4]], lambda x: greatest(0, CAST(x AS DOUBLE)))"


def cos_sql(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


@query(
    "cluster_centroids",
    """WITH x AS (SELECT label, generate_subscripts(embedding,1)-1 AS pos, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) v FROM x GROUP BY 1,2)
    SELECT label, pos, round(v, 6) + 0.0 AS value FROM m""",
)
def cluster_centroids(s, d):
    c = C.centroids(table(s, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "v")).select("label", F.col("pos").cast("bigint").alias("pos"), (F.round("v", 6) + 0.0).alias("value"))


@query(
    "nearest_to_centroid",
    """WITH x AS (SELECT label, vec_id, generate_subscripts(embedding,1) AS pos, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) c FROM x GROUP BY 1,2),
    dd AS (SELECT label, vec_id, round(sqrt(sum((CAST(v AS DOUBLE)-c)*(CAST(v AS DOUBLE)-c))),9) dist FROM x JOIN m USING (label, pos) GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) k FROM dd)
    SELECT label, vec_id, round(dist,6) AS dist FROM r WHERE k=1""",
)
def nearest_to_centroid(s, d):
    return C.nearest_to_centroid(table(s, d, "embeddings"), "vec_id", "label", "embedding")


@query("l2_normalized", f"SELECT vec_id, round(sqrt({DOT.format(a='embedding', b='embedding')}),6) AS length, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)/sqrt({DOT.format(a='embedding', b='embedding')}))),6)+0.0 AS total FROM embeddings")
def l2_normalized(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(V.norm("embedding"), 6).alias("length"), (F.round(V.total(V.l2_normalize("embedding")), 6) + 0.0).alias("total"))


@query(
    "pairwise_cosine_moments",
    """WITH x AS (SELECT vec_id, generate_subscripts(embedding,1) AS p, unnest(embedding) AS v FROM embeddings), l AS (SELECT vec_id, sqrt(sum(CAST(v AS DOUBLE)*v)) n FROM x GROUP BY 1), u AS (SELECT vec_id, p, v/n AS v FROM x JOIN l USING (vec_id)),
    s AS (SELECT sum(t*t) s FROM (SELECT p, sum(v) t FROM u GROUP BY 1)), m AS (SELECT sum(t*t) m FROM (SELECT a.p, b.p q, sum(a.v*b.v) t FROM u a JOIN u b USING (vec_id) GROUP BY 1,2)), c AS (SELECT count(*) n FROM embeddings)
    SELECT n, round((s-n)/(n*(n-1)),9)+0.0 AS mean, round(sqrt((m-n)/(n*(n-1)) - ((s-n)/(n*(n-1)))*((s-n)/(n*(n-1)))),9) AS std FROM s, m, c""",
)
def pairwise_cosine_moments(s, d):
    m = M.pairwise_cosine_moments(table(s, d, "embeddings"), "embedding", 64)
    return m.select("n", (F.round("mean", 9) + 0.0).alias("mean"), F.round("std", 9).alias("std"))


@query("distinct_vectors", "SELECT count(DISTINCT embedding) AS n_distinct, count(*) AS n, count(DISTINCT embedding) >= 40 AS enough FROM embeddings")
def distinct_vectors(s, d):
    e = table(s, d, "embeddings").select(F.hash("embedding").alias("h"), "embedding")
    g = e.groupBy("h", "embedding").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n"), (F.count(F.lit(1)) >= 40).alias("enough"))


@query(
    "prototype_invariants",
    """WITH p AS (SELECT *, proto IS NOT NULL AND len(proto)=128 AND len(list_filter(proto, lambda x: NOT (isnan(x) OR isinf(x))))=128 AS finite FROM prototypes),
    q AS (SELECT *, CASE WHEN finite THEN sqrt(list_sum(list_transform(proto, lambda x: CAST(x AS DOUBLE)*x))) END AS n FROM p)
    SELECT bank_id, count(*) AS n_rows, count(*) FILTER (WHERE NOT finite) AS n_unusable, count(*) FILTER (WHERE n=0) AS n_zero, count(*) FILTER (WHERE n>0 AND abs(n-1)>0.001) AS n_not_unit, count(*) FILTER (WHERE is_valid AND coalesce(n,0)=0) AS n_false_flag FROM q GROUP BY 1""",
)
def prototype_invariants(s, d):
    v = F.col("proto")
    finite = F.coalesce((F.size(v) == 128) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    q = table(s, d, "prototypes").select("bank_id", "is_valid", finite.alias("finite"), F.when(finite, V.norm("proto")).alias("n"))
    n = lambda c: F.count(F.when(c, 1))
    return q.groupBy("bank_id").agg(F.count(F.lit(1)).alias("n_rows"), n(~F.col("finite")).alias("n_unusable"), n(F.col("n") == 0).alias("n_zero"), n((F.col("n") > 0) & (F.abs(F.col("n") - 1) > 0.001)).alias("n_not_unit"), n(F.col("is_valid") & (F.coalesce("n", F.lit(0.0)) == 0)).alias("n_false_flag"))


#: All 64 values in eight runs of eight: the first four of a run are one distribution, the last four the other.
_RUNS = "SELECT vec_id, r::INT AS run, embedding[r*8+1:r*8+8] AS e FROM embeddings, (SELECT unnest(range(8)) r)"
_P = f"SELECT vec_id, run, {PROBS} AS p, {PROBS.replace('e[1],e[2],e[3],e[4]', 'e[5],e[6],e[7],e[8]')} AS q FROM ({_RUNS})"
_N = "CASE WHEN list_sum({x}) > 1e-6 THEN list_transform({x}, lambda v: v/list_sum({x})) ELSE [0.0,0.0,0.0,0.0]::DOUBLE[] END"
_KL = "list_sum(list_transform(range(1,5), lambda i: {a}[i]*(ln(greatest({a}[i],1e-6))-ln(greatest(({a}[i]+{b}[i])/2,1e-6)))))"


def _slices(s, d, width):
    e = table(s, d, "embeddings").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(64 // width - 1))))
    return e.select("vec_id", "run", F.transform(F.slice("embedding", F.col("run") * width + 1, F.lit(width)), lambda x: x.cast("double")).alias("e"))


@query(
    "probability_divergence",
    f"""WITH b AS ({_P}), n AS (SELECT vec_id, run, {_N.format(x='p')} AS p, {_N.format(x='q')} AS q FROM b)
    SELECT vec_id, run, round(list_sum(p),6) AS total, round(-list_sum(list_transform(p, lambda x: x*ln(greatest(x,1e-6))))/ln(4),6)+0.0 AS entropy,
    round(({_KL.format(a='p', b='q')}+{_KL.format(a='q', b='p')})/2/ln(2),6)+0.0 AS divergence FROM n""",
)
def probability_divergence(s, d):
    part = lambda a: V.normalize_probabilities(F.slice("e", a, 4))
    p = _slices(s, d, 8).select("vec_id", "run", part(1).alias("p"), part(5).alias("q"))
    return p.select("vec_id", "run", F.round(V.total("p"), 6).alias("total"), (F.round(V.entropy("p"), 6) + 0.0).alias("entropy"), (F.round(V.js_divergence("p", "q"), 6) + 0.0).alias("divergence"))


_ERRORS = "SELECT vec_id, r::INT AS run, list_transform(embedding[r*4+1:r*4+4], lambda x: abs(CAST(x AS DOUBLE))) AS err FROM embeddings, (SELECT unnest(range(16)) r)"


@query(
    "branch_oracle",
    f"""WITH b AS ({_ERRORS}), e AS (SELECT vec_id, run, err, list_transform(err, lambda x: exp((-x+list_min(err))/0.1)) AS w FROM b)
    SELECT vec_id, run, list_position(err, list_min(err))-1 AS best, round(list_max(w)/list_sum(w),6) AS weight, err[1]-list_min(err) > 0.05 AS improves, round(err[1]+list_sum(list_transform(range(1,5), lambda i: w[i]/list_sum(w)*(err[i]-err[1]))),6) AS mixed FROM e""",
)
def branch_oracle(s, d):
    """Softmax over the negative error of four branches, at all 16 places of a row, and what their mixture would leave."""
    b = _slices(s, d, 4).select("vec_id", "run", F.transform("e", F.abs).alias("err"))
    b = b.withColumn("w", V.softmax(F.transform("err", lambda x: -x), 0.1))
    e = F.col("err")
    return b.select("vec_id", "run", (F.array_position("err", F.array_min("err")) - 1).alias("best"), F.round(F.array_max("w"), 6).alias("weight"), ((e[0] - F.array_min("err")) > 0.05).alias("improves"), F.round(V.mixture(e[0], [e[i] for i in range(4)], F.col("w")), 6).alias("mixed"))


_GAIN = "sum(w*CASE WHEN abs(x)<1 THEN 0.5*x*x ELSE abs(x)-0.5 END)/greatest(sum(w),1)"


@query(
    "quality_losses",
    f"""WITH b AS ({_ERRORS}), o AS (SELECT vec_id, run, err, list_transform(err, lambda x: exp((-x+list_min(err))/0.5)) AS w, (err[1]-list_min(err)>=0.03)::INT AS ok FROM b),
    k AS (SELECT vec_id, ok, list_sum(list_transform(range(1,5), lambda i: w[i]/list_sum(w)*(ln(greatest(w[i]/list_sum(w),1e-6))-ln(0.25)))) AS kl, err FROM o), g AS (SELECT vec_id, 1.0 AS w, err[1]-unnest(err)-0.1 AS x FROM b)
    SELECT vec_id, round(gain,6) AS gain_loss, round(kl,6)+0.0 AS oracle_loss FROM (SELECT vec_id, {_GAIN} AS gain FROM g GROUP BY 1) JOIN (SELECT vec_id, sum(kl*ok)/greatest(sum(ok),1) AS kl FROM k GROUP BY 1) USING (vec_id)""",
)
def quality_losses(s, d):
    """Smooth L1 of a forecast gain (0.1 everywhere) against the real one, over all branches; divergence of the oracle from even weights where it improves."""
    from thicketry.functions import scores

    b = _slices(s, d, 4).select("vec_id", F.transform("e", F.abs).alias("err"))
    b = b.withColumn("w", V.softmax(F.transform("err", lambda x: -x), 0.5))
    even = F.array(*[F.lit(0.25)] * 4)
    ok = (F.col("err")[0] - F.array_min("err") >= 0.03).cast("double")
    gain = V.total(F.transform("err", lambda x: scores.smooth_l1(F.col("err")[0] - x - 0.1)))
    b = b.select("vec_id", gain.alias("gain"), (scores.oracle_divergence("w", even)).alias("kl"), ok.alias("ok"))
    out = b.groupBy("vec_id").agg((F.sum("gain") / (4 * F.count(F.lit(1)))).alias("gain"), M.guarded_mean(F.col("kl"), F.col("ok")).alias("kl"))
    return out.select("vec_id", F.round("gain", 6).alias("gain_loss"), (F.round("kl", 6) + 0.0).alias("oracle_loss"))


@query("one_hot_values", "SELECT vec_id, [CASE WHEN label%4=0 THEN 1.0 ELSE 0.0 END, CASE WHEN label%4=1 THEN 1.0 ELSE 0.0 END, CASE WHEN label%4=2 THEN 1.0 ELSE 0.0 END, CASE WHEN label%4=3 THEN 1.0 ELSE 0.0 END][label%4+1]::DOUBLE AS own, (label%4 IN (0,2))::INT::DOUBLE AS fg, (label%4 IN (1,3))::INT::DOUBLE AS bg FROM embeddings")
def one_hot_values(s, d):
    """The class part of a parent's value row: one-hot region, foreground and background."""
    r = F.pmod("label", F.lit(4))
    hot = V.one_hot(r, 4)
    return table(s, d, "embeddings").select("vec_id", F.element_at(hot, r + 1).alias("own"), (hot[0] + hot[2]).alias("fg"), (hot[1] + hot[3]).alias("bg"))
