"""The evaluation step: pairs, curves and one row a dataset; losses of a forecast against its targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicketry.functions import scores
from thicketry.operators import evaluation as E
from thicketry.operators import maps as M
from thicketry.operators import metrics
from thicketry.plans.catalogue import query
from thicketry.plans.maps import _AT_EDGE, _MAPS, _PIX, H, W, _maps
from thicketry.plans.retrieval import _HITS, _hits
from thicketry.session import table

_NORM = f"""{_PIX}, nrm AS (SELECT vec_id, CASE WHEN max(p) OVER w > min(p) OVER w THEN (p-min(p) OVER w)/(max(p) OVER w-min(p) OVER w) ELSE p END AS p, (v>0.5)::INT AS g FROM x WINDOW w AS (PARTITION BY vec_id)),
    a AS (SELECT vec_id, least(2*avg(p),1) AS thr, avg(abs(p-g)) AS mae, sum(g) AS fg, count(*) AS n FROM nrm GROUP BY 1),
    c AS (SELECT vec_id, level, fg, n, count(*) FILTER (WHERE g=1 AND hit) AS tp, count(*) FILTER (WHERE g=0 AND hit) AS fp FROM (SELECT vec_id, level, fg, n, g, CASE WHEN level<0 THEN p>=thr ELSE floor(p*255)>=level END AS hit FROM nrm JOIN a USING (vec_id), (SELECT unnest(range(-1,256)) AS level)) GROUP BY 1,2,3,4)"""
_AL = "power(2*(({p})-mp)*(({g})-mg)/((({p})-mp)*(({p})-mp)+(({g})-mg)*(({g})-mg)+2.220446049250313e-16)+1,2)/4"


@query(
    "evaluation_report",
    f"""{_NORM}, q AS (SELECT *, tp/greatest(1,tp+fp) AS pr, tp/greatest(1,fg) AS re, (tp+fp)/n AS mp, fg/n AS mg FROM c),
    e AS (SELECT vec_id%10 AS dataset, level, CASE WHEN tp>0 THEN 1.3*pr*re/(0.3*pr+re) ELSE 0 END AS f, (CASE WHEN fg=0 THEN n-tp-fp WHEN fg=n THEN tp+fp ELSE tp*{_AL.format(p=1, g=1)}+fp*{_AL.format(p=1, g=0)}+(fg-tp)*{_AL.format(p=0, g=1)}+(n-fg-fp)*{_AL.format(p=0, g=0)} END)/(n-1) AS e FROM q),
    mm AS (SELECT dataset, level, avg(f) AS f, avg(e) AS e FROM e GROUP BY 1,2), bb AS (SELECT vec_id%10 AS dataset, count(*) AS n, avg(mae) AS mae FROM a GROUP BY 1)
    SELECT dataset, max(bb.n) AS n, round(max(bb.mae),6) AS mae, round(max(f) FILTER (WHERE level<0),6) AS f_adaptive, round(avg(f) FILTER (WHERE level>=0),6) AS f_mean, round(max(f) FILTER (WHERE level>=0),6) AS f_max, round(max(e) FILTER (WHERE level<0),6) AS e_adaptive, round(avg(e) FILTER (WHERE level>=0),6) AS e_mean, round(max(e) FILTER (WHERE level>=0),6) AS e_max FROM mm JOIN bb USING (dataset) GROUP BY 1""",
)
def evaluation_report(s, d):
    """Each map against the mask of its mirrored view, joined by name with a check of shapes; one row a dataset."""
    m = _maps(s, d).withColumn("dataset", F.expr("vec_id % 10"))
    size = [F.lit(H).alias("h"), F.lit(W).alias("w")]
    pred = m.select("dataset", "vec_id", *size, F.col("p").alias("pred"))
    gt = m.select("dataset", "vec_id", *size, F.transform("view", lambda x: F.when(x > 0.5, 1.0).otherwise(0.0)).alias("gt"))
    r = E.report(E.paired_maps(pred, gt, ["dataset", "vec_id"]), "dataset")
    return r.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in r.dtypes))


_LOGIT = f"{_HITS}, t AS (SELECT query, query%4 AS qr, vec_id%4 AS cr, score*10 AS l FROM hits), k AS (SELECT *, ((qr<2)=(cr<2))::INT AS sem, (qr=cr)::INT AS det, ((qr=1 AND cr=2) OR (qr=2 AND cr=1)) AS across, ((qr<2)=(cr<2) AND qr<>cr) AS near FROM t)"
_BCE = "(greatest(l,0)-l*{t}+ln(1+exp(-abs(l))))"


@query("support_losses", f"{_LOGIT} SELECT query, round(sum((1+across::INT)*{_BCE.format(t='sem')})/greatest(sum(1+across::INT),1),6) AS semantic, round(sum((1+near::INT)*{_BCE.format(t='det')})/greatest(sum(1+near::INT),1),6) AS detail FROM k GROUP BY 1")
def support_losses(s, d):
    """Cross-entropy of support logits; hard negatives count twice."""
    h = _hits(s, d).withColumn("l", F.col("score") * 10)
    t = scores.support_targets(F.col("query") % 4, F.col("vec_id") % 4)
    weigh = lambda hard: 1.0 + hard.cast("double")
    loss = lambda k, hard: F.round(metrics.guarded_mean(scores.bce_logit("l", t[k].cast("double")), weigh(t[hard])), 6)
    return h.groupBy("query").agg(loss("semantic", "semantic_hard").alias("semantic"), loss("detail", "detail_hard").alias("detail"))


_BOTH = f"{_PIX}, f AS (SELECT vec_id, y, x, p, v, coalesce(lead(p) OVER r-p,0) px, coalesce(lead(p) OVER c-p,0) py, coalesce(lead(v) OVER r-v,0) vx, coalesce(lead(v) OVER c-v,0) vy FROM x WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)), n AS (SELECT *, greatest(sqrt(px*px+py*py),1e-6) pl, greatest(sqrt(vx*vx+vy*vy),1e-6) vl FROM f)"
_GERR = "(2*abs(p-v)+0.5*(1-((px/pl)*(vx/vl)+(py/pl)*(vy/vl))/greatest(sqrt((px/pl)*(px/pl)+(py/pl)*(py/pl))*sqrt((vx/vl)*(vx/vl)+(vy/vl)*(vy/vl)),1e-6))+0.5*abs(p-v))"


@query("geometry_losses", f"{_BOTH} SELECT vec_id, round(sum({_GERR})/64,5) AS loss, round(sum(abs(2*v-1)*{_GERR})/greatest(sum(abs(2*v-1)),1),5) AS weighted FROM n GROUP BY 1")
def geometry_losses(s, d):
    """Error of distance, normal and offset of two views of a map, plain and weighted by reliability."""
    m = _maps(s, d)
    a, b = M.geometry("p", H, W), M.geometry("view", H, W)
    x = m.select("vec_id", F.explode(F.arrays_zip(*(g[c].alias(f"{n}_{c}") for n, g in (("a", a), ("b", b)) for c in ("sdf", "nx", "ny", "offset")), b["reliability"].alias("r"))).alias("c")).select("vec_id", "c.*")
    e = scores.geometry_error(("a_sdf", "b_sdf"), (("a_nx", "a_ny"), ("b_nx", "b_ny")), ("a_offset", "b_offset"))
    return x.groupBy("vec_id").agg(F.round(metrics.guarded_mean(e, F.lit(1.0)), 5).alias("loss"), F.round(metrics.guarded_mean(e, F.col("r")), 5).alias("weighted"))


_T = "((abs(p-(v>0.5)::INT)>0.25)::INT*(1-greatest(0,least(1,abs(p-v)))))"
_PB = "-({t}*ln(greatest(1e-6,least(1-1e-6,p)))+(1-{t})*ln(1-greatest(1e-6,least(1-1e-6,p))))"


@query("gate_losses", f"{_PIX} SELECT vec_id, round(coalesce(avg({_PB.format(t=_T)}) FILTER (WHERE v>0.45),0),6) AS loss FROM x GROUP BY 1")
def gate_losses(s, d):
    """Cross-entropy of a gate against need x (1 - contradiction), over the cells that count."""
    x = _maps(s, d).select("vec_id", F.explode(F.arrays_zip("p", F.col("view").alias("v"))).alias("c")).select("vec_id", "c.*")
    need = scores.needs_correction("p", (F.col("v") > 0.5).cast("double")).cast("double")
    target = scores.gate_target(need, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(F.col("p") - F.col("v")))))
    return x.groupBy("vec_id").agg(F.round(metrics.conditional_mean(scores.bce("p", target), F.col("v") > 0.45), 6).alias("loss"))


@query(
    "boundary_losses",
    f"""{_MAPS}, k AS (SELECT vec_id, p, v, list_transform(v, lambda x: CASE WHEN x>0.5 THEN 1 ELSE 0 END) AS m FROM g), e AS (SELECT vec_id, p[i+1] AS p, v[i+1] AS v, ({_AT_EDGE})::INT AS t FROM k, (SELECT unnest(range(64)) i))
    SELECT vec_id, round(avg({_PB.format(t='t')}),6) AS loss, round(coalesce(sum(({_PB.format(t='t')})*(v>0.45)::INT)/nullif(sum((v>0.45)::INT),0),0),6) AS masked FROM e GROUP BY 1""",
)
def boundary_losses(s, d):
    """Cross-entropy against the boundary of a mask, over all cells and over valid ones."""
    m = _maps(s, d).withColumn("m", F.transform("view", lambda x: (x > 0.5).cast("int")))
    edge = F.transform(M.regions("m", H, W), lambda r: (r >= 2).cast("double"))
    x = m.select("vec_id", F.explode(F.arrays_zip("p", F.col("view").alias("v"), edge.alias("t"))).alias("c")).select("vec_id", "c.*")
    loss = scores.bce("p", "t")
    return x.groupBy("vec_id").agg(F.round(F.avg(loss), 6).alias("loss"), F.round(metrics.conditional_mean(loss, F.col("v") > 0.45), 6).alias("masked"))


@query("decoder_confidence", f"{_PIX} SELECT vec_id, cell, round(abs(2*(p-0.5))*(1-abs(p-v))*(1-abs(p-v)/2)*(1-greatest(0,least(1,-(w1*ln(greatest(w1,1e-6))+w2*ln(greatest(w2,1e-6))+2*0.25*ln(0.25))/ln(4))))*(1-0.3),6)+0.0 AS confidence FROM (SELECT *, p/2 AS w1, (1-p)/2 AS w2 FROM x)")
def decoder_confidence(s, d):
    """Five factors at every cell: decidedness, agreement, no contradiction, sure mixture, sure route."""
    x = _maps(s, d).select("vec_id", F.posexplode(F.arrays_zip("p", F.col("view").alias("v"))).alias("cell", "c")).select("vec_id", "cell", "c.*")
    w = F.array(F.col("p") / 2, (1 - F.col("p")) / 2, F.lit(0.25), F.lit(0.25))
    c = scores.decoder_confidence("p", "v", F.abs(F.col("p") - F.col("v")) / 2, w, F.lit(0.3))
    return x.select("vec_id", "cell", (F.round(c, 6) + 0.0).alias("confidence"))


@query("coverage_weights", f"{_PIX}, c AS (SELECT vec_id, avg((p>=0.6 OR p<=0.4)::INT) AS c FROM x GROUP BY 1) SELECT vec_id, epoch::INT AS epoch, round(2*least(1,epoch/3.0)*least(1,c/0.2),6) AS weight, CASE WHEN epoch<6 THEN 'off' WHEN epoch<11 THEN 'parent_only' ELSE 'full' END AS mode, round(greatest(0,least(1,(epoch-10)/3.0)),6) AS strength FROM c, (SELECT unnest([0,1,2,3,6,11,12,13]) AS epoch)")
def coverage_weights(s, d):
    """Weight of the loss on hard targets by their share and the epoch, with the mode and strength of the epoch."""
    kept = F.filter("p", lambda x: (x >= 0.6) | (x <= 0.4))
    c = _maps(s, d).select("vec_id", (F.size(kept) / 64.0).alias("c"), F.explode(F.array(*map(F.lit, (0, 1, 2, 3, 6, 11, 12, 13)))).alias("epoch"))
    return c.select("vec_id", "epoch", F.round(scores.coverage_weight("c", "epoch"), 6).alias("weight"), scores.stage_mode("epoch").alias("mode"), F.round(scores.injection_strength("epoch"), 6).alias("strength"))


_G6 = "list_transform(embedding[{a}:{b}], lambda x: CAST(x AS DOUBLE))"


def _pair_sql(a: str, b: str) -> str:
    cos = f"({a}[2]*{b}[2]+{a}[3]*{b}[3])/(greatest(sqrt({a}[2]*{a}[2]+{a}[3]*{a}[3]),1e-6)*greatest(sqrt({b}[2]*{b}[2]+{b}[3]*{b}[3]),1e-6))"
    return f"-abs({a}[1]-{b}[1]), {cos}, -(abs({a}[4]-{b}[4])+abs({a}[5]-{b}[5]))/2"


_U = "greatest(0,least(1,{x}[6]))"


@query(
    "geometry_support",
    f"""WITH e AS (SELECT vec_id, {_G6.format(a=1, b=6)} AS q, {_G6.format(a=7, b=12)} AS c, {_G6.format(a=13, b=18)} AS p FROM embeddings),
    f AS (SELECT vec_id, [{_pair_sql('q', 'c')}, cbrt({_U.format(x='q')}*{_U.format(x='c')}*{_U.format(x='p')}), {_pair_sql('p', 'c')}, {_U.format(x='p')}] AS f FROM e)
    SELECT vec_id, (generate_subscripts(f,1)-1)::INT AS feature, round(unnest(f),6)+0.0 AS value FROM f""",
)
def geometry_support(s, d):
    """Eight features of the geometries of a query, a child and its parent."""
    g = lambda a: F.transform(F.slice("embedding", a, 6), lambda x: x.cast("double"))
    e = table(s, d, "embeddings").select("vec_id", g(1).alias("q"), g(7).alias("c"), g(13).alias("p"))
    e = e.select("vec_id", F.posexplode(scores.geometry_support(F.col("q"), F.col("c"), F.col("p"))).alias("feature", "v"))
    return e.select("vec_id", "feature", (F.round("v", 6) + 0.0).alias("value"))


@query("parent_values", f"{_PIX} SELECT vec_id, cell, [(r=0)::INT::DOUBLE,(r=1)::INT::DOUBLE,(r=2)::INT::DOUBLE,(r=3)::INT::DOUBLE,(r IN (0,2))::INT::DOUBLE,(r IN (1,3))::INT::DOUBLE,round(2*p-1,6)+0.0,round(abs(2*p-1),6)] AS values FROM (SELECT *, (vec_id+cell)%4 AS r FROM x)")
def parent_values(s, d):
    """The eight values of a parent row at every cell."""
    x = _maps(s, d).select("vec_id", F.posexplode("p").alias("cell", "p"))
    sdf = F.round(2 * F.col("p") - 1, 6) + 0.0
    return x.select("vec_id", "cell", scores.parent_values((F.col("vec_id") + F.col("cell")) % 4, sdf, F.round(F.abs(2 * F.col("p") - 1), 6)).alias("values"))


@query("map_losses", f"{_PIX} SELECT (vec_id%10) AS dataset, round(avg({_PB.format(t='(v>0.5)::INT')}),6) AS bce, round(avg(abs(p-v)),6) AS l1 FROM x GROUP BY 1")
def map_losses(s, d):
    x = _maps(s, d).select(F.expr("vec_id % 10").alias("dataset"), F.explode(F.arrays_zip("p", F.col("view").alias("v"))).alias("c")).select("dataset", "c.*")
    return x.groupBy("dataset").agg(F.round(F.avg(scores.bce("p", (F.col("v") > 0.5).cast("double"))), 6).alias("bce"), F.round(F.avg(F.abs(F.col("p") - F.col("v"))), 6).alias("l1"))
