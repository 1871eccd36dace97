"""Statistics, ranking measures, map measures, confidences, losses and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicketry.functions import scores
from thicketry.functions import vectors as V
from thicketry.operators import metrics as M
from thicketry.plans.catalogue import query
from thicketry.plans.maps import _MAPS, _PIX, _maps
from thicketry.session import table


def _rounded(df, digits=6):
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else c for c, t in df.dtypes))


_Q = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
_QSQL = ", ".join(f"round(quantile_cont(v,{q}),9)+0.0 AS q{int(round(q * 1000)):04d}" for q in _Q)
_STAT = "count(v) AS n, round(avg(v),9)+0.0 AS mean, round(stddev_pop(v),9)+0.0 AS std, round(min(v),9)+0.0 AS min, round(max(v),9)+0.0 AS max, round(avg((v=0)::INT::DOUBLE),9)+0.0 AS zero_share"


@query("score_quantiles", f"SELECT bank_id, {_STAT}, {_QSQL} FROM (SELECT bank_id, CAST(value_score AS DOUBLE) v FROM prototypes WHERE value_score IS NOT NULL) GROUP BY 1")
def score_quantiles(s, d):
    return _rounded(M.distribution(table(s, d, "prototypes").where("value_score is not null"), "value_score", ["bank_id"], _Q), 9)


@query("event_statistics", f"SELECT event_type, {_STAT}, {_QSQL} FROM (SELECT event_type, value v FROM events WHERE value IS NOT NULL) GROUP BY 1")
def event_statistics(s, d):
    return _rounded(M.distribution(table(s, d, "events").where("value is not null"), "value", ["event_type"], _Q), 9)


@query("binary_auc", "WITH r AS (SELECT (label%3=0) AS y, row_number() OVER (ORDER BY CAST(embedding[1] AS DOUBLE), vec_id) AS r FROM embeddings), t AS (SELECT count(*) FILTER (WHERE y) p, count(*) n, sum(r) FILTER (WHERE y) s FROM r) SELECT round((s-p*(p+1)/2)/(p*(n-p)),9) AS auc, p AS n_positive, n-p AS n_negative FROM t")
def binary_auc(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("score"), "label")
    return M.binary_auc(e, "score", F.col("label") % 3 == 0, "vec_id").withColumn("auc", F.round("auc", 9))


def _pred(s, d):
    """The map against the mask of its mirrored view."""
    return _maps(s, d).select("vec_id", "p", F.transform("view", lambda x: (x > 0.5).cast("int")).alias("g"))


@query("map_mae", f"{_PIX}, me AS (SELECT vec_id, avg(abs(p-(v>0.5)::INT)) AS mae FROM x GROUP BY 1) SELECT (vec_id%10) AS dataset, round(avg(mae),6) AS mae, count(*) AS n FROM me GROUP BY 1")
def map_mae(s, d):
    m = _pred(s, d).select(F.expr("vec_id % 10").alias("dataset"), M.mae("p", "g").alias("mae"))
    return m.groupBy("dataset").agg(F.round(F.avg("mae"), 6).alias("mae"), F.count(F.lit(1)).alias("n"))


_AL = "power(2*(({p})-mp)*(({g})-mg)/((({p})-mp)*(({p})-mp)+(({g})-mg)*(({g})-mg)+1e-12)+1,2)/4"


@query(
    "threshold_curves",
    f"""{_PIX}, h AS (SELECT vec_id, floor(p*255)::INT AS level, count(*) FILTER (WHERE v>0.5) AS f, count(*) FILTER (WHERE v<=0.5) AS b FROM x GROUP BY 1,2), t AS (SELECT vec_id, sum(f) fg, sum(b) bg FROM h GROUP BY 1),
    c AS (SELECT t.vec_id, l.level, fg, bg, sum(coalesce(f,0)) OVER w AS tp, sum(coalesce(b,0)) OVER w AS fp FROM t CROSS JOIN (SELECT unnest(range(256))::INT AS level) l LEFT JOIN h ON h.vec_id=t.vec_id AND h.level=l.level WINDOW w AS (PARTITION BY t.vec_id ORDER BY l.level DESC)),
    q AS (SELECT *, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END AS pr, CASE WHEN fg>0 THEN tp/fg ELSE 0 END AS re, (tp+fp)/(fg+bg) AS mp, fg/(fg+bg) AS mg FROM c),
    e AS (SELECT level, pr, re, CASE WHEN pr+re>0 THEN 1.3*pr*re/(0.3*pr+re) ELSE 0 END AS f, CASE WHEN fg=0 THEN 1-mp WHEN bg=0 THEN mp ELSE (tp*{_AL.format(p=1, g=1)}+fp*{_AL.format(p=1, g=0)}+(fg-tp)*{_AL.format(p=0, g=1)}+(bg-fp)*{_AL.format(p=0, g=0)})/(fg+bg) END AS e FROM q)
    SELECT level, round(avg(pr),6) AS precision, round(avg(re),6) AS recall, round(avg(f),6) AS f, round(avg(e),6) AS e FROM e GROUP BY 1""",
)
def threshold_curves(s, d):
    return _rounded(M.threshold_curves(_pred(s, d), "vec_id", "p", "g"))


@query("map_measures")
def map_measures(s, d):
    return _rounded(M.map_measures(_pred(s, d), "vec_id", "p", "g", 8, 8))


@query("hard_targets", f"{_PIX} SELECT vec_id, count(*) FILTER (WHERE p>=0.6 OR p<=0.4) AS kept, count(*) FILTER (WHERE p>=0.6) AS foreground, count(*) FILTER (WHERE abs(p-(v>0.5)::INT)>0.25) AS need, round(avg(CASE WHEN p>=0.6 OR p<=0.4 THEN 1.0 ELSE 0 END),6) AS coverage FROM x GROUP BY 1")
def hard_targets(s, d):
    x = _pixels(s, d)
    target, kept = scores.hard_target("p", 0.6, 0.4)
    n = lambda c: F.count(F.when(c, 1))
    return x.groupBy("vec_id").agg(n(kept).alias("kept"), n(kept & (target == 1)).alias("foreground"), n(scores.needs_correction("p", "g")).alias("need"), F.round(F.avg(kept.cast("double")), 6).alias("coverage"))


def _pixels(s, d):
    x = _maps(s, d).select("vec_id", F.posexplode(F.arrays_zip("p", "view")).alias("cell", "c"))
    return x.select("vec_id", "cell", F.col("c.p").alias("p"), F.col("c.view").alias("v")).withColumn("g", (F.col("v") > 0.5).cast("int"))


@query("error_classes", f"{_PIX}, c AS (SELECT vec_id, CASE WHEN p<0.5 AND v>0.5 THEN 'missed' WHEN p>=0.5 AND v<=0.5 THEN 'false' WHEN abs(p-0.5)<0.1 THEN 'boundary' ELSE 'stable' END AS kind, -(CASE WHEN v>0.5 THEN ln(greatest(1e-6,least(1-1e-6,p))) ELSE ln(1-greatest(1e-6,least(1-1e-6,p))) END) AS loss FROM x) SELECT kind, count(*) AS n, round(avg(loss),6) AS bce FROM c GROUP BY 1")
def error_classes(s, d):
    x = _pixels(s, d).withColumn("edge", (F.abs(F.col("p") - 0.5) < 0.1).cast("int"))
    return x.groupBy(scores.error_class("p", "g", "edge").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(scores.bce("p", "g")), 6).alias("bce"))


#: Which of four sources should serve which class of error.
USAGE = {"missed": (0.6, 0.2, 0.1, 0.1), "false": (0.2, 0.6, 0.1, 0.1), "boundary": (0.1, 0.2, 0.6, 0.1), "stable": (0.1, 0.1, 0.1, 0.7)}
_USE = ", ".join(f"('{k}',{','.join(map(str, v))})" for k, v in USAGE.items())


@query("usage_loss", f"{_PIX}, c AS (SELECT CASE WHEN p<0.5 AND v>0.5 THEN 'missed' WHEN p>=0.5 AND v<=0.5 THEN 'false' WHEN abs(p-0.5)<0.1 THEN 'boundary' ELSE 'stable' END AS kind, p FROM x), u(kind,a,b,c,d) AS (VALUES {_USE}) SELECT kind, round(avg(-(u.a*ln(greatest(p/2,1e-6))+u.b*ln(greatest((1-p)/2,1e-6))+(u.c+u.d)*ln(0.25))),6) AS loss FROM c JOIN u USING (kind) GROUP BY 1")
def usage_loss(s, d):
    x = _pixels(s, d).withColumn("edge", (F.abs(F.col("p") - 0.5) < 0.1).cast("int")).withColumn("kind", scores.error_class("p", "g", "edge"))
    u = s.createDataFrame([(k, *v) for k, v in USAGE.items()], "kind string, a double, b double, c double, d double")
    loss = -(F.col("a") * F.log(F.greatest(F.col("p") / 2, F.lit(1e-6))) + F.col("b") * F.log(F.greatest((1 - F.col("p")) / 2, F.lit(1e-6))) + (F.col("c") + F.col("d")) * F.log(F.lit(0.25)))
    return x.join(F.broadcast(u), "kind").groupBy("kind").agg(F.round(F.avg(loss), 6).alias("loss"))


@query("confidence_product", f"{_PIX} SELECT vec_id, round(avg(abs(2*p-1)*(1-abs(p-v))*(1-4*p*(1-p))*0.8*(0.5+0.5*exp(-abs(p-v)/0.25))),6) AS confidence, round(sum(p*v)/greatest(sum(v),1),6) AS guarded, round(avg(4*p*(1-p)),6) AS uncertainty, round(avg(-(p*ln(p)+(1-p)*ln(1-p))/ln(2)),6) AS entropy, round(avg((abs(p-v)+abs(v-0.5))/2),6) AS contradiction FROM x GROUP BY 1")
def confidence_product(s, d):
    p, v = F.col("p"), F.col("v")
    return _pixels(s, d).groupBy("vec_id").agg(
        F.round(F.avg(scores.confidence(p, F.abs(p - v), scores.uncertainty(p), F.lit(0.8), p - v)), 6).alias("confidence"), F.round(M.guarded_mean(p, v), 6).alias("guarded"),
        F.round(F.avg(scores.uncertainty(p)), 6).alias("uncertainty"), F.round(F.avg(scores.binary_entropy(p)), 6).alias("entropy"), F.round(F.avg(scores.contradiction(p, v, F.lit(0.5))), 6).alias("contradiction"),
    )


@query("masked_statistics", f"{_PIX}, k AS (SELECT vec_id, cell, p, v>0.55 AS m FROM x) SELECT vec_id, round(coalesce(max(p) FILTER (WHERE m),0),6) AS max, round(coalesce(avg(p) FILTER (WHERE m),0),6) AS mean, round(coalesce(stddev_pop(p) FILTER (WHERE m),0),6) AS std, count(*) FILTER (WHERE m) AS n, round(max(p) FILTER (WHERE m),6) AS best, (arg_max(cell, p*1000-cell*1e-9) FILTER (WHERE m))::INT AS best_index, bool_or(m) AS present, round(coalesce(avg(p) FILTER (WHERE p>0.9),0),6) AS high_mean FROM k GROUP BY 1")
def masked_statistics(s, d):
    m = F.col("v") > 0.55
    out = _pixels(s, d).groupBy("vec_id").agg(*M.masked_statistics(F.col("p"), m), *M.masked_best(F.col("p"), F.col("cell"), m), M.conditional_mean(F.col("p"), F.col("p") > 0.9).alias("high_mean"))
    return out.select("vec_id", *(F.round(c, 6).alias(c) for c in ("max", "mean", "std")), "n", F.round("best", 6).alias("best"), "best_index", "present", F.round("high_mean", 6).alias("high_mean"))


@query("weighted_feature_distance", "WITH x AS (SELECT a.vec_id, a.label, list_sum(list_transform(range(1,65), lambda i: CAST(a.embedding[i] AS DOUBLE)*b.embedding[i])) AS c, list_sum(list_transform(range(1,65), lambda i: CASE WHEN abs(CAST(a.embedding[i] AS DOUBLE)-b.embedding[i])<1 THEN 0.5*power(CAST(a.embedding[i] AS DOUBLE)-b.embedding[i],2) ELSE abs(CAST(a.embedding[i] AS DOUBLE)-b.embedding[i])-0.5 END))/64 AS sl, CAST(a.vec_id%5 AS DOUBLE) AS w FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1) SELECT label, round(sum(w*(1-c))/greatest(sum(w),1),6) AS cosine_loss, round(sum(w*sl)/greatest(sum(w),1),6) AS smooth_l1 FROM x GROUP BY 1")
def weighted_feature_distance(s, d):
    e = table(s, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    diff = F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y))
    sl = V.total(F.transform(diff, lambda z: F.when(z < 1, 0.5 * z * z).otherwise(z - 0.5))) / 64
    x = e.join(b, "vec_id").select("label", (1 - V.dot("embedding", "other")).alias("c"), sl.alias("s"), F.expr("cast(vec_id % 5 as double)").alias("w"))
    return x.groupBy("label").agg(F.round(M.guarded_mean(F.col("c"), F.col("w")), 6).alias("cosine_loss"), F.round(M.guarded_mean(F.col("s"), F.col("w")), 6).alias("smooth_l1"))


_DAYS = "SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1,2"


def _days(s, d):
    return table(s, d, "events").where("value is not null").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("v"))


@query("persistence_alarm", f"WITH e AS ({_DAYS}) SELECT event_type, strftime(day,'%Y-%m-%d') AS day, (min((v>10)::INT) OVER w = 1 AND count(*) OVER w = 3) AS alarm, round(CASE WHEN count(*) OVER w = 3 THEN v-first_value(v) OVER w END,6)+0.0 AS trend FROM e WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def persistence_alarm(s, d):
    e = M.trend(M.persistent(_days(s, d), ["event_type"], "day", F.col("v") > 10), ["event_type"], "day", "v")
    return e.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "alarm", (F.round("trend", 6) + 0.0).alias("trend"))


@query("moving_average_fold", f"WITH e AS ({_DAYS}), k AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day DESC)-1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM e) SELECT event_type, round(sum(power(0.9,k)*CASE WHEN k=n-1 THEN 1 ELSE 0.1 END*v),6) AS ema, max(n) AS n FROM k GROUP BY 1")
def moving_average_fold(s, d):
    return M.moving_average_fold(_days(s, d), ["event_type"], "day", "v", 0.9).withColumn("ema", F.round("ema", 6))


@query("stage_ramp", "SELECT step_no, round(greatest(0,least(1,(step_no-5)/20.0)),6) AS ramp, count(*) AS n FROM acquisition GROUP BY 1")
def stage_ramp(s, d):
    return table(s, d, "acquisition").groupBy("step_no").agg(F.count(F.lit(1)).alias("n")).select("step_no", F.round(scores.ramp("step_no", 5, 25), 6).alias("ramp"), "n")


@query("latency_statistics", "WITH l AS (SELECT event_type, epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS us FROM events) SELECT event_type, count(us) AS n, round(avg(us/1e6),5) AS mean, round(quantile_cont(us/1e6,0.5),5) AS p50, round(quantile_cont(us/1e6,0.95),5) AS p95, round(count(us)/sum(us/1e6),6) AS per_second FROM l GROUP BY 1")
def latency_statistics(s, d):
    """Seconds between the events of a type: neither the order nor the quantiles take a type as a whole."""
    from thicketry.operators import relations as R

    e = table(s, d, "events").select("event_type", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    x = R.lagged(e, ["event_type"], ["ts", "event_id"], "us", "before").select("event_type", ((F.col("us") - F.col("before")) / 1e6).alias("v"))
    q = M.distribution(x, "v", ["event_type"], (0.5, 0.95))
    return q.select("event_type", "n", F.round("mean", 5).alias("mean"), F.round("q0500", 5).alias("p50"), F.round("q0950", 5).alias("p95"), F.round(1 / F.col("mean"), 6).alias("per_second"))
