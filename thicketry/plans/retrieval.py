"""Retrieval over a memory: embeddings are parents, their label the image they belong to."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicketry.functions import scores
from thicketry.operators import relations as R
from thicketry.operators import retrieval as T
from thicketry.plans.catalogue import query
from thicketry.plans.vectors import cos_sql
from thicketry.session import table

_HITS = f"""WITH q AS (SELECT vec_id AS query, embedding e FROM embeddings WHERE vec_id%100=0), h AS (SELECT query, vec_id, round({cos_sql('q.e', 'b.embedding')},9)+0.0 AS score FROM q JOIN embeddings b ON b.vec_id<>q.query),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM h) WHERE rank<=8)"""
_SOFT = _HITS + ", m AS (SELECT *, max(score) OVER (PARTITION BY query) mx FROM hits), w AS (SELECT query, vec_id, score, rank, exp((score-mx)/0.1)/sum(exp((score-mx)/0.1)) OVER (PARTITION BY query) AS weight FROM m)"


def _hits(s, d):
    """The stated query set, ids divisible by 100, against all rows."""
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return T.top_k(q, "query", e, "vec_id", "embedding", 8)


def _weighted(s, d):
    return T.masked_softmax(_hits(s, d), "query", "score", 0.1)


@query("route_top_k", f"{_HITS} SELECT query, vec_id, round(score,6)+0.0 AS score, rank FROM hits")
def route_top_k(s, d):
    return _hits(s, d).select("query", "vec_id", (F.round("score", 6) + 0.0).alias("score"), "rank")


@query("route_margin_confidence", f"{_HITS}, g AS (SELECT query, max(score) FILTER (WHERE rank=1) - max(score) FILTER (WHERE rank=2) AS m FROM hits GROUP BY 1) SELECT query, round(m,6)+0.0 AS margin, round(coalesce(greatest(1/(1+exp(-m/0.1)),0.1),0.1),6) AS confidence FROM g")
def route_margin_confidence(s, d):
    m = T.margins(_hits(s, d), "query", "score", "rank")
    return m.select("query", (F.round("margin", 6) + 0.0).alias("margin"), F.round(scores.margin_confidence("margin"), 6).alias("confidence"))


@query("route_entropy", f"{_SOFT} SELECT query, count(*) AS n_hits, round(-sum(weight*ln(greatest(weight,1e-6)))/ln(count(*)),6) AS entropy FROM w GROUP BY 1")
def route_entropy(s, d):
    return T.hit_entropy(_weighted(s, d), "query", "weight").withColumn("entropy", F.round("entropy", 6))


@query("region_vote", f"{_SOFT}, v AS (SELECT query, sum(CASE WHEN vec_id%4=0 THEN weight ELSE 0 END) p0, sum(CASE WHEN vec_id%4=1 THEN weight ELSE 0 END) p1, sum(CASE WHEN vec_id%4=2 THEN weight ELSE 0 END) p2, sum(CASE WHEN vec_id%4=3 THEN weight ELSE 0 END) p3 FROM w GROUP BY 1) SELECT query, round(p0,6) AS p0, round(p1,6) AS p1, round(p2,6) AS p2, round(p3,6) AS p3, round(p0+p2,6) AS fg, round(p1+p3,6) AS bg, round(abs(p0+p2-p1-p3),6) AS margin FROM v")
def region_vote(s, d):
    v = T.region_vote(_weighted(s, d).withColumn("region", F.pmod("vec_id", F.lit(4))), "query", "region", "weight")
    return v.select("query", *(F.round(c, 6).alias(c) for c in ("p0", "p1", "p2", "p3", "fg", "bg", "margin")))


@query("vote_nll", f"{_SOFT}, t AS (SELECT query, sum(CASE WHEN vec_id%4=query%4 THEN weight ELSE 0 END) p FROM w GROUP BY 1) SELECT round(avg(-ln(greatest(p,1e-6))),6) AS loss, count(*) AS n FROM t")
def vote_nll(s, d):
    t = _weighted(s, d).groupBy("query").agg(F.sum(F.when(F.pmod("vec_id", F.lit(4)) == F.pmod("query", F.lit(4)), F.col("weight")).otherwise(0.0)).alias("p"))
    return t.agg(F.round(F.avg(-F.log(F.greatest("p", F.lit(1e-6)))), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


@query("standardized_scores", f"{_HITS} SELECT query, vec_id, round(1/(1+exp(-(score-avg(score) OVER (PARTITION BY query))/greatest(stddev_pop(score) OVER (PARTITION BY query),1e-6))),6) AS z FROM hits")
def standardized_scores(s, d):
    return T.standardized(_hits(s, d), "query", "score").select("query", "vec_id", F.round("z", 6).alias("z"))


@query("top_accuracy", f"{_HITS}, l AS (SELECT h.query, h.rank, a.label=b.label AS hit FROM hits h JOIN embeddings a ON a.vec_id=h.query JOIN embeddings b ON b.vec_id=h.vec_id), p AS (SELECT query, bool_or(hit AND rank=1) a, bool_or(hit AND rank<=5) b FROM l GROUP BY 1) SELECT round(avg(a::INT::DOUBLE),6) AS top1, round(avg(b::INT::DOUBLE),6) AS topk, count(*) AS n_queries FROM p")
def top_accuracy(s, d):
    label = table(s, d, "embeddings").select("vec_id", "label")
    h = _hits(s, d).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query"), F.col("label").alias("own")), "query")
    a = T.top_accuracy(h, "query", "rank", F.col("label") == F.col("own"), 5)
    return a.select(F.round("top1", 6).alias("top1"), F.round("topk", 6).alias("topk"), "n_queries")


_LOGITS = f"SELECT q.vec_id AS query, b.vec_id, {cos_sql('q.embedding', 'b.embedding')}/0.1 AS l FROM embeddings q JOIN embeddings b ON q.vec_id%100=0"


@query("contrastive_loss", f"WITH l AS ({_LOGITS}), m AS (SELECT *, max(l) OVER (PARTITION BY query) mx FROM l) SELECT query, round(ln(sum(exp(l-mx)))+max(mx)-max(l) FILTER (WHERE vec_id=query),6) AS loss FROM m GROUP BY 1")
def contrastive_loss(s, d):
    """The logits of all rows; the row of the query's own image is the positive one."""
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("vec_id").alias("image"), "embedding")
    return T.contrastive_loss(q, "query", "image", e, "vec_id", "embedding", 0.1).withColumn("loss", F.round("loss", 6))


@query("positive_rows", "SELECT vec_id AS query, vec_id FROM embeddings WHERE vec_id%100=0")
def positive_rows(s, d):
    q = table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("vec_id").alias("image"))
    return T.positive_rows(q, "query", "image", table(s, d, "embeddings"), "vec_id")


_ROUTED = f"""WITH q AS (SELECT vec_id AS query, embedding e FROM embeddings WHERE vec_id%100=0), r AS (SELECT query, unnest([query%10, (query+3)%10])::INT AS label FROM q),
    h AS (SELECT q.query, b.vec_id, round({cos_sql('q.e', 'b.embedding')},9)+0.0 AS score FROM r JOIN embeddings b USING (label) JOIN q USING (query) WHERE b.vec_id<>q.query)
    SELECT query, vec_id, round(score,6)+0.0 AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM h) WHERE rank<=8"""


@query("routed_parents", _ROUTED)
def routed_parents(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    routes = q.select("query", F.explode(F.array(F.expr("cast(query % 10 as int)"), F.expr("cast((query + 3) % 10 as int)"))).alias("label"))
    return T.routed_top_k(q, "query", routes, "label", e, "vec_id", "embedding", 8).withColumn("score", F.round("score", 6) + 0.0)


@query("child_lookup", "WITH p AS (SELECT vec_id AS parent, label AS image, CASE WHEN vec_id%7=0 THEN -1 ELSE vec_id+10 END AS ptr FROM embeddings) SELECT parent, ptr, c.vec_id IS NOT NULL AS found, round(CAST(c.embedding[1] AS DOUBLE),6)+0.0 AS first FROM p LEFT JOIN embeddings c ON c.vec_id=p.ptr AND c.label=p.image")
def child_lookup(s, d):
    e = table(s, d, "embeddings")
    p = e.select(F.col("vec_id").alias("parent"), F.col("label").alias("image"), F.expr("case when vec_id % 7 = 0 then -1L else vec_id + 10 end").alias("ptr"))
    c = R.follow_pointer(p, "ptr", e.select(F.col("vec_id").alias("child"), "label", (F.round(F.col("embedding")[0].cast("double"), 6) + 0.0).alias("first")), "child", [("image", "label")], ["first"])
    return c.select("parent", "ptr", "found", "first")
