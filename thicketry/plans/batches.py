"""Orders, shards and batches over keys: overall ranks, dropped tails, repetition to a size, epochs, thresholds with a fall-back."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicketry.functions import keys
from thicketry.operators import relations as R
from thicketry.operators import selection as S
from thicketry.plans.catalogue import query
from thicketry.session import table

_KEYS = "SELECT DISTINCT sample_key AS k FROM image_catalog WHERE sample_key IS NOT NULL"


def _keys(s, d):
    return table(s, d, "image_catalog").where("sample_key is not null").select("sample_key").distinct()


@query("prefix_subset", "SELECT item_id, sample_key FROM image_catalog WHERE starts_with(sample_key, 'TR-MARSH/')")
def prefix_subset(s, d):
    """The rows of one subset by the beginning of their key, which reaches the scan."""
    return table(s, d, "image_catalog").where(F.col("sample_key").startswith("TR-MARSH/")).select("item_id", "sample_key")


@query(
    "overall_rank",
    """WITH f AS (SELECT run_id, sample_key, min(split_level) AS lv, min(coalesce(selection_order, 1000000000)) AS o FROM split_rows WHERE run_id IS NOT NULL AND sample_key IS NOT NULL AND split_level IS NOT NULL GROUP BY 1,2)
    SELECT run_id, sample_key, row_number() OVER (PARTITION BY run_id ORDER BY lv, o, sample_key) AS rank, lv<=1 AS selected_1, lv<=2 AS selected_2, lv<=3 AS selected_3 FROM f""",
)
def overall_rank(s, d):
    """One rank of a run over all its levels, and whether a key is in at each; no run is ranked in one task."""
    x = table(s, d, "split_rows").where("run_id is not null and sample_key is not null and split_level is not null")
    f = x.groupBy("run_id", "sample_key").agg(F.min("split_level").alias("lv"), F.min(F.coalesce("selection_order", F.lit(1_000_000_000))).alias("o"))
    n = S.ranked(f, ["run_id"], ["lv", "o", "sample_key"])
    return n.select("run_id", "sample_key", "rank", *((F.col("lv") <= i).alias(f"selected_{i}") for i in (1, 2, 3)))


@query("rank_shards", f"WITH n AS (SELECT k AS sample_key, row_number() OVER (ORDER BY k)-1 AS p, count(*) OVER () AS n FROM ({_KEYS})) SELECT sample_key, (p%7)::INT AS shard FROM n WHERE p < n-n%7")
def rank_shards(s, d):
    """Seven shards of equal size; the tail that does not fill a round is left out."""
    return S.equal_shards(_keys(s, d), "sample_key", 7)


@query("epoch_order", f"SELECT k AS sample_key, epoch::INT AS epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5('3-'||epoch||'|'||k), k)-1 AS position FROM ({_KEYS}), (SELECT unnest([0,1]) AS epoch)")
def epoch_order(s, d):
    """Another order of all keys in each epoch, the same in every run."""
    k = _keys(s, d).withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    k = k.withColumn("_o", F.md5(F.concat(F.lit("3-"), F.col("epoch").cast("string"), F.lit("|"), "sample_key")))
    return S.ranked(k, ["epoch"], ["_o", "sample_key"]).select("sample_key", "epoch", (F.col("rank") - 1).alias("position"))


@query(
    "oversampled",
    f"""WITH c AS ({_KEYS}), l AS (SELECT DISTINCT sample_key k FROM split_rows WHERE sample_key IS NOT NULL), u AS (SELECT k, row_number() OVER (ORDER BY k)-1 r FROM c WHERE k NOT IN (SELECT k FROM l)), h AS (SELECT k, row_number() OVER (ORDER BY k)-1 r, count(*) OVER () n FROM c WHERE k IN (SELECT k FROM l))
    SELECT u.k AS unlisted, h.k AS listed, u.r AS position FROM u JOIN h ON u.r % h.n = h.r""",
)
def oversampled(s, d):
    """The listed keys again and again up to the number of those that no list holds."""
    c, lists = _keys(s, d), table(s, d, "split_rows").select("sample_key")
    return R.cyclic_zip(c.join(lists, "sample_key", "left_anti").withColumnRenamed("sample_key", "unlisted"), "unlisted", c.join(lists, "sample_key", "left_semi").withColumnRenamed("sample_key", "listed"), "listed")


_CELL = "WITH x AS (SELECT vec_id, (generate_subscripts(embedding,1)-1)::INT AS cell, abs(CAST(unnest(embedding) AS DOUBLE)) AS score FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cell) AS rank, count(*) FILTER (WHERE score>=0.2) OVER (PARTITION BY vec_id) AS over, count(*) OVER (PARTITION BY vec_id) AS n FROM x)"


@query("threshold_cells", f"{_CELL} SELECT vec_id, cell, rank FROM r WHERE rank <= CASE WHEN over<6 THEN least(greatest(6,round_even(n*0.12,0)),10,n) ELSE least(over,10) END")
def threshold_cells(s, d):
    """Cells from a threshold up, the best of a share where these are too few, at most ten."""
    x = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("cell", "v")).select("vec_id", "cell", F.abs(F.col("v").cast("double")).alias("score"))
    return S.threshold_top(x, "vec_id", "score", "cell", 0.2, 0.12, 6, 10).select("vec_id", "cell", "rank")


@query("listed_line_fingerprints", "WITH l AS (SELECT DISTINCT run_id, split_level, sample_key, budget FROM split_rows WHERE sample_key IS NOT NULL AND run_id IS NOT NULL AND split_level IS NOT NULL) SELECT run_id, split_level, sha256(string_agg(sample_key||chr(9)||coalesce(budget::VARCHAR,'')||chr(9)||sha256(sample_key)||chr(10), '' ORDER BY sample_key, budget)) AS fingerprint FROM l GROUP BY 1,2")
def listed_line_fingerprints(s, d):
    """A second recipe: a line of key, number and digest each, joined by tabs; a list of a run is bounded by its budget."""
    x = table(s, d, "split_rows").where("sample_key is not null and run_id is not null and split_level is not null").select("run_id", "split_level", "sample_key", "budget").distinct()
    line = lambda r: F.concat(r["sample_key"], F.lit("\t"), F.coalesce(r["budget"].cast("string"), F.lit("")), F.lit("\t"), F.sha2(r["sample_key"], 256), F.lit("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_key", "budget"))), line), "")
    return x.groupBy("run_id", "split_level").agg(F.sha2(text, 256).alias("fingerprint"))


@query("level_audit", "SELECT sample_key, min(CASE WHEN split_level=1 THEN selection_order END) AS rank_1, coalesce(bool_or(split_level=1),false) AS selected_1, min(CASE WHEN split_level=2 THEN selection_order END) AS rank_2, coalesce(bool_or(split_level=2),false) AS selected_2, min(CASE WHEN split_level=3 THEN selection_order END) AS rank_3, coalesce(bool_or(split_level=3),false) AS selected_3, printf('%.10f', coalesce(avg(selection_order),0)) AS mean_order FROM split_rows WHERE sample_key IS NOT NULL GROUP BY 1")
def level_audit(s, d):
    """One row a key with a rank and whether it was selected for each budget, numbers in fixed decimals."""
    x = table(s, d, "split_rows").where("sample_key is not null")
    at = F.col("split_level")
    pairs = [c for i in (1, 2, 3) for c in (F.min(F.when(at == i, F.col("selection_order"))).alias(f"rank_{i}"), F.coalesce(F.bool_or(at == i), F.lit(False)).alias(f"selected_{i}"))]
    return x.groupBy("sample_key").agg(*pairs, keys.fixed(F.coalesce(F.avg("selection_order"), F.lit(0.0))).alias("mean_order"))
