"""Memory banks and caches: audits, appends, sizes, decisions; identities and acceptance of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicketry.operators import banks as B
from thicketry.operators import relations as R
from thicketry.operators.relations import numbered
from thicketry.plans.catalogue import query
from thicketry.session import table

_FINITE = "(proto IS NOT NULL AND len(proto)=128 AND len(list_filter(proto, lambda x: isnan(x) OR isinf(x)))=0)"


@query(
    "bank_audit",
    f"""WITH c AS (SELECT bank_id, count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce(value_score BETWEEN 0 AND 1, false)) AS n_value, count(*) FILTER (WHERE NOT {_FINITE}) AS n_vector, count(*) FILTER (WHERE is_valid IS NULL) AS n_flag FROM prototypes GROUP BY 1),
    d AS (SELECT bank_id, sum(n-1)::BIGINT AS n_repeated FROM (SELECT bank_id, sample_key, count(*) n FROM prototypes GROUP BY 1,2) GROUP BY 1),
    u AS (SELECT bank_id, count(*) FILTER (WHERE sample_key IS NOT NULL AND sample_key NOT IN (SELECT sample_key FROM kmeans_result WHERE sample_key IS NOT NULL)) AS n_unknown FROM prototypes GROUP BY 1)
    SELECT c.*, n_repeated, n_unknown, CASE WHEN n_vector>0 THEN 'vector' WHEN n_value>0 THEN 'value' WHEN n_flag>0 THEN 'flag' WHEN n_repeated>0 THEN 'repeated' WHEN n_unknown>0 THEN 'unknown' END AS refused FROM c JOIN d USING (bank_id) JOIN u USING (bank_id)""",
)
def bank_audit(s, d):
    """Ranges, uniqueness and references of every bank, and the first rule it breaks."""
    p = table(s, d, "prototypes").where("bank_id is not null")
    v = F.col("proto")
    rules = {"n_value": F.col("value_score").between(0, 1), "n_vector": (F.size(v) == 128) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))), "n_flag": F.col("is_valid").isNotNull()}
    out = B.violations(p, ["bank_id"], rules).join(B.repeated_rows(p, ["bank_id"], ["sample_key"]), "bank_id")
    out = out.join(B.missing_references(p, ["bank_id"], "sample_key", table(s, d, "kmeans_result"), "sample_key"), "bank_id")
    return out.withColumn("refused", R.first_failed(*((n, F.col(f"n_{n}") == 0) for n in ("vector", "value", "flag", "repeated", "unknown"))))


@query(
    "bank_append",
    """WITH l AS (SELECT vec_id, vec_id%3 AS bank, row_number() OVER (PARTITION BY vec_id%3 ORDER BY vec_id)-1 AS i, count(*) OVER (PARTITION BY vec_id%3) AS n FROM embeddings), o AS (SELECT bank, sum(n) OVER (ORDER BY bank)-n AS o FROM (SELECT DISTINCT bank, n FROM l))
    SELECT vec_id, (i+o)::BIGINT AS row_index, (CASE WHEN i+1<n THEN i+1+o ELSE -1 END)::BIGINT AS child FROM l JOIN o USING (bank)""",
)
def bank_append(s, d):
    """Three banks, each numbered from 0, with pointers to their next rows, in one."""

    def bank(k):
        e = numbered(table(s, d, "embeddings").where(F.col("vec_id") % 3 == k).select("vec_id"), "vec_id")
        n = e.agg(F.count(F.lit(1)).alias("_n"))
        return e.crossJoin(F.broadcast(n)).select("vec_id", F.col("position").alias("row_index"), F.when(F.col("position") + 1 < F.col("_n"), F.col("position") + 1).otherwise(-1).alias("child"))

    return B.appended([bank(k) for k in range(3)], "row_index", ["child"])


@query("bank_bytes", "SELECT bank_id, sum(len(proto)*4)::BIGINT AS n_bytes FROM (SELECT DISTINCT bank_id, proto FROM prototypes WHERE bank_id IS NOT NULL AND proto IS NOT NULL) GROUP BY 1")
def bank_bytes(s, d):
    return B.stored_bytes(table(s, d, "prototypes").where("bank_id is not null"), ["bank_id"], {"proto": 4})


@query("bank_decisions", "SELECT bank_id, CASE WHEN ok THEN 'use' ELSE 'without' END AS lenient, CASE WHEN ok THEN 'use' ELSE 'fail' END AS strict, CASE WHEN ok THEN 'use' ELSE 'without' END AS diagnostic FROM memory_banks")
def bank_decisions(s, d):
    """What becomes of a bank that is not known to be compatible, by policy."""
    b = table(s, d, "memory_banks")
    refused = F.when(~F.coalesce("ok", F.lit(False)), F.coalesce("reason", F.lit("unknown")))
    for name, how in (("lenient", (False,)), ("strict", (True,)), ("diagnostic", (True, True))):
        b = B.admitted(b, refused, *how).withColumnRenamed("decision", name)
    return b.select("bank_id", "lenient", "strict", "diagnostic")


_RUNS = "SELECT run_id, max(parent_run_id) AS par, max(run_mode) AS mode, count(DISTINCT split_level) AS levels, string_agg(DISTINCT budget::VARCHAR, '-' ORDER BY budget::VARCHAR) AS budgets FROM split_rows WHERE run_id IS NOT NULL GROUP BY 1"


@query("identity_mismatches", f"WITH r AS ({_RUNS}) SELECT a.run_id, concat_ws(',', CASE WHEN a.mode IS DISTINCT FROM b.mode THEN 'mode' END, CASE WHEN a.levels IS DISTINCT FROM b.levels THEN 'levels' END, CASE WHEN a.budgets IS DISTINCT FROM b.budgets THEN 'budgets' END) AS mismatches FROM r a JOIN r b ON b.run_id=a.par")
def identity_mismatches(s, d):
    """Every field in which a run's identity differs from that of the run it repeats."""
    rows = table(s, d, "split_rows").where("run_id is not null")
    budgets = F.array_join(F.array_sort(F.collect_set(F.col("budget").cast("string"))), "-")
    r = rows.groupBy("run_id").agg(F.max("parent_run_id").alias("par"), F.max("run_mode").alias("mode"), F.countDistinct("split_level").alias("levels"), budgets.alias("budgets"))
    b = r.select(F.col("run_id").alias("par"), *(F.col(c).alias(f"_{c}") for c in ("mode", "levels", "budgets")))
    wrong = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in ("mode", "levels", "budgets")]
    return r.join(b, "par").select("run_id", F.concat_ws(",", *wrong).alias("mismatches"))


_ACQ = "SELECT DISTINCT run_id, step_no, sample_key, utility, value_score, novelty FROM acquisition WHERE utility IS NOT NULL AND value_score IS NOT NULL AND novelty IS NOT NULL AND NOT isnan(utility) AND NOT isnan(value_score) AND NOT isnan(novelty)"


@query("score_invariant", f"WITH a AS ({_ACQ}), e AS (SELECT *, abs(utility-value_score*(1+novelty)) AS err, 1e-6+1e-5*abs(value_score*(1+novelty)) AS tol FROM a) SELECT run_id, count(*) AS n, count(*) FILTER (WHERE err>tol) AS n_bad, round(max(err),6) AS largest FROM e GROUP BY 1")
def score_invariant(s, d):
    """How far recorded utilities are from their formula, with an absolute and a relative tolerance."""
    cols = ["utility", "value_score", "novelty"]
    a = table(s, d, "acquisition").select("run_id", "step_no", "sample_key", *cols).distinct()
    for c in cols:
        a = a.where(F.col(c).isNotNull() & ~F.isnan(c))
    want = F.col("value_score") * (1 + F.col("novelty"))
    a = a.select("run_id", F.abs(F.col("utility") - want).alias("err"), (1e-6 + 1e-5 * F.abs(want)).alias("tol"))
    return a.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("err") > F.col("tol"), 1)).alias("n_bad"), F.round(F.max("err"), 6).alias("largest"))


@query(
    "acceptance_audit",
    """WITH l AS (SELECT DISTINCT run_id, split_level lv, sample_key k FROM split_rows WHERE run_id IS NOT NULL AND split_level IS NOT NULL AND sample_key IS NOT NULL), b AS (SELECT run_id, split_level lv, max(budget) b FROM split_rows WHERE run_id IS NOT NULL AND split_level IS NOT NULL GROUP BY 1,2),
    n AS (SELECT run_id, lv, count(*) n FROM l GROUP BY 1,2), lost AS (SELECT a.run_id, count(*) FILTER (WHERE c.k IS NULL) AS lost FROM l a JOIN n x ON x.run_id=a.run_id AND x.lv=a.lv+1 LEFT JOIN l c ON c.run_id=a.run_id AND c.lv=a.lv+1 AND c.k=a.k GROUP BY 1),
    r AS (SELECT b.run_id, count(*) AS levels, bool_and(coalesce(n.n,0)=b.b) AS exact, bool_and(coalesce(b.b>p.b, true)) AS rising FROM b LEFT JOIN n USING (run_id, lv) LEFT JOIN b p ON p.run_id=b.run_id AND p.lv=b.lv-1 GROUP BY 1)
    SELECT r.run_id, levels, coalesce(lost,0) AS lost, CASE WHEN levels<>3 THEN 'levels' WHEN NOT rising THEN 'budgets' WHEN NOT exact THEN 'counts' WHEN coalesce(lost,0)>0 THEN 'nesting' END AS refused FROM r LEFT JOIN lost USING (run_id)""",
)
def acceptance_audit(s, d):
    """Whether a run has three levels, rising budgets, as many keys as each budget, and each list within the next; the first rule it breaks."""
    from pyspark.sql import Window

    rows = table(s, d, "split_rows").where("run_id is not null and split_level is not null")
    keys = rows.where("sample_key is not null").select("run_id", "split_level", "sample_key").distinct()
    n = keys.groupBy("run_id", "split_level").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("run_id").orderBy("split_level")  # a row a level
    b = rows.groupBy("run_id", "split_level").agg(F.max("budget").alias("b")).join(n, ["run_id", "split_level"], "left")
    before = F.when(F.lag("split_level").over(by) == F.col("split_level") - 1, F.lag("b").over(by))
    b = b.withColumn("rising", F.coalesce(F.col("b") > before, F.lit(True)))
    out = b.groupBy("run_id").agg(F.count(F.lit(1)).alias("levels"), F.bool_and(F.coalesce("n", F.lit(0)) == F.col("b")).alias("exact"), F.bool_and("rising").alias("rising"))
    up = keys.select("run_id", (F.col("split_level") - 1).alias("split_level"), "sample_key", F.lit(True).alias("_there"))
    due = keys.join(n.select("run_id", (F.col("split_level") - 1).alias("split_level")), ["run_id", "split_level"], "left_semi")
    lost = due.join(up, ["run_id", "split_level", "sample_key"], "left").groupBy("run_id").agg(F.count(F.when(F.col("_there").isNull(), 1)).alias("lost"))
    out = out.join(lost, "run_id", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    rules = (("levels", F.col("levels") == 3), ("budgets", F.col("rising")), ("counts", F.col("exact")), ("nesting", F.col("lost") == 0))
    return out.select("run_id", "levels", "lost", R.first_failed(*rules).alias("refused"))


@query("subset_quota_check", "SELECT run_id, split_part(sample_key,'/',1) AS subset_name, count(DISTINCT sample_key) AS n, count(DISTINCT sample_key)>=2 AS enough FROM split_rows WHERE split_level=1 AND sample_key IS NOT NULL GROUP BY 1,2")
def subset_quota_check(s, d):
    """How many keys of each subset the first list of a run has, against a fixed number."""
    x = table(s, d, "split_rows").where("split_level = 1 and sample_key is not null")
    n = F.countDistinct("sample_key")
    return x.groupBy("run_id", F.split_part("sample_key", F.lit("/"), F.lit(1)).alias("subset_name")).agg(n.alias("n"), (n >= 2).alias("enough"))
