"""Catalog, splits, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicketry.functions import fingerprints, keys
from thicketry.operators import relations as R
from thicketry.operators import selection as S
from thicketry.plans.catalogue import query
from thicketry.session import table

KEYED = "sample_key is not null"
_LISTS = "SELECT DISTINCT run_id, split_level, sample_key FROM split_rows"


@query("catalog_keys", "SELECT DISTINCT sample_key, split_part(sample_key,'/',1) AS subset_name, regexp_extract(sample_key,'[^/]*$') AS stem, concat_ws('/', split_part(sample_key,'/',1), regexp_extract(sample_key,'[^/]*$')) AS rebuilt FROM image_catalog WHERE sample_key IS NOT NULL")
def catalog_keys(s, d):
    k = table(s, d, "image_catalog").where(KEYED).select("sample_key").distinct()
    k = k.withColumn("subset_name", keys.first_part("sample_key")).withColumn("stem", F.substring_index("sample_key", "/", -1))
    return k.withColumn("rebuilt", keys.sample_key("subset_name", "stem"))


@query("catalog_duplicates", "SELECT sample_key, count(*) AS n FROM image_catalog WHERE sample_key IS NOT NULL GROUP BY 1 HAVING count(*)>1")
def catalog_duplicates(s, d):
    return R.duplicates(table(s, d, "image_catalog").where(KEYED), "sample_key")


@query(
    "path_parts",
    r"""WITH p AS (SELECT item_id, replace(path,'\','/') AS q FROM image_catalog WHERE path IS NOT NULL)
    SELECT item_id, lower(regexp_extract(regexp_extract(q,'[^/]*$'),'\.([A-Za-z0-9]+)$',1)) AS ending, regexp_replace(regexp_extract(q,'[^/]*$'),'\.[A-Za-z0-9]+$','') AS stem,
    regexp_extract(q,'([^/]+)/im/[^/]*$',1) AS subset_of_path, lower(regexp_extract(regexp_extract(q,'[^/]*$'),'\.([A-Za-z0-9]+)$',1)) IN ('png','jpg','jpeg') AS image,
    NOT (starts_with(q,'/') OR regexp_matches(q,'^[A-Za-z]+:') OR regexp_matches(q,'(^|/)\.\.(/|$)')) AS safe FROM p""",
)
def path_parts(s, d):
    p = table(s, d, "image_catalog").where("path is not null")
    return p.select("item_id", keys.ending("path").alias("ending"), keys.stem("path").alias("stem"), keys.subset_of_path("path").alias("subset_of_path"), keys.is_image("path").alias("image"), keys.is_safe_path("path").alias("safe"))


@query(
    "first_match_lookup",
    r"""WITH p AS (SELECT sample_key, path, lower(regexp_extract(path,'\.([A-Za-z0-9]+)$',1)) AS e FROM image_catalog WHERE sample_key IS NOT NULL AND path IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample_key ORDER BY CASE e WHEN 'png' THEN 0 WHEN 'jpg' THEN 1 WHEN 'jpeg' THEN 2 ELSE 3 END, path) AS k FROM p)
    SELECT sample_key, path, e AS ending FROM r WHERE k=1""",
)
def first_match_lookup(s, d):
    p = table(s, d, "image_catalog").where("sample_key is not null and path is not null").select("sample_key", "path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ending"))
    rank = F.coalesce(*(F.when(F.col("ending") == e, F.lit(i)) for i, e in enumerate(keys.IMAGE_ENDINGS)), F.lit(3))
    return R.first_per_key(p, "sample_key", rank, F.col("path"))


@query(
    "labeled_semi",
    """WITH l AS (SELECT DISTINCT sample_key k FROM split_rows WHERE split_level=1), c AS (SELECT DISTINCT sample_key, regexp_extract(sample_key,'[^/]*$') AS stem FROM image_catalog WHERE sample_key IS NOT NULL)
    SELECT sample_key, stem FROM c WHERE sample_key IN (SELECT k FROM l) OR stem IN (SELECT k FROM l)""",
)
def labeled_semi(s, d):
    c = table(s, d, "image_catalog").where(KEYED).select("sample_key", F.substring_index("sample_key", "/", -1).alias("stem")).distinct()
    return R.semi_by_either(c, "sample_key", "stem", table(s, d, "split_rows").where("split_level = 1"), "sample_key")


@query("unlabeled_anti", "SELECT DISTINCT sample_key FROM image_catalog WHERE sample_key IS NOT NULL AND sample_key NOT IN (SELECT sample_key FROM split_rows WHERE sample_key IS NOT NULL)")
def unlabeled_anti(s, d):
    return table(s, d, "image_catalog").where(KEYED).select("sample_key").distinct().join(table(s, d, "split_rows"), "sample_key", "left_anti")


@query(
    "resolved_names",
    r"""WITH k AS (SELECT DISTINCT sample_key k FROM image_catalog WHERE sample_key IS NOT NULL), st AS (SELECT regexp_extract(k,'[^/]*$') st, count(*) n, min(k) m FROM k GROUP BY 1),
    n AS (SELECT DISTINCT sample_key AS name, regexp_replace(sample_key,'\.(png|jpe?g)$','','i') AS bare FROM split_rows WHERE sample_key IS NOT NULL)
    SELECT n.name, coalesce(a.k, b.k, CASE WHEN st.n=1 THEN st.m END) AS resolved, CASE WHEN a.k IS NOT NULL THEN 'exact' WHEN b.k IS NOT NULL THEN 'ending' WHEN st.n=1 THEN 'stem' WHEN st.n>1 THEN 'ambiguous' ELSE 'unknown' END AS kind
    FROM n LEFT JOIN k a ON a.k=n.name LEFT JOIN k b ON b.k=n.bare LEFT JOIN st ON st.st=regexp_extract(n.bare,'[^/]*$')""",
)
def resolved_names(s, d):
    return R.resolve_names(table(s, d, "split_rows"), "sample_key", table(s, d, "image_catalog"), "sample_key")


@query(
    "coalesced_lookup",
    """WITH t AS (SELECT sample_key k, min(bank_id) v FROM prototypes GROUP BY 1), r AS (SELECT DISTINCT run_id, split_level, sample_key, replace(sample_key,' ','') AS bare FROM split_rows)
    SELECT run_id, split_level, sample_key, bare, coalesce(a.v,b.v) AS bank_id FROM r LEFT JOIN t a ON a.k=r.sample_key LEFT JOIN t b ON b.k=r.bare""",
)
def coalesced_lookup(s, d):
    t = table(s, d, "prototypes").groupBy("sample_key").agg(F.min("bank_id").alias("bank_id"))
    r = table(s, d, "split_rows").select("run_id", "split_level", "sample_key").distinct().withColumn("bare", F.replace("sample_key", F.lit(" "), F.lit("")))
    return R.coalesced_lookup(r, ["sample_key", "bare"], t, "sample_key", "bank_id", "bank_id")


@query("subset_counts", "SELECT split_part(sample_key,'/',1) AS subset_name, count(*) AS n, count(DISTINCT sample_key) AS n_keys FROM image_catalog WHERE sample_key IS NOT NULL GROUP BY 1")
def subset_counts(s, d):
    return table(s, d, "image_catalog").where(KEYED).groupBy(keys.first_part("sample_key").alias("subset_name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample_key").alias("n_keys"))


@query(
    "running_subset_counts",
    """WITH a AS (SELECT DISTINCT run_id, step_no, sample_key, split_part(sample_key,'/',1) AS subset_name FROM acquisition)
    SELECT *, count(*) OVER (PARTITION BY run_id, subset_name ORDER BY step_no, sample_key ROWS UNBOUNDED PRECEDING) AS running FROM a""",
)
def running_subset_counts(s, d):
    a = table(s, d, "acquisition").select("run_id", "step_no", "sample_key").distinct().withColumn("subset_name", keys.first_part("sample_key"))
    return R.running_counts(a, ["run_id"], F.struct("step_no", "sample_key"), "subset_name")


_TREE = """WITH k AS (SELECT DISTINCT sample_key k FROM image_catalog WHERE sample_key IS NOT NULL), a AS (SELECT substr(md5(k),1,5) b, count(*) n, sha256(string_agg(k, chr(10) ORDER BY k)) d FROM k GROUP BY 1),
    c AS (SELECT substr(b,1,2) b, sum(n) n, sha256(string_agg(b||':'||d, chr(10) ORDER BY b)) d FROM a GROUP BY 1) SELECT sum(n)::BIGINT AS n_keys, sha256(string_agg(b||':'||d, chr(10) ORDER BY b)) AS fingerprint FROM c"""


@query("catalog_fingerprint", _TREE)
def catalog_fingerprint(s, d):
    return fingerprints.key_fingerprint(table(s, d, "image_catalog"), "sample_key")


_ESCAPED = r"""replace(replace(sample_key, '\', '\\'), '"', '\"')"""


@query(
    "split_fingerprints",
    f"""WITH l AS ({_LISTS}) SELECT run_id, split_level, count(*) AS n_keys, sha256('{{"sample_keys":["'||string_agg({_ESCAPED}, '","' ORDER BY sample_key)||'"]}}') AS fingerprint FROM l WHERE sample_key IS NOT NULL GROUP BY 1,2""",
)
def split_fingerprints(s, d):
    """All keys of each list, in order, with backslash and double quote escaped; a list of a run is bounded by its budget, so one row may hold it."""
    rows = table(s, d, "split_rows").where(KEYED).select("run_id", "split_level", "sample_key").distinct()
    escaped = F.transform(F.array_sort(F.collect_list("sample_key")), lambda k: F.replace(F.replace(k, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')))
    text = F.concat(F.lit('{"sample_keys":["'), F.array_join(escaped, '","'), F.lit('"]}'))
    return rows.groupBy("run_id", "split_level").agg(F.count(F.lit(1)).alias("n_keys"), F.sha2(text, 256).alias("fingerprint"))


@query(
    "split_validation",
    f"""WITH c AS (SELECT DISTINCT sample_key k FROM image_catalog WHERE sample_key IS NOT NULL), g AS (SELECT run_id, split_level, sample_key, count(*) n, max(budget) b FROM split_rows GROUP BY 1,2,3)
    SELECT run_id, split_level, sum(n)::BIGINT AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE k IS NULL) AS n_unknown, count(*)=max(b) AS exact FROM g LEFT JOIN c ON c.k=g.sample_key GROUP BY 1,2""",
)
def split_validation(s, d):
    return R.split_report(table(s, d, "split_rows"), table(s, d, "image_catalog"), ["run_id", "split_level"], "sample_key", "budget")


@query(
    "split_nesting",
    f"""WITH l AS ({_LISTS}), lv AS (SELECT DISTINCT run_id, split_level, lead(split_level) OVER (PARTITION BY run_id ORDER BY split_level) nx FROM (SELECT DISTINCT run_id, split_level FROM l))
    SELECT a.run_id, a.split_level, count(*) AS n_keys, CASE WHEN max(lv.nx) IS NOT NULL THEN count(*) FILTER (WHERE b.sample_key IS NULL) END AS lost
    FROM l a JOIN lv USING (run_id, split_level) LEFT JOIN l b ON b.run_id=a.run_id AND b.split_level=lv.nx AND b.sample_key=a.sample_key GROUP BY 1,2""",
)
def split_nesting(s, d):
    return R.nesting_report(table(s, d, "split_rows"), "run_id", "split_level", "sample_key")


@query(
    "catalog_difference",
    """WITH a AS (SELECT DISTINCT sample_key k FROM kmeans_result WHERE sample_key IS NOT NULL), b AS (SELECT DISTINCT sample_key k FROM prototypes WHERE sample_key IS NOT NULL),
    m AS (SELECT k, row_number() OVER (ORDER BY k) r FROM a WHERE k NOT IN (SELECT k FROM b)), e AS (SELECT k, row_number() OVER (ORDER BY k) r FROM b WHERE k NOT IN (SELECT k FROM a))
    SELECT (SELECT count(*) FROM m) AS missing, (SELECT count(*) FROM e) AS extra, (SELECT string_agg(k,',' ORDER BY k) FROM m WHERE r<=3) AS missing_first, (SELECT string_agg(k,',' ORDER BY k) FROM e WHERE r<=3) AS extra_first""",
)
def catalog_difference(s, d):
    a, b = (table(s, d, t).where(KEYED).select("sample_key").distinct() for t in ("kmeans_result", "prototypes"))
    return R.difference(a, b, "sample_key")


@query(
    "cyclic_zip",
    """WITH c AS (SELECT sample_key, (row_number() OVER (ORDER BY sample_key)-1) r FROM (SELECT DISTINCT sample_key FROM image_catalog WHERE sample_key IS NOT NULL)),
    b AS (SELECT bank_id, (row_number() OVER (ORDER BY bank_id)-1) r, count(*) OVER () n FROM memory_banks) SELECT c.sample_key, b.bank_id, c.r AS position FROM c JOIN b ON c.r % b.n = b.r""",
)
def cyclic_zip(s, d):
    return R.cyclic_zip(table(s, d, "image_catalog").where(KEYED).select("sample_key").distinct(), "sample_key", table(s, d, "memory_banks"), "bank_id")


@query(
    "stratified_bootstrap",
    """WITH k AS (SELECT DISTINCT sample_key, split_part(sample_key,'/',1) AS subset_name FROM image_catalog WHERE sample_key IS NOT NULL),
    r AS (SELECT *, count(*) OVER (PARTITION BY subset_name) n, row_number() OVER (PARTITION BY subset_name ORDER BY md5('0|'||sample_key), sample_key) r FROM k)
    SELECT sample_key, subset_name FROM r WHERE r <= least(n, greatest(5, ceil(round(n*0.01,9))))""",
)
def stratified_bootstrap(s, d):
    k = table(s, d, "image_catalog").where(KEYED).select("sample_key", keys.first_part("sample_key").alias("subset_name")).distinct()
    return S.stratified_sample(k, "sample_key", "subset_name", 0.01, 5)


@query("seeded_subset", "SELECT sample_key FROM (SELECT DISTINCT sample_key FROM image_catalog WHERE sample_key IS NOT NULL) ORDER BY md5('7|'||sample_key), sample_key LIMIT 512")
def seeded_subset(s, d):
    return S.seeded_subset(table(s, d, "image_catalog").where(KEYED).select("sample_key").distinct(), "sample_key", 512, "7")


@query("bank_compatibility", "SELECT bank_id, CASE WHEN coalesce(ok,false)=false AND reason IS NOT NULL THEN reason WHEN ok IS NULL THEN 'unknown state' WHEN p.n IS NULL THEN 'no prototypes' END AS refused FROM memory_banks LEFT JOIN (SELECT bank_id, count(*) n FROM prototypes GROUP BY 1) p USING (bank_id)")
def bank_compatibility(s, d):
    n = table(s, d, "prototypes").groupBy("bank_id").agg(F.count(F.lit(1)).alias("n"))
    b = table(s, d, "memory_banks").join(n, "bank_id", "left")
    named = F.when(~F.coalesce("ok", F.lit(False)), F.col("reason"))
    return b.select("bank_id", F.coalesce(named, R.first_failed(("unknown state", F.col("ok").isNotNull()), ("no prototypes", F.col("n") > 0))).alias("refused"))


@query("broken_references", "SELECT DISTINCT sample_key FROM prototypes WHERE sample_key IS NOT NULL AND sample_key NOT IN (SELECT sample_key FROM kmeans_result WHERE sample_key IS NOT NULL)")
def broken_references(s, d):
    return R.broken_references(table(s, d, "prototypes").select("sample_key"), "sample_key", table(s, d, "kmeans_result"), "sample_key").distinct()


@query("canonical_texts", r"SELECT DISTINCT sample_key, (sample_key<>'' AND trim(sample_key)=sample_key AND NOT regexp_matches(sample_key,'[\r\n\\]')) AS canonical, lpad(CAST(split_level AS VARCHAR),4,'0') AS padded FROM split_rows")
def canonical_texts(s, d):
    return table(s, d, "split_rows").select("sample_key", keys.is_canonical_text("sample_key").alias("canonical"), keys.padded("split_level").alias("padded")).distinct()


@query("acquisition_audit", "SELECT sample_key, count(DISTINCT run_id) AS runs, min(CASE WHEN split_level=1 THEN selection_order END) AS rank_level1, min(CASE WHEN split_level=2 THEN selection_order END) AS rank_level2, min(CASE WHEN split_level=3 THEN selection_order END) AS rank_level3, printf('%.10f', avg(coalesce(selection_order,0))) AS mean_order FROM split_rows GROUP BY 1")
def acquisition_audit(s, d):
    ranks = [F.min(F.when(F.col("split_level") == x, F.col("selection_order"))).alias(f"rank_level{x}") for x in (1, 2, 3)]
    return table(s, d, "split_rows").groupBy("sample_key").agg(F.countDistinct("run_id").alias("runs"), *ranks, keys.fixed(F.avg(F.coalesce("selection_order", F.lit(0)))).alias("mean_order"))
