"""The pN_ queries over the test tables, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicketry.session import store, table


def p7_ids(spark, d):
    from thicketry.llm import bpe

    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text", bpe.ranks_of())


def p9_found(spark, d):
    from thicketry.llm import quality

    return quality.not_prose(table(spark, d, "documents"), "doc_id", "text")


def p9_statistics(spark, d):
    from thicketry.llm import quality

    out = quality.text_quality(table(spark, d, "documents"), "doc_id", "text")
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes))


def p8_spans(spark, d):
    from thicketry.llm import leakage

    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


def p8_found(spark, d):
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


def _compatible(spark, d):
    """The prototypes that p3 compares: valid, of a bank that is known to be compatible."""
    banks = table(spark, d, "memory_banks").where("ok").select("bank_id").distinct()
    return table(spark, d, "prototypes").where("is_valid").join(banks, "bank_id", "left_semi")


def p3_found(spark, d):
    from thicketry.llm import neighbours

    n = neighbours.nearest_vectors(_compatible(spark, d), "sample_key", "proto", 128, k=5, min_similarity=0.9)
    return n.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()


def p3_nearest(spark, d):
    """The five most similar vectors of every vector, however similar; (key, rank, other, similarity)."""
    from thicketry.llm import neighbours

    n = neighbours.nearest_vectors(_compatible(spark, d), "sample_key", "proto", 128, k=5)
    return n.select(F.col("key").alias("sample_key"), "rank", "other", F.round("similarity", 5).alias("similarity"))


def _clusters(spark, d):
    from thicketry.llm import grouping

    return grouping.similarity_clusters(table(spark, d, "kmeans_result"), "sample_key", "normalized_features", 64)


def p6_found(spark, d):
    from thicketry.llm import grouping

    return grouping.cluster_members(_clusters(spark, d)).select(F.col("key").alias("sample_key"), "cluster_key")


def p6_clusters(spark, d):
    from thicketry.llm import grouping

    return grouping.describe_clusters(_clusters(spark, d), 64)


def _mix(spark, d):
    from thicketry.llm import catalog, mixing

    roles = table(spark, d, "subset_roles")
    rows = catalog.with_subset(table(spark, d, "image_catalog").select("pool_id", "sample_key", "subset", "path"), roles)
    ident = F.coalesce(F.col("sample_key"), F.concat(F.lit("\u0001"), "subset_name", F.lit("/"), catalog.file_name(F.col("path"))))
    records = rows.select(F.col("pool_id").alias("pool"), F.col("subset_name").alias("category"), ident.alias("id"))
    names = roles.select(F.col("subset").alias("category"), catalog.loose(F.col("subset")).alias("_loose")).dropDuplicates(["_loose"])
    mix = table(spark, d, "target_mix").withColumn("_loose", catalog.loose(F.col("subset"))).join(names, "_loose")
    mix = mix.select(F.col("pool_id").alias("pool"), "category", F.col("target_share").alias("share"), "budget", F.col("min_keep").alias("floor"))
    return mixing.sample_to_mix(records, mix)


def p1_found(spark, d):
    report = _mix(spark, d)[1]
    return report.where("unmet").select(F.col("pool").alias("pool_id"), F.col("category").alias("subset"))


def p1_report(spark, d):
    return _mix(spark, d)[1]


def p1_sample(spark, d):
    return _mix(spark, d)[0]


#: How the catalog's names are built, and what is written before or behind them.
_ADDED = r"^(?:copy|of|kopie|copie|copia|scan|final|tmp|temp|img|image|thumb|thumbnail|edit|edited|orig|original|resized|srgb|new|dup|crop\d*|v\d+|\d{1,4}|\d+x\d*|jpe?g|png|tiff?|webp|bmp|gif)$"
_MARK_LETTERS = frozenset("23456789bcdfghjkmnpqrstvwxz")


def name_form():
    from thicketry.llm import overlap

    return overlap.NameForm(letters=_MARK_LETTERS, added=_ADDED)


def _names(spark, d):
    """(catalog rows of a known role, their names by item and side)."""
    from thicketry.llm import catalog

    rows = catalog.with_subset(table(spark, d, "image_catalog").select("item_id", "sample_key", "subset", "path", "source"), table(spark, d, "subset_roles"))
    ending = r"(?i)\.(jpe?g|png|tiff?|bmp|webp|gif|heic)$"
    stem = F.regexp_replace(catalog.file_name(F.col("sample_key")), ending, "")
    file = F.regexp_replace(catalog.file_name(F.col("path")), ending, "")
    names = F.array_distinct(F.array_compact(F.array(stem, file)))
    rows = rows.where("role in ('train', 'val', 'test')")
    return rows, rows.select(F.col("item_id").alias("item"), (F.col("role") != "train").alias("evaluation"), F.explode(names).alias("name"))


def p2_found(spark, d):
    from thicketry.llm import overlap

    found = overlap.cross_split_overlaps(_names(spark, d)[1], name_form())
    return found.select(F.least("item_train", "item_eval").alias("item_a"), F.greatest("item_train", "item_eval").alias("item_b"))


def p2_counts(spark, d):
    """Overlapping pairs by the subset and the source of the training and of the evaluation row."""
    from thicketry.llm import overlap

    rows, names = _names(spark, d)
    return overlap.overlap_counts(names, name_form(), rows.select(F.col("item_id").alias("item"), F.col("subset_name").alias("subset"), "source"), ["subset", "source"])


def p4_found(spark, d):
    from thicketry.llm import stable

    # the cleaned lists are read by four branches, so they are written once
    lists = stable.with_canonical(table(spark, d, "split_rows").select("run_id", "parent_run_id", "split_level", "sample_key").distinct(), "sample_key")
    lists = store(lists.select("run_id", "parent_run_id", "split_level", "key").distinct())
    lost = store(stable.lost_members(lists.select(F.col("run_id").alias("run"), F.col("parent_run_id").alias("parent"), F.col("split_level").alias("level"), "key")))
    # as image_catalog writes them: of several writings the canonical one, else the smallest
    keys = table(spark, d, "image_catalog").where("sample_key is not null").select("sample_key").distinct()
    written = stable.with_canonical(keys, "sample_key").join(lost.select("key").distinct(), "key", "left_semi")
    written = written.groupBy("key").agg(F.min(F.struct(F.col("sample_key") != F.col("key"), "sample_key")).alias("w"))
    return lost.join(written, "key", "left").select(F.col("run").cast("bigint").alias("run_id"), F.col("level").cast("int").alias("split_level"), F.coalesce("w.sample_key", "key").alias("sample_key"))


#: Fixed rates of p4_sample by the role of a subset.
RATES = {"train": 0.05, "val": 0.1, "test": 0.1}


def p4_sample(spark, d):
    from thicketry.llm import catalog, stable

    roles = table(spark, d, "subset_roles")
    rows = catalog.with_subset(table(spark, d, "image_catalog").select("sample_key", "subset", "path"), roles)
    rate = F.coalesce(*(F.when(F.col("split_role") == r, F.lit(x)) for r, x in RATES.items()))
    rates = roles.select(F.col("subset").alias("stratum"), rate.alias("rate"))
    sample, _ = stable.stable_sample(rows.select(F.col("sample_key").alias("key"), F.col("subset_name").alias("stratum")), rates)
    return sample.select(F.col("key").alias("sample_key"), F.col("stratum").alias("subset"))


def p5_varied(spark, d):
    """500 records of kmeans_result, spread over the subsets of image_catalog."""
    from thicketry.llm import catalog, variety

    rows = table(spark, d, "image_catalog").where("sample_key is not null").select("sample_key", "subset", "path")
    rows = catalog.with_subset(rows, table(spark, d, "subset_roles")).groupBy("sample_key").agg(F.min("subset_name").alias("subset"))
    vecs = table(spark, d, "kmeans_result").where("sample_key is not null").select("sample_key", "normalized_features").join(rows, "sample_key", "left")
    out = variety.varied_subset(vecs, "sample_key", "subset", "normalized_features", 64, budget=500)
    return out.select(F.col("key").alias("sample_key"), F.col("stratum").alias("subset"), "selection_order", "group_size")


def queries():
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit()}


_LOOSE = r"regexp_replace(upper(trim(translate({x}, '_–—‐‑‒―−－', '---------'))), '[\s ]*-+[\s ]*', '-', 'g')"
_SUBSET = r"""coalesce(CASE WHEN trim(subset)<>'' THEN subset END, CASE WHEN sample_key LIKE '%/%' THEN split_part(sample_key,'/',1) END, nullif(regexp_extract(replace(path,'\','/'),'([^/]+)/im/[^/]*$',1),''))"""
_USABLE = "{v} IS NOT NULL AND len({v})={n} AND len(list_filter({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x)))=0 AND len(list_filter({v}, lambda x: x<>0))>0"
_CANON = r"regexp_replace(regexp_replace(trim(regexp_replace(replace(nfc_normalize({x}),'\','/'),'[\t\r\n]',' ','g')), '^(\./)+', ''), '\.(jpe?g|png|tiff?|bmp|webp|gif)$', '', 'i')"


def oracle_sql():
    """SQL where it can say the same on whole tables; the other queries are tested against brute force."""
    p1 = f"""WITH roles AS (SELECT subset AS s, {_LOOSE.format(x="subset")} AS l FROM subset_roles), c AS (SELECT *, {_SUBSET} AS raw FROM image_catalog),
    r AS (SELECT DISTINCT pool_id, s AS subset, coalesce(sample_key, chr(1)||s||'/'||regexp_extract(replace(path,'\\','/'),'[^/]*$')) AS id FROM c JOIN roles ON l={_LOOSE.format(x="raw")}),
    n AS (SELECT pool_id, subset, count(*) n FROM r WHERE id IS NOT NULL GROUP BY 1,2),
    t AS (SELECT pool_id, s AS subset, max(round(coalesce(target_share,0)*budget)) w, max(coalesce(min_keep,0)) f FROM target_mix JOIN roles ON l={_LOOSE.format(x="subset")} GROUP BY 1,2)
    SELECT t.pool_id, t.subset FROM t LEFT JOIN n USING (pool_id, subset) WHERE coalesce(n,0)<w OR coalesce(n,0)<f"""
    mix = f"""WITH roles AS (SELECT subset AS s, {_LOOSE.format(x="subset")} AS l FROM subset_roles), c AS (SELECT *, {_SUBSET} AS raw FROM image_catalog),
    r AS (SELECT DISTINCT pool_id AS pool, s AS category, coalesce(sample_key, chr(1)||s||'/'||regexp_extract(replace(path,'\\','/'),'[^/]*$')) AS id FROM c JOIN roles ON l={_LOOSE.format(x="raw")} WHERE pool_id IS NOT NULL),
    a AS (SELECT *, count(*) OVER (PARTITION BY pool, category) AS available, row_number() OVER (PARTITION BY pool, category ORDER BY ('0x'||substr(md5('17|'||id),1,15))::BIGINT, id)-1 AS rank FROM r WHERE id IS NOT NULL),
    n AS (SELECT pool, category, max(available) AS available FROM a GROUP BY 1,2),
    t AS (SELECT pool_id AS pool, s AS category, max(greatest(0,round(coalesce(target_share,0)*coalesce(budget,0)))::BIGINT) wanted, max(greatest(0,coalesce(min_keep,0)))::BIGINT AS floor, max(coalesce(budget,0))::BIGINT AS budget FROM target_mix JOIN roles ON l={_LOOSE.format(x="subset")} WHERE pool_id IS NOT NULL GROUP BY 1,2),
    p1 AS (SELECT t.*, coalesce(available,0) AS available, least(wanted, coalesce(available,0)) AS mass, least(floor, coalesce(available,0)) AS least FROM t LEFT JOIN n USING (pool, category)),
    p2 AS (SELECT *, CASE WHEN available>0 THEN mass/available ELSE 0 END AS p, sum(mass) OVER (PARTITION BY pool ORDER BY category)-mass+('0x'||substr(md5('17|'||pool),1,5))::BIGINT/1048576.0 AS base, greatest(mass, least) AS kept, greatest(mass, least)-least AS slack FROM p1),
    p3 AS (SELECT *, least(sum(slack) OVER q, greatest(0, sum(kept) OVER q - max(budget) OVER q)) AS surplus, sum(slack) OVER q AS room FROM p2 WINDOW q AS (PARTITION BY pool)),
    p4 AS (SELECT *, round(CASE WHEN room>0 THEN surplus*slack/room ELSE 0 END,6) AS part FROM p3), p5 AS (SELECT *, floor(part) AS back, sum(floor(part)) OVER (PARTITION BY pool) AS gone FROM p4),
    p6 AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY part-back DESC, category) AS turn FROM p5), plan AS (SELECT *, kept-back-(CASE WHEN turn<=surplus-gone AND slack>back THEN 1 ELSE 0 END) AS take FROM p6),
    k AS (SELECT a.pool, a.category, a.id, a.rank, kept, take, mass, floor(round(base+rank*p,6))-floor(round(base,6)) AS hits, floor(round(base+(rank+1)*p,6))-floor(round(base,6)) AS nxt FROM a JOIN plan USING (pool, category)),
    drawn AS (SELECT *, CASE WHEN nxt>hits THEN hits ELSE mass+rank-hits END AS place FROM k), s AS (SELECT pool, category, count(*) FILTER (WHERE place<kept) AS drawn, count(*) FILTER (WHERE place<take) AS taken FROM drawn GROUP BY 1,2)"""
    p1s = f"{mix} SELECT pool, category, id FROM drawn WHERE place<take"
    p1r = f"{mix} SELECT pool, category, plan.budget, wanted, plan.floor, available, coalesce(drawn,0) AS drawn, coalesce(taken,0) AS taken, (available<wanted OR available<plan.floor) AS unmet FROM plan LEFT JOIN s USING (pool, category)"
    p3 = f"""WITH v AS (SELECT sample_key AS k, min(proto) AS e FROM prototypes WHERE is_valid AND bank_id IN (SELECT bank_id FROM memory_banks WHERE ok) AND sample_key IS NOT NULL AND {_USABLE.format(v="proto", n=128)} GROUP BY 1),
    p AS (SELECT a.k, b.k AS o, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.k<>b.k), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, o) AS n FROM p WHERE c>=0.9)
    SELECT DISTINCT least(k,o) AS key_a, greatest(k,o) AS key_b FROM r WHERE n<=5"""
    p4 = f"""WITH l AS (SELECT DISTINCT run_id, parent_run_id AS par, split_level AS lv, {_CANON.format(x="sample_key")} AS k FROM split_rows), has AS (SELECT DISTINCT run_id, lv FROM l),
    due AS (SELECT h.run_id, h.lv, l.k FROM has h JOIN l ON l.run_id=h.run_id AND l.lv<h.lv UNION SELECT h.run_id, h.lv, b.k FROM has h JOIN (SELECT DISTINCT run_id, par FROM l) x ON x.run_id=h.run_id JOIN l b ON b.run_id=x.par AND b.lv=h.lv)
    SELECT run_id, lv AS split_level, k AS sample_key FROM due WHERE (run_id, lv, k) NOT IN (SELECT run_id, lv, k FROM l)"""
    rate = " ".join(f"WHEN '{r}' THEN {x}" for r, x in RATES.items())
    p4s = f"""WITH roles AS (SELECT subset AS s, split_role, {_LOOSE.format(x="subset")} AS l FROM subset_roles), c AS (SELECT *, {_SUBSET} AS raw FROM image_catalog WHERE sample_key IS NOT NULL)
    SELECT DISTINCT sample_key, s AS subset FROM c JOIN roles ON l={_LOOSE.format(x="raw")} WHERE ('0x'||substr(md5('v1|'||sample_key),1,12))::BIGINT < floor(CASE split_role {rate} END * 281474976710656)"""
    p6 = f"""WITH v AS (SELECT sample_key AS k, min(normalized_features) AS e FROM kmeans_result WHERE sample_key IS NOT NULL AND {_USABLE.format(v="normalized_features", n=64)} GROUP BY 1),
    g AS (SELECT a.k, min(b.k) AS m, count(*) AS n FROM v a JOIN v b ON list_cosine_similarity(a.e, b.e)>=0.835 GROUP BY 1) SELECT k AS sample_key, m AS cluster_key FROM g WHERE n>=3"""
    return {"p1_found": p1, "p1_sample": p1s, "p1_report": p1r, "p3_found": p3, "p4_found": p4, "p4_sample": p4s, "p6_found": p6}
