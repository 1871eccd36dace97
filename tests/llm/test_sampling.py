"""Problems 1, 2 and 4."""

import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from thicketry.llm import catalog, mixing, overlap, queries, stable

# Problem 1


def mix(spark, records, targets, **k):
    r = spark.createDataFrame(records, "pool string, category string, id string").withColumn("n", F.lit(1)).withColumn("available", F.lit(2))
    t = spark.createDataFrame(targets, "pool string, category string, share double, budget int, floor int")
    return mixing.sample_to_mix(r.repartition(k.pop("parts", 3)), t, **k)


def pool(name, **sizes):
    return [(name, c, f"{name}-{c}-{i:05d}") for c, n in sizes.items() for i in range(n)]


def test_shares_floors_and_budget(spark):
    records = pool("p", a=5000, b=300, c=40, d=3) + pool("q", a=10)
    targets = [("p", "a", 0.5, 200, 0), ("p", "b", 0.3, 200, 0), ("p", "c", 0.1, 200, 30), ("p", "d", 0.1, 200, 2), ("q", "a", 0.5, 10, 1), ("q", "z", 0.5, 10, 1), ("r", "a", None, None, None)]
    sample, report = mix(spark, records + records[:500], targets + targets[:2])
    got = {(r.pool, r.category): r for r in report.collect()}
    n = Counter((r.pool, r.category) for r in sample.collect())
    assert sample.count() == sample.distinct().count()
    assert all(r.taken == n[k] <= r.drawn for k, r in got.items())
    assert all(r.unmet == (r.available < r.wanted or r.available < r.floor) for r in got.values())
    assert sum(v for k, v in n.items() if k[0] == "p") <= 200 and n["p", "c"] == 30 and n["p", "d"] == 3
    assert abs(n["p", "a"] - 100) <= 10 and abs(n["p", "b"] - 60) <= 10 and n["q", "a"] == 5
    assert {k for k, r in got.items() if r.unmet} == {("p", "d"), ("q", "z")}
    assert got["r", "a"].unmet is False and got["q", "z"].available == 0


def test_same_sample_for_any_partitioning_and_chance_is_even(spark):
    records = pool("p", a=400, b=400)
    targets = [("p", "a", 0.5, 80, 0), ("p", "b", 0.25, 80, 0)]
    one = {r.id for r in mix(spark, records, targets, parts=1)[0].collect()}
    random.Random(1).shuffle(records)
    assert one == {r.id for r in mix(spark, records, targets, parts=7, buckets=4)[0].collect()} == {r.id for r in mix(spark, records, targets, buckets=1)[0].collect()}
    seen = Counter()
    for seed in range(6):
        s = {r.id for r in mix(spark, records, targets, seed=seed)[0].collect()}
        assert len([x for x in s if "-a-" in x]) in (39, 40, 41) and len([x for x in s if "-b-" in x]) in (19, 20, 21)
        seen.update(s)
    assert max(seen.values()) <= 5 and len(seen) > 200


def test_floors_beyond_the_budget_come_first_and_the_rest_goes_back(spark):
    records = pool("p", a=100, b=100, c=100) + pool("q", a=50, b=50)
    targets = [("p", "a", 0.9, 20, 0), ("p", "b", 0.05, 20, 15), ("p", "c", 0.05, 20, 3), ("q", "a", 0.5, 10, 8), ("q", "b", 0.5, 10, 9)]
    sample, report = mix(spark, records, targets)
    n = Counter((r.pool, r.category) for r in sample.collect())
    assert n["p", "b"] == 15 and n["p", "c"] == 3 and n["p", "a"] == 2 and n["q", "a"] == 8 and n["q", "b"] == 9
    got = {(r.pool, r.category): r for r in report.collect()}
    assert not any(r.unmet for r in got.values()) and got["p", "a"].drawn == 18


def test_mix_without_rows(spark):
    nulls = [(None, "a", "x"), ("p", None, "x"), ("p", "a", None)]
    sample, report = mix(spark, nulls, [("p", "a", 1.0, 2, 0), (None, "a", 1.0, 2, 0)])
    assert sample.count() == 0 and [(r.available, r.unmet) for r in report.collect()] == [(0, True)]
    sample, report = mix(spark, nulls, [])
    assert sample.count() == 0 and report.count() == 0


def test_subsets_are_told_by_other_fields(spark):
    roles = spark.createDataFrame([("TR-BARK", "train"), ("MARSH", "test")], "subset string, split_role string")
    rows = [(" tr_bark", None, None), ("TR–BARK ", "x/y", None), (None, "MARSH/a", "/m/TR-BARK/im/a.png"), (None, None, "D:\\c\\MARSH\\im\\a.png"), ("", "", "/x/y.png"), ("odd", "MARSH/a", None), (None, None, None)]
    df = spark.createDataFrame(rows, "subset string, sample_key string, path string").withColumn("i", F.monotonically_increasing_id())
    got = [r.subset_name for r in catalog.with_subset(df, roles).orderBy("i").collect()]
    assert got == ["TR-BARK", "TR-BARK", "MARSH", "MARSH", None, None, None]


# Problem 2

LETTERS = sorted(queries._MARK_LETTERS)
FORM = queries.name_form()


def test_parse():
    one = [("moss moth pool".split(), "zqz9dqmbbjccgf")]
    words, mark = one[0]
    want = ((mark, " ".join(words)),)
    for name in (f"moth-moss-pool-{mark}", f"IMG_MOTH_MOSS_POOL_{mark.upper()}", f"copy of {mark} moth.moss.pool (2)", f"móth-moss-pool-{mark}-640x480", f"MothMossPool{mark.capitalize()}", "ｍｏｔｈ-moss-pool-ｚｑｚ９ｄｑｍｂｂｊｃｃｇｆ", f"moth%20moss+pool~{mark}@2x", f"{mark.capitalize()}PoolMossMoth - Kopie"):
        assert overlap.parse(name, FORM) == want, name
    assert not any(overlap.parse(x, FORM) for x in ("b" * 300_000, "%62" * 300, "frame001993348", "img005483485", ""))
    assert (mark, "=mothmosspool" + mark) in overlap.parse("mothmosspool" + mark, FORM)
    assert overlap.parse("Two_old-owls (3)", overlap.NameForm(added=FORM.added, whole=True)) == (("oldowlstwo", ""),)
    one, two = "mothmosspool" + mark, mark + "mothmosspoolxyz"
    assert overlap.name_distance(mark, "=" + one, mark, "=" + two) == 0 and overlap.name_distance(mark, "=" + one, mark, "=gnatmudreef" + mark) > 2


def test_code_radius():
    rng = random.Random(0)
    for _ in range(300):
        a = "".join(rng.choices(LETTERS, k=14))
        b = list(a)
        for _ in range(2):
            i = rng.randrange(len(b))
            what = rng.randrange(3)
            b[i : i + 1] = [[rng.choice(LETTERS)], [], [b[i], rng.choice(LETTERS)]][what]
        x, y = overlap.fingerprint(a) & (2**64 - 1), overlap.fingerprint("".join(b)) & (2**64 - 1)
        assert (x ^ y).bit_count() <= overlap.RADIUS and overlap.edits(a, "".join(b)) <= 2
    assert overlap.edits("kitten", "sitting") == 3 and overlap.edits("bcd", "abxde", True) == 1


def damage(rng, name, n):
    s = list(name)
    spots = [i for i, c in enumerate(s) if c not in "-_ ."]
    for i in sorted(rng.sample(spots, n), reverse=True):
        what = rng.randrange(3)
        s[i : i + 1] = [[rng.choice(LETTERS)], [], [s[i], rng.choice(LETTERS)]][what]
    return "".join(s)


@pytest.mark.parametrize("crowd", [2_000, 0])
def test_overlaps(spark, crowd):
    """Frames of one series share the first letters of their marks; every pair within two edits must come out."""
    rng = random.Random(7)
    names, rows, want = [], [], set()
    marks: list[str] = []
    while len(marks) < 240:
        m = ("zqzvdqm" if len(marks) < 160 else "".join(rng.choices(LETTERS, k=7))) + "".join(rng.choices(LETTERS, k=7))
        if all(overlap.edits(m, x) >= 5 for x in marks):
            marks.append(m)
    animals, grounds, places = ["gecko", "mountainhare", "toad"], ["moss", "kelp"], ["reef", "dune"]
    for i, m in enumerate(marks):
        names.append(f"{animals[i % 3]}-{grounds[i % 2]}-{places[i % 2]}-{m}")
        rows.append((i, False, names[-1]))
    for i in range(0, 240, 2):
        parts = names[i].split("-")
        rng.shuffle(parts)
        clean = rng.choice(["-".join(parts), "_".join(parts).upper(), "scan " + ".".join(parts), "-".join(parts) + " (1)"])
        rows.append((1000 + i, True, damage(rng, clean, i % 3)))
        want.add((i, 1000 + i))
    rows += [(0, False, names[0]), (2000, False, names[2]), (3000, True, None), (3001, None, names[2]), (None, True, names[2]), (3002, True, "frame000111"), (3003, True, "gecko-moss-reef-zqzvdqmbbbbbbb")]
    want.add((2000, 1002))
    df = spark.createDataFrame(rows, "item int, evaluation boolean, name string").withColumn("id", F.lit(1)).withColumn("mark", F.lit("x"))
    got = {tuple(r) for r in overlap.cross_split_overlaps(df.repartition(3), FORM, crowd=crowd).collect()}
    assert len(want - got) <= 0, [(rows[a][2], dict((r[0], r[2]) for r in rows)[b]) for a, b in want - got][:5]
    assert not got - want
    assert overlap.cross_split_overlaps(df.where("not evaluation"), FORM).count() == 0 and overlap.cross_split_overlaps(df.limit(0), FORM).count() == 0
    # the code decides which pairs are compared: within radius zero only names with equal letter pairs meet
    assert overlap.overlap_links(df, FORM, crowd, radius=0)[1].count() < overlap.overlap_links(df, FORM, crowd)[1].count()
    sides = df.select("item", F.when(F.col("item") % 2 == 0, "even").otherwise("odd").alias("kind")).where("item is not null").distinct().withColumn("record", F.lit(1))
    counts = overlap.overlap_counts(df, FORM, sides, ["kind"], crowd)
    by = Counter((("even", "odd")[a % 2], ("even", "odd")[b % 2]) for a, b in want)
    assert {(r.train_kind, r.eval_kind): r.pairs for r in counts.collect()} == by


def test_long_glued_and_doubly_marked_names_are_found(spark):
    """However long a name is, and whatever else in it looks like a mark; runs of many letters stand once for all their windows."""
    mark, near = "zqz9dqmbbjccgf", "zqz9dqmbcjccgf"
    names = [
        f"moth-moss-pool-{near}" + "-extra" * 60,
        f"moth-mozs-pool-{mark}-x1-y2-z3-extra-more-foo-bar-baz-qux",
        f"mothmosspool{near}" + "xaeiou" * 60,
        "22334455667788-moth-moss-pool-" + mark,
        "22334455667788_MothMossPool" + mark.capitalize(),
        "22334455667788-mothmosspool" + mark,
        f"mosspool{mark}moth",
    ]
    rows = [(0, False, "moth-moss-pool-" + mark), (1, False, "mothmosspool" + mark + "aeiou" * 60), (2, False, "gnat-mud-reef-" + "b2c3d4f5g6h7j8")]
    rows += [(10 + i, True, n) for i, n in enumerate(names)]
    rows += [(30, True, "ЖабаМохПруд" + "B2c3d4f5g6h7j8"), (31, True, "22334455667788-moth-moss-pool-b2c3d4f5g6h7j8"), (32, True, "mud" + "b2c3d4f5g6h7j8")]
    rows += [(3, False, "жаба-мох-пруд-" + "b2c3d4f5g6h7j8"), (4, False, "22334455667788-moth-moss-pool-w9w8w7w6w5w4w3")]
    df = spark.createDataFrame(rows, "item int, evaluation boolean, name string")
    want = {(0, 10 + i) for i in range(len(names))} | {(1, 10 + i) for i in range(len(names))} | {(3, 30)}
    got = {tuple(r) for r in overlap.cross_split_overlaps(df, FORM).collect()}
    assert got == want, (want - got, got - want)


def test_names_of_another_form(spark):
    """Without marks, whole names match within two edits, in any order of their parts; short ones only if equal."""
    rng = random.Random(11)
    form = overlap.NameForm(letters=frozenset("#"), added=FORM.added, whole=True)
    words = "amber birch cloud dusty ember fjord glade heath islet kelpy linen mossy north ocean plume quill ridge stone tidal umber".split()
    names = ["_".join(rng.sample(words, 5)) for _ in range(150)]
    rows = [(i, False, n) for i, n in enumerate(names)] + [(900, False, "ab_cd")]
    want = set()
    for i in range(0, 150, 3):
        parts = names[i].split("_")
        parts[rng.randrange(5)] += "s"
        rng.shuffle(parts)
        rows.append((1000 + i, True, "-".join(parts)))
        want.add((i, 1000 + i))
    rows += [(2000, True, "cd-AB"), (2001, True, "ab_ce")]
    want.add((900, 2000))
    df = spark.createDataFrame(rows, "item int, evaluation boolean, name string")
    for crowd in (2_000, 0):
        assert {tuple(r) for r in overlap.cross_split_overlaps(df, form, crowd).collect()} == want


# Problem 4


def test_stable_sample(spark):
    rows = [(f"k{i}", "a" if i % 3 else "b") for i in range(3000)] + [(None, "a"), ("x", None), ("k0", "b")]
    rates = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 1.0), (None, 1.0), ("d", None)], "stratum string, rate double")
    df = spark.createDataFrame(rows, "key string, stratum string").withColumn("hash", F.lit(0)).withColumn("threshold", F.lit(9))
    first, marks = stable.stable_sample(df, rates)
    one = {(r.key, r.stratum) for r in first.collect()}
    assert len(one) == first.count() and abs(sum(k[1] == "a" for k in one) - 200) < 60 and abs(sum(k[1] == "b" for k in one) - 500) < 80
    assert one == {(r.key, r.stratum) for r in stable.stable_sample(df.repartition(9).orderBy(F.desc("key")), rates)[0].collect()}
    grown = df.unionByName(spark.createDataFrame([(f"n{i}", "a") for i in range(500)], "key string, stratum string").withColumn("hash", F.lit(0)).withColumn("threshold", F.lit(9)))
    lower = spark.createDataFrame([("a", 0.01), ("b", float("nan"))], "stratum string, rate double")
    kept, raised = stable.stable_sample(grown, lower, previous=marks)
    assert one <= {(r.key, r.stratum) for r in kept.collect()}
    assert {r.stratum: r.threshold for r in raised.collect()}["b"] == {r.stratum: r.threshold for r in marks.collect()}["b"]
    assert one != {(r.key, r.stratum) for r in stable.stable_sample(df, rates, salt="v2")[0].collect()}
    more = spark.createDataFrame([("a", 0.3), ("b", 0.6)], "stratum string, rate double")
    assert one <= {(r.key, r.stratum) for r in stable.stable_sample(df, more)[0].collect()}
    assert stable.stable_sample(df.limit(0), rates)[0].count() == 0 and stable.stable_sample(df, rates.limit(0))[0].count() == 0


def test_canonical_keys():
    k = "TR/é-moss"
    for x in (k, unicodedata.normalize("NFD", k), "TR\\é-moss", "./TR/é-moss.JPG", "\tTR/é-moss ", "TR//é-moss.png", "TR / é-moss"):
        assert stable.canonical_key(x) == k
    assert stable.canonical_key("") == "" and stable.canonical_key("TR/a.orig") == "TR/a.orig"


def test_canonical_columns_say_the_same_as_the_function(spark):
    keys = ["TR/moss", "TR\\moss.PNG", " ./TR//moss .jpg ", "TR/moss.orig", "", None, "\tTR / moss\n", "TR/\x0bm.png.png", ".", "a/./b", "TR/é-moss", unicodedata.normalize("NFD", "TR/é-moss.gif"), "TR/\u00a0moss", "x.jpeg/y.tif", "A/b.png\n"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {(r.k, r.key) for r in stable.with_canonical(df, "k").collect()} == {(k, None if k is None else stable.canonical_key(k)) for k in keys}


def test_levels_beyond_sixty_fail(spark):
    for level in (61, -1):
        with pytest.raises(Exception, match="level beyond"):
            stable.lost_members(spark.createDataFrame([(1, None, level, "a")], "run int, parent int, level int, key string")).collect()


def test_lost_members(spark):
    rng = random.Random(3)
    rows = [(run, run - 1 if run % 2 == 0 else None, level, f"k{rng.randrange(12)}") for run in range(1, 9) for level in (1, 2, 3) for _ in range(6) if (run, level) != (4, 3)]
    rows += rows[:20] + [(None, None, 1, "k1"), (1, None, None, "k1"), (1, None, 1, None), (9, 77, 2, "k1")]
    lists = defaultdict(set)
    parent = {}
    for run, p, level, k in rows:
        if None not in (run, level, k):
            lists[run, level].add(k)
            if p is not None:
                parent[run] = p
    want = set()
    for (run, level), own in lists.items():
        due = set().union(*(lists.get((run, x), set()) for x in range(level)), lists.get((parent.get(run), level), set()))
        want |= {(run, level, k) for k in due - own}
    df = spark.createDataFrame(rows, "run int, parent int, level int, key string").withColumn("own", F.lit(1)).withColumn("due", F.lit(1)).repartition(4)
    got = stable.lost_members(df)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert stable.lost_members(df.limit(0)).count() == 0
