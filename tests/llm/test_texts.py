"""Problems 7, 8 and 9."""

import os

import numpy as np
import pytest

from thicketry.llm import bpe, leakage, quality

HAVE = os.path.exists(os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.tiktoken"))
TEXTS = [
    "Hello world, it's 2024!", "", None, "   \n\n\t ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|> is text <|startoftext|>",
    "déjà vu — naïve façade\r\nzweite Zeile", "经过63轮训练,标注", "😀👩‍👩‍👧 é ​­", "x" * 3000, "word " * 2000, "퟿�\x00\x7f",
]


@pytest.fixture(scope="module")
def ranks():
    if not HAVE:
        pytest.skip("no vocabulary here")
    return bpe.ranks_of()


def test_ids_equal_the_public_encoder(spark, ranks):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 7)], "k bigint, t string, ids int")
    got = bpe.encode_texts(df.repartition(3), "k", "t", ranks).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert r.ids == enc.encode_ordinary(TEXTS[r.k] or "")
    back = {r.k: enc.decode(r.ids) for r in got}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.encode_texts(df.limit(0), "k", "t", ranks).count() == 0


def test_small_memory_and_batches_change_nothing(spark, ranks):
    words = ["inter", "internationalization", "zzzzzz", " the", "ababab", "aaa"]
    a, b = bpe.PairIndexEncoder(ranks), bpe.PairIndexEncoder(ranks, keep=2)
    a.learn(words)
    for w in words:
        b.learn([w])
        assert b.known[w] == a.known[w] == a._one_by_one(w)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k bigint, t string").coalesce(1)
    one = {r.k: r.ids for r in bpe.encode_texts(df, "k", "t", ranks, batch_chars=10).collect()}
    assert one == {r.k: r.ids for r in bpe.encode_texts(df, "k", "t", ranks).collect()}


def test_forgetting_keeps_the_words_of_the_batch(spark, ranks):
    few, all_ = bpe.PairIndexEncoder(ranks, keep=3), bpe.PairIndexEncoder(ranks)
    all_.learn(["inter", "zzzzzz", " the", "ababab"])
    for batch in (["inter", "zzzzzz"], ["zzzzzz", " the", "ababab"], ["inter", "zzzzzz", " the", "ababab"], ["inter"]):
        few.learn(iter(batch))
        assert all(few.known[w] == all_.known[w] for w in batch)
    df = spark.createDataFrame([(i, f"shared words stay zzqx{i} vvkw{i}") for i in range(40)], "k bigint, t string").coalesce(1)
    want = {r.k: r.ids for r in bpe.encode_texts(df, "k", "t", ranks).collect()}
    for keep in (1, 5, 9):
        assert want == {r.k: r.ids for r in bpe.encode_texts(df, "k", "t", ranks, batch_chars=60, keep=keep).collect()}


def test_one_merge_at_a_time_says_the_same_and_is_not_quadratic():
    """Also where a merge makes a pair of lower rank, which trained vocabularies do not have."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 260, b"bc": 259, b"abc": 256, b"ca": 261, b"aa": 258, b"aaaa": 257}
    enc = bpe.PairIndexEncoder(ranks)
    rng = np.random.default_rng(1)
    for _ in range(300):
        w = "".join(rng.choice(list("abc"), rng.integers(1, 14)))
        s = [bytes([b]) for b in w.encode()]
        while True:
            best = min(((ranks[s[i] + s[i + 1]], i) for i in range(len(s) - 1) if s[i] + s[i + 1] in ranks), default=None)
            if best is None:
                break
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]
        enc.learn([w])
        assert enc._one_by_one(w) == enc.known[w] == tuple(ranks[x] for x in s), w
    assert len(enc._one_by_one("abc" * 100_000)) >= 100_000


def test_suffix_array_and_search():
    rng = np.random.default_rng(0)
    for size, n in ((2, 1), (3, 40), (5, 300)):
        s = rng.integers(1, size, n)
        t = np.append(s, 0)
        want = sorted(range(n + 1), key=lambda i: t[i:].tolist())
        assert leakage.suffix_array(t.astype(np.int64)).tolist() == want
        fm = leakage.FMIndex(s, size, every=3)
        for m in (1, 2, 4):
            phrases = np.array([rng.integers(1, size, m) for _ in range(20)])
            lo, hi = fm.search(phrases)
            for p, a, b in zip(phrases, lo, hi):
                places = [i for i in range(n - m + 1) if (s[i : i + m] == p).all()]
                assert sorted(fm.locate(np.arange(a, b)).tolist()) == places


def test_wavelet_ranks():
    seq = np.random.default_rng(1).integers(0, 9, 100)
    w = leakage.WaveletMatrix(seq, 9)
    for c in range(9):
        for i in (0, 1, 50, 100):
            assert w.rank(np.array([c]), np.array([i]))[0] == (seq[:i] == c).sum()


LONG = "The quick brown fox jumps over the lazy dog while seven small owls watch from the old oak tree"
SHORT = "Ein kurzer Satz über Käuzchen"


def leak(spark, docs, items, **k):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, passage string, text string")
    return leakage.leaks(d, "doc_id", "text", i, "item_id", "passage", **k)


def test_leaks(spark):
    w = LONG.split()
    docs = [
        (1, "before " + LONG.upper().replace(" ", " ​, ") + " after", "x"), (2, " ".join(w[:13]), "x"), (3, " ".join(w[:12]) + " x " + " ".join(w[13:]), "x"), (4, SHORT.replace("ä", "ä"), None), (5, "kurzer Satz über Käuzchen", None),
        (6, None, None), (7, "", None), (2, " ".join(w[:13]), "x"), (8, (" ".join(w[2:16]) + " und ") * 50 + SHORT, "y"),
    ]
    items = [(10, LONG, "c"), (11, SHORT, None), (12, LONG, None), (13, None, None), (14, " .. ", None), (10, LONG, "c")]
    for kw in ({}, {"shard_words": 5}, {"block_chars": 40}):
        got = leak(spark, docs, items, **kw).collect()
        pairs = sorted((r.doc_id, r.item_id) for r in got)
        assert pairs == sorted([(1, 10), (1, 12), (2, 10), (2, 12), (2, 10), (2, 12), (4, 11), (8, 10), (8, 11), (8, 12)])
        first = next(r for r in got if (r.doc_id, r.item_id) == (1, 10))
        assert [tuple(s) for s in first.spans] == [(1, 20)] and first.n_words == 19
        assert len(next(r for r in got if (r.doc_id, r.item_id) == (8, 10)).spans) == 50
    assert leak(spark, docs[:1], []).count() == 0 and leak(spark, [], items).count() == 0


def test_leaks_of_equally_named_keys_and_a_long_text(spark):
    d = spark.createDataFrame([(1, ("word " * 300_000) + LONG)], "id bigint, text string")
    i = spark.createDataFrame([(5, LONG)], "id bigint, text string")
    got = leakage.leaks(d, "id", "text", i, "id", "text").collect()
    assert [(r.id, r.id_item, r.spans[0].first) for r in got] == [(1, 5, 300_000)]


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(vocab, rng.integers(0, 60)).tolist()), "") for i in range(120)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(1, 9)).tolist()), "") for i in range(40)]
    got = {(r.doc_id, r.item_id) for r in leak(spark, docs, items, least=3).collect()}
    want = set()
    for d, t, _ in docs:
        for i, p, _ in items:
            w, x = t.split(), p.split()
            n = min(3, len(x))
            grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if any(tuple(x[k : k + n]) in grams for k in range(len(x) - n + 1)):
                want.add((d, i))
    assert got == want


PROSE = "The night crew wrote that the tall grass looks uneven, which makes the moth harder to outline. Nobody expected the grouse to leave the slope."
GERMAN = "Die Kuratorin aus dem Tal hat die raue Karte noch einmal geprüft und viele Bilder mit Sand verworfen. Wenn das Licht schwach ist, bleibt der Frosch im Moor."
WRAPPED = PROSE.replace(", ", ",\n").replace(" to ", "\nto ").replace(" the ", " the\n")
CASES = {
    "prose": (PROSE, False), "german": (GERMAN, False), "wrapped": (WRAPPED, False), "quoted": ("> " + WRAPPED.replace("\n", "\n> "), False), "chinese": ("经过63轮训练,掩膜的边界仍然没有找到沙地上的飞蛾。如果标注是模糊的,就需要再看一遍。", False),
    "bold": (PROSE.replace("moth", "**moth**"), False), "upper": (PROSE.upper(), False), "crlf": (WRAPPED.replace("\n", "\r\n"), False),
    "tabs": ("a\tb\tc\n" + "\n".join(f"x{i}\t{i}\t0.{i}" for i in range(9)), True), "csv": ("name,n,score\n" + "\n".join(f"moss,{i},0.{i}" for i in range(9)), True), "pipes": ("\n".join(f"| moss | {i} | 0.{i} |" for i in range(9)), True),
    "columns": ("subset      n   score\n" + "\n".join(f"moss{i:7d}   0.{i}" for i in range(9)), True), "html": ("<table>" + "<tr><td>moss</td><td>1</td></tr>" * 9 + "</table>", True),
    "bullets": ("\n".join(f"- pale moth, kelp {i}" for i in range(9)), True), "numbers": ("\n".join(f"{i}. Seed set {i}" for i in range(1, 9)), True), "fields": ("subset: A\nn: 3\nscore: 0.2\n" * 5, True),
    "bare": ("ragged spider, rubble\nbroken snipe, twigs\nowlet map 12\nmottled toad, bark", True), "keywords": ("owlet shale prototype boundary woodcock note pool pebbles octopus grid lichen " * 4, True), "commas": ("cluster map 77, dim flounder, algae, pale sand, mask 192, " * 5, True),
    "repeats": ((PROSE.split(". ")[0] + ". ") * 8, True), "garbled": ("A¬ ¬he marsh nÃ|r �n§^§¤n§lµ ±Âe ~µt¤pu° ılp�¬s °°§ ¬r~¬| 1¤ °�Â 1et grÃµıl ı± ıel¶.", True), "log": ("[10:09:56] step=4399 loss=0.3130 cluster=ok\n[02:25:12] step=1695 loss=0.6955 mask=ok\n" * 4, True),
    "swedish": ("Fjärilen sitter stilla på den gråa barken tills ljuset försvinner bakom skogen. Ingen hade väntat att fågeln skulle lämna sluttningen redan samma kväll.", False),
    "greek": ("Η νυχτερινή ομάδα έγραψε ότι το ψηλό χορτάρι φαίνεται ανομοιόμορφο κοντά στο ποτάμι. Κανείς δεν περίμενε ότι το πουλί θα έφευγε από την πλαγιά.", False),
    "hindi": ("रात की टीम ने लिखा कि लंबी घास असमान दिखती है और पतंगे को पहचानना कठिन है। किसी को उम्मीद नहीं थी कि पक्षी ढलान छोड़ देगा।", False),
    "mixed": (PROSE + "\n\n" + "\n".join(f"moss,{i},0.{i}" for i in range(60)), True), "little": (PROSE * 3 + "\n\n- a moth\n- a toad\n", False),
}


def one(text):
    return {k: v[0] for k, v in quality.measure([text]).items()}


@pytest.mark.parametrize("name", list(CASES))
def test_prose_or_not(name):
    text, junk = CASES[name]
    assert (one(text)["prose_share"] < 0.5) == junk, one(text)


def test_figures(spark):
    m = one("One two, three.\nfour 5!")
    assert m["word_count"] == 4 and m["mean_word_length"] == pytest.approx(3.75) and m["line_count"] == 2 and m["end_punct_share"] == 1 and m["digit_share"] == pytest.approx(1 / 19)
    df = spark.createDataFrame([(1, PROSE, 9), (1, PROSE, 9), (2, None, 9), (3, "- a b\n- c d\n- e f", 9), (4, " ", 9)], "k bigint, t string, prose_share int")
    assert quality.text_quality(df, "k", "t").count() == 5
    assert [r.k for r in quality.not_prose(df, "k", "t").collect()] == [3]
    assert quality.not_prose(df.limit(0), "k", "t").count() == 0
    assert one("word " * 200_000)["prose_share"] == 0


def test_whole_batches_give_the_figures_of_single_texts():
    texts = [t for t, _ in CASES.values()]
    all_ = quality.measure(texts)
    for i, t in enumerate(texts):
        for k, v in one(t).items():
            assert all_[k][i] == pytest.approx(v), (k, t[:40])


def test_keys_named_like_results(spark, ranks):
    df = spark.createDataFrame([(1, PROSE), (2, "- a\n- b\n- c")], "n long, t string")
    named = df.withColumnRenamed("n", "word_count")
    assert {r.word_count_key: r.word_count for r in quality.text_quality(named, "word_count", "t").collect()} == {1: 25, 2: 3}
    assert [r.prose_share for r in quality.not_prose(df.withColumnRenamed("n", "prose_share"), "prose_share", "t").collect()] == [2]
    assert {r.ids_key for r in bpe.encode_texts(df.withColumnRenamed("n", "ids"), "ids", "t", ranks).collect()} == {1, 2}


def test_odd_texts_have_figures():
    texts = [">", " > >\n>", "\u200b", "\x00", "a", "\ud83d\udc22".encode("utf-16", "surrogatepass").decode("utf-16"), "<table>", "|\n|", "𠀀𠀁。", "x" * 300_000, PROSE]
    m = quality.measure(texts)
    assert all(len(v) == len(texts) and np.isfinite(v.astype(float)).all() for v in m.values())
    assert m["line_count"].min() == 1 and m["prose_share"].tolist()[:-1] == [0.0] * 10 and m["prose_share"][-1] > 0.9


def test_signals():
    run = np.zeros(4, np.int64)
    even, _ = quality._alignment(quality._Strings(["ab | c", "xy | d", "zz | eeee", "no bar"]), run)
    ragged, _ = quality._alignment(quality._Strings(["ab | c", "xyzzy | d", "z | e", "no bar"]), run)
    assert even.tolist() == [1, 1, 1, 0] and ragged.tolist() == [0.6, 0.6, 0.6, 0]
    share, period = quality._periodicity(np.array([5, 7, 5, 7, 5, 7, 0, 0, 0]), np.array([0] * 6 + [1] * 3), 2)
    assert share.tolist() == [1, 0] and period[0] == 2
    corr = quality._autocorrelation(np.array([10.0, 30, 10, 30, 10, 30, 20, 20, 20, 20, 5, 9, 70]), np.array([0] * 6 + [1] * 4 + [2] * 3), 3)
    assert corr[0] > 0.9 and corr[1] == 1 and corr[2] == 0


def test_autocorrelation_decides_which_lines_are_a_list():
    """Lines of like length and no end read as one long piece of prose but for the signal."""
    text = "\n".join(f"{a} {b} 与 沙地" for a, b in zip(["飞蛾掩膜", "蟾蜍边界", "螃蟹样本", "雷鸟标注"] * 3, ["积雪苔藓", "砂石海藻", "树皮落叶"] * 4))
    assert one(text)["list_share"] == 1
    assert quality.measure([text], (0.5, 0.5, 0, 0))["list_share"][0] == 0
