"""Language profiles, leaks, spam pages, page frames, residue and mixtures on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import boilerplate, langid, leakage, mixture, residue, stuffing

EN, DE = "this is what the people of my house want to buy", "das ist es was die leute in meinem haus kaufen wollen"


# --- languages ---------------------------------------------------------------------------------
def test_labels():
    assert [langid.label_code(x) for x in ("en-US", "Hindi", "DEU", "pt_BR", "und", "zxx", "", None, "??", "français")] == ["en", "hi", "de", "pt", None, None, None, None, None, "fr"]


def test_seed_profiles_and_segments(spark):
    p = langid.learn([])
    got = langid.unit_languages([EN, DE, f"{EN}. {DE}", "#tag #other", "10/10 !!!", "ok", "यह मेरे घर के लोगों के लिए अच्छा है", "yeh mere ghar ke logon ke liye achha hai", EN.upper()], p)
    assert [sorted(g) for g in got] == [["en"], ["de"], ["de", "en"], [], [], [], ["hi"], ["hi"], ["en"]]
    schema = "link_id long, caption string, transcript string, top_comments array<string>, lang string, seg_no int"
    rows = [(1, EN, f"{DE}\n\n{EN}", [DE, None, "", EN], "en", 1), (2, None, "", None, None, 1), (3, EN * 2000, None, [], "German", 1), (1, EN, None, None, "en", 1)]
    df = spark.createDataFrame(rows, schema)
    out = langid.segment_languages(df, p, "link_id", ["caption", "transcript", "top_comments"], "lang")
    found = sorted((r.link_id, r.field_name, r.seg_no, r.lang, r.label_lang) for r in out.collect())
    assert found == [(1, "caption", 1, "en", "en"), (1, "caption", 1, "en", "en"), (1, "top_comments", 1, "de", "en"), (1, "top_comments", 4, "en", "en"), (1, "transcript", 1, "de", "en"), (1, "transcript", 3, "en", "en"), (3, "caption", 1, "en", "de")]
    assert langid.segment_languages(df.limit(0), p, "link_id", ["caption"], "lang").count() == 0
    assert langid.train_profiles(df.limit(0), ["caption"]).names == p.names


def test_labels_beyond_the_500_most_frequent_spellings(spark):
    odd = ["en-US", "Hindi", " DEU ", "pt_BR", "und", "zxx", "", None, "??", "français", "tr (TR)", "\ttr\u00a0"]
    df = spark.createDataFrame([(x,) for x in odd], "lang string").select("lang", langid.code_of(F.col("lang")).alias("code"))
    assert [(r.lang, r.code) for r in df.collect()] == [(x, langid.label_code(x)) for x in odd]
    rng = np.random.default_rng(0)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(k, f"junk{k // 2}", EN) for k in range(1200)] + [(2000 + k, f"tr-{k}", " ".join(rng.choice(words, 8))) for k in range(80)]
    p = langid.train_profiles(spark.createDataFrame(rows, "link_id long, lang string, caption string"), ["caption"])
    assert "tr" in p.names


def test_learning_drops_wrong_labels():
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = np.random.default_rng(0)
    odd = [" ".join(rng.choice(words, 8)) for _ in range(80)]
    p = langid.learn([("xx", t) for t in odd] + [("xx", EN)] * 10 + [("en", EN)] * 60)
    assert "xx" in p.names
    best, _ = p.classify([EN, odd[0]])
    assert [p.names[b] for b in best] == ["en", "xx"]


# --- leaks -------------------------------------------------------------------------------------
ITEM = "Read this now. " + " ".join(f"the {a} {b} carried {n} boxes over a {c} hill" for n, (a, b, c) in enumerate(zip("red old tall soft wide late cold".split(), "mule cart horse barge train crane lorry".split(), "green stony foggy sunny mossy windy quiet".split(), strict=True))) + ". What came first?"
ITEM2 = "Read this now. " + " ".join(f"every {a} painter sold {n} frames near one {c} river" for n, (a, c) in enumerate(zip("calm loud rich poor kind shy bold".split(), "deep blue slow wild long icy broad".split(), strict=True))) + ". What came first?"


def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
    return d[-1]


def test_banded_distance_equals_the_full_one():
    rng = np.random.default_rng(1)
    left = [rng.integers(0, 4, rng.integers(1, 40)).astype(np.uint32) for _ in range(30)]
    right = [np.delete(x, rng.integers(0, len(x), min(3, len(x) - 1))) if len(x) > 1 else x for x in left]
    assert list(leakage.banded_distance(left, right, 32)) == [edit_distance(a.tolist(), b.tolist()) for a, b in zip(left, right, strict=True)]


def test_passages_lose_shared_sentences(spark):
    items = spark.createDataFrame([(1, ITEM), (2, ITEM2), (3, "Read this now. What came first?"), (4, ""), (5, None), (6, ITEM2)], "item_id long, text string")
    got = {r.item_id: r.passage for r in leakage.passages(items, "item_id", "text").collect()}
    assert got[1].startswith("the red mule") and got[1].endswith("quiet hill.") and set(got) == {1, 2, 6} and got[2] == got[6]


def test_codes_and_grams():
    texts = ["Ab-c  d", "", " ..", "É_1 ", "x" * 30]
    code, starts = leakage.encode(texts)
    assert ["".join(map(chr, code[a:b])) for a, b in zip(starts, starts[1:])] == ["ab c d", "", "", "é 1", "x" * 30]
    g = leakage.grams(leakage.codes("the same words twice: the same words twice"))
    assert len(g) == 42 - leakage.Q and g[0] == g[21] and len(set(g.tolist())) == 21


def test_leaks(spark):
    body = leakage.codes(ITEM).tobytes().decode("utf-32-le")[14:-16].strip()
    third, half = body[: len(body) // 3 + 20], len(body) // 2
    wrapped = "\n".join("> " + body[i : i + 50] for i in range(0, len(body), 50))
    altered = body.replace("carried", "caried").replace("hill", "hil").upper()
    docs = [(1, "before " + third + " after"), (2, f"{body[:120]} {'filler words here ' * 40} {body[half : half + 120]}"), (3, "x " + wrapped), (4, altered), (5, "Read this now. What came first?"), (6, "the red mule carried 0 boxes"), (7, None), (8, ""), (9, "noise " * 50_000 + body), (9, body)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, ITEM2), (3, None), (4, "Read this now.")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(df, items).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (9, 1), (9, 1)]
    assert leakage.find_leaks(df, items.limit(0)).count() == 0 and leakage.find_leaks(df.limit(0), items).count() == 0
    in_blocks = sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(df, items, block_mb=0.0003).collect())
    assert in_blocks == got


# --- spam pages --------------------------------------------------------------------------------
PROSE = "I bought the old kettle in the market and it was not what I had wanted, but the man who sold it to me said that it would last for years. "


def test_spam_pages(spark):
    soup, links = "cheap kettle buy kettle kettle online best kettle sale " * 30, " ".join(f"https://a{i}.example/p/{i} kettle" for i in range(60))
    listed = PROSE * 5 + "\n" + "\n".join(f"kettle {i}" for i in range(10))
    docs = [(i, PROSE * (2 + i % 3) + f"It was number {i}.") for i in range(40)] + [(100, soup), (101, links), (102, "#one #two #three " * 30), (103, listed), (104, None), (105, ""), (106, PROSE + soup), (107, PROSE * 12 + soup[:200]), (100, soup)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in stuffing.find_stuffed(df).collect()) == [100, 101, 102, 106]
    assert stuffing.find_stuffed(df.limit(0)).count() == 0
    curve = {r.id: r for r in stuffing.curves(df.where("doc_id in (1, 100)"), "doc_id").collect()}
    assert curve[1].lang == "en" and curve[1].prose > 0.3 > 0.1 > curve[100].prose and curve[100].stuffed > 0.5


# --- frames and residue ------------------------------------------------------------------------
def pages():
    rng = np.random.default_rng(3)
    words = "kettle market river window letter garden winter bridge summer road".split()
    rows, n = [], 0
    for s in range(12):
        menu, foot = [f"Menu{chr(97 + s)} home", f"Shop{chr(97 + s)} deals"], f"(c) 2024 Site{s}x company"
        for k in range(12):
            body = ["The " + " ".join(rng.choice(words, 14)) + " was what I saw in the town, and it was not the one that I had thought of." for _ in range(2)]
            sub = ["What we found"] if rng.random() < 0.4 else []
            title = " ".join(rng.choice(words, 4)) + f" {n}x"
            rows.append((n, f"https://www.site{s}x.example/p/{title.replace(' ', '-')}-{n}", "\n".join([*menu, title, body[0], *sub, body[1], foot]), 200))
            n += 1
    return rows


BODY = "body_id long, url string, text string, http_status int"


def test_frames(spark):
    rows = pages()
    extra = [(9001, None, "a text without any page", 200), (9002, "https://www.site1x.example/p/z", None, 200), (9003, "https://www.site1x.example/p/y", "", 404)]
    df = spark.createDataFrame(rows + extra, BODY)
    got = {}
    for r in boilerplate.find_furniture(df, chunk=5).collect():
        got.setdefault(r.body_id, set()).add(r.line_no)
    for n, _, text, _ in rows:
        lines = text.split("\n")
        assert got[n] == {1, 2, len(lines)}, (text, got[n])
    assert not {9001, 9002, 9003} & set(got)
    main = {r.body_id: r.text for r in boilerplate.main_texts(df).collect()}
    assert main[0].split("\n")[0] == rows[0][2].split("\n")[2]
    assert boilerplate.find_furniture(df.limit(0)).count() == 0


def test_frames_of_pages_without_a_path(spark):
    foot, rows = "write to the office of this house", [(n, u, t, s) for n, u, t, s in pages()]
    plain = [(f"{t.split(chr(10))[3]}\n{foot}") for _, _, t, _ in rows[:40]]
    odd = [(5000 + i, [None, "", "no-host/page"][i % 3], t, 200) for i, t in enumerate(plain)]
    asked = [(6000 + i, f"https://www.asked.example/index.php?id={i}", t.replace(foot, "all rights stay with the asked firm"), 200) for i, t in enumerate(plain)]
    again = [(7000 + i, "https://www.asked.example/index.php?id=0&ref=x", asked[0][2] + "\nseen in one text only", 200) for i in range(5)]
    df = spark.createDataFrame(rows + odd + asked + again, BODY)
    known = {(r.site, r.key): r.verdict for r in boilerplate.induce(df).collect()}
    assert known["", boilerplate.code("=" + foot)] == "t"
    assert known["asked.example", boilerplate.code("=all rights stay with the § firm")] == "t"
    # five refetches of one text are one page
    assert ("asked.example", boilerplate.code("=seen in one text only")) not in known
    found = {(r.body_id, r.line_no) for r in boilerplate.find_furniture(df).collect()}
    assert {(r[0], 2) for r in odd + asked} <= found


def test_sites(spark):
    urls = {"https://a.co.uk/x": "a.co.uk", "http://www.b.co.in": "b.co.in", "//news.c.example/": "c.example", "https://user@d.example:80/p": "d.example", "plain": "", None: "", "https://co.uk/": "co.uk", "https://h/": "h"}
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", boilerplate.site_column(F.col("url")).alias("site"))
    assert {r.url: r.site for r in df.collect()} == urls == {u: boilerplate.site_of(u) for u in urls}


def test_language_is_that_of_the_whole_text():
    assert boilerplate.language(f"{DE} " * 80 + f"{EN} " * 200) == "en"


def test_slots():
    yes = ["Dear {{ name }}, hello", "Order <%= id %> now", "for *|STORE|*", "a __PRICE__ list", "[Insert date here]", "@Model.Name", "%FIRST_NAME% won"]
    no = ['It began with "Dear [First Name]" and', "the software prints {{price}} when a field is empty", "a 5% rise", "see [1] there", "x < y > z", "__init__"[:1]]
    assert [residue.open_slots(x) for x in yes + no] == [True] * len(yes) + [False] * len(no)


def test_residue(spark):
    bad = ["Page not found\nPlease try again in 5 minutes.", "Access denied\nToo many requests from your network.", "Please enable JavaScript to continue.\nError code 403", "Your text goes here. Text text text text."]
    rows = pages()
    rows += [(1000 + i, f"https://www.site{i % 12}x.example/p/err-{i}", bad[i % 4] + f"\nReference {i}", 200 if i % 3 else 404) for i in range(48)]
    rows += [(2000, "https://www.site1x.example/p/long", (PROSE * 4) + "It cost {{ price }} in all.", 200), (2001, "https://www.site1x.example/p/talk", (PROSE * 4) + "The site showed \"page not found\" for a day.", 404), (2002, "https://www.site1x.example/p/none", None, 404)]
    df = spark.createDataFrame(rows, BODY)
    got = {r.body_id for r in residue.find_residue(df).collect()}
    assert 2000 in got and not {2001, 2002} & got
    assert len(got & set(range(1000, 1048))) >= 46 and len(got & set(range(144))) == 0
    assert residue.find_residue(df.limit(0)).count() == 0


def test_held_out_hosts():
    sample = [(f"s{i % 20}.example", PROSE * 3 + f"Number {i}.", 200, True) for i in range(120)] + [(f"s{i % 20}.example", f"Access denied\nError code {i}\nPlease try again later.", 403, False) for i in range(60)]
    known = np.ones(1 << residue.WORD_BITS, bool)
    assert residue.train(sample, known).held_out["accuracy"] > 0.95


def test_common_words_count_each_text_once(spark):
    texts = [("one two", i) for i in range(50)] + [(f"one red {w}", 100 + i) for i, w in enumerate("abc")] + [("", 200), (None, 201)]
    known = residue.vocabulary(spark.createDataFrame(texts, "text string, body_id long"))
    assert known[residue.word_bit("one")] and known[residue.word_bit("red")] and not known[residue.word_bit("two")]


# --- mixtures ----------------------------------------------------------------------------------
@pytest.fixture
def vocabulary(tmp_path):
    import base64

    (tmp_path / "byte_bpe_50k.tiktoken").write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    return str(tmp_path)


def test_mixture(spark, vocabulary):
    rng = np.random.default_rng(5)
    docs = [(i, "A" if i % 10 < 8 else ("b " if i % 10 == 8 else "C"), "x" * int(rng.integers(20, 200))) for i in range(1500)] + [(5000, None, "x"), (5001, "other", "x"), (5002, "a", None), (5003, "a", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    goals = spark.createDataFrame([("a", 0.4, 1), ("B", 0.4, 3), ("c", 0.2, 3), ("d", 0.0, 1), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixture.mix(df, goals, folder=vocabulary)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"a", "b", "c"}
    assert all(abs(r.actual_share - r.target_share) < 0.01 and r.reachable for r in got.values())
    most = {r.source: r.m for r in chosen.groupBy("source").agg({"copies": "max"}).withColumnRenamed("max(copies)", "m").collect()}
    assert most["a"] <= 1 and most["b"] <= 3 and most["c"] <= 3 and chosen.where("copies < 1 or n_tokens < 1").count() == 0
    # more than the caps allow: the small sources stay below their share, and the report says so
    low = {r.source: r for r in mixture.mix(df, goals, total=1e6, folder=vocabulary)[1].collect()}
    assert not low["b"].reachable and low["b"].n_copies <= 3 * 150
    empty = mixture.mix(df.limit(0), goals, folder=vocabulary)
    assert empty[0].count() == 0 and {r.tokens for r in empty[1].collect()} == {0}
