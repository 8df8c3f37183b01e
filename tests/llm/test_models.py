"""Language, URL, HTML, search and toxicity operators."""

import random
import time
import zlib

import numpy as np
import pytest

from factorlab.llm import langid, mainhtml, topk, toxicity, urlfilter
from factorlab.llm.queries import ORACLE, QUERIES
from workload.check import difference, duck

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op4_url_filter", "op8_top_k"])
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert difference(got, duck(SMALL).execute(ORACLE[name]).df()) is None


def test_languages_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op3_language"](spark, MIDDLE).collect()]
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert len(held) > 200 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_grams_do_not_depend_on_pieces(monkeypatch):
    table, text = langid._codes_table(), "Ein Text, in Stücke geteilt \U0001f600 字 " * 20
    whole = np.sort(np.concatenate(list(langid._grams(text, table))))
    monkeypatch.setattr(langid, "_PIECE", 7)
    assert (np.sort(np.concatenate(list(langid._grams(text, table)))) == whole).all()
    # one for each order and place that begins before the end and reaches a letter
    codes = [0, 0, *(ord(c.lower()) if c.isalpha() else 0 for c in text if ord(c) < 0x3000), 0, 0]
    assert len(whole) >= sum(any(codes[i:i + n]) for i in range(len(codes) - 2) for n in (1, 2, 3)) - 200


def test_awkward_languages(awkward, nothing):
    out = {r["doc_id"]: r for r in langid.predict(awkward, langid.fit(awkward)).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (2, 3, 5))
    assert out[6]["lang_pred"] in ("en", "de")
    assert langid.predict(nothing, langid.fit(awkward)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(awkward, langid.fit(nothing)).collect()} == {"und"}


@pytest.mark.parametrize("url,host,path", [
    ("HTTP://WWW.Example.COM/A/b?x#y", "www.example.com", "/A/b"), ("http://a.b?x=/1", "a.b", ""), ("no scheme/x", "", ""),
    (None, "", ""), ("://h#/p", "h", ""), ("x://y://z/w", "y:", "//z/w"), ("http://É.example/x", "É.example", "/x")])
def test_url_parts(url, host, path):
    assert urlfilter.split_url(url) == (host, path)


def test_url_rules_and_terms(spark):
    rules = {"net/": "block", "example.net/en/": "allow"}
    cases = {"http://example.net/en/1": "allow", "http://a.example.net/en": "block", "http://notexample.net/en/": "block",
             "http://a.net": "allow", "http://a.org/porn": "block", "http://a.org/pornography": "allow",
             "http://a.org/free-bets": "block", "http://a.org/free/free": "allow", "http://a.org/FREE_win": "block", None: "allow"}
    frame = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string").selectExpr("*", "1 as host", "2 as rule")
    got = {r["url"]: r["verdict"] for r in urlfilter.judge(frame, rules).collect()}
    assert got == cases
    assert urlfilter.judge(frame.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(frame, {}, {}).collect()} == {"allow"}


def test_many_rules_and_long_urls():
    chance = random.Random(9)
    names = ["a", "b", "cc", "d-e"]

    def some():
        host = ".".join(chance.choice(names) for _ in range(chance.randint(1, 4)))
        return host, "".join("/" + chance.choice(["", "x", "yy"]) for _ in range(chance.randint(0, 3)))
    rules = {"".join(some()): "block" for _ in range(400)} | {"cc/": "allow", "": "block", "/": "allow"}
    lookup = urlfilter.Rules(rules)
    for _ in range(2000):
        host, path = some()
        fits = [r for r in rules for d, m, p in [r.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith(m + p)]
        assert lookup.best(host, path) == max(fits, key=lambda r: (len(r), r), default=None)
    large = urlfilter.Rules({f"h{i}.example/p{i % 7}/": "block" for i in range(100_000)})
    started = time.monotonic()
    assert [large.best(f"www.h{i}.example", f"/p{i % 7}/x") for i in range(3000)] == [f"h{i}.example/p{i % 7}/" for i in range(3000)]
    assert large.best("x." * 200_000 + "h5.example", "/p5/" + "y" * 1_000_000) == "h5.example/p5/" and time.monotonic() - started < 20


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<body><nav>menu</nav><p>One\n two<br>three<p>four &lt;b&gt;</body>", "One two three four <b>"),
    ("<div class='ad'>x</div><article><h1>T</h1><p>a<b>b</b>c</p><div class='comments'><p>no</p></div></article>", "T abc"),
    ("<article><p>a<script>var t='</p>';</script>b<style>p{}</style></p><!-- <p>c</p> --></article><footer>f</footer>", "ab"),
    ("<main><ul><li>x<li>y</ul></main><aside>z</aside><form><p>q</p></form>", "x y"),
    ("<div class='sidebar'><p>all there is</p></div>", "all there is"), ("<p>caf&eacute;&nbsp;&#x41;", "café A")])
def test_main_text_of_one_page(html, text):
    blocks = mainhtml.read_blocks(html)
    assert mainhtml.below(blocks, mainhtml.best_container(blocks)) == text


@pytest.mark.parametrize("wrapper", [
    "class='layout has-sidebar'", "class='no-sidebar'", "class='comments-open'", "class='with-header'", "id='search-results'",
    "class='banner'", "role='search'"])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_wrappers_do_not_lose_the_article(wrapper, tag):
    """Another line of the page must not become its whole text, whatever the wrapper is called."""
    html = (f"<div {wrapper}><{tag}><p>The whole article, longer than all else.</p><div class='share'>Send on</div></{tag}></div>"
            "<p>2024</p>")
    blocks = mainhtml.read_blocks(html)
    assert [x[1] for x in blocks] == ["The whole article, longer than all else.", "2024"]
    short = f"<div {wrapper}><article><p>Short.</p></article></div><p>{'Imprint and terms of use. ' * 5}</p>"
    assert "Short." in [x[1] for x in mainhtml.read_blocks(short)]


def test_classes_that_remove_most_of_the_text_are_ignored():
    parts = "".join(f"<div class='{c}'><p>A third of the text.</p></div>" for c in ("widget", "promo", "related"))
    assert len(mainhtml.read_blocks(parts + "<p>2024</p>")) == 4
    short = "<article><p>Short.</p></article><div class='ad'>An advertisement longer than that.</div>"
    assert [x[1] for x in mainhtml.read_blocks(short)] == ["Short."]
    html = "<p>An article that is the longest part of the page.<span class='ad'>Buy</span></p><div class='comments'>No</div>"
    assert [x[1] for x in mainhtml.read_blocks(html)] == ["An article that is the longest part of the page."]


LONG = "Reader comments go on and on, far longer than the story that they are about. " * 9


def main_text(html):
    blocks = mainhtml.read_blocks(html)
    return mainhtml.below(blocks, mainhtml.best_container(blocks))


@pytest.mark.parametrize("name", ["comments", "ad", "menu", "cookie consent", "replies"])
@pytest.mark.parametrize("page", [
    "<div class='story'><p>A short story.</p></div><div class='{0}'><p>{1}</p></div>",
    "<article><p>A short story.</p><section class='{0}'><p>{1}</p></section></article>",
    "<article><p>A short story.</p></article><section class='{0}'><article class='{0}'><p>{1}</p></article></section>",
    "<main><div class='{0}'><div><p>{1}</p></div></div><p>A short story.</p></main>"])
def test_no_length_makes_comments_menus_or_adverts_the_article(name, page):
    assert main_text(page.format(name, LONG)) == "A short story."


@pytest.mark.parametrize("tag", ["nav", "form", "aside", "header"])
def test_an_unclosed_menu_or_form_does_not_swallow_the_article(tag):
    story = "<p>The story of the page, which is longer than its menu.</p><p>Its end.</p>"
    assert main_text(f"<body><{tag}><a href='/'>Home</a><article>{story}</article></body>") == "The story of the page, which is longer than its menu. Its end."
    assert "Its end." in main_text(f"<body><{tag}><a href='/'>Home</a><div class='story'>{story}</div></body>")
    assert "Home" not in main_text(f"<body><{tag}><a href='/'>Home</a></{tag}><div class='story'>{story}</div></body>")


@pytest.mark.parametrize("piece", ["<div>line ", "<div class='ad'>line ", "<section><p>line", "<div></span>line "])
def test_deep_pages_take_time_in_proportion(piece):
    started = time.monotonic()
    text = main_text(piece * 10_000)
    assert text.startswith("line") and time.monotonic() - started < 3
    assert main_text("<div>" * 300 + "<p>deep</p>") == "deep"


def test_scores_equal_the_sum_over_all_prefixes():
    chance = random.Random(4)
    for _ in range(60):
        html, depth = "", 0
        for _ in range(40):
            if chance.random() < .55 or not depth:
                html += f"<div class='c{chance.choice('xyz')}'>"
                depth += 1
            else:
                html += "</div>"
                depth -= 1
            html += f"<p>{'w' * chance.randrange(1, 9)}</p>" if chance.random() < .6 else ""
        blocks = mainhtml.read_blocks(html)
        scores = {}
        for node, text, linked in blocks:
            path, worth = blocks.path(node), float(len(text))
            for k in range(len(path), 0, -1):
                scores[path[:k]] = scores.get(path[:k], 0.0) + worth
                worth /= 2
        assert mainhtml.best_container(blocks) == (min(scores, key=lambda p: (-scores[p], p)) if scores else ())
        best = mainhtml.best_container(blocks)
        assert mainhtml.below(blocks, best) == " ".join(t for n, t, _ in blocks if blocks.path(n)[:len(best)] == best)


def test_hosts_agree_on_a_path(spark):
    """One page's largest container is an odd one; its host's other pages decide."""
    usual = "<div class='story-{i}'><p>{a}</p><p>tail</p></div><div class='more'><p>{b}</p></div>"
    pages = [(i, f"http://h.example/{i}", usual.format(i=i, a="main text of the page " * 5, b="other words")) for i in range(6)]
    pages += [(6, "http://h.example/6", usual.format(i=6, a="short", b="far longer than the story itself " * 9)),
              (7, "http://g.example/7", "<p>lone</p>"), (8, None, "<p>no host</p>"), (8, None, "<p>no host</p>"), (9, "http://h.example/9", None)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "1 as path", "2 as site", "3 as text")
    for limit in (mainhtml.BROADCAST_HOSTS, -1):
        mainhtml.BROADCAST_HOSTS, before = limit, mainhtml.BROADCAST_HOSTS
        got = {r["page_id"]: r["text"] for r in mainhtml.extract(frame).collect()}
        mainhtml.BROADCAST_HOSTS = before
        assert got[6] == "short tail" and got[7] == "lone" and got[8] == "no host" and got[9] == ""
        assert got[0] == " ".join(("main text of the page " * 5).split()) + " tail"
    assert mainhtml.extract(frame.limit(0)).count() == 0


def test_main_text_query(spark):
    rows = QUERIES["op6_main_text"](spark, SMALL).collect()
    assert len(rows) == 50 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert not any("var t=" in r["text"] or "&copy;" in r["text"] or "<" in r["text"][:40] for r in rows)


@pytest.mark.parametrize("segments", [3, 8])
def test_top_k_equals_brute_force(spark, segments):
    rng = random.Random(segments)
    base = [rng.getrandbits(64) for _ in range(6)]
    codes = [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 0, 1, 3, 9]))) for _ in range(150)]
    codes += [base[0]] * 30
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    frame = spark.createDataFrame([*enumerate(signed), (0, signed[0]), (None, 5), (999, None)], "id bigint, code bigint")
    asked = frame.where("id % 30 = 0").withColumnRenamed("id", "query_id").distinct()
    got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in topk.top_k(frame, asked, 7, segments).collect()}
    want = {}
    for q in range(0, 180, 30):
        near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes))[:7]
        want |= {(q, n + 1): (i, d) for n, (d, i) in enumerate(near)}
    assert got == want
    few = frame.where("id < 3")
    assert topk.top_k(few, asked.where("query_id = 0"), 7).count() == 3
    assert topk.top_k(frame.limit(0), asked).count() == 0 and topk.top_k(frame, asked.limit(0)).count() == 0


def test_codes(spark):
    rows = [(1, [0.5, -0.1, 0.0, 2.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0] * 64)]
    code = topk.binary_code().alias("c")
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("vec_id", code)
    assert dict(map(tuple, frame.collect())) == {1: 9, 2: None, 3: None, 4: None, 5: None, 6: -1}
    long = spark.createDataFrame([(7, [1.0] * 65)], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="64 bits"):
        long.select(code).collect()


def toxic_docs(spark, n=600):
    rng = random.Random(2)
    words = [a + b for a in "abcdefgh" for b in ("ra", "to", "ni", "lu", "se")]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=30)
        bad = i % 6 == 0
        if bad:
            text.insert(rng.randrange(30), rng.choice(["vexoling", "vexolora", "Grumbax"]))
        rows.append((i, " ".join(text), int(bad)))
    rows += [(n + i, " ".join(["copied", "sentence", "of", "toxic", "kind"] * 3), 1) for i in range(40)]
    return (spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"),
            spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"), {r[0]: r[2] for r in rows})


def test_toxicity_learns_telling_words_and_not_those_of_copies(spark):
    docs, labels, truth = toxic_docs(spark)
    model = toxicity.fit(docs, labels)
    assert {t[:4] for t in model.terms} == {b"vexo", b"grum"}
    rows = toxicity.score(docs, model).collect()
    assert all(r["predicted"] == truth[r["doc_id"]] for r in rows if r["doc_id"] < 600)
    assert all(truth[i] for r in rows if r["predicted"] for i in r["evidence"])
    # the copies are labelled toxic, so they go, although no word of theirs is telling
    assert toxicity.without_toxic(docs, labels).count() == 500


def test_copies_of_toxic_examples_are_toxic(spark):
    """Every toxic example has words of its own, so that none of them is telling."""
    rng, letters = random.Random(5), "bcdfghklmnprstvwz"
    words = ["".join(rng.choices(letters, k=7)) for _ in range(900)]
    plain = [(i, " ".join(rng.choices(words[:300], k=30)), 0) for i in range(300)]
    learned = [i for i in range(300, 400) if zlib.crc32(str(i).encode()) % 3 != 1][:30]
    held = [i for i in range(400, 600) if zlib.crc32(str(i).encode()) % 3 == 1][:30]
    texts = [" ".join(words[300 + 20 * n:320 + 20 * n] + rng.choices(words[:300], k=5)) for n in range(30)]
    rows = plain + [(i, t, 1) for ids in (learned, held) for i, t in zip(ids, texts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == 1 and got[i]["evidence"][0] == copy for i, copy in zip(held, learned))
    assert not any(got[r[0]]["predicted"] for r in plain)


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_neighbours_are_exact(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(6)
    model = toxicity.Model(terms={str(i).encode(): i for i in range(40)}, idf=np.ones(40))
    counts = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(40, rng.integers(1, 6), replace=False)} for _ in range(700)]
    vectors = [model.vector(c) for c in counts]
    model.index(np.arange(700) * 3, rng.integers(0, 2, 700).astype(float), vectors)
    dense = np.zeros((700, 40))
    for row, (at, w) in zip(dense, vectors):
        row[at] = w
    for i in range(0, 700, 7):
        scores = np.round(dense @ dense[i], 9)
        scores[i] = -1
        want = sorted((x for x in range(700) if scores[x] > 0), key=lambda x: (-scores[x], x))[:toxicity.NEIGHBOURS]
        got, cosines = model.nearest(*vectors[i], leave=i)
        assert got.tolist() == want and np.allclose(cosines, scores[want])


def plain_scores(model, docs):
    """Votes of the nearest examples by dense cosines over all terms, examples and texts."""
    def dense(at, w):
        row = np.zeros(len(model.idf))
        row[at] = w
        return row
    examples = [dense(*model.vector(toxicity._unpacked(model.at[s:e], model.times[s:e]))) for s, e in zip(model.ends, model.ends[1:])]
    for text in docs:
        v = dense(*model.vector(model.counts(text)))
        cosines = [float(v @ x) for x in examples]
        best = [i for i in sorted(range(len(examples)), key=lambda i: (-round(cosines[i], 9), model.ids[i])) if cosines[i] > 0][:10]
        strength = [cosines[i] / (1.01 - min(cosines[i], 1)) for i in best]
        vote = (sum(s * model.toxic[i] for s, i in zip(strength, best)) + 0.1 * model.prior) / (sum(strength) + 0.1)
        yield model.curve[round(vote * 100)], [int(model.ids[i]) for i in best]


def test_scores_equal_a_dense_comparison(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    made = toxicity.Model.of(model.state())
    rows = toxicity.score(docs, model).orderBy("doc_id").collect()
    for r, (score, evidence) in zip(rows, plain_scores(made, [r["text"] for r in rows])):
        assert r["evidence"] == evidence and r["score"] == pytest.approx(score, abs=1e-9)


def test_awkward_toxicity(spark, awkward, nothing):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (4, 1), (4, 1)], "doc_id bigint, toxic int")
    for docs, some in ((awkward, labels), (awkward, labels.limit(0)), (nothing, labels)):
        out = toxicity.score(docs, toxicity.fit(docs, some))
        assert out.count() == docs.count() and all(0 <= r["score"] <= 1 for r in out.select("score").collect())
    assert toxicity.without_toxic(awkward, labels.limit(0)).columns == awkward.columns
