"""Operators of tallyrow.llm against plain versions, on small tables with every kind of odd row."""

import hashlib
import html
import re

import pytest

from oracle import duck, _rows
from tallyrow.llm import contamination, licenses, maintext, mixing, neardup, ordermin, quality, repeats, reputation, tokens
from tallyrow.llm.queries import QUERIES, SQL

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
COLUMNS = "doc_id long, text string, score double, n_words long, registers string, __key int"
PASSAGE = " ".join(f"p{i}" for i in range(60))
LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(30_000))
ODD = [
    (1, f"start {PASSAGE} end of one"),
    (2, f"Other words\nbefore {PASSAGE}"),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "same same same"),
    (6, "same same same"),
    (7, "one two three four"),
    (None, f"null id {PASSAGE}"),
    (8, LONG),
    (9, "rep " * 200),
    (10, "Ünïcode wörter ça 漢字 " * 9 + "CC BY, all rights reserved; CC-BY"),
    (11, "Licensed under the Apache License, Version 2.0. General Public License"),
    (12, f"{PASSAGE} tail"),
    (13, f"{PASSAGE} tail!"),
]


def make(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 7, "x", 1) for i, t in rows], COLUMNS)


@pytest.fixture(scope="module")
def odd(spark):
    return make(spark, ODD)


def spaced(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


def alnum(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().translate(LOWER))


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_empty_tables_give_empty_results(spark, tmp_path):
    none = make(spark, [])
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = quality.fit_quality(none, marks)
    for found in (
        repeats.repeat_report(none),
        quality.score_quality(none, model),
        tokens.count_tokens(none, tokens.tokenizer_file()),
        contamination.find_matches(none, items),
        mixing.mixing_rates(none, spark.createDataFrame([], "doc_id long, domain string")),
        reputation.judge(pages, spark.createDataFrame([], "host string, bad int")),
        maintext.extract(pages),
        ordermin.fingerprint(none),
        neardup.link_near_duplicates(none),
        licenses.scan_licenses(none),
    ):
        assert found.count() == 0


def plain_repeats(rows, window):
    from collections import Counter

    docs = [spaced(t) for _, t in rows]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for (doc_id, _), d in zip(rows, docs):
        gone = set()
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(d) if i not in gone)
        out.append((doc_id, len(d), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 3])
def test_repeats(odd, window):
    assert ordered(repeats.repeat_report(odd, window).collect()) == ordered(plain_repeats(ODD, window))


def test_repeats_cut_from_texts(odd):
    out = {r.doc_id: r for r in repeats.without_repeats(odd).collect()}
    assert out[1].text == "start end of one" and out[1].n_words == 7
    assert out[3].text is None and out[5].text == "   \n\t " and out[9].text == ""
    assert out[8].text == LONG


def test_quality_learns_and_keeps(spark):
    rows = [(i, ("*** $$$ junk" if i % 3 == 0 else "the plain words of a text") + f" w{i}") for i in range(300)]
    docs = make(spark, [*rows, (None, None), (5, "the plain words of a text w5")])
    marks = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, marks)
    scored = quality.score_quality(docs, model).collect()
    assert len(scored) == 302 and all(0 <= r.score <= 1 for r in scored)
    assert all(r.predicted == (r.score >= 0.3) for r in scored)
    held = [r for r in scored if r.held_out]
    assert held and sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.95 * len(held)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 2


def test_token_counts(odd):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.tokenizer_file())
    want = []
    for i, t in ODD:
        n = len(own.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert ordered(tokens.count_tokens(odd, tokens.tokenizer_file()).collect()) == ordered(want)


def test_tokens_of_special_strings_and_long_texts(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.tokenizer_file())
    texts = ["a<|endoftext|>b <|startoftext|>", "x\u00a0y\u2003z\x1cq", "It's we'll 2024 ΑΣ", "ab " * 500_000]
    found = tokens.count_tokens(make(spark, list(enumerate(texts))), tokens.tokenizer_file()).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(own.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}


ITEMS = [(1, "p3 p4 p5 P6 p7 p8 p9 p10 p11 p12 p13 p14"), (2, "same same"), (3, None), (4, ""), (5, "three, FOUR"), (5, "three, FOUR"), (None, "tail")]


@pytest.mark.parametrize("block_words", [contamination.BLOCK_WORDS, 4])
def test_contamination(spark, odd, block_words):
    want = []
    for doc_id, text in ODD:
        d, hit, items = alnum(text), set(), set()
        for item, words in ((i, alnum(t)) for i, t in ITEMS):
            size = min(10, len(words))
            for j in range(len(words) - size + 1 if size else 0):
                for i in range(len(d) - size + 1):
                    if d[i : i + size] == words[j : j + size]:
                        hit.update(range(i, i + size))
                        items |= {str(item)} if item is not None else set()
        want.append((doc_id, len(d), len(hit), tuple(sorted(items))))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = contamination.find_matches(odd, bench, block_words=block_words).collect()
    assert ordered((r.doc_id, r.n_words, sum(s.behind - s.first for s in r.spans), tuple(r.item_ids)) for r in found) == ordered(want)
    clean = contamination.clean_rows(odd, bench, block_words=block_words)
    assert clean.count() == sum(not w[2] for w in want) and clean.columns == odd.columns


def test_proximity(spark):
    docs = make(spark, [(1, "c x b y a"), (2, "a " + "x " * 50 + "b c")])
    found = contamination.find_matches(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string"), slop=3).collect()
    assert {r.doc_id: (r.item_ids, r.near_item_ids) for r in found} == {1: ([], ["1"]), 2: ([], [])}


def test_mixing_meets_targets(spark):
    rows = [(i, ("der die das und" if i % 5 == 0 else "the of and to") + f" q{i % 7}") for i in range(400)]
    docs = make(spark, [*rows, (None, None), (401, "")])
    labelled = spark.createDataFrame([(i, "de" if i % 5 == 0 else "en") for i in range(200)], "doc_id long, domain string")
    found = mixing.mixing_rates(docs, labelled, {"de": 0.5, "en": 0.5}).collect()
    assert len(found) == 402 and all(r.rate >= 1 - 1e-9 and r.copies >= 1 for r in found)
    total = [sum(r.rate * r.n_tokens * r.posteriors[k] for r in found) for k in (0, 1)]
    assert abs(total[0] / sum(total) - 0.5) < 0.02
    out = mixing.mixed(docs, labelled, {"de": 0.5, "en": 0.5})
    assert out.columns == [*docs.columns, "rate", "copies"] and out.count() == 402


URLS = ["http://A.Example.com/en/5", "https://www.example.com/en/1?x=/", "http://x.net/es/", "net://net/fr/1#a", "nothing", None, "http://com", "ftp://deep.www.example.com/en/", "http://notexample.com/en/1", "x://a.org?://b.com/"]


def test_url_rules_and_reputation(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (3, URLS[3])], "page_id long, url string")
    bad = [("bad.org", 1)] * 60 + [("good.org", 0)] * 60 + [(None, 1)]
    outcomes = spark.createDataFrame(bad, "host string, bad int")
    found = {r.page_id: r for r in reputation.judge(pages, outcomes).collect()}
    assert [found[i].rule for i in range(10)] == ["example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, "www.example.com/en/", "com/", None]
    assert (found[0].host, found[0].path) == ("a.example.com", "/en/5") and (found[5].host, found[5].path) == ("", "")
    assert found[9].host == "a.org" and found[9].path == ""
    hosts = spark.createDataFrame([(1, "http://bad.org/a"), (2, "http://good.org/a")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in reputation.judge(hosts, outcomes).collect()} == {1: "block", 2: "allow"}


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="/a">Home</a></nav>
<div class="ad">Buy &amp; save of the and to</div><article><header>By me</header><h1>Head &amp;  line</h1><p><b>First &lt;one&gt;<br>half
<p>The second of the long blocks of this text, which has stop words and is long enough to be decided.</p>Short.
<aside>Aside text</aside><div class="comments"><p>Nice!</p></div><form>Name <input></form></article>
<footer>&copy; all</footer></body>"""


def test_main_text(spark):
    want = "Head & line\nFirst <one> half\nThe second of the long blocks of this text, which has stop words and is long enough to be decided.\nShort."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>x"), (None, "u", "<<a '" * 3_000), (1, "u", PAGE)]
    found = maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 6
    assert [r.text for r in found if r.page_id == 1] == [want] * 2
    assert all(r.n_chars == len(r.text) for r in found) and [r.text for r in found if r.page_id in (2, 3)] == ["", ""]


def test_main_text_is_the_article(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op7_main_text"](spark, sf_dir).collect():
        article = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?p>|</?h1>", article))
        assert r.text == "\n".join(b for b in blocks if b)


def test_order_minhash(spark, odd):
    found = ordermin.fingerprint(odd).collect()
    assert len(found) == len(ODD)
    rows = sorted(ODD, key=lambda r: -1e9 if r[0] is None else r[0], reverse=True)
    want = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        want.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    assert ordered((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == ordered(want)
    prints = {}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert len(prints[6]) == 1 and prints[3] == prints[4]
    near = {r.doc_id: r.near_next for r in found}
    assert near[13] > 0.5 and near[2] < 0.9


def test_order_and_occurrences_matter(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words[20:] + words[:20]), "a b c " * 30, "a b c " * 31]
    rows = ordermin.add_signature(make(spark, list(enumerate(texts))), "text", "s").select("doc_id", "s").collect()
    s = {r.doc_id: set(r.s) for r in rows}
    assert s[0] != s[1] and len(s[0] & s[1]) > 10 and s[2] != s[3]


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = spaced((t or "").encode().translate(LOWER).decode())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if group[m] == group[k] and rows[m][0] is not None]
        component = min(ids) if ids and sets[k] else doc_id
        out.append((doc_id, len(sets[k]), component, doc_id == component))
    return out


def variants():
    base = [f"b{i}" for i in range(120)]
    rows = [(100 + k, " ".join(["X%d" % k if k and i % 97 in range(k % 9) else w for i, w in enumerate(base)])) for k in range(40)]
    return [*ODD, *rows]


def test_near_duplicates(spark, monkeypatch):
    rows = variants()
    for small, block in ((neardup.SMALL, neardup.BLOCK), (2, 3)):
        monkeypatch.setattr(neardup, "SMALL", small)
        monkeypatch.setattr(neardup, "BLOCK", block)
        found = neardup.link_near_duplicates(make(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept")
        assert ordered(found.collect()) == ordered(plain_components(rows))


def test_one_row_of_each_component(spark):
    rows = variants()
    kept = neardup.one_of_each(make(spark, rows))
    assert ordered([r.doc_id] for r in kept.collect()) == ordered({(i,) for i, _, _, k in plain_components(rows) if k})


def test_licenses(spark, odd):
    assert len(licenses.signatures()) > 200
    assert all(len({r.label for r in licenses.signatures() if r.label == s.label}) == 1 for s in licenses.signatures())
    found = {r.doc_id: r for r in licenses.scan_licenses(odd).collect()}
    assert (found[10].n_base, found[10].base_labels) == (3, "cc-by,reserved")
    first = alnum(ODD[11][1]).index(b"cc")
    assert (found[10].first_word, found[10].last_word) == (first, first + 5)
    assert found[11].labels == "apache-2.0,gpl" and found[11].base_labels == "gpl" and found[11].score == 0.95
    assert found[3].n_words == 0 and found[3].labels == "" and found[3].first_word is None
    assert all(r.n_words == len(alnum(dict(ODD)[r.doc_id])) for r in found.values())


def test_license_suppression():
    wide, inner, other = (0, 30, 50, 0.9, "a"), (5, 20, 30, 0.8, "b"), (25, 40, 30, 0.8, "c")
    assert licenses.suppressed([inner, other, wide]) == [wide, other]
    assert licenses.suppressed([(0, 30, 10, 0.5, "a"), inner]) == [(0, 30, 10, 0.5, "a"), inner]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck(sf_dir).execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, result.fetchall())


def test_native_operators_use_no_python(spark, sf_dir):
    for name in ("op6_url_reputation", "op8_order_minhash"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
