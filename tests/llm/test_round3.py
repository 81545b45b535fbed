"""The operators of the third round against plain versions, on small tables with every kind of odd row."""

import hashlib
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrow.llm import combojoin, contamination, convtrie, filteraudit, maintext, mixing, ordermin, quality, subwords
from tallyrow.llm.queries import SQL

LONG = " ".join(f"w{i % 9000}" for i in range(400_000))
DOCS = [
    (1, "a b c", "s", "en"),
    (5, "a b c", "s", "en"),
    (5, "a b c", "s", "en"),
    (2, None, None, "en"),
    (3, "", "", "en"),
    (None, "", "s", None),
    (None, None, "t", None),
    (4, " \n\t ", "t", "en"),
    (6, LONG, "t", "en"),
    (7, LONG, "s", "en"),
    (8, "WORD " * 300 + "x$", "t", "en"),
    (9, " ".join(f"q{i}" for i in range(250)), "t", "en"),
    (10, "é 漢 " * 5 + "AB|", None, "en"),
    (11, " ".join(f"q{i}" for i in range(250)), "u", "en"),
    (-3, " ".join(f"q{i}" for i in range(250)), "u", "en"),
]
MARKS = [(1, 1, 0), (5, 0, 1), (5, 1, 0), (9, 1, 1), (11, 1, 0), (None, 1, 1), (6, None, 1), (77, 1, 1)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def documents(spark, rows):
    return spark.createDataFrame([(*r, 0, "k", 1) for r in rows], "doc_id long, text string, source string, lang string, mask int, key string, PART int")


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, part string")


def fails(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text))]


def plain_audit(docs, marks):
    rows = []
    for i, t, s, _ in docs:
        t = t or ""
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in docs)
        mine = [m for m in marks if m[0] is not None and m[0] == i]
        rows.append((s or "", [*fails(t), copy], any(m[1] == 1 for m in mine), any(m[2] == 1 for m in mine)))
    out, total = [], {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order):
                f = "ABCDE".index(letter)
                here = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = [r for r in own if r[1][f]]
                total[part, letter] = total.get((part, letter), 0) + len(here)
                unique = sum(sum(r[1]) == 1 for r in failing)
                out.append([part, "".join(order), step + 1, len(left), len(here), len(failing) - len(here), unique, sum(r[2] for r in here), sum(r[3] for r in here)])
    return [(*r, total[r[0], r[1][r[2] - 1]]) for r in out]


def test_filter_audit(spark):
    found = filteraudit.audit_filters(filteraudit.failed_sets(documents(spark, DOCS), labels(spark, MARKS)))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert ordered(found.collect()) == ordered(plain_audit(DOCS, MARKS))


def test_filter_audit_without_rows(spark):
    assert filteraudit.audit_filters(filteraudit.failed_sets(documents(spark, []), labels(spark, []))).count() == 0
    found = filteraudit.failed_sets(documents(spark, DOCS), labels(spark, []))
    assert found.agg({"docs": "sum", "good": "sum"}).first()[:] in ((len(DOCS), 0), (0, len(DOCS)))


def test_path_counts():
    forward, backward = filteraudit.path_counts(5)
    assert forward[-1] == backward[0] == 120
    through = filteraudit.orders_through("ABCDE")
    for edge, orders in enumerate(through):
        state, f = divmod(edge, 5)
        assert len(orders) == (0 if state >> f & 1 else forward[state] * backward[state | 1 << f])


def test_words_do_not_depend_on_the_slice(monkeypatch):
    text = ("ab  c\n" * 50 + "long" * 40).encode()
    whole = filteraudit.failed_alone(text)
    monkeypatch.setattr(filteraudit, "SLICE", 7)
    assert [w for part in filteraudit.word_lists(text) for w in part] == text.split() and filteraudit.failed_alone(text) == whole


def sql_rows(sql, **tables):
    connection = duckdb.connect()
    for name, frame in tables.items():
        connection.register(name, frame)
    result = connection.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def test_filter_audit_sql_on_odd_rows(spark):
    docs, marks = documents(spark, DOCS), labels(spark, MARKS)
    names, want = sql_rows(SQL["op12_filter_audit"], documents=docs.toArrow(), labels=marks.toArrow())
    found = filteraudit.audit_filters(filteraudit.failed_sets(docs, marks))
    assert found.columns == names and ordered(found.collect()) == ordered(want)


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn, role or "", text or ""))
    sha = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    plain = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: (y[0] is not None, y[0] or 0, sha(*y[1:])))] for c, x in turns.items()}
    rebuilt = {}
    for c in plain:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        rebuilt[c] = tuple(plain.get(base, [])[:h] + plain[c][h:])
    nodes = {}
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            nodes.setdefault(x[:d], []).append(c)
    words = lambda t: len(re.findall(rb"[^\x20\x09-\x0d]+", t.encode()))
    out = []
    for x, members in nodes.items():
        under = [y for y in nodes if y[: len(x)] == x]
        kids = lambda y: sum(len(z) == len(y) + 1 and z[: len(y)] == y for z in nodes)
        ends = ",".join(str(c) for c in sorted(c for c in members if rebuilt[c] == x))
        saved = sum((len(nodes[y]) - 1) * (words(y[-1][1]) if y else 0) for y in under)
        parent = min(nodes[x[:-1]]) if x else None
        out.append((min(members), len(x), parent, len(members), kids(x), sum(kids(y) == 0 for y in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talks(seed=3, convs=90):
    draw = random.Random(seed)
    rows = []
    for c in [*range(convs), -3, -25, 200, 201, 1000, 1019]:
        n = draw.choice([0, 1, 1, 2, 3, 5, 9]) if c != 40 else 60
        for t in range(n):
            rows.append((c, t, draw.choice(["user", "user", None]), draw.choice(["a b", "a b", "c", "", None, "d  e\tf g"])))
    copies = [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(4)]
    odd = [(None, 1, "user", "x"), (5, None, "user", "first"), (5, None, "user", "first"), (5, 2, "u", "tie"), (5, 2, "u", "tie two"), (7, 10**12, "é", "ü 漢")]
    return rows + copies + odd


CONV = "conv_id long, turn long, role string, text string, band int, path string, WORDS int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 9, "p", 1) for r in rows], CONV)


@pytest.mark.parametrize("band, shard", [(1024, 200_000), (1024, 3), (2, 5), (1, 200_000), (3, 1)])
def test_prefix_trie(spark, band, shard):
    rows = talks()
    turns = convtrie.spliced(convtrie.numbered_turns(conversations(spark, rows)))
    found = convtrie.prefix_trie(turns, band, shard)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert ordered(found.collect()) == ordered(plain_trie(rows))


def test_prefix_trie_sql_on_odd_rows(spark):
    rows = talks(5, 60)
    names, want = sql_rows(SQL["op13_prefix_trie"], conversations=conversations(spark, rows).toArrow())
    assert ordered(want) == ordered(plain_trie(rows))
    assert names == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_prefix_trie_without_rows(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert convtrie.prefix_trie(convtrie.spliced(convtrie.numbered_turns(conversations(spark, rows)))).count() == 0


@pytest.mark.parametrize("block", [1, 3, 256])
def test_parentheses(block):
    draw = random.Random(block)
    bits, open_ = [], 0
    while len(bits) < 700 or open_:
        up = open_ == 0 or (len(bits) < 700 and draw.random() < 0.55)
        bits.append(up)
        open_ += 1 if up else -1
    parens = convtrie.Parens(np.array(bits), block)
    at, stack, close = np.flatnonzero(bits), [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    assert parens.findclose(at).tolist() == [close[i] for i in at]
    assert parens.leaf_rank()[-1] == sum(a and not b for a, b in zip(bits, bits[1:]))


def shingles(text, size=4):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def plain_links(rows, percent):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and a and b and 100 * len(a & b) >= percent * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if group[m] == group[k] and rows[m][0] is not None]
        out.append((doc_id, len(sets[k]), (min(ids) if ids else None) if sets[k] else doc_id))
    return out


def near_texts():
    """Families of variants around the threshold, of many sizes, and a template that all of many texts share."""
    draw = random.Random(11)
    rows = [(1, None), (2, ""), (3, " \t "), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (None, "one two"), (None, None), (6, "a b c d"), (7, "a b c e")]
    key = 100
    for n in (8, 9, 10, 12, 20, 33, 70, 150, 400):
        base = [f"b{n}x{i}" for i in range(n)]
        for _ in range(14):
            w = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3]) * max(1, n // 100)):
                at = draw.randrange(len(w))
                w[at : at + draw.choice([0, 1, 1])] = [f"e{draw.randrange(10**6)}"] * draw.choice([0, 1])
            rows.append((key, " ".join(w)))
            key += 1
    template = [f"t{i}" for i in range(120)]
    for k in range(30):
        rows.append((key + k, " ".join(template + [f"u{k}x{i}" for i in range(k)])))
    return rows


def texts(spark, rows):
    return spark.createDataFrame([(*r, 3, b"k", 1) for r in rows], "doc_id long, text string, n long, KEYS binary, node int")


@pytest.mark.parametrize("percent, kind, small, block", [(85, None, 24, 512), (85, "mixed", 2, 4), (80, "pairs", 2, 7), (90, "triples", 24, 512), (85, "rare", 3, 5)])
def test_combination_join(spark, monkeypatch, percent, kind, small, block):
    monkeypatch.setattr(combojoin, "SMALL", small)
    monkeypatch.setattr(combojoin, "BLOCK", block)
    rows = near_texts()
    groups = {
        None: None,
        "mixed": np.random.default_rng(5).choice([0, 1, 2], 1 << 16, p=[0.1, 0.6, 0.3]).astype(np.uint8),
        "pairs": np.ones(1 << 16, np.uint8),
        "triples": np.full(1 << 16, 2, np.uint8),
        "rare": np.zeros(1 << 16, np.uint8),
    }[kind]
    found = combojoin.link_similar(texts(spark, rows), percent, groups)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert ordered(found.collect()) == ordered(plain_links(rows, percent))


def test_combination_join_without_rows(spark):
    assert combojoin.link_similar(texts(spark, [])).count() == 0
    assert ordered(combojoin.link_similar(texts(spark, [(1, None), (2, " ")])).collect()) == [(1, 0, 1), (2, 0, 2)]
    with pytest.raises(ValueError):
        combojoin.link_similar(texts(spark, []), 60)


@pytest.mark.parametrize("percent", [80, 85, 93])
def test_linked_sets_share_a_key(percent):
    draw = np.random.default_rng(percent)
    for n in [*range(4, 70), 100, 127, 128, 129, 500]:
        groups = draw.choice(np.array([0, 1, 2], np.uint8), 1 << 16, p=draw.dirichlet([0.4, 1, 1]))
        x = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for _ in range(8):
            gone = draw.integers(0, combojoin.missing(n, percent) + 1)
            keep = draw.permutation(x)[gone:]
            y = np.unique(np.concatenate([keep, draw.integers(0, 1 << 63, draw.integers(0, 4) * max(1, n // 20), dtype=np.uint64)]))
            if not combojoin.similar(x, y, percent) or np.array_equal(x, y):
                continue
            a, b = (combojoin.signatures(s, groups, percent)[0] for s in (x, y))
            assert len(np.intersect1d(a, b))
            bits = [np.frombuffer(combojoin.parity(s), np.uint64) for s in (x, y)]
            differ = combojoin._differ(*[v.tobytes() for v in bits])
            assert differ <= len(np.setxor1d(x, y)) and combojoin.may_link(np.array([differ]), np.array([len(x)]), np.array([len(y)]), percent)[0]


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_prefix_can_always_be_extended(percent):
    draw = np.random.default_rng(1)
    for n in range(1, 400):
        for kind in (1, 2, None):
            groups = np.full(1 << 16, kind, np.uint8) if kind else draw.integers(0, 3, 1 << 16).astype(np.uint8)
            combojoin.signatures(np.sort(draw.integers(0, 1 << 63, n, dtype=np.uint64)), groups, percent)


# --- main text of pages that are built otherwise ------------------------------------------------

TEXT = "This is the text of the page, which is long enough and has the stop words that a main text has, as it is to be kept."
MORE = "And this is the other text of the page, of which it is to be said that it has the stop words and is a part of it too."
ITALIAN = "Il governo ha presentato ieri il nuovo programma; secondo gli esperti, nei prossimi mesi molte famiglie potranno risparmiare parecchio denaro."
CHINESE = "昨天政府公布了新的经济计划，专家认为，未来几个月许多家庭将能够节省大量开支，同时企业也会得到更多支持。"
NAV = '<nav><a href="/a">Home</a> <a href="/b">News</a></nav>'


@pytest.mark.parametrize("name", ['class="social-science"', 'class="search-results-article"', 'class="share-holder"', 'id="ad-hoc-networks"', 'id="header-fixed-page"', 'class="Related-Work"'])
def test_names_that_only_begin_like_a_mark(name):
    assert maintext.main_text(f"<body>{NAV}<article {name}><p>{TEXT}</p></article></body>") == TEXT
    assert maintext.main_text(f"<body>{NAV}<div {name}><h1>Title here</h1><p>{TEXT}</p></div></body>") == f"Title here\n{TEXT}"


@pytest.mark.parametrize("name", ["comments", "comments-list", "site-footer", "siteFooter", "ad-box-2", "adBanner", "cookie-notice", "page_header", "left-sidebar", "related widget", "third-party-ads"])
def test_names_that_are_marks(name):
    page = f'<body><div><p>{TEXT}</p></div><div class="{name}"><p>{MORE}</p></div></body>'
    assert maintext.main_text(page) == TEXT and maintext.main_text(page.replace("class=", "id=")) == TEXT


def test_forms_and_wrappers_around_the_page():
    hidden = '<input type="hidden" name="state" value="x">'
    assert maintext.main_text(f"<body><form>{hidden}{NAV}<div><h1>Title</h1><p>{TEXT}</p><p>{MORE}</p></div></form></body>") == f"Title\n{TEXT}\n{MORE}"
    controls = '<input name="a"><input name="b"><textarea></textarea><button>Send</button>'
    assert maintext.main_text(f"<body><div><p>{TEXT}</p></div><form><p>{MORE}</p>{controls}</form></body>") == TEXT
    assert maintext.main_text(f'<body><div class="widget"><main><h1>Title</h1><p>{TEXT}</p></main></div></body>') == f"Title\n{TEXT}"
    # comments may be longer than the article
    assert maintext.main_text(f'<article><p>{TEXT}</p></article><div class="comments"><article><p>{MORE}</p><p>{MORE}</p></article></div>') == TEXT
    assert maintext.main_text(f"<body>{NAV}<aside><p>{TEXT}</p></aside></body>") == ""


@pytest.mark.parametrize("text", [ITALIAN, CHINESE])
def test_languages_without_stop_words(text):
    other = text[::-1] + text[-1]
    assert maintext.main_text(f"<body>{NAV}<div><p>{text}</p><p>{text}</p></div><div class=ad>{text}</div><ul><li><a href=x>{other}</a></ul></body>") == f"{text}\n{text}"


def test_comments_and_open_links():
    for empty in ("<!-->", "<!--->", "<!---->", "<!-- x --!>", "<!-- a > b -->"):
        assert maintext.main_text(f"<article>{empty}<p>{TEXT}</p><!-- y --><p>{MORE}</p></article>") == f"{TEXT}\n{MORE}"
    assert maintext.main_text(f"<article><p>{TEXT}</p><!-- open <p>{MORE}</p>") == TEXT
    assert maintext.main_text(f'<div><p>{TEXT} <a href="x">see</p><p>{MORE}</p><p>{TEXT}</p></div>') == f"{TEXT} see\n{MORE}\n{TEXT}"
    assert maintext.main_text(f'<div><p>{TEXT}</p><a href="x"><p>{MORE}</p></a></div>') == TEXT


def test_main_text_of_the_pages_without_article(spark, sf_dir):
    """The same pages with a plain div in place of the article."""
    lost = kept = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        want = maintext.main_text(r.html).split("\n")
        found = maintext.main_text(r.html.replace("<article>", '<div class="entry">').replace("</article>", "</div>")).split("\n")
        assert set(found) - {""} <= set(want)
        kept += sum(map(len, found))
        lost += sum(map(len, want))
    assert kept > 0.9 * lost


# --- benchmark phrases --------------------------------------------------------------------------


def near_rows(seed=4):
    draw = random.Random(seed)
    words = [f"v{i}" for i in range(40)] + ["the"] * 20
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([0, 5, 60, 200])))) for i in range(60)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 3, 4, 6])))) for i in range(25)]
    return [*docs, (None, docs[5][1]), (3, None)], [*items, (None, "v1 v2"), (7, items[7][1]), (90, "nowhere to be found")]


@pytest.mark.parametrize("slop, block", [(0, 200_000), (3, 7)])
def test_proximity_matches(spark, slop, block):
    docs, items = near_rows()
    split = [(i, (t or "").split()) for i, t in docs]
    count = {}
    for _, w in split:
        for x in w:
            count[x] = count.get(x, 0) + 1
    window = 4
    want = []
    for doc_id, w in split:
        exact, near = set(), set()
        for item, text in items:
            words = text.split()
            size = min(window, len(words))
            for j in range(len(words) - size + 1 if size else 0):
                phrase = words[j : j + size]
                if any(x not in count for x in phrase):
                    continue
                if any(w[i : i + size] == phrase for i in range(len(w) - size + 1)):
                    exact.add(item)
                rare = min(phrase, key=lambda x: count[x])
                for i in (i for i, x in enumerate(w) if x == rare):
                    around = w[max(0, i - size - slop + 1) : i + size + slop]
                    if all(x in around for x in phrase):
                        near.add(item)
        want.append((doc_id, len(w), *(sorted(str(i) for i in found if i is not None) for found in (exact, near))))
    make = lambda rows, key: spark.createDataFrame([(*r, 1) for r in rows], f"{key} long, text string, row1 int")
    found = contamination.find_matches(make(docs, "doc_id"), make(items, "item_id"), window, slop, block)
    assert ordered(found.select("doc_id", "n_words", "item_ids", "near_item_ids").collect()) == ordered(want)
    assert any(set(w[3]) > set(w[2]) for w in want)


def test_one_item_a_hundred_thousand_times(spark):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "a b c"), (3, "")], "doc_id long, text string")
    items = spark.range(100_000).selectExpr("id % 2 AS item_id", "'a b c d' AS text")
    found = {r.doc_id: r for r in contamination.find_matches(docs, items).collect()}
    assert found[1].item_ids == ["0", "1"] and [tuple(s) for s in found[1].spans] == [(1, 5)] and found[2].spans == []
    assert contamination.item_phrases(items, 10).count() == 2
    assert [r.doc_id for r in contamination.clean_rows(docs, items).collect()] in ([2, 3], [3, 2])


def test_phrases_that_do_not_occur_cost_nothing():
    rng = np.random.default_rng(0)
    held = np.sort(rng.integers(0, 1 << 63, 5_000, dtype=np.uint64))
    text = rng.integers(0, 5_000, 200_000)
    order = np.argsort(text, kind="stable")
    sizes = np.bincount(text, minlength=5_000).astype(np.int32)
    segment = contamination.Segment([0, len(text)], held.tobytes(), sizes.tobytes(), order.astype(np.int32).tobytes())
    seconds = []
    for n in (2_000, 400_000):
        own = held[np.lib.stride_tricks.sliding_window_view(text, 10)[:100]]
        other = rng.integers(0, 1 << 63, (n, 10), dtype=np.uint64)
        phrases = np.concatenate([own, other])
        terms = np.unique(phrases)
        totals = np.maximum(np.isin(terms, held) * 40, 1)
        totals[np.isin(terms, other)] = 20  # rarer than all that the segment has
        block = contamination._ranked(terms, [(np.searchsorted(terms, phrases), np.zeros((len(phrases), 2), np.int64))], totals)
        began = time.perf_counter()
        for _ in range(5):
            (hit,) = contamination.segment_hits(segment, block, None)
        seconds.append(time.perf_counter() - began)
        assert hit[1] == [(0, 109)]
    assert seconds[1] < 4 * seconds[0]


def test_clean_rows_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", "z")], "doc_id long, text string, __row1 string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.clean_rows(docs, none).count() == 4
    hit = spark.createDataFrame([(1, "B"), (2, None)], "item_id long, text string")
    kept = contamination.clean_rows(docs, hit)
    assert kept.columns == docs.columns and ordered(kept.collect()) == ordered([(None, None, "y"), (2, "", "z")])
    assert contamination.clean_rows(docs.where("false"), hit).count() == 0


# --- mixing and training ------------------------------------------------------------------------


def plain_rates(p, n, target, least, steps):
    """Projected gradient with fixed rates in memory, without momentum."""
    rate = np.ones(len(p))
    second = (p * n[:, None]).T @ p
    own = np.diag(second)
    length = 1 / np.linalg.eigvalsh(second / np.sqrt(np.outer(own, own))).max()
    for _ in range(steps):
        rate = np.maximum(least, rate - p @ (length * ((rate * n) @ p - target) / own))
    return rate


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_mixing_equals_a_plain_projected_gradient(spark, least):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.5, 0.2], 2000)
    p = 0.85 * np.eye(3)[p.argmax(axis=1)] + 0.15 * p
    n = rng.integers(0, 300, 2000)
    shares = np.array([0.5, 0.3, 0.2])
    profiles = spark.createDataFrame([(int(a), b.tobytes()) for a, b in zip(n, p)], "n_tokens long, p binary")
    fit = mixing.fit_rates(profiles, shares, least)
    found = mixing.rates(p, fit)
    total = (found * n) @ p
    assert found.min() >= least - 1e-12 and np.abs(total / total.sum() - shares).max() < 1e-3
    assert total.sum() >= 0.999 * ((n[:, None] * p).sum(axis=0) / shares).max()
    rate = plain_rates(p, n, shares * total.sum(), least, 3000)
    assert np.abs(((found - rate) * n) @ p).max() < 5e-4 * total.sum()
    assert np.abs((found - rate)[n > 0]).max() < 0.02


def test_mixing_of_a_domain_of_one_in_ten_thousand(spark):
    own = np.arange(30_000) % 3
    own[:3] = 3
    p = np.eye(4)[own] * 0.98 + 0.005
    shares = np.array([0.2, 0.4, 0.2, 0.2])
    profiles = spark.createDataFrame([(100, r.tobytes()) for r in p], "n_tokens long, p binary")
    fit = mixing.fit_rates(profiles, shares, 0.0)
    total = mixing.rates(p, fit) @ p
    assert np.abs(total / total.sum() - shares).max() < 1e-3 and len(fit.steps) <= mixing.MOST_STEPS


def test_mixed_replaces_columns_of_its_names(spark):
    docs = spark.createDataFrame([(i, "the of and", "x", 1.0, "k") for i in range(12)], "doc_id long, text string, Rate string, copies double, p string")
    labelled = spark.createDataFrame([(i, "en") for i in range(12)], "doc_id long, domain string")
    out = mixing.mixed(docs, labelled, {"en": 1.0})
    assert out.columns == ["doc_id", "text", "p", "rate", "copies"] and out.select("Rate", "copies").distinct().count() == 1
    assert mixing.mixed(docs.where("false"), labelled, {"en": 1.0}).count() == 0


def test_one_row_for_a_labelled_id_that_repeats(spark, monkeypatch):
    monkeypatch.setattr(subwords, "LEAST_STEPS", 50)
    seen = []
    plain = subwords.materialize
    monkeypatch.setattr(subwords, "materialize", lambda df: seen.append(plain(df)) or seen[-1])
    docs = spark.range(10_000).selectExpr("1L AS doc_id", "'the same text' AS text").union(spark.createDataFrame([(2, "another one"), (3, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    models = [subwords.fit(docs, labels, "quality", (0, 1)), subwords.fit(docs.distinct(), labels, "quality", (0, 1))]
    assert [t.count() for t in seen] == [3, 3]
    assert all((a == b).all() for a, b in zip(*models))


def test_model_does_not_depend_on_what_the_driver_holds(spark, monkeypatch):
    monkeypatch.setattr(subwords, "LEAST_STEPS", 60)
    docs = spark.createDataFrame([(i, f"w{i % 7} junk *** {i}" if i % 2 else f"a plain text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    models = []
    for held in (subwords.HELD_BYTES, 0):
        monkeypatch.setattr(subwords, "HELD_BYTES", held)
        models.append(subwords.fit(docs, labels, "quality", (0, 1)))
    assert all((a == b).all() for a, b in zip(*models))


def test_grams_stay_inside_words(spark):
    import pyarrow as pa

    def grams(text):
        (w,) = subwords.words(pa.array([text]), subwords.SPACED)
        return sorted(x for b, s, e in list(subwords._features(w))[1 if len(w.starts) < 2 else 2 :] for x in b[s[0] : e[0]])

    assert grams("über den") == sorted(grams("über") + grams("den"))
    assert len(grams("漢字漢字漢")) == 3 + 2 and grams("ab cd") == [] and len(grams("\n abc ")) == 1
    (w,) = subwords.words(pa.array(["abcd", "ef", "", "ghi"]), subwords.SPACED)
    kinds = list(subwords._features(w))[2:]
    assert [[int(e - s) for s, e in zip(k[1], k[2])] for k in kinds] == [[2, 0, 0, 1], [1, 0, 0, 0]]


def test_quality_on_held_out_rows(spark, sf_dir):
    """Accuracy on the rows that were not learnt from, of the larger test table."""
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels)).where("held_out").join(labels, "doc_id")
    right, n = scored.selectExpr("avg(cast(predicted = quality AS double))", "count(*)").first()
    assert n > 50 and right >= 0.9


# --- the next document --------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["outlying", "null", "repeated", "string", "one", "none"])
def test_next_document_in_even_ranges(spark, kind):
    draw = random.Random(7)
    ids = {
        "outlying": [*range(300), 10**15, -(10**17)],
        "null": [None] * 200 + list(range(100)),
        "repeated": [5] * 200 + list(range(60)),
        "string": [f"k{draw.randrange(10**6)}" for _ in range(300)] + [None],
        "one": [3],
        "none": [],
    }[kind]
    rows = [(i, f"text {k} of {draw.random()}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, f"id {'string' if kind == 'string' else 'long'}, text string")
    tie = F.xxhash64("text")
    hashes = {r.text: r.h for r in df.select("text", tie.alias("h")).collect()}
    line = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, hashes[r[1]]) if kind != "string" else (r[0] is not None, r[0] or "", hashes[r[1]]), reverse=True)
    want = [(*r, line[(k + 1) % len(line)][1]) for k, r in enumerate(line)]
    found = ordermin.with_next(df, "id", tie, ["text"], rows_per_block=10)
    assert ordered(found.collect()) == ordered(want)
    if len(rows) > 100:
        ends = ordermin.range_ends(df.select(F.struct("id", tie.alias("tie")).alias("key")), 30).first().ends
        assert len(ends) > 15

