"""Cases of the second review, each of which a shorter way through the operators loses."""

import re
import time
from re import _constants as sre, _parser

import numpy as np

import corpus_pipeline
from tallyrow.llm import licenses, maintext, mixing, neardup, subwords

COLUMNS = "doc_id long, text string"


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_pipeline_links_from_80_percent(spark, sf_dir):
    base = [f"b{i}" for i in range(204)]
    texts = [base]
    for changes in (range(10, 200, 50), range(20, 200, 46), range(5, 200, 30)):
        texts.append([f"x{i}" if i in changes else w for i, w in enumerate(base)])
    # linked with the last but one only, and far from the base
    texts.append([f"y{i}" if i in (35, 90, 135, 180) else w for i, w in enumerate(texts[2])])
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingles(t) for _, t in rows]
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(0.8 <= share(a, b) < 0.85 for a, b in ((0, 1), (0, 2), (2, 4))) and max(share(3, i) for i in (0, 1, 2, 4)) < 0.8
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    docs = spark.createDataFrame(rows, COLUMNS)
    want = sorted({min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in group})
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()) == want == [1, 4]
    assert neardup.link_near_duplicates(docs).where("kept").count() == 5


def alternatives(items):
    """Every text of a parsed pattern, with its optional parts there and left out."""
    texts = [""]
    for op, value in items:
        if op is sre.LITERAL:
            more = [chr(value)]
        elif op is sre.IN:
            more = [chr(v) for o, v in value if o is sre.LITERAL][:3] or [chr(v[0]) for o, v in value if o is sre.RANGE][:1]
        elif op is sre.SUBPATTERN:
            more = alternatives(value[3])
        elif op is sre.BRANCH:
            more = [t for branch in value[1] for t in alternatives(branch)]
        elif op is sre.MAX_REPEAT:
            more = [t * n for n in sorted({value[0], max(value[0], 1)}) for t in alternatives(value[2])]
        else:
            continue
        texts = [a + b for a in texts for b in more]
    return texts


def test_license_rules_with_and_without_keywords_and_wrapped():
    rules = [(r, re.compile(r.pattern)) for r in licenses.signatures()]
    for rule, pattern in rules:
        assert rule.keywords
        texts = {t.encode("latin-1") for t in alternatives(_parser.parse(rule.pattern))}
        assert texts
        for t in texts:
            assert pattern.fullmatch(t) and any(k in t for k in rule.keywords), (rule, t)
        for t in (min(texts), max(texts), max(texts, key=len)):
            for blank in (b" ", b"\n", b"\r\n # ", b"\n//\t", b"  *\n *  ", b"\xc2\xa0 ", b"\n\n"):
                wrapped = t.replace(b" ", blank)
                want = [(2, 2 + len(wrapped), rule.priority, rule.score, rule.label)]
                assert licenses.detections(b"x " + wrapped + b" y", [(rule, pattern)]) == want, (rule, wrapped)


def test_licenses_that_gates_lost(spark):
    texts = [
        ("Licensed to you under the MIT License", "mit"),
        ("the Expat License", "mit"),
        ("see wtfpl.net for it", "wtfpl"),
        ("/* Apache License,\n# Version 2.0", "apache-2.0"),
        ("under the Apache\nLicense", "apache"),
        (" * GNU General\n * Public License v3 ", "gpl,gpl-3.0"),
        ("put into\n\n\t the   public  domain", "public-domain"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], COLUMNS)
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [found[i].labels for i in range(len(texts))] == [labels for _, labels in texts]
    assert found[0].score == 0.95
    assert texts[5][0].encode()[found[5].spans[0].start : found[5].spans[0].end] == b"GNU General\n * Public License v3"


LONG = "This is the text of the page, which is long enough and has the stop words that a main text has, as it is to be kept."
OTHER = "And this is the other text of the page, of which it is to be said that it has the stop words and is not a part of it."


def test_main_text_outside_of_articles():
    teaser = f"<aside><article><p>{OTHER}</p></article></aside>"
    comment = f'<article class="comment"><p>{OTHER}</p></article>'
    assert maintext.main_text(f"<body><div><p>{LONG}</p></div>{teaser}</body>") == LONG
    assert maintext.main_text(f"<body><div><p>{LONG}</p></div>{comment}{comment}</body>") == LONG
    assert maintext.main_text(f"<body><article><p>{LONG}</p></article><div><p>{OTHER}</p></div></body>") == f"{LONG}\n{OTHER}"
    assert maintext.main_text(f"<body><div><p>{LONG}</p></div></body>") == LONG
    assert maintext.main_text(f'<main class="banner"><p>{LONG}</p></main>') == LONG


def test_main_text_without_end_of_head():
    for begin in ("<body>", "<p>", "<div><p>", "<main>", "<b>", ""):
        assert maintext.main_text(f"<html><head><title>T</title><meta charset=x>\n<script>a</script>{begin}{LONG}") == LONG
    assert maintext.main_text(f"<head><title>{OTHER}</title><style>p</style></head><body><p>{LONG}</p>") == LONG


def test_main_text_keeps_formulas_and_objects():
    page = f"<article><p>{LONG} <math><mi>x</mi><annotation>tex</annotation></math> <object>shown</object></p></article>"
    assert maintext.main_text(page) == f"{LONG} x shown"


def test_main_text_behind_long_attributes():
    for n in (10, 9_990, 10_010, 3_000_000):
        for quote, other in ("\"'", "'\""):
            value = f"<svg {other}a>b{other}>" + "x" * n
            page = f"<body><div data-x={quote}{value}{quote} class=ad><p>{OTHER}</p></div><p title=it's lang = {quote}>{quote}>{LONG}</p></body>"
            assert maintext.main_text(page) == LONG
    assert maintext.main_text(f"<article><p class=\"a>{LONG}</p></article>") == LONG
    assert maintext.main_text(f'<article><p>{LONG}</p><a title="x > y"') == LONG


def test_main_text_of_many_open_quotes_takes_linear_time():
    begin = time.perf_counter()
    for tag in ('<a b=">" ', "<a b='\">\"' ", '<a b=">'):
        maintext.main_text(tag * 100_000 + "<a b='>")
    assert time.perf_counter() - begin < 30


def profiles(spark, p):
    rows = [(100, r.tobytes()) for r in p]
    return spark.createDataFrame(rows, "n_tokens long, p binary")


def test_mixing_reaches_rare_domains(spark):
    shares = np.array([0.2, 0.4, 0.2, 0.2])
    own = np.arange(30_000) % 3
    for rare in (3_000, 3, 1):
        own[:rare] = 3
        p = np.eye(4)[own]
        # likely, not sure
        for p in (p, p * 0.99 + np.roll(p, 1, axis=1) * 0.01):
            fit = mixing.fit_rates(profiles(spark, p), shares, 0.0)
            total = mixing.rates(p, fit) @ p
            assert np.abs(total / total.sum() - shares).max() < 1e-3 and np.abs(fit.residual).max() < mixing.CLOSE
        own[:rare] = np.arange(rare) % 3


def test_mixing_says_what_is_lacking(spark, caplog):
    p = np.eye(3)[np.arange(300) % 2]
    fit = mixing.fit_rates(profiles(spark, p), np.array([0.2, 0.4, 0.4]), 1.0)
    # the first domain has 150 tokens at rate 1, a fifth of the 750 aimed at
    assert np.allclose(mixing.rates(p, fit) @ p, [150, 300, 0], atol=1e-2)
    assert np.allclose(fit.residual, [0, 0, -0.4], atol=1e-3) and mixing.rates(p, fit).min() >= 1
    docs = spark.createDataFrame([(i, "the of and to") for i in range(20)], COLUMNS)
    labelled = spark.createDataFrame([(i, "en") for i in range(20)], "doc_id long, domain string")
    with caplog.at_level("WARNING"):
        mixing.fit_mix(docs, labelled, {"de": 0.5, "en": 0.5})
    assert "targets not met" in caplog.text and "'de': -0." in caplog.text


def test_training_counts_long_texts_in_full(spark, monkeypatch):
    monkeypatch.setattr(subwords, "LEAST_STEPS", 20)
    models = []
    for n in (1_000, 100_000):
        docs = spark.createDataFrame([(1, "x " * (3 * n) + "y " * n), (2, ""), (3, "z")], COLUMNS)
        chosen = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, label int")
        models.append(subwords.train(docs, chosen, [0.5, 0.5], (0, 1)))
    # the same shares of features but for some at the one place where the words change
    (a, c), (b, d) = models
    assert np.abs(a - b).max() < 0.02 * np.abs(a).max() and np.abs(c - d).max() < 0.02
