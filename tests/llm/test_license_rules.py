"""License texts, fields and expressions, and the base phrases against SQL."""

import duckdb
import pytest

from tallyrow.llm import licenses

WORDING = [
    ("license: mit", "mit"),
    ("mit licensed", "mit"),
    ("under the mit licence", "mit"),
    ("licensed under gpl-2.0-only", "gpl-2.0"),
    ("spdx-license-identifier: (mit or apache-2.0)", "apache-2.0,mit"),
    ("spdx-license-identifier: zlib and bsd-3-clause and isc", "bsd-3-clause,isc,zlib"),
    ("mit or apache-2.0", "apache-2.0,mit"),
    ("gnu general public license as published by the\n# free software foundation; either version 2", "gpl-2.0"),
    ("version 2.1 of the gnu lesser general public license", "lgpl-2.1"),
    ("gnu lesser general public license as published by the free software foundation; version 2.1.", "lgpl-2.1"),
    ('{\n  "license": "bsd-3-clause",\n}', "bsd-3-clause"),
    ('license = {text = "isc"}', "isc"),
    ("permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", "bsd"),
    ("this is free and unencumbered software released into the public domain.", "unlicense"),
    ("to use, copy, modify, and/or distribute", ""),
    ("the unlicensed operator; a summit or apache-2.0x; a driving license: mitigated", ""),
]


@pytest.mark.parametrize("text, labels", WORDING)
def test_wording(text, labels):
    rules = [(r, licenses.re.compile(r.pattern)) for r in licenses.signatures()]
    assert ",".join(sorted({d[4] for d in licenses.detections(text.encode(), rules)})) == labels


PLACES = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, i, CASE WHEN w[i + 1] = 'cc' AND w[i + 2] = 'by' THEN 'cc-by'
    WHEN w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license' THEN 'gpl'
    WHEN w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved' THEN 'reserved' END AS label
  FROM (SELECT doc_id, w, unnest(range(len(w) + 1)) AS i FROM w))
SELECT doc_id, max(len(w)) AS n_words, count(label) AS n_base, min(i) FILTER (label IS NOT NULL) AS first_word,
  max(i) FILTER (label IS NOT NULL) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM p GROUP BY doc_id
"""


def test_base_phrases_equal_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = licenses.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = con.execute(PLACES).fetchall()
    assert any(r[2] for r in want)
    assert sorted(map(tuple, found.collect())) == sorted(want)
