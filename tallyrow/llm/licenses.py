"""License scan with ordered signature rules.

Hand-written patterns of license names are put into sentence forms, which gives some hundreds of rules, ordered
by priority: an explicit identifier or grant comes before a bare name. Others know whole license texts by their opening
sentences; of an expression such as "MIT OR Apache-2.0" each operand is found by a rule of its own. The rules are
matched on a copy of the text in which white space, with the comment leaders around a line break, is one blank; places
are given in the text itself. A rule is only tried on a copy that holds one of its keywords, which are derived from its pattern. Of all detections, one whose interval lies inside the interval of a detection of higher priority
(or of the same priority and longer) is dropped; what stays gives labels and score.

The base phrases are searched apart from the rules, word by word, and their labels always stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from re import _constants as sre, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.base import register, table
from tallyrow.llm.bytescan import ALNUM, LOWER, words

#: phrase -> label
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_V = r"(?:,? ?(?:version|v\.?|ver\.?) ?)?"
#: label: (pattern of the name, pattern of the SPDX identifier, pattern of the address)
NAMES = {
    "apache-1.1": (rf"apache (?:software )?license{_V} ?1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    "apache-2.0": (rf"apache (?:software )?license{_V} ?2(?:\.0)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    "mit": (r"(?:mit|expat) license", r"mit", r"opensource\.org/licenses?/mit"),
    "mit-0": (r"mit no attribution license", r"mit-0", r"opensource\.org/licenses?/mit-0"),
    "x11": (r"x11 license", r"x11", r"opensource\.org/licenses?/x11"),
    "bsd-2-clause": (r"(?:simplified|freebsd|2-clause|two-clause) bsd license", r"bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause"),
    "bsd-3-clause": (r"(?:new|modified|revised|3-clause|three-clause) bsd license", r"bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause"),
    "bsd-4-clause": (r"(?:original|4-clause|four-clause) bsd license", r"bsd-4-clause", r"directory\.fsf\.org/wiki/license:bsd_4clause"),
    "0bsd": (r"zero[- ]clause bsd license", r"0bsd", r"opensource\.org/licenses?/0bsd"),
    "isc": (r"isc license", r"isc", r"opensource\.org/licenses?/isc"),
    "gpl-1.0": (rf"(?:gnu )?(?:general public license|gpl){_V} ?1(?:\.0)?", r"gpl-1\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    "gpl-2.0": (rf"(?:gnu )?(?:general public license|gpl){_V} ?2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    "gpl-3.0": (rf"(?:gnu )?(?:general public license|gpl){_V} ?3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    "lgpl-2.0": (rf"(?:gnu )?(?:library general public license|lgpl){_V} ?2(?:\.0)?", r"lgpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    "lgpl-2.1": (rf"(?:gnu )?(?:lesser general public license|lgpl){_V} ?2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    "lgpl-3.0": (rf"(?:gnu )?(?:lesser general public license|lgpl){_V} ?3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    "agpl-3.0": (rf"(?:gnu )?(?:affero general public license|agpl){_V} ?3(?:\.0)?", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl-3\.0"),
    "gfdl-1.2": (rf"(?:gnu )?free documentation license{_V} ?1\.2", r"gfdl-1\.2(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2"),
    "gfdl-1.3": (rf"(?:gnu )?free documentation license{_V} ?1\.3", r"gfdl-1\.3(?:-only|-or-later)?", r"gnu\.org/licenses/fdl-1\.3"),
    "mpl-1.1": (rf"mozilla public license{_V} ?1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/1\.1"),
    "mpl-2.0": (rf"mozilla public license{_V} ?2(?:\.0)?", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    "epl-1.0": (rf"eclipse public license{_V} ?1(?:\.0)?", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    "epl-2.0": (rf"eclipse public license{_V} ?2(?:\.0)?", r"epl-2\.0", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    "cddl-1.0": (rf"common development and distribution license{_V} ?1(?:\.0)?", r"cddl-1\.0", r"opensource\.org/licenses?/cddl-1\.0"),
    "cpl-1.0": (rf"common public license{_V} ?1(?:\.0)?", r"cpl-1\.0", r"opensource\.org/licenses?/cpl1\.0"),
    "eupl-1.2": (rf"european union public licen[cs]e{_V} ?1\.2", r"eupl-1\.2", r"joinup\.ec\.europa\.eu/[a-z/]{0,40}eupl"),
    "artistic-2.0": (rf"artistic license{_V} ?2(?:\.0)?", r"artistic-2\.0", r"opensource\.org/licenses?/artistic-2\.0"),
    "bsl-1.0": (rf"boost software license{_V} ?1(?:\.0)?", r"bsl-1\.0", r"boost\.org/license_1_0"),
    "busl-1.1": (rf"business source license{_V} ?1\.1", r"busl-1\.1", r"mariadb\.com/bsl11"),
    "zlib": (r"zlib(?:/libpng)? license", r"zlib", r"opensource\.org/licenses?/zlib"),
    "unlicense": (r"the unlicense", r"unlicense", r"unlicense\.org"),
    "wtfpl": (r"do what the fuck you want to public license", r"wtfpl", r"wtfpl\.net"),
    "psf-2.0": (rf"python software foundation license{_V} ?2", r"psf-2\.0", r"docs\.python\.org/3/license"),
    "ofl-1.1": (rf"sil open font license{_V} ?1\.1", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
    "odbl-1.0": (rf"open database license{_V} ?1(?:\.0)?", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    "odc-by-1.0": (rf"open data commons attribution license{_V} ?1(?:\.0)?", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    "ms-pl": (r"microsoft public license", r"ms-pl", r"opensource\.org/licenses?/ms-pl"),
    "cc0-1.0": (rf"(?:creative commons zero|cc0){_V}(?: ?1\.0)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    "cc-by-2.0": (r"(?:cc[ -]by|creative commons attribution) 2\.0", r"cc-by-2\.0", r"creativecommons\.org/licenses/by/2\.0"),
    "cc-by-3.0": (r"(?:cc[ -]by|creative commons attribution) 3\.0", r"cc-by-3\.0", r"creativecommons\.org/licenses/by/3\.0"),
    "cc-by-4.0": (r"(?:cc[ -]by|creative commons attribution) 4\.0", r"cc-by-4\.0", r"creativecommons\.org/licenses/by/4\.0"),
    "cc-by-sa-3.0": (r"(?:cc[ -]by-sa|creative commons attribution-sharealike) 3\.0", r"cc-by-sa-3\.0", r"creativecommons\.org/licenses/by-sa/3\.0"),
    "cc-by-sa-4.0": (r"(?:cc[ -]by-sa|creative commons attribution-sharealike) 4\.0", r"cc-by-sa-4\.0", r"creativecommons\.org/licenses/by-sa/4\.0"),
    "cc-by-nd-4.0": (r"(?:cc[ -]by-nd|creative commons attribution-noderiv(?:ative)?s) 4\.0", r"cc-by-nd-4\.0", r"creativecommons\.org/licenses/by-nd/4\.0"),
    "cc-by-nc-3.0": (r"(?:cc[ -]by-nc|creative commons attribution-noncommercial) 3\.0", r"cc-by-nc-3\.0", r"creativecommons\.org/licenses/by-nc/3\.0"),
    "cc-by-nc-4.0": (r"(?:cc[ -]by-nc|creative commons attribution-noncommercial) 4\.0", r"cc-by-nc-4\.0", r"creativecommons\.org/licenses/by-nc/4\.0"),
    "cc-by-nc-sa-4.0": (r"(?:cc[ -]by-nc-sa|creative commons attribution-noncommercial-sharealike) 4\.0", r"cc-by-nc-sa-4\.0", r"creativecommons\.org/licenses/by-nc-sa/4\.0"),
    "cc-by-nc-nd-4.0": (r"(?:cc[ -]by-nc-nd|creative commons attribution-noncommercial-noderiv(?:ative)?s) 4\.0", r"cc-by-nc-nd-4\.0", r"creativecommons\.org/licenses/by-nc-nd/4\.0"),
}
_UNDER = r"under (?:the (?:terms of the )?)?"
_OR = r"\)? (?:and/or|and|or) \(?"
#: form: (pattern around {name}, {spelled} (the name in its spellings), {spdx}, {url} or {any} identifier, priority, score)
FORMS = {
    "identifier": (r"spdx-license-identifier: {{0,4}}\(?{spdx}(?![a-z0-9.-])", 60, 1.0),
    "field": (r"(?<![a-z0-9-])licen[cs]e[\"']? ?[:=] ?(?:\{{ ?text = )?[\"'(]?{spdx}(?![a-z0-9.-])", 55, 0.95),
    "grant": (rf"(?:dual-|re)?licen[cs]ed (?:to you )?{_UNDER}(?:{{name}}|{{spdx}})(?![a-z0-9-])", 50, 0.95),
    "release": (rf"(?:released|distributed|published|provided|(?:made )?available) {_UNDER}(?:{{name}}|{{spdx}})(?![a-z0-9-])", 50, 0.95),
    "address": (r"{url}(?![a-z0-9-])", 40, 0.9),
    "first operand": (rf"(?<![a-z0-9.+-]){{spdx}}{_OR}{{any}}(?![a-z0-9.-])", 35, 0.9),
    "second operand": (rf"(?<![a-z0-9.+-]){{any}}{_OR}{{spdx}}(?![a-z0-9.-])", 35, 0.9),
    "name": (r"(?<![a-z0-9-]){spelled}(?![a-z0-9-])", 30, 0.8),
}
#: Opening sentences and other fixed wording of license texts, (label, pattern): priority 45, score 0.9.
TEXTS = (
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsl-1.0", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ofl-1.1", r"permission is hereby granted, free of charge, to any person obtaining a copy of the font software"),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("0bsd", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\."),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", r"nor the names of (?:its|their|the|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-1.1", r"the end-user documentation included with the redistribution, if any, must include the following acknowledge?ment"),
    ("apache-2.0", r"terms and conditions for use, reproduction, and distribution"),
    ("gpl", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("agpl-3.0", r"the gnu affero general public license is a free, copyleft license for software and other kinds of works"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("zlib", r"this software is provided ['\"]?as-is['\"]?, without any express or implied warranty\. in no event will the authors be held liable"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("ms-pl", r"if you use the software, you accept this license\. if you do not accept the license, do not use the software"),
    ("psf-2.0", r"this license agreement is between the python software foundation"),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed\. preamble this license establishes the terms"),
)
#: label: (pattern, priority, score)
SINGLE = {
    "gpl": (r"(?:gnu general public license|gnu gpl)", 20, 0.6),
    "lgpl": (r"(?:gnu (?:lesser|library) general public license|gnu lgpl)", 22, 0.6),
    "agpl": (r"(?:gnu affero general public license|gnu agpl)", 22, 0.6),
    "gfdl": (r"gnu free documentation license", 20, 0.6),
    "apache": (r"apache (?:software )?license", 20, 0.6),
    "bsd": (r"bsd(?:-style)? license", 20, 0.6),
    "mpl": (r"mozilla public license", 20, 0.6),
    "epl": (r"eclipse public license", 20, 0.6),
    "creative-commons": (r"creative commons (?:attribution|license)", 10, 0.5),
    "public-domain": (r"(?:released|dedicated|placed|put) (?:in)?to the public domain", 40, 0.9),
    "proprietary": (r"(?:proprietary and confidential|confidential and proprietary)", 40, 0.9),
    "copyright": (r"(?:copyright (?:\(c\)|©) ?[0-9]{4}|\(c\) copyright)", 10, 0.3),
    "reserved": (r"all rights reserved", 10, 0.5),
}
#: family: (label without the number, pattern of its name, numbers); they are named with the version apart from the name.
GNU = (
    ("gpl", r"general public license", (r"1", r"2", r"3")),
    ("lgpl", r"(?:library|lesser) general public license", (r"2", r"2\.1", r"3")),
    ("agpl", r"affero general public license", (r"3",)),
    ("gfdl", r"free documentation license", (r"1\.2", r"1\.3")),
)
_BREAK = rb"[\r\n][\t\x0b\x0c ]*+(?://[/!]*+|/\*++!?|\*++(?!/)|#++!?|;++|--++|%++|[>|][>| \t]*+|\"++|'|!++|<!--++|\.\.(?=[\t ])|(?:dnl|rem)(?=[\t ]))"
_EDGE = rb"[*#|](?<=[\t ].)[*#|]*+(?=[\t\x0b\x0c ]*+[\r\n])"
#: Comment leaders at the begin of a line, and the right edge of a box of them.
LEADERS = re.compile(rb"%b|%b" % (_BREAK, _EDGE))
#: White space that is not just one blank.
RUN = re.compile(rb"[\t-\r ](?:[\t-\r ]++|(?<! ))")


@dataclass(frozen=True)
class Signature:
    label: str
    pattern: bytes
    priority: int
    score: float
    keywords: frozenset[bytes]


def keywords(items) -> frozenset[bytes]:
    """Texts of which every match of a parsed pattern holds at least one; empty if there are none.

    Of several such sets the one with the longest shortest text, then the one with the fewest texts.
    """
    best: frozenset[bytes] = frozenset()

    def worth(option: frozenset[bytes]) -> tuple[int, int]:
        return min(map(len, option), default=0), -len(option)

    run = b""
    for op, value in [*items, (None, None)]:
        found: frozenset[bytes] = frozenset()
        if op is sre.LITERAL:
            run += bytes([value])
            continue
        if op is sre.SUBPATTERN:
            found = keywords(value[3])
        elif op is sre.BRANCH:
            each = [keywords(branch) for branch in value[1]]
            found = frozenset().union(*each) if all(each) else found
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0]:
            found = keywords(value[2])
        for option in (frozenset([run] if run else []), found):
            if option and (not best or worth(option) > worth(best)):
                best = option
        run = b""
    return best


def spelled(name: str) -> str:
    """A name's pattern with "license", "licence" and "licensed" as its last word."""
    return re.sub(r"(?<!un)license(?!s)", "licen[cs]ed?", name)


@cache
def signatures() -> tuple[Signature, ...]:
    """All rules, highest priority first."""
    rules = [(label, spelled(p), priority, score) for label, (p, priority, score) in SINGLE.items()]
    rules += [(label, p, 45, 0.9) for label, p in TEXTS]
    for family, name, numbers in GNU:
        for number in numbers:
            label = f"{family}-{number}".replace("\\", "") + ("" if "." in number else ".0")
            version = number + ("" if "." in number else r"(?:\.0)?") + r"(?![a-z0-9-]|\.[0-9])"
            rules.append((label, rf"(?:gnu )?{name} as published by the free software foundation[,;:]? (?:either )?version {version}", 45, 0.9))
            rules.append((label, rf"(?:version |v\.? ?){version} of the (?:gnu )?{name}", 45, 0.9))
    identifiers = "|".join(spdx for _, spdx, _ in NAMES.values())
    for label, (name, spdx, url) in NAMES.items():
        parts = {"name": f"(?:{name})", "spelled": f"(?:{spelled(name)})", "spdx": f"(?:{spdx})", "url": f"(?:{url})", "any": f"(?:{identifiers})"}
        for pattern, priority, score in FORMS.values():
            rules.append((label, pattern.format(**parts), priority, score))
    same: dict[frozenset[bytes], frozenset[bytes]] = {}  # equal sets are one object, which makes looking them up cheap
    out = []
    for label, p, priority, score in rules:
        keys = keywords(_parser.parse(p.encode()))
        out.append(Signature(label, p.encode(), priority, score, same.setdefault(keys, keys)))
    return tuple(sorted(out, key=lambda s: (-s.priority, s.label, s.pattern)))


def folded(text: bytes) -> tuple[bytes, bytes]:
    """A copy of the text's length in which comment leaders are blanks, and one in which white space is one blank."""
    flat = text.replace(b"\xc2\xa0", b"  ")
    if b"\n" in flat or b"\r" in flat:
        flat = LEADERS.sub(lambda m: b" " * len(m[0]), flat)
    return flat, RUN.sub(b" ", flat)


def places(flat: bytes, at: np.ndarray) -> np.ndarray:
    """Places in ``flat`` of places in its copy with one blank for each run."""
    runs = np.array([m.span() for m in RUN.finditer(flat)], np.int64).reshape(-1, 2)
    gone = np.cumsum(runs[:, 1] - runs[:, 0] - 1)
    return at + np.concatenate([[0], gone])[np.searchsorted(runs[:, 1] - gone, at, side="right")]


def detections(text: bytes, rules) -> list[tuple[int, int, int, float, str]]:
    """(start, end, priority, score, label) of what is left after suppression; ``text`` is in lower case."""
    flat, plain = folded(text)
    has: dict[frozenset[bytes], bool] = {}
    found = []
    for rule, pattern in rules:
        if rule.keywords not in has:
            has[rule.keywords] = not rule.keywords or any(k in plain for k in rule.keywords)
        if has[rule.keywords]:
            found += [(m.start(), m.end(), rule.priority, rule.score, rule.label) for m in pattern.finditer(plain)]
    if found and len(plain) != len(text):
        starts = places(flat, np.array([d[0] for d in found])).tolist()
        ends = (places(flat, np.array([d[1] for d in found]) - 1) + 1).tolist()
        found = [(start, end, *d[2:]) for start, end, d in zip(starts, ends, found)]
    return suppressed(found)


def suppressed(found: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """Drops what lies inside the interval of a stronger detection.

    A detection is stronger with a higher priority, or with the same one and a longer interval. Equal intervals of
    one priority both stay.
    """
    kept: list[tuple[int, int, int, float, str]] = []
    holding: list[tuple[int, int, int, float, str]] = []  # intervals that reach over the current start
    for d in sorted(set(found), key=lambda d: (d[0], -d[1], -d[2])):
        holding = [o for o in holding if o[1] > d[0]]
        if not any(d[1] <= o[1] and (o[2] > d[2] or (o[2] == d[2] and o[1] - o[0] > d[1] - d[0])) for o in holding):
            kept.append(d)
        holding.append(d)
    return kept


_SEP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_IN = rb"[0-9a-z\x80-\xff]"


def base_patterns() -> list[tuple[str, bytes, bytes]]:
    """(label, keyword, pattern) of the base phrases; a phrase's words may be parted by any non-word bytes."""
    out = []
    for phrase, label in BASE:
        parts = phrase.encode().split()
        out.append((label, max(parts, key=len), rb"(?<!%b)%b(?!%b)" % (_IN, _SEP.join(parts), _IN)))
    return out


def scan_licenses(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row.

    ``spans`` lists the detections that stay as (label, first byte, end, score), bytes of the UTF-8 text; ``score`` is
    the largest one's score, at least 0.5 with a base phrase, else 0. A null or empty text has no words, null places
    and empty labels. Repeated rows are scanned one by one, null ids are kept, other columns are ignored.
    """
    rules = signatures()
    base = base_patterns()
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def scan(batches):
        compiled = [(rule, re.compile(rule.pattern)) for rule in rules]
        phrases = [(label, keyword, re.compile(pattern)) for label, keyword, pattern in base]
        for batch in batches:
            rows = []
            for w in words(batch.column(1), ALNUM, LOWER):
                for i in range(len(w.rows)):
                    text = w.text(i)
                    begin = w.starts[w.first[i] : w.first[i + 1]] - w.bounds[i]
                    places, base_labels = [], []
                    for label, keyword, pattern in phrases:
                        if keyword in text:
                            at = [m.start() for m in pattern.finditer(text)]
                            if at:
                                base_labels.append(label)
                                places.append(np.searchsorted(begin, at))
                    places = np.concatenate(places) if places else np.zeros(0, np.int64)
                    found = detections(text, compiled)
                    score = max([0.5 if base_labels else 0.0, *(d[3] for d in found)])
                    rows.append(
                        (
                            len(begin),
                            len(places),
                            int(places.min()) if len(places) else None,
                            int(places.max()) if len(places) else None,
                            ",".join(sorted(base_labels)),
                            ",".join(sorted({*base_labels, *(d[4] for d in found)})),
                            score,
                            [{"label": d[4], "start": d[0], "end": d[1], "score": d[3]} for d in found],
                        )
                    )
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(
        scan,
        f"doc_id {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,score:double>>",
    )


@register("op10_licenses")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
