"""License scans by ordered signature rules.

Rules are regular expressions over lower-cased UTF-8 bytes, gated by groups of
keywords: one Aho-Corasick pass finds the keywords of a text and only rules are
tried of whose every group a keyword occurs. Whatever a rule's pattern matches
holds a keyword of each of its groups. Overlapping detections are resolved by
priority: a detection that lies inside one of higher priority, or inside a
longer one of the same priority, is suppressed. The four base phrases are
counted beside the rules and are never suppressed.

Defined results: null and empty texts have no words, labels or places and
score 0; texts are scanned whole; equal texts give equal rows; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomstone.llm.text_bytes import as_bytes, bounded, split_at

# Phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Label, name pattern, keywords of which a name always holds one (after |, of another alternative), SPDX pattern, address pattern.
FAMILIES = (
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "affero", r"agpl-\d\.\d[-a-z]*", r"gnu\.org/licenses/agpl"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "general public", r"lgpl-\d\.\d[-a-z]*", r"gnu\.org/licenses/lgpl"),
    ("gpl", r"(?:gnu )?general public licen[cs]e|gnu gpl", "general public|gnu gpl", r"gpl-\d\.\d[-a-z]*", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("gfdl", r"gnu free documentation licen[cs]e", "free documentation", r"gfdl-\d\.\d[-a-z]*", r"gnu\.org/licenses/fdl"),
    ("apache", r"apache (?:software )?licen[cs]e", "apache", r"apache-\d\.\d", r"apache\.org/licenses"),
    ("mit", r"(?:mit|expat|x11) licen[cs]e", "licen", r"mit(?:-0)?", r"opensource\.org/licenses?/mit"),
    ("bsd", r"(?:new |modified |simplified |original )?bsd(?: \d-clause|-style)? licen[cs]e", "bsd", r"bsd-\d-clause[-a-z]*", r"opensource\.org/licenses?/bsd"),
    ("mpl", r"mozilla public licen[cs]e", "mozilla", r"mpl-\d\.\d[-a-z]*", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", r"eclipse public licen[cs]e", "eclipse", r"epl-\d\.\d", r"eclipse\.org/legal/epl"),
    ("cddl", r"common development and distribution licen[cs]e", "distribution", r"cddl-\d\.\d", r"opensource\.org/licenses?/cddl"),
    ("cpl", r"common public licen[cs]e", "common public", r"cpl-\d\.\d", r"opensource\.org/licenses?/cpl"),
    ("isc", r"isc licen[cs]e", "isc", r"isc", r"opensource\.org/licenses?/isc"),
    ("zlib", r"zlib(?:/libpng)? licen[cs]e", "zlib", r"zlib(?:-acknowledgement)?", r"zlib\.net/zlib_license"),
    ("boost", r"boost software licen[cs]e", "boost", r"bsl-1\.0", r"boost\.org/license"),
    ("artistic", r"(?:perl )?artistic licen[cs]e", "artistic", r"artistic-\d\.\d", r"perlfoundation\.org/artistic"),
    ("unlicense", r"the unlicen[cs]e|unlicen[cs]e", "unlicen", r"unlicense", r"unlicense\.org"),
    ("wtfpl", r"do what the f\S+ you want to public licen[cs]e", "you want to", r"wtfpl", r"wtfpl\.net"),
    ("cc-by-nc-nd", r"cc[ -]by[ -]nc[ -]nd|attribution-?noncommercial-?noderiv\w*", "cc|attribution", r"cc-by-nc-nd-\d\.\d", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", r"cc[ -]by[ -]nc[ -]sa|attribution-?noncommercial-?sharealike", "cc|attribution", r"cc-by-nc-sa-\d\.\d", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", r"cc[ -]by[ -]nc|attribution-?noncommercial", "cc|attribution", r"cc-by-nc-\d\.\d", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", r"cc[ -]by[ -]nd|attribution-?noderiv\w*", "cc|attribution", r"cc-by-nd-\d\.\d", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", r"cc[ -]by[ -]sa|attribution-?sharealike", "cc|attribution", r"cc-by-sa-\d\.\d", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", r"cc[ -]by|creative commons attribution", "cc|creative commons", r"cc-by-\d\.\d", r"creativecommons\.org/licenses/by/"),
    ("cc0", r"cc0(?: 1\.0)?(?: universal)?|creative commons zero", "cc0|creative commons", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("ofl", r"(?:sil )?open font licen[cs]e", "open font", r"ofl-\d\.\d", r"scripts\.sil\.org/ofl"),
    ("odbl", r"open database licen[cs]e", "open database", r"odbl-\d\.\d", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", r"open data commons attribution licen[cs]e", "open data commons", r"odc-by-\d\.\d", r"opendatacommons\.org/licenses/by"),
    ("pddl", r"public domain dedication and licen[cs]e", "public domain", r"pddl-\d\.\d", r"opendatacommons\.org/licenses/pddl"),
    ("psf", r"(?:psf|python software foundation) licen[cs]e", "licen", r"(?:psf|python)-\d\.\d", r"python\.org/psf/license"),
    ("php", r"php licen[cs]e", "php", r"php-3\.\d+", r"php\.net/license"),
    ("ruby", r"ruby licen[cs]e", "ruby", r"ruby", r"ruby-lang\.org/en/about/license"),
    ("openssl", r"openssl licen[cs]e", "openssl", r"openssl", r"openssl\.org/source/license"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", r"postgresql", r"postgresql\.org/about/licence"),
    ("eupl", r"european union public licen[cs]e", "european union", r"eupl-\d\.\d", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("osl", r"open software licen[cs]e", "open software", r"osl-\d\.\d", r"opensource\.org/licenses?/osl"),
    ("afl", r"academic free licen[cs]e", "academic free", r"afl-\d\.\d", r"opensource\.org/licenses?/afl"),
    ("ms-pl", r"microsoft public licen[cs]e", "microsoft", r"ms-pl", r"opensource\.org/licenses?/ms-pl"),
    ("bsl", r"business source licen[cs]e", "business source", r"busl-1\.1", r"mariadb\.com/bsl"),
    ("sspl", r"server side public licen[cs]e", "server side", r"sspl-1\.0", r"mongodb\.com/licensing/server-side"),
    ("elastic", r"elastic licen[cs]e", "elastic", r"elastic-2\.0", r"elastic\.co/licensing"),
    ("upl", r"universal permissive licen[cs]e", "universal permissive", r"upl-1\.0", r"opensource\.org/licenses?/upl"),
    ("beerware", r"beer-?ware licen[cs]e", "beer", r"beerware", r"people\.freebsd\.org/~phk"),
)

# Form, pattern around the name (N), keyword of the form, priority, confidence in tenths.
FORMS = (
    ("grant", r"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?(?:N)(?:,? (?:version|v) ?\d(?:\.\d)?)?", "under", 5, 9),
    ("version", r"(?:N),? (?:version |v)\d(?:\.\d)*(?: or (?:\(at your option\) )?(?:any )?later)?", "", 4, 8),
    ("notice", r"(?:see|read|accept|copy of) (?:the )?(?:N)", "", 3, 7),
    ("name", r"(?:N)", "", 2, 6),
)

# Sentences that standard texts hold: label, pattern, keyword, priority, confidence in tenths.
TEXTS = (
    ("mit", r"permission is hereby granted, free of charge, to any person", "permission is hereby", 6, 10),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software", "permission to use", 6, 9),
    ("bsd", r"redistribution and use in source and binary forms", "redistribution and use", 6, 9),
    ("zlib", r"this software is provided 'as-is', without any express or implied", "as-is", 6, 8),
    ("apache", r"you may not use this file except in compliance with the license", "in compliance with", 6, 8),
    ("gpl", r"this program is free software[:;] you can redistribute it", "free software", 6, 9),
    ("mpl", r"this source code form is subject to the terms of the mozilla", "source code form", 6, 10),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 6, 10),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain", "public domain", 3, 7),
    ("proprietary", r"all rights reserved", "rights reserved", 1, 4),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 3, 8),
    ("mit", r"the software is provided \"?as is\"?, without warranty of any kind, express or implied", "as is", 6, 8),
    ("mit", r"the above copyright notice and this permission notice shall be included", "permission notice", 6, 10),
    ("mit-0", r"without restriction, including without limitation the rights to use, copy, modify", "without restriction", 5, 8),
    ("x11", r"except as contained in this notice, the names? of", "as contained in this notice", 6, 9),
    ("isc", r"the software is provided \"?as is\"? and the author disclaims all warranties", "author disclaims", 6, 10),
    ("0bsd", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\.", "for any purpose", 5, 7),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of source", 6, 10),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary", 6, 10),
    ("bsd-3-clause", r"nor the names of (?:its|the) contributors may be used to endorse", "nor the names", 7, 10),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising materials", 7, 10),
    ("bsd", r"this software is provided by the (?:copyright holders|regents|authors?) (?:and contributors )?\"?as is", "is provided by the", 6, 8),
    ("apache", r"licensed under the apache license, version 2\.0 \(the \"?license\"?\)", "apache license", 7, 10),
    ("apache", r"unless required by applicable law or agreed to in writing, software distributed under the license", "agreed to in writing", 6, 9),
    ("apache", r"see the license for the specific language governing permissions and limitations", "governing permissions", 6, 9),
    ("apache", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge", "no-charge", 6, 10),
    ("gpl", r"either version \d(?:\.\d)? of the license, or \(?at your option\)? any later version", "any later version", 6, 8),
    ("gpl", r"you should have received a copy of the gnu general public license", "you should have received", 6, 10),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license", "you should have received", 7, 10),
    ("agpl", r"you should have received a copy of the gnu affero general public license", "you should have received", 7, 10),
    ("gpl", r"but without any warranty; without even the implied warranty of merchantability", "without even the implied", 6, 8),
    ("gpl-2.0", r"gnu general public license version 2, june 1991", "june 1991", 7, 10),
    ("gpl-3.0", r"gnu general public license version 3, 29 june 2007", "29 june 2007", 7, 10),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim copies", 6, 9),
    ("agpl", r"remote network interaction; use with the gnu general public license", "remote network interaction", 7, 10),
    ("lgpl", r"this library is free software[:;] you can redistribute it", "this library is free", 7, 10),
    ("mpl", r"if a copy of the mpl was not distributed with this file", "a copy of the mpl", 7, 10),
    ("epl", r"the accompanying materials are made available under the terms of the eclipse public license", "accompanying materials", 7, 10),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license", "accompanying program", 7, 10),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "contents of this file", 7, 10),
    ("artistic", r"you may make and give away verbatim copies of the (?:source form of the )?(?:standard version|package)", "make and give away", 6, 9),
    ("boost", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", "person or organization", 7, 10),
    ("zlib", r"the origin of this software must not be misrepresented", "must not be misrepresented", 6, 10),
    ("zlib", r"altered source versions must be plainly marked as such", "altered source versions", 6, 10),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "anyone is free to", 6, 10),
    ("cc0", r"has waived all copyright and related", "has waived all copyright", 7, 10),
    ("cc-by", r"you must give appropriate credit, provide a link to the license", "appropriate credit", 5, 8),
    ("cc-by-sa", r"you must distribute your contributions under the same license as the original", "under the same license", 5, 8),
    ("cc-by-nc", r"you may not use the material for commercial purposes", "commercial purposes", 5, 8),
    ("cc-by-nd", r"you may not distribute the modified material", "modified material", 5, 8),
    ("ofl", r"this font software is licensed under the sil open font license", "font software", 7, 10),
    ("ofl", r"with reserved font name", "reserved font name", 6, 9),
    ("openssl", r"this product includes software developed by the openssl project", "openssl project", 7, 10),
    ("php", r"this product includes php software, freely available from", "includes php", 7, 10),
    ("psf", r"psf is making python available to licensee on an \"?as is\"? basis", "making python available", 7, 10),
    ("postgresql", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee", "and its documentation", 7, 9),
    ("ms-pl", r"each contributor grants you a non-exclusive, worldwide, royalty-free copyright license", "royalty-free copyright", 6, 7),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license", "verbatim or modified copies", 6, 9),
    ("beerware", r"if we meet some day, and you think this stuff is worth it, you can buy me a beer", "buy me a beer", 7, 10),
    ("bsl", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use", "non-production use", 7, 10),
    ("sspl", r"making the functionality of the program or modified version available to third parties as a service", "as a service", 7, 10),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service", "managed service", 7, 10),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|distribution) of this (?:file|document|software)", "unauthori", 4, 8),
    ("proprietary", r"no part of this (?:publication|document|book) may be reproduced", "may be reproduced", 4, 8),
    ("proprietary", r"(?:strictly|company) confidential", "confidential", 2, 5),
    ("proprietary", r"for internal use only", "internal use only", 2, 5),
    ("public-domain", r"this (?:work|file|program|text) is in the public domain", "public domain", 4, 8),
    ("copyright", r"copyright (?:\(c\)|\xc2\xa9)? ?(?:19|20)\d\d", "copyright", 1, 3),
)

SPDX = r"spdx-license-identifier: ?\(?(?:S)(?![-.\w])"
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = True
_IN, _OUT = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]"


@dataclass(frozen=True)
class Signature:
    """One rule: what it finds, when it is tried, and how it ranks."""

    label: str
    form: str
    pattern: str
    keywords: tuple[tuple[str, ...], ...]
    priority: int
    confidence: float


def signature_rules() -> tuple[Signature, ...]:
    """The rules in order: families by form, then identifiers, addresses and standard texts."""
    rules = []
    for label, name, keyword, spdx, address in FAMILIES:
        for form, around, form_keyword, priority, confidence in FORMS:
            need = tuple(tuple(k.split("|")) for k in (keyword, form_keyword) if k)
            rules.append(Signature(label, form, around.replace("N", name), need, priority, confidence / 10))
        rules.append(Signature(label, "spdx", SPDX.replace("S", spdx), (("spdx-license-identifier",),), 7, 1.0))
        rules.append(Signature(label, "address", address, ((_address_keyword(address),),), 6, 0.9))
    rules += [Signature(label, "text", pattern, ((key,),), priority, c / 10) for label, pattern, key, priority, c in TEXTS]
    return tuple(rules)


def _address_keyword(address: str) -> str:
    return re.split(r"\\|/", address)[0]


@lru_cache(maxsize=1)
def _compiled():
    rules = signature_rules()
    automaton, numbers, holding = ahocorasick.Automaton(), {}, {}
    for rule in rules:
        for group in rule.keywords:
            number = numbers.setdefault(group, len(numbers))
            for keyword in group:
                holding.setdefault(keyword, set()).add(number)
    for keyword, groups in holding.items():
        automaton.add_word(keyword, frozenset(groups))
    automaton.make_automaton()
    gates = [frozenset(numbers[group] for group in r.keywords) for r in rules]
    patterns = [re.compile(rb"(?<!" + _IN + rb")(?:" + r.pattern.encode("latin-1") + rb")(?!" + _IN + rb")") for r in rules]
    base = [(label, re.compile(rb"(?<!" + _IN + rb")(?=" + (_OUT + b"+").join(p.encode().split()) + rb"(?!" + _IN + rb"))"), p.split()[0].encode()) for p, label in BASE]
    return automaton, rules, gates, patterns, base


def detect(lowered: bytes) -> list[tuple[int, int, int]]:
    """Kept detections of one lower-cased text: (start, end, rule number), by start."""
    automaton, rules, gates, patterns, _ = _compiled()
    seen = set().union(*{groups for _, groups in automaton.iter(lowered.decode("latin-1"))})
    if not seen:
        return []
    found = [(m.start(), m.end(), k) for k, gate in enumerate(gates) if gate <= seen for m in patterns[k].finditer(lowered)]
    return suppress(found, [r.priority for r in rules])


def suppress(found: list[tuple[int, int, int]], priority: list[int]) -> list[tuple[int, int, int]]:
    """Drop what lies inside a detection of higher priority, or of the same priority that is longer or an earlier rule.

    In order of rank, a detection is kept unless a kept one contains it: the
    furthest end among kept starts at or before its own, from a Fenwick tree.
    """
    places = {start: k + 1 for k, start in enumerate(sorted({d[0] for d in found}))}
    furthest, kept = [0] * (len(places) + 1), []
    for start, end, rule in sorted(found, key=lambda d: (-priority[d[2]], d[0] - d[1], d[2], d[0])):
        at, reach = places[start], 0
        while at:
            reach, at = max(reach, furthest[at]), at & (at - 1)
        if reach >= end:
            continue
        kept.append((start, end, rule))
        at = places[start]
        while at <= len(places):
            furthest[at] = max(furthest[at], end)
            at += at & -at
    return sorted(kept)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan rows of (doc_id, text)."""
    _, rules, _, _, base = _compiled()
    for batch in bounded(batches):
        data, offsets = as_bytes(batch.column("text"))
        starts, _, owner = split_at(WORD_BYTE[data], offsets)
        words = np.bincount(owner, minlength=batch.num_rows)
        lowered, firsts = data.tobytes().lower(), np.searchsorted(starts, offsets)
        rows = {name: [] for name in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for i in range(batch.num_rows):
            text = lowered[offsets[i] : offsets[i + 1]]
            places, base_labels = [], set()
            for label, pattern, first in base:
                if first in text:
                    at = [m.start() for m in pattern.finditer(text)]
                    places += at
                    base_labels |= {label} if at else set()
            index = np.searchsorted(starts, np.array(sorted(places), dtype=np.int64) + offsets[i]) - firsts[i]
            kept = detect(text)
            miss = 1.0
            for rule in {k for _, _, k in kept}:
                miss *= 1.0 - rules[rule].confidence
            labels = base_labels | {rules[k].label for _, _, k in kept}
            rows["n_base"].append(len(places))
            rows["first_word"].append(int(index[0]) if len(index) else None)
            rows["last_word"].append(int(index[-1]) if len(index) else None)
            rows["base_labels"].append(",".join(sorted(base_labels)))
            rows["labels"].append(",".join(sorted(labels)))
            rows["score"].append(max(1.0 - miss, 0.6 if base_labels else 0.0))
        columns = [batch.column("doc_id").cast(pa.int64()), pa.array(words, pa.int64())]
        columns += [pa.array(rows[k], pa.int64()) for k in ("n_base", "first_word", "last_word")]
        columns += [pa.array(rows[k], pa.string()) for k in ("base_labels", "labels")]
        columns.append(pa.array(rows["score"], pa.float64()))
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def scan(docs: DataFrame) -> DataFrame:
    """License detections of each document, without moving rows."""
    return docs.select("doc_id", "text").mapInArrow(scan_batches, SCHEMA)
