"""License scan: ordered signature rules behind a keyword prefilter.

Every rule is a regular expression over the lower-cased text with a label, a
priority and keywords. The keywords are read off the expression: letters that
every match must hold, or for alternatives one of several, so the filter loses
no match. One Aho-Corasick pass finds the keywords; only the rules whose
keywords are all present run. Detections are taken by priority, then length,
then start, and one whose interval lies inside an accepted interval is
suppressed.

Edge cases: a null text counts as empty (no words, no labels, score 0); a text
without any keyword has no detections; equal rows give equal results; null ids
pass through; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from re import _parser

from pyspark.sql import DataFrame

from pointloom.llm.common import map_rows

#: Phrases counted as base places, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Names: label, identifier, pattern of the name, priority of the family.
FAMILIES = (
    ("apache-2.0", r"apache-2\.0(?:-only)?", r"apache(?: software)? licen[cs]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b", 1),
    ("apache-1.1", r"apache-1\.1", r"apache(?: software)? licen[cs]e,? ?(?:version|v\.?)? ?1\.1", 1),
    ("mit", r"mit", r"(?:mit|expat) licen[cs]e", 2),
    ("mit-0", r"mit-0", r"mit no attribution(?: licen[cs]e)?", 1),
    ("x11", r"x11", r"(?:mit/)?x11 licen[cs]e", 2),
    ("bsd-2-clause", r"bsd-2-clause", r"(?:simplified|freebsd|(?:2|two)[- ]clause) bsd licen[cs]e", 1),
    ("bsd-3-clause", r"bsd-3-clause", r"(?:new|modified|revised|(?:3|three)[- ]clause) bsd licen[cs]e", 1),
    ("bsd-4-clause", r"bsd-4-clause", r"(?:original|(?:4|four)[- ]clause) bsd licen[cs]e", 1),
    ("bsd", r"0bsd", r"(?:zero[- ]clause )?bsd(?:-style)? licen[cs]e", 3),
    ("isc", r"isc", r"isc licen[cs]e", 2),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:general public licen[cs]e|gpl),? ?(?:version |v\.? ?)?2(?:\.0)?\b", 1),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:general public licen[cs]e|gpl),? ?(?:version |v\.? ?)?3(?:\.0)?\b", 1),
    ("gpl", r"gpl", r"gnu general public licen[cs]e", 3),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?(?:version |v\.? ?)?2\.1", 1),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?(?:version |v\.? ?)?3(?:\.0)?\b", 1),
    ("lgpl", r"lgpl", r"gnu (?:lesser|library) general public licen[cs]e", 2),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:affero general public licen[cs]e|agpl),? ?(?:version |v\.? ?)?3(?:\.0)?\b", 1),
    ("agpl", r"agpl", r"gnu affero general public licen[cs]e", 2),
    ("mpl-1.1", r"mpl-1\.1", r"mozilla public licen[cs]e,? (?:version |v\.? ?)?1\.1", 1),
    ("mpl-2.0", r"mpl-2\.0", r"mozilla public licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?", 1),
    ("epl-1.0", r"epl-1\.0", r"eclipse public licen[cs]e(?:,? -? ?(?:version |v\.? ?)?1(?:\.0)?)", 1),
    ("epl-2.0", r"epl-2\.0", r"eclipse public licen[cs]e(?:,? -? ?(?:version |v\.? ?)?2(?:\.0)?)", 1),
    ("cddl-1.0", r"cddl-1\.0", r"common development and distribution licen[cs]e", 1),
    ("cpl-1.0", r"cpl-1\.0", r"common public licen[cs]e", 1),
    ("artistic-2.0", r"artistic-2\.0", r"artistic licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?", 1),
    ("artistic-1.0", r"artistic-1\.0", r"(?:perl |clarified )?artistic licen[cs]e", 2),
    ("bsl-1.0", r"bsl-1\.0", r"boost software licen[cs]e", 1),
    ("zlib", r"zlib", r"zlib(?:/libpng)? licen[cs]e", 1),
    ("unlicense", r"unlicense", r"the unlicen[cs]e", 1),
    ("wtfpl", r"wtfpl", r"do what the f[u*]ck you want to public licen[cs]e", 1),
    ("cc0-1.0", r"cc0-1\.0", r"(?:cc0|creative commons zero)(?: 1\.0)?(?: universal)?", 1),
    ("cc-by-4.0", r"cc-by-4\.0", r"(?:cc[- ]by|creative commons attribution)(?: licen[cs]e)?[- ]4\.0", 1),
    ("cc-by-3.0", r"cc-by-3\.0", r"(?:cc[- ]by|creative commons attribution)(?: licen[cs]e)?[- ]3\.0", 1),
    ("cc-by-sa-4.0", r"cc-by-sa-4\.0", r"(?:cc[- ]by[- ]sa|creative commons attribution-sharealike)[- ]4\.0", 1),
    ("cc-by-sa-3.0", r"cc-by-sa-3\.0", r"(?:cc[- ]by[- ]sa|creative commons attribution-sharealike)[- ]3\.0", 1),
    ("cc-by-nc-4.0", r"cc-by-nc-4\.0", r"(?:cc[- ]by[- ]nc|creative commons attribution-noncommercial)[- ]4\.0", 1),
    ("cc-by-nc-sa-4.0", r"cc-by-nc-sa-4\.0", r"(?:cc[- ]by[- ]nc[- ]sa|creative commons attribution-noncommercial-sharealike)[- ]4\.0", 1),
    ("cc-by-nd-4.0", r"cc-by-nd-4\.0", r"(?:cc[- ]by[- ]nd|creative commons attribution-noderiv(?:ative)?s)[- ]4\.0", 1),
    ("cc-by-nc-nd-4.0", r"cc-by-nc-nd-4\.0", r"(?:cc[- ]by[- ]nc[- ]nd|creative commons attribution-noncommercial-noderiv(?:ative)?s)[- ]4\.0", 1),
    ("ofl-1.1", r"ofl-1\.1", r"sil open font licen[cs]e", 1),
    ("odbl-1.0", r"odbl-1\.0", r"open (?:data commons open )?database licen[cs]e", 1),
    ("pddl-1.0", r"pddl-1\.0", r"public domain dedication and licen[cs]e", 1),
    ("python-2.0", r"(?:psf-2\.0|python-2\.0)", r"python software foundation licen[cs]e", 1),
    ("php-3.01", r"php-3\.01", r"php licen[cs]e", 2),
    ("ruby", r"ruby", r"ruby licen[cs]e", 2),
    ("openssl", r"openssl", r"openssl licen[cs]e", 1),
    ("postgresql", r"postgresql", r"postgresql licen[cs]e", 1),
    ("eupl-1.2", r"eupl-1\.2", r"european union public licen[cs]e", 1),
    ("ms-pl", r"ms-pl", r"microsoft public licen[cs]e", 1),
    ("bsl-business", r"busl-1\.1", r"business source licen[cs]e", 1),
    ("sspl-1.0", r"sspl-1\.0", r"server side public licen[cs]e", 1),
    ("proprietary", r"licenseref-proprietary", r"(?:proprietary|commercial) licen[cs]e", 4),
)

#: Ways of granting, each a template with its own precedence and confidence.
NOTICES = (
    (0, r"spdx-license-identifier:\s*{id}(?![\w.+-])", 1.0),
    (10, r"(?:dual[- ])?licen[cs]ed\s+(?:to\s+\w+\s+)?(?:under|according to)\s+(?:the\s+)?(?:terms\s+(?:and conditions\s+)?of\s+)?(?:the\s+)?(?:{name}|{id}(?![\w+-]))", 0.95),
    (20, r"(?:released|distributed|published|made available|provided)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?{name}", 0.9),
    (30, r"subject\s+to\s+the\s+(?:terms\s+(?:and conditions\s+)?of\s+the\s+)?{name}", 0.85),
    (40, r"(?:under|see|read|accept)\s+the\s+{name}(?:\s+(?:for|text|file|below))", 0.7),
    (50, r"(?<!\w){name}", 0.6),
)

#: Signature texts: label, words of the text (a space is any white space, the rest a regular expression), priority, confidence.
SIGNATURES = (
    ("public-domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain", 15, 0.8),
    ("public-domain", r"no copyright is claimed", 20, 0.6),
    ("all-rights-reserved", r"all rights reserved", 60, 0.5),
    ("bsd", r"redistribution and use in source and binary forms", 12, 0.9),
    ("bsd-3-clause", r"neither the names? of .{1,80}? nor the names of (?:its|any|their) contributors may be used to endorse", 11, 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", 10, 0.95),
    ("bsd-2-clause", r"redistributions in binary form must reproduce the above copyright notice", 13, 0.8),
    ("bsd", r"redistributions of source code must retain the above copyright notice", 13, 0.8),
    ("mit", r"permission is hereby granted,? free of charge", 12, 0.9),
    ("mit", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies", 13, 0.9),
    ("mit", r"to deal in the software without restriction", 14, 0.8),
    ("x11", r"shall not be used in advertising or otherwise to promote the sale,? use or other dealings in this software", 11, 0.9),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute", 12, 0.9),
    ("isc", r"the software is provided \W{0,3}as is\W{0,3} and the author disclaims all warranties", 13, 0.85),
    ("apache-2.0", r"you may obtain a copy of the license at https?://www\.apache\.org/licenses/license-2\.0", 9, 1.0),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing, software distributed under the license", 12, 0.9),
    ("apache-2.0", r"licensed to the apache software foundation", 10, 0.95),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", 11, 0.85),
    ("gpl", r"free software foundation;? either version", 12, 0.9),
    ("gpl-2.0", r"either version 2 of the license, or \(at your option\) any later version", 11, 0.95),
    ("gpl-3.0", r"either version 3 of the license, or \(at your option\) any later version", 11, 0.95),
    ("gpl", r"you should have received a copy of the gnu general public license", 13, 0.9),
    ("gpl", r"51 franklin (?:street|st), fifth floor", 40, 0.5),
    ("gpl", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom", 12, 0.95),
    ("gpl-3.0", r"\W?propagate\W? a work means to do anything with it", 12, 0.95),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license", 11, 0.95),
    ("lgpl-2.1", r"either version 2\.1 of the license, or \(at your option\) any later version", 10, 0.95),
    ("lgpl", r"a program that contains no derivative of any portion of the library", 12, 0.9),
    ("agpl", r"you should have received a copy of the gnu affero general public license", 11, 0.95),
    ("agpl-3.0", r"interacting with it remotely through a computer network", 12, 0.9),
    ("gpl-classpath", r"as a special exception, the copyright holders of this library give you permission to link", 12, 0.85),
    ("gpl-font", r"if you create a document which uses this font", 12, 0.85),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license, v\. ?2\.0", 9, 1.0),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1", 9, 1.0),
    ("mpl-2.0", r"incompatible with secondary licenses", 20, 0.8),
    ("epl-2.0", r"https?://www\.eclipse\.org/legal/epl-2\.0", 12, 0.95),
    ("epl-1.0", r"https?://www\.eclipse\.org/legal/epl-v10\.html", 12, 0.95),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse", 14, 0.85),
    ("cddl-1.0", r"you may not use this file except in compliance with the common development", 12, 0.9),
    ("cddl-1.0", r"when distributing covered code, include this cddl header", 12, 0.95),
    ("cpl-1.0", r"any use, reproduction or distribution of the program constitutes recipient'?s acceptance", 16, 0.7),
    ("bsl-1.0", r"any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 12, 0.95),
    ("zlib", r"this software is provided \W{0,3}as-is\W{0,3}, without any express or implied warranty", 12, 0.9),
    ("zlib", r"the origin of this software must not be misrepresented", 12, 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 9, 1.0),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", 11, 0.95),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed", 12, 0.9),
    ("beerware", r"if we meet some day,? and you think this stuff is worth it", 12, 0.95),
    ("cc0-1.0", r"has waived all copyright and related or neighboring rights", 12, 0.95),
    ("cc0-1.0", r"https?://creativecommons\.org/publicdomain/zero/1\.0", 10, 1.0),
    ("cc-by-4.0", r"https?://creativecommons\.org/licenses/by/4\.0", 10, 1.0),
    ("cc-by-3.0", r"https?://creativecommons\.org/licenses/by/3\.0", 10, 1.0),
    ("cc-by-sa-4.0", r"https?://creativecommons\.org/licenses/by-sa/4\.0", 10, 1.0),
    ("cc-by-sa-3.0", r"https?://creativecommons\.org/licenses/by-sa/3\.0", 10, 1.0),
    ("cc-by-nc-4.0", r"https?://creativecommons\.org/licenses/by-nc/4\.0", 10, 1.0),
    ("cc-by-nc-sa-4.0", r"https?://creativecommons\.org/licenses/by-nc-sa/4\.0", 10, 1.0),
    ("cc-by-nd-4.0", r"https?://creativecommons\.org/licenses/by-nd/4\.0", 10, 1.0),
    ("cc-by-nc-nd-4.0", r"https?://creativecommons\.org/licenses/by-nc-nd/4\.0", 10, 1.0),
    ("ofl-1.1", r"the fonts, including any derivative works, can be bundled, embedded, redistributed", 12, 0.95),
    ("ofl-1.1", r"with reserved font name", 20, 0.8),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", 12, 0.9),
    ("artistic-2.0", r"you are permitted to use the standard version and create and use modified versions", 12, 0.85),
    ("python-2.0", r"psf is making python (?:\S+ )?available to licensee on an \W{0,3}as is\W{0,3} basis", 12, 0.95),
    ("openssl", r"this product includes software developed by the openssl project", 11, 0.95),
    ("openssl", r"this product includes cryptographic software written by eric young", 11, 0.95),
    ("php-3.01", r"this product includes php software, freely available from", 12, 0.95),
    ("postgresql", r"in no event shall the university of california be liable to any party for direct, indirect, special", 15, 0.7),
    ("ncsa", r"to deal with the software without restriction, including without limitation", 12, 0.8),
    ("eupl-1.2", r"licensed under the eupl", 11, 0.85),
    ("ms-pl", r"if you use the software, you accept this license\. if you do not accept the license, do not use the software", 13, 0.8),
    ("bsl-business", r"change date .{0,60}?change license", 18, 0.7),
    ("sspl-1.0", r"offering the functionality of the program or modified version to third parties as a service", 14, 0.9),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", 12, 0.9),
    ("commons-clause", r"the license does not grant to you, the right to sell the software", 12, 0.95),
    ("llama-community", r"llama \d(?:\.\d)? community license", 12, 0.9),
    ("rail", r"(?:open|big(?:science|code)) ?(?:open)?rail(?:-m)? license", 12, 0.85),
    ("proprietary", r"unauthori[sz]ed copying of this file,? via any medium,? is strictly prohibited", 14, 0.9),
    ("proprietary", r"proprietary and confidential", 30, 0.6),
    ("proprietary", r"may not be (?:reproduced|redistributed|copied),? .{0,60}?without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)", 25, 0.7),
    ("warranty-disclaimer", r"without even the implied warranty of merchantability or fitness for a particular purpose", 50, 0.4),
)


def _needs(tree) -> list[frozenset]:
    """Sets of letters of a parsed expression: every match holds one member of each set."""
    out, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if str(op) == "LITERAL":
            run += chr(arg)
            continue
        if str(op) == "BRANCH":  # what stands before goes with each way: the parser takes common first letters out
            ways = [_needs([*(("LITERAL", ord(c)) for c in run), *way]) for way in arg[1]]
            if all(ways):
                out.append(frozenset().union(*(max(way, key=_strength) for way in ways)))
                run = ""
                continue
        if run:
            out.append(frozenset({run}))
            run = ""
        match str(op):
            case "SUBPATTERN":
                out += _needs(arg[-1])
            case "MAX_REPEAT" | "MIN_REPEAT" if arg[0] > 0:
                out += _needs(arg[2])
    return out


#: Words too common to tell much.
EVERYDAY = frozenset("the under for file below text by worth released provided distributed available published subject document contents written received".split())


def _strength(words: frozenset) -> tuple[int, int, int]:
    plain = {w.strip() for w in words}
    return -len(plain & EVERYDAY), min(map(len, plain)), -len(words)


def keywords(pattern: str) -> tuple[frozenset, ...]:
    """The two strongest sets of letters that every match of the pattern must hold one of."""
    return tuple(sorted(set(_needs(_parser.parse(pattern))), key=lambda w: (*_strength(w), sorted(w)))[-2:])


@lru_cache(1)
def rules() -> list[tuple[int, str, re.Pattern, tuple[frozenset, ...], float]]:
    """All rules in order of priority: (priority, label, pattern, keyword sets each of which must be hit, confidence)."""
    out = []
    for label, ident, name, family in FAMILIES:
        for at, template, confidence in NOTICES:
            out.append((at + family, label, template.replace("{name}", name).replace("{id}", ident), confidence))
    for label, words, at, confidence in SIGNATURES:
        out.append((at, label, words.replace(" ", r"\s+"), confidence))
    return sorted(((at, label, re.compile(pattern, re.DOTALL), keywords(pattern), confidence) for at, label, pattern, confidence in out), key=lambda r: (r[0], r[1], r[2].pattern))


@lru_cache(1)
def gates() -> list[str]:
    """Letters one of which every match of any rule holds: the strongest sets' words that hold no other one."""
    words = {w for rule in rules() for w in rule[3][-1]}
    return sorted((w for w in words if not any(x != w and x in w for x in words)), key=len)


@lru_cache(1)
def _automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for rule in rules():
        for word in frozenset().union(*rule[3]):
            auto.add_word(word, word)
    auto.make_automaton()
    return auto


def detect(low: str, filtered: bool = True) -> list[tuple[int, int, str, float]]:
    """Detections (start, end, label, confidence) that survive suppression, by start; the same without the keyword filter."""
    if filtered and not any(g in low for g in gates()):
        return []
    present = {word for _, word in _automaton().iter(low)}
    found = []
    for at, label, pattern, needs, confidence in rules():
        if filtered and not all(need & present for need in needs):
            continue
        found += [(at, -(m.end() - m.start()), m.start(), m.end(), label, confidence) for m in pattern.finditer(low)]
    kept: list[tuple[int, int, str, float]] = []
    ends: list[tuple[int, int]] = []  # accepted intervals none of which holds another: sorted by start and by end
    for _, _, start, end, label, confidence in sorted(found):
        k = bisect_right(ends, (start, 1 << 60))
        if k and ends[k - 1][1] >= end:
            continue
        kept.append((start, end, label, confidence))
        j = k if not (k and ends[k - 1][0] == start) else k - 1
        while j < len(ends) and ends[j][1] <= end:
            del ends[j]
        ends.insert(j, (start, end))
    return sorted(kept)


_NOT_WORD = bytes(c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word index, label) of every place of a base phrase."""
    out = []
    for phrase, label in BASE:
        want = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(want[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(want)] == want:
                out.append((at, label))
    return out


def _scan(rows: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
    for doc_id, text in zip(rows["doc_id"], rows["text"]):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        words = raw.translate(_NOT_WORD).split()
        places = base_places(words) if b"license" in raw else []
        found = detect(raw.decode("utf-8", "replace"))
        base = {label for _, label in places}
        for key, value in (
            ("doc_id", doc_id), ("n_words", len(words)), ("n_base", len(places)),
            ("first_word", min((p for p, _ in places), default=None)), ("last_word", max((p for p, _ in places), default=None)),
            ("base_labels", ",".join(sorted(base))), ("labels", ",".join(sorted(base | {d[2] for d in found}))),
            ("score", max([d[3] for d in found] + [0.9] * bool(base), default=0.0)),
            ("spans", ",".join(f"{d[2]}:{d[0]}:{d[1]}" for d in found)),
        ):
            out[key].append(value)
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per input row: counts, base labels, all labels, score and spans of license notices."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return map_rows(docs.select("doc_id", "text"), _scan, schema)
