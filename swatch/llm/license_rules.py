"""Ordered signature rules for licences: patterns written by hand, each with the words that must occur for it to be tried.

In a pattern a space stands for a run of ASCII characters that are neither letters nor digits, so names match whatever
the punctuation or line breaks between their words; letters match in either case, whole words only.  ``tag`` and
``url`` patterns are matched as written.
"""

from __future__ import annotations

import re
from typing import NamedTuple

WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"
GAP = rf"[^{WORD}]{{1,12}}"

# Tiers, the best first, with the confidence of a detection.
TAG, URL, NOTICE, NAME, FAMILY, GENERIC = range(1, 7)
WEIGHT = {TAG: 1.0, URL: 0.95, NOTICE: 0.9, NAME: 0.85, FAMILY: 0.7, GENERIC: 0.4}


class Rule(NamedTuple):
    label: str
    tier: int
    keywords: tuple[str, ...]  # all in the lower-cased text, or the rule is not tried
    pattern: str


VERSION = r"(?:version |ver |v ?)?"
_L = r"(?:the )?"

# Label, two keywords, name, identifier in tags, address.
LICENSES = [
    ("apache-1.0", "apache", "", rf"apache (?:software )?licen[cs]e {VERSION}1 0", r"Apache-1\.0", r"apache\.org/licenses/LICENSE-1\.0"),
    ("apache-1.1", "apache", "", rf"apache (?:software )?licen[cs]e {VERSION}1 1", r"Apache-1\.1", r"apache\.org/licenses/LICENSE-1\.1"),
    ("apache-2.0", "apache", "", rf"apache (?:software )?licen[cs]e {VERSION}2(?: 0)?|apache {VERSION}2(?: 0)? licen[cs]e", r"Apache-2\.0", r"apache\.org/licenses/LICENSE-2\.0"),
    ("mit", "", "", r"mit(?: x11)? (?:style )?licen[cs]e|licen[cs]ed under (?:the )?mit|expat licen[cs]e", r"MIT", r"opensource\.org/licenses?/mit"),
    ("mit-0", "mit", "", r"mit no attribution licen[cs]e|mit 0 licen[cs]e", r"MIT-0", r"opensource\.org/licenses?/mit-0"),
    ("x11", "", "", r"x11 licen[cs]e|x consortium licen[cs]e", r"X11", r"xfree86\.org/3\.3\.6/COPYRIGHT2"),
    ("isc", "", "", r"isc (?:style )?licen[cs]e|internet systems consortium licen[cs]e", r"ISC", r"opensource\.org/licenses?/isc"),
    ("0bsd", "bsd", "", r"zero clause bsd(?: licen[cs]e)?|0 clause bsd(?: licen[cs]e)?|bsd zero clause(?: licen[cs]e)?", r"0BSD", r"opensource\.org/licenses?/0bsd"),
    ("bsd-1-clause", "bsd", "clause", r"(?:1|one) clause bsd(?: licen[cs]e)?|bsd (?:1|one) clause(?: licen[cs]e)?", r"BSD-1-Clause", r"opensource\.org/licenses?/bsd-1-clause"),
    ("bsd-2-clause", "bsd", "", r"(?:2|two) clause bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e", r"BSD-2-Clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", "", r"(?:3|three) clause bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e", r"BSD-3-Clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", "", r"(?:4|four) clause bsd(?: licen[cs]e)?|bsd (?:4|four) clause(?: licen[cs]e)?|original bsd licen[cs]e", r"BSD-4-Clause", r"directory\.fsf\.org/wiki/License:BSD-4-Clause"),
    ("gpl-1.0", "gpl", "", rf"gpl {VERSION}1(?: 0)?|gplv1", r"GPL-1\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "gpl", "", rf"gpl {VERSION}2(?: 0)?|gplv2", r"GPL-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gpl", "", rf"gpl {VERSION}3(?: 0)?|gplv3", r"GPL-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-1.0", "general", "public", rf"(?:gnu )?general public licen[cs]e {VERSION}1(?: 0)?", r"GPL-1", r"gnu\.org/copyleft/gpl-1"),
    ("gpl-2.0", "general", "public", rf"(?:gnu )?general public licen[cs]e {VERSION}2(?: 0)?|version 2 of the gnu general public licen[cs]e", r"GPL-2", r"gnu\.org/copyleft/gpl-2"),
    ("gpl-3.0", "general", "public", rf"(?:gnu )?general public licen[cs]e {VERSION}3(?: 0)?|version 3 of the gnu general public licen[cs]e", r"GPL-3", r"gnu\.org/copyleft/gpl-3"),
    ("lgpl-2.0", "library", "public", rf"(?:gnu )?library general public licen[cs]e(?: {VERSION}2(?: 0)?)?", r"LGPL-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("lgpl-2.1", "lesser", "public", rf"(?:gnu )?lesser general public licen[cs]e {VERSION}2 1|version 2 1 of the gnu lesser general public licen[cs]e", r"LGPL-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lesser", "public", rf"(?:gnu )?lesser general public licen[cs]e {VERSION}3(?: 0)?|version 3 of the gnu lesser general public licen[cs]e", r"LGPL-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2.1", "lgpl", "", rf"lgpl {VERSION}2 1|lgplv2 1", r"LGPL-2\.1", r"gnu\.org/copyleft/lgpl-2\.1"),
    ("lgpl-3.0", "lgpl", "", rf"lgpl {VERSION}3(?: 0)?|lgplv3", r"LGPL-3", r"gnu\.org/copyleft/lgpl-3"),
    ("agpl-3.0", "affero", "", rf"(?:gnu )?affero general public licen[cs]e(?: {VERSION}3(?: 0)?)?", r"AGPL-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("agpl-3.0", "agpl", "", rf"agpl {VERSION}3(?: 0)?|agplv3", r"AGPL-3", r"gnu\.org/licenses/agpl\.html"),
    ("agpl-1.0", "affero", "", rf"affero general public licen[cs]e {VERSION}1(?: 0)?", r"AGPL-1\.0(?:-only|-or-later)?", r"affero\.org/oagpl"),
    ("gfdl-1.1", "documentation", "free", rf"(?:gnu )?free documentation licen[cs]e {VERSION}1 1", r"GFDL-1\.1(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.1"),
    ("gfdl-1.2", "documentation", "free", rf"(?:gnu )?free documentation licen[cs]e {VERSION}1 2", r"GFDL-1\.2(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2"),
    ("gfdl-1.3", "documentation", "free", rf"(?:gnu )?free documentation licen[cs]e {VERSION}1 3", r"GFDL-1\.3(?:-only|-or-later)?", r"gnu\.org/licenses/fdl-1\.3"),
    ("mpl-1.0", "mozilla", "", rf"mozilla public licen[cs]e {VERSION}1 0", r"MPL-1\.0", r"mozilla\.org/MPL/1\.0|mozilla\.org/MPL/MPL-1\.0"),
    ("mpl-1.1", "mozilla", "", rf"mozilla public licen[cs]e {VERSION}1 1", r"MPL-1\.1", r"mozilla\.org/MPL/1\.1|mozilla\.org/MPL/MPL-1\.1"),
    ("mpl-2.0", "mozilla", "", rf"mozilla public licen[cs]e {VERSION}2(?: 0)?", r"MPL-2\.0", r"mozilla\.org/MPL/2\.0"),
    ("epl-1.0", "eclipse", "", rf"eclipse public licen[cs]e {VERSION}1(?: 0)?", r"EPL-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", "", rf"eclipse public licen[cs]e {VERSION}2(?: 0)?", r"EPL-2\.0", r"eclipse\.org/legal/epl-(?:2\.0|v20)"),
    ("edl-1.0", "eclipse", "", rf"eclipse distribution licen[cs]e(?: {VERSION}1(?: 0)?)?", r"EDL-1\.0", r"eclipse\.org/legal/edl"),
    ("cddl-1.0", "development", "distribution", rf"common development (?:and )?distribution licen[cs]e(?: {VERSION}1 0)?", r"CDDL-1\.0", r"opensource\.org/licenses?/cddl-?1"),
    ("cddl-1.1", "development", "distribution", rf"common development (?:and )?distribution licen[cs]e {VERSION}1 1", r"CDDL-1\.1", r"glassfish\.java\.net/public/CDDL"),
    ("cpl-1.0", "common", "public", rf"common public licen[cs]e(?: {VERSION}1(?: 0)?)?", r"CPL-1\.0", r"opensource\.org/licenses?/cpl1"),
    ("ipl-1.0", "ibm", "public", rf"ibm public licen[cs]e(?: {VERSION}1(?: 0)?)?", r"IPL-1\.0", r"opensource\.org/licenses?/ibmpl"),
    ("apsl-2.0", "apple", "public", rf"apple public source licen[cs]e(?: {VERSION}2(?: 0)?)?", r"APSL-2\.0", r"opensource\.apple\.com/license/apsl"),
    ("artistic-1.0", "artistic", "", rf"artistic licen[cs]e {VERSION}1(?: 0)?", r"Artistic-1\.0(?:-Perl)?", r"opensource\.org/licenses?/artistic-license-1\.0"),
    ("artistic-2.0", "artistic", "", rf"artistic licen[cs]e {VERSION}2(?: 0)?", r"Artistic-2\.0", r"opensource\.org/licenses?/artistic-license-2\.0"),
    ("afl-3.0", "academic", "free", rf"academic free licen[cs]e(?: {VERSION}3(?: 0)?)?", r"AFL-3\.0", r"opensource\.org/licenses?/afl-3\.0"),
    ("osl-3.0", "open software", "", rf"open software licen[cs]e(?: {VERSION}3(?: 0)?)?", r"OSL-3\.0", r"opensource\.org/licenses?/osl-3\.0"),
    ("bsl-1.0", "boost", "", rf"boost software licen[cs]e(?: {VERSION}1(?: 0)?)?", r"BSL-1\.0", r"boost\.org/LICENSE_1_0"),
    ("busl-1.1", "business", "source", rf"business source licen[cs]e(?: {VERSION}1 1)?", r"BUSL-1\.1", r"mariadb\.com/bsl11"),
    ("sspl-1.0", "server side", "", rf"server side public licen[cs]e(?: {VERSION}1(?: 0)?)?", r"SSPL-1\.0", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", "elastic", "", rf"elastic licen[cs]e(?: {VERSION}2(?: 0)?)?", r"Elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    ("zlib", "zlib", "", r"zlib (?:libpng )?licen[cs]e", r"Zlib", r"zlib\.net/zlib_license"),
    ("libpng-2.0", "png", "", r"png reference library licen[cs]e(?: version 2)?|libpng licen[cs]e(?: version 2)?", r"libpng-2\.0", r"libpng\.org/pub/png/src/libpng-LICENSE"),
    ("psf-2.0", "python", "", rf"python software foundation licen[cs]e(?: {VERSION}2(?: 0)?)?", r"(?:PSF|Python)-2\.0", r"docs\.python\.org/[0-9./]*license|python\.org/psf/license"),
    ("php-3.01", "php", "", rf"php licen[cs]e {VERSION}3 0?1", r"PHP-3\.01", r"php\.net/license/3_01"),
    ("ruby", "ruby", "", r"ruby(?: s)? licen[cs]e", r"Ruby", r"ruby-lang\.org/en/LICENSE"),
    ("openssl", "", "", r"openssl licen[cs]e|original ssleay licen[cs]e", r"OpenSSL", r"openssl\.org/source/license"),
    ("postgresql", "postgresql", "", r"postgresql licen[cs]e", r"PostgreSQL", r"postgresql\.org/about/licen[cs]e"),
    ("curl", "curl", "licen", r"curl licen[cs]e", r"curl", r"curl\.(?:se|haxx\.se)/docs/copyright"),
    ("ncsa", "illinois", "", r"university of illinois (?:ncsa )?open source licen[cs]e", r"NCSA", r"opensource\.org/licenses?/ncsa"),
    ("w3c", "w3c", "", r"w3c (?:software )?(?:notice and )?licen[cs]e", r"W3C(?:-20150513)?", r"w3\.org/Consortium/Legal"),
    ("unlicense", "", "", r"(?:the )?unlicen[cs]e", r"Unlicense", r"unlicense\.org"),
    ("wtfpl", "", "", r"wtfpl|do what the fuck you want to public licen[cs]e", r"WTFPL", r"wtfpl\.net"),
    ("beerware", "", "", r"the beer ware licen[cs]e|beerware licen[cs]e", r"Beerware", r"spdx\.org/licenses/Beerware"),
    ("eupl-1.1", "european", "public", rf"european union public licen[cs]e {VERSION}1 1", r"EUPL-1\.1", r"joinup\.ec\.europa\.eu/software/page/eupl/licence-eupl-1\.1"),
    ("eupl-1.2", "european", "public", rf"european union public licen[cs]e(?: {VERSION}1 2)?", r"EUPL-1\.2", r"joinup\.ec\.europa\.eu/\S{0,80}eupl"),
    ("cecill-2.1", "cecill", "", rf"cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: {VERSION}2(?: 1)?)?", r"CECILL-2\.[01]", r"cecill\.info/licences"),
    ("ms-pl", "", "", r"microsoft public licen[cs]e|ms pl licen[cs]e", r"MS-PL", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "", "", r"microsoft reciprocal licen[cs]e|ms rl licen[cs]e", r"MS-RL", r"opensource\.org/licenses?/ms-rl"),
    ("ofl-1.1", "font", "", rf"sil open font licen[cs]e(?: {VERSION}1 1)?|open font licen[cs]e {VERSION}1 1", r"OFL-1\.1", r"scripts\.sil\.org/OFL"),
    ("odbl-1.0", "", "", rf"open (?:data commons )?(?:open )?database licen[cs]e(?: {VERSION}1 0)?|odbl", r"ODbL-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "data commons", "", r"open data commons attribution licen[cs]e", r"ODC-By-1\.0", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "data commons", "", r"open data commons public domain dedication(?: and licen[cs]e)?", r"PDDL-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("cdla-permissive-2.0", "community data", "", rf"community data licen[cs]e agreement permissive(?: {VERSION}2(?: 0)?)?", r"CDLA-Permissive-[12]\.0", r"cdla\.dev/permissive"),
    ("openrail-m", "openrail", "", r"(?:creativeml |bigcode )?openrail(?: m)?(?: licen[cs]e)?", r"OpenRAIL-M", r"licenses\.ai"),
    ("llama", "llama", "community", r"llama(?: [23](?: [0-9])?)? community licen[cs]e(?: agreement)?", r"Llama-[23][0-9.]*", r"llama\.meta\.com/\S{0,80}license"),
    ("cc0-1.0", "cc0", "", rf"cc0(?: {VERSION}1 0)?(?: universal)?", r"CC0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-pdm-1.0", "public domain", "", r"public domain mark(?: 1 0)?", r"CC-PDM-1\.0", r"creativecommons\.org/publicdomain/mark"),
    ("mulan-psl-2.0", "mulan", "", rf"mulan permissive software licen[cs]e(?: {VERSION}2)?|mulan psl licen[cs]e", r"MulanPSL-2\.0", r"license\.coscl\.org\.cn/MulanPSL2"),
    ("polyform-noncommercial", "polyform", "", r"polyform noncommercial licen[cs]e(?: 1 0 0)?", r"PolyForm-Noncommercial-1\.0\.0", r"polyformproject\.org/licenses/noncommercial"),
]

# Creative Commons: the short form of the terms, and the terms spelled out.
CC_TERMS = [
    ("by", "attribution"),
    ("by-sa", "attribution share ?alike"),
    ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by-nc", "attribution non ?commercial"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

# Label, two keywords, words of the licence's own text.
NOTICES = [
    ("mit", "hereby", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "merchantability", "", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "permission", "modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-3-clause", "endorse", "", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse"),
    ("bsd-2-clause", "redistribution", "", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-4-clause", "advertising", "", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "compliance", "licen", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", "contributor", "", r"licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("gpl-or-later", "redistribute", "general", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-or-later", "later version option", "", r"either version [123](?: 0)? of the licen[cs]e or at your option any later version"),
    ("lgpl-or-later", "lesser", "terms", r"under the terms of the gnu lesser general public licen[cs]e"),
    ("agpl-or-later", "affero", "terms", r"under the terms of the gnu affero general public licen[cs]e"),
    ("gpl-no-warranty", "fitness", "", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mpl-2.0", "source code form", "", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-1.1", "contents of this file", "", r"the contents of this file are subject to the mozilla public licen[cs]e"),
    ("cddl-1.0", "contents of this file", "", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("epl-2.0", "eclipse", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("unlicense", "unencumbered", "", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "everyone is permitted", "", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"),
    ("zlib", "misrepresented", "", r"the origin of this software must not be misrepresented"),
    ("bsl-1.0", "organization obtaining", "", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("beerware", "buy me a beer", "", r"you can buy me a beer in return"),
    ("ofl-1.1", "font", "sil", r"this font software is licen[cs]ed under the sil open font licen[cs]e"),
    ("postgresql", "documentation", "fee", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("cc0-1.0", "waived", "", r"waived all copyright and related or neighboring rights"),
    ("psf-2.0", "psf", "", r"psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e"),
    ("gfdl-1.3", "invariant", "", r"with no invariant sections no front cover texts and no back cover texts"),
    ("ogl-uk", "open government", "", rf"open government licen[cs]e(?: {VERSION}[123](?: 0)?)?"),
]

FAMILIES = [
    ("apache", "apache", "licen", r"apache (?:software )?licen[cs]e"),
    ("bsd", "bsd", "licen", r"bsd (?:style )?licen[cs]e"),
    ("gpl", "general", "public", r"(?:gnu )?general public licen[cs]e"),
    ("gpl", "gpl", "", r"gpl|gnu gpl"),
    ("lgpl", "lgpl", "", r"lgpl|gnu lgpl"),
    ("lgpl", "lesser", "public", r"(?:gnu )?lesser general public licen[cs]e"),
    ("agpl", "agpl", "", r"agpl|gnu agpl"),
    ("gfdl", "documentation", "free", r"(?:gnu )?free documentation licen[cs]e"),
    ("mpl", "mozilla", "licen", r"mozilla public licen[cs]e"),
    ("epl", "eclipse", "licen", r"eclipse public licen[cs]e"),
    ("artistic", "artistic", "licen", r"artistic licen[cs]e"),
    ("php", "php", "licen", r"php licen[cs]e"),
    ("cc", "creative commons", "", r"creative commons(?: licen[cs]e)?"),
    ("public-domain", "public domain", "", r"(?:released|dedicated|placed) (?:in|into|to) the public domain|this work is in the public domain"),
]

GENERICS = [
    ("reserved", "reserved", "rights", r"all rights reserved|(?:some|no) rights reserved"),
    ("licensed", "licen", "", r"(?:is |are )?(?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of )?(?:the )?[0-9a-z]{2,20}(?: [0-9a-z]{1,20})? licen[cs]e"),
    ("see-license", "licen", "", r"see (?:the )?(?:file )?licen[cs]e(?: txt| md)? (?:file )?for (?:more )?(?:details|information|terms)"),
    ("proprietary", "proprietary", "", r"proprietary (?:and )?(?:confidential|licen[cs]e|software)|confidential and proprietary"),
    ("copyright", "copyright", "", r"copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("warranty-disclaimer", "warrant", "", r"without warrant(?:y|ies) of any kind|no warranty"),
    ("non-commercial", "commercial", "use", r"(?:for )?non ?commercial use only|not for commercial use"),
    ("reproduction", "reproduc", "", r"no part of this (?:publication|work|book|document) may be reproduced"),
    ("permission", "permission", "", r"(?:reprinted|reproduced|used) (?:with|by) permission"),
    ("academic-use", "only", "", r"for academic(?: and research)? (?:use|purposes) only|for research(?: and academic)? (?:use|purposes) only"),
]

# A text without any of these has none of the rules' keywords in a place where a rule could match.
# Every rule needs one of these; a text without any is not searched.  ``cc`` counts only where ``cc by`` stands.
ANCHORS = ("licen", "spdx", "commons", "copyright", "copyleft", "clause", "domain", "gpl", "warrant", "permi", "redistribut",
           "mpl", "epl", "cc0", "wtfpl", "odbl", "cecill", "openrail", "legal", "cddl", "ofl", "eupl", "unencumbered",
           "misrepresented", "beer", "regents", "contributors", "advertising", "invariant", "proprietary", "commercial",
           "reserved", "published", "reproduced", "apsl", "bsl11", "academic", "research", "confidential", "cc")


def _worded(pattern: str) -> str:
    return rf"(?i)(?<![{WORD}])(?:{pattern})(?![{WORD}])".replace(" ?", f"(?:{GAP})?").replace(" ", GAP)


def alternatives(pattern: str) -> list[str]:
    """The pattern's parts between bars outside of brackets."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def certain(pattern: str) -> str:
    """The pattern without its optional groups and those of several forms, lower-cased: what every match must contain."""
    plain = pattern.replace("\\", "").lower()
    while (group := re.search(r"\((?:\?:|\?<!|\?!)([^()]*)\)([?]?)", plain)):
        own = group[1] if not group[2] and "|" not in group[1] and group[0].startswith("(?:") else "#"
        plain = plain[:group.start()] + own + plain[group.end():]
    return plain


def anchor_of(pattern: str) -> str:
    """An anchor that every match must contain."""
    sure = certain(pattern)
    return next(a for a in ANCHORS if a in sure)


def rules() -> list[Rule]:
    """All rules in order: an earlier one wins among equal intervals of one tier."""
    out = []

    def add(label: str, tier: int, keywords: str, pattern: str) -> None:
        for part in alternatives(pattern):
            words = dict.fromkeys([anchor_of(part), *keywords.split()])
            out.append(Rule(label, tier, tuple(words), _worded(part)))

    for label, one, two, name, tag, url in LICENSES:
        out.append(Rule(label, TAG, ("spdx",), rf"(?i)SPDX-License-Identifier:\x20{{0,4}}\(?(?:{tag})(?![{WORD}.-])"))
        for part in alternatives(url):
            out.append(Rule(label, URL, ("http", anchor_of(part)), rf"(?i)https?://(?:www\.)?{part}"))
        add(label, NAME, f"{one} {two}", name)
    for terms, spelled in CC_TERMS:
        for version in CC_VERSIONS:
            label, number, dots = f"cc-{terms}-{version}", version.replace(".", " "), version.replace(".", r"\.")
            out.append(Rule(label, TAG, ("spdx",), rf"(?i)SPDX-License-Identifier:\x20{{0,4}}\(?CC-{terms}-{dots}(?![{WORD}.-])"))
            out.append(Rule(label, URL, ("commons",), rf"(?i)creativecommons\.org/licenses/{terms}/{dots}"))
            add(label, NAME, "", f"cc {terms.replace('-', ' ')} {number}")
            add(label, NAME, "creative", f"creative commons {spelled} {number}(?: [a-z]{{1,20}})?(?: licen[cs]e)?")
        add(f"cc-{terms}", FAMILY, "", f"cc {terms.replace('-', ' ')}")
        add(f"cc-{terms}", FAMILY, "creative", f"creative commons {spelled}(?: licen[cs]e)?")
    for tier, own in ((NOTICE, NOTICES), (FAMILY, FAMILIES), (GENERIC, GENERICS)):
        for label, one, two, words in own:
            add(label, tier, f"{one} {two}", words)
    return sorted(out, key=lambda r: r.tier)
