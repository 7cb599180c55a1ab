"""License scan by ordered signature rules.

The rules are hand-written signatures of license texts, headers and notices, and regexes made from a
table of license names and a table of notice templates.  A rule is tried only if all its keywords, the
words that it spells out, occur in the text; rules have priorities, and a detection
that lies inside another of the same or a higher priority is suppressed.  Three base
phrases are located word by word on every text, and their labels always stay.

Texts are lower-cased in A-Z only and read as UTF-8 bytes; a word is a run of digits, ASCII letters
and non-ASCII characters.  Defined results: a null or empty text has no words, no labels, null word
positions and score 0; repeated rows each get a row; a null ``doc_id`` is passed through; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import LOWER, slices, word_bounds

NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x61:0x7B] = False
NOT_WORD[0x80:] = False
GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
WORD = rb"[0-9a-z\x80-\xff]+"
EDGE_LEFT, EDGE_RIGHT = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"

# Base phrases and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Label -> names in notices (words separated by blanks) and, last, the short identifier.
LICENSES = {
    "mit": ("mit", "expat", "mit"),
    "apache-2": ("apache license version 2 0", "apache 2 0", "apache 2", "apache 2 0"),
    "apache-1": ("apache license version 1 1", "apache software license 1 1", "apache 1 1"),
    "gpl-2": ("gnu general public license version 2", "gnu gpl version 2", "gpl v2", "gplv2", "gpl 2 0"),
    "gpl-3": ("gnu general public license version 3", "gnu gpl version 3", "gpl v3", "gplv3", "gpl 3 0"),
    "gpl": ("gnu general public license", "gnu gpl", "gpl"),
    "lgpl-2": ("gnu lesser general public license version 2 1", "gnu library general public license version 2", "lgplv2", "lgpl 2 1"),
    "lgpl-3": ("gnu lesser general public license version 3", "lgplv3", "lgpl 3 0"),
    "lgpl": ("gnu lesser general public license", "gnu lgpl", "lgpl"),
    "agpl-3": ("gnu affero general public license version 3", "agplv3", "agpl 3 0"),
    "bsd-2": ("bsd 2 clause", "two clause bsd", "simplified bsd", "bsd 2 clause"),
    "bsd-3": ("bsd 3 clause", "three clause bsd", "new bsd", "bsd 3 clause"),
    "bsd": ("bsd style", "bsd"),
    "mpl-2": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "mpl-1": ("mozilla public license version 1 1", "mpl 1 1"),
    "epl-1": ("eclipse public license version 1 0", "epl 1 0"),
    "epl-2": ("eclipse public license version 2 0", "epl 2 0"),
    "cddl": ("common development and distribution license", "cddl 1 0"),
    "isc": ("isc",),
    "zlib": ("zlib",),
    "boost": ("boost software license", "bsl 1 0"),
    "unlicense": ("unlicense",),
    "wtfpl": ("do what the fuck you want to public license", "wtfpl"),
    "artistic-2": ("artistic license 2 0", "artistic 2 0"),
    "eupl": ("european union public licence", "eupl 1 2"),
    "odbl": ("open database license", "odbl 1 0"),
    "ofl": ("sil open font license", "ofl 1 1"),
    "cc0": ("creative commons zero", "cc0 1 0", "cc0"),
    "cc-by": ("creative commons attribution", "cc by"),
    "cc-by-sa": ("creative commons attribution sharealike", "cc by sa"),
    "cc-by-nd": ("creative commons attribution noderivatives", "cc by nd"),
    "cc-by-nc": ("creative commons attribution noncommercial", "cc by nc"),
    "cc-by-nc-sa": ("creative commons attribution noncommercial sharealike", "cc by nc sa"),
    "cc-by-nc-nd": ("creative commons attribution noncommercial noderivatives", "cc by nc nd"),
}
# Notice templates with their priority; {} is a license name.
TEMPLATES = (
    (90, "spdx license identifier {}"),
    (80, "licensed under the terms of the {}"),
    (80, "licensed under the {}"),
    (80, "licensed under {}"),
    (80, "licenced under {}"),
    (80, "released under the {}"),
    (80, "released under {}"),
    (80, "distributed under the {}"),
    (80, "available under the {}"),
    (80, "under the terms of the {}"),
    (70, "the {} license"),
    (60, "{} license"),
    (60, "license {}"),
)
# Signatures (label, priority, words): a word may be a small regex; at least one word of each is spelt out.
SIGNATURES = (
    ("mit", 85, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 84, "the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", 82, "the software is provided as is without warranty of any kind express or implied"),
    ("mit", 72, "mit licen[cs]ed?"),
    ("mit", 72, "(?:mit|expat) x11 licen[cs]e"),
    ("mit", 70, "opensource org licenses mit"),
    ("mit-0", 86, "mit no attribution"),
    ("bsd", 85, "redistribution and use in source and binary forms"),
    ("bsd", 80, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 80, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", 86, "neither the names? of ~12 nor the names of its contributors may be used to endorse"),
    ("bsd-3", 84, "names? of ~14 may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3", 80, "opensource org licenses bsd 3 clause"),
    ("bsd-2", 80, "opensource org licenses bsd 2 clause"),
    ("bsd-2", 76, "2 clause bsd licen[cs]e"),
    ("bsd-3", 76, "3 clause bsd licen[cs]e"),
    ("bsd-4", 76, "4 clause bsd licen[cs]e"),
    ("bsd-0", 80, "zero clause bsd"),
    ("bsd-0", 84, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
    ("bsd", 78, "use of this source code is governed by a bsd style licen[cs]e"),
    ("bsd", 74, "this software is provided by ~14 as is and any express or implied warranties"),
    ("bsd-protection", 84, "bsd protection license"),
    ("bsd-patent", 82, "bsd(?: 2 clause)? plus patent licen[cs]e"),
    ("clear-bsd", 84, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4", 86, "all advertising materials mentioning features or use of this software must display"),
    ("bsd", 70, "opensource org licenses bsd license"),
    ("bsd-3", 72, "bsd (?:new|modified|revised) licen[cs]e"),
    ("bsd-2", 72, "(?:freebsd|simplified) license"),
    ("isc", 85, "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", 72, "(?:isc|openbsd) license"),
    ("isc", 80, "opensource org licenses isc"),
    ("hpnd", 84, "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", 82, "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("x11", 84, "except as contained in this notice the names? of ~10 shall not be used in advertising"),
    ("ncsa", 82, "university of illinois ncsa open source licen[cs]e"),
    ("ncsa", 80, "opensource org licenses ncsa"),
    ("icu", 80, "icu license icu 1 8 1 and later"),
    ("unicode", 82, "unicode inc license agreement data files and software"),
    ("w3c", 82, "w3c software notice and license"),
    ("w3c", 80, "www w3 org consortium legal copyright software"),
    ("libpng", 82, "this code is released under the libpng license"),
    ("libtiff", 82, "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("ijg", 82, "this software is based in part on the work of the independent jpeg group"),
    ("freetype", 82, "freetype project license"),
    ("freetype", 80, "portions of this software are copyright ~6 the freetype project"),
    ("info-zip", 82, "info zip license"),
    ("bzip2", 80, "bzip2 and libbzip2 licen[cs]e"),
    ("vim", 80, "vim licen[cs]e"),
    ("tcl", 80, "tcl tk licen[cs]e"),
    ("tcl", 82, "this software is copyrighted by the regents of the university of california sun microsystems"),
    ("afl-3", 82, "academic free licen[cs]e (?:version |v ?)?3 0"),
    ("osl-3", 82, "open software licen[cs]e (?:version |v ?)?3 0"),
    ("ecl-2", 82, "educational community licen[cs]e(?: version)? 2 0"),
    ("upl", 82, "universal permissive licen[cs]e"),
    ("mulan-psl-2", 84, "mulan psl v2"),
    ("blueoak", 82, "blue oak model licen[cs]e"),
    ("cecill", 82, "cecill free software licen[cs]e"),
    ("cecill", 80, "cecill [abc] licen[cs]e"),
    ("qpl", 82, "q public licen[cs]e version 1 0"),
    ("apsl", 82, "apple public source licen[cs]e"),
    ("nposl", 80, "non profit open software licen[cs]e"),
    ("ncl-nasa", 80, "nasa open source agreement"),
    ("lppl", 84, "conditions of the latex project public license"),
    ("lppl", 80, "latex project org lppl"),
    ("intel-osl", 80, "intel open source licen[cs]e"),
    ("sleepycat", 82, "sleepycat (?:public )?licen[cs]e"),
    ("watcom", 80, "sybase open watcom public licen[cs]e"),
    ("rpl", 80, "reciprocal public licen[cs]e"),
    ("zpl", 80, "zope public licen[cs]e"),
    ("vsl", 80, "vovida software licen[cs]e"),
    ("apache-2", 88, "licensed under the apache license version 2 0 the license"),
    ("apache-2", 84, "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", 80, "www apache org licenses license 2 0"),
    ("apache-2", 80, "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-2", 72, "(?:asl|apache) (?:licen[cs]e )?v?2(?: 0)? licensed"),
    ("apache-1", 80, "this product includes software developed by the apache software foundation"),
    ("apache", 62, "apache software licen[cs]e"),
    ("apache-2", 84, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", 84, "the asf licenses this file to you under the apache license version 2 0"),
    ("apache-2", 88, "apache license version 2 0 january 2004"),
    ("apache-2", 82, "you may not use this file except in compliance with the license"),
    ("apache-2", 79, "without warranties or conditions of any kind either express or implied see the license for the specific language"),
    ("apache-2", 80, "opensource org licenses apache 2 0"),
    ("apache-2-llvm", 86, "apache license v?2 0 with llvm exceptions"),
    ("apache-1", 84, "the apache software license version 1 1"),
    ("apache-1", 80, "the names? apache ~6 must not be used to endorse or promote products derived from this software"),
    ("gpl", 85, "this program is free software you can redistribute it and or modify"),
    ("gpl", 84, "published by the free software foundation either version"),
    ("gpl-2", 87, "general public license ~12 either version 2 of the license"),
    ("gpl-3", 87, "general public license ~12 either version 3 of the license"),
    ("gpl-2", 84, "general public license version 2 only"),
    ("gpl", 79, "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 79, "see the gnu general public license for more details"),
    ("gpl", 77, "write to the free software foundation inc"),
    ("gpl-2", 86, "terms of version 2 of the gnu general public license"),
    ("gpl-3", 86, "terms of version 3 of the gnu general public license"),
    ("gpl-2", 83, "gnu general public license v2(?: 0)?"),
    ("gpl-3", 83, "gnu general public license v3(?: 0)?"),
    ("gpl-1", 87, "general public license ~12 either version 1 of the license"),
    ("gpl", 84, "gnu general public license preamble ~3 the licenses for most software"),
    ("gpl-2", 88, "gnu general public license version 2 june 1991"),
    ("gpl-3", 88, "gnu general public license version 3 29 june 2007"),
    ("gpl-1", 88, "gnu general public license version 1 february 1989"),
    ("gpl", 78, "distributed under the (?:terms of the )?gnu general public license"),
    ("gpl", 74, "(?:under|by) the gpl"),
    ("gpl-linking-exception", 87, "as a special exception the copyright holders of this library give you permission to link"),
    ("gpl-bison-exception", 87, "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-gcc-exception", 87, "gcc runtime library exception"),
    ("gpl-font-exception", 87, "this font does not by itself cause the resulting document to be covered by the gnu general public license"),
    ("gpl", 80, "you should have received a copy of the gnu general public license"),
    ("gpl", 76, "www gnu org licenses gpl"),
    ("gpl-2", 78, "gpl (?:v|version )?2(?: 0)? (?:only|or later)"),
    ("gpl-3", 78, "gpl (?:v|version )?3(?: 0)? (?:only|or later)"),
    ("gpl-classpath", 88, "linking this library statically or dynamically with other modules"),
    ("lgpl", 85, "this library is free software you can redistribute it and or modify"),
    ("lgpl", 80, "you should have received a copy of the gnu lesser general public license"),
    ("lgpl", 76, "www gnu org licenses lgpl"),
    ("lgpl-2", 87, "(?:lesser|library) general public license ~12 either version 2(?: 1)? of the license"),
    ("lgpl-3", 87, "lesser general public license ~12 either version 3 of the license"),
    ("lgpl", 80, "see the gnu (?:lesser|library) general public license for more details"),
    ("lgpl", 79, "this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl-2", 88, "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", 88, "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2", 83, "gnu (?:lesser|library) general public license v2(?: 1)?"),
    ("lgpl-3", 83, "gnu lesser general public license v3(?: 0)?"),
    ("agpl-3", 85, "gnu affero general public license as published by"),
    ("agpl-3", 76, "www gnu org licenses agpl"),
    ("agpl-3", 88, "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3", 80, "see the gnu affero general public license for more details"),
    ("agpl-3", 83, "gnu affero general public license v3(?: 0)?"),
    ("agpl-3", 76, "affero general public licen[cs]e"),
    ("fdl", 86, "with no invariant sections no front cover texts and no back cover texts"),
    ("fdl", 76, "www gnu org (?:licenses|copyleft) fdl"),
    ("fdl", 84, "copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("fdl", 72, "gnu (?:fdl|free documentation licen[cs]e)"),
    ("mpl-2", 88, "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2", 80, "mozilla org mpl 2 0"),
    ("mpl-2", 80, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2", 86, "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1", 80, "mozilla org mpl 1 1"),
    ("mpl-1", 80, "the original code is ~12 the initial developer of the original code"),
    ("mpl-1", 78, "alternatively the contents of this file may be used under the terms of either"),
    ("mpl-1", 84, "the contents of this file are subject to the mozilla public license"),
    ("epl-2", 84, "this program and the accompanying materials are made available under the terms of the eclipse public license v? ?2 0"),
    ("epl-1", 83, "this program and the accompanying materials are made available under the terms of the eclipse public license v? ?1 0"),
    ("epl", 70, "eclipse org legal epl"),
    ("epl-2", 80, "www eclipse org legal epl (?:2|v2)0?"),
    ("epl-1", 80, "www eclipse org legal epl v10"),
    ("edl", 80, "eclipse distribution license"),
    ("cpl", 80, "common public license (?:version |v ?)?1 0"),
    ("ipl", 80, "ibm public license (?:version |v ?)?1 0"),
    ("cddl", 84, "subject to the terms of the common development and distribution license"),
    ("cddl", 80, "opensource org licenses cddl"),
    ("cddl", 80, "glassfish (?:dev java net|java net) public cddl"),
    ("zlib", 85, "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("zlib", 80, "the origin of this software must not be misrepresented"),
    ("boost", 85, "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("boost", 76, "www boost org license 1 0"),
    ("unlicense", 85, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 78, "unlicense org"),
    ("wtfpl", 84, "you just do what the fuck you want to"),
    ("artistic-2", 80, "everyone is permitted to copy and distribute verbatim copies of this license document ~8 artistic"),
    ("perl", 78, "under the same terms as perl itself"),
    ("python", 80, "psf license agreement for python"),
    ("python", 72, "python software foundation licen[cs]e"),
    ("ruby", 72, "ruby(?: s)? license"),
    ("php", 78, "this source file is subject to version [0-9] [0-9]+ of the php license"),
    ("postgresql", 78, "postgresql licen[cs]e"),
    ("openssl", 78, "this product includes software developed by the openssl project"),
    ("curl", 74, "curl licen[cs]e"),
    ("json", 86, "the software shall be used for good not evil"),
    ("beerware", 80, "beer ware license"),
    ("ms-pl", 76, "microsoft public licen[cs]e"),
    ("ms-rl", 76, "microsoft reciprocal licen[cs]e"),
    ("eupl", 80, "licensed under the eupl version"),
    ("ofl", 84, "this font software is licensed under the sil open font license"),
    ("ofl", 76, "scripts sil org ofl"),
    ("ofl", 84, "sil open font license version 1 [01]"),
    ("ofl", 80, "with reserved font name"),
    ("ufl", 82, "ubuntu font licen[cs]e"),
    ("bitstream-vera", 82, "bitstream vera fonts copyright"),
    ("odbl", 78, "opendatacommons org licenses odbl"),
    ("odc-by", 78, "open data commons attribution"),
    ("cc0", 84, "to the extent possible under law ~12 waived all copyright"),
    ("cc0", 78, "creativecommons org publicdomain zero"),
    ("cc0", 84, "cc0 1 0 universal"),
    ("cc0", 80, "no rights reserved ~3 cc0"),
    ("cc-by", 80, "creative commons attribution [0-9] [0-9] (?:international|unported|generic)"),
    ("cc-by-sa", 81, "creative commons attribution sharealike [0-9] [0-9]"),
    ("cc-by-sa", 81, "creative commons attribution share alike"),
    ("cc-by-nd", 81, "creative commons attribution no ?derivat(?:ives|ive works)"),
    ("cc-by-nc-sa", 82, "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", 82, "creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("cc-pdm", 80, "creativecommons org publicdomain mark"),
    ("odbl", 82, "open data commons open database licen[cs]e"),
    ("pddl", 82, "public domain dedication and licen[cs]e"),
    ("cdla", 82, "community data license agreement"),
    ("ogl", 80, "open government licen[cs]e"),
    ("etalab", 80, "licence ouverte(?: open licence)?"),
    ("cc-by", 78, "creativecommons org licenses by [0-9]"),
    ("cc-by-sa", 79, "creativecommons org licenses by sa"),
    ("cc-by-nd", 79, "creativecommons org licenses by nd"),
    ("cc-by-nc", 79, "creativecommons org licenses by nc [0-9]"),
    ("cc-by-nc-sa", 80, "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", 80, "creativecommons org licenses by nc nd"),
    ("cc-by", 76, "this work is licensed under a creative commons attribution"),
    ("cc-by-nc", 77, "creative commons ~6 non ?commercial"),
    ("sspl", 82, "server side public licen[cs]e"),
    ("busl", 82, "business source licen[cs]e"),
    ("elastic", 80, "elastic license(?: v?2(?: 0)?)?"),
    ("commons-clause", 84, "commons clause license condition"),
    ("rail", 78, "open ?rail(?: m)? licen[cs]e"),
    ("llama", 76, "llama [0-9](?: [0-9])? community license"),
    ("public-domain", 75, "(?:dedicated|released|placed|given) (?:in)?to the public domain"),
    ("public-domain", 75, "in the public domain"),
    ("proprietary", 75, "all rights reserved"),
    ("proprietary", 76, "proprietary and confidential"),
    ("proprietary", 76, "unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
    ("proprietary", 75, "no part of this (?:publication|book|work|document) may be reproduced"),
    ("proprietary", 74, "(?:licensed|restricted) material(?:s)? property of"),
    ("proprietary", 74, "for internal use only"),
    ("evaluation", 74, "for evaluation purposes only"),
    ("non-commercial", 73, "(?:for|personal) non ?commercial use only"),
    ("copyright", 40, "copyright (?:c )?(?:19|20)[0-9]{2}"),
)


def _parts(words: str) -> list[str]:
    """The words of a rule; blanks within brackets do not part words."""
    return [w for w in re.split(r" (?![^()\[\]{}]*[)\]}])", words) if w]


def _spelt(words: str) -> frozenset[bytes]:
    """The words that a text must hold for the rule to match."""
    return frozenset(w.encode() for w in _parts(words) if w.isalnum())


def _phrase(words: str) -> bytes:
    """The rule's regex over bytes: words stand apart; a blank inside a word is a gap as well, and ``~n`` up to n words.

    A gap is any run of other characters, so phrases go on over line ends and comment marks.
    """
    out = EDGE_LEFT
    for k, w in enumerate(_parts(words)):
        if w[0] == "~":
            out += b"(?:" + GAP + WORD + b"){0," + w[1:].encode() + b"}?"
        else:
            out += (GAP if k else b"") + w.encode().replace(b" ?", b"(?:" + GAP + b")?").replace(b" ", GAP)
    return out + EDGE_RIGHT


@cache
def rules() -> tuple[tuple[int, str, frozenset[bytes], re.Pattern], ...]:
    """(priority, label, keywords, regex), highest priority first."""
    made = [(priority, label, words) for label, priority, words in SIGNATURES]
    for label, names in LICENSES.items():
        for priority, template in TEMPLATES:
            for name in dict.fromkeys(names):
                if template != "{} license" or name.split()[-1] != "license":
                    made.append((priority, label, template.format(name)))
    ordered = sorted(dict.fromkeys(made), key=lambda r: (-r[0], -len(r[2]), r))
    return tuple((p, label, _spelt(w), re.compile(_phrase(w))) for p, label, w in ordered)


@cache
def keywords() -> tuple[tuple[bytes, ...], tuple[bytes, ...]]:
    """Openers, one of which every rule needs (its longest word), and all words of all rules."""
    needed = [max(sorted(words), key=len) for _, _, words, _ in rules()]
    every = set().union(*[words for _, _, words, _ in rules()])
    return tuple(sorted(set(needed))), tuple(sorted(every))


def detect(text: bytes) -> list[tuple[int, int, int, str]]:
    """(start, end, priority, label) in bytes of a lower-cased text, after suppression.

    A detection inside another of the same or a higher priority goes; of equal ones the first by
    priority, then by label, stays.
    """
    openers, every = keywords()
    if not any(k in text for k in openers):
        return []
    present = {w for w in every if w in text}
    found = [
        (m.start(), m.end(), priority, label)
        for priority, label, needed, pattern in rules()
        if needed <= present
        for m in pattern.finditer(text)
    ]
    found.sort(key=lambda d: (d[0], -d[1], -d[2], d[3]))
    reach: dict[int, int] = {}  # by priority: the furthest end so far
    kept = []
    for d in found:
        if not any(p >= d[2] and end >= d[1] for p, end in reach.items()):
            kept.append(d)
        reach[d[2]] = max(reach.get(d[2], -1), d[1])
    return kept


_BASE = tuple((label, re.compile(_phrase(words)), max(words.encode().split(), key=len)) for words, label in BASE_PHRASES)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for _, _, data, offsets in slices(batch.column("text")):
            lower = LOWER[data]
            starts, _, first = word_bounds(lower, offsets, NOT_WORD)
            raw = lower.tobytes()
            counts = np.diff(first)
            for i in range(len(offsets) - 1):
                text = raw[offsets[i] : offsets[i + 1]]
                places, base = [], set()
                for label, pattern, keyword in _BASE:
                    if keyword in text:
                        at = [m.start() for m in pattern.finditer(text)]
                        if at:
                            base.add(label)
                            places += at
                detections = detect(text)
                labels = base | {d[3] for d in detections}
                positions = np.searchsorted(starts[first[i] : first[i + 1]] - offsets[i], [min(places), max(places)]) if places else (None, None)
                score = 1.0 if base else max([d[2] / 100 for d in detections], default=0.0)
                for column, value in zip(
                    columns,
                    (int(counts[i]), len(places), *[None if p is None else int(p) for p in positions], ",".join(sorted(base)), ",".join(sorted(labels)), score),
                ):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id")]
            + [pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),))],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )


def license_scan(documents: DataFrame) -> DataFrame:
    """Base places, labels and a score for every document."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"]).mapInArrow(_scan, schema)
