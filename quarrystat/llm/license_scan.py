"""License scans with ordered signature rules.

Signatures are regular expressions: hand-written sentences of licence texts, file headers and warranties, and forms built by
rule from families: their names, SPDX ids, addresses and grants. Each signature has keywords; an automaton over all keywords reads a text once, and only signatures whose
keywords all occur are run. Detections are taken by priority, then by length and place; one that lies inside the interval
of a detection already taken is suppressed. Base phrases (runs of words) are counted apart and their labels always stay.

Defined results: null text is empty; a text without words has null first and last word; repeated rows each get a result;
a very long text is read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.texthash import LOWER, worker_cache

SEP = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]"

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Families as label: (names, SPDX forms, addresses). Names are lower case; a space is any run of separators.
FAMILIES = {
    "apache": (["apache license", "apache software license"], ["apache-1.0", "apache-1.1", "apache-2.0"], ["apache.org/licenses"]),
    "mit": (["mit license", "expat license", "x11 license"], ["mit", "mit-0", "x11"], ["opensource.org/licenses/mit"]),
    "bsd": (["bsd license", "new bsd license", "simplified bsd license", "3-clause bsd license", "2-clause bsd license"], ["bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd"], ["opensource.org/licenses/bsd"]),
    "gpl": (["gnu gpl", "gnu general public license"], ["gpl-1.0", "gpl-2.0", "gpl-3.0"], ["gnu.org/licenses/gpl"]),
    "lgpl": (["gnu lgpl", "lesser general public license", "library general public license"], ["lgpl-2.0", "lgpl-2.1", "lgpl-3.0"], ["gnu.org/licenses/lgpl"]),
    "agpl": (["gnu agpl", "affero general public license"], ["agpl-1.0", "agpl-3.0"], ["gnu.org/licenses/agpl"]),
    "gfdl": (["gnu free documentation license"], ["gfdl-1.1", "gfdl-1.2", "gfdl-1.3"], ["gnu.org/licenses/fdl"]),
    "mpl": (["mozilla public license"], ["mpl-1.0", "mpl-1.1", "mpl-2.0"], ["mozilla.org/mpl"]),
    "epl": (["eclipse public license"], ["epl-1.0", "epl-2.0"], ["eclipse.org/legal/epl"]),
    "cddl": (["common development and distribution license"], ["cddl-1.0", "cddl-1.1"], ["opensource.org/licenses/cddl"]),
    "cpl": (["common public license"], ["cpl-1.0"], ["opensource.org/licenses/cpl"]),
    "ipl": (["ibm public license"], ["ipl-1.0"], []),
    "eupl": (["european union public licence", "european union public license"], ["eupl-1.0", "eupl-1.1", "eupl-1.2"], ["joinup.ec.europa.eu/collection/eupl"]),
    "cc-by": (["creative commons attribution"], ["cc-by-1.0", "cc-by-2.0", "cc-by-2.5", "cc-by-3.0", "cc-by-4.0"], ["creativecommons.org/licenses/by/"]),
    "cc-by-sa": (["creative commons attribution-sharealike"], ["cc-by-sa-2.0", "cc-by-sa-3.0", "cc-by-sa-4.0"], ["creativecommons.org/licenses/by-sa/"]),
    "cc-by-nc": (["creative commons attribution-noncommercial"], ["cc-by-nc-2.0", "cc-by-nc-3.0", "cc-by-nc-4.0"], ["creativecommons.org/licenses/by-nc/"]),
    "cc-by-nd": (["creative commons attribution-noderivatives"], ["cc-by-nd-3.0", "cc-by-nd-4.0"], ["creativecommons.org/licenses/by-nd/"]),
    "cc-by-nc-sa": (["creative commons attribution-noncommercial-sharealike"], ["cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0"], ["creativecommons.org/licenses/by-nc-sa/"]),
    "cc-by-nc-nd": (["creative commons attribution-noncommercial-noderivatives"], ["cc-by-nc-nd-3.0", "cc-by-nc-nd-4.0"], ["creativecommons.org/licenses/by-nc-nd/"]),
    "cc0": (["cc0 public domain dedication", "creative commons zero"], ["cc0-1.0"], ["creativecommons.org/publicdomain/zero"]),
    "public-domain": (["released into the public domain", "dedicated to the public domain", "public domain mark"], ["pddl-1.0"], ["creativecommons.org/publicdomain/mark"]),
    "unlicense": (["the unlicense"], ["unlicense"], ["unlicense.org"]),
    "isc": (["isc license"], ["isc"], ["opensource.org/licenses/isc"]),
    "zlib": (["zlib license", "zlib/libpng license"], ["zlib", "libpng"], ["opensource.org/licenses/zlib"]),
    "boost": (["boost software license"], ["bsl-1.0"], ["boost.org/license"]),
    "python": (["python software foundation license"], ["psf-2.0", "python-2.0"], ["docs.python.org/license"]),
    "artistic": (["artistic license"], ["artistic-1.0", "artistic-2.0"], ["opensource.org/licenses/artistic"]),
    "ofl": (["sil open font license", "open font license"], ["ofl-1.0", "ofl-1.1"], ["scripts.sil.org/ofl"]),
    "wtfpl": (["do what the fuck you want to public license"], ["wtfpl"], ["wtfpl.net"]),
    "php": (["php license"], ["php-3.0", "php-3.01"], ["php.net/license"]),
    "ruby": (["ruby license"], ["ruby"], []),
    "openssl": (["openssl license"], ["openssl"], []),
    "postgresql": (["postgresql license"], ["postgresql"], []),
    "ncsa": (["university of illinois/ncsa open source license"], ["ncsa"], []),
    "ms-pl": (["microsoft public license"], ["ms-pl"], []),
    "ms-rl": (["microsoft reciprocal license"], ["ms-rl"], []),
    "osl": (["open software license"], ["osl-1.0", "osl-2.1", "osl-3.0"], []),
    "afl": (["academic free license"], ["afl-1.2", "afl-2.1", "afl-3.0"], []),
    "odbl": (["open database license"], ["odbl-1.0"], ["opendatacommons.org/licenses/odbl"]),
    "odc-by": (["open data commons attribution license"], ["odc-by-1.0"], ["opendatacommons.org/licenses/by"]),
    "ogl": (["open government licence"], ["ogl-uk-1.0", "ogl-uk-2.0", "ogl-uk-3.0"], ["nationalarchives.gov.uk/doc/open-government-licence"]),
    "cecill": (["cecill license", "cecill free software license"], ["cecill-2.0", "cecill-2.1", "cecill-b", "cecill-c"], ["cecill.info"]),
    "sspl": (["server side public license"], ["sspl-1.0"], []),
    "busl": (["business source license"], ["busl-1.1"], []),
    "elastic": (["elastic license"], ["elastic-2.0"], []),
    "openrail": (["openrail license", "responsible ai license"], ["openrail"], []),
    "proprietary": (["proprietary and confidential", "unauthorized copying of this file"], ["licenseref-proprietary"], []),
}

#: What stands before a name that is granted, with a word that tells of it.
GRANTS = {
    "under": rf"(?:licensed|released|distributed|available|provided|published|redistributed|offered|covered){SEP}+under(?:{SEP}+the{SEP}+terms{SEP}+(?:and{SEP}+conditions{SEP}+)?of)?",
    "terms": rf"(?:under|by|to){SEP}+the{SEP}+(?:terms|provisions){SEP}+(?:and{SEP}+conditions{SEP}+)?of",
    "subject": rf"subject{SEP}+to",
}

#: Short names of Creative Commons licences by their terms, and of GNU licences.
CC_TERMS = {"cc-by": "by", "cc-by-sa": "by sa", "cc-by-nc": "by nc", "cc-by-nd": "by nd", "cc-by-nc-sa": "by nc sa", "cc-by-nc-nd": "by nc nd"}
GNU = {"gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl"}

#: Sentences of licence texts and file headers that stand without a name, with their labels and keywords.
BODIES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software", ("hereby", "person", "deal")),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software", ("hereby", "person", "deal")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission", "substantial")),
    ("ofl", "permission is hereby granted free of charge to any person obtaining a copy of the font software", ("hereby", "font")),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", ("hereby", "organization")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("purpose", "distribute")),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", ("purpose", "distribute")),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ("purpose", "agreement")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution", "binary")),
    ("bsd", "redistributions of source code must retain the above copyright notice", ("redistributions", "retain")),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", ("redistributions", "reproduce")),
    ("apache", "you may not use this file except in compliance with the license", ("compliance", "except")),
    ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", ("contributor", "irrevocable")),
    ("mpl", "this source code form is subject to the terms of the mozilla public", ("source", "mozilla")),
    ("mpl", "covered software is provided under this license on an as is basis", ("covered", "basis")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("redistribute", "gnu")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu", ("redistribute", "library")),
    ("agpl", "you must prominently offer all users interacting with it remotely through a computer network", ("prominently", "remotely")),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse", ("accompanying", "eclipse")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("warranty", "liable")),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("altered", "misrepresented")),
    ("wtfpl", "you just do what the fuck you want to", ("fuck",)),
    ("python", "psf hereby grants licensee a nonexclusive", ("psf", "licensee")),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", ("intent", "package")),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", ("deed", "dedicated")),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service", ("hosted", "managed")),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", ("licensor", "derivative")),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("merchantability", "noninfringement")),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", ("holders", "liable")),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", ("contributors", "implied")),
    ("bsd", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages", ("exemplary", "contributors")),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ("endorse", "promote")),
    ("bsd", "all advertising materials mentioning features or use of this software must display the following acknowledgement", ("advertising", "acknowledgement")),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", ("disclaims", "warranties")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that", ("purpose", "provided")),
    ("apache", "licensed to the apache software foundation asf under one or more contributor license agreements", ("apache", "agreements")),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("applicable", "basis")),
    ("apache", "see the license for the specific language governing permissions and limitations under the license", ("governing", "limitations")),
    ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license", ("contributor", "patent")),
    ("apache", "you must cause any modified files to carry prominent notices stating that you changed the files", ("prominent", "notices")),
    ("apache", "this product includes software developed by the apache software foundation", ("developed", "foundation")),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability", ("hope", "merchantability")),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ("received", "gnu")),
    ("gpl", "you may convey verbatim copies of the program s source code as you receive it", ("convey", "verbatim")),
    ("gpl", "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program", ("publish", "derived")),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", ("verbatim", "everyone")),
    ("gpl", "a work that contains portions of the program and is a derivative is licensed as a whole at no charge to all third parties", ("portions", "parties")),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty", ("hope", "library")),
    ("lgpl", "a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it", ("derivative", "linked")),
    ("lgpl", "you may convey a combined work under terms of your choice", ("convey", "combined")),
    ("agpl", "notwithstanding any other provision of this license if you modify the program your modified version must prominently offer all users", ("notwithstanding", "prominently")),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", ("mpl", "obtain")),
    ("mpl", "the contents of this file are subject to the mozilla public license", ("contents", "mozilla")),
    ("mpl", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language", ("kind", "language")),
    ("epl", "each contributor hereby grants recipient a non exclusive worldwide royalty free copyright license", ("contributor", "recipient")),
    ("epl", "a contributor may choose to distribute the program in object code form under its own license agreement", ("contributor", "object")),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ("contents", "development")),
    ("cddl", "when distributing covered code include this cddl header notice in each file", ("cddl", "header")),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("anyone", "freely")),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ("origin", "misrepresented")),
    ("boost", "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies", ("entire", "disclaimer")),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", ("compile", "anyone")),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain", ("jurisdictions", "dedicate")),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ("extent", "neighboring")),
    ("cc0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives", ("affirmer", "waives")),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format", ("redistribute", "medium")),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made", ("appropriate", "indicate")),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original", ("remix", "contributions")),
    ("cc-by-nc", "you may not use the material for commercial purposes", ("material", "commercial")),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", ("remix", "modified")),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("document", "gnu")),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", ("invariant", "cover")),
    ("ofl", "the fonts including any derivative works can be bundled embedded redistributed and or sold with any software provided that any reserved names are not used", ("fonts", "reserved")),
    ("ofl", "no modified version of the font software may use the reserved font name", ("font", "reserved")),
    ("python", "subject to the terms and conditions of this license agreement psf hereby grants", ("psf", "conditions")),
    ("artistic", "you may make and give away verbatim copies of the source form of the standard version of this package", ("verbatim", "package")),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", ("openssl", "toolkit")),
    ("php", "this product includes php software freely available from", ("php", "freely")),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices", ("verbatim", "duplicate")),
    ("ms-pl", "each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution prepare derivative works of its contribution", ("contributor", "prepare")),
    ("ms-rl", "for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file", ("recipients", "binary")),
    ("odbl", "you are free to share to copy distribute and use the database", ("share", "database")),
    ("odbl", "you must attribute any public use of the database or works produced from the database", ("attribute", "database")),
    ("ogl", "you must acknowledge the source of the information in your product or application by including or linking to any attribution statement", ("acknowledge", "attribution")),
    ("eupl", "the licensor grants you a worldwide royalty free non exclusive sublicensable licence", ("licensor", "sublicensable")),
    ("cecill", "the purpose of this free software license agreement is to grant users the right to modify and redistribute the software governed by this license", ("governed", "grant")),
    ("sspl", "if you make the functionality of the program or a modified version available to third parties as a service", ("functionality", "service")),
    ("busl", "the additional use grant and the change date", ("additional", "change")),
    ("elastic", "you may not move change disable or circumvent the license key functionality in the software", ("circumvent", "functionality")),
    ("openrail", "you agree not to use the model or derivatives of the model for the specified restricted uses", ("derivatives", "restricted")),
    ("osl", "licensor hereby grants you a worldwide royalty free non exclusive sublicensable license for the duration of the copyright", ("licensor", "duration")),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", ("verbatim", "everyone")),
    ("proprietary", "this software is the confidential and proprietary information of", ("confidential", "proprietary")),
    ("proprietary", "no part of this publication may be reproduced stored in a retrieval system or transmitted in any form or by any means", ("retrieval", "reproduced")),
    ("proprietary", "any unauthorized copying distribution or use of this material is strictly prohibited", ("unauthorized", "prohibited")),
    ("proprietary", "reproduction in whole or in part without written permission is prohibited", ("reproduction", "prohibited")),
    ("public-domain", "this file is in the public domain and comes with no warranty", ("domain", "warranty")),
    ("public-domain", "the author hereby disclaims copyright to this source code", ("disclaims", "author")),
    ("public-domain", "this work is a work of the united states government and is not subject to copyright protection", ("states", "protection")),
]

NOT_BEFORE, NOT_AFTER = r"(?<![0-9a-z\x80-\xff])", r"(?![0-9a-z\x80-\xff])"


def _words(phrase: str) -> str:
    return rf"{SEP}+".join(re.escape(w) for w in re.findall(r"[0-9a-z]+", phrase))


def signatures() -> list[tuple[int, str, float, tuple[str, ...], str]]:
    """(priority, label, confidence, keywords that must all occur, pattern over lower-case bytes), in rule order."""
    out = []
    for label, (names, spdx, addresses) in FAMILIES.items():
        for s in spdx:
            out.append((100, label, 1.0, ("spdx",), rf"spdx{SEP}+license{SEP}+identifier{SEP}+{_words(s)}(?:{SEP}(?:only|or{SEP}later))?"))
            word, ending = max(re.findall(r"[0-9a-z]+", s), key=len), rf"(?:\+|{SEP}+(?:only|or{SEP}later))?"
            bare = _words(s) + ending
            out.append((75, label, 0.85, ("licen", word), rf"licen[sc]es?{SEP}{{0,3}}[:=]{SEP}{{0,3}}{bare}"))
            out.append((75, label, 0.85, ("licen", word), rf"{bare}{SEP}+licen[sc]ed?"))
            for key, g in GRANTS.items():
                out.append((75, label, 0.85, (key, word), rf"{g}{SEP}+(?:the{SEP}+|an?{SEP}+)?{bare}"))
        for a in addresses:
            out.append((90, label, 0.95, (a,), re.escape(a) + r"[0-9a-z./_-]*"))
        for n in names:
            word = max(re.findall(r"[0-9a-z]+", n), key=len)
            version = rf"(?:{SEP}+(?:version|v){SEP}*[0-9]+(?:\.[0-9]+)*)?"
            for key, g in GRANTS.items():
                out.append((80, label, 0.9, (key, word), rf"{g}{SEP}+(?:the{SEP}+|an?{SEP}+)?{_words(n)}{version}"))
            out.append((60, label, 0.7, (word,), rf"{_words(n)}{version}"))
    for label, terms in CC_TERMS.items():
        version = rf"(?:{SEP}+(?:version{SEP}*|v)?[1-4]\.[0-9])?"
        long = _words(terms).replace("sa", f"(?:sa|share{SEP}?alike)").replace("nc", f"(?:nc|non{SEP}?commercial)").replace("nd", f"(?:nd|no{SEP}?deriv(?:ative)?s?)")
        out.append((70, label, 0.8, ("cc",), rf"cc{SEP}+{long}{version}"))
        out.append((70, label, 0.8, ("commons",), rf"creative{SEP}+commons{SEP}+(?:by|attribution){long[2:]}{version}"))
    for label, name in GNU.items():
        out.append((70, label, 0.8, (name,), rf"(?:gnu{SEP}+)?{name}{SEP}*v[1-3](?:\.[0-9])?\+?"))
    for label, sentence, keys in BODIES:
        out.append((85, label, 0.9, keys, _words(sentence)))
    out.append((50, "copyright", 0.5, ("copyright",), rf"copyright{SEP}*(?:\(c\)|\xc2\xa9)?{SEP}*(?:19|20)[0-9][0-9]"))
    out.append((50, "copyright", 0.5, ("rights reserved",), rf"some{SEP}+rights{SEP}+reserved"))
    return out


@cache
def rules() -> tuple[list, dict[bytes, list[int]]]:
    """Compiled signatures by place, and for each keyword the signatures that ask for it."""
    found, asked = [], {}
    for i, (priority, label, sure, keys, pattern) in enumerate(signatures()):
        found.append((priority, label, sure, len(set(keys)), f"{NOT_BEFORE}(?:{pattern}){NOT_AFTER}"))
        for k in set(keys):
            asked.setdefault(k, []).append(i)
    return found, asked


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.rules, asked = rules()
        self.compiled: dict[int, re.Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        for k, ids in asked.items():
            self.automaton.add_word(k, (k, ids))
        self.automaton.make_automaton()
        self.keywords = [(k.encode(), ids) for k, ids in asked.items()]
        self.base = [(re.compile(f"{NOT_BEFORE}{_words(p)}{NOT_AFTER}".encode("latin-1")), label, max(p.split(), key=len).encode() if p != "cc by" else b"cc") for p, label in PHRASES.items()]

    def _pattern(self, i: int) -> re.Pattern:
        if i not in self.compiled:
            self.compiled[i] = re.compile(self.rules[i][4].encode("latin-1"))
        return self.compiled[i]

    def detect(self, low: bytes) -> list[tuple[int, int, str, float]]:
        """Detections (start, end, label, confidence) by place, none inside another."""
        met: dict[int, int] = {}
        for key, ids in {v[0]: v[1] for _, v in self.automaton.iter(low.decode("latin-1"))}.items():
            for i in ids:
                met[i] = met.get(i, 0) + 1
        hits = []
        for i, n in met.items():
            priority, label, sure, keys, _ = self.rules[i]
            if n == keys:
                hits += [(-priority, m.start() - m.end(), m.start(), m.end(), label, sure) for m in self._pattern(i).finditer(low)]
        # the widest intervals taken so far, by start and so by end as well: one look tells whether another holds a hit
        kept: list[tuple[int, int, str, float]] = []
        starts: list[int] = []
        ends: list[int] = []
        for _, _, a, b, label, sure in sorted(hits):
            i = bisect_right(starts, a)
            if i and ends[i - 1] >= b:
                continue
            kept.append((a, b, label, sure))
            lo, hi = bisect_left(starts, a), bisect_right(ends, b)
            starts[lo : max(lo, hi)], ends[lo : max(lo, hi)] = [a], [b]
        return sorted(kept)

    def base_places(self, low: bytes) -> list[tuple[int, str]]:
        out = []
        for pattern, label, word in self.base:
            if word in low:
                out += [(m.start(), label) for m in pattern.finditer(low)]
        return sorted(out)


def scanner() -> Scanner:
    cache_ = worker_cache()
    if "licenses" not in cache_:
        cache_["licenses"] = Scanner()
    return cache_["licenses"]


WORD = np.array([not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])


def scan_text(text: str | None) -> dict:
    """Words, base places and detections of one text."""
    low = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    word = WORD[np.frombuffer(low, dtype=np.uint8)]
    starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1]))) if len(word) else np.zeros(0, dtype=np.int64)
    s = scanner()
    base, found = s.base_places(low), s.detect(low)
    at = np.searchsorted(starts, [a for a, _ in base]).tolist()
    labels = sorted({x for _, x in base})
    return {
        "n_words": len(starts),
        "n_base": len(base),
        "first_word": min(at, default=None),
        "last_word": max(at, default=None),
        "base_labels": ",".join(labels),
        "labels": ",".join(sorted({*labels, *(x for _, _, x, _ in found)})),
        "score": max([0.8 if base else 0.0, *(x for *_, x in found)]),
        "detections": [{"start": a, "end": b, "label": x} for a, b, x, _ in found],
    }


FIELDS = [("n_words", "long", pa.int64()), ("n_base", "long", pa.int64()), ("first_word", "long", pa.int64()), ("last_word", "long", pa.int64()), ("base_labels", "string", pa.string()), ("labels", "string", pa.string()), ("score", "double", pa.float64()), ("detections", "array<struct<start:long,end:long,label:string>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])))]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan_text(t) for t in batch.column(1).to_pylist()]
        columns = [pa.array([r[name] for r in rows], kind) for name, _, kind in FIELDS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *[f[0] for f in FIELDS]])


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document, with detections as byte intervals of the UTF-8 text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_scan, "doc_id long, " + ", ".join(f"{n} {t}" for n, t, _ in FIELDS))


def digest(docs: DataFrame) -> DataFrame:
    """The operator's contract."""
    return scan(docs).drop("detections")
