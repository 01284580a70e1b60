"""Signature rules for license scans, in order of their strength.

A signature is a row of words: `a|b` is either word, `w?` may be missing, `*3` is
up to three words of any kind. Rules of strength 1 are grants, notices and tags, of
2 names with a version, of 3 names, of 4 hints. Where one text gives many versions or
variants, rules are made from lists.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    strength: int
    signature: str
    base: bool = False  # its label stays whatever covers it


#: What a detection of each strength is worth.
WEIGHTS = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}

#: The phrases that always count (fixed by the contract).
BASE = [Rule("mit", 3, "mit license", True), Rule("apache", 3, "apache license", True), Rule("gpl", 3, "general public license", True)]

_GRANTS = """
mit: permission is hereby granted free of charge to any person obtaining a copy of this software
mit: the software is provided as is without warranty of any kind express or implied *4 merchantability
mit: licensed|released|distributed|available under the? terms? of? the mit license|licence
mit: licensed|released|distributed|available under the? mit license|licence
mit-0: permission is hereby granted free of charge *12 without restriction
x11: except as contained in this notice the name of the x consortium
bsd: redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause: redistributions in binary form must reproduce the above copyright notice
bsd-3-clause: neither the name of *8 nor the names of its contributors may be used to endorse
bsd-4-clause: all advertising materials mentioning features or use of this software must display
bsd: licensed|released|distributed under the? terms? of? the? *2 bsd license|licence
isc: permission to use copy modify and? or? distribute this software for any purpose with or without fee
0bsd: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
zlib: this software is provided as is without any express or implied warranty in no event will the authors
zlib: altered source versions must be plainly marked as such
bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense: this is free and unencumbered software released into the public domain
wtfpl: do what the *1 you want to public license
cc0-1.0: the person who associated a work with this deed has dedicated the work to the public domain
public-domain: placed|released|dedicated in|into|to the public domain
apache-2.0: licensed under the apache license version 2 0
apache-2.0: you may not use this file except in compliance with the license
apache-2.0: unless required by applicable law or agreed to in writing software distributed under the license
apache-1.1: this product includes software developed by the apache software foundation
mpl-2.0: this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1: the contents of this file are subject to the mozilla public license version 1 1
epl-1.0: made available under the terms of the eclipse public license v1 0
epl-2.0: made available under the terms of the eclipse public license v? 2 0
cddl-1.0: the contents of this file are subject to the terms of the common development and distribution license
artistic-2.0: this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0
perl: it under the same terms as perl itself
ruby: you may redistribute it and or modify it under the same terms as ruby
psf-2.0: python software foundation license version 2
ofl-1.1: this font software is licensed under the sil open font license version 1 1
ftl: portions of this software are copyright *6 the freetype project
openssl: this product includes software developed by the openssl project for use in the openssl toolkit
curl: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
w3c: permission to use copy modify and distribute this software and its documentation with or without modification
unicode: permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
ms-pl: this license governs use of the accompanying software if you use the software you accept this license
llama: use of the llama materials is governed by
rail: use based restrictions as referenced in
proprietary: all rights reserved no part of this *3 may be reproduced
proprietary: unauthorized copying of this file *3 is strictly prohibited
proprietary: this software is proprietary and confidential
proprietary: subject to the terms of the end user license agreement
"""

_NAMED = """
apache-1.0: apache *2 license version? v? 1 0
apache-1.1: apache *2 license version? v? 1 1
apache-2.0: apache *2 license|licence version? v? 2 0
apache-2.0: apache *2 license|licence version? v2
apache-2.0: apache 2 0 license|licence
apache-2.0: asl 2 0
bsd-2-clause: simplified bsd license|licence
bsd-2-clause: freebsd license|licence
bsd-2-clause: 2|two clause bsd license|licence
bsd-2-clause: bsd 2 clause
bsd-3-clause: new|revised|modified bsd license|licence
bsd-3-clause: 3|three clause bsd license|licence
bsd-3-clause: bsd 3 clause
bsd-4-clause: original bsd license|licence
bsd-4-clause: 4|four clause bsd license|licence
bsd-4-clause: bsd 4 clause
mpl-1.0: mozilla public license|licence version? v? 1 0
mpl-1.1: mozilla public license|licence version? v? 1 1
mpl-2.0: mozilla public license|licence version? v? 2 0
mpl-2.0: mpl v? 2 0
epl-1.0: eclipse public license|licence version? v? 1 0
epl-2.0: eclipse public license|licence version? v? 2 0
cddl-1.0: common development and distribution license version? v? 1 0
cddl-1.1: common development and distribution license version? v? 1 1
cpl-1.0: common public license version? v? 1 0
artistic-1.0: artistic license|licence version? v? 1 0
artistic-2.0: artistic license|licence version? v? 2 0
bsl-1.0: boost software license version? v? 1 0
afl-3.0: academic free license version? v? 3 0
osl-3.0: open software license version? v? 3 0
eupl-1.1: european union public license|licence version? v? 1 1
eupl-1.2: european union public license|licence version? v? 1 2
ofl-1.0: open font license version? v? 1 0
ofl-1.1: open font license version? v? 1 1
php-3.01: php license version? v? 3 01
zpl-2.1: zope public license version? v? 2 1
lppl-1.3c: latex project public license version? v? 1 3c?
cecill-2.1: cecill free software license agreement version? v? 2 1
odbl-1.0: open data commons open database license version? v? 1 0
odc-by-1.0: open data commons attribution license version? v? 1 0
pddl-1.0: open data commons public domain dedication and license version? v? 1 0
busl-1.1: business source license version? v? 1 1
sspl-1.0: server side public license version? v? 1 0?
elastic-2.0: elastic license version? v? 2 0
gpl-2.0-classpath: gpl version? v? 2 0? with the? classpath exception
"""

_NAMES = """
mit: mit licensed
mit: mit licenced
mit: mit licence
mit: expat license|licence
mit: license|licence mit
apache: apache software license|licence
apache: apache licensed|licence
bsd: bsd license|licence
bsd: bsd style license|licence
bsd: berkeley software distribution license|licence
mpl: mozilla public license|licence
epl: eclipse public license|licence
cddl: common development and distribution license|licence
cpl: common public license
ipl: ibm public license
qpl: q public license
npl: netscape public license
spl: sun public license
artistic: artistic license|licence
isc: isc license|licence
zlib: zlib license|licence
zlib: zlib libpng license|licence
libpng: libpng license|licence
bsl: boost software license|licence
unlicense: the unlicense
wtfpl: wtfpl
afl: academic free license|licence
osl: open software license|licence
eupl: european union public license|licence
ofl: open font license|licence
psf: python software foundation license
psf: python license
php: php license|licence
ruby: ruby license|licence
zpl: zope public license
lppl: latex project public license
cecill: cecill license|licence
w3c: w3c software notice and license
icu: icu license|licence
x11: x11 license|licence
ncsa: university of illinois ncsa open source license
sleepycat: sleepycat license|licence
openssl: openssl license|licence
openldap: openldap public license
curl: curl license|licence
postgresql: postgresql license|licence
vim: vim license|licence
jpeg: independent jpeg group license
bitstream-vera: bitstream vera font|fonts copyright
ms-pl: microsoft public license
ms-rl: microsoft reciprocal license
apsl: apple public source license
nasa: nasa open source agreement
odbl: open database license
odc-by: open data commons attribution license
pddl: public domain dedication and license
sspl: server side public license
busl: business source license
elastic: elastic license
polyform: polyform noncommercial|strict|shield|perimeter license
commons-clause: commons clause license condition
json: the software shall be used for good not evil
beerware: beer ware license
cc: creative commons license|licence
rail: responsible ai license|licence
openrail: openrail m? license|licence
llama: llama *2 community license agreement
gemma: gemma terms of use
gfdl: free documentation license
lgpl: lesser general public license
lgpl: library general public license
agpl: affero general public license
public-domain: public domain
"""

_HINTS = """
license: licensed under
license: released under
license: distributed under the terms
license: subject to the license
license: license agreement
license: terms and conditions of the license
license: see the license file
license: license file for details
license: full license text
license: see copying
license: dual licensed
license: sublicense
copyright: all rights reserved
copyright: above copyright notice
copyright: copyright holder|holders
free-use: free of charge
free-use: royalty free
no-warranty: without warranty of any kind
no-warranty: without any warranty
"""

#: Short names of licenses as tags give them.
_TAGS = """
MIT MIT-0 X11 ISC 0BSD BSD-2-Clause BSD-3-Clause BSD-4-Clause Apache-1.0 Apache-1.1 Apache-2.0 MPL-1.0 MPL-1.1 MPL-2.0
EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 CPL-1.0 IPL-1.0 Artistic-1.0 Artistic-2.0 BSL-1.0 Zlib Libpng Unlicense WTFPL AFL-3.0
OSL-3.0 EUPL-1.1 EUPL-1.2 OFL-1.0 OFL-1.1 PSF-2.0 PHP-3.01 Ruby ZPL-2.1 LPPL-1.3c CECILL-2.1 W3C ICU NCSA Sleepycat
OpenSSL curl PostgreSQL Vim IJG MS-PL MS-RL APSL-2.0 NASA-1.3 ODbL-1.0 ODC-By-1.0 PDDL-1.0 SSPL-1.0 BUSL-1.1
Elastic-2.0 CC0-1.0 JSON Beerware HPND NTP Unicode-DFS-2016 UPL-1.0 BlueOak-1.0.0 MulanPSL-2.0 Python-2.0
"""

#: The family's short name, its words, and its versions.
_GNU = [
    ("gpl", "general public", ["1 0", "2 0", "3 0"]), ("lgpl", "lesser|library general public", ["2 0", "2 1", "3 0"]),
    ("agpl", "affero general public", ["1 0", "3 0"]), ("gfdl", "free documentation", ["1 1", "1 2", "1 3"]),
]
_CC = {
    "by": "attribution", "by-sa": "attribution share? alike|sharealike", "by-nd": "attribution no? derivs|derivatives|noderivs|noderivatives",
    "by-nc": "attribution non? commercial|noncommercial", "by-nc-sa": "attribution non? commercial|noncommercial share? alike|sharealike",
    "by-nc-nd": "attribution non? commercial|noncommercial no? derivs|derivatives|noderivs|noderivatives",
}
_CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]


def _lines(text: str, strength: int) -> list[Rule]:
    found = [Rule(*(label.strip(), strength, signature.strip())) for label, signature in (x.split(":", 1) for x in text.strip().splitlines())]
    return [spelt for rule in found for spelt in _spelt(rule)]


def _spelt(rule: Rule) -> list[Rule]:
    """A rule for each spelling of the word that most rules have, so that it can be their keyword."""
    if "license|licence" not in rule.signature:
        return [rule]
    return [rule._replace(signature=rule.signature.replace("license|licence", word)) for word in ("license", "licence")]


def _gnu() -> list[Rule]:
    out = []
    for name, words, versions in _GNU:
        for v in versions:
            label, (major, minor) = f"{name}-{v.replace(' ', '.')}", v.split()
            number = f"{major} 0?" if minor == "0" else v
            out += [
                Rule(f"{label}-or-later", 1, f"terms of the gnu {words} license *8 version {number} *4 or *4 any later version"),
                Rule(f"{label}-or-later", 1, f"spdx license identifier {name} {v} or later"), Rule(f"{label}-only", 1, f"spdx license identifier {name} {v} only"),
                Rule(label, 1, f"spdx license identifier {name} {v}"), Rule(label, 2, f"gnu? {words} license|licence version? v? {number}"),
                Rule(f"{label}-or-later", 2, f"gnu? {words} license|licence version? v? {number} or *2 later"),
                Rule(label, 2, f"{name} version? v? {number}"), Rule(label, 2, f"{name}? {name}v{major}" if minor == "0" else f"{name}v{major} {minor}"),
            ]
        out += [Rule(name, 3, f"gnu {words} license|licence"), Rule(name, 4, name)]
    return out


def _cc() -> list[Rule]:
    out = []
    for kind, words in _CC.items():
        short = kind.replace("-", " ")
        for v in _CC_VERSIONS:
            label = f"cc-{kind}-{v.replace(' ', '.')}"
            out += [
                Rule(label, 1, f"spdx license identifier cc {short} {v}"), Rule(label, 2, f"cc {short} {v}"),
                Rule(label, 2, f"creative commons {words} {v} *2 license|licence"), Rule(label, 1, f"creativecommons org licenses {short} {v}"),
            ]
        out += [Rule(f"cc-{kind}", 3, f"cc {short}"), Rule(f"cc-{kind}", 3, f"creative commons {words}")]
    return [*out, Rule("cc0-1.0", 2, "cc0 1? 0?"), Rule("cc0-1.0", 1, "creativecommons org publicdomain zero 1 0")]


def _tagged() -> list[Rule]:
    return [Rule(tag.lower(), 1, "spdx license identifier " + " ".join(re.findall("[0-9a-z]+", tag.lower()))) for tag in _TAGS.split()]


def standard_rules() -> list[Rule]:
    """All rules, the base phrases first."""
    parts = [(_GRANTS, 1), (_NAMED, 2), (_NAMES, 3), (_HINTS, 4)]
    made = (x for r in [*_tagged(), *_gnu(), *_cc()] for x in _spelt(r))
    return [*BASE, *(r for text, k in parts for r in _lines(text, k)), *made]


def compiled(signature: str) -> str:
    """The signature as a regular expression over texts whose words each have a space before and one behind."""
    out = []
    for token in signature.split():
        if token[0] == "*":
            out.append(f"(?: [^ ]+ ){{0,{int(token[1:])}}}?")
        else:
            word = token.removesuffix("?")
            out.append(f" (?:{word}) " if token == word and "|" in word else f"(?: (?:{word}) )?" if token != word else f" {word} ")
    return "".join(out)


#: Words that many texts have, in some language: the last choice for a keyword.
_PLAIN = set(
    "01 2016 a above an and any apple as authors available beer by code data details dual files for form free full if in is it itself kind later mit nc "
    "nd no non of only open or pl program public purpose rl sa see shall software style sun that the this to under use user v1 v2 version versions "
    "want what with without written you".split()
)


def sure_words(signature: str) -> list[str]:
    """The words that every match has."""
    return [t for t in signature.split() if re.fullmatch("[0-9a-z]+", t)]


def keywords(rules: list[Rule]) -> list[str]:
    """For each rule, of the words that every match has, the one that the fewest rules need; of these the longest."""
    needed = Counter(w for r in rules for w in set(sure_words(r.signature)))

    def best(signature: str) -> str:
        sure = sure_words(signature)
        return min([w for w in sure if len(w) > 1 and w not in _PLAIN] or sure, key=lambda w: (needed[w], -len(w), w))

    return [best(r.signature) for r in rules]


def longest(signature: str) -> int:
    """Words that a match has at most."""
    return sum(int(t[1:]) if t[0] == "*" else 1 for t in signature.split())
