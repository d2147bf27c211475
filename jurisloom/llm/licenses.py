"""License scans by ordered signature rules.

A text becomes its words (A-Z in lower case, runs of ASCII letters, ASCII digits
and characters beyond ASCII) joined by single spaces, so a rule is a regular
expression over words and places are word numbers.  Each rule names a keyword
phrase that it can't match without; one automaton finds all keywords in one
pass and only their rules run.  A detection is dropped when one of a higher
priority, or a longer one of the same, covers its words; among equal ones the
earlier rule stays.  Base rules are never dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, extended, map_arrow, slices


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str
    base: bool = False


#: Phrases that are always reported.
BASE = (
    Rule("gpl", 30, "gnu general public license", "gnu general public license", True),
    Rule("apache", 30, "apache license", "apache license", True),
    Rule("cc-by", 30, "cc by", "cc by", True),
    Rule("mit", 30, "mit license", "mit license", True),
)

# label | keyword | name of the licence as a pattern over words | words of its short identifier
NAMES = r"""
gpl-1.0 | general public | gnu general public licen[sc]e (?:version |v )?1(?: 0)? | gpl 1 0(?: only| or later)?
gpl-2.0 | general public | (?:gnu )?general public licen[sc]e (?:version |v )?2(?: 0)? | gpl 2 0(?: only| or later)?
gpl-3.0 | general public | (?:gnu )?general public licen[sc]e (?:version |v )?3(?: 0)? | gpl 3 0(?: only| or later)?
lgpl-2.0 | library general | (?:gnu )?library general public licen[sc]e(?: (?:version |v )?2(?: 0)?)? | lgpl 2 0(?: only| or later)?
lgpl-2.1 | lesser general | (?:gnu )?lesser general public licen[sc]e (?:version |v )?2 1 | lgpl 2 1(?: only| or later)?
lgpl-3.0 | lesser general | (?:gnu )?lesser general public licen[sc]e (?:version |v )?3(?: 0)? | lgpl 3 0(?: only| or later)?
agpl-1.0 | affero general | affero general public licen[sc]e (?:version |v )?1(?: 0)? | agpl 1 0(?: only| or later)?
agpl-3.0 | affero general | (?:gnu )?affero general public licen[sc]e(?: (?:version |v )?3(?: 0)?)? | agpl 3 0(?: only| or later)?
gfdl-1.1 | free documentation | (?:gnu )?free documentation licen[sc]e (?:version |v )?1 1 | gfdl 1 1(?: only| or later)?
gfdl-1.2 | free documentation | (?:gnu )?free documentation licen[sc]e (?:version |v )?1 2 | gfdl 1 2(?: only| or later)?
gfdl-1.3 | free documentation | (?:gnu )?free documentation licen[sc]e (?:version |v )?1 3 | gfdl 1 3(?: only| or later)?
apache-1.0 | apache | apache (?:software )?licen[sc]e (?:version |v )?1 0 | apache 1 0
apache-1.1 | apache | apache (?:software )?licen[sc]e (?:version |v )?1 1 | apache 1 1
apache-2.0 | apache | apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)? | apache 2 0
mit-0 | mit | mit no attribution(?: licen[sc]e)? | mit 0
mit-x11 | x11 | (?:mit )?x11 licen[sc]e | x11
expat | expat | expat licen[sc]e | expat
isc | isc | isc licen[sc]e | isc
bsd-1-clause | bsd | (?:1|one) clause bsd licen[sc]e | bsd 1 clause
bsd-2-clause | bsd | (?:(?:2|two) clause bsd|simplified bsd|freebsd) licen[sc]e | bsd 2 clause
bsd-3-clause | bsd | (?:(?:3|three) clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e | bsd 3 clause
bsd-4-clause | bsd | (?:(?:4|four) clause bsd|original bsd|old bsd) licen[sc]e | bsd 4 clause
0bsd | bsd | (?:zero clause bsd|0 ?bsd|bsd zero clause) licen[sc]e | 0bsd
mpl-1.0 | mozilla public | mozilla public licen[sc]e (?:version |v )?1 0 | mpl 1 0
mpl-1.1 | mozilla public | mozilla public licen[sc]e (?:version |v )?1 1 | mpl 1 1
mpl-2.0 | mozilla public | mozilla public licen[sc]e (?:version |v )?2(?: 0)? | mpl 2 0
epl-1.0 | eclipse public | eclipse public licen[sc]e (?:version |v )?1(?: 0)? | epl 1 0
epl-2.0 | eclipse public | eclipse public licen[sc]e (?:version |v )?2(?: 0)? | epl 2 0
edl-1.0 | eclipse distribution | eclipse distribution licen[sc]e(?: (?:version |v )?1(?: 0)?)? | edl 1 0
cddl-1.0 | common development | common development and distribution licen[sc]e(?: (?:version |v )?1(?: 0)?)? | cddl 1 0
cddl-1.1 | common development | common development and distribution licen[sc]e (?:version |v )?1 1 | cddl 1 1
cpl-1.0 | common public | common public licen[sc]e(?: (?:version |v )?1(?: 0)?)? | cpl 1 0
ipl-1.0 | ibm public | ibm public licen[sc]e(?: (?:version |v )?1(?: 0)?)? | ipl 1 0
eupl-1.1 | european union public | european union public licen[sc]e (?:version |v )?1 1 | eupl 1 1
eupl-1.2 | european union public | european union public licen[sc]e (?:version |v )?1 2 | eupl 1 2
cecill-2.1 | cecill | cecill (?:free software )?licen[sc]e(?: agreement)?(?: (?:version |v )?2(?: 1)?)? | cecill 2 1
cecill-b | cecill | cecill b(?: free software)?(?: licen[sc]e)? | cecill b
cecill-c | cecill | cecill c(?: free software)?(?: licen[sc]e)? | cecill c
artistic-1.0 | artistic | artistic licen[sc]e (?:version |v )?1(?: 0)? | artistic 1 0(?: perl)?
artistic-2.0 | artistic | artistic licen[sc]e (?:version |v )?2(?: 0)? | artistic 2 0
bsl-1.0 | boost software | boost software licen[sc]e(?: (?:version |v )?1(?: 0)?)? | bsl 1 0
zlib | zlib | zlib(?: libpng)? licen[sc]e | zlib
libpng | libpng | libpng licen[sc]e | libpng(?: 2 0)?
unlicense | unlicense | the unlicense | unlicense
wtfpl | do what the | do what the \w+ you want to public licen[sc]e | wtfpl
python-2.0 | python software foundation | python software foundation licen[sc]e(?: (?:version |v )?2)? | psf 2 0|python 2 0
php-3.01 | php | php licen[sc]e(?: (?:version |v )?3(?: 01| 0)?)? | php 3 0(?:1)?
ruby | ruby | ruby licen[sc]e | ruby
openssl | openssl | openssl licen[sc]e | openssl
postgresql | postgresql | postgresql licen[sc]e | postgresql
ncsa | illinois | university of illinois (?:ncsa )?open source licen[sc]e | ncsa
afl-3.0 | academic free | academic free licen[sc]e(?: (?:version |v )?3(?: 0)?)? | afl 3 0
osl-3.0 | open software licen | open software licen[sc]e(?: (?:version |v )?3(?: 0)?)? | osl 3 0
ms-pl | microsoft public | microsoft public licen[sc]e | ms pl
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e | ms rl
ofl-1.1 | open font | (?:sil )?open font licen[sc]e(?: (?:version |v )?1(?: 1)?)? | ofl 1 1
lppl-1.3c | latex project public | latex project public licen[sc]e(?: (?:version |v )?1(?: 3c?)?)? | lppl 1 3c
upl-1.0 | universal permissive | universal permissive licen[sc]e(?: (?:version |v )?1(?: 0)?)? | upl 1 0
blueoak-1.0.0 | blue oak model | blue oak model licen[sc]e(?: 1 0 0)? | blueoak 1 0 0
mulan-psl-2.0 | mulan | mulan (?:permissive software licen[sc]e|psl)(?: (?:version |v )?2)? | mulanpsl 2 0
sspl-1.0 | server side public | server side public licen[sc]e(?: (?:version |v )?1)? | sspl 1 0
busl-1.1 | business source | business source licen[sc]e(?: (?:version |v )?1(?: 1)?)? | busl 1 1
elastic-2.0 | elastic licen | elastic licen[sc]e(?: (?:version |v )?2(?: 0)?)? | elastic 2 0
odbl-1.0 | open database | (?:odc )?open database licen[sc]e(?: (?:version |v )?1(?: 0)?)? | odbl 1 0
odc-by-1.0 | open data commons attribution | open data commons attribution licen[sc]e(?: (?:version |v )?1(?: 0)?)? | odc by 1 0
pddl-1.0 | public domain dedication and licen | (?:open data commons )?public domain dedication and licen[sc]e | pddl 1 0
cdla-permissive | community data licen | community data licen[sc]e agreement permissive(?: (?:version |v )?[12](?: 0)?)? | cdla permissive [12] 0
cdla-sharing | community data licen | community data licen[sc]e agreement sharing(?: (?:version |v )?1(?: 0)?)? | cdla sharing 1 0
etalab-2.0 | licence ouverte | licence ouverte(?: open licence)?(?: (?:version |v )?2(?: 0)?)? | etalab 2 0
ogl-uk-3.0 | open government | open government licen[sc]e(?: (?:version |v )?3(?: 0)?)? | ogl uk 3 0
dl-de-by-2.0 | datenlizenz deutschland | datenlizenz deutschland namensnennung(?: (?:version )?2 0)? | dl de by 2 0
openrail | openrail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[sc]e)? | openrail(?:pp)?
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)? | cc0 1 0
cc-by-1.0 | cc by | cc by 1 0 | cc by 1 0
cc-by-2.0 | cc by | cc by 2 0 | cc by 2 0
cc-by-2.5 | cc by | cc by 2 5 | cc by 2 5
cc-by-3.0 | cc by | cc by 3 0 | cc by 3 0
cc-by-4.0 | cc by | cc by 4 0 | cc by 4 0
cc-by-sa-2.0 | cc by sa | cc by sa 2 0 | cc by sa 2 0
cc-by-sa-3.0 | cc by sa | cc by sa 3 0 | cc by sa 3 0
cc-by-sa-4.0 | cc by sa | cc by sa 4 0 | cc by sa 4 0
cc-by-sa | cc by sa | cc by sa | cc by sa
cc-by-nd | cc by nd | cc by nd(?: [1234] [05])? | cc by nd [1234] [05]
cc-by-nc | cc by nc | cc by nc(?: [1234] [05])? | cc by nc [1234] [05]
cc-by-nc-sa | cc by nc sa | cc by nc sa(?: [1234] [05])? | cc by nc sa [1234] [05]
cc-by-nc-nd | cc by nc nd | cc by nc nd(?: [1234] [05])? | cc by nc nd [1234] [05]
cc-by-4.0 | creative commons attribution | creative commons attribution (?:4 0 international|international 4 0)(?: public)?(?: licen[sc]e)? | 
cc-by-sa-4.0 | creative commons attribution | creative commons attribution share ?alike (?:4 0 international|international 4 0)(?: public)?(?: licen[sc]e)? | 
cc-by-nc | creative commons attribution | creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)? | 
cc-by-nc-sa | creative commons attribution | creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)? | 
cc-by-nc-nd | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:atives|ative works|s)(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)? | 
cc-by-nd | creative commons attribution | creative commons attribution no ?deriv(?:atives|ative works|s)(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)? | 
cc-by | creative commons attribution | creative commons attribution(?: [1234] [05])?(?: unported| generic)?(?: licen[sc]e)? | 
"""

# priority | label | keyword | pattern over words: titles, sentences and addresses
SENTENCES = r"""
95 | mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
90 | mit | to deal in the software | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
85 | mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
95 | isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
80 | bsd | redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
90 | bsd-3-clause | endorse or promote | neither the name of (?:(?!nor the names of its contributors |neither the name of )[^ ]+ )++nor the names of its contributors may be used to endorse or promote products derived from this software
92 | bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
80 | bsd | redistributions of source code | redistributions of source code must retain the above copyright notice
80 | bsd | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
95 | apache-2.0 | licensed under the apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
90 | apache-2.0 | except in compliance with the license | you may not use this file except in compliance with the license
90 | apache-2.0 | apache org | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
90 | apache-1.1 | apache org | (?:https? )?(?:www )?apache org licenses license 1 1(?: txt| html)?
95 | gpl-2.0 | as published by the free software | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or (?:[^ ]+ ){0,4}any later version
95 | gpl-3.0 | as published by the free software | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or (?:[^ ]+ ){0,4}any later version
95 | lgpl-2.1 | as published by the free software | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license
95 | lgpl-3.0 | as published by the free software | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license
95 | agpl-3.0 | as published by the free software | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license
70 | gpl | a copy of the gnu general public | you should have received a copy of the gnu general public license along with this (?:program|file|software|library)
70 | lgpl | a copy of the gnu lesser general | you should have received a copy of the gnu lesser general public license along with this (?:program|file|software|library)
70 | gpl | merchantability or fitness | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
85 | gpl-2.0 | gnu org licenses | (?:https? )?(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?
85 | gpl-3.0 | gnu org licenses | (?:https? )?(?:www )?gnu org licenses gpl 3 0(?: txt| html)?
85 | lgpl-2.1 | gnu org licenses | (?:https? )?(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html)?
85 | lgpl-3.0 | gnu org licenses | (?:https? )?(?:www )?gnu org licenses lgpl 3 0(?: txt| html)?
85 | agpl-3.0 | gnu org licenses | (?:https? )?(?:www )?gnu org licenses agpl 3 0(?: txt| html)?
85 | gfdl | gnu org licenses | (?:https? )?(?:www )?gnu org licenses fdl(?: 1 [123])?(?: txt| html)?
60 | gpl | gplv | gpl ?v ?[123]
60 | gpl | gplv2 | gplv2
60 | gpl | gplv3 | gplv3
60 | lgpl | lgplv2 | lgplv2(?: 1)?
60 | lgpl | lgplv3 | lgplv3
60 | agpl-3.0 | agplv3 | agplv3
95 | mpl-2.0 | mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
85 | mpl-2.0 | mozilla org mpl | (?:https? )?(?:www )?mozilla org mpl 2 0
85 | mpl-1.1 | mozilla org mpl | (?:https? )?(?:www )?mozilla org mpl(?: mpl 1 1)?(?: html)?
85 | epl-2.0 | eclipse org legal | (?:https? )?(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?
85 | epl-1.0 | eclipse org legal | (?:https? )?(?:www )?eclipse org legal epl v10(?: html)?
95 | unlicense | released into the public domain | this is free and unencumbered software released into the public domain
90 | unlicense | unlicense org | (?:https? )?(?:www )?unlicense org
95 | bsl-1.0 | boost software license | distributed under the boost software license version 1 0
85 | bsl-1.0 | boost org | (?:https? )?(?:www )?boost org license 1 0 txt
95 | zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
90 | zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
95 | wtfpl | what the fuck you want | you just do what the fuck you want to
85 | ofl-1.1 | scripts sil org | (?:https? )?(?:www )?scripts sil org ofl
85 | cc0-1.0 | creativecommons org publicdomain | (?:https? )?(?:www )?creativecommons org publicdomain zero 1 0
85 | public-domain-mark | creativecommons org publicdomain | (?:https? )?(?:www )?creativecommons org publicdomain mark 1 0
86 | cc-by-sa | creativecommons org licenses | (?:https? )?(?:www )?creativecommons org licenses by sa [1234] [05]
86 | cc-by-nc | creativecommons org licenses | (?:https? )?(?:www )?creativecommons org licenses by nc [1234] [05]
86 | cc-by-nd | creativecommons org licenses | (?:https? )?(?:www )?creativecommons org licenses by nd [1234] [05]
86 | cc-by-nc-sa | creativecommons org licenses | (?:https? )?(?:www )?creativecommons org licenses by nc sa [1234] [05]
86 | cc-by-nc-nd | creativecommons org licenses | (?:https? )?(?:www )?creativecommons org licenses by nc nd [1234] [05]
85 | cc-by | creativecommons org licenses | (?:https? )?(?:www )?creativecommons org licenses by [1234] [05]
85 | mit | opensource org licenses | (?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php)?
85 | isc | opensource org licenses | (?:https? )?(?:www )?opensource org licenses isc(?: license)?(?: php)?
85 | bsd-3-clause | opensource org licenses | (?:https? )?(?:www )?opensource org licenses bsd 3 clause
85 | bsd-2-clause | opensource org licenses | (?:https? )?(?:www )?opensource org licenses bsd 2 clause
85 | artistic-2.0 | opensource org licenses | (?:https? )?(?:www )?opensource org licenses artistic license 2 0
55 | public-domain | public domain | (?:dedicated|released|placed) (?:in|into|to) the public domain
55 | public-domain | public domain | (?:this work|it|which) is in the public domain
60 | gpl-exception | classpath | (?:gnu )?classpath exception
60 | gpl-exception | gcc runtime library | gcc runtime library exception
60 | gpl-exception | linking exception | (?:static |dynamic )?linking exception
58 | dual-license | dual licensed | dual licensed under
58 | dual-license | dual license | dual licen[sc]ed? (?:mit|bsd|apache|gpl)(?: [0-9])*(?: (?:or|and) \w+)?
50 | proprietary | all rights reserved | all rights reserved
65 | proprietary | proprietary and confidential | (?:this (?:file|software|document|source code) is )?proprietary and confidential
65 | proprietary | unauthorized copying | unauthorized copying (?:of this file|via any medium|or distribution)(?: via any medium)?
65 | proprietary | may not be reproduced | may not be reproduced(?: [^ ]+){0,12} without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)
60 | proprietary | end user license | end user licen[sc]e agreement
60 | proprietary | trade secret | (?:contains|constitutes?) (?:confidential information and )?trade secrets?
55 | non-commercial | non commercial | (?:for )?non commercial (?:use|purposes?) only
55 | non-commercial | noncommercial | (?:for )?noncommercial (?:use|purposes?) only
55 | research-only | research purposes | (?:for )?research purposes only
55 | educational-only | educational purposes | (?:for )?educational purposes only
40 | copyleft | share alike | share alike
40 | copyleft | copyleft | copyleft(?: licen[sc]e)?
35 | gpl | gpl | (?:gnu )?gpl(?: licen[sc]ed?)?
35 | lgpl | lgpl | (?:gnu )?lgpl(?: licen[sc]ed?)?
35 | agpl | agpl | (?:gnu )?agpl(?: licen[sc]ed?)?
35 | bsd | bsd license | bsd (?:style )?license
35 | bsd | bsd licence | bsd (?:style )?licence
35 | bsd | bsd style | bsd style(?: licen[sc]e)?
35 | mit | mit licensed | mit licensed
35 | mit | mit style | mit style(?: licen[sc]e)?
35 | mit | mit licence | mit licence
35 | apache | apache licensed | apache licensed
35 | apache | apache licence | apache licence
35 | creative-commons | creative commons | creative commons(?: licen[sc]ed?)?
20 | open-source | open source license | (?:under )?an? open source licen[sc]e
20 | see-license | see the license | see (?:the )?license(?: file| txt| md)?(?: for (?:more )?(?:details|information))?
20 | see-license | license file | (?:in|see) the license file
"""


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, by falling priority (stable): the order decides between equal detections.

    Every licence of ``NAMES`` gives a rule for its name, for a grant under that
    name, and for its machine-readable identifier.
    """
    found = list(BASE)
    for line in NAMES.strip().splitlines():
        label, keyword, name, short = (x.strip() for x in f"{line} ".split(" | ", 3))
        grant = r"(?:licen[sc]ed|released|distributed|available|redistribute it|provided|published)"
        terms = r"under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
        found.append(Rule(label, 60, keyword, name))
        found.append(Rule(label, 75, keyword, f"{grant} {terms}(?:{name})"))
        if short:
            found.append(Rule(label, 92, "spdx license identifier", f"spdx license identifier (?:{short})"))
            found.append(Rule(label, 80, "license", f"license (?:expression |type )?(?:{short})"))
    for line in SENTENCES.strip().splitlines():
        priority, label, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        found.append(Rule(label, int(priority), keyword, pattern))
    return tuple(sorted(found, key=lambda r: -r.priority))


SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
TABLE = bytes.maketrans(SEPARATORS + bytes(range(65, 91)), b" " * len(SEPARATORS) + bytes(range(97, 123)))


class Scanner:
    """Compiled rules and the automaton of their keywords."""

    def __init__(self, table: tuple[Rule, ...]) -> None:
        import ahocorasick

        self.rules = table
        self.compiled: dict[int, re.Pattern[bytes]] = {}
        by_keyword: dict[str, list[int]] = {}
        for k, r in enumerate(table):
            by_keyword.setdefault(r.keyword, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for word, owners in by_keyword.items():
            # A keyword may end within a word, never start within one.
            self.automaton.add_word(f" {word}", tuple(owners))
        self.automaton.make_automaton()

    def pattern(self, k: int) -> re.Pattern[bytes]:
        if k not in self.compiled:
            self.compiled[k] = re.compile(rb"(?<= )(?:" + self.rules[k].pattern.encode() + rb")(?= )")
        return self.compiled[k]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words, and kept detections as (first word, word after the last, rule)."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
        if not words:
            return 0, []
        flat = b" " + b" ".join(words) + b" "
        wanted: set[int] = set()
        for _, owners in self.automaton.iter(flat.decode("latin-1")):
            wanted.update(owners)
        if not wanted:
            return len(words), []
        spans = [(m.start(), m.end(), k) for k in sorted(wanted) for m in self.pattern(k).finditer(flat)]
        return len(words), self._resolve(flat, spans)

    def _resolve(self, flat: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """One sweep from left to right, longest first, knowing the furthest end of each priority.

        What covers a span starts no later, so it has been seen; that it may be
        dropped itself doesn't matter, as what covers it covers the span too.
        """
        spans.sort(key=lambda s: (s[0], -s[1], s[2]))
        ends: dict[int, int] = {}
        seen: set[tuple[int, int]] = set()
        kept, at, word = [], 1, 0
        # Equal spans come in the order of rules; a higher priority may still follow a longer span.
        for start, end, k in spans:
            rule = self.rules[k]
            covered = (start, end) in seen or any(e >= end for p, e in ends.items() if p >= rule.priority)
            word += flat.count(b" ", at, start)
            at = start
            if rule.base or not covered:
                kept.append((word, word + flat.count(b" ", start, end) + 1, k))
            if not rule.base:
                ends[rule.priority] = max(ends.get(rule.priority, 0), end)
                seen.add((start, end))
        return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules())


DETECTIONS = "array<struct<label:string,rule:int,priority:int,first_word:long,end_word:long,base:boolean>>"


def scan_licenses(df: DataFrame, text_col: str = "text", words_col: str = "n_words", out_col: str = "detections") -> DataFrame:
    """``df`` with the number of words of ``text_col`` and its kept detections.

    Narrow; whole texts.  A null text is an empty one: 0 words, no detections.
    Columns already called like the two new ones are replaced, others stay.
    """
    keep = df.drop(words_col, out_col)
    kind = pa.list_(
        pa.struct([("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("base", pa.bool_())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for whole in batches:
            for batch in slices(whole, text_col):
                found = [s.scan(t) for t in batch.column(text_col).to_pylist()]
                rows = [
                    [(s.rules[k].label, k, s.rules[k].priority, a, b, s.rules[k].base) for a, b, k in spans] for _, spans in found
                ]
                names = [f.name for f in kind.value_type]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([n for n, _ in found], pa.int64()), pa.array([[dict(zip(names, x, strict=True)) for x in r] for r in rows], kind)],
                    names=[*batch.schema.names, words_col, out_col],
                )

    return map_arrow(keep, run, extended(keep, **{words_col: "long", out_col: DETECTIONS}))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections in all documents, as digest columns."""
    found = scan_licenses(documents(spark, sf_dir, "doc_id", "text")).drop("text")
    base = F.filter("detections", lambda d: d["base"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")
    doubt = F.aggregate("detections", F.lit(1.0), lambda a, d: a * (1 - d["priority"] / 100.0))
    return found.select(
        "doc_id", "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first_word"])).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("detections")).alias("labels"),
        F.least(F.lit(1.0), 1 - doubt).alias("score"),
    )
