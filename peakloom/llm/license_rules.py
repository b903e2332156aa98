"""Signature rules of licenses, written by hand for texts of folded words joined by one space.

A line is `label | confidence | keywords | pattern`. Keywords, comma-separated, must all stand in the
text at the start of a word before the pattern is tried; a slash parts those of which one is enough. A family names its versions once; {v}
stands for a version's words ("2 0"), and {V} in a label for its usual spelling ("2.0"). Gaps are
bounded, so patterns take linear time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Sections in the order of their priority: what they hold, the highest first.
TAGS, NOTICES, TITLES, LINKS, SHORT, MENTIONS = range(6)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    confidence: float
    keywords: tuple[tuple[bytes, ...], ...]
    pattern: str

    def compiled(self) -> re.Pattern[bytes]:
        return re.compile(rb"(?<= )(?:" + self.pattern.encode() + rb")(?= )")


#: Sentences of license texts and of the notices that they ask for.
_NOTICES = r"""
mit | 0.98 | hereby granted,person obtaining | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 0.9 | shall be included | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
mit-0 | 0.7 | mit no attribution | mit no attribution(?: license)?
bsl-1.0 | 0.98 | hereby granted,person or organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
icu | 0.6 | data files or software | deal in the data files or software without restriction
isc | 0.95 | permission to use | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
hpnd | 0.8 | permission to use | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is hereby granted
bsd | 0.9 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 0.95 | endorse or promote | neither the names? of (?:the )?(?:\S+ ){1,12}?nor the names of (?:its|their|other) contributors may be used to endorse or promote products
bsd-4-clause | 0.95 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause-patent | 0.8 | redistribution and use,patent license | subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights
apache-2.0 | 0.98 | licensed under the apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance
apache-2.0 | 0.9 | apache org licenses | terms and conditions for use reproduction and distribution 1 definitions license shall mean
apache-1.1 | 0.9 | apache software foundation | this product includes software developed by the apache software foundation
gpl | 0.9 | redistribute it and or modify | this (?:program|software|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | 0.9 | redistribute it and or modify | this (?:library|program|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl | 0.9 | redistribute it and or modify | this (?:program|software) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl | 0.7 | without even the implied warranty | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
lgpl | 0.7 | without even the implied warranty | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license
gpl-classpath-exception | 0.9 | classpath exception | (?:with the )?classpath exception(?: 2 0)?
gpl-gcc-exception | 0.9 | runtime library exception | gcc runtime library exception(?: 3 1)?
gpl-linking-exception | 0.8 | special exception,permission to link | as a special exception (?:\S+ ){0,12}?permission to link
gfdl | 0.9 | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | 0.98 | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | 0.95 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | 0.95 | eclipse public license | made available under the terms of the eclipse public license v ?1 0
epl-2.0 | 0.95 | eclipse public license | made available under the terms of the eclipse public license (?:v ?)?2 0
cddl-1.0 | 0.9 | common development and distribution | subject to the terms of the common development and distribution license
zlib | 0.9 | express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 0.85 | must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense | 0.98 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 0.95 | what the fuck | do what the fuck you want to(?: public license)?
beerware | 0.9 | beer ware/beerware | (?:the )?beer ?ware license
cc0-1.0 | 0.95 | related or neighboring rights/related and neighboring rights | (?:has|have) (?:dedicated|waived) (?:\S+ ){0,12}?(?:copyright and )?related (?:and|or) neighboring rights
ofl-1.1 | 0.9 | font software | permission is hereby granted free of charge to any person obtaining a copy of the font software
artistic | 0.8 | artistic license/artistic licence | under the (?:same )?terms (?:of|as) (?:the )?(?:perl )?artistic licen[cs]e
perl | 0.9 | same terms as perl | (?:redistribute|modify) it (?:and or modify it )?under the same terms as perl(?: itself)?
openssl | 0.9 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 0.9 | cryptographic software | this product includes cryptographic software written by eric young
psf-2.0 | 0.9 | python software foundation | this license agreement is between the python software foundation psf and the individual or organization
php | 0.9 | developed by the php | this product includes (?:php )?software (?:developed by the php group|freely available from)
postgresql | 0.9 | university of california be liable | in no event shall the university of california be liable to any party for direct indirect special
json | 0.9 | for good not evil | the software shall be used for good not evil
ijg | 0.9 | independent jpeg group | this software is based in part on the work of the independent jpeg group
ftl | 0.9 | freetype project | portions of this software are copyright (?:\S+ ){0,6}?the freetype project
libpng | 0.9 | png reference library | the (?:contributing authors|png reference library)(?: \S+){0,12}? (?:supplied as is|disclaim all warranties)
curl | 0.7 | permission to use,copyright holder shall not | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
unicode | 0.9 | unicode data files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
sspl-1.0 | 0.9 | service source code | you must make the service source code available via network download
commons-clause | 0.95 | right to sell | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
busl-1.1 | 0.9 | change license | (?:change date|change license) (?:\S+ ){0,24}?(?:business source license|additional use grant)
public-domain | 0.85 | public domain | (?:placed|released|dedicated|put|is) (?:in|into|to) the public domain
public-domain | 0.8 | public domain | has been (?:identified|marked) as being free of known restrictions under copyright law (?:\S+ ){0,12}?public domain
proprietary | 0.6 | all rights reserved | (?:copyright|c) (?:\S+ ){0,12}?all rights reserved
proprietary | 0.8 | confidential,proprietary | (?:proprietary and confidential|confidential and proprietary)(?: information)?
proprietary | 0.8 | prior written permission | no part of this (?:book|publication|document|work|software) may be reproduced (?:\S+ ){0,24}?prior written permission
proprietary | 0.7 | end user license agreement | end user licen[cs]e agreement
noncommercial | 0.6 | non commercial/noncommercial | for (?:personal and )?non ?commercial (?:use|purposes)(?: only)?
research-only | 0.6 | research | for (?:academic |internal )?research (?:use|purposes) only
"""

#: Names: label | confidence | keywords | name, with the versions of a family behind a further bar.
_TITLES = r"""
gpl-{V} | 0.95 | gnu general public | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version|v) ?{v} | 1.0 2.0 3.0
lgpl-{V} | 0.95 | general public | gnu (?:lesser|library) general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version|v) ?{v} | 2.0 2.1 3.0
agpl-{V} | 0.95 | affero general public | (?:gnu )?affero general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version|v) ?{v} | 1.0 3.0
gpl-{V}-or-later | 0.97 | gnu general public,any later | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version|v) ?{v} (?:of the license )?or (?:at your option )?any later version | 1.0 2.0 3.0
lgpl-{V}-or-later | 0.97 | general public,any later | gnu (?:lesser|library) general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version|v) ?{v} (?:of the license )?or (?:at your option )?any later version | 2.0 2.1 3.0
agpl-{V}-or-later | 0.97 | affero general public,any later | (?:gnu )?affero general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version|v) ?{v} (?:of the license )?or (?:at your option )?any later version | 3.0
gfdl-{V} | 0.95 | free documentation | gnu free documentation licen[cs]e (?:version|v) ?{v} | 1.1 1.2 1.3
apache-{V} | 0.95 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?{v} | 1.0 1.1 2.0
mpl-{V} | 0.95 | mozilla public | mozilla public licen[cs]e (?:version |v ?)?{v} | 1.0 1.1 2.0
epl-{V} | 0.95 | eclipse public | eclipse public licen[cs]e (?:version |v ?)?{v} | 1.0 2.0
eupl-{V} | 0.95 | european union public | european union public licen[cs]e (?:version |v ?)?{v} | 1.0 1.1 1.2
cddl-{V} | 0.95 | common development and distribution | common development and distribution licen[cs]e (?:cddl )?(?:version |v ?)?{v} | 1.0 1.1
cecill-{V} | 0.9 | cecill | cecill (?:free software licen[cs]e agreement )?(?:version |v ?)?{v} | 1.0 1.1 2.0 2.1
cecill-{V} | 0.9 | cecill | cecill {v} (?:free software )?licen[cs]e | b c
afl-{V} | 0.9 | academic free | academic free licen[cs]e (?:version |v ?)?{v} | 1.1 1.2 2.0 2.1 3.0
osl-{V} | 0.9 | open software license | open software license (?:version |v ?)?{v} | 1.0 1.1 2.0 2.1 3.0
artistic-{V} | 0.9 | artistic | artistic licen[cs]e (?:version |v ?)?{v} | 1.0 2.0
ecl-{V} | 0.9 | educational community | educational community licen[cs]e (?:version |v ?)?{v} | 1.0 2.0
efl-{V} | 0.9 | eiffel forum | eiffel forum licen[cs]e (?:version |v ?)?{v} | 1.0 2.0
lppl-{V} | 0.9 | latex project public | latex project public licen[cs]e (?:version |v ?)?{v} | 1.0 1.1 1.2 1.3a 1.3c
npl-{V} | 0.9 | netscape public | netscape public licen[cs]e (?:version |v ?)?{v} | 1.0 1.1
ofl-{V} | 0.9 | open font | (?:sil )?open font licen[cs]e (?:version |v ?)?{v} | 1.0 1.1
ogl-uk-{V} | 0.9 | open government | open government licen[cs]e (?:for public sector information )?(?:version |v ?)?{v} | 1.0 2.0 3.0
php-{V} | 0.9 | php license | php license (?:version |v ?)?{v} | 3.0 3.01
rpl-{V} | 0.9 | reciprocal public | reciprocal public licen[cs]e (?:version |v ?)?{v} | 1.1 1.5
zpl-{V} | 0.9 | zope public | zope public licen[cs]e (?:zpl )?(?:version |v ?)?{v} | 1.1 2.0 2.1
apsl-{V} | 0.9 | apple public source | apple public source licen[cs]e (?:version |v ?)?{v} | 1.0 1.1 1.2 2.0
cern-ohl-{V}-2.0 | 0.9 | cern open hardware | cern open hardware licen[cs]e (?:version |v ?)?2 (?:0 )?{v} | permissive strongly weakly
mulanpsl-{V} | 0.9 | mulan | mulan (?:permissive software licen[cs]e|psl) (?:version |v ?)?{v} | 1.0 2.0
lpl-{V} | 0.9 | lucent public | lucent public licen[cs]e (?:version |v ?)?{v} | 1.0 1.02
openldap-{V} | 0.9 | openldap public | openldap public licen[cs]e (?:version |v ?)?{v} | 2.0 2.7 2.8
polyform-{V} | 0.9 | polyform | polyform {v} licen[cs]e | noncommercial small-business internal-use shield strict
elastic-{V} | 0.9 | elastic license | elastic license (?:version |v ?)?{v} | 1.0 2.0
sspl-{V} | 0.9 | server side public | server side public licen[cs]e (?:version |v ?)?{v} | 1.0
busl-{V} | 0.9 | business source | business source licen[cs]e (?:version |v ?)?{v} | 1.0 1.1
bsd-{V}-clause | 0.9 | bsd | (?:{v} clause|simplified {v} clause) (?:new |revised |simplified )?bsd(?: licen[cs]e)? | 0 1 2 3 4
bsd-{V}-clause | 0.9 | bsd | bsd {v} clause(?: licen[cs]e)? | 0 1 2 3 4
bsd-3-clause | 0.85 | bsd | (?:new|modified|revised) bsd licen[cs]e
bsd-2-clause | 0.85 | bsd | (?:simplified|freebsd) (?:bsd )?licen[cs]e
mit | 0.9 | mit license/mit licence | (?:the )?mit licen[cs]e
x11 | 0.85 | x11/mit x11/x consortium | (?:the )?(?:x11|mit x11|x consortium) licen[cs]e
mit | 0.85 | expat license | (?:the )?expat licen[cs]e
isc | 0.9 | isc license | (?:the )?isc license
cc0-1.0 | 0.95 | cc0 | cc0 (?:1 0 )?universal(?: public domain dedication)?
cc-pdm-1.0 | 0.9 | public domain mark | public domain mark(?: 1 0)?
unlicense | 0.8 | the unlicense | the unlicense
bsl-1.0 | 0.9 | boost software | boost software licen[cs]e(?: version)?(?: 1 0)?
ms-pl | 0.9 | microsoft public | microsoft public licen[cs]e
ms-rl | 0.9 | microsoft reciprocal | microsoft reciprocal licen[cs]e
ncsa | 0.9 | illinois | (?:university of illinois )?(?:illinois )?ncsa open source licen[cs]e
zlib | 0.9 | zlib | zlib (?:libpng )?licen[cs]e
upl-1.0 | 0.9 | universal permissive | universal permissive licen[cs]e
postgresql | 0.9 | postgresql license | postgresql license
openssl | 0.85 | openssl license | openssl license
ruby | 0.85 | ruby license | ruby license
vim | 0.85 | vim license | vim license
w3c | 0.85 | w3c software | w3c software (?:and document )?(?:notice and )?licen[cs]e
blueoak-1.0.0 | 0.9 | blue oak | blue oak model licen[cs]e
cpl-1.0 | 0.9 | common public license | common public license(?: version)?(?: 1 0)?
ipl-1.0 | 0.9 | ibm public | ibm public licen[cs]e
qpl-1.0 | 0.9 | q public | (?:the )?q public licen[cs]e
sleepycat | 0.85 | sleepycat | sleepycat licen[cs]e
sissl | 0.9 | sun industry standards | sun industry standards source licen[cs]e
python-2.0 | 0.85 | python license/python licence/python software foundation | python (?:software foundation )?licen[cs]e
odbl-1.0 | 0.9 | open database | open (?:data commons )?(?:open )?database licen[cs]e(?: odbl)?
odc-by-1.0 | 0.9 | open data commons | open data commons attribution licen[cs]e
pddl-1.0 | 0.9 | public domain dedication and | (?:open data commons )?public domain dedication and licen[cs]e
openrail | 0.85 | open rail/openrail/creativeml/bigscience | (?:open rail|openrail|creativeml open rail|bigscience rail)(?: m)?(?: licen[cs]e)?
llama-community | 0.85 | llama | llama (?:\d (?:\d )?)?community licen[cs]e(?: agreement)?
commons-clause | 0.85 | commons clause | commons clause(?: license condition)?
wtfpl | 0.9 | wtfpl | wtfpl
nasa-1.3 | 0.85 | nasa open source | nasa open source agreement
naumen | 0.85 | naumen public | naumen public licen[cs]e
nokia | 0.85 | nokia open source | nokia open source licen[cs]e
watcom-1.0 | 0.85 | sybase open watcom | sybase open watcom public licen[cs]e
zend-2.0 | 0.85 | zend | zend (?:engine )?licen[cs]e
fair | 0.7 | fair license | (?:the )?fair license
tcl | 0.8 | tcl tk | tcl tk licen[cs]e
xfree86-1.1 | 0.85 | xfree86 license | xfree86 license
intel | 0.8 | intel open source | intel open source licen[cs]e
cpal-1.0 | 0.85 | common public attribution | common public attribution licen[cs]e
cpol-1.02 | 0.85 | code project open | code project open licen[cs]e
"""

#: The parts of Creative Commons licenses and the words they are named by.
CC_KINDS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative|ate)?s(?: works)?", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative|ate)?s(?: works)?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Addresses of license texts, as words.
_LINKS = r"""
gpl-{V} | 0.9 | gnu org licenses | gnu org licenses (?:old licenses )?gpl {v}(?: (?:html|txt|en|standalone))* | 1.0 2.0 3.0
lgpl-{V} | 0.9 | gnu org licenses | gnu org licenses (?:old licenses )?lgpl {v}(?: (?:html|txt|en|standalone))* | 2.0 2.1 3.0
agpl-{V} | 0.9 | gnu org licenses | gnu org licenses agpl {v}(?: (?:html|txt|en|standalone))* | 3.0
gfdl-{V} | 0.9 | gnu org licenses | gnu org licenses (?:old licenses )?fdl {v}(?: (?:html|txt|en|standalone))* | 1.1 1.2 1.3
apache-{V} | 0.9 | apache org licenses | apache org licenses license {v}(?: (?:html|txt))? | 1.0 1.1 2.0
mpl-{V} | 0.9 | mozilla org | mozilla org (?:en us )?mpl {v} | 1.0 1.1 2.0
epl-{V} | 0.9 | eclipse org | eclipse org (?:legal|org documents) epl (?:v ?)?{v} | 1.0 2.0
mit | 0.85 | opensource org | opensource org licenses? mit(?: license)?(?: (?:php|html))?
isc | 0.85 | opensource org | opensource org licenses? isc
bsd-{V}-clause | 0.85 | opensource org | opensource org licenses? bsd {v} clause | 2 3
cc0-1.0 | 0.9 | creativecommons org | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | 0.9 | creativecommons org | creativecommons org publicdomain mark 1 0
unlicense | 0.9 | unlicense org | unlicense org
bsl-1.0 | 0.85 | boost org | boost org license 1 0(?: txt)?
ofl-1.1 | 0.85 | scripts sil org | scripts sil org ofl
"""

#: Short forms.
_SHORT = r"""
gpl-{V} | 0.8 | gpl | (?:gnu )?gpl ?(?:version |v ?)?{v} | 1.0 2.0 3.0
gpl-{V} | 0.8 | gplv | (?:gnu )?gplv{v} | 1.0 2.0 3.0
gpl-{V}-or-later | 0.85 | gpl | (?:gnu )?gpl ?(?:version |v ?)?{v} or (?:later|newer|any later version) | 1.0 2.0 3.0
gpl-{V}-only | 0.85 | gpl | gpl {v} only | 1.0 2.0 3.0
lgpl-{V} | 0.8 | lgpl | (?:gnu )?lgpl ?(?:version |v ?)?{v} | 2.0 2.1 3.0
lgpl-{V}-or-later | 0.85 | lgpl | (?:gnu )?lgpl ?(?:version |v ?)?{v} or (?:later|newer|any later version) | 2.0 2.1 3.0
agpl-{V} | 0.8 | agpl | (?:gnu )?agpl ?(?:version |v ?)?{v} | 1.0 3.0
mpl-{V} | 0.75 | mpl | mpl (?:version |v ?)?{v} | 1.0 1.1 2.0
epl-{V} | 0.75 | epl | epl (?:version |v ?)?{v} | 1.0 2.0
eupl-{V} | 0.75 | eupl | eupl (?:version |v ?)?{v} | 1.0 1.1 1.2
apache-{V} | 0.8 | apache | apache (?:version |v ?)?{v} | 1.0 1.1 2.0
apache-2.0 | 0.7 | asl | asl 2 0
cddl-{V} | 0.75 | cddl | cddl (?:version |v ?)?{v} | 1.0 1.1
ofl-1.1 | 0.75 | ofl | (?:sil )?ofl 1 1
odbl-1.0 | 0.75 | odbl | odbl(?: 1 0)?
cc0-1.0 | 0.8 | cc0 | cc0(?: 1 0)?
bsd | 0.6 | bsd | (?:the )?bsd licen[cs]ed?
public-domain | 0.5 | public domain | public domain
"""

#: Names without a version, and sentences that only say that something is licensed.
_MENTIONS = r"""
gpl | 0.7 | gnu general public | gnu general public licen[cs]e
lgpl | 0.7 | general public | gnu (?:lesser|library) general public licen[cs]e
agpl | 0.7 | affero general public | (?:gnu )?affero general public licen[cs]e
gfdl | 0.7 | free documentation | gnu free documentation licen[cs]e
gpl | 0.5 | gpl | (?:gnu )?gpl
lgpl | 0.5 | lgpl | (?:gnu )?lgpl
agpl | 0.5 | agpl | (?:gnu )?agpl
apache | 0.7 | apache | apache (?:software )?licen[cs]e
mpl | 0.7 | mozilla public | mozilla public licen[cs]e
epl | 0.7 | eclipse public | eclipse public licen[cs]e
eupl | 0.7 | european union public | european union public licen[cs]e
artistic | 0.6 | artistic license/artistic licence | artistic licen[cs]e
ofl | 0.6 | open font | open font licen[cs]e
creative-commons | 0.5 | creative commons | creative commons(?: licen[cs]e)?
open-source | 0.3 | open source | (?:open source|free software) licen[cs]e
unknown-license | 0.2 | licensed under/released under/distributed under/published under | (?:licensed|released|distributed|published) under (?:the )?(?:terms of )?(?:this|an?|its own|the same|the following|an? (?:custom|separate|unknown|own|proprietary)) licen[cs]e
"""


def _words(version: str) -> str:
    """A version as words; a trailing 0 may be left out."""
    words = re.split(r"[.-]", version)
    return " ".join(words[:-1]) + "(?: 0)?" if len(words) == 2 and words[1] == "0" else " ".join(words)


def _section(lines: str, priority: int) -> list[Rule]:
    out = []
    for line in lines.strip().splitlines():
        label, confidence, keywords, pattern, *versions = line.split(" | ")
        for v in versions[0].split() if versions else [""]:
            at = pattern.replace("{v}", _words(v)) if v else pattern
            every = tuple(tuple(k.encode() for k in part.split("/")) for part in keywords.split(","))
            out.append(Rule(f"{priority}:{len(out)}", label.replace("{V}", v), priority, float(confidence), every, at))
    return out


def _creative_commons() -> list[Rule]:
    out = []
    for kind, name in CC_KINDS.items():
        for v in CC_VERSIONS:
            label, words, short = f"cc-{kind}-{v}", _words(v), kind.replace("-", " ")
            out.append(Rule(f"cc-title:{label}", label, TITLES, 0.95, ((b"attribution",),), f"(?:creative commons )?{name} {words}(?: (?:international|unported|generic))?(?: (?:public )?licen[cs]e)?"))
            out.append(Rule(f"cc-link:{label}", label, LINKS, 0.9, ((b"creativecommons org",),), f"creativecommons org licenses {short} {words}"))
            out.append(Rule(f"cc-short:{label}", label, SHORT, 0.85, ((b"cc",),), f"cc {short} {words}"))
        out.append(Rule(f"cc-any:{kind}", f"cc-{kind}", MENTIONS, 0.6, ((b"cc",),), f"cc {kind.replace('-', ' ')}"))
        out.append(Rule(f"cc-named:{kind}", f"cc-{kind}", MENTIONS, 0.7, ((b"creative commons",),), f"creative commons {name}"))
    return out


def _tags(labels: list[str]) -> list[Rule]:
    """License tags in source files, one a label that looks like an identifier."""
    return [Rule(f"tag:{label}", label, TAGS, 0.99, ((b"spdx license identifier",),), f"spdx license identifier {' '.join(re.split('[.-]', label))}") for label in labels]


def rules() -> list[Rule]:
    """All rules by priority, then in the order in which they are written."""
    named = [*_section(_NOTICES, NOTICES), *_section(_TITLES, TITLES), *_creative_commons(), *_section(_LINKS, LINKS), *_section(_SHORT, SHORT), *_section(_MENTIONS, MENTIONS)]
    out = _tags(sorted({r.label for r in named})) + named
    return sorted(out, key=lambda r: r.priority)
