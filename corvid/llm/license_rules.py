"""License detection with ordered signature rules.

A text is lower-cased (A-Z) and read as words, joined by one space; rules are
regular expressions over that string: wordings of licence bodies, grants and
headers, SPDX expressions, and names with their versions. A rule runs only
where one of its keywords stands, detections are taken by priority, and a
detection inside one already taken is suppressed. The base phrases are always kept and counted.

Defined results: a null or empty text has no words and no labels; phrases may
stand several times; repeated rows each get a row; labels are distinct and
sorted; the score is 0 without a detection.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache
from itertools import accumulate, groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import as_bytes, table

#: Everything in ASCII but digits and lower-case letters separates words.
_SEPARATORS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

BASE = ((b"under the mit license", "mit"), (b"apache license version 2", "apache-2"), (b"cc by nc", "cc-by-nc"))

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("detections", T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
])


@dataclass(frozen=True)
class Rule:
    """A signature; it is tried only where one of its keywords stands. An expression gives the labels of the ids in it."""

    name: str
    label: str
    keywords: tuple[bytes, ...]
    signature: str
    priority: int
    confidence: float
    expression: bool = False

    @property
    def pattern(self) -> re.Pattern[bytes]:
        return _compiled(self.signature)


@cache
def _compiled(signature: str) -> re.Pattern[bytes]:
    return re.compile(rb"(?:^|(?<= ))(?:" + signature.encode() + rb")(?= |$)")


#: Signatures of licence bodies, grants and headers in lower-case words, one a line: label | keyword | confidence | pattern.
#: ``<any n>`` stands for up to n words.
WORDINGS = """
mit | permission | 0.9 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission | 0.98 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
ncsa | permission | 0.98 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
mit | permission | 0.85 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | warranties | 0.7 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement
mit | liable | 0.7 | in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
json | evil | 0.98 | the software shall be used for good not evil
boost-1 | permission | 0.97 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
ofl-1.1 | permission | 0.97 | permission is hereby granted free of charge to any person obtaining a copy of the font software
ofl-1.1 | font | 0.95 | this font software is licensed under the sil open font license version 1 1
isc | permission | 0.96 | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0bsd | permission | 0.9 | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)
isc | disclaims | 0.8 | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
postgresql | permission | 0.96 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | permission | 0.9 | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
hpnd | permission | 0.85 | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
bsd | redistribution | 0.9 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | redistributions | 0.85 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions | 0.85 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3 | endorse | 0.96 | neither the names? of <any 12> may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3 | endorse | 0.9 | the names? of <any 12> may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4 | advertising | 0.96 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | provided | 0.75 | this software is provided by the (?:copyright holders?|regents|authors?|contributors)(?: and contributors)? as is and any express or implied warranties
bsd-patent | receiving | 0.9 | subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual
bsd-3-clear | patent | 0.9 | no express or implied licenses to any party s patent rights are granted by this license
apache-2 | apache | 0.98 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | basis | 0.85 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | apache | 0.95 | apache license version 2 0 january 2004
apache-2 | contributor | 0.93 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:except as stated in this section )?(?:copyright|patent) license
apache-2 | notice | 0.85 | if the work includes a notice text file as part of its distribution then any derivative works that you distribute must include a readable copy of the attribution notices
apache-1.1 | apache | 0.9 | this product includes software developed by the apache software foundation
apache-1 | apache | 0.9 | this product includes software developed by the apache group for use in the apache http server project
openssl | openssl | 0.95 | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic | 0.92 | this product includes cryptographic software written by eric young
php-3.01 | php | 0.9 | this product includes php software freely available from
zlib | liable | 0.85 | in no event will the authors be held liable for any damages arising from the use of this software
zlib | permission | 0.95 | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib | misrepresented | 0.95 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered | 0.9 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | png | 0.85 | this copy of the libpng notices is provided for your convenience
unlicense | unencumbered | 0.97 | this is free and unencumbered software released into the public domain
unlicense | anyone | 0.9 | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | fuck | 0.95 | you just do what the fuck you want to
wtfpl | changing | 0.9 | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
beerware | beer | 0.9 | the beer ?ware license
beerware | beer | 0.97 | if we meet some ?day and you think this stuff is worth it you can buy me a beer in return
gpl-1-or-later | general | 0.98 | gnu general public license as published by the free software foundation either version 1(?: of the license)? or at your option any later version
gpl-2-or-later | general | 0.98 | gnu general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version
gpl-3-or-later | general | 0.98 | gnu general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
gpl-2 | general | 0.95 | gnu general public license (?:version 2 )?as published by the free software foundation(?: version 2(?: of the license| only)?)?(?! either)
gpl-3 | general | 0.95 | gnu general public license as published by the free software foundation version 3(?: of the license| only)?
lgpl-2-or-later | library | 0.98 | gnu library general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version
lgpl-2.1-or-later | lesser | 0.98 | gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or at your option any later version
lgpl-3-or-later | lesser | 0.98 | gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
lgpl-2.1 | lesser | 0.95 | gnu lesser general public license(?: version 2 1)? as published by the free software foundation(?: version 2 1(?: of the license)?)?(?! either| version 3)
agpl-3-or-later | affero | 0.98 | gnu affero general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
agpl-3 | affero | 0.95 | gnu affero general public license as published by the free software foundation version 3(?: of the license| only)?
gpl | hope | 0.6 | this (?:program|file|package|software) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
lgpl | hope | 0.6 | this library is distributed in the hope that it will be useful but without any warranty
gpl | received | 0.8 | you should have received a copy of the gnu general public license along with
lgpl | received | 0.8 | you should have received a copy of the gnu (?:lesser|library) general public license along with
agpl | received | 0.8 | you should have received a copy of the gnu affero general public license along with
gpl-2 | freedom | 0.9 | the licenses for most software are designed to take away your freedom to share and change it
gpl-3 | copyleft | 0.95 | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3 | practical | 0.8 | the licenses for most software and other practical works are designed to take away your freedom to share and change the works
agpl-3 | network | 0.95 | your modified version must prominently offer all users interacting with it remotely through a computer network
lgpl-3 | supplemented | 0.95 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented
lgpl | derivative | 0.7 | a program that contains no derivative of any portion of the library but is designed to work with the library
gnu-text | verbatim | 0.5 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-linking-exception | exception | 0.9 | as a special exception <any 14> permission to link <any 12> with
classpath-exception-2 | linking | 0.95 | linking this library statically or dynamically with other modules is making a combined work based on this library
gcc-exception-3.1 | gcc | 0.9 | gcc runtime library exception version 3 1
bison-exception | bison | 0.9 | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
autoconf-exception | autoconf | 0.85 | a configuration script generated by autoconf
mpl-2 | mozilla | 0.98 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | mpl | 0.9 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | mozilla | 0.97 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1 | mozilla | 0.97 | the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 | netscape | 0.95 | the contents of this file are subject to the netscape public license version 1 1
epl-1 | eclipse | 0.97 | made available under the terms of the eclipse public license v ?1 0
epl-2 | eclipse | 0.97 | made available under the terms of the eclipse public license (?:v|version)? ?2 0
edl-1 | eclipse | 0.9 | eclipse distribution license v ?1 0
cpl-1 | common | 0.9 | common public license (?:v|version) ?1 0
ipl-1 | ibm | 0.9 | ibm public license (?:v|version) ?1 0
cddl-1 | distribution | 0.95 | subject to the terms of the common development and distribution license
eupl-1.2 | eupl | 0.95 | licensed under the eupl(?: version| v)? 1 2
eupl-1.1 | eupl | 0.95 | licensed under the eupl(?: version| v)? 1 1
artistic-1 | package | 0.92 | the intent of this document is to state the conditions under which a package may be copied
artistic-2 | package | 0.9 | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
perl | perl | 0.9 | (?:redistribute|modify) it(?: and or modify it)? under the same terms as perl(?: 5)? itself
python-2 | python | 0.95 | this license agreement is between the python software foundation psf and the individual or organization
ms-pl | accept | 0.7 | if you use the software you accept this license if you do not accept the license do not use the software
sspl-1 | functionality | 0.92 | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 | production | 0.95 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
elastic-2 | elastic | 0.9 | elastic license (?:version )?2 0
elastic-2 | managed | 0.9 | you may not provide the software to third parties as a hosted or managed service
commons-clause | sell | 0.95 | the license does not include and the license does not grant to you the right to sell the software
polyform-nc-1 | polyform | 0.95 | polyform noncommercial license 1 0 0
bigscience-openrail-m | bigscience | 0.92 | bigscience (?:bloom )?(?:open ?rail|rail)(?: m)?
creativeml-openrail-m | rail | 0.92 | creativeml open ?rail(?: m)?
llama-2 | llama | 0.92 | llama 2 community license(?: agreement)?
llama-3 | llama | 0.92 | llama 3 community license(?: agreement)?
gfdl-1.2-or-later | documentation | 0.97 | gnu free documentation license version 1 2 or any later version
gfdl-1.3-or-later | documentation | 0.97 | gnu free documentation license version 1 3 or any later version
gfdl | invariant | 0.85 | with no invariant sections no front cover texts and no back cover texts
cc0-1 | waived | 0.95 | to the extent possible under law <any 12> waived all copyright and related or neighboring rights
cc0-1 | dedicated | 0.9 | the person who associated a work with this deed has dedicated the work to the public domain
cc-by | share | 0.6 | you are free to share copy and redistribute the material in any medium or format
cc-by | credit | 0.6 | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-nc | commercial | 0.8 | you may not use the material for commercial purposes
cc-by-sa | remix | 0.85 | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-nd | remix | 0.85 | if you remix transform or build upon the material you may not distribute the modified material
odc-by-1 | commons | 0.92 | open data commons attribution license
pddl-1 | commons | 0.92 | open data commons public domain dedication and licen[cs]e
odbl-1 | commons | 0.92 | open data commons open database licen[cs]e
ogl-uk-3 | government | 0.92 | open government licen[cs]e v ?3 0
public-domain | domain | 0.7 | this (?:work|file|code|software|document|program) is (?:in|part of) the public domain
public-domain | disclaim | 0.8 | (?:the )?authors? hereby disclaims? copyright to this source code
public-domain | domain | 0.75 | (?:released|dedicated|placed|donated) (?:in|into|to) the public domain
proprietary | proprietary | 0.85 | confidential and proprietary
proprietary | proprietary | 0.8 | proprietary notice
proprietary | unauthori | 0.9 | unauthori[sz]ed (?:copying|use|reproduction)(?: or distribution)? of this (?:file|document|software|material)(?: via any medium)? is strictly prohibited
proprietary | reproduced | 0.8 | no part of this (?:publication|document|book|work) may be reproduced
proprietary | means | 0.7 | may not be (?:reproduced|copied)(?: stored| distributed)*(?: or)? (?:transmitted|distributed) in any form or by any means
proprietary | secret | 0.75 | contains (?:valuable )?trade secrets
proprietary | rights | 0.4 | all rights reserved
source-available | evaluation | 0.6 | for evaluation purposes only
no-license | granted | 0.5 | no licen[cs]e is granted(?: by implication)?
"""

#: SPDX identifiers and their labels
SPDX = """
MIT mit|MIT-0 mit-0|ISC isc|0BSD 0bsd|Apache-1.0 apache-1|Apache-1.1 apache-1.1|Apache-2.0 apache-2|BSD-2-Clause bsd-2|BSD-3-Clause bsd-3|BSD-4-Clause bsd-4|BSL-1.0 boost-1
BSD-2-Clause-Patent bsd-patent|BSD-3-Clause-Clear bsd-3-clear|GPL-1.0-only gpl-1|GPL-1.0-or-later gpl-1-or-later|GPL-2.0 gpl-2|GPL-2.0-only gpl-2|GPL-2.0-or-later gpl-2-or-later
GPL-3.0 gpl-3|GPL-3.0-only gpl-3|GPL-3.0-or-later gpl-3-or-later|LGPL-2.0-only lgpl-2|LGPL-2.0-or-later lgpl-2-or-later|LGPL-2.1 lgpl-2.1|LGPL-2.1-only lgpl-2.1|LGPL-2.1-or-later lgpl-2.1-or-later
LGPL-3.0 lgpl-3|LGPL-3.0-only lgpl-3|LGPL-3.0-or-later lgpl-3-or-later|AGPL-3.0 agpl-3|AGPL-3.0-only agpl-3|AGPL-3.0-or-later agpl-3-or-later|MPL-1.0 mpl-1|MPL-1.1 mpl-1.1|MPL-2.0 mpl-2
EPL-1.0 epl-1|EPL-2.0 epl-2|CDDL-1.0 cddl-1|CDDL-1.1 cddl-1.1|EUPL-1.1 eupl-1.1|EUPL-1.2 eupl-1.2|CC0-1.0 cc0-1|CC-BY-3.0 cc-by-3|CC-BY-4.0 cc-by-4|CC-BY-SA-3.0 cc-by-sa-3|CC-BY-SA-4.0 cc-by-sa-4
CC-BY-NC-4.0 cc-by-nc-4|CC-BY-NC-SA-4.0 cc-by-nc-sa-4|CC-BY-ND-4.0 cc-by-nd-4|CC-BY-NC-ND-4.0 cc-by-nc-nd-4|Artistic-1.0 artistic-1|Artistic-2.0 artistic-2|Zlib zlib|Unlicense unlicense|WTFPL wtfpl
OFL-1.1 ofl-1.1|PostgreSQL postgresql|Python-2.0 python-2|PSF-2.0 python-2|OpenSSL openssl|PHP-3.01 php-3.01|MS-PL ms-pl|MS-RL ms-rl|UPL-1.0 upl-1|NCSA ncsa|BUSL-1.1 busl-1.1|SSPL-1.0 sspl-1
ODbL-1.0 odbl-1|ODC-By-1.0 odc-by-1|PDDL-1.0 pddl-1|GFDL-1.3-or-later gfdl-1.3-or-later|GFDL-1.2-only gfdl-1.2|OSL-3.0 osl-3|AFL-3.0 afl-3|Elastic-2.0 elastic-2|JSON json|X11 x11|HPND hpnd
Classpath-exception-2.0 classpath-exception-2|GCC-exception-3.1 gcc-exception-3.1|LLVM-exception llvm-exception|Linux-syscall-note linux-syscall-note|Bison-exception-2.2 bison-exception|Autoconf-exception-3.0 autoconf-exception
"""


@cache
def spdx_ids() -> dict[str, str]:
    """Label by identifier in words, longest first."""
    pairs = [x.split() for line in SPDX.strip().splitlines() for x in line.split("|")]
    words = {re.sub("[^a-z0-9]+", " ", k.lower()): v for k, v in pairs}
    return dict(sorted(words.items(), key=lambda x: (-len(x[0]), x[0])))


@cache
def _spdx_pattern() -> re.Pattern[bytes]:
    return _compiled("|".join(spdx_ids()))


#: label: (keyword, names as word patterns, versions or None, SPDX ids as words, site words)
FAMILIES = {
    "mit": ("mit", "mit license|mit licence|the mit open source license", None, "mit", "opensource org licenses mit"),
    "mit-0": ("mit", "mit no attribution license", None, "mit 0", "opensource org licenses mit 0"),
    "apache": ("apache", "apache (?:software )?licen[cs]e", "1 0|1 1|2(?: 0)?", "apache {v}", "apache org licenses license {v}"),
    "gpl": ("gpl|general", "(?:gnu )?general public licen[cs]e|gnu gpl|gpl", "1|2|3", "gpl {v}(?: 0)?(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl {v}(?: 0)?"),
    "lgpl": ("lgpl|lesser|library", "(?:gnu )?(?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl", "2|2 1|3", "lgpl {v}(?: 0)?(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl {v}(?: 0)?"),
    "agpl": ("agpl|affero", "(?:gnu )?affero general public licen[cs]e|gnu agpl|agpl", "1|3", "agpl {v}(?: 0)?(?: only| or later)?", "gnu org licenses agpl {v}(?: 0)?"),
    "gfdl": ("documentation|gfdl", "(?:gnu )?free documentation licen[cs]e|gfdl", "1 1|1 2|1 3", "gfdl {v}(?: only| or later)?", "gnu org licenses fdl {v}"),
    "mpl": ("mozilla|mpl", "mozilla public licen[cs]e|mpl", "1 0|1 1|2(?: 0)?", "mpl {v}", "mozilla org mpl {v}"),
    "epl": ("eclipse|epl", "eclipse public licen[cs]e|epl", "1(?: 0)?|2(?: 0)?", "epl {v}", "eclipse org legal epl {v}"),
    "cddl": ("cddl|distribution", "common development and distribution licen[cs]e|cddl", "1 0|1 1", "cddl {v}", "opensource org licenses cddl {v}"),
    "eupl": ("eupl|european", "european union public licen[cs]e|eupl", "1 0|1 1|1 2", "eupl {v}", "joinup ec europa eu eupl {v}"),
    "artistic": ("artistic|perl", "(?:perl )?artistic licen[cs]e", "1 0|2(?: 0)?", "artistic {v}", "opensource org licenses artistic {v}"),
    "boost": ("boost|bsl", "boost software licen[cs]e", "1 0", "bsl {v}", "boost org license {v}"),
    "osl": ("osl|open", "open software licen[cs]e", "1 0|2 0|2 1|3 0", "osl {v}", "opensource org licenses osl {v}"),
    "afl": ("academic|afl", "academic free licen[cs]e", "1 1|1 2|2 0|2 1|3 0", "afl {v}", "opensource org licenses afl {v}"),
    "odbl": ("odbl|database", "open (?:data commons )?(?:open )?database licen[cs]e|odbl", "1 0", "odbl {v}", "opendatacommons org licenses odbl {v}"),
    "python": ("python|psf", "python (?:software foundation )?licen[cs]e|psf licen[cs]e", "2(?: 0)?", "python {v}|psf {v}", "docs python org license"),
    "ofl": ("ofl|font", "(?:sil )?open font licen[cs]e|ofl", "1 1", "ofl {v}", "scripts sil org ofl"),
    "cecill": ("cecill", "cecill(?: free software)? licen[cs]e|cecill", "1 0|1 1|2 0|2 1", "cecill {v}", "cecill info licences licence cecill v{v}"),
    "zlib": ("zlib", "zlib(?: libpng)? licen[cs]e", None, "zlib", "zlib net zlib license"),
    "isc": ("isc", "isc licen[cs]e", None, "isc", "opensource org licenses isc"),
    "unlicense": ("unlicense", "the unlicense|unlicense", None, "unlicense", "unlicense org"),
    "wtfpl": ("wtfpl|fuck", "do what the fuck you want to public licen[cs]e|wtfpl", None, "wtfpl", "wtfpl net"),
    "0bsd": ("bsd", "zero clause bsd licen[cs]e|0 clause bsd licen[cs]e", None, "0bsd", "opensource org licenses 0bsd"),
    "bsd-2": ("bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) licen[cs]e", None, "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    "bsd-3": ("bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e", None, "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    "bsd-4": ("bsd", "(?:bsd 4 clause|4 clause bsd|original bsd) licen[cs]e", None, "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    "cc0": ("cc0|zero", "cc0(?: public domain dedication)?|creative commons zero", "1 0", "cc0 {v}", "creativecommons org publicdomain zero {v}"),
    "postgresql": ("postgresql", "postgresql licen[cs]e", None, "postgresql", "opensource org licenses postgresql"),
    "openssl": ("openssl", "openssl licen[cs]e", None, "openssl", "openssl org source license"),
    "php": ("php", "php licen[cs]e", "3 0|3 01", "php {v}", "php net license {v}"),
    "ms-pl": ("microsoft|ms", "microsoft public licen[cs]e", None, "ms pl", "opensource org licenses ms pl"),
    "ms-rl": ("microsoft|ms", "microsoft reciprocal licen[cs]e", None, "ms rl", "opensource org licenses ms rl"),
    "upl": ("upl|universal", "universal permissive licen[cs]e", "1 0", "upl {v}", "opensource org licenses upl"),
    "ncsa": ("ncsa|illinois", "university of illinois ncsa open source licen[cs]e|ncsa licen[cs]e", None, "ncsa", "opensource org licenses ncsa"),
    "busl": ("business|busl", "business source licen[cs]e", "1 1", "busl {v}", "mariadb com bsl11"),
    "sspl": ("server|sspl", "server side public licen[cs]e|sspl", "1", "sspl {v}(?: 0)?", "mongodb com licensing server side public license"),
}
#: Creative Commons conditions, with their words
CC = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: form, priority, confidence; later rules are weaker
FORMS = (("spdx", 90, 0.99), ("expression", 85, 0.9), ("wording", 80, 0.9), ("later", 78, 0.9), ("notice", 75, 0.95), ("url", 70, 0.9), ("versioned", 60, 0.85), ("title", 40, 0.6))


@cache
def rules() -> tuple[Rule, ...]:
    """The signature rules: written ones, SPDX expressions, and each family's names in their forms and versions."""
    out = []

    def add(name: str, label: str, keywords: str, signature: str, priority: int, confidence: float, expression: bool = False) -> None:
        out.append(Rule(name, label, tuple(k.encode() for k in keywords.split("|")), signature, priority, confidence, expression))

    level = {form: (p, c) for form, p, c in FORMS}
    for k, line in enumerate(WORDINGS.strip().splitlines()):
        label, keyword, confidence, signature = (x.strip() for x in line.split(" | "))
        spelled = re.sub(" <any ([0-9]+)> ", r" (?:[^ ]+ ){1,\1}?", signature)
        add(f"{label}:wording-{k}", label, keyword, spelled, level["wording"][0], float(confidence))
    every, several = "|".join(spdx_ids()), "|".join(x for x in spdx_ids() if " " in x)
    single, operator = "|".join(x for x in spdx_ids() if " " not in x), " (?:and|or|with) "
    add("spdx:tag", "", "spdx", f"spdx license identifier (?:{every})(?:{operator}(?:{every}))*", *level["spdx"], expression=True)
    firsts = "|".join(sorted({" ".join(x.split()[:2]) for x in spdx_ids() if " " in x}))
    add("spdx:expression", "", firsts, f"(?:{several})(?:{operator}(?:{every}))+|(?:{single})(?:{operator}(?:{single}))*{operator}(?:{several})(?:{operator}(?:{every}))*", *level["expression"], expression=True)
    for label, (keywords, names, versions, spdx, site) in FAMILIES.items():
        for v in versions.split("|") if versions else [None]:
            own = label if v is None else f"{label}-{re.sub(' 0$', '', re.sub('[^0-9 ]', '', v)).strip().replace(' ', '.')}"
            number = "" if v is None else f" (?:version |v ?|v)?(?:{v})(?: 0)?"
            under = "(?:licen[cs]ed|released|distributed|available|provided|published|made available|covered) (?:under|by) (?:the )?(?:terms of (?:the )?)?"
            add(f"{own}:notice", own, keywords, f"{under}(?:{names}){number}", *level["notice"])
            add(f"{own}:url", own, site.split()[0], f"(?:https? )?(?:www )?{site.format(v=v)}", *level["url"])
            if v is not None:
                add(f"{own}:versioned", own, keywords, f"(?:{names}){number}", *level["versioned"])
                if label in ("gpl", "lgpl", "agpl"):
                    add(f"{own}:or-later", f"{own}-or-later", keywords, f"(?:{under})?(?:{names}){number}(?: of the licen[cs]e)? (?:or (?:at your option )?(?:any )?(?:later|newer|above)|and (?:later|above))(?: versions?)?", *level["later"])
                    add(f"{own}:short", own, label, f"{label}v{v}(?: 0)?", *level["versioned"])
                    add(f"{own}:short-or-later", f"{own}-or-later", label, f"{label}v{v}(?: 0)? or (?:any )?later(?: versions?)?", *level["later"])
        add(f"{label}:title", label, keywords, f"(?:{names})", *level["title"])
    for kind, words in CC.items():
        short = kind.replace("-", " ")
        for v in CC_VERSIONS:
            number = v.replace(" 0", "") if v.endswith(" 0") else v.replace(" ", ".")
            own = f"cc-{kind}-{number}"
            add(f"{own}:notice", own, "cc|commons", f"(?:licen[cs]ed|released|available|published) under (?:a |the )?(?:cc|creative commons) {short} (?:version )?{v}", *level["notice"])
            add(f"{own}:words", own, "commons", f"creative commons {words}(?: international| unported| generic)? (?:version )?{v}", *level["versioned"])
            add(f"{own}:url", own, "creativecommons", f"creativecommons org licenses {short} {v}", *level["url"])
            add(f"{own}:versioned", own, "cc", f"cc {short} (?:version )?{v}", *level["versioned"])
        add(f"cc-{kind}:title", f"cc-{kind}", "cc", f"cc {short}", *level["title"])
        add(f"cc-{kind}:words-title", f"cc-{kind}", "commons", f"creative commons {words}", *level["title"])
    return tuple(sorted(out, key=lambda r: (-r.priority, r.name)))


@cache
def by_keyword() -> dict[bytes, tuple[int, ...]]:
    """Numbers of the rules that a keyword opens."""
    groups: dict[bytes, list[int]] = {}
    for k, rule in enumerate(rules()):
        for keyword in rule.keywords:
            groups.setdefault(keyword, []).append(k)
    return {k: tuple(v) for k, v in groups.items()}


@cache
def keywords() -> ahocorasick.Automaton:
    """Finds all keywords in one pass over a text."""
    out = ahocorasick.Automaton()
    for keyword, numbers in by_keyword().items():
        out.add_word(keyword.decode("latin-1"), numbers)
    out.make_automaton()
    return out


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rule: str
    label: str
    priority: int
    confidence: float


def detections(joined: bytes, numbers: set[int]) -> list[Detection]:
    """All matches of the rules with these numbers."""
    found = []
    for k in sorted(numbers):
        rule = rules()[k]
        for m in rule.pattern.finditer(joined):
            if rule.expression:
                found += [Detection(m.start() + x.start(), m.start() + x.end(), rule.name, spdx_ids()[x[0].decode()], rule.priority, rule.confidence) for x in _spdx_pattern().finditer(m[0])]
            else:
                found.append(Detection(m.start(), m.end(), rule.name, rule.label, rule.priority, rule.confidence))
    return found


def suppressed(found: list[Detection]) -> list[Detection]:
    """By priority, then place, the longer first; one inside an accepted one goes."""
    found = sorted(found, key=lambda x: (-x.priority, x.start, -x.end, -x.confidence, x.rule))
    taken: list[Detection] = []
    starts, ends = [], []  # of the higher priorities: starts in order, the furthest end up to each
    for _, level in groupby(found, key=lambda x: x.priority):
        reach, kept = -1, []
        for x in level:
            above = bisect_right(starts, x.start)
            if max(reach, ends[above - 1] if above else -1) < x.end:
                kept.append(x)
                reach = x.end
        taken += kept
        order = sorted((x.start, x.end) for x in taken)
        starts, ends = [a for a, _ in order], list(accumulate((b for _, b in order), max))
    return sorted(taken, key=lambda x: (x.start, x.end))


def detect(joined: bytes) -> list[Detection]:
    """Detections of the rules of which a keyword stands in the text."""
    opened = {k for _, numbers in keywords().iter(joined.decode("latin-1")) for k in numbers}
    return suppressed(detections(joined, opened)) if opened else []


def scan(text: bytes) -> dict:
    words = text.lower().translate(_SEPARATORS).split()
    joined = b" ".join(words)
    padded = b" " + joined + b" "
    taken = detect(joined)
    hits = []
    for phrase, label in BASE:
        whole, at = b" " + phrase + b" ", -1
        while (at := padded.find(whole, at + 1)) >= 0:
            hits.append((at, label))
    begins = list(accumulate((len(w) + 1 for w in words), initial=0)) if hits or taken else []  # where each word begins
    places, base_labels = [bisect_right(begins, at) - 1 for at, _ in hits], {label for _, label in hits}
    best: dict[str, float] = dict.fromkeys(base_labels, 0.95)
    for x in taken:
        best[x.label] = max(best.get(x.label, 0.0), x.confidence)
    miss = 1.0
    for c in best.values():
        miss *= 1 - c
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(best)), "score": 1 - miss,
        "detections": [{"rule": x.rule, "label": x.label, "first": bisect_right(begins, x.start) - 1, "last": bisect_right(begins, x.end - 1) - 1} for x in taken],
    }


_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("detections", pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))),
])


@F.arrow_udf(RESULT)
def license_scan(text: pa.Array) -> pa.Array:
    return pa.array([scan(x) for x in as_bytes(text)], _ARROW)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id`` and, per document, counts, labels, score and the accepted detections."""
    return docs.select("doc_id", license_scan(F.col("text")).alias("found")).select("doc_id", "found.*")


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
