"""Signatures of licenses: regular expressions over words in lower case with one space between, and what they mean.

A line is ``label | keyword | tier | expression``. The keyword is a string that each match holds. Tiers rank detections: 1 identifiers and
sentences of a license's own text, 2 notices that put a work under a license, 3 names with a version, 4 bare names, 5 hints. The order of the lines
ranks rules of one tier. Marks are no words: ``2.0`` is ``2 0`` and ``CC-BY`` is ``cc by``. An expression may match 64 words at most, and holds one of :data:`STEMS`.
"""

from __future__ import annotations

from typing import NamedTuple

#: Every match holds one of these, so a text without them needs no rules.
STEMS = ("licen", "copyright", "warrant", "redistribut", "permission", "public domain", "creative commons", "gnu ", "copyleft", "rights reserved", "unencumbered", "terms of", "gpl", "wtfpl")
#: Words that the longest match may have.
MOST_WORDS = 64
#: How sure a detection of each tier is.
WEIGHTS = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.6, 5: 0.3}

_LINES = r"""
apache-2.0 | apache | 1 | spdx license identifier apache 2 0
apache-1.1 | apache | 1 | spdx license identifier apache 1 1
apache-1.0 | apache | 1 | spdx license identifier apache 1 0
mit-0 | mit | 1 | spdx license identifier mit 0
mit | mit | 1 | spdx license identifier mit
bsd-2-clause | bsd | 1 | spdx license identifier bsd 2 clause
bsd-3-clause | bsd | 1 | spdx license identifier bsd 3 clause
bsd-4-clause | bsd | 1 | spdx license identifier bsd 4 clause
bsd-1-clause | bsd | 1 | spdx license identifier bsd 1 clause
0bsd | 0bsd | 1 | spdx license identifier 0bsd
isc | isc | 1 | spdx license identifier isc
gpl-1.0-or-later | gpl | 1 | spdx license identifier gpl 1 0(?: or later)?
gpl-2.0-or-later | gpl | 1 | spdx license identifier gpl 2 0 or later
gpl-2.0-only | gpl | 1 | spdx license identifier gpl 2 0(?: only)?
gpl-3.0-or-later | gpl | 1 | spdx license identifier gpl 3 0 or later
gpl-3.0-only | gpl | 1 | spdx license identifier gpl 3 0(?: only)?
lgpl-2.0-or-later | lgpl | 1 | spdx license identifier lgpl 2 0(?: or later| only)?
lgpl-2.1-or-later | lgpl | 1 | spdx license identifier lgpl 2 1 or later
lgpl-2.1-only | lgpl | 1 | spdx license identifier lgpl 2 1(?: only)?
lgpl-3.0-or-later | lgpl | 1 | spdx license identifier lgpl 3 0 or later
lgpl-3.0-only | lgpl | 1 | spdx license identifier lgpl 3 0(?: only)?
agpl-3.0-or-later | agpl | 1 | spdx license identifier agpl 3 0 or later
agpl-3.0-only | agpl | 1 | spdx license identifier agpl 3 0(?: only)?
mpl-1.1 | mpl | 1 | spdx license identifier mpl 1 1
mpl-2.0 | mpl | 1 | spdx license identifier mpl 2 0
epl-1.0 | epl | 1 | spdx license identifier epl 1 0
epl-2.0 | epl | 1 | spdx license identifier epl 2 0
cddl-1.0 | cddl | 1 | spdx license identifier cddl 1 0
cddl-1.1 | cddl | 1 | spdx license identifier cddl 1 1
eupl-1.1 | eupl | 1 | spdx license identifier eupl 1 1
eupl-1.2 | eupl | 1 | spdx license identifier eupl 1 2
cc0-1.0 | cc0 | 1 | spdx license identifier cc0 1 0
cc-by-3.0 | cc by | 1 | spdx license identifier cc by 3 0
cc-by-4.0 | cc by | 1 | spdx license identifier cc by 4 0
cc-by-sa-3.0 | cc by sa | 1 | spdx license identifier cc by sa 3 0
cc-by-sa-4.0 | cc by sa | 1 | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | cc by nc | 1 | spdx license identifier cc by nc 4 0
cc-by-nc-sa-4.0 | cc by nc sa | 1 | spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | cc by nc nd | 1 | spdx license identifier cc by nc nd 4 0
cc-by-nd-4.0 | cc by nd | 1 | spdx license identifier cc by nd 4 0
unlicense | unlicense | 1 | spdx license identifier unlicense
wtfpl | wtfpl | 1 | spdx license identifier wtfpl
zlib | zlib | 1 | spdx license identifier zlib
bsl-1.0 | bsl | 1 | spdx license identifier bsl 1 0
artistic-2.0 | artistic | 1 | spdx license identifier artistic 2 0
ofl-1.1 | ofl | 1 | spdx license identifier ofl 1 1
python-2.0 | python | 1 | spdx license identifier python 2 0
ncsa | ncsa | 1 | spdx license identifier ncsa
postgresql | postgresql | 1 | spdx license identifier postgresql
busl-1.1 | busl | 1 | spdx license identifier busl 1 1
sspl-1.0 | sspl | 1 | spdx license identifier sspl 1 0
elastic-2.0 | elastic | 1 | spdx license identifier elastic 2 0
mulanpsl-2.0 | mulanpsl | 1 | spdx license identifier mulanpsl 2 0
upl-1.0 | upl | 1 | spdx license identifier upl 1 0
odbl-1.0 | odbl | 1 | spdx license identifier odbl 1 0
mit | permission | 1 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission | 1 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | furnished | 1 | to permit persons to whom the software is furnished to do so the software is provided as is without warranty of any kind
warranty-disclaimer-mit | merchantability | 2 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
bsd-2-clause | redistribution | 1 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | endorse | 1 | neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | endorse | 1 | the names? of (?:\S+ ){1,12}may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising | 1 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment(?: \S+){0,30} (?:copyright|license|rights reserved)
isc | permission | 1 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | permission | 1 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
zlib | warranty | 1 | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib | permission | 1 | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
bsl-1.0 | permission | 1 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
postgresql | permission | 1 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | permission | 1 | permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted
ncsa | permission | 1 | to deal with the software without restriction including without limitation the rights to use copy (?:\S+ ){0,30}permission
apache-2.0 | perpetual | 1 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 | apache | 1 | apache license version 2 0 january 2004
apache-2.0 | warranties | 1 | distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language
apache-1.1 | apache | 1 | the end user documentation included with the redistribution if any must include the following acknowledge?ment(?: \S+){0,12} apache
gpl-3.0 | gnu | 1 | gnu general public license version 3 29 june 2007
gpl-2.0 | gnu | 1 | gnu general public license version 2 june 1991
lgpl-3.0 | gnu | 1 | gnu lesser general public license version 3 29 june 2007
lgpl-2.1 | gnu | 1 | gnu lesser general public license version 2 1 february 1999
lgpl-2.0 | gnu | 1 | gnu library general public license version 2 june 1991
agpl-3.0 | gnu | 1 | gnu affero general public license version 3 19 november 2007
gfdl-1.3 | gnu | 1 | gnu free documentation license version 1 3 3 november 2008
gfdl-1.2 | gnu | 1 | gnu free documentation license version 1 2 november 2002
gpl-3.0 | copyleft | 1 | the gnu general public license is a free copyleft license for software and other kinds of works
agpl-3.0 | copyleft | 1 | the gnu affero general public license is a free copyleft license for software and other kinds of works
gpl-2.0 | everyone | 1 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
unlicense | unencumbered | 1 | this is free and unencumbered software released into the public domain
wtfpl | do what | 1 | do what the f[a-z]* you want to public license
mpl-2.0 | mozilla | 1 | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-1.1 | mozilla | 1 | the contents of this file are subject to the mozilla public license version 1 1
cddl-1.0 | cddl | 1 | the contents of this file are subject to the terms of the common development and distribution license(?: \S+){0,8} cddl
epl-1.0 | eclipse | 1 | the accompanying program is provided under the terms of this eclipse public license
cc0-1.0 | waive | 1 | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright
cc0-1.0 | cc0 | 1 | the person who associated a work with this deed has dedicated the work to the public domain(?: \S+){0,40} cc0
ofl-1.1 | font | 1 | this font software is licensed under the sil open font license version 1 1
artistic-2.0 | artistic | 1 | the artistic license 2 0 copyright c 2000 2006
python-2.0 | python | 1 | psf hereby grants licensee a nonexclusive royalty free world wide license(?: \S+){0,20} python
json | evil | 1 | the software shall be used for good not evil(?: \S+){0,20} (?:warranty|copyright|permission)
beerware | beer | 1 | beer ware license revision 42
apache-2.0 | apache | 2 | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?license (?:version |v)?2(?: 0)?
apache-2.0 | apache | 2 | apache license (?:version |v)?2(?: 0)? the license you may not use this file except in compliance with the license
apache-1.1 | apache | 2 | (?:licensed|released|distributed) under (?:the )?apache software license version 1 1
mit | mit | 2 | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?mit license
mit | mit | 2 | this (?:project|software|work|code|package|library|repository) is (?:\S+ ){0,3}(?:licensed|under) (?:\S+ ){0,3}mit license
mit | expat | 2 | (?:licensed|released|distributed) under the expat license
bsd-2-clause | bsd | 2 | (?:licensed|released|distributed) under (?:the )?(?:simplified|2 clause|two clause|free) bsd license
bsd-3-clause | bsd | 2 | (?:licensed|released|distributed) under (?:the )?(?:new|modified|revised|3 clause|three clause) bsd(?: style)? license
bsd-4-clause | bsd | 2 | (?:licensed|released|distributed) under (?:the )?(?:original|4 clause|four clause) bsd license
bsd | bsd | 2 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |a )?bsd(?: style)? license
isc | isc | 2 | (?:licensed|released|distributed) under (?:the )?isc license
zlib | zlib | 2 | (?:licensed|released|distributed) under (?:the )?zlib(?: libpng)? license
bsl-1.0 | boost | 2 | distributed under the boost software license version 1 0
gpl-3.0-or-later | general public license | 2 | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later | general public license | 2 | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2.0-only | general public license | 2 | gnu general public license version 2 as published by the free software foundation
gpl-3.0-only | general public license | 2 | gnu general public license version 3 as published by the free software foundation
gpl-3.0 | general public license | 2 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?gnu (?:gpl )?general public license (?:gpl )?(?:version |v)?3(?: 0)?
gpl-2.0 | general public license | 2 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?gnu (?:gpl )?general public license (?:gpl )?(?:version |v)?2(?: 0)?
gpl-3.0 | gpl | 2 | (?:licensed|released|distributed) under (?:the )?(?:gnu )?gpl ?(?:version |v)?3(?: 0)?
gpl-3.0 | gplv3 | 2 | (?:licensed|released|distributed) under (?:the )?(?:gnu )?gplv3
gpl-2.0 | gplv2 | 2 | (?:licensed|released|distributed) under (?:the )?(?:gnu )?gplv2
lgpl-2.1-or-later | lesser general public license | 2 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later | lesser general public license | 2 | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-3.0 | lesser general public license | 2 | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?gnu lesser general public license (?:lgpl )?(?:version |v)?3(?: 0)?
lgpl-2.1 | lesser general public license | 2 | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?gnu lesser general public license (?:lgpl )?(?:version |v)?2 1
agpl-3.0-or-later | affero general public license | 2 | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3.0 | affero general public license | 2 | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?gnu affero general public license (?:agpl )?(?:version |v)?3(?: 0)?
gfdl-1.3 | free documentation license | 2 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
gfdl-1.2 | free documentation license | 2 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
mpl-2.0 | mozilla | 2 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mozilla public license (?:version |v)?2(?: 0)?
mpl-1.1 | mozilla | 2 | (?:licensed|released|distributed) under (?:the )?mozilla public license version 1 1
epl-2.0 | eclipse | 2 | made available under the terms of the eclipse public license (?:v|version )?2(?: 0)?
epl-1.0 | eclipse | 2 | made available under the terms of the eclipse public license v1 0
cc-by-nc-nd-4.0 | nc nd | 2 | licensed under (?:a |the )?(?:creative commons )?(?:cc )?by nc nd 4 0(?: international)?
cc-by-nc-sa-4.0 | nc sa | 2 | licensed under (?:a |the )?(?:creative commons )?(?:cc )?by nc sa 4 0(?: international)?
cc-by-nc-4.0 | by nc | 2 | licensed under (?:a |the )?(?:creative commons )?(?:cc )?by nc 4 0(?: international)?
cc-by-nd-4.0 | by nd | 2 | licensed under (?:a |the )?(?:creative commons )?(?:cc )?by nd 4 0(?: international)?
cc-by-sa-4.0 | by sa | 2 | licensed under (?:a |the )?(?:creative commons )?(?:cc )?by sa 4 0(?: international)?
cc-by-sa-3.0 | by sa | 2 | licensed under (?:a |the )?(?:creative commons )?(?:cc )?by sa 3 0(?: unported)?
cc-by-4.0 | cc by | 2 | licensed under (?:a |the )?(?:creative commons )?cc by 4 0(?: international)?
cc-by-3.0 | cc by | 2 | licensed under (?:a |the )?(?:creative commons )?cc by 3 0(?: unported)?
cc-by-nc-nd-4.0 | noderivatives | 2 | creative commons attribution noncommercial noderivatives 4 0(?: international)?(?: public)? license
cc-by-nc-sa-4.0 | noncommercial sharealike | 2 | creative commons attribution noncommercial sharealike 4 0(?: international)?(?: public)? license
cc-by-nc-4.0 | noncommercial | 2 | creative commons attribution noncommercial 4 0(?: international)?(?: public)? license
cc-by-nd-4.0 | noderivatives | 2 | creative commons attribution noderivatives 4 0(?: international)?(?: public)? license
cc-by-sa-4.0 | alike | 2 | creative commons attribution share ?alike 4 0(?: international)?(?: public)? license
cc-by-sa-3.0 | sharealike | 2 | creative commons attribution sharealike 3 0(?: unported)? license
cc-by-4.0 | attribution | 2 | creative commons attribution 4 0(?: international)?(?: public)? license
cc-by-3.0 | attribution | 2 | creative commons attribution 3 0(?: unported)? license
cc0-1.0 | public domain | 2 | (?:dedicated|released|placed) (?:to|into|in) the public domain (?:under|using|by) (?:\S+ ){0,3}cc0(?: 1 0)?
public-domain | public domain | 2 | (?:has been|is|are|was) (?:hereby )?(?:dedicated|released|placed|put) (?:to|into|in) the public domain
unlicense | unlicense | 2 | (?:licensed|released) under the unlicense
wtfpl | wtfpl | 2 | (?:licensed|released) under (?:the )?wtfpl
artistic-2.0 | artistic | 2 | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?artistic license (?:version )?2(?: 0)?
perl | perl | 2 | under the same terms as perl itself(?: \S+){0,20} (?:license|copyright|redistribute)
perl | perl | 2 | free software you can redistribute it and or modify it under the same terms as perl
ofl-1.1 | open font | 2 | licensed under the (?:sil )?open font license(?: version)? 1 1
elastic-2.0 | elastic | 2 | licensed under the elastic license(?: version)? 2(?: 0)?
busl-1.1 | business source | 2 | licensed under the business source license(?: version)? 1 1
sspl-1.0 | server side public | 2 | licensed under the server side public license(?: version)? 1
mulanpsl-2.0 | mulan | 2 | licensed under mulan psl v2
odbl-1.0 | open database | 2 | (?:licensed|available) under the open database license
proprietary | proprietary | 2 | this (?:software|document|material|work) is (?:the )?(?:confidential and )?proprietary (?:\S+ ){0,12}(?:license|permission|rights reserved|copyright)
proprietary | permission | 2 | (?:may not|no part of this \S+ may) be (?:reproduced|copied|distributed)(?: \S+){0,20} without (?:the )?(?:prior )?(?:express )?(?:written )?permission
gpl-2.0-or-later | gpl | 3 | gpl (?:version |v)?2 or (?:\S+ )?later(?: \S+){0,4} license
gpl-3.0-or-later | gpl | 3 | gpl (?:version |v)?3 or (?:\S+ )?later(?: \S+){0,4} license
apache-2.0 | apache | 3 | apache (?:software )?license(?: version)? v?2(?: 0)?
apache-2.0 | apache | 3 | apache 2(?: 0)? license
apache-1.1 | apache | 3 | apache (?:software )?license(?: version)? 1 1
apache-1.0 | apache | 3 | apache (?:software )?license(?: version)? 1 0
gpl-3.0 | general public license | 3 | (?:gnu )?general public license(?: gpl)?(?: version)? v?3(?: 0)?
gpl-2.0 | general public license | 3 | (?:gnu )?general public license(?: gpl)?(?: version)? v?2(?: 0)?
gpl-1.0 | general public license | 3 | (?:gnu )?general public license(?: gpl)?(?: version)? v?1(?: 0)?
lgpl-3.0 | lesser | 3 | (?:gnu )?lesser general public license(?: lgpl)?(?: version)? v?3(?: 0)?
lgpl-2.1 | lesser | 3 | (?:gnu )?lesser general public license(?: lgpl)?(?: version)? v?2 1
lgpl-2.0 | library general | 3 | (?:gnu )?library general public license(?: lgpl)?(?: version)? v?2(?: 0)?
agpl-3.0 | affero | 3 | (?:gnu )?affero general public license(?: agpl)?(?: version)? v?3(?: 0)?
mpl-2.0 | mozilla | 3 | mozilla public license(?: mpl)?(?: version)? v?2(?: 0)?
mpl-1.1 | mozilla | 3 | mozilla public license(?: mpl)?(?: version)? v?1 1
epl-2.0 | eclipse | 3 | eclipse public license(?: epl)?(?: version)? v?2(?: 0)?
epl-1.0 | eclipse | 3 | eclipse public license(?: epl)?(?: version)? v?1 0
eupl-1.2 | european union | 3 | european union public licen[cs]e(?: version)? v?1 2
eupl-1.1 | european union | 3 | european union public licen[cs]e(?: version)? v?1 1
bsd-2-clause | bsd | 3 | (?:simplified|2 clause|two clause) bsd licen[cs]e
bsd-2-clause | bsd | 3 | bsd 2 clause (?:\S+ )?licen[cs]e
bsd-3-clause | bsd | 3 | (?:new|modified|revised|3 clause|three clause) bsd licen[cs]e
bsd-3-clause | bsd | 3 | bsd 3 clause (?:\S+ )?licen[cs]e
artistic-2.0 | artistic | 3 | artistic licen[cs]e(?: version)? 2(?: 0)?
artistic-1.0 | artistic | 3 | artistic licen[cs]e(?: version)? 1(?: 0)?
bsl-1.0 | boost | 3 | boost software licen[cs]e(?: version)? 1 0
cddl-1.0 | common development | 3 | common development and distribution licen[cs]e(?: cddl)?(?: version)? v?1 0
cpl-1.0 | common public | 3 | common public licen[cs]e(?: version)? v?1 0
ofl-1.1 | open font | 3 | (?:sil )?open font licen[cs]e(?: version)? 1 1
cc0-1.0 | creative commons | 3 | creative commons (?:zero|cc0)(?: v?1 0)?(?: universal)?
cc-by-nc-sa | commercial | 4 | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | commercial | 4 | creative commons attribution non ?commercial no ?derivatives
cc-by-nc | commercial | 4 | creative commons attribution non ?commercial
cc-by-nd | derivatives | 4 | creative commons attribution no ?derivatives
cc-by-sa | share | 4 | creative commons attribution share ?alike
cc-by | attribution | 4 | creative commons attribution
agpl | affero | 4 | (?:gnu )?affero general public licen[cs]e
lgpl | lesser | 4 | (?:gnu )?lesser general public licen[cs]e
lgpl | library general | 4 | (?:gnu )?library general public licen[cs]e
gpl | general public | 4 | (?:gnu )?general public licen[cs]e
gfdl | free documentation | 4 | (?:gnu )?free documentation licen[cs]e
gpl | gnu gpl | 4 | gnu gpl
mit | mit | 4 | mit licen[cs]e
mit | x11 | 4 | mit x11 licen[cs]e
x11 | x11 | 4 | x11 licen[cs]e
apache | apache | 4 | apache (?:software )?licen[cs]e
bsd | bsd | 4 | bsd(?: style)? licen[cs]e
isc | isc | 4 | isc licen[cs]e
zlib | zlib | 4 | zlib(?: libpng)? licen[cs]e
mpl | mozilla | 4 | mozilla public licen[cs]e
epl | eclipse | 4 | eclipse public licen[cs]e
cddl | common development | 4 | common development and distribution licen[cs]e
eupl | european union | 4 | european union public licen[cs]e
artistic | artistic | 4 | artistic licen[cs]e
bsl-1.0 | boost | 4 | boost software licen[cs]e
python | python | 4 | python software foundation licen[cs]e
php | php | 4 | php licen[cs]e
ruby | ruby | 4 | ruby licen[cs]e
openssl | openssl | 4 | openssl licen[cs]e
ofl | open font | 4 | open font licen[cs]e
odbl | open database | 4 | open database licen[cs]e
odc-by | open data commons | 4 | open data commons attribution licen[cs]e
unlicense | unlicense | 4 | the unlicense
postgresql | postgresql | 4 | postgresql licen[cs]e
ncsa | ncsa | 4 | (?:university of illinois )?ncsa open source licen[cs]e
ms-pl | microsoft | 4 | microsoft public licen[cs]e
ms-rl | microsoft | 4 | microsoft reciprocal licen[cs]e
apsl | apple | 4 | apple public source licen[cs]e
intel | intel | 4 | intel open source licen[cs]e
ibm-pl | ibm | 4 | ibm public licen[cs]e
sspl | server side | 4 | server side public licen[cs]e
busl | business source | 4 | business source licen[cs]e
elastic | elastic | 4 | elastic licen[cs]e
commons-clause | commons clause | 4 | commons clause licen[cs]e
openrail | rail | 4 | (?:creativeml )?open ?rail(?: m| \+\+ m)? licen[cs]e
llama | llama | 4 | llama (?:\d )?(?:\d )?community licen[cs]e
creative-commons | creative commons | 5 | creative commons
public-domain | public domain | 5 | public domain
copyleft | copyleft | 5 | copyleft
all-rights-reserved | rights reserved | 5 | all rights reserved
copyright-notice | copyright | 5 | copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?
unknown-license | ed under | 5 | licen[cs]ed under
unknown-license | licen | 5 | (?:this|the|following|see|end user|open source|free software) licen[cs]e(?: agreement| file| terms)?
unknown-license | terms of | 5 | under the terms of (?:the |this )?(?:\S+ ){0,4}licen[cs]e
warranty-disclaimer | warranty | 5 | without (?:any )?warranty
warranty-disclaimer | warranties | 5 | (?:without|no) (?:any )?(?:express or implied )?warranties
"""


class Rule(NamedTuple):
    number: int
    label: str
    keyword: str
    tier: int
    pattern: str  # over words with a space of their own on both sides


def _rules() -> tuple[Rule, ...]:
    out = []
    for line in _LINES.strip().splitlines():
        label, keyword, tier, expression = (part.strip() for part in line.split(" | "))
        out.append(Rule(len(out), label, keyword.replace(" ", "  "), int(tier), " (?:" + expression.replace(" ?", "@").replace(" ", "  ").replace("@", "(?:  )?") + ") "))
    return tuple(out)


RULES = _rules()
