"""Hand-written signatures of licenses, over A-Z lower-cased words with one space between them.

A line is: label | keyword | priority | confidence | pattern | example.  Patterns
are regular expressions of whole words; the keyword is part of every match.
Where the pattern is plain words, it is its own example.  Priorities: 1 a grant
or clause that only this license has, 2 a notice that names its license, 3 a
sentence that several licenses share, 4 a mere mention.
"""

from __future__ import annotations

TEXT = r"""
mit | permission is hereby | 1 | 0.97 | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | copyright notice | 1 | 0.95 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | without restriction | 1 | 0.95 | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit | permit persons | 1 | 0.9 | to permit persons to whom the software is furnished to do so subject to the following conditions
mit | software | 2 | 0.85 | the software is provided as is without warranty of any kind express or implied
mit | noninfringement | 2 | 0.8 | (?:merchantability )?fitness for a particular purpose and noninfringement | merchantability fitness for a particular purpose and noninfringement
mit | authors or copyright holders | 2 | 0.85 | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit | license | 2 | 0.9 | (?:released|licensed|available|distributed) under the (?:terms of the )?(?:mit|expat|x11) licen[sc]e | released under the terms of the mit license
mit-0 | mit no attribution | 2 | 0.9 | mit no attribution(?: license)? | mit no attribution license
x11 | x consortium | 1 | 0.9 | except as contained in this notice the name of the x consortium shall not be used in advertising
isc | permission to use | 1 | 0.97 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | author disclaims | 1 | 0.95 | the author disclaims all warranties with regard to this software
isc | disclaims all warranties | 2 | 0.8 | disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
isc | action of contract | 3 | 0.7 | whether in an action of contract negligence or other tortious action
isc | license | 2 | 0.9 | (?:the )?isc licen[sc]e | the isc license
0bsd | zero clause bsd | 2 | 0.95 | (?:bsd )?zero clause bsd(?: license)? | zero clause bsd license
0bsd | permission to use | 1 | 0.9 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd | redistribution and use | 1 | 0.97 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | redistributions of source | 1 | 0.92 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions in binary | 1 | 0.92 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd-3-clause | endorse or promote | 1 | 0.95 | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software | neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-3-clause | endorse or promote | 2 | 0.85 | may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising materials | 1 | 0.95 | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | copyright holders and contributors | 2 | 0.9 | this software is provided by the copyright holders and contributors as is
bsd | the regents of the university | 2 | 0.85 | (?:copyright )?the regents of the university of california | the regents of the university of california
bsd | substitute goods | 3 | 0.7 | procurement of substitute goods or services
bsd | license | 2 | 0.9 | (?:licensed|released|distributed) under (?:the|a) (?:[234] clause |new |simplified |modified )?bsd(?: style)? licen[sc]e | released under the simplified bsd license
bsd | bsd style | 4 | 0.6 | bsd style license
apache-2.0 | apache license | 1 | 0.98 | licensed under the apache license version 2 0
apache-2.0 | apache org licenses | 1 | 0.95 | (?:http|https) (?:www )?apache org licenses(?: license 2 0)? | http www apache org licenses license 2 0
apache-2.0 | compliance with the license | 1 | 0.9 | you may not use this file except in compliance with the license
apache-2.0 | copy of the license | 2 | 0.85 | you may obtain a copy of the license at
apache-2.0 | unless required by applicable law | 1 | 0.92 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | contributor license agreements | 1 | 0.9 | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | grant of patent license | 2 | 0.8 | grant of patent license
apache-2.0 | grant of copyright license | 2 | 0.8 | grant of copyright license
apache-1.1 | apache software foundation | 1 | 0.9 | this product includes software developed by the apache software foundation
apache | apache | 3 | 0.7 | apache licensed
gpl | free software you can | 1 | 0.95 | this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0-or-later | any later version | 1 | 0.95 | either version 2 of the license or at your option any later version
gpl-3.0-or-later | any later version | 1 | 0.95 | either version 3 of the license or at your option any later version
gpl | any later version | 3 | 0.7 | or at your option any later version
gpl | useful but without | 1 | 0.9 | distributed in the hope that it will be useful but without any warranty
gpl | implied warranty | 2 | 0.8 | without even the implied warranty of merchantability or fitness for a particular purpose
gpl | received a copy of the gnu | 1 | 0.9 | you should have received a copy of the gnu general public license along with this (?:program|file|software) | you should have received a copy of the gnu general public license along with this program
gpl | gnu org licenses | 1 | 0.9 | (?:http|https) www gnu org licenses(?: gpl(?: [23] 0)?(?: html)?)? | http www gnu org licenses gpl 3 0 html
gpl-2.0 | temple place | 2 | 0.85 | 59 temple place suite 330 boston ma 02111 1307
gpl-2.0 | franklin street | 2 | 0.85 | 51 franklin (?:street|st) fifth floor boston ma 02110 1301 | 51 franklin street fifth floor boston ma 02110 1301
gpl-2.0 | general public license | 2 | 0.92 | (?:gnu )?general public license version 2 only | gnu general public license version 2 only
gpl-2.0 | gplv2 | 2 | 0.9 | (?:licensed under )?gplv2(?: only| or later)? | licensed under gplv2 or later
gpl-3.0 | gplv3 | 2 | 0.9 | (?:licensed under )?gplv3(?: only| or later)? | licensed under gplv3
gpl | verbatim copies | 2 | 0.85 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | licenses for most software | 2 | 0.8 | the licenses for most software are designed to take away your freedom to share and change it
gpl-2.0-classpath | linking exception | 1 | 0.9 | classpath (?:linking )?exception | classpath linking exception
gpl | copyleft | 4 | 0.5 | copyleft(?: license)? | copyleft license
lgpl | lesser general public | 1 | 0.95 | under the terms of the gnu lesser general public license as published by the free software foundation
lgpl | lesser general public | 1 | 0.9 | you should have received a copy of the gnu lesser general public license along with this (?:library|program) | you should have received a copy of the gnu lesser general public license along with this library
lgpl-2.0 | library general public | 1 | 0.95 | gnu library general public license(?: version 2)? | gnu library general public license version 2
lgpl-2.1 | version 2 1 of the license | 1 | 0.93 | either version 2 1 of the license or at your option any later version
lgpl-2.1 | lgplv2 | 2 | 0.9 | lgplv2(?: 1)?(?: or later)? | lgplv2 1 or later
lgpl-3.0 | lgplv3 | 2 | 0.9 | lgplv3(?: or later)? | lgplv3
lgpl | combined work | 2 | 0.8 | you may convey a combined work under terms of your choice
agpl-3.0 | affero general public | 1 | 0.96 | under the terms of the gnu affero general public license as published by the free software foundation
agpl-3.0 | remote network interaction | 1 | 0.9 | remote network interaction use with the gnu general public license
agpl-3.0 | agplv3 | 2 | 0.9 | agplv3(?: or later)? | agplv3 or later
agpl-3.0 | interacting with it remotely | 1 | 0.9 | all users interacting with it remotely through a computer network
fdl-1.3 | free documentation license | 1 | 0.95 | (?:gnu )?free documentation license(?: version 1 [123])? | gnu free documentation license version 1 3
fdl-1.3 | invariant sections | 1 | 0.92 | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | mozilla public license | 1 | 0.97 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mozilla org mpl | 1 | 0.95 | you can obtain one at (?:http|https) (?:www )?mozilla org mpl 2 0 | you can obtain one at https mozilla org mpl 2 0
mpl-2.0 | incompatible with secondary licenses | 1 | 0.9 | this source code form is incompatible with secondary licenses
mpl-1.1 | mozilla public license | 1 | 0.95 | the contents of this file are subject to the mozilla public license version 1 1
mpl | covered software | 2 | 0.8 | distribution of source form all distribution of covered software in source code form
epl-1.0 | eclipse public license | 1 | 0.95 | eclipse public license v(?:ersion)? ?1 0 | eclipse public license v1 0
epl-2.0 | eclipse public license | 1 | 0.95 | this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? ?2 0 | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl | eclipse org legal | 1 | 0.92 | (?:http|https) www eclipse org legal epl(?: v[12]0| 2 0)?(?: html)? | http www eclipse org legal epl v10 html
edl-1.0 | eclipse distribution license | 1 | 0.95 | eclipse distribution license(?: v| version)? ?1 0 | eclipse distribution license v 1 0
cpl-1.0 | common public license | 1 | 0.95 | common public license(?: v| version)? ?1 0 | common public license version 1 0
ipl-1.0 | ibm public license | 1 | 0.95 | ibm public license(?: version)? 1 0 | ibm public license version 1 0
cddl-1.0 | common development and distribution | 1 | 0.96 | the contents of this file are subject to the terms of the common development and distribution license
cddl-1.0 | cddl | 2 | 0.85 | cddl(?: 1 [01])? | cddl 1 0
eupl-1.2 | european union public | 1 | 0.96 | european union public licen[cs]e(?: v| version)? ?(?:1 [012])? | european union public licence version 1 2
eupl-1.2 | eupl | 2 | 0.85 | licensed under the eupl(?: v?1 2)?(?: or later)? | licensed under the eupl 1 2 or later
cecill | cecill | 1 | 0.92 | (?:governed by the )?cecill(?: [bc])?(?: free software)? licen[sc]e | governed by the cecill free software license
ms-pl | microsoft public license | 1 | 0.95 | microsoft public license(?: ms pl)? | microsoft public license ms pl
ms-rl | microsoft reciprocal license | 1 | 0.95 | microsoft reciprocal license(?: ms rl)? | microsoft reciprocal license ms rl
afl-3.0 | academic free license | 1 | 0.95 | academic free license(?: version| v)? ?(?:[123] [01])? | academic free license version 3 0
osl-3.0 | open software license | 1 | 0.95 | open software license(?: version| v)? ?(?:[123] [01])? | open software license version 3 0
artistic-1.0 | artistic license | 1 | 0.9 | the clarified artistic license
artistic-2.0 | artistic license | 1 | 0.95 | the artistic license 2 0
perl | as perl itself | 1 | 0.92 | (?:you can redistribute it and or modify it )?under the same terms as perl(?: [56])? itself | under the same terms as perl itself
ruby | ruby license | 2 | 0.85 | (?:same|under the) (?:license as ruby|ruby license) | under the ruby license
php-3.01 | php license | 1 | 0.92 | this source file is subject to version 3 01? of the php license | this source file is subject to version 3 01 of the php license
python-2.0 | python software foundation | 1 | 0.95 | psf license agreement for (?:the )?python software foundation|python software foundation license version 2 | python software foundation license version 2
zlib | warranty in no event | 1 | 0.95 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | altered source versions | 1 | 0.95 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | origin of this software | 1 | 0.95 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng | libpng license | 1 | 0.92 | (?:the )?(?:png reference library|libpng) license(?: version 2)? | the libpng license version 2
curl | curl license | 2 | 0.85 | (?:the )?curl license | the curl license
boost-1.0 | boost software license | 1 | 0.97 | distributed under the boost software license version 1 0
boost-1.0 | machine executable object code | 1 | 0.95 | solely in the form of machine executable object code generated by a source language processor
openssl | openssl toolkit | 1 | 0.95 | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic software written by | 1 | 0.95 | this product includes cryptographic software written by eric young
ofl-1.1 | sil open font license | 1 | 0.97 | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | reserved font name | 1 | 0.92 | (?:with )?reserved font names? | with reserved font name
ofl-1.1 | scripts sil org | 1 | 0.9 | (?:http|https) scripts sil org ofl | http scripts sil org ofl
unicode | unicode license | 1 | 0.92 | unicode license(?: agreement)?(?: v3)? | unicode license v3
icu | icu license | 1 | 0.9 | icu license
wtfpl | do what the fuck | 1 | 0.97 | do what the fuck you want to public license
unlicense | unencumbered software | 1 | 0.97 | this is free and unencumbered software released into the public domain
unlicense | unlicense org | 1 | 0.92 | (?:http|https) unlicense org | https unlicense org
unlicense | relinquishment in perpetuity | 1 | 0.95 | overt act of relinquishment in perpetuity of all present and future rights
cc0 | no rights reserved | 1 | 0.92 | cc0 no rights reserved
cc0 | creative commons zero | 1 | 0.95 | creative commons zero(?: v1 0)?(?: universal)? | creative commons zero v1 0 universal
cc0 | publicdomain zero | 1 | 0.95 | creativecommons org publicdomain zero 1 0
cc0 | waived all copyright | 1 | 0.95 | has waived all copyright and related or neighboring rights
public-domain | public domain mark | 2 | 0.9 | public domain mark(?: 1 0)? | public domain mark 1 0
public-domain | public domain | 2 | 0.9 | (?:this|the) (?:work|file|code|software|text|image) is in the public domain | this work is in the public domain
public-domain | public domain | 2 | 0.85 | no copyright (?:is )?claimed .{0,30}?public domain | no copyright is claimed and it is in the public domain
public-domain | united states government | 2 | 0.85 | (?:is )?a work of the united states government and (?:is )?(?:not subject to copyright|in the public domain) | a work of the united states government and is not subject to copyright
cc-by-4.0 | creativecommons org licenses | 1 | 0.95 | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons org licenses | 1 | 0.95 | creativecommons org licenses by 3 0
cc-by-sa-4.0 | creativecommons org licenses | 1 | 0.95 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons org licenses | 1 | 0.95 | creativecommons org licenses by sa 3 0
cc-by-nc | creativecommons org licenses | 1 | 0.95 | creativecommons org licenses by nc [1-4] 0 | creativecommons org licenses by nc 4 0
cc-by-nd | creativecommons org licenses | 1 | 0.95 | creativecommons org licenses by nd [1-4] 0 | creativecommons org licenses by nd 4 0
cc-by-nc-sa | creativecommons org licenses | 1 | 0.95 | creativecommons org licenses by nc sa [1-4] 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd | creativecommons org licenses | 1 | 0.95 | creativecommons org licenses by nc nd [1-4] 0 | creativecommons org licenses by nc nd 4 0
cc-by | creative commons | 1 | 0.95 | licensed under a creative commons attribution (?:[1-4] 0 )?(?:international |unported |generic )?license | licensed under a creative commons attribution 4 0 international license
cc-by-sa | creative commons | 1 | 0.95 | licensed under a creative commons attribution share ?alike (?:[1-4] 0 )?(?:international |unported |generic )?license | licensed under a creative commons attribution sharealike 4 0 international license
cc-by-nc | creative commons | 1 | 0.95 | licensed under a creative commons attribution non ?commercial (?:[1-4] 0 )?(?:international |unported |generic )?license | licensed under a creative commons attribution noncommercial 4 0 international license
cc-by-nc-sa | creative commons | 1 | 0.95 | creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: international| unported)?(?: license)? | creative commons attribution noncommercial sharealike 4 0 international license
cc-by-nc-nd | creative commons | 1 | 0.95 | creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] 0)?(?: international| unported)?(?: license)? | creative commons attribution noncommercial noderivatives 4 0 international license
cc-by | creative commons | 2 | 0.8 | creative commons attribution license
cc | creative commons | 3 | 0.7 | (?:under|with) a creative commons license | under a creative commons license
cc | creative commons corporation | 2 | 0.8 | creative commons corporation is not a law firm and does not provide legal services
cc-by-sa | wikipedia | 2 | 0.85 | text is available under the creative commons attribution share ?alike license .{0,40}?wikipedia|wikipedia .{0,60}?creative commons attribution share ?alike | text is available under the creative commons attribution sharealike license from wikipedia
odbl-1.0 | open database license | 1 | 0.96 | open (?:data commons )?(?:open )?database license(?: odbl)?(?: v?1 0)? | open database license odbl v1 0
odbl-1.0 | openstreetmap contributors | 2 | 0.85 | (?:copyright |c )?openstreetmap contributors | openstreetmap contributors
odc-by-1.0 | open data commons attribution | 1 | 0.95 | open data commons attribution license(?: v?1 0)? | open data commons attribution license v1 0
pddl-1.0 | public domain dedication and license | 1 | 0.95 | public domain dedication and licen[sc]e(?: pddl)?(?: v?1 0)? | public domain dedication and license pddl v1 0
cdla-permissive-2.0 | community data license | 1 | 0.95 | community data license agreement permissive(?: version)? [12] 0 | community data license agreement permissive version 2 0
cdla-sharing-1.0 | community data license | 1 | 0.95 | community data license agreement sharing(?: version)? 1 0 | community data license agreement sharing version 1 0
ogl-3.0 | open government licence | 1 | 0.96 | (?:contains public sector information licensed under the )?open government licence(?: v| version)? ?(?:[123] 0)? | contains public sector information licensed under the open government licence v3 0
etalab-2.0 | licence ouverte | 1 | 0.95 | licence ouverte(?: etalab)?(?: version)?(?: 2 0)? | licence ouverte etalab version 2 0
dl-de-by-2.0 | datenlizenz deutschland | 1 | 0.95 | datenlizenz deutschland (?:namensnennung|zero)(?: version)? 2 0 | datenlizenz deutschland namensnennung version 2 0
openrail | responsible ai license | 1 | 0.92 | (?:open )?responsible ai licenses?(?: openrail)? | open responsible ai license openrail
openrail-m | openrail | 2 | 0.88 | (?:bigscience |creativeml )?(?:open ?)?rail ?\+?\+? ?m(?: license)?|openrail(?:\+\+)?(?: m)? | openrail m
busl-1.1 | business source license | 1 | 0.96 | business source license(?: version)?(?: 1 1)? | business source license 1 1
busl-1.1 | change date | 2 | 0.85 | effective on the change date or the fourth anniversary
sspl-1.0 | server side public license | 1 | 0.96 | server side public license(?: v| version)? ?(?:1)? | server side public license version 1
elastic-2.0 | elastic license | 1 | 0.95 | elastic license(?: version)?(?: 2 0)? | elastic license 2 0
commons-clause | commons clause | 1 | 0.95 | commons clause(?: license)? condition|commons clause license | commons clause license condition
polyform | polyform | 1 | 0.93 | polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license(?: 1 0 0)? | polyform noncommercial license 1 0 0
jsonlicense | good not evil | 1 | 0.97 | the software shall be used for good not evil
beerware | beer | 1 | 0.95 | (?:the )?beer ?ware license(?: revision 42)?|buy me a beer in return | the beer ware license revision 42
upl-1.0 | universal permissive license | 1 | 0.95 | universal permissive license(?: v| version)? ?1 0 | universal permissive license v 1 0
ncsa | university of illinois | 1 | 0.95 | university of illinois(?: ncsa)? open source license | university of illinois ncsa open source license
w3c | w3c software | 1 | 0.93 | w3c software (?:notice and )?(?:and document )?(?:notice and )?license | w3c software notice and license
vim | vim license | 1 | 0.9 | vim license
postgresql | postgresql | 1 | 0.93 | (?:the )?postgresql licen[cs]e | the postgresql licence
llvm-exception | llvm exceptions | 1 | 0.95 | apache license v(?:ersion)? ?2 0 with llvm exceptions | apache license v2 0 with llvm exceptions
latex | latex project public license | 1 | 0.95 | latex project public license(?: version)?(?: 1 [0-3][ac]?)? | latex project public license version 1 3c
mulan | mulan | 1 | 0.93 | mulan psl v[12]|mulan permissive software license(?: version)? [12] | mulan permissive software license version 2
blueoak | blue oak | 1 | 0.93 | blue oak model license(?: 1 0 0)? | blue oak model license 1 0 0
opl | open publication license | 1 | 0.92 | open publication license(?: v?1 0)? | open publication license v1 0
gutenberg | project gutenberg | 1 | 0.95 | (?:under the terms of )?the project gutenberg license(?: included with this ebook)? | under the terms of the project gutenberg license included with this ebook
gutenberg | project gutenberg | 2 | 0.8 | this ebook is for the use of anyone anywhere (?:in the united states .{0,90}?)?at no cost .{0,120}?project gutenberg|project gutenberg tm | project gutenberg tm
arxiv | arxiv org | 2 | 0.85 | arxiv org (?:perpetual )?non ?exclusive license | arxiv org perpetual non exclusive license
spdx | spdx license identifier | 1 | 0.98 | spdx license identifier [a-z0-9]+(?: [0-9]+){0,3}(?: only| or later)? | spdx license identifier mit
reserved | rights reserved | 3 | 0.7 | copyright(?: c)?(?: [12][0-9]{3})+ .{1,60}?all rights reserved | copyright c 2020 acme inc all rights reserved
reserved | rights reserved | 3 | 0.7 | (?:alle rechte vorbehalten|tous droits r[^ ]{1,2}serv[^ ]{1,2}s|todos los derechos reservados) .{0,20}?rights reserved|all rights reserved worldwide | all rights reserved worldwide
reserved | alle rechte | 3 | 0.7 | alle rechte vorbehalten
reserved | tous droits | 3 | 0.7 | tous droits r.serv.s | tous droits réservés
reserved | todos los derechos | 3 | 0.7 | todos los derechos reservados
reserved | tutti i diritti | 3 | 0.7 | tutti i diritti riservati
reserved | todos os direitos | 3 | 0.7 | todos os direitos reservados
proprietary | confidential | 2 | 0.85 | (?:this (?:document|file|software) is )?(?:strictly )?confidential and proprietary | this document is confidential and proprietary
proprietary | written consent | 2 | 0.8 | without the (?:express |prior )?written consent of | without the prior written consent of
proprietary | reproduced | 2 | 0.8 | no part of this (?:publication|book|document|work) may be reproduced | no part of this publication may be reproduced
proprietary | unauthorized | 2 | 0.8 | unauthorized (?:copying|reproduction|use|distribution)(?: of this file)? (?:via any medium )?is strictly prohibited | unauthorized copying of this file via any medium is strictly prohibited
proprietary | trade secret | 3 | 0.7 | (?:contains|constitutes?) (?:valuable )?trade secrets? | contains trade secrets
proprietary | license agreement | 3 | 0.7 | end user license agreement
proprietary | license agreement | 3 | 0.7 | subject to the terms (?:and conditions )?of (?:the|a|your) license agreement | subject to the terms and conditions of the license agreement
proprietary | evaluation | 3 | 0.6 | for evaluation purposes only
non-commercial | commercial | 3 | 0.7 | for (?:personal and )?non ?commercial use only | for non commercial use only
non-commercial | commercial | 3 | 0.7 | (?:may not be used for|not for) commercial (?:purposes|use) | may not be used for commercial purposes
non-commercial | research | 3 | 0.6 | for (?:academic|research) (?:and research )?(?:purposes|use) only | for academic and research purposes only
non-commercial | personal use | 3 | 0.6 | for personal use only
fair-use | fair use | 4 | 0.5 | (?:under|constitutes?|considered) fair use | considered fair use
royalty-free | royalty free | 3 | 0.7 | (?:worldwide |perpetual |non ?exclusive |irrevocable |no charge )+royalty free | perpetual worldwide non exclusive no charge royalty free
royalty-free | royalty free | 4 | 0.5 | royalty free license
no-derivatives | derivative works | 3 | 0.7 | (?:no|without) derivative works | no derivative works
attribution | attribution | 4 | 0.5 | attribution (?:is )?required | attribution is required
dual | dual licensed | 2 | 0.8 | dual licensed under .{1,60}? and .{1,30}? | dual licensed under mit and apache
license-file | license | 3 | 0.6 | see (?:the )?(?:accompanying |included )?licen[sc]e(?: txt| md)?(?: file)? (?:for|in the root|in this) | see the accompanying license file for
license-file | license | 3 | 0.6 | (?:found|included) in the licen[sc]e file | found in the license file
license-file | copying | 3 | 0.6 | see (?:the file )?copying(?: lesser)? for (?:the )?(?:license|copying conditions|details) | see the file copying for copying conditions
warranty-disclaimer | warrant | 3 | 0.7 | (?:makes|make) no (?:representations or )?warranties | makes no representations or warranties
warranty-disclaimer | warrant | 3 | 0.7 | express or implied warranties
warranty-disclaimer | as is | 3 | 0.6 | provided (?:on an )?as is(?: basis)? | provided on an as is basis
liability | liable | 3 | 0.6 | in no event shall .{1,80}? be liable | in no event shall the author be liable
liability | consequential damages | 3 | 0.7 | (?:incidental|special|indirect) .{0,30}?consequential damages | incidental or consequential damages
copyright | copyright | 4 | 0.5 | copyright notice
copyright | copyright | 4 | 0.5 | (?:portions )?copyright (?:c )?by | portions copyright by
copyright | copyrighted | 4 | 0.5 | copyrighted (?:material|work|content) | copyrighted material
trademark | trademark | 4 | 0.4 | (?:registered )?trademarks? of | registered trademark of
"""


def signatures() -> list[tuple[str, str, str, int, float, str]]:
    """(label, keyword, pattern, priority, confidence, example) of every line, in order."""
    out = []
    for line in TEXT.strip().splitlines():
        label, keyword, priority, confidence, pattern = (x.strip() for x in line.split(" | ")[:5])
        example = line.split(" | ")[5].strip() if line.count(" | ") > 4 else pattern
        out.append((label, keyword, pattern, int(priority), float(confidence), example))
    return out
