"""Signatures of licences, written by hand, in order of priority among equals.

A line is: label; tier (3 a grant, a notice or an identifier, 2 a named version, 1 a mention); keyword phrase; expression.
Words are in lower case with one space between; signs are gone, so `Apache-2.0` reads `apache 2 0`. The keyword phrase
stands in everything that the expression matches.
"""

SIGNATURES = """
# MIT and its relatives
mit; 3; permission is hereby granted free of charge; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit; 3; to deal in the software without restriction; to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit; 3; the above copyright notice and this permission notice; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit; 3; the software is provided as is without warranty; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit; 3; in no event shall the authors or copyright holders; in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
mit; 3; spdx license identifier mit; spdx license identifier mit
mit; 3; opensource org licenses mit; (?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php| html)?
mit; 3; mit licen; (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?mit (?:license|licence)
mit; 3; license mit; license mit
mit; 1; mit licen; (?:the )?mit (?:license|licence)
mit; 1; mit lizenz; mit lizenz
mit; 1; licence mit; licence mit
mit; 1; licencia mit; licencia mit
mit; 1; expat license; expat license
mit-0; 3; spdx license identifier mit 0; spdx license identifier mit 0
mit-0; 2; mit no attribution; mit no attribution(?: license)?
x11; 3; the x consortium be liable; in no event shall the x consortium be liable for any claim damages or other liability
x11; 2; x11 license; (?:mit )?x11 license
isc; 3; permission to use copy modify and; permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc; 3; the author disclaims all warranties with regard; the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
isc; 3; spdx license identifier isc; spdx license identifier isc
isc; 1; isc license; (?:the )?isc license
zlib; 3; the origin of this software must not be misrepresented; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib; 3; altered source versions must be plainly marked; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib; 3; permission is granted to anyone to use this software; permission is granted to anyone to use this software for any purpose including commercial applications
zlib; 3; spdx license identifier zlib; spdx license identifier zlib
zlib; 1; zlib; (?:the )?zlib (?:libpng )?license
bsl-1.0; 3; boost software license; distributed under the boost software license version 1 0
bsl-1.0; 3; spdx license identifier bsl 1 0; spdx license identifier bsl 1 0
bsl-1.0; 3; www boost org license 1 0 txt; (?:https? )?www boost org license 1 0 txt
bsl-1.0; 2; boost software license; boost software license (?:version |v)?1 0
bsl-1.0; 1; boost software license; boost software license
# BSD
bsd; 3; redistribution and use in source and binary forms; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd; 3; redistributions of source code must retain; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd; 3; redistributions in binary form must reproduce; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd; 3; this software is provided by the copyright holders; this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd-3-clause; 3; neither the name of; neither the name of (?:the )?(?:[0-9a-z]+ ){1,8}nor the names of its contributors may be used to endorse or promote products
bsd-3-clause; 3; spdx license identifier bsd 3 clause; spdx license identifier bsd 3 clause
bsd-3-clause; 3; opensource org licenses bsd 3 clause; (?:https? )?(?:www )?opensource org licenses bsd 3 clause
bsd-3-clause; 3; governed by a bsd style license; use of this source code is governed by a bsd style license that can be found in the license file
bsd-3-clause; 2; bsd 3 clause; bsd 3 clause(?: license)?
bsd-3-clause; 2; 3 clause bsd; (?:the )?3 clause bsd(?: license)?
bsd-3-clause; 2; three clause bsd; three clause bsd(?: license)?
bsd-3-clause; 2; new bsd license; new bsd license
bsd-3-clause; 2; modified bsd license; modified bsd license
bsd-3-clause; 2; revised bsd license; revised bsd license
bsd-2-clause; 3; spdx license identifier bsd 2 clause; spdx license identifier bsd 2 clause
bsd-2-clause; 3; opensource org licenses bsd 2 clause; (?:https? )?(?:www )?opensource org licenses bsd 2 clause
bsd-2-clause; 2; bsd 2 clause; bsd 2 clause(?: license)?
bsd-2-clause; 2; 2 clause bsd; (?:the )?2 clause bsd(?: license)?
bsd-2-clause; 2; simplified bsd license; simplified bsd license
bsd-2-clause; 2; freebsd license; freebsd license
bsd-4-clause; 3; all advertising materials mentioning features; all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause; 3; spdx license identifier bsd 4 clause; spdx license identifier bsd 4 clause
bsd-4-clause; 2; bsd 4 clause; bsd 4 clause(?: license)?
bsd-4-clause; 2; original bsd license; original bsd license
bsd-4-clause; 2; 4 clause bsd; 4 clause bsd(?: license)?
0bsd; 3; spdx license identifier 0bsd; spdx license identifier 0bsd
0bsd; 2; zero clause bsd; (?:bsd )?zero clause bsd(?: license)?
bsd; 3; bsd; (?:licensed|released|distributed|available) under (?:the |a )?bsd(?: style)? license
bsd; 1; bsd license; (?:the )?bsd license
bsd; 1; bsd style license; bsd style license
bsd; 1; bsd lizenz; bsd lizenz
bsd; 1; licence bsd; licence bsd
# Apache
apache-2.0; 3; licensed under the apache license; licensed under the apache license version 2 0
apache-2.0; 3; you may not use this file except in compliance; you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0; 3; www apache org licenses license 2 0; (?:https? )?www apache org licenses license 2 0(?: txt| html)?
apache-2.0; 3; distributed under the license is distributed; unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0; 3; see the license for the specific language; see the license for the specific language governing permissions and limitations under the license
apache-2.0; 3; licensed to the apache software foundation; licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0; 3; spdx license identifier apache 2 0; spdx license identifier apache 2 0
apache-2.0; 3; opensource org licenses apache 2 0; (?:https? )?(?:www )?opensource org licenses apache 2 0
apache-2.0; 3; apache; (?:released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?apache (?:license|licence) (?:version |v)?2(?: 0)?
apache-2.0; 2; apache license; apache license (?:version |v)?2(?: 0)?
apache-2.0; 2; apache 2; apache 2(?: 0)? (?:license|licence)
apache-2.0; 2; apache software license; apache software license (?:version |v)?2(?: 0)?
apache-1.1; 3; this product includes software developed by the apache; this product includes software developed by the apache software foundation
apache-1.1; 3; spdx license identifier apache 1 1; spdx license identifier apache 1 1
apache-1.1; 2; apache; apache (?:software )?license (?:version )?1 1
apache; 3; apache license; (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache license
apache; 1; apache license; (?:the )?apache license
apache; 1; apache lizenz; apache lizenz
apache; 1; licence apache; licence apache
apache; 1; licencia apache; licencia apache
# GNU General Public License
gpl-3.0-or-later; 3; either version 3; you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later; 3; either version 2; you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl; 3; this program is free software; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl; 3; without even the implied warranty; this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
gpl; 3; received a copy of the gnu general public license; you should have received a copy of the gnu general public license along with this program
gpl; 3; comes with absolutely no warranty; this program comes with absolutely no warranty
gpl; 3; free software and you are welcome to redistribute; this is free software and you are welcome to redistribute it under certain conditions
gpl-3.0; 3; gnu general public license version 3 29 june 2007; gnu general public license version 3 29 june 2007
gpl-2.0; 3; gnu general public license version 2 june 1991; gnu general public license version 2 june 1991
gpl-3.0-or-later; 3; spdx license identifier gpl 3 0; spdx license identifier gpl 3 0 or later
gpl-3.0; 3; spdx license identifier gpl 3 0; spdx license identifier gpl 3 0(?: only)?
gpl-2.0-or-later; 3; spdx license identifier gpl 2 0; spdx license identifier gpl 2 0 or later
gpl-2.0; 3; spdx license identifier gpl 2 0; spdx license identifier gpl 2 0(?: only)?
gpl-1.0; 3; spdx license identifier gpl 1 0; spdx license identifier gpl 1 0(?: only| or later)?
gpl-3.0; 3; general public license; (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?gnu general public license (?:version |v)?3(?: 0)?
gpl-2.0; 3; general public license; (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?gnu general public license (?:version |v)?2(?: 0)?
gpl-3.0; 3; www gnu org licenses gpl 3 0; (?:https? )?www gnu org licenses gpl 3 0(?: html| txt| en html)?
gpl-2.0; 3; www gnu org licenses; (?:https? )?www gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
gpl; 3; www gnu org licenses gpl; (?:https? )?www gnu org licenses gpl(?: html| txt)?
gpl-3.0; 2; general public license; (?:gnu )?general public license (?:version |v)?3(?: 0)?
gpl-2.0; 2; general public license; (?:gnu )?general public license (?:version |v)?2(?: 0)?
gpl-3.0; 2; gplv3; (?:gnu )?gplv3(?: 0)?
gpl-2.0; 2; gplv2; (?:gnu )?gplv2(?: 0)?
gpl-3.0; 2; gpl 3; (?:gnu )?gpl 3(?: 0)?
gpl-2.0; 2; gpl 2; (?:gnu )?gpl 2(?: 0)?
gpl-3.0; 2; gpl v3; (?:gnu )?gpl v3(?: 0)?
gpl-2.0; 2; gpl v2; (?:gnu )?gpl v2(?: 0)?
gpl-3.0; 2; gpl version 3; (?:gnu )?gpl version 3(?: 0)?
gpl-2.0; 2; gpl version 2; (?:gnu )?gpl version 2(?: 0)?
gpl; 1; general public license; (?:gnu )?general public license
gpl; 1; gnu gpl; gnu gpl
gpl; 1; licence publique generale gnu; licence publique generale gnu
gpl; 1; licence publique générale gnu; licence publique générale gnu
gpl; 1; licencia pública general de gnu; licencia pública general de gnu
gpl; 1; allgemeine öffentliche gnu lizenz; allgemeine öffentliche gnu lizenz
gpl-classpath-exception; 3; permission to link this library with independent modules; as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-classpath-exception; 2; classpath exception; (?:gpl )?(?:with )?(?:the )?classpath exception
gcc-runtime-exception; 2; gcc runtime library exception; gcc runtime library exception(?: version 3 1)?
font-exception; 3; embed this font or unaltered portions; if you create a document which uses this font and embed this font or unaltered portions of this font into the document
# Lesser and Affero
lgpl-2.1; 3; received a copy of the gnu lesser general public; you should have received a copy of the gnu lesser general public license along with this library
lgpl; 3; this library is free software; this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl-2.1; 3; spdx license identifier lgpl 2 1; spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0; 3; spdx license identifier lgpl 3 0; spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.0; 3; spdx license identifier lgpl 2 0; spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1; 3; www gnu org licenses; (?:https? )?www gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt| en html)?
lgpl-3.0; 3; www gnu org licenses lgpl 3 0; (?:https? )?www gnu org licenses lgpl 3 0(?: html| txt| en html)?
lgpl-2.1; 2; lesser general public license; (?:gnu )?lesser general public license (?:version |v)?2 1
lgpl-3.0; 2; lesser general public license; (?:gnu )?lesser general public license (?:version |v)?3(?: 0)?
lgpl-2.0; 2; library general public license; (?:gnu )?library general public license(?: version 2(?: 0)?)?
lgpl-2.1; 2; lgplv2 1; (?:gnu )?lgplv2 1
lgpl-3.0; 2; lgplv3; (?:gnu )?lgplv3
lgpl-2.1; 2; lgpl 2 1; (?:gnu )?lgpl 2 1
lgpl-3.0; 2; lgpl 3; (?:gnu )?lgpl 3(?: 0)?
lgpl; 1; lesser general public license; (?:gnu )?lesser general public license
lgpl; 1; gnu lgpl; gnu lgpl
agpl-3.0; 3; under the terms of the gnu affero general public; under the terms of the gnu affero general public license as published by the free software foundation
agpl-3.0; 3; interacting with it remotely through a computer network; all users interacting with it remotely through a computer network
agpl-3.0; 3; spdx license identifier agpl 3 0; spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0; 3; www gnu org licenses agpl; (?:https? )?www gnu org licenses agpl 3 0(?: html| txt| en html)?
agpl-3.0; 2; affero general public license; (?:gnu )?affero general public license (?:version |v)?3(?: 0)?
agpl-1.0; 2; affero general public license; affero general public license version 1
agpl-3.0; 2; agplv3; (?:gnu )?agplv3
agpl-3.0; 2; agpl 3; (?:gnu )?agpl 3(?: 0)?
agpl; 1; affero general public license; (?:gnu )?affero general public license
gfdl; 3; permission is granted to copy distribute and or modify this document; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl; 3; with no invariant sections; with no invariant sections no front cover texts and no back cover texts
gfdl-1.3; 3; spdx license identifier gfdl 1 3; spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1.2; 3; spdx license identifier gfdl 1 2; spdx license identifier gfdl 1 2(?: only| or later)?
gfdl-1.3; 2; free documentation license; (?:gnu )?free documentation license version 1 3
gfdl-1.2; 2; free documentation license; (?:gnu )?free documentation license version 1 2
gfdl; 1; free documentation license; (?:gnu )?free documentation license
gfdl; 1; gnu fdl; gnu fdl
# Mozilla, Eclipse, European and other weak copyleft
mpl-2.0; 3; source code form is subject to the terms of the mozilla; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0; 3; if a copy of the mpl was not distributed; if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0; 3; mozilla org mpl 2 0; (?:https? )?(?:www )?mozilla org mpl 2 0
mpl-2.0; 3; spdx license identifier mpl 2 0; spdx license identifier mpl 2 0
mpl-1.1; 3; the contents of this file are subject to the mozilla; the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1; 3; spdx license identifier mpl 1 1; spdx license identifier mpl 1 1
mpl-2.0; 2; mozilla public license; mozilla public license (?:version |v |v)?2(?: 0)?
mpl-1.1; 2; mozilla public license; mozilla public license (?:version |v |v)?1 1
mpl; 1; mozilla public license; mozilla public license
epl-2.0; 3; accompanying materials are made available under the terms; this program and the accompanying materials are made available under the terms of the eclipse public license (?:version |v |v)?2 0
epl-1.0; 3; accompanying materials are made available under the terms; this program and the accompanying materials are made available under the terms of the eclipse public license (?:version |v |v)?1 0
epl-2.0; 3; www eclipse org legal epl 2 0; (?:https? )?www eclipse org legal epl 2 0
epl-1.0; 3; www eclipse org legal epl v10; (?:https? )?www eclipse org legal epl v10(?: html)?
epl-2.0; 3; spdx license identifier epl 2 0; spdx license identifier epl 2 0
epl-1.0; 3; spdx license identifier epl 1 0; spdx license identifier epl 1 0
epl-2.0; 2; eclipse public license; eclipse public license (?:version |v |v)?2(?: 0)?
epl-1.0; 2; eclipse public license; eclipse public license (?:version |v |v)?1(?: 0)?
epl; 1; eclipse public license; eclipse public license
edl-1.0; 2; eclipse distribution license; eclipse distribution license(?: v 1 0| version 1 0)?
eupl-1.2; 3; licensed under the eupl; licensed under the eupl (?:version |v )?1 2
eupl-1.2; 3; spdx license identifier eupl 1 2; spdx license identifier eupl 1 2
eupl-1.1; 3; spdx license identifier eupl 1 1; spdx license identifier eupl 1 1
eupl-1.2; 2; european union public licen; european union public licen[cs]e (?:version |v )?1 2
eupl-1.1; 2; european union public licen; european union public licen[cs]e (?:version |v )?1 1
eupl; 1; european union public licen; european union public licen[cs]e
cecill-2.1; 2; cecill; cecill(?: free software)? license(?: agreement)? version 2 1
cecill-b; 2; cecill b; cecill b(?: free software)? license
cecill-c; 2; cecill c; cecill c(?: free software)? license
cecill; 3; governed by the cecill; this software is governed by the cecill license under french law
cecill; 1; licence cecill; licence cecill
cddl-1.0; 3; contents of this file are subject to the terms of the common; the contents of this file are subject to the terms of the common development and distribution license
cddl-1.0; 3; spdx license identifier cddl 1 0; spdx license identifier cddl 1 0
cddl-1.1; 3; spdx license identifier cddl 1 1; spdx license identifier cddl 1 1
cddl-1.0; 2; common development and distribution license; common development and distribution license(?: cddl)? version 1 0
cddl; 1; common development and distribution license; common development and distribution license
cpl-1.0; 2; common public license; common public license(?: version 1 0| v1 0)?
ipl-1.0; 2; ibm public license; ibm public license(?: version 1 0)?
osl-3.0; 2; open software license; open software license (?:version |v )?3 0
afl-3.0; 2; academic free license; academic free license (?:version |v )?3 0
afl; 1; academic free license; academic free license
artistic-2.0; 3; spdx license identifier artistic 2 0; spdx license identifier artistic 2 0
artistic-2.0; 2; artistic license; (?:the )?artistic license (?:version )?2(?: 0)?
artistic-1.0; 2; artistic license; (?:the )?artistic license (?:version )?1(?: 0)?
artistic; 1; artistic license; (?:the )?artistic license
artistic; 3; under the same terms as perl itself; you can redistribute it and or modify it under the same terms as perl itself
qpl-1.0; 2; q public license; (?:the )?q public license(?: version 1 0)?
lppl-1.3c; 3; conditions of the latex project public license; this work may be distributed and or modified under the conditions of the latex project public license
lppl; 1; latex project public license; latex project public license
sleepycat; 2; sleepycat license; (?:the )?sleepycat license
vim; 2; vim license; (?:the )?vim license
php-3.01; 3; this product includes php software; this product includes php software freely available from
php-3.01; 2; php license; (?:the )?php license (?:version )?3 01
ruby; 3; under the same terms as ruby; (?:redistribute it|distributed|available) (?:and or modify it )?under the same terms as ruby(?: itself)?
python-2.0; 3; psf is making python available; psf is making python available to licensee on an as is basis
python-2.0; 2; python software foundation license; python software foundation license(?: version 2)?
openssl; 3; software developed by the openssl project; this product includes software developed by the openssl project for use in the openssl toolkit
openssl; 2; openssl license; openssl license
curl; 2; curl license; curl license
ncsa; 3; university of illinois nor the names; neither the names of (?:[0-9a-z]+ ){1,8}university of illinois nor the names of its contributors
ncsa; 2; university of illinois; university of illinois ncsa open source license
w3c; 3; w3c software notice and license; w3c software notice and license
postgresql; 2; postgresql license; (?:the )?postgresql license
unicode; 3; license agreement data files and software; unicode inc license agreement data files and software
icu; 2; icu license; icu license
ofl-1.1; 3; this font software is licensed under the sil open font; this font software is licensed under the sil open font license version 1 1
ofl-1.1; 3; with reserved font name; with reserved font name
ofl-1.1; 3; scripts sil org ofl; (?:https? )?scripts sil org ofl
ofl-1.1; 3; spdx license identifier ofl 1 1; spdx license identifier ofl 1 1
ofl-1.1; 2; open font license; (?:sil )?open font license (?:version |v)?1 1
ofl; 1; open font license; (?:sil )?open font license
bitstream-vera; 2; bitstream vera; bitstream vera fonts copyright
ms-pl; 3; spdx license identifier ms pl; spdx license identifier ms pl
ms-pl; 2; microsoft public license; microsoft public license(?: ms pl)?
ms-rl; 2; microsoft reciprocal license; microsoft reciprocal license(?: ms rl)?
upl-1.0; 2; universal permissive license; universal permissive license(?: v 1 0| version 1 0)?
mulan-2.0; 2; mulan permissive software license; mulan permissive software license(?: v2| version 2)?
ecl-2.0; 2; educational community license; educational community license(?: version 2 0)?
# Public domain
unlicense; 3; free and unencumbered software released; this is free and unencumbered software released into the public domain
unlicense; 3; anyone is free to copy modify publish use; anyone is free to copy modify publish use compile sell or distribute this software
unlicense; 3; unlicense org; (?:https? )?unlicense org
unlicense; 3; spdx license identifier unlicense; spdx license identifier unlicense
unlicense; 2; the unlicense; the unlicense
wtfpl; 3; do what the fuck you want to public license; do what the fuck you want to public license
wtfpl; 2; wtfpl; wtfpl(?: version 2)?
cc0-1.0; 3; waived all copyright and related; has waived all copyright and related or neighboring rights
cc0-1.0; 3; creativecommons org publicdomain zero; (?:https? )?creativecommons org publicdomain zero 1 0
cc0-1.0; 3; spdx license identifier cc0 1 0; spdx license identifier cc0 1 0
cc0-1.0; 2; cc0 1 0; cc0 1 0(?: universal)?
cc0-1.0; 2; creative commons zero; creative commons zero(?: v1 0)?(?: universal)?
cc0-1.0; 1; cc0; cc0(?: license)?
cc-pdm-1.0; 3; creativecommons org publicdomain mark; (?:https? )?creativecommons org publicdomain mark 1 0
cc-pdm-1.0; 2; public domain mark; public domain mark(?: 1 0)?
pddl-1.0; 2; public domain dedication and license; (?:open data commons )?public domain dedication and license(?: pddl)?
public-domain; 3; into the public domain; (?:placed|released|put|dedicated) (?:it |this work |this file |this code )?into the public domain
public-domain; 3; dedicated to the public domain; (?:is |are |has been |hereby )?dedicated to the public domain
public-domain; 3; is in the public domain; (?:this work |this file |this code |it )?is in the public domain
public-domain; 3; no copyright is claimed; no copyright is claimed
public-domain; 3; work of the united states government; (?:is a |as a )?work of the united states government
public-domain; 3; gemeinfrei; (?:ist |sind )?gemeinfrei
public-domain; 3; domaine public; (?:est |sont )?(?:dans le |tombé dans le )?domaine public
public-domain; 3; dominio público; (?:es |está |son )?(?:de |en el )?dominio público
# Creative Commons
cc-by-4.0; 3; under a creative commons attribution 4 0; (?:is )?licensed under a creative commons attribution 4 0 international license
cc-by-sa-4.0; 3; under a creative commons attribution sharealike 4 0; (?:is )?licensed under a creative commons attribution sharealike 4 0 international license
cc-by-sa-3.0; 3; creative commons attribution sharealike 3 0; (?:is )?licensed under (?:a|the) creative commons attribution sharealike 3 0 (?:unported )?license
cc-by-sa; 3; text is available under the creative commons; text is available under the creative commons attribution sharealike license
cc-by-4.0; 3; creativecommons org licenses by 4 0; (?:https? )?creativecommons org licenses by 4 0
cc-by-3.0; 3; creativecommons org licenses by 3 0; (?:https? )?creativecommons org licenses by 3 0
cc-by-2.0; 3; creativecommons org licenses by 2 0; (?:https? )?creativecommons org licenses by 2 0
cc-by-sa-4.0; 3; creativecommons org licenses by sa 4 0; (?:https? )?creativecommons org licenses by sa 4 0
cc-by-sa-3.0; 3; creativecommons org licenses by sa 3 0; (?:https? )?creativecommons org licenses by sa 3 0
cc-by-nc-4.0; 3; creativecommons org licenses by nc 4 0; (?:https? )?creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0; 3; creativecommons org licenses by nc sa 4 0; (?:https? )?creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0; 3; creativecommons org licenses by nc sa 3 0; (?:https? )?creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4.0; 3; creativecommons org licenses by nc nd 4 0; (?:https? )?creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0; 3; creativecommons org licenses by nd 4 0; (?:https? )?creativecommons org licenses by nd 4 0
cc-by-4.0; 3; spdx license identifier cc by 4 0; spdx license identifier cc by 4 0
cc-by-sa-4.0; 3; spdx license identifier cc by sa 4 0; spdx license identifier cc by sa 4 0
cc-by-nc-4.0; 3; spdx license identifier cc by nc 4 0; spdx license identifier cc by nc 4 0
cc-by-nc-sa-4.0; 3; spdx license identifier cc by nc sa 4 0; spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0; 3; spdx license identifier cc by nc nd 4 0; spdx license identifier cc by nc nd 4 0
cc-by-nc-sa-4.0; 2; cc by nc sa 4 0; cc by nc sa 4 0
cc-by-nc-sa-3.0; 2; cc by nc sa 3 0; cc by nc sa 3 0
cc-by-nc-nd-4.0; 2; cc by nc nd 4 0; cc by nc nd 4 0
cc-by-nc-nd-3.0; 2; cc by nc nd 3 0; cc by nc nd 3 0
cc-by-nc-4.0; 2; cc by nc 4 0; cc by nc 4 0
cc-by-nc-3.0; 2; cc by nc 3 0; cc by nc 3 0
cc-by-nd-4.0; 2; cc by nd 4 0; cc by nd 4 0
cc-by-sa-4.0; 2; cc by sa 4 0; cc by sa 4 0
cc-by-sa-3.0; 2; cc by sa 3 0; cc by sa 3 0
cc-by-sa-2.0; 2; cc by sa 2 0; cc by sa 2 0
cc-by-4.0; 2; cc by 4 0; cc by 4 0
cc-by-3.0; 2; cc by 3 0; cc by 3 0
cc-by-2.0; 2; cc by 2 0; cc by 2 0
cc-by-nc-sa-4.0; 2; attribution noncommercial sharealike 4 0; (?:creative commons )?attribution noncommercial sharealike 4 0(?: international)?(?: license)?
cc-by-nc-nd-4.0; 2; attribution noncommercial noderivatives 4 0; (?:creative commons )?attribution noncommercial noderivatives 4 0(?: international)?(?: license)?
cc-by-nc-4.0; 2; attribution noncommercial 4 0; (?:creative commons )?attribution noncommercial 4 0(?: international)?(?: license)?
cc-by-nd-4.0; 2; attribution noderivatives 4 0; (?:creative commons )?attribution noderivatives 4 0(?: international)?(?: license)?
cc-by-sa-4.0; 2; attribution sharealike 4 0; (?:creative commons )?attribution sharealike 4 0(?: international)?(?: license)?
cc-by-sa-3.0; 2; attribution sharealike 3 0; (?:creative commons )?attribution sharealike 3 0(?: unported)?(?: license)?
cc-by-4.0; 2; creative commons attribution 4 0; creative commons attribution 4 0(?: international)?(?: license)?
cc-by-3.0; 2; creative commons attribution 3 0; creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-nc-sa; 1; cc by nc sa; cc by nc sa
cc-by-nc-nd; 1; cc by nc nd; cc by nc nd
cc-by-nc; 1; cc by nc; cc by nc
cc-by-nd; 1; cc by nd; cc by nd
cc-by-sa; 1; cc by sa; cc by sa
cc-by; 1; cc by; cc by
cc-by-sa; 1; namensnennung weitergabe unter gleichen bedingungen; namensnennung weitergabe unter gleichen bedingungen
cc-by; 1; creative commons namensnennung; creative commons namensnennung
cc-by-sa; 1; paternité partage; (?:paternité|attribution) partage dans les mêmes conditions|paternité partage des conditions initiales
cc-by-sa; 1; reconocimiento compartirigual; reconocimiento compartirigual
cc; 1; creative commons; creative commons(?: license| lizenz)?
# Data, models and government works
odbl-1.0; 3; made available under the open database license; made available under the open database license
odbl-1.0; 3; opendatacommons org licenses odbl; (?:https? )?opendatacommons org licenses odbl(?: 1 0)?
odbl-1.0; 2; open database license; (?:odc )?open database license (?:odbl )?(?:version |v)?1 0
odbl; 1; open database license; open database license
odc-by-1.0; 3; made available under the open data commons attribution; made available under the open data commons attribution license
odc-by-1.0; 2; open data commons attribution license; open data commons attribution license(?: v1 0| odc by)?
cdla-permissive-2.0; 2; community data license agreement permissive; community data license agreement permissive(?: version)? 2 0
cdla-sharing-1.0; 2; community data license agreement sharing; community data license agreement sharing(?: version)? 1 0
ogl-uk-3.0; 3; public sector information licensed under the open; contains public sector information licensed under the open government licence v3 0
ogl-uk-3.0; 2; open government licence; open government licence v?3 0
ogl; 1; open government licen; open government licen[cs]e
dl-de-by-2.0; 2; datenlizenz deutschland; datenlizenz deutschland namensnennung(?: version)? 2 0
etalab-2.0; 2; licence ouverte; licence ouverte(?: open licence)?(?: version)? 2 0
openrail; 2; openrail; (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)?
llama-community; 3; community license; (?:meta )?llama [23](?: [0-9])? community license(?: agreement)?
gemma; 3; gemma terms of use; gemma terms of use
# Source available and proprietary
bsl-1.1; 2; business source license; business source license (?:version )?1 1
sspl-1.0; 2; server side public license; server side public license(?: version 1| v1)?
elastic-2.0; 2; elastic license; elastic license (?:version )?2 0
commons-clause; 3; commons clause; commons clause license condition
commons-clause; 1; commons clause; commons clause
polyform-noncommercial-1.0.0; 2; polyform noncommercial license; polyform noncommercial license(?: 1 0 0)?
confluent-community-1.0; 2; confluent community license; confluent community license(?: agreement)?(?: version 1 0)?
redis-source-available; 2; redis source available license; redis source available license
noncommercial; 3; for non commercial; (?:may be used|for use|is free|free of charge|free) (?:only )?for non commercial (?:use|purposes)(?: only)?
noncommercial; 3; for personal use only; for personal use only
noncommercial; 3; keine kommerzielle nutzung; keine kommerzielle nutzung
proprietary; 3; proprietary and confidential; proprietary and confidential
proprietary; 3; confidential and proprietary; confidential and proprietary(?: information)?
proprietary; 3; unauthorized copying of this file; unauthorized copying of this file via any medium is strictly prohibited
proprietary; 3; or transmitted in any form; no part of this (?:publication|book|document) may be reproduced (?:distributed )?or transmitted in any form or by any means
proprietary; 3; without the prior written permission; without the prior written permission of the (?:publisher|author|owner|copyright holder|copyright owner)
proprietary; 3; end user license agreement; (?:this )?end user license agreement
proprietary; 3; subject to the terms of the license agreement; subject to the terms of the license agreement
proprietary; 3; may not be copied reproduced; may not be copied reproduced (?:republished )?(?:modified )?(?:or )?(?:distributed|transmitted)
all-rights-reserved; 1; all rights reserved; all rights reserved
all-rights-reserved; 1; alle rechte vorbehalten; alle rechte vorbehalten
all-rights-reserved; 1; tous droits réservés; tous droits réservés
all-rights-reserved; 1; todos los derechos reservados; todos los derechos reservados
# Notices
copyright; 1; copyright c; copyright c (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?
copyright; 1; copyright; copyright (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?
copyright; 1; copyright holder; copyright holders?
spdx-file-copyright; 3; spdx filecopyrighttext; spdx filecopyrighttext
as-is; 1; provided as is; (?:is |are )?provided as is(?: without warranty(?: of any kind)?)?
no-warranty; 1; without warranty of any kind; without warranty of any kind(?: either express(?:ed)? or implied)?
no-warranty; 1; merchantability; (?:implied )?warrant(?:y|ies) of merchantability(?: and| or)? fitness for a particular purpose
patent-grant; 3; patent license to make have made; (?:perpetual )?worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent license to make have made
trademark-notice; 1; trademark; (?:is a |are )(?:registered )?trademarks? of
"""
