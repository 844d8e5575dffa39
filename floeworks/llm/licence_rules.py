"""The rules of the licence scan, written by hand: one a line, as label; priority; confidence; keyword; expression.

Expressions run over normalised text (words in lower case, one space between them) and cover whole words. The
keywords are whole words, one of which is in every text that the expression fits (`|` between them). Priorities: 1 weak mentions, 2 names, 3 names with a
version, 4 notices, 5 identifiers and URLs, 6 and 7 licence texts and the most special names.
"""

RULES = """
# creative commons
cc-by; 2; 0.8; cc; cc by
cc-by-4.0; 3; 0.95; cc; cc by 4 0( international)?
cc-by-3.0; 3; 0.95; cc; cc by 3 0( unported)?
cc-by-2.5; 3; 0.95; cc; cc by 2 5
cc-by-2.0; 3; 0.95; cc; cc by 2 0( generic)?
cc-by-1.0; 3; 0.9; cc; cc by 1 0
cc-by-sa; 3; 0.9; cc; cc by sa
cc-by-sa-4.0; 4; 0.95; cc; cc by sa 4 0( international)?
cc-by-sa-3.0; 4; 0.95; cc; cc by sa 3 0( unported)?
cc-by-sa-2.5; 4; 0.95; cc; cc by sa 2 5
cc-by-sa-2.0; 4; 0.95; cc; cc by sa 2 0
cc-by-nd; 3; 0.9; cc; cc by nd
cc-by-nd-4.0; 4; 0.95; cc; cc by nd 4 0( international)?
cc-by-nc; 3; 0.9; cc; cc by nc
cc-by-nc-4.0; 4; 0.95; cc; cc by nc 4 0( international)?
cc-by-nc-3.0; 4; 0.95; cc; cc by nc 3 0
cc-by-nc-sa; 4; 0.9; cc; cc by nc sa
cc-by-nc-sa-4.0; 5; 0.95; cc; cc by nc sa 4 0( international)?
cc-by-nc-sa-3.0; 5; 0.95; cc; cc by nc sa 3 0
cc-by-nc-nd; 4; 0.9; cc; cc by nc nd
cc-by-nc-nd-4.0; 5; 0.95; cc; cc by nc nd 4 0( international)?
cc0; 2; 0.8; cc; cc (0|zero)
cc0; 2; 0.8; cc0; cc0
cc0-1.0; 3; 0.95; cc0; cc0 1 0( universal)?
cc0; 6; 1.0; waives; affirmer hereby (overtly fully permanently irrevocably and unconditionally )?waives
cc0; 6; 1.0; dedicated; dedicated the work to the public domain by waiving all of his or her rights
cc-by; 4; 0.9; attribution; creative commons attribution( [1-4] [05])?( international| unported| generic)?( public)? licen[cs]e
cc-by-sa; 5; 0.9; sharealike; creative commons attribution sharealike( [1-4] [05])?( international| unported| generic)?( public)?( licen[cs]e)?
cc-by-sa; 5; 0.9; share; creative commons attribution share alike( [1-4] [05])?( international| unported)?( licen[cs]e)?
cc-by-nd; 5; 0.9; noderivs|noderivatives; creative commons attribution noderiv(s|atives)( [1-4] [05])?( international| unported)?( licen[cs]e)?
cc-by-nd; 5; 0.9; derivs|derivatives; creative commons attribution no deriv(s|atives)( [1-4] [05])?( licen[cs]e)?
cc-by-nc; 5; 0.9; noncommercial; creative commons attribution noncommercial( [1-4] [05])?( international| unported)?( licen[cs]e)?
cc-by-nc; 5; 0.9; commercial; creative commons attribution non commercial( [1-4] [05])?( international| unported)?( licen[cs]e)?
cc-by-nc-sa; 6; 0.9; noncommercial; creative commons attribution noncommercial share ?alike( [1-4] [05])?( international| unported)?( licen[cs]e)?
cc-by-nc-nd; 6; 0.9; noncommercial; creative commons attribution noncommercial no ?deriv(s|atives)( [1-4] [05])?( international| unported)?( licen[cs]e)?
cc-by; 5; 1.0; creativecommons; creativecommons org licenses by( [1-4] [05])?
cc-by-sa; 6; 1.0; creativecommons; creativecommons org licenses by sa( [1-4] [05])?
cc-by-nd; 6; 1.0; creativecommons; creativecommons org licenses by nd( [1-4] [05])?
cc-by-nc; 6; 1.0; creativecommons; creativecommons org licenses by nc( [1-4] [05])?
cc-by-nc-sa; 7; 1.0; creativecommons; creativecommons org licenses by nc sa( [1-4] [05])?
cc-by-nc-nd; 7; 1.0; creativecommons; creativecommons org licenses by nc nd( [1-4] [05])?
cc0; 6; 1.0; creativecommons; creativecommons org publicdomain zero 1 0
public-domain; 6; 1.0; creativecommons; creativecommons org publicdomain mark 1 0
creative-commons; 1; 0.6; creative; creative commons( licen[cs]ed?)?
cc-by; 6; 0.9; adapt; you are free to share and adapt the material for any purpose even commercially
# gnu
gpl; 1; 0.7; gpl; gpl
gpl; 2; 0.8; gpl; gnu gpl
gpl-1; 3; 0.9; gpl|gpl1|gplv1|gplv; (gnu )?gpl ?v? ?1( 0)?
gpl-2; 3; 0.9; gpl; (gnu )?gpl (v|version )?2( 0)?
gpl-2; 3; 0.9; gplv2; gplv2
gpl-2+; 4; 0.95; gplv2; gplv2 or later
gpl-2+; 4; 0.95; gpl; (gnu )?gpl (v|version )?2( 0)? (plus|or later|or any later version)
gpl-3; 3; 0.9; gpl; (gnu )?gpl (v|version )?3( 0)?
gpl-3; 3; 0.9; gplv3; gplv3
gpl-3+; 4; 0.95; gplv3; gplv3 or later
gpl-3+; 4; 0.95; gpl; (gnu )?gpl (v|version )?3( 0)? (plus|or later|or any later version)
gpl; 2; 0.8; general; (gnu )?general public licen[cs]e
gpl-1; 3; 0.9; general; (gnu )?general public licen[cs]e( v| version)? 1( 0)?
gpl-2; 3; 0.9; general; (gnu )?general public licen[cs]e( v| version)? 2( 0)?
gpl-2; 3; 0.9; general; version 2 of the (gnu )?general public licen[cs]e
gpl-3; 3; 0.9; general; (gnu )?general public licen[cs]e( v| version)? 3( 0)?
gpl-3; 3; 0.9; general; version 3 of the (gnu )?general public licen[cs]e
gpl; 4; 0.95; redistribute; you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl-2+; 6; 1.0; redistribute; redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
gpl-3+; 6; 1.0; redistribute; redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
gpl-2; 6; 1.0; redistribute; redistribute it and or modify it under the terms of the gnu general public licen[cs]e version 2( only)? as published by the free software foundation
gpl; 5; 0.95; received; you should have received a copy of the gnu general public licen[cs]e
gpl; 5; 0.95; freedom; the licenses for most software are designed to take away your freedom to share and change it
gpl-3; 6; 1.0; copyleft; the gnu general public license is a free copyleft license for software and other kinds of works
gpl-2; 5; 1.0; spdx; spdx license identifier gpl 2 0( only)?
gpl-2+; 6; 1.0; spdx; spdx license identifier gpl 2 0 or later
gpl-3; 5; 1.0; spdx; spdx license identifier gpl 3 0( only)?
gpl-3+; 6; 1.0; spdx; spdx license identifier gpl 3 0 or later
gpl; 4; 1.0; gnu; gnu org (licenses|licences|copyleft) gpl( html| txt)?
gpl-3; 5; 1.0; gnu; gnu org licenses gpl 3 0
gpl-2; 5; 1.0; gnu; gnu org licenses (old licenses )?gpl 2 0
gpl-classpath; 6; 1.0; exception; as a special exception the copyright holders of this (library|software) give you permission to link
gpl-bison; 6; 0.95; bison; as a special exception you may create a larger work that contains part or all of the bison parser skeleton
lgpl; 2; 0.8; lgpl; (gnu )?lgpl
lgpl-2.1; 3; 0.9; lgpl; (gnu )?lgpl (v|version )?2 1
lgpl-3; 3; 0.9; lgpl; (gnu )?lgpl (v|version )?3( 0)?
lgpl-2.1; 3; 0.9; lgplv2; lgplv2 1
lgpl-3; 3; 0.9; lgplv3; lgplv3
lgpl; 3; 0.85; lesser; (gnu )?lesser general public licen[cs]e
lgpl-2.1; 4; 0.95; lesser; (gnu )?lesser general public licen[cs]e( v| version)? 2 1
lgpl-3; 4; 0.95; lesser; (gnu )?lesser general public licen[cs]e( v| version)? 3( 0)?
lgpl; 3; 0.85; library; gnu library general public licen[cs]e
lgpl-2; 4; 0.95; library; gnu library general public licen[cs]e( v| version)? 2( 0)?
lgpl-2.1+; 6; 1.0; lesser; gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version
lgpl-3+; 6; 1.0; lesser; gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
lgpl; 5; 0.95; lesser; you should have received a copy of the gnu lesser general public licen[cs]e
lgpl-2.1; 5; 1.0; spdx; spdx license identifier lgpl 2 1( only| or later)?
lgpl-3; 5; 1.0; spdx; spdx license identifier lgpl 3 0( only| or later)?
lgpl; 5; 1.0; gnu; gnu org (licenses|copyleft) lgpl( html| txt)?
agpl; 2; 0.8; agpl; (gnu )?agpl
agpl-3; 3; 0.9; agpl; (gnu )?agpl (v|version )?3( 0)?
agpl-3; 3; 0.9; agplv3; agplv3
agpl; 3; 0.85; affero; (gnu )?affero general public licen[cs]e
agpl-1; 4; 0.9; affero; affero general public licen[cs]e( v| version)? 1( 0)?
agpl-3; 4; 0.95; affero; (gnu )?affero general public licen[cs]e( v| version)? 3( 0)?
agpl-3+; 6; 1.0; affero; gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
agpl; 5; 0.95; affero; you should have received a copy of the gnu affero general public licen[cs]e
agpl-3; 5; 1.0; spdx; spdx license identifier agpl 3 0( only| or later)?
agpl; 5; 1.0; gnu; gnu org licenses agpl( 3 0)?( html| txt)?
gfdl; 2; 0.8; gfdl; (gnu )?gfdl
gfdl; 3; 0.9; documentation; (gnu )?free documentation licen[cs]e( version 1 [1-3])?
gfdl; 6; 1.0; invariant; with no invariant sections no front cover texts and no back cover texts
gfdl; 5; 1.0; gnu; gnu org (licenses|copyleft) fdl( html| txt)?
gnu-all-permissive; 6; 1.0; permitted; copying and distribution of this file with or without modification are permitted in any medium without royalty
# mit family
mit; 2; 0.8; mit; mit licen[cs]ed?
mit; 4; 0.95; mit; licen[cs]ed under (the )?(terms of (the )?)?mit( x11)?( licen[cs]e)?
mit; 4; 0.95; mit; (released|distributed|available|published) under (the )?(terms of (the )?)?mit( x11)?( licen[cs]e)?
mit; 3; 0.9; mit; see the mit licen[cs]e
mit; 3; 0.9; expat; expat licen[cs]e
mit; 3; 0.9; x11; x11 licen[cs]e
mit; 5; 1.0; spdx; spdx license identifier mit
mit; 5; 1.0; opensource; opensource org licen[cs]es? mit( license)?( php| html)?
mit; 6; 1.0; permission; permission is hereby granted free of charge to any person obtaining a copy
mit; 5; 0.95; deal; to deal in the software without restriction
mit; 5; 0.95; substantial; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit; 5; 0.9; noninfringement; merchantability fitness for a particular purpose and noninfringement
mit-0; 4; 0.95; attribution; mit no attribution
mit-0; 6; 1.0; spdx; spdx license identifier mit 0
mit-advertising; 5; 0.9; advertising; except as contained in this notice the name(s)? of [a-z0-9 ]{1,60} shall not be used in advertising
ncsa; 3; 0.9; illinois; (university of )?illinois( ncsa)? open source licen[cs]e
ncsa; 5; 1.0; spdx; spdx license identifier ncsa
ncsa; 6; 0.95; deal; to deal with the software without restriction
isc; 2; 0.8; isc; isc licen[cs]ed?
isc; 4; 0.95; isc; licen[cs]ed under (the )?(terms of (the )?)?isc( licen[cs]e)?
isc; 5; 1.0; spdx; spdx license identifier isc
isc; 5; 1.0; opensource; opensource org licen[cs]es? isc( license)?
isc; 6; 1.0; permission; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc; 5; 0.95; permission; permission to use copy modify and or distribute this software for any purpose
hpnd; 6; 0.95; permission; permission to use copy modify and distribute this software and its documentation for any purpose
0bsd; 5; 1.0; spdx; spdx license identifier 0bsd
0bsd; 3; 0.9; zero; zero clause bsd( licen[cs]e)?
zlib; 2; 0.8; zlib; zlib( libpng)? licen[cs]ed?
zlib; 5; 1.0; spdx; spdx license identifier zlib
zlib; 6; 1.0; misrepresented; the origin of this software must not be misrepresented
zlib; 6; 0.95; altered; altered source versions must be plainly marked as such
libpng; 3; 0.9; libpng; libpng licen[cs]e
curl; 3; 0.9; curl; curl licen[cs]e
curl; 5; 1.0; spdx; spdx license identifier curl
icu; 3; 0.9; icu; icu licen[cs]e
unicode; 3; 0.9; unicode; unicode (data files|inc) licen[cs]e( agreement)?
unicode; 5; 1.0; spdx; spdx license identifier unicode( dfs 2016| 3 0)?
# bsd family
bsd; 2; 0.8; bsd; bsd( style)? licen[cs]ed?
bsd; 4; 0.9; bsd; licen[cs]ed under (the |a )?(terms of (the )?)?bsd( style)?( licen[cs]e)?
bsd; 4; 0.9; bsd; (released|distributed|available) under (the |a )?(terms of (the )?)?bsd( style)?( licen[cs]e)?
bsd-2; 3; 0.9; clause; bsd 2 clause( licen[cs]e)?
bsd-3; 3; 0.9; clause; bsd 3 clause( licen[cs]e)?
bsd-4; 3; 0.9; clause; bsd 4 clause( licen[cs]e)?
bsd-2; 3; 0.9; clause; (2|two) clause bsd( licen[cs]e)?
bsd-3; 3; 0.9; clause; (3|three) clause bsd( licen[cs]e)?
bsd-4; 3; 0.9; clause; (4|four) clause bsd( licen[cs]e)?
bsd-2; 3; 0.9; simplified; simplified bsd( licen[cs]e)?
bsd-2; 3; 0.9; freebsd; freebsd licen[cs]e
bsd-3; 3; 0.9; bsd; (new|modified|revised) bsd( licen[cs]e)?
bsd; 3; 0.8; berkeley; berkeley software distribution( licen[cs]e)?
bsd-2; 5; 1.0; spdx; spdx license identifier bsd 2 clause
bsd-3; 5; 1.0; spdx; spdx license identifier bsd 3 clause
bsd-4; 5; 1.0; spdx; spdx license identifier bsd 4 clause
bsd; 5; 1.0; opensource; opensource org licen[cs]es? bsd( license)?( php)?
bsd-2; 5; 1.0; opensource; opensource org licen[cs]es? bsd 2 clause
bsd-3; 5; 1.0; opensource; opensource org licen[cs]es? bsd 3 clause
bsd; 6; 1.0; redistribution; redistribution and use in source and binary forms with or without modification
bsd; 5; 0.9; redistributions; redistributions of source code must retain the above copyright notice
bsd; 5; 0.9; redistributions; redistributions in binary form must reproduce the above copyright notice
bsd-3; 6; 0.95; endorse; neither the name of [a-z0-9 ]{1,80} may be used to endorse or promote products
bsd-4; 6; 0.95; advertising; all advertising materials mentioning features or use of this software must display
bsd-clear; 6; 0.95; patent; no express or implied licenses to any party s patent rights are granted
# apache
apache; 2; 0.8; apache; apache( software)? licen[cs]ed?
apache-1.0; 3; 0.9; apache; apache( software)? licen[cs]e( v| version)? 1 0
apache-1.1; 3; 0.9; apache; apache( software)? licen[cs]e( v| version)? 1 1
apache-2.0; 3; 0.9; apache; apache( software)? licen[cs]e( v| version)? 2( 0)?
apache-2.0; 3; 0.9; apache; apache 2 0( licen[cs]ed?)?
apache-2.0; 4; 0.95; apache; licen[cs]ed under (the )?(terms of (the )?)?apache( software)?( licen[cs]e)?( v| version)? 2 0
apache-2.0; 6; 1.0; apache; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache; 5; 0.95; compliance; you may not use this file except in compliance with the license
apache-2.0; 5; 1.0; spdx; spdx license identifier apache 2 0
apache-2.0; 5; 1.0; apache; apache org licenses license 2 0( txt| html)?
apache; 4; 0.95; apache; licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0; 6; 1.0; perpetual; perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-1.1; 6; 0.95; apache; this product includes software developed by the apache software foundation
ecl-2.0; 3; 0.9; educational; educational community licen[cs]e( version)? 2 0
# weak copyleft and others with names
mpl; 2; 0.8; mozilla; mozilla public licen[cs]e
mpl-1.1; 3; 0.9; mozilla; mozilla public licen[cs]e( v| version)? 1 1
mpl-1.0; 3; 0.9; mozilla; mozilla public licen[cs]e( v| version)? 1 0
mpl-2.0; 3; 0.9; mozilla; mozilla public licen[cs]e( v| version)? 2( 0)?
mpl; 2; 0.7; mpl; mpl( licen[cs]ed?| [12] [01])
mpl-2.0; 6; 1.0; mozilla; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0; 5; 1.0; spdx; spdx license identifier mpl 2 0
mpl-2.0; 5; 1.0; mozilla; mozilla org (mpl|media mpl) 2 0
mpl-1.1; 6; 1.0; mozilla; the contents of this file are subject to the mozilla public license version 1 1
epl; 2; 0.8; eclipse; eclipse public licen[cs]e
epl-1.0; 3; 0.9; eclipse; eclipse public licen[cs]e( v| version)? 1 0
epl-2.0; 3; 0.9; eclipse; eclipse public licen[cs]e( v| version)? 2 0
epl-2.0; 5; 1.0; spdx; spdx license identifier epl 2 0
epl-1.0; 5; 1.0; spdx; spdx license identifier epl 1 0
epl; 6; 1.0; accompanying; this program and the accompanying materials are made available under the terms of the eclipse public license
cddl; 2; 0.8; cddl; cddl( licen[cs]ed?| 1 [01])?
cddl; 3; 0.9; development; common development and distribution licen[cs]e( version 1 [01])?
cddl; 5; 1.0; spdx; spdx license identifier cddl 1 [01]
cpl; 3; 0.9; common; common public licen[cs]e( version)?( 1 0)?
eupl; 2; 0.8; eupl; eupl( v)?( 1 [0-2])?
eupl; 3; 0.9; european; european union public licen[cs]e( v| version)?( 1 [0-2])?
eupl-1.2; 5; 1.0; spdx; spdx license identifier eupl 1 2
artistic; 2; 0.8; artistic; artistic licen[cs]e
artistic-1.0; 3; 0.9; artistic; artistic licen[cs]e( v| version)? 1 0
artistic-2.0; 3; 0.9; artistic; artistic licen[cs]e( v| version)? 2( 0)?
artistic; 5; 0.95; perl; under the same terms as perl itself
boost; 2; 0.8; boost; boost software licen[cs]e
boost-1.0; 3; 0.9; boost; boost software licen[cs]e( v| version)? 1 0
boost-1.0; 5; 1.0; spdx; spdx license identifier bsl 1 0
boost-1.0; 5; 1.0; boost; boost org license 1 0( txt)?
boost-1.0; 6; 1.0; machine; except in the form of machine executable object code generated by a source language processor
unlicense; 2; 0.8; unlicense; (the )?unlicense
unlicense; 5; 1.0; spdx; spdx license identifier unlicense
unlicense; 5; 1.0; unlicense; unlicense org
unlicense; 6; 1.0; unencumbered; this is free and unencumbered software released into the public domain
wtfpl; 2; 0.9; wtfpl; wtfpl
wtfpl; 3; 0.95; fuck; do what the fuck you want to public licen[cs]e
beerware; 3; 0.9; beerware; beerware( licen[cs]e)?
beerware; 6; 1.0; beer; you can buy me a beer in return
python; 2; 0.8; python; python (software foundation )?licen[cs]e( version 2)?
python; 3; 0.9; psf; psf licen[cs]e
python; 5; 1.0; spdx; spdx license identifier (psf|python) 2 0
php; 2; 0.8; php; php licen[cs]e
php-3.01; 3; 0.9; php; php licen[cs]e( v| version)? 3 01
php-3.0; 3; 0.9; php; php licen[cs]e( v| version)? 3 0
ruby; 2; 0.8; ruby; ruby( s)? licen[cs]e
ofl; 2; 0.8; ofl; (sil )?ofl( 1 [01])?
ofl; 3; 0.9; font; (sil )?open font licen[cs]e
ofl-1.1; 4; 0.95; font; (sil )?open font licen[cs]e( v| version)? 1 1
ofl-1.1; 6; 1.0; font; this font software is licensed under the sil open font license
ofl-1.1; 5; 1.0; scripts; scripts sil org ofl
odbl; 2; 0.8; odbl; odbl( 1 0)?
odbl; 3; 0.9; database; open (data commons )?(open )?database licen[cs]e( v| version)?( 1 0)?
odc-by; 3; 0.9; commons; open data commons attribution licen[cs]e
pddl; 3; 0.9; commons; (open data commons )?public domain dedication and licen[cs]e
ogl; 3; 0.9; government; open government licen[cs]e( v| version)?( [1-3]( 0)?)?
ms-pl; 3; 0.9; microsoft; microsoft public licen[cs]e
ms-rl; 3; 0.9; microsoft; microsoft reciprocal licen[cs]e
ms-pl; 5; 1.0; spdx; spdx license identifier ms pl
lppl; 3; 0.9; latex; latex project public licen[cs]e( version)?( 1 3 ?c?)?
cecill; 2; 0.8; cecill; cecill( [abc])?( licen[cs]e)?
osl; 3; 0.9; license|licence; open software licen[cs]e( v| version)?( 3 0)?
afl; 3; 0.9; academic; academic free licen[cs]e( v| version)?( [123] [01])?
qpl; 3; 0.9; q|qt; q(t)? public licen[cs]e
zpl; 3; 0.9; zope; zope public licen[cs]e( version)?( 2 [01])?
w3c; 3; 0.9; w3c; w3c( software)?( notice and)? licen[cs]e
vim; 3; 0.9; vim; vim licen[cs]e
sleepycat; 3; 0.9; sleepycat; sleepycat licen[cs]e
openssl; 3; 0.9; openssl; openssl licen[cs]e
openssl; 6; 0.95; openssl; this product includes software developed by the openssl project
json; 6; 1.0; good; the software shall be used for good not evil
freetype; 3; 0.9; freetype; freetype (project )?licen[cs]e
ijg; 5; 0.95; jpeg; this software is based in part on the work of the independent jpeg group
ipl; 3; 0.9; ibm; ibm public licen[cs]e( version)?( 1 0)?
apsl; 3; 0.9; apple; apple public source licen[cs]e( version)?( 2 0)?
upl; 3; 0.9; permissive; universal permissive licen[cs]e( v| version)?( 1 0)?
rpl; 3; 0.9; reciprocal; reciprocal public licen[cs]e( version)?( 1 [15])?
mulan; 3; 0.9; mulan; mulan (psl|permissive software licen[cs]e)( v2| v1)?
sspl; 3; 0.9; server; server side public licen[cs]e( v| version)?( 1)?
sspl; 2; 0.8; sspl; sspl
elastic; 3; 0.9; elastic; elastic licen[cs]e( v| version)?( 2( 0)?)?
busl; 3; 0.9; business; business source licen[cs]e( v| version)?( 1 1)?
commons-clause; 3; 0.9; commons; commons clause
commons-clause; 6; 1.0; sell; the license does not grant to you the right to sell the software
polyform; 3; 0.9; polyform; polyform (noncommercial|small business|shield|perimeter|free trial|strict)( licen[cs]e)?
openrail; 3; 0.9; rail|openrail; (bigscience |creativeml )?open ?rail( m| s)?( licen[cs]e)?
llama; 3; 0.9; llama; llama( [23])? community licen[cs]e
# public domain
public-domain; 2; 0.7; domain; (in|into) the public domain
public-domain; 4; 0.9; domain; (released|dedicated|placed|donated|put) (in|in to|into|to) the public domain
public-domain; 4; 0.9; domain; (hereby )?dedicates? (this work|it|any and all copyright interest) to the public domain
public-domain; 1; 0.5; domain; public domain
public-domain; 4; 0.9; copyrighted; (this (work|file|software) is )?not copyrighted
# rights, notices and closed licences
reserved; 2; 0.6; reserved; all rights reserved
reserved; 2; 0.5; reserved; some rights reserved
no-rights-reserved; 3; 0.8; reserved; no rights reserved
reserved; 3; 0.7; reserved; all rights not expressly granted (herein )?are reserved
copyright; 1; 0.4; copyright; copyright( c)?( [0-9]{4}){1,4}
copyright; 1; 0.4; copyrighted; copyrighted by
copyright; 1; 0.4; copyright; copyright (holder|holders|owner|notice)
copyright; 1; 0.4; copyright; portions copyright( c)?
copyright; 1; 0.4; property; (trademarks|copyrights) are (the )?property of their respective owners
copyright; 2; 0.5; spdx; spdx filecopyrighttext
proprietary; 4; 0.9; proprietary; proprietary and confidential
proprietary; 4; 0.9; confidential; confidential and proprietary
proprietary; 4; 0.9; proprietary; this (software|document|material) is proprietary
proprietary; 4; 0.9; unauthorized; unauthorized (copying|use|reproduction|distribution)( or distribution)? of this (file|software|material|document|work)
proprietary; 4; 0.9; secret|secrets; (contains )?trade secrets? (of|and confidential information)
proprietary; 3; 0.8; written; without (the )?(express|prior)( prior)? written (permission|consent)
proprietary; 3; 0.8; agreement; end user licen[cs]e agreement
proprietary; 3; 0.8; reproduced|copied; no part of this (publication|book|work|document) may be (reproduced|copied)
noncommercial; 3; 0.8; commercial|noncommercial; (for )?non ?commercial use only
noncommercial; 3; 0.8; personal; for personal use only
noncommercial; 3; 0.8; commercial; not for commercial use
evaluation; 3; 0.8; evaluation; for evaluation purposes only
fair-use; 2; 0.5; fair; fair use (notice|doctrine)
freeware; 2; 0.6; freeware; freeware
shareware; 2; 0.6; shareware; shareware
royalty-free; 2; 0.6; royalty; royalty free( licen[cs]e)?
warranty; 1; 0.3; warranty|warranties; (without|no) warrant(y|ies) of any kind
warranty; 1; 0.3; warranty|warranties; (without|no) warrant(y|ies)( express or implied)?
warranty; 2; 0.4; warranty; distributed in the hope that it will be useful but without any warranty
warranty; 2; 0.4; provided; (is )?provided (by the copyright holders and contributors )?as is
warranty; 2; 0.4; liable; in no event shall [a-z0-9 ]{1,80} be liable
licensed; 1; 0.3; licensed; licensed (to|by|from)
licensed; 1; 0.3; licensed|licenced; licen[cs]ed under
licensed; 1; 0.3; license|licence|copying; see (the )?(file )?(licen[cs]e|copying)( txt| md| file)?( for (details|more details|more information|licensing information))?
licensed; 1; 0.3; dual; dual licen[cs]ed
spdx; 1; 0.5; spdx; spdx license identifier
"""
