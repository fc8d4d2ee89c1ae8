"""Signatures of licenses, written by hand: label, priority, keywords and regular expression.

A blank in an expression stands for any run of characters that are no word, ``#`` for an optional
"v", "ver" or "version" before a number. Texts are lower-cased. One of the keywords, single words, is
in every match. Names with a version rank above names without, notices and texts below names.
"""

from __future__ import annotations

SIGNATURES = r"""
gpl-1.0-or-later :: 78 :: general :: gnu general public licen[cs]e #1(?:\.0)? or (?:any )?(?:later|newer)
gpl-2.0-or-later :: 78 :: general :: (?:gnu )?general public licen[cs]e #2(?:\.0)? or (?:\(?at your option\)? )?(?:any )?(?:later|newer)
gpl-3.0-or-later :: 78 :: general :: (?:gnu )?general public licen[cs]e #3(?:\.0)? or (?:\(?at your option\)? )?(?:any )?(?:later|newer)
gpl-2.0-or-later :: 77 :: either :: either #2(?:\.0)? of the licen[cs]e or (?:at your option )?any later
gpl-3.0-or-later :: 77 :: either :: either #3(?:\.0)? of the licen[cs]e or (?:at your option )?any later
gpl-1.0 :: 70 :: general :: gnu general public licen[cs]e #1(?:\.0)?
gpl-2.0 :: 70 :: general :: (?:gnu )?general public licen[cs]e #2(?:\.0)?
gpl-3.0 :: 70 :: general :: (?:gnu )?general public licen[cs]e #3(?:\.0)?
gpl-2.0-or-later :: 74 :: gpl gplv2 :: gpl[^0-9a-z\x80-\xff]{0,3}#2(?:\.0)?(?:\+| or (?:any )?(?:later|newer))
gpl-3.0-or-later :: 74 :: gpl gplv3 :: gpl[^0-9a-z\x80-\xff]{0,3}#3(?:\.0)?(?:\+| or (?:any )?(?:later|newer))
gpl-1.0 :: 69 :: gpl :: gpl[^0-9a-z\x80-\xff]{0,3}#1(?:\.0)?
gpl-2.0 :: 69 :: gpl :: gpl[^0-9a-z\x80-\xff]{0,3}#2(?:\.0)?
gpl-3.0 :: 69 :: gpl :: gpl[^0-9a-z\x80-\xff]{0,3}#3(?:\.0)?
gpl :: 50 :: general :: gnu general public licen[cs]e
gpl :: 50 :: gpl :: gnu gpl
gpl :: 48 :: gpl :: (?:under|covered by|terms of) (?:the )?gpl
gpl :: 60 :: gnu :: www\.gnu\.org/licenses/(?:old-licenses/)?gpl
gpl :: 40 :: redistribute :: this program is free software:? you can redistribute it and or modify it under the terms
gpl :: 39 :: hope :: distributed in the hope that it will be useful but without any warranty
gpl :: 38 :: copyleft :: protecting your rights to copy change and distribute copyleft
lgpl-2.0-or-later :: 79 :: library :: gnu library general public licen[cs]e #2(?:\.0)? or (?:any )?(?:later|newer)
lgpl-2.1-or-later :: 79 :: lesser :: gnu lesser general public licen[cs]e #2\.1 or (?:any )?(?:later|newer)
lgpl-3.0-or-later :: 79 :: lesser :: gnu lesser general public licen[cs]e #3(?:\.0)? or (?:any )?(?:later|newer)
lgpl-2.0 :: 71 :: library :: gnu library general public licen[cs]e #2(?:\.0)?
lgpl-2.1 :: 71 :: lesser :: (?:gnu )?lesser general public licen[cs]e #2\.1
lgpl-3.0 :: 71 :: lesser :: (?:gnu )?lesser general public licen[cs]e #3(?:\.0)?
lgpl-2.0 :: 70 :: lgpl :: lgpl[^0-9a-z\x80-\xff]{0,3}#2(?:\.0)?
lgpl-2.1 :: 70 :: lgpl :: lgpl[^0-9a-z\x80-\xff]{0,3}#2\.1
lgpl-3.0 :: 70 :: lgpl :: lgpl[^0-9a-z\x80-\xff]{0,3}#3(?:\.0)?
lgpl :: 52 :: lesser library :: gnu (?:lesser|library) general public licen[cs]e
lgpl :: 51 :: lgpl :: (?:gnu )?lgpl
lgpl :: 41 :: library :: this library is free software you can redistribute it and or modify it
agpl-3.0-or-later :: 79 :: affero :: affero general public licen[cs]e #3(?:\.0)? or (?:any )?(?:later|newer)
agpl-1.0 :: 72 :: affero :: affero general public licen[cs]e #1(?:\.0)?
agpl-3.0 :: 72 :: affero :: (?:gnu )?affero general public licen[cs]e #3(?:\.0)?
agpl-3.0 :: 71 :: agpl :: agpl[^0-9a-z\x80-\xff]{0,3}#3(?:\.0)?
agpl :: 53 :: affero :: (?:gnu )?affero general public licen[cs]e
agpl :: 52 :: agpl :: (?:gnu )?agpl
gfdl-1.1 :: 72 :: documentation :: gnu free documentation licen[cs]e #1\.1
gfdl-1.2 :: 72 :: documentation :: gnu free documentation licen[cs]e #1\.2
gfdl-1.3 :: 72 :: documentation :: gnu free documentation licen[cs]e #1\.3
gfdl :: 52 :: documentation :: gnu free documentation licen[cs]e
gfdl :: 51 :: gfdl :: (?:gnu )?gfdl
apache-1.0 :: 70 :: apache :: apache (?:software )?licen[cs]e #1\.0
apache-1.1 :: 70 :: apache :: apache (?:software )?licen[cs]e #1\.1
apache-2.0 :: 70 :: apache :: apache (?:software )?licen[cs]e #2(?:\.0)?
apache-2.0 :: 69 :: apache :: apache[^0-9a-z\x80-\xff]{0,3}#2(?:\.0)?
apache-1.1 :: 68 :: asl :: asl[^0-9a-z\x80-\xff]{0,3}#1\.1
apache-2.0 :: 68 :: asl :: asl[^0-9a-z\x80-\xff]{0,3}#2(?:\.0)?
apache :: 50 :: apache :: apache (?:software )?licen[cs]e
apache-2.0 :: 66 :: apache :: www\.apache\.org/licenses/license-2\.0
apache-2.0 :: 42 :: compliance :: you may not use this file except in compliance with the licen[cs]e
apache :: 41 :: contributor :: licensed to the apache software foundation \(?asf\)? under one or more contributor
mpl-1.0 :: 70 :: mozilla :: mozilla public licen[cs]e #1\.0
mpl-1.1 :: 70 :: mozilla :: mozilla public licen[cs]e #1\.1
mpl-2.0 :: 70 :: mozilla :: mozilla public licen[cs]e #2(?:\.0)?
mpl-1.1 :: 69 :: mpl :: mpl[^0-9a-z\x80-\xff]{0,3}#1\.1
mpl-2.0 :: 69 :: mpl :: mpl[^0-9a-z\x80-\xff]{0,3}#2(?:\.0)?
mpl :: 50 :: mozilla :: mozilla public licen[cs]e
mpl-2.0 :: 66 :: mozilla :: mozilla\.org/mpl/2\.0
epl-1.0 :: 70 :: eclipse :: eclipse public licen[cs]e #1\.0
epl-2.0 :: 70 :: eclipse :: eclipse public licen[cs]e #2(?:\.0)?
epl-1.0 :: 69 :: epl :: epl[^0-9a-z\x80-\xff]{0,3}#1\.0
epl-2.0 :: 69 :: epl :: epl[^0-9a-z\x80-\xff]{0,3}#2(?:\.0)?
epl :: 50 :: eclipse :: eclipse public licen[cs]e
eupl-1.1 :: 70 :: european :: european union public licen[cs]e #1\.1
eupl-1.2 :: 70 :: european :: european union public licen[cs]e #1\.2
eupl-1.2 :: 69 :: eupl :: eupl[^0-9a-z\x80-\xff]{0,3}#1\.2
eupl :: 50 :: european :: european union public licen[cs]e
eupl :: 49 :: eupl :: eupl
cddl-1.0 :: 70 :: common :: common development and distribution licen[cs]e #1\.0
cddl-1.1 :: 70 :: common :: common development and distribution licen[cs]e #1\.1
cddl-1.0 :: 69 :: cddl :: cddl[^0-9a-z\x80-\xff]{0,3}#1\.0
cddl :: 50 :: common :: common development and distribution licen[cs]e
cddl :: 49 :: cddl :: cddl
cpl-1.0 :: 70 :: common :: common public licen[cs]e #1\.0
cpl :: 50 :: common :: common public licen[cs]e
ipl-1.0 :: 60 :: ibm :: ibm public licen[cs]e(?: #1\.0)?
osl-3.0 :: 70 :: open :: open software licen[cs]e #3(?:\.0)?
osl-2.1 :: 70 :: open :: open software licen[cs]e #2\.1
osl-2.0 :: 70 :: open :: open software licen[cs]e #2\.0
osl-1.0 :: 70 :: open :: open software licen[cs]e #1\.0
osl :: 50 :: open :: open software licen[cs]e
afl-3.0 :: 70 :: academic :: academic free licen[cs]e #3(?:\.0)?
afl-2.1 :: 70 :: academic :: academic free licen[cs]e #2\.1
afl-2.0 :: 70 :: academic :: academic free licen[cs]e #2\.0
afl :: 50 :: academic :: academic free licen[cs]e
artistic-1.0 :: 70 :: artistic :: (?:perl )?artistic licen[cs]e #1\.0
artistic-2.0 :: 70 :: artistic :: (?:perl )?artistic licen[cs]e #2(?:\.0)?
artistic :: 50 :: artistic :: (?:perl )?artistic licen[cs]e
artistic :: 45 :: perl :: under the same terms as perl itself
bsl-1.0 :: 70 :: boost :: boost software licen[cs]e(?: #1\.0)?
bsl-1.0 :: 66 :: boost :: www\.boost\.org/license_1_0\.txt
bsl-1.1 :: 70 :: business :: business source licen[cs]e #1\.1
busl :: 50 :: business :: business source licen[cs]e
zpl-1.1 :: 70 :: zope :: zope public licen[cs]e #1\.1
zpl-2.0 :: 70 :: zope :: zope public licen[cs]e #2\.0
zpl-2.1 :: 70 :: zope :: zope public licen[cs]e #2\.1
zpl :: 50 :: zope :: zope public licen[cs]e
odbl-1.0 :: 70 :: database :: open database licen[cs]e #1(?:\.0)?
odbl :: 52 :: database :: (?:open data commons )?open database licen[cs]e
odbl :: 50 :: odbl :: odbl
odc-by-1.0 :: 60 :: commons :: open data commons attribution licen[cs]e
pddl-1.0 :: 60 :: dedication :: public domain dedication and licen[cs]e
pddl :: 50 :: pddl :: pddl
ofl-1.0 :: 70 :: font :: (?:sil )?open font licen[cs]e #1\.0
ofl-1.1 :: 70 :: font :: (?:sil )?open font licen[cs]e #1\.1
ofl :: 50 :: font :: (?:sil )?open font licen[cs]e
ofl :: 49 :: ofl :: sil ofl
lppl-1.0 :: 70 :: latex :: latex project public licen[cs]e #1\.0
lppl-1.2 :: 70 :: latex :: latex project public licen[cs]e #1\.2
lppl-1.3 :: 70 :: latex :: latex project public licen[cs]e #1\.3[abc]?
lppl-1.3 :: 69 :: lppl :: lppl[^0-9a-z\x80-\xff]{0,3}#1\.3[abc]?
lppl :: 50 :: latex :: latex project public licen[cs]e
lppl :: 49 :: lppl :: lppl
ms-pl :: 55 :: microsoft :: microsoft public licen[cs]e
ms-rl :: 55 :: microsoft :: microsoft reciprocal licen[cs]e
ms-lpl :: 55 :: microsoft :: microsoft limited public licen[cs]e
ms-pl :: 50 :: pl :: ms-pl
ms-rl :: 50 :: rl :: ms-rl
python-2.0 :: 66 :: python :: python software foundation licen[cs]e(?: agreement)?(?: for python)? #2(?:\.0)?
python :: 50 :: python :: python software foundation licen[cs]e
python :: 49 :: psf :: psf licen[cs]e
php-3.0 :: 70 :: php :: php licen[cs]e #3\.0
php-3.01 :: 71 :: php :: php licen[cs]e #3\.01
php :: 50 :: php :: php licen[cs]e
ruby :: 50 :: ruby :: ruby licen[cs]e
ruby :: 45 :: ruby :: under the same terms as ruby(?: itself)?
qpl-1.0 :: 60 :: qpl public :: q public licen[cs]e #1\.0|qpl[^0-9a-z\x80-\xff]{0,3}#1\.0
qpl :: 50 :: public :: the q public licen[cs]e
wtfpl :: 60 :: fuck :: do what the fuck you want to public licen[cs]e
wtfpl :: 50 :: wtfpl :: wtfpl
unlicense :: 55 :: unlicense :: the unlicense
unlicense :: 54 :: unlicense :: unlicense\.org
unlicense :: 46 :: unencumbered :: this is free and unencumbered software released into the public domain
zlib :: 55 :: zlib :: zlib(?: libpng)? licen[cs]e
zlib :: 42 :: warranty :: this software is provided as is without any express or implied warranty in no event
zlib :: 41 :: misrepresented :: the origin of this software must not be misrepresented
libpng :: 50 :: libpng :: libpng licen[cs]e
isc :: 55 :: isc :: isc licen[cs]e
isc :: 41 :: permission :: permission to use copy modify and or distribute this software for any purpose
0bsd :: 62 :: zero :: zero clause bsd(?: licen[cs]e)?
0bsd :: 60 :: 0bsd :: 0bsd
mit :: 55 :: mit :: mit licen[cs]e
mit :: 54 :: mit :: licen[cs]e mit
mit :: 53 :: mit :: (?:under|the) mit
mit :: 54 :: expat :: expat licen[cs]e
mit-0 :: 62 :: attribution :: mit no attribution(?: licen[cs]e)?
mit :: 60 :: opensource :: opensource\.org/licenses/mit
mit :: 42 :: hereby :: permission is hereby granted free of charge to any person obtaining a copy
mit :: 41 :: noninfringement :: fitness for a particular purpose and noninfringement
x11 :: 55 :: x11 :: x11 licen[cs]e
bsd-2-clause :: 64 :: bsd :: (?:2|two) clause bsd(?: licen[cs]e)?
bsd-2-clause :: 64 :: bsd :: bsd (?:2|two) clause
bsd-2-clause :: 63 :: simplified freebsd :: (?:simplified bsd|freebsd) licen[cs]e
bsd-3-clause :: 64 :: bsd :: (?:3|three) clause bsd(?: licen[cs]e)?
bsd-3-clause :: 64 :: bsd :: bsd (?:3|three) clause
bsd-3-clause :: 63 :: bsd :: (?:new|modified|revised) bsd licen[cs]e
bsd-4-clause :: 64 :: bsd :: (?:4|four) clause bsd(?: licen[cs]e)?
bsd-4-clause :: 64 :: bsd :: bsd (?:4|four) clause
bsd-4-clause :: 63 :: bsd :: original bsd licen[cs]e
bsd :: 50 :: bsd :: bsd(?: style)? licen[cs]e
bsd :: 50 :: berkeley :: berkeley software distribution licen[cs]e
bsd :: 41 :: redistribution :: redistribution and use in source and binary forms with or without modification
bsd-3-clause :: 43 :: endorse :: may be used to endorse or promote products derived from this software
bsd-4-clause :: 43 :: advertising :: all advertising materials mentioning features or use of this software
cc0-1.0 :: 66 :: cc0 :: cc0[^0-9a-z\x80-\xff]{0,3}#1\.0
cc0 :: 55 :: cc0 :: cc0
cc0 :: 56 :: zero :: creative commons zero
cc0-1.0 :: 68 :: publicdomain :: creativecommons\.org/publicdomain/zero/1\.0
cc-by :: 52 :: attribution :: creative commons attribution
cc-by :: 50 :: cc :: cc by
cc :: 45 :: commons :: creative commons licen[cs]e
postgresql :: 55 :: postgresql :: postgresql licen[cs]e
ncsa :: 55 :: ncsa illinois :: (?:university of illinois )?ncsa open source licen[cs]e
openssl :: 55 :: openssl :: openssl licen[cs]e
curl :: 50 :: curl :: curl licen[cs]e
vim :: 50 :: vim :: vim licen[cs]e
sleepycat :: 55 :: sleepycat :: sleepycat licen[cs]e
beerware :: 55 :: beer :: beer(?: )?ware licen[cs]e
json :: 45 :: evil :: shall be used for good not evil
unicode :: 55 :: unicode :: unicode(?: inc)? licen[cs]e agreement
upl-1.0 :: 60 :: universal :: universal permissive licen[cs]e(?: #1\.0)?
ecl-2.0 :: 60 :: educational :: educational community licen[cs]e(?: #2\.0)?
cecill-2.1 :: 60 :: cecill :: cecill(?: free software licen[cs]e)?(?: agreement)? #2\.1
cecill :: 50 :: cecill :: cecill(?:-[bc])? (?:free software )?licen[cs]e
sspl-1.0 :: 60 :: server :: server side public licen[cs]e
elastic-2.0 :: 60 :: elastic :: elastic licen[cs]e(?: #2\.0)?
commons-clause :: 60 :: clause :: commons clause licen[cs]e condition
polyform :: 55 :: polyform :: polyform (?:noncommercial|small business|strict|shield) licen[cs]e
openrail :: 55 :: openrail rail :: (?:bigscience )?(?:open)?rail(?:-m)? licen[cs]e
public-domain :: 44 :: domain :: released into the public domain
public-domain :: 44 :: domain :: dedicated to the public domain
public-domain :: 43 :: domain :: (?:is|are) in the public domain
proprietary :: 42 :: reserved :: all rights reserved
proprietary :: 44 :: unauthorized :: unauthorized copying of this file via any medium is strictly prohibited
proprietary :: 43 :: confidential :: proprietary and confidential
proprietary :: 43 :: permission :: may not be (?:copied|reproduced|redistributed) without (?:the )?(?:express |prior |written )*permission
proprietary :: 40 :: consent :: without the (?:prior |express )?written consent of
"""
