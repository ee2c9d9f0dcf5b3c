"""License scans with ordered signature rules, as DataFrame functions only.

Words of the text (ASCII letters lower-cased) are joined by single spaces. A
rule has keywords, a regex over that form, a label, a priority (smaller wins)
and a confidence. Rules none of whose keywords occurs are skipped, as are
whole texts without any root (``roots``), one of which is in whatever a rule matches. Every start of a rule counts, found with
look-ahead, so a detection does not depend on where scanning began. A detection
is suppressed if another contains its interval and has a smaller priority, or
the same priority and a longer interval, or the same interval and an earlier
rule. Labels of the rest are joined with the base labels, which always stay.

Long texts are scanned in segments of ``SEGMENT`` words with ``OVERLAP`` words
of context on both sides; a match has at most ``OVERLAP`` words, so segments
find exactly what a scan of the whole text finds, and the work for a text is
linear in its length.

Defined results: a null or empty text has 0 words, no labels and score 0;
repeated rows give repeated results; a null id is kept; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEGMENT, OVERLAP = 400, 48
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Families: label stem, keywords (any of them), name as a regex over words, versions.
FAMILIES = [
    ("apache", "apache", "(?:the )?apache(?: software)?(?: license| licence| public license)?", ["1.0", "1.1", "2.0"]),
    ("gpl", "gpl|general public", "(?:(?:the )?gnu general public licen[cs]e|(?:gnu )?gpl|general public licen[cs]e)", ["1.0", "2.0", "3.0"]),
    ("lgpl", "lgpl|general public", "(?:(?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e|(?:gnu )?lgpl)", ["2.0", "2.1", "3.0"]),
    ("agpl", "agpl|affero", "(?:(?:the )?(?:gnu )?affero general public licen[cs]e|(?:gnu )?agpl)", ["1.0", "3.0"]),
    ("gfdl", "gfdl|free documentation", "(?:(?:the )?(?:gnu )?free documentation licen[cs]e|gfdl)", ["1.1", "1.2", "1.3"]),
    ("mpl", "mpl|mozilla", "(?:(?:the )?mozilla public licen[cs]e|mpl)", ["1.0", "1.1", "2.0"]),
    ("epl", "epl|eclipse", "(?:(?:the )?eclipse public licen[cs]e|epl)", ["1.0", "2.0"]),
    ("cddl", "cddl|common development", "(?:common development and distribution licen[cs]e|cddl)", ["1.0", "1.1"]),
    ("cpl", "cpl|common public", "(?:(?:the )?common public licen[cs]e|cpl)", ["0.5", "1.0"]),
    ("eupl", "eupl|european union", "(?:(?:the )?european union public licen[cs]e|eupl)", ["1.0", "1.1", "1.2"]),
    ("ofl", "ofl|open font", "(?:(?:the )?(?:sil )?open font licen[cs]e|ofl)", ["1.0", "1.1"]),
    ("osl", "osl|open software", "(?:(?:the )?open software licen[cs]e|osl)", ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", "afl|academic free", "(?:(?:the )?academic free licen[cs]e|afl)", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("artistic", "artistic", "(?:the )?(?:perl )?artistic licen[cs]e", ["1.0", "2.0"]),
    ("boost", "boost", "(?:the )?boost software licen[cs]e", ["1.0"]),
    ("python", "python", "(?:the )?python(?: software foundation)? licen[cs]e", ["2.0"]),
    ("php", "php", "(?:the )?php licen[cs]e", ["3.0", "3.01"]),
    ("zpl", "zpl|zope", "(?:(?:the )?zope public licen[cs]e|zpl)", ["1.1", "2.0", "2.1"]),
    ("odbl", "odbl|database", "(?:(?:the )?open (?:data commons open )?database licen[cs]e|odbl)", ["1.0"]),
    ("cc0", "cc0", "(?:creative commons )?cc0", ["1.0"]),
    ("lppl", "lppl|latex", "(?:(?:the )?latex project public licen[cs]e|lppl)", ["1.0", "1.1", "1.2", "1.3"]),
    ("bsl", "busl|business source", "(?:business source licen[cs]e|busl)", ["1.1"]),
    ("sspl", "sspl|server side", "(?:server side public licen[cs]e|sspl)", ["1.0"]),
]
# Creative Commons: label stem and the words for it, both short and long.
CREATIVE = [
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
]
CREATIVE_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
# Licenses without versions: label, keyword, name.
PLAIN = [
    ("mit", "mit|expat|x11", "(?:the )?(?:mit|expat|x11) licen[cs]e"),
    ("mit", "mit", "licen[cs]ed under(?: the)? mit"),
    ("mit-0", "mit", "mit no attribution"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd licen[cs]e)"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|(?:new|modified|revised) bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)"),
    ("0bsd", "bsd", "(?:0bsd|bsd zero clause|zero clause bsd)"),
    ("isc", "isc", "(?:the )?isc licen[cs]e"),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("postgresql", "postgresql", "(?:the )?postgresql licen[cs]e"),
    ("openssl", "openssl", "(?:the )?openssl licen[cs]e"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "(?:is|are) in the public domain"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "licen", "(?:subject to|under) the terms of (?:a|an|the|your) (?:commercial|proprietary|end user) licen[cs]e"),
]
# Passages of well-known license texts: label, keyword, words in order.
PASSAGES = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "substantial portions", "shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "free software", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "free software", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("boost-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("zlib", "arising from", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "neighboring rights", "has (?:waived|dedicated) all copyright and related (?:or|and) neighboring rights"),
    ("warranty", "warranty", "without warranty of any kind(?: express or implied)?"),
    ("warranty", "warranties", "any express or implied warranties including but not limited to"),
]
# Licenses told by their name: label and name; the keyword of each is the stem of "license".
NAMES = """
aal|attribution assurance licen[cs]e
abstyles|abstyles licen[cs]e
adobe-2006|adobe systems incorporated source code licen[cs]e
adobe-glyph|adobe glyph list licen[cs]e
adsl|amazon digital services licen[cs]e
aladdin|aladdin free public licen[cs]e
aml|apple mit licen[cs]e
apafml|adobe postscript afm licen[cs]e
apl-1.0|adaptive public licen[cs]e
apsl|apple public source licen[cs]e(?: version)?(?: 1 [012]| 2 0)?
arphic-1999|arphic public licen[cs]e
bahyph|bahyph licen[cs]e
beerware|(?:the )?beer ?ware licen[cs]e
bigscience-rail|bigscience (?:bloom )?rail licen[cs]e
bittorrent|bittorrent open source licen[cs]e
blueoak-1.0.0|blue oak model licen[cs]e(?: 1 0 0)?
bsd-protection|bsd protection licen[cs]e
bzip2|bzip2 (?:and libbzip2 )?licen[cs]e
caldera|caldera licen[cs]e
catosl-1.1|computer associates trusted open source licen[cs]e
cdla-permissive|community data licen[cs]e agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing|community data licen[cs]e agreement sharing(?: version)?(?: 1 0)?
cecill|cecill free software licen[cs]e(?: agreement)?
cecill-b|cecill b (?:free software )?licen[cs]e
cecill-c|cecill c (?:free software )?licen[cs]e
cern-ohl-p|cern open hardware licen[cs]e(?: version 2)? permissive
cern-ohl-s|cern open hardware licen[cs]e(?: version 2)? strongly reciprocal
cern-ohl-w|cern open hardware licen[cs]e(?: version 2)? weakly reciprocal
clartistic|clarified artistic licen[cs]e
cnri-jython|cnri jython licen[cs]e
cnri-python|cnri (?:open source )?python licen[cs]e
condor-1.1|condor public licen[cs]e
cpal-1.0|common public attribution licen[cs]e
cpol-1.02|code project open licen[cs]e
cua-opl-1.0|cua office public licen[cs]e
cube|cube (?:game engine )?licen[cs]e
curl|curl licen[cs]e
drl-1.0|detection rule licen[cs]e
ecl|educational community licen[cs]e(?: version)?(?: [12] 0)?
efl|eiffel forum licen[cs]e(?: version)?(?: [12])?
elastic-2.0|elastic licen[cs]e(?: 2 0)?
entessa|entessa public licen[cs]e
epics|epics open licen[cs]e
erlpl-1.1|erlang public licen[cs]e
etalab-2.0|licence ouverte(?: open licence)?(?: etalab)?
eudatagrid|eu datagrid software licen[cs]e
fair|(?:the )?fair licen[cs]e
frameworx-1.0|frameworx open licen[cs]e
freebsd-doc|freebsd documentation licen[cs]e
freeimage|freeimage public licen[cs]e
ftl|freetype (?:project )?licen[cs]e
gl2ps|gl2ps licen[cs]e
glide|3dfx glide (?:source code )?general public licen[cs]e
gnuplot|gnuplot licen[cs]e
gsoap-1.3b|gsoap public licen[cs]e
haskellreport|haskell language report licen[cs]e
hippocratic|hippocratic licen[cs]e(?: version)?(?: [123] [01])?
icu|icu licen[cs]e
imagemagick|imagemagick licen[cs]e
info-zip|info zip licen[cs]e
intel|intel open source licen[cs]e
interbase-1.0|interbase public licen[cs]e
ipa|ipa font licen[cs]e
ipl-1.0|ibm public licen[cs]e
jasper-2.0|jasper licen[cs]e
jpnic|japan network information center licen[cs]e
json|(?:the )?json licen[cs]e
lal|(?:licence art libre|free art licen[cs]e)
latex2e|latex2e licen[cs]e
leptonica|leptonica licen[cs]e
lgpllr|lesser general public licen[cs]e for linguistic resources
libpng|libpng licen[cs]e(?: version 2)?
libtiff|libtiff licen[cs]e
liliq-p|licence libre du quebec permissive
liliq-r|licence libre du quebec reciprocite
llama|llama(?: [234])?(?: [123])? community licen[cs]e(?: agreement)?
lpl|lucent public licen[cs]e
minpack|minpack licen[cs]e
miros|miros? licen[cs]e
mitnfa|mit nfa licen[cs]e
motosoto|motosoto open source licen[cs]e
mpich2|mpich2 licen[cs]e
mulan-psl|mulan permissive software licen[cs]e(?: version)?(?: [12])?
mulan-publ|mulan public licen[cs]e
multics|multics licen[cs]e
naist-2003|nara institute of science and technology licen[cs]e
naumen|naumen public licen[cs]e
nbpl-1.0|net boolean public licen[cs]e
ncgl-uk-2.0|non commercial government licen[cs]e
net-snmp|net snmp licen[cs]e
netcdf|netcdf licen[cs]e
ngpl|nethack general public licen[cs]e
nlod|norwegian licen[cs]e for open government data
nokia|nokia open source licen[cs]e
nosl|netizen open source licen[cs]e
npl|netscape public licen[cs]e(?: version)?(?: 1 [01])?
nposl-3.0|non profit open software licen[cs]e
ntp|(?:the )?ntp licen[cs]e
nvidia|nvidia (?:software|open model|source code) licen[cs]e(?: agreement)?
oclc-2.0|oclc research public licen[cs]e
odc-by-1.0|open data commons attribution licen[cs]e
ogc-1.0|ogc software licen[cs]e
ogl-canada|open government licen[cs]e canada
ogl-uk|open government licen[cs]e(?: v?[123] 0)?
ogtsl|open group test suite licen[cs]e
oldap|openldap public licen[cs]e(?: version)?(?: [12] [0-9])?
oml|open market licen[cs]e
opl-1.0|open public licen[cs]e
oset-pl-2.1|oset foundation public licen[cs]e
parity|parity public licen[cs]e(?: [67] 0 0)?
plexus|plexus classworlds licen[cs]e
polyform-free-trial|polyform free trial licen[cs]e
polyform-internal-use|polyform internal use licen[cs]e
polyform-noncommercial|polyform non ?commercial licen[cs]e
polyform-perimeter|polyform perimeter licen[cs]e
polyform-shield|polyform shield licen[cs]e
polyform-small-business|polyform small business licen[cs]e
polyform-strict|polyform strict licen[cs]e
qpl-1.0|q public licen[cs]e
rhecos-1.1|red hat ecos public licen[cs]e
rpl|reciprocal public licen[cs]e(?: 1 [15])?
rpsl-1.0|realnetworks public source licen[cs]e
rsa-md|rsa message digest licen[cs]e
rscpl|ricoh source code public licen[cs]e
ruby|ruby(?: s)? licen[cs]e
scea|scea shared source licen[cs]e
sendmail|sendmail (?:open source )?licen[cs]e
sgi-b|sgi free software licen[cs]e b(?: version)?(?: [12] [01])?
shl|solderpad hardware licen[cs]e
simpl-2.0|simple public licen[cs]e
sissl|sun industry standards source licen[cs]e
sleepycat|sleepycat (?:public )?licen[cs]e
smppl|secure messaging protocol public licen[cs]e
snia|snia public licen[cs]e
spl-1.0|sun public licen[cs]e
sugarcrm-1.1.3|sugarcrm public licen[cs]e
tapr-ohl-1.0|tapr open hardware licen[cs]e
tcl|tcl tk licen[cs]e
torque-1.1|torque (?:v2 5 )?software licen[cs]e
tosl|trusster open source licen[cs]e
tu-berlin|technische universitaet berlin licen[cs]e
ucl-1.0|upstream compatibility licen[cs]e
unicode-dfs|unicode licen[cs]e(?: agreement)?(?: v3)?
upl-1.0|universal permissive licen[cs]e
vim|vim licen[cs]e
vostrom|vostrom public licen[cs]e
vsl-1.0|vovida software licen[cs]e
w3c|w3c software (?:notice and )?(?:document )?licen[cs]e
watcom-1.0|sybase open watcom public licen[cs]e
xfree86-1.1|xfree86 licen[cs]e
xnet|x net licen[cs]e
ypl|yahoo public licen[cs]e
zend-2.0|zend (?:engine )?licen[cs]e
zimbra|zimbra public licen[cs]e
non-commercial|for non ?commercial use only under (?:this|the) licen[cs]e
dual|dual licen[cs]ed under
multi|(?:triple|tri|multi) licen[cs]ed under
sublicense|without the right to sub ?licen[cs]e
"""
# Other names, passages and notices: label, keyword, words in order.
MORE = """
d-fsl-1.0|lizenz|deutsche freie software lizenz
copyleft-next|copyleft|copyleft next(?: 0 3 [01])?
fdk-aac|fraunhofer|software licen[cs]e for the fraunhofer fdk aac codec library
hpnd|permission notice|historical permission notice and disclaimer
ijg|jpeg group|this software is based in part on the work of the independent jpeg group
imatix|imatix|imatix standard function library agreement
nasa-1.3|nasa open|nasa open source agreement(?: version)?(?: 1 3)?
pddl-1.0|open data commons|open data commons public domain dedication(?: and licen[cs]e)?
smlnj|standard ml|standard ml of new jersey copyright notice
gemma|gemma terms|gemma terms of use
public-domain|public domain|dedicate any and all copyright interest in (?:the|this) software to the public domain
public-domain|public domain|this (?:file|code|software|work|document) has been put (?:in|into) the public domain
public-domain|no copyright|no copyright is claimed
proprietary|trade secret|contains (?:confidential|proprietary) information and trade secrets
proprietary|internal use only|for internal use only
proprietary|unauthorized|unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|document|material) (?:via any medium )?is (?:strictly )?prohibited
proprietary|unpublished|unpublished rights reserved under the copyright laws of the united states
proprietary|may not be reproduced|may not be reproduced (?:or distributed )?in (?:any form|whole or in part) without (?:the )?(?:prior|express) written (?:permission|consent)
mit|noninfringement|merchantability fitness for a particular purpose and noninfringement
mit|to deal in the software|to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
mit|sublicense|sublicense and or sell copies of the software
mit|above copyright notice|the above copyright notice and this permission notice shall be included
bsd|binary form|redistributions in binary form must reproduce the above copyright notice
bsd|contributors as is|this software is provided by the (?:copyright holders|regents|author) and contributors as is
bsd-3-clause|neither the name|neither the name of (?:the )?(?:[^ ]+ ){1,6}nor the names of its contributors
bsd-4-clause|product includes software|this product includes software developed by
apache-2.0|as is basis|distributed on an as is basis without warranties or conditions of any kind
apache-2.0|contributor licen|under one or more contributor licen[cs]e agreements
apache-2.0|perpetual worldwide|perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[cs]e
apache-1.1|apache software foundation|this product includes software developed by the apache software foundation
gpl|hope that it will be useful|distributed in the hope that it will be useful but without any warranty
gpl|received a copy|you should have received a copy of the gnu general public licen[cs]e
lgpl|received a copy|you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
agpl|received a copy|you should have received a copy of the gnu affero general public licen[cs]e
gpl|either version|either version [123] of the licen[cs]e or at your option any later version
gpl|everyone is permitted|everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document
gfdl|invariant sections|with no invariant sections no front cover texts and no back cover texts
gpl-exception|special exception|as a special exception the copyright holders give you permission to link
gcc-exception|runtime library exception|gcc runtime library exception
classpath-exception|classpath|classpath exception
mpl|mozilla|if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl
mpl-1.1|licen|software distributed under the licen[cs]e is distributed on an as is basis
epl|accompanying materials|this program and the accompanying materials are made available under the terms of
cddl|covered software|this licen[cs]e applies to covered software under the common development
zlib|misrepresented|the origin of this software must not be misrepresented
zlib|plainly marked|altered source versions must be plainly marked as such
isc|disclaims all warranties|the author disclaims all warranties with regard to this software
boost-1.0|machine executable|solely in the form of machine executable object code generated by a source language processor
unlicense|for any purpose commercial|for any purpose commercial or non commercial and by any means
wtfpl|do what the f|do what the fuck you want to public licen[cs]e
beerware|buy me a beer|buy me a beer in return
ofl|reserved font name|with reserved font name
cc0-1.0|no rights reserved|no rights reserved
cc0-1.0|cc0|cc0 1 0 universal public domain dedication
cc-by|appropriate credit|you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made
cc-by-sa|share alike|distribute your contributions under the same licen[cs]e as the original share alike
cc-by-nd|distribute the modified|you may not distribute the modified material
cc-by-nc|commercial purposes|you may not use the material for commercial purposes
warranty|as is|provided as is without (?:any )?(?:express or implied )?warranty
warranty|in no event|in no event shall the (?:authors?|copyright (?:holders?|owner)|contributors) (?:or (?:copyright holders|contributors) )?be liable
warranty|merchantability|implied warrant(?:y|ies) of merchantability (?:and|or) fitness for a particular purpose
warranty|consequential|direct indirect incidental special exemplary or consequential damages
warranty|use at your own risk|use at your own risk
copyright|copr |copr (?:19|20)[0-9]{2}
copyright|rights reserved by|rights reserved by (?:the )?(?:author|publisher|copyright holder)s?
copyright|copyright notice|this copyright notice (?:must|shall|may) (?:not )?be (?:retained|removed|included)
trademark|trademark|(?:is|are) (?:a )?registered trademarks? of
patent|patent|(?:patent|patents) pending
license-reference|licen|licen[cs]e file in the (?:root|top level) (?:directory|folder) of this (?:source tree|repository|project|distribution)
license-reference|licen|found in the licen[cs]e(?: txt| md)? file
license-reference|licen|by (?:downloading|installing|using) (?:this|the) [^ ]+ you agree to (?:the terms of )?(?:this|the) licen[cs]e
license-reference|licen|refer to the licen[cs]e for the specific language governing
license-reference|licen|third party licen[cs]es?
license-reference|copying|full copyright notice in the file copying
license-reference|eula|end user licen[cs]e agreement eula
"""
# Notices that name no license.
NOTICES = [
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})?"),
    ("copyright", "copyright", "copyright(?: c)? by"),
    ("reserved", "all rights reserved", "all rights reserved"),
    ("reserved", "some rights reserved", "some rights reserved"),
    ("license-reference", "see", "see (?:the )?(?:file )?(?:license|licence|copying|notice)(?: txt| md)?(?: file)? for (?:details|more|the|terms|full)"),
    ("license-reference", "licen", "(?:released|licen[cs]ed|distributed|published|available) under(?: the)?(?: terms of(?: the)?)?(?: [^ ]+){0,3} licen[cs]e"),
]
# Each rule's match holds "licen" or, at the beginning of a word, one of these.
ROOTS = (
    "attribution|see copying|see the copying|see file copying|see the file copying|see notice|see the notice|see file notice|see the file notice|"
    "lgpl|agpl|gpl|cc0|cc by|creative commons|creativecommons|copyright|all rights reserved|some rights reserved|rights reserved|public domain|spdx|warrant|redistribut|"
    "hereby granted|permission to use|endorse or promote|unencumbered|neighboring rights|substantial portions|free software|software foundation|advertising materials|source code form|"
    "arising from|apache|bsd|0bsd|freebsd|mpl|epl|cddl|cpl|eupl|ofl|osl|afl|zpl|odbl|lppl|busl|sspl|gfdl|wtfpl|mit no attribution|proprietary and confidential"
).split("|")


def _trie(words: list[str]) -> str:
    """A regex for any of ``words`` that tries each first letter once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    if "" in heads:
        return ""
    return "(?:" + "|".join(re.escape(c) + _trie(rest) for c, rest in sorted(heads.items())) + ")"


def roots(extra: list[dict]) -> str:
    """A regex of which something occurs in whatever a rule matches: ``ROOTS`` and keywords of ``MORE`` after a space, and keywords of extra rules anywhere."""
    mine = {*ROOTS, *(line.split("|", 2)[1].strip() for line in MORE.split("\n") if line)} - {"licen"}
    return "|".join(["licen", " " + _trie(sorted(mine)), *sorted(re.escape(k) for r in extra for k in r["keyword"].split("|"))])


def words_of(version: str) -> str:
    """Version numbers as words: a final 0 may be missing."""
    major, minor = version.split(".")
    return f"{major}(?: {minor})?" if minor == "0" else f"{major} {minor}"


def rules() -> list[dict]:
    """All rules in order; ``id`` is a rule's place."""
    found: list[tuple] = []

    def add(priority: int, confidence: float, label: str, keyword: str, regex: str) -> None:
        found.append((priority, confidence, label, keyword, regex))

    for stem, keyword, name, versions in FAMILIES:
        for version in versions:
            v, label = words_of(version), f"{stem}-{version}"
            add(10, 1.0, label, "spdx", f"spdx license identifier {stem} {v}(?: only| or later)?")
            add(20, 0.95, label, keyword, f"{name}(?: version| ver| v)? v?{v}(?: only| or later| or any later version| or at your option any later version)?")
            if stem in ("gpl", "lgpl", "agpl", "gfdl"):
                add(30, 0.9, label, "gnu org", f"gnu org (?:licenses|copyleft) (?:old licenses )?{stem} {v}(?: html| txt)?")
        add(40, 0.7, stem, keyword, name.removesuffix("?") if stem == "apache" else name)
    for label, short, long in CREATIVE:
        for version in CREATIVE_VERSIONS:
            v = words_of(version)
            add(10, 1.0, f"{label}-{version}", "spdx", f"spdx license identifier cc {short} {v}")
            add(20, 0.95, f"{label}-{version}", "cc", f"cc {short}(?: version| v)? {v}(?: international| unported| generic)?")
            add(20, 0.95, f"{label}-{version}", "attribution", f"(?:creative commons )?{long}(?: version| v)? {v}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?")
            add(30, 0.9, f"{label}-{version}", "creativecommons", f"creativecommons org licenses {short} {v}")
        add(40, 0.7, label, "cc", f"cc {short}")
        add(40, 0.7, label, "creative commons", f"creative commons {long}")
    for label, keyword, name in PLAIN:
        add(20, 0.9, label, keyword, name)
    for label in sorted({label for label, _, _ in PLAIN if label not in ("proprietary", "public-domain")}):
        add(10, 1.0, label, "spdx", "spdx license identifier " + label.replace("-", " "))
        add(30, 0.9, label, "opensource org", "opensource org licenses? " + label.replace("-", " "))
    for label, name in (line.split("|", 1) for line in NAMES.split("\n") if line):
        add(25, 0.85, label, "licen", name)
    for label, keyword, words in (line.split("|", 2) for line in MORE.split("\n") if line):
        low = label in ("warranty", "copyright", "trademark", "patent", "license-reference")
        add(60 if low else 30, 0.4 if low else 0.85, label, keyword, words)
    for label, keyword, words in PASSAGES:
        add(30, 0.9, label, keyword, words)
    for label, keyword, words in NOTICES:
        add(60, 0.4, label, keyword, words)
    keys = ("priority", "confidence", "label", "keyword", "regex")
    return [dict(zip(keys, r, strict=True)) | {"id": i} for i, r in enumerate(found)]


# Rules with the same keywords stand behind one gate.
_RULE = "array<struct<keywords:array<string>,rules:array<struct<id:int,priority:int,confidence:double,label:string,take:string,cut:string>>>>"

# Detections of a segment s among rules: s.text begins with "^ ", words are single-spaced, and a match begins at the space before its first word.
_FOUND = """
transform(segments, s -> element_at(transform(array(
  flatten(transform(filter(flatten(transform(filter(gates, g -> exists(g.keywords, k -> contains(s.text, k))), g -> g.rules)), r -> rlike(s.text, r.cut)),
    r -> element_at(transform(array(struct(regexp_extract_all(s.text, r.take, 1) as found, split(s.text, r.cut, -1) as pieces)),
      m -> transform(m.found, (t, i) -> struct(
        aggregate(slice(m.pieces, 1, i + 1), 0, (n, p) -> n + length(p)) as lo, length(t) as n,
        r.priority as priority, r.id as id, r.label as label, r.confidence as confidence))), 1)))),
  all -> filter(all, d -> d.lo >= s.lo and d.lo < s.hi and not exists(all, e ->
    e.lo <= d.lo and e.lo + e.n >= d.lo + d.n and (e.priority < d.priority or (e.priority = d.priority
      and (e.n > d.n or (e.n = d.n and e.id < d.id))))))), 1))
"""
_SEGMENTS = f"""
transform(sequence(0, greatest(size(w) - 1, 0), {SEGMENT}), i -> element_at(transform(array(struct(
    if(i = 0, '^', concat('^ ', array_join(slice(w, greatest(i - {OVERLAP} + 1, 1), {OVERLAP}), ' '))) as before,
    concat(' ', array_join(slice(w, i + 1, {SEGMENT}), ' ')) as core,
    if(i + {SEGMENT} >= size(w), ' ', concat(' ', array_join(slice(w, i + {SEGMENT} + 1, {OVERLAP}), ' '), ' ')) as after)),
  p -> struct(concat(p.before, p.core, p.after) as text, length(p.before) as lo, length(p.before) + length(p.core) as hi)), 1))
"""


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[dict] | None = None) -> DataFrame:
    """One row for each row of ``docs``.

    Columns: ``id_col``, n_words, n_base, first_word, last_word, base_labels,
    labels, score (the largest confidence) and n_detections, both after suppression. ``extra`` rules come after the built-in ones.
    """
    table = rules()
    table += [r | {"id": len(table) + i} for i, r in enumerate(extra or [])]
    gates: dict[str, list[dict]] = {}
    for r in table:
        gates.setdefault(r["keyword"], []).append({k: r[k] for k in ("id", "priority", "confidence", "label")} | {"take": f"(?=( {r['regex']})(?= ))", "cut": f"(?= {r['regex']}(?= ))"})
    literal = json.dumps([{"keywords": k.split("|"), "rules": rules} for k, rules in gates.items()])
    base = "(?= (?:" + "|".join(BASE) + ")(?= ))"
    lowered = F.translate(text_of(text_col), UPPER, LOWER)
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.concat(F.lit("^ "), F.trim(F.regexp_replace(lowered, GAPS, " ")), F.lit(" ")).alias("line"))
    spaces = lambda c: f"(length({c}) - length(replace({c}, ' ', '')))"
    counted = read.select(
        "id",
        "line",
        F.expr(f"if(line = '^  ', 0, {spaces('line')} - 1)").cast("long").alias("n_words"),
        F.expr(f"case when {' or '.join(f'''contains(line, ' {p} ')''' for p in BASE)} then split(line, r'{base}', -1) end").alias("places"),
        F.col("line").rlike(roots(extra or [])).alias("open"),
    )
    base_labels = "filter(array(" + ", ".join(f"if(contains(line, ' {p} '), '{label}', null)" for p, label in sorted(BASE.items(), key=lambda x: x[1])) + "), x -> x is not null)"
    based = counted.select(
        "id",
        "n_words",
        F.expr("if(places is null, 0, size(places) - 1)").cast("long").alias("n_base"),
        F.expr(spaces("places[0]")).cast("long").alias("first_word"),
        F.expr(f"n_words + 1 - {spaces('places[size(places) - 1]')}").cast("long").alias("last_word"),
        F.expr(base_labels).alias("base"),
        F.expr("if(open, split(trim(substring(line, 2)), ' '), null)").alias("w"),
    )
    segmented = based.withColumn("segments", F.expr(f"if(w is null, null, {_SEGMENTS})")).drop("w")
    ruled = segmented.withColumn("gates", F.when(F.col("segments").isNotNull(), F.from_json(F.lit(literal), _RULE)))
    found = ruled.withColumn("found", F.expr(f"if(segments is null, null, {_FOUND})")).drop("segments", "gates")
    flat = found.withColumn("kept", F.coalesce(F.flatten("found"), F.expr("cast(array() as array<struct<lo:int,n:int,priority:int,id:int,label:string,confidence:double>>)")))
    return flat.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(base, transform(kept, d -> d.label)))), ',')").alias("labels"),
        F.expr("aggregate(kept, 0D, (m, d) -> greatest(m, d.confidence))").alias("score"),
        F.expr("cast(size(kept) as long)").alias("n_detections"),
    )
