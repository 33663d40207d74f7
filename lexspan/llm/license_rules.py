"""Signature rules for licences, in order: label | priority | weight | keyword | pattern.

Patterns run over normalised text: words in lower case, one space between, no punctuation, so that
"version 2.0" reads "version 2 0". They begin and end at words. Priorities: 3 a full notice, tag or
address, 2 a licence's name, 1 a loose mention. Each keyword occurs wherever its pattern matches.
"""

from __future__ import annotations

import re

#: One of these occurs in every text in which a rule's keyword does.
ANCHORS = ("licen", "copyright", "spdx", "gpl", "creative commons", "cc by", "cc0", "public domain", "permission is", "redistribution", "warranty", "rights reserved", "wtfpl", "copyleft")

_RULES = """
mit | 3 | 1.0 | spdx | spdx licen[sc]e identifier mit
mit | 3 | 1.0 | permission is | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 3 | 0.9 | licen | (?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?mit licen[sc]e
mit | 3 | 0.9 | licen | opensource org licenses mit
mit | 2 | 0.8 | licen | the mit licen[sc]e
mit | 2 | 0.8 | licen | mit licen[sc]ed?
mit | 2 | 0.7 | licen | expat licen[sc]e
mit | 2 | 0.7 | licen | x11 licen[sc]e
mit-0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier mit 0
mit-0 | 2 | 0.9 | licen | mit no attribution licen[sc]e
apache-2.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier apache 2 0
apache-2.0 | 3 | 1.0 | licen | licensed under the apache licen[sc]e version 2 0
apache-2.0 | 3 | 1.0 | licen | apache org licenses licen[sc]e 2 0
apache-2.0 | 3 | 0.9 | licen | you may not use this file except in compliance with the licen[sc]e
apache-2.0 | 2 | 0.9 | licen | apache (?:software )?licen[sc]e version 2(?: 0)?
apache-2.0 | 2 | 0.9 | licen | apache (?:software )?licen[sc]e v?2(?: 0)?
apache-2.0 | 2 | 0.8 | licen | apache 2(?: 0)? licen[sc]ed?
apache-1.1 | 3 | 1.0 | spdx | spdx licen[sc]e identifier apache 1 1
apache-1.1 | 2 | 0.9 | licen | apache (?:software )?licen[sc]e (?:version |v)?1 1
apache-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier apache 1 0
apache-1.0 | 2 | 0.9 | licen | apache (?:software )?licen[sc]e (?:version |v)?1 0
apache | 1 | 0.6 | licen | apache licen[sc]e
gpl-3.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier gpl 3 0(?: only| or later)?
gpl-3.0 | 3 | 1.0 | licen | (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e (?:version |v)3(?: 0)?
gpl-3.0 | 3 | 1.0 | licen | gnu general public licen[sc]e as published by the free software foundation either version 3
gpl-3.0 | 2 | 0.9 | licen | (?:gnu )?general public licen[sc]e (?:version |v)?3(?: 0)?
gpl-3.0 | 2 | 0.9 | gpl | (?:gnu )?gpl ?v?3(?: 0)?
gpl-2.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier gpl 2 0(?: only| or later)?
gpl-2.0 | 3 | 1.0 | licen | (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e (?:version |v)2(?: 0)?
gpl-2.0 | 3 | 1.0 | licen | gnu general public licen[sc]e as published by the free software foundation either version 2
gpl-2.0 | 2 | 0.9 | licen | (?:gnu )?general public licen[sc]e (?:version |v)?2(?: 0)?
gpl-2.0 | 2 | 0.9 | gpl | (?:gnu )?gpl ?v?2(?: 0)?
gpl-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier gpl 1 0(?: only| or later)?
gpl-1.0 | 2 | 0.9 | licen | general public licen[sc]e (?:version |v)?1(?: 0)?
gpl | 3 | 0.9 | licen | gnu org licenses gpl(?: html| txt)?
gpl | 2 | 0.7 | licen | gnu general public licen[sc]e
gpl | 1 | 0.6 | licen | general public licen[sc]e
gpl | 1 | 0.5 | gpl | gnu gpl
lgpl-3.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier lgpl 3 0(?: only| or later)?
lgpl-3.0 | 2 | 0.9 | licen | (?:gnu )?lesser general public licen[sc]e (?:version |v)?3(?: 0)?
lgpl-3.0 | 2 | 0.9 | gpl | (?:gnu )?lgpl ?v?3(?: 0)?
lgpl-2.1 | 3 | 1.0 | spdx | spdx licen[sc]e identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 | 2 | 0.9 | licen | (?:gnu )?lesser general public licen[sc]e (?:version |v)?2 1
lgpl-2.1 | 2 | 0.9 | gpl | (?:gnu )?lgpl ?v?2 1
lgpl-2.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier lgpl 2 0(?: only| or later)?
lgpl-2.0 | 2 | 0.9 | licen | (?:gnu )?library general public licen[sc]e(?: (?:version |v)?2(?: 0)?)?
lgpl | 2 | 0.7 | licen | (?:gnu )?lesser general public licen[sc]e
lgpl | 1 | 0.5 | gpl | (?:gnu )?lgpl
agpl-3.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier agpl 3 0(?: only| or later)?
agpl-3.0 | 2 | 0.9 | licen | (?:gnu )?affero general public licen[sc]e (?:version |v)?3(?: 0)?
agpl-3.0 | 2 | 0.9 | gpl | (?:gnu )?agpl ?v?3(?: 0)?
agpl-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier agpl 1 0(?: only| or later)?
agpl | 2 | 0.7 | licen | (?:gnu )?affero general public licen[sc]e
agpl | 1 | 0.5 | gpl | (?:gnu )?agpl
gfdl-1.3 | 3 | 1.0 | spdx | spdx licen[sc]e identifier gfdl 1 3(?: only| or later)?
gfdl-1.3 | 2 | 0.9 | licen | gnu free documentation licen[sc]e (?:version |v)?1 3
gfdl-1.2 | 3 | 1.0 | spdx | spdx licen[sc]e identifier gfdl 1 2(?: only| or later)?
gfdl-1.2 | 2 | 0.9 | licen | gnu free documentation licen[sc]e (?:version |v)?1 2
gfdl | 2 | 0.7 | licen | gnu free documentation licen[sc]e
fsfap | 3 | 1.0 | spdx | spdx licen[sc]e identifier fsfap
fsfap | 2 | 0.9 | copyright | copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved
bsd-3-clause | 3 | 1.0 | spdx | spdx licen[sc]e identifier bsd 3 clause
bsd-3-clause | 3 | 1.0 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | 3 | 1.0 | licen | opensource org licenses bsd 3 clause
bsd-3-clause | 2 | 0.9 | licen | bsd (?:3|three) clause licen[sc]e
bsd-3-clause | 2 | 0.9 | licen | (?:3|three) clause bsd licen[sc]e
bsd-3-clause | 2 | 0.8 | licen | (?:new|modified|revised) bsd licen[sc]e
bsd-2-clause | 3 | 1.0 | spdx | spdx licen[sc]e identifier bsd 2 clause
bsd-2-clause | 3 | 1.0 | licen | opensource org licenses bsd 2 clause
bsd-2-clause | 2 | 0.9 | licen | bsd (?:2|two) clause licen[sc]e
bsd-2-clause | 2 | 0.9 | licen | (?:2|two) clause bsd licen[sc]e
bsd-2-clause | 2 | 0.8 | licen | (?:simplified|freebsd) (?:bsd )?licen[sc]e
bsd-4-clause | 3 | 1.0 | spdx | spdx licen[sc]e identifier bsd 4 clause
bsd-4-clause | 2 | 0.9 | licen | (?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd) licen[sc]e
0bsd | 3 | 1.0 | spdx | spdx licen[sc]e identifier 0bsd
0bsd | 2 | 0.9 | licen | (?:zero clause bsd|bsd zero clause|0bsd) licen[sc]e
bsd-1-clause | 3 | 1.0 | spdx | spdx licen[sc]e identifier bsd 1 clause
bsd-protection | 2 | 0.9 | licen | bsd protection licen[sc]e
bsd | 2 | 0.6 | licen | bsd licen[sc]e
bsd | 2 | 0.6 | licen | bsd style licen[sc]e
isc | 3 | 1.0 | spdx | spdx licen[sc]e identifier isc
isc | 3 | 1.0 | copyright | (?:permission to )?use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
isc | 2 | 0.8 | licen | isc licen[sc]e
mpl-2.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier mpl 2 0
mpl-2.0 | 3 | 1.0 | licen | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-2.0 | 2 | 0.9 | licen | mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?
mpl-1.1 | 3 | 1.0 | spdx | spdx licen[sc]e identifier mpl 1 1
mpl-1.1 | 2 | 0.9 | licen | mozilla public licen[sc]e (?:version |v ?)?1 1
mpl-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier mpl 1 0
mpl-1.0 | 2 | 0.9 | licen | mozilla public licen[sc]e (?:version |v ?)?1 0
mpl | 2 | 0.7 | licen | mozilla public licen[sc]e
epl-2.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier epl 2 0
epl-2.0 | 2 | 0.9 | licen | eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?
epl-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier epl 1 0
epl-1.0 | 2 | 0.9 | licen | eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?
epl | 2 | 0.7 | licen | eclipse public licen[sc]e
edl-1.0 | 2 | 0.9 | licen | eclipse distribution licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?
cddl-1.1 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cddl 1 1
cddl-1.1 | 2 | 0.9 | licen | common development and distribution licen[sc]e (?:cddl )?(?:version |v ?)?1 1
cddl-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cddl 1 0
cddl-1.0 | 2 | 0.9 | licen | common development and distribution licen[sc]e (?:cddl )?(?:version |v ?)?1 0
cddl | 2 | 0.7 | licen | common development and distribution licen[sc]e
cpl-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cpl 1 0
cpl-1.0 | 2 | 0.8 | licen | common public licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?
ipl-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier ipl 1 0
ipl-1.0 | 2 | 0.8 | licen | ibm public licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?
cpal-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cpal 1 0
cpal-1.0 | 2 | 0.8 | licen | common public attribution licen[sc]e
eupl-1.2 | 3 | 1.0 | spdx | spdx licen[sc]e identifier eupl 1 2
eupl-1.2 | 2 | 0.9 | licen | european union public licen[sc]e (?:version |v ?)?1 2
eupl-1.1 | 3 | 1.0 | spdx | spdx licen[sc]e identifier eupl 1 1
eupl-1.1 | 2 | 0.9 | licen | european union public licen[sc]e (?:version |v ?)?1 1
eupl | 2 | 0.7 | licen | european union public licen[sc]e
osl-3.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier osl 3 0
osl-3.0 | 2 | 0.9 | licen | open software licen[sc]e (?:version |v ?)?3(?: 0)?
osl-2.1 | 3 | 1.0 | spdx | spdx licen[sc]e identifier osl 2 1
osl | 2 | 0.6 | licen | open software licen[sc]e
afl-3.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier afl 3 0
afl-3.0 | 2 | 0.9 | licen | academic free licen[sc]e (?:version |v ?)?3(?: 0)?
afl-2.1 | 3 | 1.0 | spdx | spdx licen[sc]e identifier afl 2 1
afl | 2 | 0.6 | licen | academic free licen[sc]e
artistic-2.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier artistic 2 0
artistic-2.0 | 2 | 0.9 | licen | artistic licen[sc]e (?:version |v ?)?2(?: 0)?
artistic-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier artistic 1 0
artistic-1.0 | 2 | 0.9 | licen | artistic licen[sc]e (?:version |v ?)?1(?: 0)?
artistic | 2 | 0.6 | licen | (?:perl )?artistic licen[sc]e
bsl-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier bsl 1 0
bsl-1.0 | 3 | 1.0 | licen | distributed under the boost software licen[sc]e version 1 0
bsl-1.0 | 3 | 1.0 | licen | boost org licen[sc]e 1 0 txt
bsl-1.0 | 2 | 0.8 | licen | boost software licen[sc]e
busl-1.1 | 3 | 1.0 | spdx | spdx licen[sc]e identifier busl 1 1
busl-1.1 | 2 | 0.8 | licen | business source licen[sc]e(?: 1 1)?
sspl-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier sspl 1 0
sspl-1.0 | 2 | 0.8 | licen | server side public licen[sc]e
elastic-2.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier elastic 2 0
elastic-2.0 | 2 | 0.8 | licen | elastic licen[sc]e(?: 2(?: 0)?)?
polyform-noncommercial | 3 | 1.0 | spdx | spdx licen[sc]e identifier polyform noncommercial 1 0 0
polyform-noncommercial | 2 | 0.8 | licen | polyform noncommercial licen[sc]e
polyform-small-business | 2 | 0.8 | licen | polyform small business licen[sc]e
zlib | 3 | 1.0 | spdx | spdx licen[sc]e identifier zlib
zlib | 3 | 1.0 | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 2 | 0.8 | licen | zlib (?:libpng )?licen[sc]e
libpng | 3 | 1.0 | spdx | spdx licen[sc]e identifier libpng(?: 2 0)?
libpng | 2 | 0.8 | licen | libpng licen[sc]e
unlicense | 3 | 1.0 | spdx | spdx licen[sc]e identifier unlicense
unlicense | 3 | 1.0 | public domain | this is free and unencumbered software released into the public domain
unlicense | 2 | 0.8 | licen | the unlicense
wtfpl | 3 | 1.0 | spdx | spdx licen[sc]e identifier wtfpl
wtfpl | 2 | 0.9 | licen | do what the f[^ ]* you want to public licen[sc]e
wtfpl | 1 | 0.6 | wtfpl | wtfpl
cc0-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cc0 1 0
cc0-1.0 | 3 | 1.0 | public domain | creativecommons org publicdomain zero 1 0
cc0-1.0 | 2 | 0.9 | cc0 | cc0 1 0(?: universal)?
cc0-1.0 | 2 | 0.8 | cc0 | cc0(?: licen[sc]e)?
cc0-1.0 | 2 | 0.8 | creative commons | creative commons zero
cc-pdm | 2 | 0.8 | public domain | public domain mark(?: 1 0)?
cc-by-4.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cc by 4 0
cc-by-4.0 | 3 | 1.0 | licen | creativecommons org licenses by 4 0
cc-by-4.0 | 3 | 0.9 | licen | licensed under (?:a )?(?:creative commons )?cc by 4 0
cc-by-4.0 | 2 | 0.9 | cc by | cc by 4 0
cc-by-4.0 | 2 | 0.9 | creative commons | creative commons attribution 4 0(?: international)?(?: licen[sc]e)?
cc-by-3.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cc by 3 0
cc-by-3.0 | 3 | 1.0 | licen | creativecommons org licenses by 3 0
cc-by-3.0 | 2 | 0.9 | cc by | cc by 3 0
cc-by-3.0 | 2 | 0.9 | creative commons | creative commons attribution 3 0(?: unported)?(?: licen[sc]e)?
cc-by-2.5 | 2 | 0.9 | cc by | cc by 2 5
cc-by-2.0 | 2 | 0.9 | cc by | cc by 2 0
cc-by-1.0 | 2 | 0.9 | cc by | cc by 1 0
cc-by | 1 | 0.6 | cc by | cc by
cc-by | 1 | 0.6 | creative commons | creative commons attribution(?: licen[sc]e)?
cc-by-sa-4.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cc by sa 4 0
cc-by-sa-4.0 | 3 | 1.0 | licen | creativecommons org licenses by sa 4 0
cc-by-sa-4.0 | 3 | 0.9 | licen | licensed under (?:a )?(?:creative commons )?cc by sa 4 0
cc-by-sa-4.0 | 2 | 0.9 | cc by | cc by sa 4 0
cc-by-sa-4.0 | 2 | 0.9 | creative commons | creative commons attribution share ?alike 4 0(?: international)?(?: licen[sc]e)?
cc-by-sa-3.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cc by sa 3 0
cc-by-sa-3.0 | 3 | 1.0 | licen | creativecommons org licenses by sa 3 0
cc-by-sa-3.0 | 2 | 0.9 | cc by | cc by sa 3 0
cc-by-sa-3.0 | 2 | 0.9 | creative commons | creative commons attribution share ?alike 3 0(?: unported)?(?: licen[sc]e)?
cc-by-sa-2.5 | 2 | 0.9 | cc by | cc by sa 2 5
cc-by-sa-2.0 | 2 | 0.9 | cc by | cc by sa 2 0
cc-by-sa | 1 | 0.7 | cc by | cc by sa
cc-by-sa | 1 | 0.7 | creative commons | creative commons attribution share ?alike(?: licen[sc]e)?
cc-by-nc-4.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cc by nc 4 0
cc-by-nc-4.0 | 3 | 1.0 | licen | creativecommons org licenses by nc 4 0
cc-by-nc-4.0 | 3 | 0.9 | licen | licensed under (?:a )?(?:creative commons )?cc by nc 4 0
cc-by-nc-4.0 | 2 | 0.9 | cc by | cc by nc 4 0
cc-by-nc-4.0 | 2 | 0.9 | creative commons | creative commons attribution non ?commercial 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-3.0 | 2 | 0.9 | cc by | cc by nc 3 0
cc-by-nc-3.0 | 2 | 0.9 | creative commons | creative commons attribution non ?commercial 3 0(?: unported)?(?: licen[sc]e)?
cc-by-nc-2.0 | 2 | 0.9 | cc by | cc by nc 2 0
cc-by-nc | 1 | 0.7 | cc by | cc by nc
cc-by-nc | 1 | 0.7 | creative commons | creative commons attribution non ?commercial(?: licen[sc]e)?
cc-by-nd-4.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cc by nd 4 0
cc-by-nd-4.0 | 2 | 0.9 | cc by | cc by nd 4 0
cc-by-nd-4.0 | 2 | 0.9 | creative commons | creative commons attribution no ?derivatives 4 0(?: international)?(?: licen[sc]e)?
cc-by-nd-3.0 | 2 | 0.9 | cc by | cc by nd 3 0
cc-by-nd | 1 | 0.7 | cc by | cc by nd
cc-by-nc-sa-4.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cc by nc sa 4 0
cc-by-nc-sa-4.0 | 3 | 1.0 | licen | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-4.0 | 2 | 0.9 | cc by | cc by nc sa 4 0
cc-by-nc-sa-4.0 | 2 | 0.9 | creative commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-sa-3.0 | 2 | 0.9 | cc by | cc by nc sa 3 0
cc-by-nc-sa | 1 | 0.7 | cc by | cc by nc sa
cc-by-nc-nd-4.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cc by nc nd 4 0
cc-by-nc-nd-4.0 | 3 | 1.0 | licen | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-4.0 | 2 | 0.9 | cc by | cc by nc nd 4 0
cc-by-nc-nd-4.0 | 2 | 0.9 | creative commons | creative commons attribution non ?commercial no ?derivatives 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-nd-3.0 | 2 | 0.9 | cc by | cc by nc nd 3 0
cc-by-nc-nd | 1 | 0.7 | cc by | cc by nc nd
cc | 1 | 0.5 | creative commons | creative commons(?: licen[sc]es?)?
odbl-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier odbl 1 0
odbl-1.0 | 2 | 0.9 | licen | open (?:data commons open )?database licen[sc]e(?: (?:odbl )?(?:v ?)?1 0)?
odc-by-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier odc by 1 0
odc-by-1.0 | 2 | 0.9 | licen | open data commons attribution licen[sc]e
pddl-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier pddl 1 0
pddl-1.0 | 2 | 0.9 | public domain | (?:open data commons )?public domain dedication and licen[sc]e
cdla-permissive-2.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cdla permissive 2 0
cdla-permissive-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cdla permissive 1 0
cdla-permissive | 2 | 0.8 | licen | community data licen[sc]e agreement permissive
cdla-sharing-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cdla sharing 1 0
cdla-sharing | 2 | 0.8 | licen | community data licen[sc]e agreement sharing
ogl-uk-3.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier ogl uk 3 0
ogl-uk-3.0 | 2 | 0.9 | licen | open government licen[sc]e (?:version |v ?)?3(?: 0)?
ogl | 2 | 0.7 | licen | open government licen[sc]e
ofl-1.1 | 3 | 1.0 | spdx | spdx licen[sc]e identifier ofl 1 1
ofl-1.1 | 2 | 0.9 | licen | sil open font licen[sc]e(?: (?:version |v ?)?1 1)?
ofl-1.0 | 2 | 0.9 | licen | sil open font licen[sc]e (?:version |v ?)?1 0
ofl | 1 | 0.6 | licen | open font licen[sc]e
python-2.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier python 2 0
psf-2.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier psf 2 0
psf-2.0 | 2 | 0.8 | licen | python software foundation licen[sc]e(?: (?:version |v ?)?2)?
ruby | 3 | 1.0 | spdx | spdx licen[sc]e identifier ruby
ruby | 2 | 0.7 | licen | ruby licen[sc]e
php-3.01 | 3 | 1.0 | spdx | spdx licen[sc]e identifier php 3 01
php-3.01 | 2 | 0.8 | licen | php licen[sc]e (?:version |v ?)?3 01
php-3.0 | 2 | 0.8 | licen | php licen[sc]e (?:version |v ?)?3 0
postgresql | 3 | 1.0 | spdx | spdx licen[sc]e identifier postgresql
postgresql | 2 | 0.8 | licen | postgresql licen[sc]e
openssl | 3 | 1.0 | spdx | spdx licen[sc]e identifier openssl
openssl | 2 | 0.8 | licen | openssl licen[sc]e
curl | 3 | 1.0 | spdx | spdx licen[sc]e identifier curl
curl | 2 | 0.7 | licen | curl licen[sc]e
ncsa | 3 | 1.0 | spdx | spdx licen[sc]e identifier ncsa
ncsa | 2 | 0.8 | licen | university of illinois ncsa open source licen[sc]e
ncsa | 2 | 0.7 | licen | ncsa (?:open source )?licen[sc]e
upl-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier upl 1 0
upl-1.0 | 2 | 0.8 | licen | universal permissive licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?
ms-pl | 3 | 1.0 | spdx | spdx licen[sc]e identifier ms pl
ms-pl | 2 | 0.8 | licen | microsoft public licen[sc]e
ms-rl | 3 | 1.0 | spdx | spdx licen[sc]e identifier ms rl
ms-rl | 2 | 0.8 | licen | microsoft reciprocal licen[sc]e
w3c | 3 | 1.0 | spdx | spdx licen[sc]e identifier w3c
w3c | 2 | 0.8 | licen | w3c software (?:notice and )?licen[sc]e
unicode-dfs-2016 | 3 | 1.0 | spdx | spdx licen[sc]e identifier unicode dfs 2016
unicode-3.0 | 2 | 0.8 | licen | unicode licen[sc]e(?: v3)?
lppl-1.3c | 3 | 1.0 | spdx | spdx licen[sc]e identifier lppl 1 3c
lppl | 2 | 0.8 | licen | latex project public licen[sc]e(?: (?:version |v ?)?1 3c?)?
vim | 3 | 1.0 | spdx | spdx licen[sc]e identifier vim
vim | 2 | 0.7 | licen | vim licen[sc]e
beerware | 3 | 1.0 | spdx | spdx licen[sc]e identifier beerware
beerware | 2 | 0.8 | licen | beer ?ware licen[sc]e
json | 3 | 1.0 | spdx | spdx licen[sc]e identifier json
json | 2 | 0.8 | licen | json licen[sc]e
mulanpsl-2.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier mulanpsl 2 0
mulanpsl | 2 | 0.8 | licen | mulan permissive software licen[sc]e(?: v(?:ersion )?2)?
cecill-2.1 | 3 | 1.0 | spdx | spdx licen[sc]e identifier cecill 2 1
cecill | 2 | 0.8 | licen | cecill(?: [bc])? (?:free software )?licen[sc]e
qpl-1.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier qpl 1 0
qpl-1.0 | 2 | 0.8 | licen | q public licen[sc]e
sleepycat | 3 | 1.0 | spdx | spdx licen[sc]e identifier sleepycat
sleepycat | 2 | 0.8 | licen | sleepycat licen[sc]e
zpl-2.1 | 3 | 1.0 | spdx | spdx licen[sc]e identifier zpl 2 1
zpl | 2 | 0.8 | licen | zope public licen[sc]e(?: (?:version |v ?)?2 [01])?
apsl-2.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier apsl 2 0
apsl | 2 | 0.8 | licen | apple public source licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?
nasa-1.3 | 3 | 1.0 | spdx | spdx licen[sc]e identifier nasa 1 3
nasa | 2 | 0.8 | licen | nasa open source agreement licen[sc]e
rpl-1.5 | 3 | 1.0 | spdx | spdx licen[sc]e identifier rpl 1 5
rpl | 2 | 0.8 | licen | reciprocal public licen[sc]e
blueoak-1.0.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier blueoak 1 0 0
blueoak-1.0.0 | 2 | 0.8 | licen | blue oak model licen[sc]e
ecl-2.0 | 3 | 1.0 | spdx | spdx licen[sc]e identifier ecl 2 0
ecl-2.0 | 2 | 0.8 | licen | educational community licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?
openrail | 2 | 0.8 | licen | (?:creativeml )?open rail(?: m)? licen[sc]e
llama | 2 | 0.8 | licen | llama (?:2|3) community licen[sc]e(?: agreement)?
proprietary | 2 | 0.6 | rights reserved | all rights reserved
proprietary | 2 | 0.7 | licen | (?:proprietary|commercial) licen[sc]e
proprietary | 2 | 0.7 | licen | end user licen[sc]e agreement
public-domain | 2 | 0.7 | public domain | (?:released|placed|dedicated) (?:in|to|into) the public domain
public-domain | 1 | 0.4 | public domain | public domain
copyleft | 1 | 0.3 | copyleft | copyleft
other-spdx | 1 | 0.5 | spdx | spdx licen[sc]e identifier [^ ]+
notice | 1 | 0.3 | copyright | copyright (?:c )?(?:19|20)[0-9][0-9]
notice | 1 | 0.3 | licen | licensed under
notice | 1 | 0.3 | licen | see (?:the )?licen[sc]e (?:file )?for
"""


def rules() -> list[dict[str, object]]:
    """The table's rows, numbered in order; a pattern's spaces are doubled, as in the text it runs over."""
    rows = [[x.strip() for x in line.split(" | ", 4)] for line in _RULES.strip().splitlines()]
    return [{"n": n, "label": a, "prio": int(b), "weight": float(c), "kw": kw.replace(" ", "  "), "rx": f" {re.sub(' ', '  ', rx)} ".replace("  ?", "(?:  )?")} for n, (a, b, c, kw, rx) in enumerate(rows)]
