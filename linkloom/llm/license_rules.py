"""Signature rules of licences: one per line, hand-written.

Columns: priority (3: full text or formal notice, 2: name with version, 1: bare mention),
label, keyword that any match contains and that begins a word, regex over words. Words are lower case, of letters
and digits, with single blanks between them; so ``2.0`` is ``2 0``.
"""

from __future__ import annotations

from typing import NamedTuple

TEXT = r"""
3 gpl-1.0 | general public | gnu general public license as published by the free software foundation (?:either )?version 1
3 gpl-2.0-only | general public | gnu general public license version 2 as published by the free software foundation
3 gpl-2.0-only | general public | gnu general public license (?:v ?2|version 2) only
3 gpl-2.0-or-later | general public | gnu general public license as published by the free software foundation (?:either )?version 2 of the license or at your option any later version
3 gpl-2.0-or-later | general public | gnu general public license (?:v2|v 2|version 2) or (?:any )?later
3 gpl-3.0-only | general public | gnu general public license version 3 as published by the free software foundation
3 gpl-3.0-only | general public | gnu general public license (?:v ?3|version 3) only
3 gpl-3.0-or-later | general public | gnu general public license as published by the free software foundation (?:either )?version 3 of the license or at your option any later version
3 gpl-3.0-or-later | general public | gnu general public license (?:v3|v 3|version 3) or (?:any )?later
3 gpl | distributed in the hope | this program is distributed in the hope that it will be useful but without any warranty
3 gpl | redistribute it and | is free software you can redistribute it and or modify it under the terms of the gnu general public license
3 lgpl | redistribute it and | is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
3 agpl | redistribute it and | is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
2 gpl-1.0 | general public | gnu general public license (?:v ?1|version 1)(?: 0)?
2 gpl-2.0 | general public | gnu general public license (?:v ?2|version 2)(?: 0)?
2 gpl-3.0 | general public | gnu general public license (?:v ?3|version 3)(?: 0)?
2 gpl-1.0 | gpl | gnu gpl (?:v ?1|version 1)(?: 0)?
2 gpl-2.0 | gpl | (?:gnu )?gpl ?(?:v ?2|version 2|2)(?: 0)?
2 gpl-3.0 | gpl | (?:gnu )?gpl ?(?:v ?3|version 3|3)(?: 0)?
2 gpl-2.0 | gplv2 | (?:gnu )?gplv2
2 gpl-3.0 | gplv3 | (?:gnu )?gplv3
2 gpl-2.0-with-classpath-exception | classpath | (?:gpl|gnu general public license) (?:v ?2|version 2|2)?(?: 0)? ?with (?:the )?classpath exception
2 gpl-3.0-with-gcc-exception | runtime library exception | gcc runtime library exception(?: version 3 1)?
2 gpl-with-linking-exception | special exception | as a special exception .{0,80}permission to link
1 gpl | general public | gnu general public licen[sc]e
1 gpl | gnu gpl | gnu gpl
1 gpl | gpl | gpl licen[sc]ed?
3 lgpl-2.1-or-later | lesser general | gnu lesser general public license as published by the free software foundation (?:either )?version 2 1 of the license or at your option any later version
3 lgpl-3.0-or-later | lesser general | gnu lesser general public license as published by the free software foundation (?:either )?version 3 of the license or at your option any later version
3 lgpl-2.0-or-later | library general | gnu library general public license as published by the free software foundation (?:either )?version 2 of the license or at your option any later version
2 lgpl-2.0 | library general | gnu library general public license (?:v ?2|version 2)(?: 0)?
2 lgpl-2.1 | lesser general | gnu lesser general public license (?:v ?2 1|version 2 1)
2 lgpl-3.0 | lesser general | gnu lesser general public license (?:v ?3|version 3)(?: 0)?
2 lgpl-2.0 | lgpl | (?:gnu )?lgpl ?(?:v ?2|version 2|2)(?: 0)?
2 lgpl-2.1 | lgpl | (?:gnu )?lgpl ?(?:v ?2 1|version 2 1|2 1)
2 lgpl-3.0 | lgpl | (?:gnu )?lgpl ?(?:v ?3|version 3|3)(?: 0)?
1 lgpl | lesser general | gnu lesser general public licen[sc]e
1 lgpl | library general | gnu library general public licen[sc]e
1 lgpl | lgpl | lgpl licen[sc]ed?
3 agpl-3.0-or-later | affero | gnu affero general public license as published by the free software foundation (?:either )?version 3 of the license or at your option any later version
2 agpl-1.0 | affero | affero general public license (?:v ?1|version 1)(?: 0)?
2 agpl-3.0 | affero | (?:gnu )?affero general public license (?:v ?3|version 3)(?: 0)?
2 agpl-3.0 | agpl | (?:gnu )?agpl ?(?:v ?3|version 3|3)(?: 0)?
1 agpl | affero | (?:gnu )?affero general public licen[sc]e
1 agpl | agpl | agpl licen[sc]ed?
2 gfdl-1.1 | free documentation | gnu free documentation license (?:v ?1 1|version 1 1)
2 gfdl-1.2 | free documentation | gnu free documentation license (?:v ?1 2|version 1 2)
2 gfdl-1.3 | free documentation | gnu free documentation license (?:v ?1 3|version 1 3)
3 gfdl | free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
1 gfdl | free documentation | gnu free documentation licen[sc]e
1 gfdl | gfdl | gfdl
3 apache-2.0 | apache license | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
3 apache-2.0 | apache | (?:https? )?(?:www )?apache org licenses license 2 0
3 apache-2.0 | apache | licensed to the apache software foundation asf under one or more contributor license agreements
2 apache-1.0 | apache | apache (?:software )?licen[sc]e (?:v ?1|version 1)(?: 0)?
2 apache-1.1 | apache | apache (?:software )?licen[sc]e (?:v ?1 1|version 1 1)
2 apache-2.0 | apache | apache (?:software )?licen[sc]e (?:v ?2|version 2|2)(?: 0)?
2 apache-2.0 | apache | apache 2 0(?: licen[sc]ed?)?
2 apache-2.0 | alv2 | alv2
1 apache | apache | apache (?:software )?licen[sc]e
3 mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
3 mit | the above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
3 mit | software is provided as is | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
3 mit-0 | without restriction | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .{0,300}to do so the software is provided as is
2 mit-0 | mit no attribution | mit no attribution(?: license)?
2 mit | mit licen | (?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of the )?mit licen[sc]e
2 mit | mit licen | (?:x11|expat) mit licen[sc]e
1 mit | mit licen | mit licen[sc]e
1 mit | mit licen | mit licensed
2 x11 | x11 | x11 licen[sc]e
2 mit | expat licen | expat licen[sc]e
3 mit-cmu | permission to use copy | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
3 isc | permission to use copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1 isc | isc licen | isc licen[sc]e
3 0bsd | permission to use copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
2 0bsd | zero clause | (?:bsd )?zero clause bsd(?: licen[sc]e)?
2 0bsd | 0bsd | 0bsd
3 bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
3 bsd-3-clause | endorse or promote | neither the name of .{1,120}nor the names of (?:its|their) contributors may be used to endorse or promote products
3 bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
2 bsd-1-clause | 1 clause | (?:bsd 1 clause|1 clause bsd)(?: licen[sc]e)?
2 bsd-2-clause | 2 clause | (?:bsd 2 clause|2 clause bsd)(?: licen[sc]e)?
2 bsd-3-clause | 3 clause | (?:bsd 3 clause|3 clause bsd)(?: licen[sc]e)?
2 bsd-4-clause | 4 clause | (?:bsd 4 clause|4 clause bsd)(?: licen[sc]e)?
2 bsd-2-clause | simplified bsd | simplified bsd licen[sc]e
2 bsd-2-clause | freebsd licen | freebsd licen[sc]e
2 bsd-3-clause | new bsd | new bsd licen[sc]e
2 bsd-3-clause | bsd licen | (?:revised|modified) bsd licen[sc]e
2 bsd-4-clause | original bsd | original bsd licen[sc]e
1 bsd | bsd | bsd (?:style )?licen[sc]ed?
3 mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
3 mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
2 mpl-1.0 | mozilla | mozilla public licen[sc]e (?:v ?1|version 1)(?: 0)?
2 mpl-1.1 | mozilla | mozilla public licen[sc]e (?:v ?1 1|version 1 1)
2 mpl-2.0 | mozilla | mozilla public licen[sc]e (?:v ?2|version 2)(?: 0)?
2 mpl-2.0 | mpl v | mpl (?:v ?2|version 2)(?: 0)?
2 mpl-2.0 | mpl 2 | mpl 2(?: 0)?
1 mpl | mozilla | mozilla public licen[sc]e
3 epl-1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
3 epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0
2 epl-1.0 | eclipse | eclipse public licen[sc]e (?:v ?1|version 1|1)(?: 0)?
2 epl-2.0 | eclipse | eclipse public licen[sc]e (?:v ?2|version 2|2)(?: 0)?
1 epl | eclipse | eclipse public licen[sc]e
2 edl-1.0 | eclipse distribution | eclipse distribution licen[sc]e(?: v ?1 0)?
2 cddl-1.0 | development and distribution | common development and distribution licen[sc]e (?:v ?1|version 1)(?: 0)?
2 cddl-1.1 | development and distribution | common development and distribution licen[sc]e (?:v ?1 1|version 1 1)
1 cddl | development and distribution | common development and distribution licen[sc]e
1 cddl | cddl | cddl
2 cpl-1.0 | common public | common public licen[sc]e (?:v ?1|version 1)(?: 0)?
1 cpl | common public | common public licen[sc]e
2 cpal-1.0 | common public attribution | common public attribution licen[sc]e(?: version 1 0)?
2 eupl-1.1 | european union | european union public licen[sc]e (?:v ?1 1|version 1 1)
2 eupl-1.2 | european union | european union public licen[sc]e (?:v ?1 2|version 1 2)
1 eupl | european union | european union public licen[sc]e
1 eupl | eupl | eupl
2 ms-pl | microsoft public | microsoft public licen[sc]e
2 ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e
3 unlicense | unencumbered | this is free and unencumbered software released into the public domain
1 unlicense | unlicense | the unlicense
1 unlicense | unlicense | unlicensed? org
3 wtfpl | just do what the | you just do what the fuck you want to
2 wtfpl | what the f | do what the f(?:uck)? you want to public licen[sc]e
1 wtfpl | wtfpl | wtfpl
3 zlib | misrepresented | the origin of this software must not be misrepresented
2 zlib | zlib licen | zlib licen[sc]e
2 zlib | zlib libpng licen | zlib libpng licen[sc]e
2 libpng | libpng | libpng licen[sc]e
2 boost-1.0 | boost software | boost software licen[sc]e (?:v ?1|version 1)(?: 0)?
3 boost-1.0 | boost software | distributed under the boost software license version 1 0
1 boost | boost software | boost software licen[sc]e
2 artistic-1.0 | artistic licen | artistic licen[sc]e (?:v ?1|version 1|1)(?: 0)?
2 artistic-2.0 | artistic licen | artistic licen[sc]e (?:v ?2|version 2|2)(?: 0)?
1 artistic | artistic licen | artistic licen[sc]e
2 artistic-perl | same terms as perl | under the same terms as perl(?: itself)?
2 psf-2.0 | python software | python software foundation licen[sc]e (?:v ?2|version 2)(?: 0)?
1 psf | python software | python software foundation licen[sc]e
2 python-2.0 | python licen | python licen[sc]e (?:v ?2|version 2|2)(?: 0)?
2 ruby | ruby licen | ruby licen[sc]e
2 php-3.0 | php licen | php licen[sc]e (?:v ?3|version 3)(?: 0)
2 php-3.01 | php licen | php licen[sc]e (?:v ?3 01|version 3 01)
1 php | php licen | php licen[sc]e
2 zpl-2.1 | zope public | zope public licen[sc]e (?:v ?2 1|version 2 1)
1 zpl | zope public | zope public licen[sc]e
2 openssl | openssl | openssl licen[sc]e
3 openssl | openssl | this product includes software developed by the openssl project
2 ofl-1.1 | open font | sil open font licen[sc]e (?:v ?1 1|version 1 1)
2 ofl-1.0 | open font | sil open font licen[sc]e (?:v ?1 0|version 1 0)
1 ofl | open font | (?:sil )?open font licen[sc]e
2 ncsa | ncsa | university of illinois ncsa open source licen[sc]e
1 ncsa | ncsa | ncsa licen[sc]e
2 postgresql | postgresql | postgresql licen[sc]e
2 json | good not evil | the software shall be used for good not evil
1 json | json licen | json licen[sc]e
2 beerware | beerware licen | the beerware licen[sc]e
2 beerware | beer ware licen | the beer ware licen[sc]e
1 beerware | beerware | beerware
2 upl-1.0 | universal permissive | universal permissive licen[sc]e(?: v ?1 0)?
2 osl-3.0 | open software licen | open software licen[sc]e (?:v ?3|version 3)(?: 0)?
2 afl-3.0 | academic free licen | academic free licen[sc]e (?:v ?3|version 3)(?: 0)?
1 osl | open software licen | open software licen[sc]e
1 afl | academic free licen | academic free licen[sc]e
2 ecl-2.0 | educational community licen | educational community licen[sc]e (?:v ?2|version 2)(?: 0)?
2 cecill-2.1 | cecill | cecill (?:free software )?licen[sc]e(?: agreement)? (?:v ?2 1|version 2 1)
2 cecill-b | cecill | cecill b
2 cecill-c | cecill | cecill c
1 cecill | cecill | cecill
2 mulan-psl-2.0 | mulan | mulan (?:psl|permissive software licen[sc]e) ?(?:v ?2|version 2)
1 mulan-psl | mulan | mulan psl
2 sspl-1.0 | server side public | server side public licen[sc]e(?: v ?1| version 1)?
2 busl-1.1 | business source | business source licen[sc]e (?:v ?1 1|version 1 1|1 1)
1 busl | business source | business source licen[sc]e
2 elastic-2.0 | elastic licen | elastic licen[sc]e (?:v ?2|version 2|2)(?: 0)?
1 elastic | elastic licen | elastic licen[sc]e
2 commons-clause | commons clause | commons clause(?: licen[sc]e condition v1 0)?
2 polyform-noncommercial | polyform | polyform noncommercial(?: licen[sc]e)?(?: 1 0 0)?
2 polyform-small-business | polyform | polyform small business(?: licen[sc]e)?
2 openrail | openrail | (?:creativeml |bigcode )?openrail(?: m)?
2 llama-community | community licen | llama (?:2 |3 |3 1 )?community licen[sc]e
2 cc-by-1.0 | cc by | cc by 1 0
2 cc-by-2.0 | cc by | cc by 2 0
2 cc-by-2.5 | cc by | cc by 2 5
2 cc-by-3.0 | cc by | cc by 3 0
2 cc-by-4.0 | cc by | cc by 4 0
2 cc-by-sa-1.0 | cc by sa | cc by sa 1 0
2 cc-by-sa-2.0 | cc by sa | cc by sa 2 0
2 cc-by-sa-2.5 | cc by sa | cc by sa 2 5
2 cc-by-sa-3.0 | cc by sa | cc by sa 3 0
2 cc-by-sa-4.0 | cc by sa | cc by sa 4 0
2 cc-by-nc-2.0 | cc by nc | cc by nc 2 0
2 cc-by-nc-2.5 | cc by nc | cc by nc 2 5
2 cc-by-nc-3.0 | cc by nc | cc by nc 3 0
2 cc-by-nc-4.0 | cc by nc | cc by nc 4 0
2 cc-by-nd-2.0 | cc by nd | cc by nd 2 0
2 cc-by-nd-3.0 | cc by nd | cc by nd 3 0
2 cc-by-nd-4.0 | cc by nd | cc by nd 4 0
2 cc-by-nc-sa-2.0 | cc by nc sa | cc by nc sa 2 0
2 cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa 3 0
2 cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
2 cc-by-nc-nd-2.0 | cc by nc nd | cc by nc nd 2 0
2 cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd 3 0
2 cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
1 cc-by-sa | cc by sa | cc by sa
1 cc-by-nc | cc by nc | cc by nc
1 cc-by-nd | cc by nd | cc by nd
1 cc-by-nc-sa | cc by nc sa | cc by nc sa
1 cc-by-nc-nd | cc by nc nd | cc by nc nd
3 cc-by-3.0 | creativecommons | creativecommons org licenses by 3 0
3 cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
3 cc-by-sa-3.0 | creativecommons | creativecommons org licenses by sa 3 0
3 cc-by-sa-4.0 | creativecommons | creativecommons org licenses by sa 4 0
3 cc-by-nc-3.0 | creativecommons | creativecommons org licenses by nc 3 0
3 cc-by-nc-4.0 | creativecommons | creativecommons org licenses by nc 4 0
3 cc-by-nd-4.0 | creativecommons | creativecommons org licenses by nd 4 0
3 cc-by-nc-sa-4.0 | creativecommons | creativecommons org licenses by nc sa 4 0
3 cc-by-nc-nd-4.0 | creativecommons | creativecommons org licenses by nc nd 4 0
3 cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
2 cc-by-4.0 | creative commons | creative commons attribution 4 0(?: international)?(?: (?:public )?licen[sc]e)?
2 cc-by-3.0 | creative commons | creative commons attribution 3 0(?: unported)?(?: licen[sc]e)?
2 cc-by-sa-4.0 | creative commons | creative commons attribution share ?alike 4 0(?: international)?(?: (?:public )?licen[sc]e)?
2 cc-by-sa-3.0 | creative commons | creative commons attribution share ?alike 3 0(?: unported)?(?: licen[sc]e)?
2 cc-by-nc-4.0 | creative commons | creative commons attribution non ?commercial 4 0(?: international)?(?: (?:public )?licen[sc]e)?
2 cc-by-nc-sa-4.0 | creative commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: (?:public )?licen[sc]e)?
2 cc-by-nc-nd-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
2 cc-by-nd-4.0 | creative commons | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
1 cc-by-nc | creative commons | creative commons attribution non ?commercial
1 cc-by-sa | creative commons | creative commons attribution share ?alike
1 cc-by | creative commons | creative commons attribution(?: licen[sc]e)?
2 cc0-1.0 | cc0 | cc0(?: 1 0)?
2 cc0-1.0 | cc zero | cc zero(?: 1 0)?
1 cc | creative commons | creative commons licen[sc]e
2 pddl-1.0 | public domain dedication | (?:open data commons )?public domain dedication and licen[sc]e
2 odbl-1.0 | open database | (?:open data commons )?open database licen[sc]e
2 odc-by-1.0 | open data commons | open data commons attribution licen[sc]e
2 ogl-uk-3.0 | open government | open government licen[sc]e (?:v ?3|version 3)(?: 0)?
1 ogl-uk | open government | open government licen[sc]e
1 public-domain | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
1 public-domain | public domain | (?:is|are) in the public domain
2 proprietary | all rights reserved | proprietary and confidential all rights reserved
1 proprietary | all rights reserved | all rights reserved
2 proprietary | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
2 proprietary | redistribut | redistribution (?:is )?(?:strictly )?(?:prohibited|forbidden)
1 proprietary | commercial licen | commercial licen[sc]e (?:agreement|required)
1 proprietary | end user licen | end user licen[sc]e agreement
2 freeware | freeware | (?:this software is|distributed as) freeware
2 shareware | shareware | (?:this software is|distributed as) shareware
3 spdx | spdx | spdx license identifier [0-9a-z]+(?: [0-9a-z]+){0,4}
"""


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    regex: str


def parse(text: str) -> list[Rule]:
    rules = []
    for line in text.strip().splitlines():
        head, keyword, regex = line.split(" | ", 2)
        priority, label = head.split(" ", 1)
        rules.append(Rule(int(priority), label.strip(), keyword.strip(), regex.strip()))
    return rules


RULES = parse(TEXT)
