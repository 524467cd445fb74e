"""Signature rules for licenses: (label, priority, patterns), in order.

Patterns see a text as lower-case words with one space between, before and after (so ``version 2.0``
is ``version 2 0``). A pattern is tried only if the longest literal that each match of it holds is in the text. Of detections where one
lies within another's words, the one of higher priority stays, then the longer, then the earlier rule.
"""

V2, V3 = r"(?:version |v ?)?2(?: 0)?", r"(?:version |v ?)?3(?: 0)?"

RULES: list[tuple[str, int, list[str]]] = [
    ("spdx", 10, [r"spdx license identifier(?: \S+){1,4}"]),
    ("mit", 50, [r"under the mit license", r"mit license", r"licensed under (?:the )?mit", r"released under (?:the )?mit", r"license mit", r"mit licensed", r"the mit license mit", r"mit x11 license", r"expat license", r"license identifier mit", r"licence mit", r"sous licence mit", r"mit lizenz", r"licencia mit", r"dual mit"]),
    ("mit", 40, [r"permission is hereby granted free of charge to any person obtaining a copy", r"to deal in the software without restriction including without limitation the rights", r"the above copyright notice and this permission notice shall be included in all copies"]),
    ("mit-0", 60, [r"mit no attribution", r"license identifier mit 0", r"mit 0 license"]),
    ("apache-2", 50, [rf"apache license {V2}", rf"apache software license {V2}", r"apache license version 2 0", r"license identifier apache 2 0", rf"licensed under (?:the )?apache (?:license )?{V2}", r"apache 2 0 license", r"apache 2 license", r"asl 2 0", r"licence apache(?: version)? 2(?: 0)?", r"apache lizenz(?: version)? 2(?: 0)?", r"licencia apache(?: version)? 2(?: 0)?", r"apache org licenses license 2 0"]),
    ("apache-2", 40, [r"licensed under the apache license", r"you may not use this file except in compliance with the license", r"apache license"]),
    ("apache-1.1", 50, [r"apache (?:software )?license (?:version )?1 1", r"license identifier apache 1 1"]),
    ("apache-1.0", 50, [r"apache (?:software )?license (?:version )?1 0", r"license identifier apache 1 0"]),
    ("gpl-3", 60, [rf"gnu general public license {V3}", r"general public license as published by the free software foundation either version 3", r"general public license(?: gpl)? version 3", r"general public license(?: gnu gpl)? v3"]),
    ("gpl-3", 60, [r"gpl ?v? ?3(?: 0)?", r"gplv3", r"gpl version 3", r"gpl 3 0 (?:only|or later)", r"gnu gpl 3", r"license identifier gpl 3 0(?: or later| only)?"]),
    ("gpl-2", 60, [rf"gnu general public license {V2}", r"general public license as published by the free software foundation either version 2", r"general public license(?: gpl)? version 2", r"general public license(?: gnu gpl)? v2"]),
    ("gpl-2", 60, [r"gpl ?v? ?2(?: 0)?", r"gplv2", r"gpl version 2", r"gpl 2 0 (?:only|or later)", r"gnu gpl 2", r"license identifier gpl 2 0(?: or later| only)?"]),
    ("gpl-1", 60, [r"gnu general public license (?:version |v ?)?1", r"general public license version 1"]),
    ("gpl", 30, [r"gnu general public license", r"general public license as published by the free software foundation", r"under the terms of the gnu general public license"]),
    ("gpl", 30, [r"licensed under (?:the )?(?:gnu )?gpl", r"gnu gpl", r"gpl licensed", r"gpl license", r"licence gpl", r"licencia gpl", r"gpl lizenz"]),
    ("lgpl-3", 70, [rf"(?:gnu )?lesser general public license {V3}", r"lesser general public license as published by the free software foundation either version 3"]),
    ("lgpl-3", 70, [r"lgpl ?v? ?3(?: 0)?", r"lgplv3", r"license identifier lgpl 3 0"]),
    ("lgpl-2.1", 70, [r"(?:gnu )?lesser general public license (?:version |v ?)?2 1", r"lesser general public license as published by the free software foundation either version 2 1"]),
    ("lgpl-2.1", 70, [r"lgpl ?v? ?2 1", r"lgplv2 1", r"license identifier lgpl 2 1"]),
    ("lgpl-2", 70, [rf"(?:gnu )?library general public license(?: {V2})?"]),
    ("lgpl", 35, [r"(?:gnu )?lesser general public license"]),
    ("lgpl", 35, [r"gnu lgpl", r"licensed under (?:the )?lgpl", r"lgpl licensed"]),
    ("agpl-3", 70, [rf"(?:gnu )?affero general public license(?: {V3})?", r"affero general public license as published by the free software foundation either version 3", r"affero gpl"]),
    ("agpl-3", 70, [r"agpl ?v? ?3(?: 0)?", r"agplv3", r"gnu agpl", r"license identifier agpl 3 0"]),
    ("gfdl", 60, [r"gnu free documentation license(?: version 1 [123])?", r"free documentation license"]),
    ("bsd-3", 50, [r"bsd 3 clause(?: license)?", r"3 clause bsd(?: license)?", r"three clause bsd(?: license)?", r"new bsd license", r"modified bsd license", r"revised bsd license", r"license identifier bsd 3 clause", r"bsd license 3 clause"]),
    ("bsd-3", 45, [r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products"]),
    ("bsd-2", 50, [r"bsd 2 clause(?: license)?", r"2 clause bsd(?: license)?", r"two clause bsd(?: license)?", r"simplified bsd license", r"freebsd license", r"license identifier bsd 2 clause"]),
    ("bsd-4", 50, [r"bsd 4 clause(?: license)?", r"4 clause bsd(?: license)?", r"original bsd license", r"old bsd license"]),
    ("bsd-4", 45, [r"all advertising materials mentioning features or use of this software must display the following acknowledgement"]),
    ("0bsd", 55, [r"0bsd", r"bsd zero clause license", r"zero clause bsd"]),
    ("bsd", 30, [r"bsd license", r"bsd style license", r"licensed under (?:the )?bsd", r"bsd licensed", r"licence bsd", r"bsd lizenz", r"licencia bsd"]),
    ("bsd", 25, [r"redistribution and use in source and binary forms with or without modification are permitted", r"redistributions of source code must retain the above copyright notice", r"redistributions in binary form must reproduce the above copyright notice"]),
    ("isc", 50, [r"isc license", r"licensed under (?:the )?isc", r"license identifier isc", r"isc licensed"]),
    ("isc", 40, [r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("mpl-2", 60, [rf"mozilla public license(?: mpl)? {V2}", r"mozilla public license v 2 0", r"subject to the terms of the mozilla public license v 2 0"]),
    ("mpl-2", 60, [r"mpl ?v? ?2(?: 0)?", r"license identifier mpl 2 0"]),
    ("mpl-1.1", 60, [r"mozilla public license (?:version |v ?)?1 1"]),
    ("mpl", 30, [r"mozilla public license"]),
    ("epl-2", 60, [rf"eclipse public license(?: epl)? {V2}"]),
    ("epl-2", 60, [r"epl ?v? ?2(?: 0)?", r"license identifier epl 2 0"]),
    ("epl-1", 60, [r"eclipse public license(?: epl)? (?:version |v ?)?1(?: 0)?"]),
    ("epl", 30, [r"eclipse public license", r"eclipse distribution license"]),
    ("cddl", 50, [r"common development and distribution license(?: (?:version |v ?)?1 [01])?"]),
    ("cddl", 50, [r"cddl(?: ?v? ?1 [01])?"]),
    ("cpl", 50, [r"common public license(?: version 1 0)?", r"common public attribution license"]),
    ("ibm-pl", 50, [r"ibm public license(?: version 1 0)?"]),
    ("eupl", 50, [r"european union public licen[cs]e(?: (?:version |v ?)?1 [012])?"]),
    ("eupl", 50, [r"eupl(?: ?v? ?1 [012])?"]),
    ("cecill", 50, [r"cecill(?: [abc])?(?: licen[cs]e)?(?: version 2(?: [01])?)?"]),
    ("artistic-2", 60, [r"artistic license (?:version |v ?)?2(?: 0)?", r"license identifier artistic 2 0"]),
    ("artistic", 30, [r"artistic license", r"perl artistic license", r"same terms as perl itself"]),
    ("zlib", 50, [r"zlib license", r"zlib libpng license", r"license identifier zlib"]),
    ("zlib", 40, [r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"]),
    ("boost", 50, [r"boost software license(?: (?:version |v ?)?1 0)?", r"license identifier bsl 1 0", r"boost org license 1 0"]),
    ("python", 50, [r"python software foundation license(?: version 2)?", r"psf license(?: agreement)?"]),
    ("php", 50, [r"php license(?: (?:version |v ?)?3(?: 0[01])?)?"]),
    ("ruby", 50, [r"ruby license", r"same license as ruby"]),
    ("openssl", 50, [r"openssl license", r"openssl toolkit"]),
    ("w3c", 50, [r"w3c software (?:notice and )?license", r"w3c document license"]),
    ("x11", 50, [r"x11 license"]),
    ("wtfpl", 50, [r"do what the (?:fuck|f ck) you want to public license"]),
    ("wtfpl", 50, [r"wtfpl(?: version 2)?"]),
    ("unlicense", 50, [r"the unlicense", r"unlicense org", r"license identifier unlicense", r"unlicense license"]),
    ("unlicense", 45, [r"this is free and unencumbered software released into the public domain"]),
    ("cc0", 60, [r"cc0(?: 1 0)?(?: universal)?", r"license identifier cc0 1 0"]),
    ("cc0", 60, [r"creative commons zero(?: v1 0)?", r"creative commons cc0"]),
    ("public-domain", 40, [r"(?:released|placed|dedicated) (?:in ?to|in|to) the public domain", r"public domain dedication", r"this (?:work|text|document|file|software) is (?:in )?(?:the )?public domain", r"public domain mark"]),
    ("public-domain", 40, [r"domaine public"]),
    ("public-domain", 40, [r"dominio p[úu]blico"]),
    ("public-domain", 40, [r"gemeinfrei"]),
    ("cc-by-nc-nd", 90, [r"cc by nc nd(?: [1-4] [05])?", r"license identifier cc by nc nd"]),
    ("cc-by-nc-nd", 90, [r"creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)?(?: [1-4] [05])?(?: international| unported)?"]),
    ("cc-by-nc-sa", 90, [r"cc by nc sa(?: [1-4] [05])?", r"license identifier cc by nc sa"]),
    ("cc-by-nc-sa", 90, [r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?"]),
    ("cc-by-nc", 80, [r"cc by nc(?: [1-4] [05])?"]),
    ("cc-by-nc", 80, [r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?", r"creative commons by nc"]),
    ("cc-by-nd", 80, [r"cc by nd(?: [1-4] [05])?"]),
    ("cc-by-nd", 80, [r"creative commons attribution no ?deriv(?:s|atives|ative works)?(?: [1-4] [05])?(?: international| unported)?"]),
    ("cc-by-sa", 80, [r"cc by sa(?: [1-4] [05])?"]),
    ("cc-by-sa", 80, [r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?", r"creative commons by sa"]),
    ("cc-by", 60, [r"cc by(?: [1-4] [05])?", r"license identifier cc by 4 0"]),
    ("cc-by", 60, [r"creative commons attribution(?: license)?(?: [1-4] [05])?(?: international| unported)?", r"creative commons by [1-4] [05]"]),
    ("cc-by-nc-nd", 90, [r"creativecommons org licenses by nc nd(?: [1-4] [05])?"]),
    ("cc-by-nc-sa", 90, [r"creativecommons org licenses by nc sa(?: [1-4] [05])?"]),
    ("cc-by-nc", 80, [r"creativecommons org licenses by nc(?: [1-4] [05])?"]),
    ("cc-by-nd", 80, [r"creativecommons org licenses by nd(?: [1-4] [05])?"]),
    ("cc-by-sa", 80, [r"creativecommons org licenses by sa(?: [1-4] [05])?"]),
    ("cc-by", 60, [r"creativecommons org licenses by(?: [1-4] [05])?"]),
    ("cc0", 60, [r"creativecommons org publicdomain zero(?: 1 0)?"]),
    ("creative-commons", 20, [r"creative commons(?: licen[cs]e)?", r"licen[cs]ed under (?:a )?creative commons", r"licence creative commons", r"creative commons lizenz"]),
    ("odbl", 50, [r"open database licen[cs]e(?: odbl)?(?: v?1 0)?"]),
    ("odbl", 50, [r"odbl(?: 1 0)?"]),
    ("odc-by", 50, [r"open data commons attribution licen[cs]e(?: v?1 0)?", r"odc by(?: 1 0)?"]),
    ("pddl", 50, [r"open data commons public domain dedication(?: and licen[cs]e)?"]),
    ("cdla", 50, [r"community data license agreement(?: permissive| sharing)?"]),
    ("ogl-uk", 50, [r"open government licen[cs]e(?: v?[123] 0)?"]),
    ("etalab", 50, [r"licence ouverte(?: etalab)?(?: [12] 0)?"]),
    ("openrail", 50, [r"(?:big ?science|creativeml|big ?code) open ?rail(?: m)?", r"open ?rail(?: m)? license", r"responsible ai license"]),
    ("llama", 50, [r"llama [23](?: [123])? community license(?: agreement)?"]),
    ("ofl", 50, [r"sil open font license(?: (?:version |v ?)?1 1)?", r"open font license"]),
    ("ms-pl", 50, [r"microsoft public license"]),
    ("ms-rl", 50, [r"microsoft reciprocal license"]),
    ("apsl", 50, [r"apple public source license(?: (?:version |v ?)?[12] [0-9])?"]),
    ("nasa", 50, [r"nasa open source agreement(?: version 1 3)?"]),
    ("ncsa", 50, [r"university of illinois (?:ncsa )?open source license"]),
    ("osl-3", 50, [r"open software license(?: (?:version |v ?)?3(?: 0)?)?"]),
    ("afl-3", 50, [r"academic free license(?: (?:version |v ?)?3(?: 0)?)?"]),
    ("ecl-2", 50, [r"educational community license(?: (?:version |v ?)?2(?: 0)?)?"]),
    ("qpl", 50, [r"q public license(?: version 1 0)?"]),
    ("sleepycat", 50, [r"sleepycat license", r"sleepycat public license"]),
    ("vim", 50, [r"vim license"]),
    ("beerware", 50, [r"beer ?ware license(?: revision 42)?", r"buy me a beer in return"]),
    ("json", 50, [r"shall be used for good not evil"]),
    ("sspl", 50, [r"server side public license(?: (?:version |v ?)?1)?"]),
    ("busl", 50, [r"business source license(?: (?:version |v ?)?1 1)?"]),
    ("elastic-2", 50, [r"elastic license(?: (?:version |v ?)?2(?: 0)?)?"]),
    ("commons-clause", 50, [r"commons clause(?: license condition v1 0)?"]),
    ("polyform", 50, [r"polyform (?:noncommercial|shield|strict|small business|perimeter) license(?: 1 0 0)?"]),
    ("upl", 50, [r"universal permissive license(?: (?:version |v ?)?1 0)?"]),
    ("mulan", 50, [r"mulan (?:psl|permissive software license)(?: v ?[12])?"]),
    ("all-rights-reserved", 30, [r"all rights reserved", r"copyright .{1,80}? all rights reserved"]),
    ("all-rights-reserved", 30, [r"tous droits r[ée]serv[ée]s"]),
    ("all-rights-reserved", 30, [r"alle rechte vorbehalten"]),
    ("all-rights-reserved", 30, [r"todos los derechos reservados"]),
    ("proprietary", 40, [r"proprietary and confidential", r"confidential and proprietary", r"proprietary license", r"this (?:software|document) is proprietary"]),
    ("proprietary", 40, [r"may not be (?:reproduced|copied|redistributed)(?: \S+){0,8} without(?: prior)?(?: written)? permission", r"do not (?:copy|redistribute) without permission"]),
    ("eula", 40, [r"end user licen[cs]e agreement"]),
    ("non-commercial", 35, [r"for non commercial (?:use|purposes) only", r"non commercial use only", r"non commercial license"]),
    ("non-commercial", 35, [r"for noncommercial (?:use|purposes) only", r"noncommercial use only"]),
    ("research-only", 35, [r"for research (?:use|purposes) only", r"research only license"]),
    ("copyright", 10, [r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", r"copyright by", r"copyright holders?"]),
    ("license", 5, [r"licensed under(?: \S+){1,6}", r"license terms", r"under the following license", r"see (?:the )?license(?: file)? for"]),
]
