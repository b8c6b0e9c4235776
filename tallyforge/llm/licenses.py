"""License scans by ordered signature rules, in Spark's own expressions only.

A text becomes its lower-cased words. Rules are regexes over words: signatures of the licenses' own
texts and notices (``SIGNED``), and names of licenses with the sentences that grant them (``NAMED``).
Each has one keyword, and only texts that hold a keyword are looked at further, and only around
each keyword, in a window as wide as its rules reach. A rule is tried only where its longest fixed
part stands. A detection is a rule's match around a keyword: first word, words, priority, label.
A detection within another one of the same or a higher rank (a smaller priority) is suppressed; of
equal ones the first by priority and label stays. Base phrases have priority 0, which nothing
suppresses.

All of it happens within a row, so nothing is shuffled and repeated rows don't matter.

Defined results: null and empty texts have no words and no labels, score 0. In very long texts every
keyword counts; the work grows with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, lower_ascii

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: detections that are told apart at a time
BLOCK = 128
#: label, phrase
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
_V = "(?: version)?"
#: label, the keyword, how texts name the license (regexes over words; ~ marks the keyword)
NAMED = [
    ("apache-1", "apache", f"~apache(?: software)?(?: license)?{_V} v?1(?: [01])?"),
    ("apache-2", "apache", f"~apache(?: software)?(?: license)?{_V} v?2(?: 0)?"),
    ("gpl-1", "gpl", f"(?:gnu )?~gpl{_V} v?1"), ("gpl-2", "gpl", f"(?:gnu )?~gpl{_V} v?2"), ("gpl-3", "gpl", f"(?:gnu )?~gpl{_V} v?3"), ("gpl-2", "gplv2", "~gplv2"), ("gpl-3", "gplv3", "~gplv3"),
    ("gpl-1", "general", f"(?:gnu )?~general public license{_V} v?1"), ("gpl-2", "general", f"(?:gnu )?~general public license{_V} v?2"), ("gpl-3", "general", f"(?:gnu )?~general public license{_V} v?3"),
    ("lgpl-2", "lgpl", f"(?:gnu )?~lgpl{_V} v?2(?: 0)?"), ("lgpl-2.1", "lgpl", f"(?:gnu )?~lgpl{_V} v?2 1"), ("lgpl-3", "lgpl", f"(?:gnu )?~lgpl{_V} v?3"),
    ("lgpl-2.1", "lesser", f"(?:gnu )?~lesser general public license{_V} v?2 1"), ("lgpl-3", "lesser", f"(?:gnu )?~lesser general public license{_V} v?3"), ("lgpl-2", "library", f"(?:gnu )?~library general public license{_V} v?2"),
    ("agpl-3", "agpl", f"(?:gnu )?~agpl{_V} v?3"), ("agpl-3", "affero", f"(?:gnu )?~affero general public license{_V} v?3"), ("fdl", "documentation", "(?:gnu )?free ~documentation license"),
    ("bsd-2", "bsd", "(?:2|two) clause ~bsd"), ("bsd-3", "bsd", "(?:3|three) clause ~bsd"), ("bsd-4", "bsd", "(?:4|four) clause ~bsd"), ("bsd-2", "bsd", "~bsd (?:2|two) clause"), ("bsd-3", "bsd", "~bsd (?:3|three) clause"), ("bsd-2", "freebsd", "~freebsd license"),
    ("mpl-1", "mozilla", f"~mozilla public license{_V} v?1(?: [01])?"), ("mpl-2", "mozilla", f"~mozilla public license{_V} v?2(?: 0)?"), ("mpl-2", "mpl", f"~mpl{_V} v?2(?: 0)?"), ("epl-1", "eclipse", f"~eclipse public license{_V} v?1"), ("epl-2", "eclipse", f"~eclipse public license{_V} v?2"),
    ("edl-1", "eclipse", "~eclipse distribution license"), ("cddl-1", "cddl", f"~cddl{_V}(?: 1(?: [01])?)?"), ("cddl-1", "development", "common ~development and distribution license"), ("cpl-1", "common", "~common public license"), ("eupl-1.2", "eupl", f"~eupl{_V} v?1 2"),
    ("eupl-1.2", "european", "~european union public licen[cs]e"), ("artistic-1", "artistic", "~artistic license(?: 1 0)?"), ("artistic-2", "artistic", "~artistic license 2 0"), ("boost", "boost", "~boost software license"), ("zlib", "zlib", "~zlib license"), ("libpng", "libpng", "~libpng license"),
    ("unlicense", "unlicense", "the ~unlicense"), ("wtfpl", "wtfpl", "~wtfpl"), ("isc", "isc", "~isc license"), ("x11", "x11", "~x11 license"), ("ofl", "ofl", "~ofl(?: 1 1)?"), ("ofl", "font", "open ~font license"), ("postgresql", "postgresql", "~postgresql license"), ("python", "psf", "~psf license"),
    ("python", "python", "~python(?: software foundation)? license"), ("ruby", "ruby", "~ruby license"), ("php", "php", "~php license"), ("openssl", "openssl", "~openssl license"), ("ncsa", "ncsa", "~ncsa(?: open source)? license"), ("curl", "curl", "~curl license"), ("vim", "vim", "~vim license"),
    ("odbl", "odbl", "~odbl"), ("odbl", "database", "open ~database license"), ("odc-by", "attribution", "open data commons ~attribution license"), ("pddl", "pddl", "~pddl"), ("ms-pl", "microsoft", "~microsoft public license"), ("ms-rl", "microsoft", "~microsoft reciprocal license"),
    ("blueoak", "oak", "blue ~oak model license"), ("busl", "busl", "~busl"), ("busl", "business", "~business source license"), ("sspl", "sspl", "~sspl"), ("sspl", "server", "~server side public license"), ("elastic-2", "elastic", "~elastic license(?: 2 0)?"), ("cecill", "cecill", "~cecill(?: (?:1|2)(?: [01])?)?"),
    ("mulan", "mulan", "~mulan(?: permissive software license| psl)"), ("upl", "universal", "~universal permissive license"), ("afl", "academic", "~academic free license"), ("osl", "osl", "~osl 3 0"), ("public-domain", "domain", "(?:in|to) the public ~domain"), ("all-rights", "reserved", "all rights ~reserved"),
]
#: conditions of the public licenses of one family; each with and without a version and in two ways of writing
_CC = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
_CC_LONG = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:s|atives|ative works)", "nc": "non ?commercial"}
_MIT = [("mit", "mit"), ("isc", "isc"), ("x11", "x11"), ("expat", "expat"), ("zlib", "zlib")]
#: label, the keyword, a signature of the license's text or notice, priority, confidence
SIGNED = [
    ("mit", "hereby", "permission is ~hereby granted free of charge to any person obtaining a copy of this software", 1, 0.95),
    ("mit", "sublicense", "(?:to )?use copy modify merge publish distribute ~sublicense and or sell copies of the software", 1, 0.95),
    ("mit", "noninfringement", "merchantability fitness for a particular purpose and ~noninfringement", 2, 0.7),
    ("mit", "notice", "the above copyright ~notice and this permission notice shall be included in all copies or substantial portions", 1, 0.9),
    ("mit", "persons", "to permit ~persons to whom the software is furnished to do so", 1, 0.9),
    ("mit-0", "attribution", "mit no ~attribution", 1, 0.95),
    ("x11", "consortium", "except as contained in this notice the name of the x ~consortium shall not be used", 1, 0.95),
    ("x11", "advertising", "shall not be used in ~advertising or otherwise to promote the sale use or other dealings in this software", 1, 0.9),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is ~hereby granted", 1, 0.95),
    ("isc", "hereby", "permission to use copy modify and distribute this software for any purpose with or without fee is ~hereby granted", 1, 0.95),
    ("isc", "disclaims", "the software is provided as is and the author ~disclaims all warranties", 1, 0.9),
    ("0bsd", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is ~hereby granted the software", 1, 0.95),
    ("hpnd", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is ~hereby granted", 1, 0.9),
    ("bsd", "redistribution", "~redistribution and use in source and binary forms with or without modification are permitted", 2, 0.9),
    ("bsd", "redistributions", "~redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 2, 0.9),
    ("bsd", "redistributions", "~redistributions in binary form must reproduce the above copyright notice", 2, 0.9),
    ("bsd-3", "endorse", "may be used to ~endorse or promote products derived from this software without specific prior written permission", 1, 0.9),
    ("bsd-3", "endorse", "names of its contributors may be used to ~endorse or promote products", 1, 0.9),
    ("bsd-4", "advertising", "all ~advertising materials mentioning features or use of this software must display the following acknowledgement", 1, 0.95),
    ("bsd", "regents", "this software is provided by the ~regents and contributors as is", 1, 0.85),
    ("bsd", "exemplary", "direct indirect incidental special ~exemplary or consequential damages", 3, 0.5),
    ("bsd-clear", "patent", "no express or implied licenses to any party s ~patent rights are granted by this license", 1, 0.95),
    ("bsd-patent", "contributors", "each copyright holder and ~contributors? hereby grants you a perpetual worldwide", 1, 0.8),
    ("apache-1.1", "acknowledgment", "this product includes software developed by the apache software foundation ~acknowledgment", 1, 0.9),
    ("apache-1.1", "apache", "products derived from this software may not be called ~apache nor may apache appear in their name", 1, 0.95),
    ("apache-1.1", "apache", "this product includes software developed by the ~apache software foundation", 2, 0.6),
    ("apache-2", "apache", "licensed under the ~apache license version 2 0 the license", 1, 1.0),
    ("apache-2", "compliance", "you may not use this file except in ~compliance with the license", 1, 0.9),
    ("apache-2", "obtain", "you may ~obtain a copy of the license at http(?:s)? www apache org licenses license 2 0", 1, 1.0),
    ("apache-2", "conditions", "distributed on an as is basis without warranties or ~conditions of any kind either express or implied", 1, 0.9),
    ("apache-2", "governing", "see the license for the specific language ~governing permissions and limitations under the license", 1, 0.9),
    ("apache-2", "contributor", "each ~contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", 1, 0.9),
    ("apache-2", "derivative", "you must give any other recipients of the work or ~derivative works a copy of this license", 1, 0.95),
    ("apache-2", "notice", "if the work includes a ~notice text file as part of its distribution", 1, 0.95),
    ("apache-2", "licensor", "unless required by applicable law or agreed to in writing ~licensor provides the work", 1, 0.9),
    ("apache-2", "apache", "~apache org licenses license 2 0(?: html| txt)?", 1, 0.95),
    ("apache-2", "asf", "licensed to the apache software foundation ~asf under one or more contributor license agreements", 1, 1.0),
    ("gpl", "redistribute", "this program is free software you can ~redistribute it and or modify it under the terms of the gnu general public license", 2, 0.9),
    ("gpl-2+", "general", "under the terms of the gnu ~general public license as published by the free software foundation either version 2 of the license or", 1, 1.0),
    ("gpl-3+", "general", "under the terms of the gnu ~general public license as published by the free software foundation either version 3 of the license or", 1, 1.0),
    ("gpl", "warranty", "in the hope that it will be useful but without any ~warranty without even the implied warranty", 2, 0.7),
    ("gpl", "general", "you should have received a copy of the gnu ~general public license along with this program", 2, 0.85),
    ("gpl", "freedom", "the licenses for most software are designed to take away your ~freedom to share and change it", 1, 0.9),
    ("gpl-2", "recipients", "you must give any other ~recipients of the program a copy of this license along with the program", 1, 0.9),
    ("gpl-2", "verbatim", "you may copy and distribute ~verbatim copies of the program s source code as you receive it", 1, 0.95),
    ("gpl-2", "franklin", "51 ~franklin street fifth floor boston", 3, 0.5),
    ("gpl-3", "conveying", "you may convey a work based on the program ~conveying", 1, 0.8),
    ("gpl-3", "convey", "to ~convey a work means any kind of propagation that enables other parties to make or receive copies", 1, 0.95),
    ("gpl-3", "copyleft", "the gnu general public license is a free ~copyleft license for software and other kinds of works", 1, 0.95),
    ("gpl-3", "circumvention", "no covered work shall be deemed part of an effective technological measure ~circumvention", 1, 0.8),
    ("gpl-3", "tivoization", "~tivoization", 3, 0.4),
    ("gpl", "copyleft", "~copyleft license", 3, 0.4),
    ("classpath-exception", "classpath", "gnu ~classpath exception", 1, 0.9),
    ("classpath-exception", "linking", "~linking this library statically or dynamically with other modules is making a combined work based on this library", 1, 0.95),
    ("lgpl", "redistribute", "this library is free software you can ~redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 1, 0.95),
    ("lgpl-2.1+", "lesser", "gnu ~lesser general public license as published by the free software foundation either version 2 1 of the license or", 1, 1.0),
    ("lgpl-3+", "lesser", "gnu ~lesser general public license as published by the free software foundation either version 3 of the license or", 1, 1.0),
    ("lgpl-2+", "library", "gnu ~library general public license as published by the free software foundation either version 2 of the license or", 1, 1.0),
    ("lgpl", "lesser", "you should have received a copy of the gnu ~lesser general public license along with this (?:library|program)", 2, 0.85),
    ("lgpl-2.1", "library", "a program that contains no derivative of any portion of the ~library but is designed to work with the library", 1, 0.95),
    ("lgpl-3", "linked", "combined work is a work produced by combining or ~linked", 2, 0.5),
    ("agpl-3+", "affero", "gnu ~affero general public license as published by the free software foundation either version 3 of the license or", 1, 1.0),
    ("agpl-3", "affero", "you should have received a copy of the gnu ~affero general public license along with this program", 1, 0.9),
    ("agpl-3", "remotely", "all users interacting with it ~remotely through a computer network", 1, 0.95),
    ("fdl", "invariant", "with no ~invariant sections no front cover texts and no back cover texts", 1, 1.0),
    ("fdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free ~documentation license", 1, 1.0),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the ~mozilla public license v 2 0", 1, 1.0),
    ("mpl-2", "mozilla", "if a copy of the mpl was not distributed with this file you can obtain one at http(?:s)?(?: www)? ~mozilla org mpl 2 0", 1, 1.0),
    ("mpl-2", "incompatible", "this source code form is ~incompatible with secondary licenses", 1, 0.95),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the ~mozilla public license version 1 1", 1, 1.0),
    ("mpl-1", "mozilla", "the contents of this file are subject to the ~mozilla public license version 1 0", 1, 1.0),
    ("mpl", "rights", "for the specific language governing ~rights and limitations under the license", 2, 0.6),
    ("mpl", "initial", "the ~initial developer of the original code is", 2, 0.7),
    ("npl", "netscape", "~netscape public license", 1, 0.9),
    ("epl-2", "eclipse", "this program and the accompanying materials are made available under the terms of the ~eclipse public license 2 0", 1, 1.0),
    ("epl-1", "eclipse", "available under the terms of the ~eclipse public license v1 0 which accompanies this distribution", 1, 1.0),
    ("epl", "recipient", "any use reproduction or distribution of the program constitutes ~recipient s acceptance of this agreement", 1, 0.9),
    ("cpl-1", "common", "under the terms of this ~common public license agreement", 1, 0.95),
    ("cddl-1", "development", "the contents of this file are subject to the terms of the common ~development and distribution license", 1, 1.0),
    ("cddl-1", "opensolaris", "you can obtain a copy of the license at usr src ~opensolaris license", 1, 0.95),
    ("cddl-1", "executable", "covered software means a the original software or b modifications ~executable", 2, 0.6),
    ("cc-by", "creative", "this work is licensed under (?:a|the) ~creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? license", 1, 0.95),
    ("cc-by-sa", "creative", "this work is licensed under (?:a|the) ~creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)? license", 1, 0.95),
    ("cc-by-nc", "creative", "this work is licensed under (?:a|the) ~creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)? license", 1, 0.95),
    ("cc-by", "creativecommons", "~creativecommons org licenses by [1-4] [05]", 1, 0.95),
    ("cc-by-sa", "creativecommons", "~creativecommons org licenses by sa [1-4] [05]", 1, 0.95),
    ("cc-by-nc", "creativecommons", "~creativecommons org licenses by nc [1-4] [05]", 1, 0.95),
    ("cc-by-nd", "creativecommons", "~creativecommons org licenses by nd [1-4] [05]", 1, 0.95),
    ("cc-by-nc-sa", "creativecommons", "~creativecommons org licenses by nc sa [1-4] [05]", 1, 0.95),
    ("cc-by-nc-nd", "creativecommons", "~creativecommons org licenses by nc nd [1-4] [05]", 1, 0.95),
    ("cc0", "creativecommons", "~creativecommons org publicdomain zero 1 0", 1, 1.0),
    ("cc-pdm", "creativecommons", "~creativecommons org publicdomain mark 1 0", 1, 1.0),
    ("cc", "attribution", "you must give appropriate credit provide a link to the license and indicate if changes were made ~attribution", 2, 0.7),
    ("cc0", "waived", "has ~waived all copyright and related or neighboring rights", 1, 0.95),
    ("cc0", "affirmer", "~affirmer hereby overtly fully permanently irrevocably and unconditionally waives", 1, 1.0),
    ("unlicense", "unencumbered", "this is free and ~unencumbered software released into the public domain", 1, 1.0),
    ("unlicense", "domain", "anyone is free to copy modify publish use compile sell or distribute this software ~domain", 2, 0.7),
    ("unlicense", "detriment", "to the ~detriment of our heirs and successors", 1, 0.95),
    ("public-domain", "domain", "(?:is|are) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public ~domain", 1, 0.9),
    ("public-domain", "dedicate", "we ~dedicate any and all copyright interest in the software to the public domain", 1, 0.95),
    ("public-domain", "copyright", "(?:no|without) ~copyright (?:is )?claimed", 2, 0.6),
    ("wtfpl", "fuck", "do what the ~fuck you want to(?: public license)?", 1, 0.95),
    ("beerware", "beer", "you can buy me a ~beer in return", 1, 0.95),
    ("beerware", "beerware", "~beerware(?: license)?", 2, 0.8),
    ("json", "evil", "the software shall be used for good not ~evil", 1, 1.0),
    ("zlib", "altered", "~altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1, 0.95),
    ("zlib", "misrepresented", "the origin of this software must not be ~misrepresented you must not claim that you wrote the original software", 1, 0.95),
    ("zlib", "implied", "this software is provided as is without any express or ~implied warranty in no event will the authors be held liable", 1, 0.9),
    ("boost", "boost", "distributed under the ~boost software license version 1 0", 1, 1.0),
    ("boost", "organization", "free of charge to any person or ~organization obtaining a copy of the software and accompanying documentation", 1, 0.95),
    ("boost", "machine", "unless such copies or derivative works are solely in the form of ~machine executable object code", 1, 0.95),
    ("artistic", "artistic", "the intent of this document is to state the conditions under which a package may be copied ~artistic", 1, 0.8),
    ("artistic-1", "semblance", "the copyright holder maintains some ~semblance of artistic control over the development of the package", 1, 0.95),
    ("artistic-2", "artistic", "under the terms of the ~artistic license version 2 0", 1, 1.0),
    ("perl", "perl", "under the same terms as ~perl itself", 1, 0.95),
    ("ofl", "font", "this ~font software is licensed under the sil open font license version 1 1", 1, 1.0),
    ("ofl", "reserved", "no modified version of the font software may use the ~reserved font name", 1, 0.95),
    ("python", "psf", "~psf is making python available to licensee on an as is basis", 1, 1.0),
    ("python", "psf", "python software foundation ~psf hereby grants licensee a nonexclusive royalty free world wide license", 1, 1.0),
    ("python", "cnri", "~cnri open source license agreement", 1, 0.95),
    ("ms-pl", "patent", "each contributor grants you a non exclusive worldwide royalty free license under its licensed ~patent", 2, 0.6),
    ("ms-pl", "microsoft", "this license governs use of the accompanying software ~microsoft", 2, 0.6),
    ("ms-rl", "reciprocal", "~reciprocal grants for any file you distribute that contains code from the software", 1, 0.95),
    ("postgresql", "postgresql", "~postgresql is released under the postgresql license", 1, 0.95),
    ("postgresql", "california", "in no event shall the university of ~california be liable to any party", 1, 0.85),
    ("openssl", "openssl", "this product includes software developed by the ~openssl project for use in the openssl toolkit", 1, 1.0),
    ("openssl", "cryptographic", "this product includes ~cryptographic software written by eric young", 1, 0.95),
    ("ncsa", "illinois", "university of ~illinois ncsa open source license", 1, 1.0),
    ("ncsa", "deal", "to ~deal with the software without restriction including without limitation", 1, 0.85),
    ("odbl", "database", "made available under the open ~database license", 1, 0.95),
    ("odbl", "opendatacommons", "~opendatacommons org licenses odbl(?: 1 0)?", 1, 0.95),
    ("odc-by", "opendatacommons", "~opendatacommons org licenses by(?: 1 0)?", 1, 0.95),
    ("pddl", "opendatacommons", "~opendatacommons org licenses pddl(?: 1 0)?", 1, 0.95),
    ("afl", "academic", "licensed under the ~academic free license version [123] [01]", 1, 0.95),
    ("osl", "open", "licensed under the ~open software license version [123] [01]", 1, 0.95),
    ("eupl-1.2", "eupl", "licensed under the ~eupl version 1 2 or as soon they will be approved by the european commission", 1, 1.0),
    ("eupl-1.1", "eupl", "licensed under the ~eupl version 1 1", 1, 0.95),
    ("cecill", "cecill", "governed by the ~cecill(?: b| c)? license under french law", 1, 0.95),
    ("sspl", "service", "if you make the functionality of the program or a modified version available to third parties as a ~service", 1, 1.0),
    ("busl", "licensor", "the ~licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", 1, 1.0),
    ("busl", "additional", "~additional use grant", 2, 0.7),
    ("elastic-2", "hosted", "you may not provide the software to third parties as a ~hosted or managed service", 1, 0.95),
    ("elastic-2", "circumvent", "you may not move change disable or ~circumvent the license key functionality in the software", 1, 0.95),
    ("commons-clause", "clause", "~clause license condition v1 0", 1, 0.9),
    ("commons-clause", "sell", "the grant of rights under the license will not include and the license does not grant to you the right to ~sell the software", 1, 1.0),
    ("upl", "larger", "~larger works to which the software is contributed", 1, 0.9),
    ("blueoak", "excuse", "~excuse if anyone notifies you in writing that you have not complied", 1, 0.95),
    ("polyform", "polyform", "~polyform (?:noncommercial|strict|shield|small business|internal use|free trial) license", 1, 0.95),
    ("parity", "parity", "~parity public license", 1, 0.95),
    ("rail", "openrail", "~openrail(?: m)?(?: license)?", 1, 0.9),
    ("rail", "responsible", "~responsible ai license", 1, 0.9),
    ("llama", "llama", "~llama [234](?: [0-9])? community license agreement", 1, 0.95),
    ("proprietary", "confidential", "proprietary and ~confidential", 2, 0.7),
    ("proprietary", "unauthorized", "~unauthorized (?:copying|reproduction|use|distribution)(?: of this file)?(?: via any medium)? is strictly prohibited", 1, 0.9),
    ("proprietary", "consent", "without the (?:express )?(?:prior )?written ~consent of the (?:author|owner|publisher|copyright holder)", 2, 0.7),
    ("proprietary", "reproduced", "no part of this (?:publication|book|document|work|site) may be ~reproduced(?: stored| distributed| in any form)?", 1, 0.9),
    ("proprietary", "copied", "may not be ~copied (?:reproduced )?(?:or )?(?:redistributed )?without permission", 2, 0.7),
    ("non-commercial", "commercial", "for non ~commercial (?:use|purposes) only", 2, 0.7),
    ("non-commercial", "commercial", "not for ~commercial use", 2, 0.6),
    ("research-only", "research", "for ~research (?:use|purposes) only", 2, 0.7),
    ("evaluation-only", "evaluation", "for ~evaluation (?:use|purposes) only", 2, 0.7),
    ("crown", "crown", "~crown copyright(?: and database right)?", 2, 0.7),
    ("ogl", "government", "contains public sector information licensed under the open ~government licence v[123] 0", 1, 1.0),
    ("ogl", "government", "open ~government licence", 2, 0.8),
]
_VERBS = ["licensed", "released", "distributed", "available", "published", "provided", "offered"]


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keyword, pattern, label, priority, confidence), several hundred of them."""
    out = []
    for label, phrase in BASE:
        keyword = {"mit": "license", "apache-2": "apache", "cc-by-nc": "cc"}[label]
        out.append((keyword, phrase.replace(keyword, f"~{keyword}"), label, 0, 1.0))
    spoken = [(label, keyword, name) for label, keyword, name in NAMED]
    for parts in _CC:
        words = parts.split()
        for version in ["", " 1 0", " 2 0", " 2 5", " 3 0", " 4 0"]:
            label = "cc-" + "-".join(words) + (f"-{version.strip().replace(' ', '.')}" if version else "")
            spoken.append((label, "cc", f"~cc {parts}{version}"))
            spoken.append((label, "creative", "~creative commons " + " ".join(_CC_LONG[w] for w in words) + (f"{_V}(?: license)?(?: international| unported)?{version}" if version else "")))
    spoken += [("cc0", "cc0", "~cc0(?: 1 0)?"), ("cc0", "creative", "~creative commons zero")]
    out += [(keyword, pattern, label, rank, confidence) for label, keyword, pattern, rank, confidence in SIGNED]
    for label, keyword, name in spoken:
        if keyword not in ("domain", "reserved"):
            out.append((keyword, f"(?:{'|'.join(_VERBS)}) under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[sc]e)?", label, 1, 0.95))
        out.append((keyword, f"{name}(?: licen[sc]e)?", label, 2, 0.8))
    for label, name in _MIT:
        for keyword in ("license", "licence"):
            out.append((keyword, f"(?:{'|'.join(_VERBS)}) under (?:the )?(?:terms of the )?{name} ~{keyword}", label, 1, 0.95))
            out.append((keyword, f"(?:the )?{name} ~{keyword}", label, 2, 0.8))
            out.append((keyword, f"~{keyword} {name}", label, 3, 0.6))
        out.append(("spdx", f"~spdx license identifier {name}", label, 1, 1.0))
    for label in sorted({x for x, _, _ in NAMED}):
        spaced = label.replace("-", " ").replace(".", " ")
        out.append(("spdx", f"~spdx license identifier {spaced}(?: 0)?(?: only| or later| clause)?", label, 1, 1.0))
    out.append(("license", "(?:see|read) (?:the )?(?:file )?~license(?: file)?(?: for (?:the )?details)", "see-license", 3, 0.4))
    out.append(("license", "(?:gnu )?general public ~license", "gpl", 3, 0.6))
    return out


def fixed_part(pattern: str) -> str:
    """The longest text that every match of ``pattern`` holds."""
    runs, depth = [""], 0
    for i, c in enumerate(pattern):
        if c in "([":
            depth, runs = depth + 1, [*runs, ""]
        elif c in ")]":
            depth -= 1
        elif depth == 0 and c != "?" and pattern[i + 1 : i + 2] != "?":
            runs[-1] += c
        else:
            runs.append("")
    return max(runs, key=len)


def reach(table: list[tuple[str, str, str, int, float]]) -> dict[str, tuple[int, int]]:
    """How many words before and after each keyword its rules may take: a blank of a pattern stands
    for one blank at most."""
    out: dict[str, tuple[int, int]] = {}
    for keyword, pattern, *_ in table:
        ahead, behind = (part.count(" ") for part in pattern.split("~"))
        before, after = out.get(keyword, (0, 0))
        out[keyword] = (max(before, ahead), max(after, behind))
    return out


_DETECTION = "struct<start:int,less:int,priority:int,label:string,confidence:double>"


def _detections(words: Column, table: list[tuple[str, str, str, int, float]]) -> Column:
    windows = reach(table)
    cells = []
    for keyword, (before, after) in sorted(windows.items()):
        own = [
            F.struct(F.lit(f"(?<= )(?:{p})(?= )").alias("pattern"), F.lit(fixed_part(p)).alias("fixed"), F.lit(label).alias("label"), F.lit(rank).alias("priority"), F.lit(c).alias("confidence"))
            for k, p, label, rank, c in table if k == keyword
        ]
        cells += [F.lit(keyword), F.struct(F.lit(before).alias("before"), F.lit(after).alias("after"), F.array(*own).alias("rules"))]
    by_keyword = F.create_map(*cells)
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: h.word.isin(sorted(windows)))

    def around(hit: Column, own: Column) -> Column:
        first = F.greatest(hit["at"] - own.before, F.lit(0))
        lead = F.array_join(F.slice(words, first + 1, hit["at"] - first), " ")
        tail = F.array_join(F.slice(words, hit["at"] + 2, own.after), " ")
        window = F.concat(F.lit(" "), lead, F.lit(" ~"), hit.word, F.lit(" "), tail, F.lit(" "))

        def matched(window: Column) -> Column:
            def one(rule: Column) -> Column:
                def shaped(found: Column) -> Column:
                    spaces = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
                    ahead = spaces(F.substring_index(found, "~", 1))
                    return F.when(found != "", F.struct(
                        (hit["at"] - ahead).cast("int").alias("start"), (-1 - spaces(found)).cast("int").alias("less"), rule.priority.alias("priority"), rule.label.alias("label"), rule.confidence.alias("confidence"),
                    ))

                return F.when(F.contains(window, rule.fixed), let(F.call_function("regexp_extract", window, rule.pattern, F.lit(0)), shaped))

            return F.filter(F.transform(own.rules, one), lambda d: d.isNotNull())

        return let(window, matched)

    return F.array_sort(F.flatten(F.transform(hits, lambda hit: let(F.element_at(by_keyword, hit.word), lambda own: around(hit, own)))))


def _suppressed(found: Column) -> Column:
    """Those of the sorted detections that no earlier one of their rank or above contains. Earlier
    ones begin at or before, so the largest end so far of each rank tells. What is kept grows in
    blocks, so a text of n detections costs about n * (``BLOCK`` + n / ``BLOCK``) copies."""
    none = F.array().cast(f"array<{_DETECTION}>")

    def step(acc: Column, d: Column) -> Column:
        end = d.start - d.less
        inside = (d.priority > 0) & (F.get(acc.ends, d.priority) >= end)
        return F.struct(
            F.transform(acc.ends, lambda e, p: F.when(p >= d.priority, F.greatest(e, end)).otherwise(e)).alias("ends"),
            F.when(inside, acc.kept).otherwise(F.concat(acc.kept, F.array(d))).alias("kept"),
        )

    def block(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(found, k * BLOCK + 1, F.lit(BLOCK)), F.struct(acc.ends.alias("ends"), none.alias("kept")), step)
        return let(part, lambda p: F.struct(p.ends.alias("ends"), F.concat(acc.kept, F.array(p.kept)).alias("kept")))

    start = F.struct(F.array(*[F.lit(0)] * 4).alias("ends"), F.array().cast(f"array<array<{_DETECTION}>>").alias("kept"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    return F.when(F.size(found) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc.kept))).otherwise(none)


def license_scan(docs: DataFrame, table: list[tuple[str, str, str, int, float]] | None = None) -> DataFrame:
    """doc_id, n_words, detections (start, less = minus the number of words, priority, label,
    confidence) of each row of ``docs`` (doc_id, text)."""
    table = table or rules()
    keywords = sorted({k for k, *_ in table})
    words = F.filter(F.split(lower_ascii(F.coalesce(docs["text"], F.lit(""))), NOT_WORD), lambda w: w != "")
    none = F.array().cast(f"array<{_DETECTION}>")
    found = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.when(F.arrays_overlap(w, F.array(*map(F.lit, keywords))), let(_detections(w, table), _suppressed)).otherwise(none).alias("detections"),
    ))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), found.alias("found")).select("doc_id", "found.*")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("detections", lambda d: d.priority == 0)
    starts = F.transform(base, lambda d: d.start.cast("long"))
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d.label))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d.confidence)), F.lit(0.0)).alias("score"),
    )
