"""Signatures of license texts, notices and deeds, written by hand over lower-case words between single spaces.

Each entry is (label, keyword, pattern, priority). The keyword stands in every match, at the start of a word. Sentences of
a license's own text weigh most, then notices that name it, then phrases that several licenses share.
"""

# Phrases of public license texts.
TEXTS = (
    # MIT and its kin
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 50),
    ("mit", "to deal in the software", r"to deal in the software without restriction including without limitation the rights", 45),
    ("mit", "substantial portions", r"(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 45),
    ("mit", "the software is provided", r"the software is provided as is without warranty of any kind express or implied including but not limited to", 35),
    ("mit-0", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction(?: [a-z]+){20,40} and to permit persons to whom the software is furnished to do so the software is provided", 52),
    ("x11", "except as contained", r"except as contained in this notice the names? of(?: the)?(?: [a-z]+){1,6} shall not be used in advertising", 48),
    ("mit-cmu", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose", 46),
    ("isc", "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 50),
    ("isc", "the software is provided", r"the software is provided as is and the author disclaims all warranties with regard to this software", 45),
    ("0bsd", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 52),
    # BSD
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 45),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 42),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 42),
    ("bsd-3-clause", "neither the name", r"neither the names? of(?: the)?(?: [^ ]+){1,8} nor the names of (?:its|any) contributors may be used to endorse or promote products", 50),
    ("bsd-3-clause", "the name of the author", r"the name of the author may not be used to endorse or promote products derived from this software", 48),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 50),
    ("bsd-2-clause", "this software is provided", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties", 35),
    ("bsd-2-clause-views", "the views and conclusions", r"the views and conclusions contained in the software and documentation are those of the authors", 48),
    ("bsd-2-clause-patent", "subject to the terms", r"subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights", 48),
    ("bsd-3-clause-clear", "no express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license", 50),
    ("bsd-3-clause-attribution", "redistributions of any form", r"redistributions of any form whatsoever must retain the following acknowledge?ment", 48),
    # Apache
    ("apache-2", "you may not use this file", r"you may not use this file except in compliance with the license", 45),
    ("apache-2", "www apache org", r"(?:https? )?www apache org licenses license 2 0(?: txt| html)?", 48),
    ("apache-2", "unless required by applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 45),
    ("apache-2", "grant of copyright license", r"grant of copyright license subject to the terms and conditions of this license each contributor hereby grants", 50),
    ("apache-2", "grant of patent license", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants", 50),
    ("apache-1.1", "this product includes software", r"this product includes software developed by the apache software foundation", 46),
    ("apache-1.0", "this product includes software", r"this product includes software developed by the apache group", 46),
    # GNU
    ("gpl-1-or-later", "either version 1", r"gnu general public license as published by the free software foundation either version 1 (?:of the license )?or at your option any later version", 52),
    ("gpl-2-or-later", "either version 2", r"gnu general public license as published by the free software foundation either version 2 (?:of the license )?or at your option any later version", 52),
    ("gpl-3-or-later", "either version 3", r"gnu general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version", 52),
    ("gpl-2", "gnu general public license", r"gnu general public license as published by the free software foundation version 2(?: of the license)?", 50),
    ("gpl-3", "gnu general public license", r"gnu general public license as published by the free software foundation version 3(?: of the license)?", 50),
    ("lgpl-2-or-later", "either version 2", r"gnu library general public license as published by the free software foundation either version 2 (?:of the license )?or at your option any later version", 52),
    ("lgpl-2.1-or-later", "either version 2 1", r"gnu lesser general public license as published by the free software foundation either version 2 1 (?:of the license )?or at your option any later version", 52),
    ("lgpl-3-or-later", "either version 3", r"gnu lesser general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version", 52),
    ("agpl-3-or-later", "either version 3", r"gnu affero general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version", 52),
    ("gpl", "you should have received", r"you should have received a copy of the gnu general public license along with", 40),
    ("lgpl", "you should have received", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", 40),
    ("agpl", "you should have received", r"you should have received a copy of the gnu affero general public license along with", 40),
    ("gpl", "this program is free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 38),
    ("lgpl", "is free software", r"(?:this library|this program|it) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 38),
    ("agpl", "this program is free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", 38),
    ("gpl-2", "the licenses for most software", r"the licenses for most software are designed to take away your freedom to share and change it", 50),
    ("gpl-3", "the gnu general public license", r"the gnu general public license is a free copyleft license for software and other kinds of works", 50),
    ("gpl-3", "the licenses for most software", r"the licenses for most software and other practical works are designed to take away your freedom", 50),
    ("agpl-3", "the gnu affero general", r"the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed", 52),
    ("agpl-3", "remote network interaction", r"remote network interaction use with the gnu general public license", 48),
    ("lgpl-2.1", "this license the lesser", r"this license the lesser general public license applies to some specially designated software", 50),
    ("lgpl-3", "this version of the gnu lesser", r"this version of the gnu lesser general public license incorporates the terms and conditions", 50),
    ("gfdl", "permission is granted to copy", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 50),
    ("gfdl", "with no invariant", r"with no invariant sections no front cover texts and no back cover texts", 46),
    ("gpl-with-classpath-exception", "as a special exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules", 50),
    ("gpl-with-bison-exception", "as a special exception", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 50),
    ("gpl-with-gcc-exception", "under section 7", r"under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception", 50),
    ("gpl-with-autoconf-exception", "as a special exception", r"as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script", 50),
    ("gnu-all-permissive", "copying and distribution", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 50),
    # Mozilla, Eclipse, Sun, IBM and others
    ("mpl-2.0", "this source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0", 52),
    ("mpl-2.0", "if a copy of the mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 48),
    ("mpl-1.1", "the contents of this file", r"the contents of this file are subject to the mozilla public license version 1 1", 52),
    ("mpl-1.0", "the contents of this file", r"the contents of this file are subject to the mozilla public license version 1 0", 52),
    ("npl-1.1", "the contents of this file", r"the contents of this file are subject to the netscape public license version 1 1", 52),
    ("epl-1.0", "this program and the", r"this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0", 52),
    ("epl-2.0", "this program and the", r"this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2 0", 52),
    ("epl-1.0", "https www eclipse org", r"https www eclipse org legal epl v10 html", 46),
    ("epl-2.0", "https www eclipse org", r"https www eclipse org legal epl (?:2 0|v20 html)", 46),
    ("cddl-1.0", "the contents of this file", r"the contents of this file are subject to the terms of the common development and distribution license", 50),
    ("cpl-1.0", "the accompanying program", r"the accompanying program is provided under the terms of this common public license", 50),
    ("ipl-1.0", "the accompanying program", r"the accompanying program is provided under the terms of this ibm public license", 50),
    ("apsl-2.0", "this file contains original", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license", 50),
    ("qpl-1.0", "the q public license", r"the q public license version 1 0", 46),
    ("osl-3.0", "licensed under the open", r"licensed under the open software license version 3 0", 48),
    ("afl-3.0", "licensed under the academic", r"licensed under the academic free license version 3 0", 48),
    ("eupl-1.2", "licensed under the eupl", r"licensed under the eupl version 1 2(?: or as soon they will be approved by the european commission)?", 50),
    ("eupl-1.1", "licensed under the eupl", r"licensed under the eupl version 1 1(?: or as soon they will be approved by the european commission)?", 50),
    ("cecill-2.1", "this software is governed", r"this software is governed by the cecill license under french law", 50),
    ("cecill-b", "this software is governed", r"this software is governed by the cecill b license under french law", 52),
    ("cecill-c", "this software is governed", r"this software is governed by the cecill c license under french law", 52),
    ("ms-pl", "if you use the software", r"if you use the software you accept this license if you do not accept the license do not use the software", 44),
    ("ms-rl", "reciprocal grants", r"reciprocal grants for any file you distribute that contains code from the software", 48),
    ("nposl-3.0", "non profit open", r"non profit open software license (?:version )?3 0", 48),
    ("upl-1.0", "the universal permissive", r"the universal permissive license upl version 1 0", 50),
    ("wxwindows", "wxwindows library", r"wxwindows library licen[cs]e(?: version 3 1)?", 44),
    ("sleepycat", "redistributions in any form", r"redistributions in any form must be accompanied by information on how to obtain complete source code", 50),
    ("zpl-2.1", "zope public license", r"zope public license(?: zpl)? version 2 1", 48),
    # Permissive notices
    ("zlib", "this software is provided as", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 50),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 48),
    ("libpng", "the png reference", r"the png reference library is supplied as is", 48),
    ("libtiff", "permission to use copy modify", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 48),
    ("boost-1.0", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 52),
    ("boost-1.0", "distributed under the boost", r"distributed under the boost software license version 1 0", 50),
    ("curl", "permission to use copy modify", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 48),
    ("postgresql", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", 50),
    ("ncsa", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", 52),
    ("openssl", "this product includes software", r"this product includes software developed by the openssl project", 48),
    ("ssleay", "this product includes cryptographic", r"this product includes cryptographic software written by eric young", 48),
    ("php-3.01", "this product includes php", r"this product includes php software freely available from", 48),
    ("python-2", "psf is making python", r"psf is making python available to licensee on an as is basis", 50),
    ("python-2", "this license agreement is", r"this license agreement is between the python software foundation", 50),
    ("ruby", "you may make and give", r"you may make and give away verbatim copies of the source form of the software without restriction", 46),
    ("artistic-2", "the artistic license 2", r"the artistic license 2 0", 46),
    ("perl-artistic-1", "the intent of this document", r"the intent of this document is to state the conditions under which a package may be copied", 48),
    ("perl", "the same terms as perl", r"(?:under )?the same terms as perl itself", 46),
    ("unicode", "unicode inc", r"unicode inc license agreement data files and software", 48),
    ("icu", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute and or sell copies of the software and to permit persons", 53),
    ("w3c", "by obtaining using", r"by obtaining using and or copying this work you the licensee agree that you have read understood", 48),
    ("vim", "there are no restrictions", r"there are no restrictions on distributing unmodified copies of vim", 48),
    ("tcl", "the authors hereby grant", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", 50),
    ("bzip2", "this program bzip2", r"this program bzip2 the associated library libbzip2 and all documentation are copyright", 48),
    ("freetype", "portions of this software", r"portions of this software are copyright(?: [^ ]+){0,4} the freetype project", 48),
    ("ijg", "this software is based", r"this software is based in part on the work of the independent jpeg group", 48),
    ("json", "the software shall be used", r"the software shall be used for good not evil", 50),
    ("beerware", "as long as you retain", r"as long as you retain this notice you can do whatever you want with this stuff", 50),
    ("wtfpl", "you just do what", r"you just do what the fuck you want to", 50),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to public license", 48),
    ("fair", "usage of the works", r"usage of the works is permitted provided that this instrument is retained with the works", 50),
    ("ecl-2.0", "educational community license", r"educational community license (?:version )?2 0", 46),
    ("naumen", "naumen public license", r"naumen public license", 42),
    ("hpnd", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 48),
    ("ntp", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 48),
    ("mulan-psl-2", "mulan psl v2", r"mulan psl v2", 44),
    ("blueoak-1.0", "blue oak model license", r"blue oak model license(?: 1 0 0)?", 46),
    # Public domain and dedications
    ("unlicense", "this is free and unencumbered", r"this is free and unencumbered software released into the public domain", 52),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software", 48),
    ("cc0-1.0", "to the extent possible", r"to the extent possible under law(?: [^ ]+){1,12} (?:has|have) (?:waived|dedicated) all copyright and related", 50),
    ("cc0-1.0", "publicdomain zero", r"publicdomain zero 1 0", 46),
    ("cc0-1.0", "no rights reserved", r"no rights reserved", 30),
    ("cc-pdm-1.0", "publicdomain mark", r"publicdomain mark 1 0", 46),
    ("public-domain", "released into the public", r"released into the public domain", 36),
    ("public-domain", "placed in the public", r"placed in the public domain", 36),
    ("public-domain", "dedicated to the public", r"dedicated to the public domain", 36),
    ("public-domain", "in the public domain", r"(?:is|are|be) in the public domain", 32),
    # Creative Commons deeds and links
    ("cc-by-4.0", "creativecommons org licenses by 4", r"creativecommons org licenses by 4 0(?: legalcode)?", 48),
    ("cc-by-3.0", "creativecommons org licenses by 3", r"creativecommons org licenses by 3 0(?: [a-z]{2})?", 48),
    ("cc-by-2.0", "creativecommons org licenses by 2", r"creativecommons org licenses by 2 0(?: [a-z]{2})?", 48),
    ("cc-by-sa-4.0", "creativecommons org licenses by sa", r"creativecommons org licenses by sa 4 0(?: legalcode)?", 48),
    ("cc-by-sa-3.0", "creativecommons org licenses by sa", r"creativecommons org licenses by sa 3 0(?: [a-z]{2})?", 48),
    ("cc-by-nc-4.0", "creativecommons org licenses by nc", r"creativecommons org licenses by nc 4 0(?: legalcode)?", 48),
    ("cc-by-nd-4.0", "creativecommons org licenses by nd", r"creativecommons org licenses by nd 4 0(?: legalcode)?", 48),
    ("cc-by-nc-sa-4.0", "creativecommons org licenses by nc", r"creativecommons org licenses by nc sa 4 0(?: legalcode)?", 49),
    ("cc-by-nc-nd-4.0", "creativecommons org licenses by nc", r"creativecommons org licenses by nc nd 4 0(?: legalcode)?", 49),
    ("cc-by", "you must give appropriate", r"you must give appropriate credit provide a link to the license and indicate if changes were made", 40),
    ("cc-by-sa", "if you remix transform", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original", 44),
    ("cc-by-nd", "if you remix transform", r"if you remix transform or build upon the material you may not distribute the modified material", 44),
    ("cc-by-nc", "you may not use the material", r"you may not use the material for commercial purposes", 44),
    ("cc", "some rights reserved", r"some rights reserved", 26),
    # Fonts and data
    ("ofl-1.1", "this font software is", r"this font software is licensed under the sil open font license version 1 1", 52),
    ("ofl-1.1", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of the font software", 50),
    ("bitstream-vera", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license", 50),
    ("ubuntu-font-1.0", "ubuntu font licen", r"ubuntu font licen[cs]e(?: version)?(?: 1 0)?", 44),
    ("odbl-1.0", "open data commons open", r"open data commons open database license", 48),
    ("odc-by-1.0", "open data commons attribution", r"open data commons attribution license", 48),
    ("pddl-1.0", "open data commons public", r"open data commons public domain dedication and license", 48),
    ("cdla-permissive-2.0", "community data license", r"community data license agreement permissive version 2 0", 48),
    ("cdla-sharing-1.0", "community data license", r"community data license agreement sharing version 1 0", 48),
    ("ogl-uk-3.0", "open government licen", r"open government licen[cs]e(?: v(?:ersion)? ?3 0)?", 46),
    ("us-government-work", "this work was prepared", r"this work was prepared by an officer or employee of the united states government", 46),
    # Source available, model and restrictive terms
    ("bsl-1.1", "business source license", r"business source license 1 1", 46),
    ("sspl-1", "if you make the functionality", r"if you make the functionality of the program or a modified version available to third parties as a service", 50),
    ("elastic-2", "you may not provide the software", r"you may not provide the software to third parties as a hosted or managed service", 50),
    ("commons-clause", "commons clause", r"commons clause license condition(?: v1 0)?", 46),
    ("commons-clause", "the grant of rights", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software", 50),
    ("polyform-noncommercial-1.0", "polyform noncommercial", r"polyform noncommercial license(?: 1 0 0)?", 46),
    ("polyform-small-business-1.0", "polyform small business", r"polyform small business license(?: 1 0 0)?", 46),
    ("confluent-community-1.0", "confluent community license", r"confluent community license(?: agreement)?(?: version)?(?: 1 0)?", 46),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: license)?", 40),
    ("rail", "responsible ai license", r"responsible ai license", 40),
    ("non-commercial", "for non commercial use", r"for non commercial use only", 34),
    ("non-commercial", "for noncommercial use", r"for noncommercial use only", 34),
    ("non-commercial", "free for personal", r"free for personal use(?: only)?", 30),
    ("research-only", "for research purposes", r"for research purposes only", 32),
    ("research-only", "for academic use", r"for academic use only", 32),
    ("evaluation-only", "for evaluation purposes", r"for evaluation purposes only", 32),
    ("proprietary", "this software is proprietary", r"this software is proprietary(?: and confidential)?", 36),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", 44),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 34),
    ("proprietary", "you may not copy", r"you may not copy modify (?:or )?distribute", 32),
    ("all-rights-reserved", "no part of this publication", r"no part of this publication may be reproduced(?: distributed or transmitted)?", 38),
    ("all-rights-reserved", "may not be reproduced", r"may not be reproduced without (?:the )?(?:prior )?(?:written )?permission", 36),
    ("all-rights-reserved", "alle rechte vorbehalten", r"alle rechte vorbehalten", 34),
    ("all-rights-reserved", "tous droits", r"tous droits réservés", 34),
    ("all-rights-reserved", "todos los derechos", r"todos los derechos reservados", 34),
    ("all-rights-reserved", "tutti i diritti", r"tutti i diritti riservati", 34),
    ("all-rights-reserved", "todos os direitos", r"todos os direitos reservados", 34),
    # References to a license file
    ("see-license", "see the license file", r"see the license file(?: for (?:details|more information))?", 22),
    ("see-license", "see license", r"see license(?: txt| md)?(?: file)? for (?:details|more information|the full license text)", 22),
    ("see-license", "the full license text", r"the full license text (?:is|can be found)", 22),
    ("see-copying", "see the file copying", r"see the file copying(?: for (?:details|copying permission))?", 22),
    ("see-license", "use of this source code", r"use of this source code is governed by an? [^ ]+(?: style)? license that can be found in the license file", 40),
    ("bsd", "use of this source code", r"use of this source code is governed by a bsd style license that can be found in the license file", 46),
    ("mit", "use of this source code", r"use of this source code is governed by an mit style license that can be found in the license file", 46),
)
