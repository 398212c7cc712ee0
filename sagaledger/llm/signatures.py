"""Signatures of license texts, written by hand: sentences and phrases that stand in a license's text, its notice or its summary.

Each is a regular expression over lower-case words joined by one space (marks are gone, so "licensor's" is "licensor s").  A
signature names its license, or its family where several licenses of the family have the same sentence.
"""

from __future__ import annotations

SIGNATURES: dict[str, list[str]] = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "the above copyright notice and this permission notice shall be included in all copies",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
        "mit licensed",
        "this (?:project|code|software|library|package|work) is (?:licensed|released|made available) under the mit",
    ],
    "mit-0": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction (?:\\S+ ){1,30}persons? to whom the software is furnished to do so the software is provided"],
    "x11": ["except as contained in this notice the name of the x consortium shall not be used in advertising", "x window system is a trademark of x consortium"],
    "isc": [
        "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee",
        "provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and (?:the author|isc) disclaims all warranties with regard to this software",
    ],
    "0bsd": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"],
    "bsd-2-clause": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
        "the views and conclusions contained in the software and documentation are those of the authors",
    ],
    "bsd-3-clause": [
        "neither the name of (?:\\S+ ){1,12}may be used to endorse or promote products",
        "the name of the (?:author|copyright holder) may not be used to endorse or promote products derived from this software",
        "use of this source code is governed by a bsd style license",
    ],
    "bsd-4-clause": [
        "all advertising materials mentioning features or use of this software must display the following acknowledgement",
        "this product includes software developed by the university of california berkeley and its contributors",
    ],
    "apache-1.1": [
        "this product includes software developed by the apache software foundation",
        "products derived from this software may not be called apache nor may apache appear in their name",
    ],
    "apache-2": [
        "you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "see the license for the specific language governing permissions and limitations under the license",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce",
        "you must give any other recipients of the work or derivative works a copy of this license",
        "you must cause any modified files to carry prominent notices stating that you changed the files",
        "if the work includes a notice text file as part of its distribution",
        "see the notice file distributed with this work for additional information regarding copyright ownership",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "you should have received a copy of the gnu general public license",
        "this program is distributed in the hope that it will be useful but without any warranty",
        "the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change",
        "the gnu general public license is intended to guarantee your freedom to share and change",
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        "this program comes with absolutely no warranty for details type show w",
        "the gnu general public license does not permit incorporating your program into proprietary programs",
    ],
    "gpl-2": [
        "gnu general public license version 2 june 1991",
        "either version 2 of the license or at your option any later version",
        "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program",
        "accompany it with the complete corresponding machine readable source code",
        "under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation",
    ],
    "gpl-3": [
        "gnu general public license version 3 29 june 2007",
        "either version 3 of the license or at your option any later version",
        "the corresponding source for a work in object code form means all the source code needed to generate install",
        "a user product is either 1 a consumer product",
        "you may not propagate or modify a covered work except as expressly provided under this license",
        "no covered work shall be deemed part of an effective technological measure",
        "additional permissions are terms that supplement the terms of this license by making exceptions",
    ],
    "lgpl": [
        "you should have received a copy of the gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "a work that uses the library is an executable",
        "the ordinary general public license therefore permits such linking only if the entire combination fits its criteria of freedom",
    ],
    "lgpl-2.1": ["gnu lesser general public license version 2 1 february 1999", "either version 2 1 of the license or at your option any later version", "gnu library general public license version 2 june 1991"],
    "lgpl-3": ["gnu lesser general public license version 3 29 june 2007", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "the minimal corresponding source for a combined work"],
    "agpl-3": [
        "gnu affero general public license version 3 19 november 2007",
        "remote network interaction use with the gnu general public license",
        "your modified version must prominently offer all users interacting with it remotely through a computer network",
        "you should have received a copy of the gnu affero general public license",
    ],
    "mpl-1.1": ["the contents of this file are subject to the mozilla public license version 1 1", "the initial developer of the original code is", "alternatively the contents of this file may be used under the terms of either the gnu general public license"],
    "mpl-2": [
        "this source code form is subject to the terms of the mozilla public license",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        "this source code form is incompatible with secondary licenses as defined by the mozilla public license",
        "covered software is provided under this license on an as is basis without warranty of any kind",
    ],
    "epl-1": ["the accompanying program is provided under the terms of this eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"],
    "epl-2": ["this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0", "this source code may also be made available under the following secondary licenses when the conditions"],
    "cddl-1": ["the contents of this file are subject to the terms of the common development and distribution license", "when distributing covered code include this cddl header in each file", "you can obtain a copy of the license at usr src opensolaris license"],
    "cpl-1": ["the accompanying program is provided under the terms of this common public license", "any use reproduction or distribution of the program constitutes recipient s acceptance of this (?:common public license )?agreement"],
    "eupl-1.2": ["licensed under the eupl (?:version )?1 2", "this european union public licence the eupl applies to the work", "you may not use this work except in compliance with the licence"],
    "osl-3": ["licensed under the open software license version 3 0", "this open software license the license applies to any original work of authorship"],
    "afl-3": ["licensed under the academic free license version 3 0", "this academic free license the license applies to any original work of authorship"],
    "artistic-2": ["you may distribute verbatim copies of the source form of the standard version of this package", "the intent of this document is to state the conditions under which a package may be copied", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package"],
    "bsl-1": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software",
        "distributed under the boost software license version 1 0",
        "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
    ],
    "busl-1.1": ["the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "effective on the change date", "the business source license (?:this document or the license )?is not an open source license"],
    "elastic-2": ["you may not provide the software to third parties as a hosted or managed service", "you may not move change disable or circumvent the license key functionality"],
    "sspl-1": ["offering the program as a service if you make the functionality of the program or a modified version available to third parties as a service", "making the functionality of the program or modified version available to third parties as a service includes"],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    ],
    "libpng": ["the png reference library is supplied as is", "the contributing authors and group 42 inc disclaim all warranties"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest",
    ],
    "wtfpl": ["you just do what the fuck you want to", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "beerware": ["as long as you retain this notice you can do whatever you want with this stuff", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"],
    "ncsa": ["neither the names of (?:\\S+ ){1,20}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"],
    "postgresql": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "the university of california specifically disclaims any warranties"],
    "python-2": ["psf is making python available to licensee on an as is basis", "this license agreement is between the python software foundation psf", "psf hereby grants licensee a nonexclusive royalty free world wide license"],
    "php-3": ["this product includes php software freely available from", "products derived from this software may not be called php nor may php appear in their name"],
    "ruby": ["you may redistribute the software in source and binary forms provided that you do at least one of the following distribute the binaries and library files of the software", "ruby is copyrighted free software by yukihiro matsumoto"],
    "openssl": ["this product includes software developed by the openssl project for use in the openssl toolkit", "this product includes cryptographic software written by eric young"],
    "curl": ["permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "except as contained in this notice the name of a copyright holder shall not be used in advertising"],
    "vim": ["there are no restrictions on distributing unmodified copies of vim", "vim is charityware"],
    "json": ["the software shall be used for good not evil"],
    "icu": ["permission is hereby granted free of charge to any person obtaining a copy of this software (?:\\S+ ){1,60}both the above copyright notice s and this permission notice appear in supporting documentation"],
    "unicode": ["unicode inc license agreement data files and software", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"],
    "w3c": ["by obtaining and or copying this work you the licensee agree that you have read understood and will comply with the following terms", "this work is being provided by the copyright holders under the following license"],
    "upl-1": ["the larger works to which the software is contributed", "this license is subject to the following condition the above copyright notice and either this complete permission notice or at a minimum a reference to the upl"],
    "mulan-psl-2": ["you can use this software according to the terms and conditions of the mulan psl v2", "you may obtain a copy of mulan psl v2 at"],
    "cecill-2.1": ["this software is governed by the cecill license under french law", "as a counterpart to the access to the source code and rights to copy modify and redistribute granted by the license"],
    "blueoak-1": ["this license gives everyone as much permission to work with this software as possible while protecting contributors from liability", "in order to receive this license you must agree to its rules"],
    "ms-pl": ["if you distribute any portion of the software in source code form you may do so only under this license", "this license governs use of the accompanying software if you use the software you accept this license"],
    "ms-rl": ["for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code"],
    "ofl-1.1": [
        "this font software is licensed under the sil open font license",
        "neither the font software nor any of its individual components in original or modified versions may be sold by itself",
        "no modified version of the font software may use the reserved font name",
        "with reserved font name",
    ],
    "gfdl": ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "with no invariant sections no front cover texts and no back cover texts", "a copy of the license is included in the section entitled gnu free documentation license"],
    "odbl-1": ["made available under the open database license", "any rights in individual contents of the database are licensed under the database contents license", "contains information from (?:\\S+ ){1,8}which is made available here under the open database license"],
    "odc-by": ["made available under the open data commons attribution license", "contains information from (?:\\S+ ){1,8}which is made available under the odc attribution license"],
    "pddl-1": ["made available under the public domain dedication and license", "the work is not protected by copyright the database or its contents are dedicated to the public domain"],
    "cc": [
        "this work is licensed under a creative commons",
        "except where otherwise noted (?:this|the) (?:work|content|site) (?:\\S+ ){0,6}is licensed under a creative commons",
        "to view a copy of this license visit http s? ?creativecommons org licenses",
        "some rights reserved creative commons",
    ],
    "cc0": [
        "the person who associated a work with this deed has dedicated the work to the public domain",
        "to the extent possible under law (?:\\S+ ){1,8}has waived all copyright and related or neighboring rights",
        "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders",
        "creativecommons org publicdomain zero 1 0",
    ],
    "cc-by": ["creativecommons org licenses by [1-4] 0", "you are free to share and adapt the material for any purpose even commercially", "you must give appropriate credit provide a link to the license and indicate if changes were made"],
    "cc-by-sa": ["creativecommons org licenses by sa [1-4] 0", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"],
    "cc-by-nd": ["creativecommons org licenses by nd [1-4] 0", "if you remix transform or build upon the material you may not distribute the modified material"],
    "cc-by-nc": ["creativecommons org licenses by nc [1-4] 0", "you may not use the material for commercial purposes", "(?:free )?for non ?commercial use only"],
    "cc-by-nc-sa": ["creativecommons org licenses by nc sa [1-4] 0"],
    "cc-by-nc-nd": ["creativecommons org licenses by nc nd [1-4] 0"],
    "llama-community": [
        "you are granted a non exclusive worldwide non transferable and royalty free limited license under meta s intellectual property",
        "if on the (?:llama \\S+ )?version release date the monthly active users of the products or services made available by or for licensee",
        "built with (?:meta )?llama",
    ],
    "openrail-m": ["you agree not to use the model or derivatives of the model in any way that violates any applicable", "use based restrictions as referenced in paragraph 5", "the use restrictions set forth in attachment a"],
    "proprietary": [
        "all rights reserved no part of this (?:publication|book|work|document) may be reproduced",
        "this (?:software|document|file) (?:is|contains) (?:the )?(?:proprietary|confidential)(?: and (?:proprietary|confidential))? (?:information|property) of",
        "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material) (?:\\S+ ){0,8}is (?:strictly )?prohibited",
        "for internal use only",
        "do not (?:copy|distribute|reproduce) without (?:the )?(?:prior )?(?:written )?permission",
        "no license express or implied (?:\\S+ ){0,6}is granted",
        "by (?:installing|downloading|using) (?:the|this) software you agree to (?:be bound by )?the terms of this (?:end user )?license agreement",
        "end user license agreement",
        "this copyrighted material may not be (?:copied|reproduced|republished|redistributed)",
        "reproduction in whole or in part without (?:written )?permission is prohibited",
    ],
    "public-domain": [
        "this (?:work|file|code|software|document) (?:is|was) (?:hereby )?(?:placed|released) (?:in|into) the public domain",
        "no copyright is claimed (?:in|for)",
        "is (?:a work of the united states government and|not subject to copyright protection)",
        "this work is in the public domain in the united states because",
        "the author (?:hereby )?disclaims copyright to this source code",
    ],
}
