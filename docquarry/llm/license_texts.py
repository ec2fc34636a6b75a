"""Notices of common licenses, and the identifiers that tags name. All texts are public; labels are SPDX identifiers in lower case.

A notice: (label, text, key phrases, phrases that must not stand there). Of each group of key phrases one must stand, word by
word, at its place in the notice. Only words count, so signs are left out.
"""

_AS_IS = (
    "the software is provided as is without warranty of any kind "
    "express or implied including but not limited to the warranties "
    "of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable "
    "for any claim damages or other liability whether in an action "
    "of contract tort or otherwise arising from out of or "
    "in connection with the software or the use or other "
    "dealings in the software"
)
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or "
    "without modification are permitted provided that the following conditions "
    "are met "
    "1 redistributions of source code must retain the above copyright "
    "notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright "
    "notice this list of conditions and the following disclaimer in "
    "the documentation and or other materials provided with the distribution "
)
_BSD_TAIL = (
    "this software is provided by the copyright holders and contributors "
    "as is and any express or implied warranties including but "
    "not limited to the implied warranties of merchantability and fitness "
    "for a particular purpose are disclaimed in no event shall "
    "the copyright holder or contributors be liable for any direct "
    "indirect incidental special exemplary or consequential damages including but "
    "not limited to procurement of substitute goods or services loss "
    "of use data or profits or business interruption however caused "
    "and on any theory of liability whether in contract strict "
    "liability or tort including negligence or otherwise arising in any "
    "way out of the use of this software even if "
    "advised of the possibility of such damage"
)
_BSD_KEYS = ("redistribution and use", "source and binary forms", "redistributions of source code", "redistributions in binary form", "copyright holders and contributors")


def _gnu(program: str, name: str, version: str) -> str:
    return (
        f"this {program} is free software you can redistribute it "
        f"and or modify it under the terms of the {name} "
        "as published by the free software foundation "
        f"either version {version} of the license or at your option "
        f"any later version this {program} is distributed in the "
        "hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness "
        f"for a particular purpose see the {name} for more details"
    )


def _version(v: str) -> tuple[str, ...]:
    return f"version {v}", f"{v} of the license", f"{v} of the"


_GPL, _LGPL, _AGPL = "gnu general public license", "gnu lesser general public license", "gnu affero general public license"

_NOT_GPL = ("lesser general", "affero general", "library general")

#: Names that stand for a license by themselves, word by word.
NAMES = (
    ("apache-2.0", "apache license version 2 0"), ("apache-2.0", "apache license 2 0"), ("mpl-2.0", "mozilla public license version 2 0"), ("mpl-2.0", "mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla public license 2 0"), ("epl-2.0", "eclipse public license v2 0"), ("epl-2.0", "eclipse public license version 2 0"), ("epl-2.0", "eclipse public license 2 0"),
    ("gpl-2.0", "gnu general public license version 2"), ("gpl-3.0", "gnu general public license version 3"), ("lgpl-2.1", "gnu lesser general public license version 2 1"),
    ("lgpl-3.0", "gnu lesser general public license version 3"), ("agpl-3.0", "gnu affero general public license version 3"), ("bsd-2-clause", "bsd 2 clause license"),
    ("bsd-3-clause", "bsd 3 clause license"), ("isc", "isc license"), ("zlib", "zlib license"), ("bsl-1.0", "boost software license version 1 0"), ("bsl-1.0", "boost software license 1 0"),
    ("cc-by-4.0", "creative commons attribution 4 0"), ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0"), ("cc0-1.0", "cc0 1 0 universal"), ("eupl-1.2", "european union public licence v 1 2"),
)

NOTICES: tuple[tuple[str, str, tuple[tuple[str, ...], ...], tuple[str, ...]], ...] = (
    ("mit", (
        "permission is hereby granted free of charge to any person "
        "obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and "
        "to permit persons to whom the software is furnished to "
        "do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the software "
    ) + _AS_IS, (("to deal in the software", "permission is hereby granted", "publish distribute sublicense", "copies or substantial portions", "claim damages"),), ()),
    ("mit", "released under the mit license", (("mit license",),), ()),
    ("apache-2.0", (
        "licensed under the apache license version 2 0 the license "
        "you may not use this file except in compliance "
        "with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an "
        "as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the "
        "specific language governing permissions and limitations under the license"
    ), (("apache license", "www apache org", "apache org"), ("2 0", "version 2", "license 2")), ()),
    # a notice whose version can't be read still names its family
    ("gpl", _gnu("program", _GPL, "2"), (("gnu general", "general public"),), _NOT_GPL),
    ("lgpl", _gnu("library", _LGPL, "2 1"), (("lesser",),), ()),
    ("agpl", _gnu("program", _AGPL, "3"), (("affero",),), ()),
    ("gpl-2.0", _gnu("program", _GPL, "2"), (("gnu general", "general public"), _version("2")), _NOT_GPL),
    ("gpl-3.0", _gnu("program", _GPL, "3"), (("gnu general", "general public"), _version("3")), _NOT_GPL),
    ("lgpl-2.1", _gnu("library", _LGPL, "2 1"), (("lesser", "gnu lesser"), _version("2 1")), ()),
    ("lgpl-3.0", _gnu("library", _LGPL, "3"), (("lesser", "gnu lesser"), _version("3")), ()),
    ("agpl-3.0", _gnu("program", _AGPL, "3"), (("affero", "gnu affero"), _version("3")), ()),
    ("bsd-2-clause", _BSD_HEAD + _BSD_TAIL, (_BSD_KEYS,), ("neither the name", "endorse or promote products", "contributors may be used to endorse", "specific prior written permission")),
    ("bsd-3-clause", _BSD_HEAD + (
        "3 neither the name of the copyright holder nor the names "
        "of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission "
    ) + _BSD_TAIL, (_BSD_KEYS, ("neither the name", "endorse or promote", "to endorse", "its contributors", "prior written permission")), ()),
    ("isc", (
        "permission to use copy modify and or distribute this software "
        "for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice "
        "appear in all copies the software is provided as is "
        "and the author disclaims all warranties with regard to this "
        "software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any "
        "special direct indirect or consequential damages or any damages whatsoever "
        "resulting from loss of use data or profits whether in "
        "an action of contract negligence or other tortious action arising "
        "out of or in connection with the use or performance of this software"
    ), (("in all copies", "permission notice appear", "provided that the above", "tortious action", "author disclaims"),), ()),
    ("0bsd", (
        "permission to use copy modify and or distribute this software "
        "for any purpose with or without fee is hereby granted "
        "the software is provided as is and the author disclaims "
        "all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the "
        "author be liable for any special direct indirect or consequential damages"
    ), (("with or without fee", "author disclaims", "permission to use", "any purpose with", "hereby granted"),), ("appear in all copies", "permission notice appear", "provided that the above copyright notice")),
    ("mpl-2.0", (
        "this source code form is subject to the terms of "
        "the mozilla public license v 2 0 if a copy of "
        "the mpl was not distributed with this file you can "
        "obtain one at https mozilla org mpl 2 0"
    ), (("mozilla public license", "public license v 2 0", "the mpl was", "mozilla org mpl"),), ()),
    ("epl-2.0", (
        "this program and the accompanying materials are made available under "
        "the terms of the eclipse public license v2 0 which "
        "accompanies this distribution and is available at "
        "https www eclipse org legal epl 2 0"
    ), (("eclipse public license", "www eclipse org", "legal epl", "accompanying materials"),), ()),
    ("unlicense", (
        "this is free and unencumbered software released into the public "
        "domain anyone is free to copy modify publish use compile "
        "sell or distribute this software either in source code form "
        "or as a compiled binary for any purpose commercial or "
        "non commercial and by any means"
    ), (("unencumbered software", "public domain", "anyone is free", "compiled binary"),), ()),
    ("zlib", (
        "this software is provided as is without any express or "
        "implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this "
        "software permission is granted to anyone to use this software "
        "for any purpose including commercial applications and to alter it "
        "and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you "
        "must not claim that you wrote the original software"
    ), (("granted to anyone", "not be misrepresented", "redistribute it freely", "commercial applications"),), ()),
    ("bsl-1.0", (
        "permission is hereby granted free of charge to any person "
        "or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license the software to use reproduce "
        "display distribute execute and transmit the software and to prepare "
        "derivative works of the software and to permit third parties "
        "to whom the software is furnished to do so"
    ), (("person or organization", "execute and transmit", "prepare derivative", "third parties"),), ()),
    ("wtfpl", (
        "everyone is permitted to copy and distribute verbatim or modified "
        "copies of this license document and changing it is allowed "
        "as long as the name is changed "
        "do what the fuck you want to public license "
        "terms and conditions for copying distribution and modification "
        "0 you just do what the fuck you want to"
    ), (("fuck you want", "changing it is allowed", "the fuck"),), ()),
    ("cc0-1.0", (
        "to the extent possible under law the author has waived "
        "all copyright and related or neighboring rights to this work"
    ), (("neighboring rights", "has waived", "waived all copyright", "related or"),), ()),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", (("commons attribution 4", "attribution 4 0", "attribution 4"),), ()),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", (("attribution sharealike", "sharealike 4 0"),), ()),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", (("attribution noncommercial", "noncommercial 4 0"),), ()),
    ("eupl-1.2", (
        "licensed under the eupl version 1 2 or as soon "
        "they will be approved by the european commission subsequent versions "
        "of the eupl the licence you may not use this "
        "work except in compliance with the licence"
    ), (("the eupl", "european commission", "the licence"),), ()),
)
NOTICES += tuple((label, name, ((name,),), ()) for label, name in NAMES)

#: Identifiers that an SPDX-License-Identifier tag may name; their words are looked up, the longest run first.
IDENTIFIERS = (
    "0bsd afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 "
    "cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 ecl-2.0 epl-1.0 epl-2.0 "
    "eupl-1.1 eupl-1.2 gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later isc lgpl-2.0 lgpl-2.1 lgpl-2.1-only "
    "lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl ncsa ofl-1.1 openssl osl-3.0 "
    "php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1"
).split()
