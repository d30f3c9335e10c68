"""Notices of public licenses, as their stewards word them. A name may have several."""

#: Creative Commons licenses by their short and long names, and versions as both name them.
COMMONS = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
VERSIONS = (("4.0", "4.0 International"), ("3.0", "3.0 Unported"))
WORDINGS = (
    "This work is licensed under a Creative Commons {long} License.",
    "Licensed under a Creative Commons {long} License.",
    "Licensed under CC {short}.",
    "Licensed under the CC {short} License.",
    "Released under CC {short}.",
)

#: SPDX identifiers and the license each names here.
SPDX = (
    ("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"),
    ("GPL-2.0-only", "GPL-2.0"), ("GPL-2.0-or-later", "GPL-2.0"), ("GPL-3.0-only", "GPL-3.0"), ("GPL-3.0-or-later", "GPL-3.0"),
    ("LGPL-2.1-only", "LGPL-2.1"), ("LGPL-2.1-or-later", "LGPL-2.1"), ("AGPL-3.0-only", "AGPL-3.0"), ("AGPL-3.0-or-later", "AGPL-3.0"),
    ("MPL-2.0", "MPL-2.0"), ("EPL-2.0", "EPL-2.0"), ("Unlicense", "Unlicense"), ("CC0-1.0", "CC0-1.0"),
    *((f"CC-{short}-{version}", f"CC-{short}-{version}") for short, _ in COMMONS for version, _ in VERSIONS),
)

AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
    " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
    " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
    " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission.\n"
)
BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
    " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with'
        " the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction',
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any"
        " later version.",
    ),
    (
        "AGPL-3.0",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by"
        " the Free Software Foundation, either version 3 of the License",
    ),
    (
        "LGPL-2.1",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by"
        " the Free Software Foundation; either version 2.1 of the License",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this"
        " work.",
    ),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    *(
        (f"CC-{short}-{version}", wording.format(long=f"{long} {named}", short=f"{short} {version}"))
        for wording in WORDINGS
        for short, long in COMMONS
        for version, named in VERSIONS
    ),
    # whole bodies
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation the'
        " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        " Software.\n" + AS_IS,
    ),
    ("BSD-2-Clause", BSD_TERMS + BSD_AS_IS),
    ("BSD-3-Clause", BSD_TERMS + BSD_NAMES + BSD_AS_IS),
    # titles and short headers
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Distributed under the MIT License."),
    ("ISC", "ISC License"),
    ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under Apache 2.0."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "Licensed under GPLv2."),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under GPLv3."),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "Licensed under AGPLv3."),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    *((name, f"SPDX-License-Identifier: {tag}") for tag, name in SPDX),
)
