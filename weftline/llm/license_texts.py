"""Usual wordings of common licenses besides their one-sentence notices: short licenses whole,
standard headers, titles of the long legal texts, links and SPDX lines."""

from __future__ import annotations

_AS_IS_MIT = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_GRANT_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_BSD_BEGIN = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""
_BOOST = """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"""


def _gnu_header(what: str, name: str, version: str) -> str:
    return f"""This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software
Foundation, either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""


def _gnu(spdx: str, name: str, version: str, issued: str, whats: tuple[str, ...] = ("program",)) -> list[str]:
    return [
        *(_gnu_header(what, name, version) for what in whats),
        f"GNU {name} Version {version}, {issued}",
        f"under the terms of the GNU {name}, version {version}",
        f"under the terms of the GNU {name} version {version} or later",
        f"licensed under the GNU {name} v{version}",
        *_spdx(spdx, f"{spdx}-only", f"{spdx}-or-later"),
    ]


def _spdx(*names: str) -> list[str]:
    return [f"SPDX-License-Identifier: {name}" for name in names]


def _creative(kind: str, name: str) -> list[str]:
    return [
        f"Creative Commons {name} 4.0 International",
        f"Creative Commons {name} 4.0",
        f"Licensed under CC {kind.upper()} 4.0",
        f"CC-{kind.upper()}-4.0",
        f"creativecommons.org/licenses/{kind}/4.0",
        *_spdx(f"CC-{kind.upper()}-4.0"),
    ]


WORDINGS: dict[str, list[str]] = {
    "Apache-2.0": [_APACHE_HEADER, "Apache License Version 2.0, January 2004", "Released under the Apache License 2.0", "Licensed under the Apache License 2.0", *_spdx("Apache-2.0")],
    "MIT": [f"{_GRANT_MIT} {_AS_IS_MIT}", _GRANT_MIT, "Licensed under the MIT License", "Distributed under the MIT License", "under the terms of the MIT License", *_spdx("MIT")],
    "BSD-2-Clause": [f"{_BSD_BEGIN} {_BSD_AS_IS}", "BSD 2-Clause License", *_spdx("BSD-2-Clause")],
    "BSD-3-Clause": [f"{_BSD_BEGIN} {_BSD_NAMES} {_BSD_AS_IS}", "BSD 3-Clause License", *_spdx("BSD-3-Clause")],
    "ISC": [_ISC, *_spdx("ISC")],
    "Zlib": [_ZLIB, *_spdx("Zlib")],
    "Unlicense": [_UNLICENSE, *_spdx("Unlicense")],
    "BSL-1.0": [_BOOST, "Boost Software License - Version 1.0 - August 17th, 2003", *_spdx("BSL-1.0")],
    "GPL-1.0": _gnu("GPL-1.0", "General Public License", "1", "February 1989"),
    "GPL-2.0": _gnu("GPL-2.0", "General Public License", "2", "June 1991"),
    "GPL-3.0": _gnu("GPL-3.0", "General Public License", "3", "29 June 2007"),
    "LGPL-2.0": _gnu("LGPL-2.0", "Library General Public License", "2", "June 1991", ("library", "program")),
    "LGPL-2.1": _gnu("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999", ("library", "program")),
    "LGPL-3.0": _gnu("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007", ("library", "program")),
    "AGPL-3.0": _gnu("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"),
    "MPL-2.0": [_MPL_HEADER, "Mozilla Public License Version 2.0", *_spdx("MPL-2.0")],
    "CC-BY-4.0": _creative("by", "Attribution"),
    "CC-BY-SA-4.0": _creative("by-sa", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _creative("by-nc", "Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _creative("by-nd", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _creative("by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _creative("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "creativecommons.org/publicdomain/zero/1.0", *_spdx("CC0-1.0")],
}
