"""Standard notices as they stand in files: wrapped, in comments, on one line."""

import pytest

from wavemill.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
BSD_2 = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
REST = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
BSD_3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_2 = """A program that does things.
Copyright (C) 2020 Some Body

This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
"""
GPL_3 = GPL_2.replace("free software;", "free software:").replace("Foundation; either version 2", "Foundation, either version 3")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
"""


def commented(text, prefix):
    return "\n".join((prefix + line).rstrip() for line in text.split("\n"))


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""

TEXTS = [
    (LGPL, "LGPL-2.1-or-later"),
    (commented(LGPL, " * "), "LGPL-2.1-or-later"),
    (commented(AGPL, "# "), "AGPL-3.0-or-later"),
    (ZLIB, "Zlib"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", "Apache-2.0,MIT"),
    ("# SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("/* SPDX-License-Identifier: (GPL-2.0-or-later AND LGPL-2.1-only) */", "GPL-2.0-or-later,LGPL-2.1-only"),
    ("SPDX-License-Identifier: WTFPL", ""),
    ("This work is licensed under the Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This project is available under the MIT license.", "MIT"),
    ("Licensed under the GPLv3", "GPL-3.0-only"),
    ("Released under the ISC license; enjoy.", "ISC"),
    (MIT, "MIT"),
    (commented(MIT, " * "), "MIT"),
    (commented(MIT, "# "), "MIT"),
    (MIT.replace("\n", "\r\n"), "MIT"),
    (" ".join(MIT[MIT.index("Permission"):].split()), "MIT"),
    (BSD_2 + REST, "BSD-2-Clause"),
    (BSD_2 + BSD_3 + REST, "BSD-3-Clause"),
    (commented(BSD_2 + BSD_3 + REST, "// "), "BSD-3-Clause"),
    ((BSD_2 + BSD_3 + REST).replace("\n\n1.", "\n1.").replace("\n\n2.", "\n2.").replace("\n\n3.", "\n3."), "BSD-3-Clause"),
    (" ".join((BSD_2 + BSD_3 + REST).split()), "BSD-3-Clause"),
    ((BSD_2 + BSD_3 + REST).replace("the copyright holder", "Big Firm Inc."), "BSD-3-Clause"),
    ((BSD_2 + BSD_3 + REST).replace("1.", "(1)").replace("2. R", "(2) R").replace("3.", "(3)"), "BSD-3-Clause"),
    (GPL_2, "GPL-2.0-or-later"),
    (commented(GPL_2, " * "), "GPL-2.0-or-later"),
    (GPL_3, "GPL-3.0-or-later"),
    (MPL, "MPL-2.0"),
    (APACHE, "Apache-2.0"),
    ("This work has been released into the public\ndomain.", "public-domain"),
    ("Licensed under the GNU General Public License version\n2. See there.", "GPL-2.0-only"),
    (MIT + "\n" + MPL + "\n" + BSD_2, "BSD-2-Clause,MIT,MPL-2.0"),
    (BSD_2.split("1.")[0] + REST, ""),
    (MIT.replace("and this permission notice", "and this"), ""),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t) for i, (t, _) in enumerate(TEXTS)]
    return {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_standard_notices(found, i):
    assert found[i] == TEXTS[i][1]
