"""Common license notices and the labels that they must have; texts that must have none."""

import pytest

from quillon.llm import license_rules
from quillon.llm import license_scan as LS

NOTICES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted", "hpnd"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("The name of the author may not be used to endorse or promote products", "bsd-3-clause"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions", "bsd"),
    ("Redistributions in binary form must reproduce the above copyright notice", "bsd"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement:", "bsd-4-clause"),
    ("This software is provided 'as-is', without any express or implied warranty.", "warranty-disclaimer"),
    ("In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
    ("The origin of this software must not be misrepresented; you must not claim that you wrote it", "zlib"),
    ("Altered source versions must be plainly marked as such", "zlib"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1.0"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "apache-2.0"),
    ("you may not use this file except in compliance with the License", "apache-2.0"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", "apache-2.0"),
    ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.", "mpl-1.1"),
    ("subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.", "cddl-1.0"),
    ("under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation", "gpl-2.0"),
    ("version 3 of the GNU General Public License", "gpl-3.0"),
    ("the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2.0-or-later"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License", "gpl-3.0"),
    ("either version 3 of the GNU General Public License, or (at your option) any later version", "gpl-3.0-or-later"),
    ("the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "lgpl-2.1-or-later"),
    ("version 3 of the GNU Lesser General Public License", "lgpl-3.0"),
    ("the GNU Library General Public License version 2 of the License", "lgpl-2.0"),
    ("GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "agpl-3.0-or-later"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("has waived all copyright and related or neighboring rights to this work", "cc0-1.0"),
    ("As long as you retain this notice you can do whatever you want with this stuff.", "beerware"),
    ("The Software shall be used for Good, not Evil.", "json"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("This software is based in part on the work of the Independent JPEG Group.", "ijg"),
    ("you can redistribute it under the same terms as Perl itself", "artistic-or-gpl"),
    ("Copyright 2020 The Authors, with Reserved Font Name Example", "ofl-1.1"),
    ("You are free to share, copy and redistribute the material in any medium or format", "cc"),
    ("GPL version 2 with the Classpath exception", "classpath-exception"),
    ("As a special exception, the copyright holders of this library give you permission to link this library with independent modules", "classpath-exception"),
    ("GPL 3 with the GCC Runtime Library Exception, version 3.1", "gcc-exception"),
    ("Apache License v2.0 with LLVM Exceptions", "llvm-exception"),
    ("gives permission to link the code of portions of this program with the OpenSSL library", "openssl-exception"),
    ("As a special exception, you may create a larger work that contains part or all of the Bison parser skeleton", "bison-exception"),
    ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note", "linux-syscall-note"),
    ("Commons Clause License Condition v1.0", "commons-clause"),
    ("Additional Use Grant: none", "busl-1.1"),
    ("You may not provide the software to third parties as a hosted or managed service", "elastic-2.0"),
    ("End User License Agreement", "eula"),
    ("for non-commercial use only", "non-commercial"),
    ("For academic and non-commercial purposes only", "non-commercial"),
    ("Unauthorized copying of this file, via any medium, is strictly prohibited", "proprietary"),
    ("No part of this publication may be reproduced", "proprietary"),
    ("For internal use only.", "proprietary"),
    ("ALL RIGHTS\nRESERVED", "proprietary"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("SPDX-License-Identifier: (BSD-3-Clause)", "bsd-3-clause"),
    ("released under the MIT license", "mit"),
    ("Distributed under the Boost Software License, Version 1.0.", "bsl-1.0"),
    ("available under the terms of the 3-clause BSD license", "bsd-3-clause"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "epl-1.0"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("https://creativecommons.org/licenses/by-nc/3.0/", "cc-by-nc-3.0"),
    ("the implied warranty of MERCHANTABILITY or FITNESS", "warranty-disclaimer"),
    ("License: GPLv3", "gpl-3.0"),
    ("the EUPL, version 1.2", "eupl-1.2"),
    ("covered by the PostgreSQL License", "postgresql"),
    ("ImageMagick License", "imagemagick"),
    ("PSF license agreement for Python 3.12", "psf-2.0"),
]
NONE = ["She has a driving licence and permission to park.", "not a word about it", "The mit of the institute", "He wanted to redistribute the wealth, free of charge", "version 2 of the general plan", "in no event will the author be late"]
#: (text, labels that it must not have, whether nothing at all is left)
DENIED = [("This file is not released under the Mozilla Public License.", "mpl"), ("has never been licensed under the Apache Software License", "apache"), ("It is no longer distributed under the terms of the GNU Affero General Public License", "agpl"), ("isn't available under the BSD License", "bsd")]


@pytest.fixture(scope="module")
def scanned(spark):
    texts = [t for t, *_ in NOTICES] + NONE + [t for t, _ in DENIED]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {texts[r.row.doc_id]: r for r in LS.summary(LS.license_scan(docs)).collect()}


@pytest.mark.parametrize(("text", "label"), NOTICES)
def test_notice(scanned, text, label):
    assert label in scanned[text].labels.split(",") and scanned[text].score > 0


@pytest.mark.parametrize("text", NONE)
def test_no_notice(scanned, text):
    assert scanned[text].labels == "" and scanned[text].score == 0


@pytest.mark.parametrize(("text", "label"), DENIED)
def test_denied(scanned, text, label):
    r = scanned[text]
    assert label not in set(r.labels.split(",")) - set(r.base_labels.split(",")) and r.n_detections > 0 and r.score in (0, LS.BASE_SURE)


def test_versions_hide_what_they_contain(scanned):
    assert scanned["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."].labels == "mpl-1.1"
    assert scanned["either version 3 of the GNU General Public License, or (at your option) any later version"].labels == "gpl,gpl-3.0-or-later"  # gpl is a base phrase


def test_hundreds_of_rules_of_which_many_are_written_by_hand():
    assert len(license_rules.rules()) > 600 and len(license_rules.NOTICES) + len(license_rules.OTHER) > 110
