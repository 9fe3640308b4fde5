import textwrap

import pytest
from llm import licenses

NOTICES = {
    "mit": """Copyright (c) 2020 Someone. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "gpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "apache-2": """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License""",
}


def labels(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.labels for r in licenses.digest(licenses.scan(rows)).collect()}
    return [found[i] for i in range(len(texts))]


def test_wrapped_notices(spark):
    """Each notice, however its lines break, alone and behind comment signs in a longer text."""
    texts, expected = [], []
    for label, notice in NOTICES.items():
        for width in (30, 72, 80, 10_000):
            lines = textwrap.wrap(" ".join(notice.split()), width, break_long_words=False)
            texts += ["\n".join(lines), "some words before\n" * 40 + "\n".join(" * " + line for line in lines) + "\nand after" * 40]
            expected += [label] * 2
    assert labels(spark, texts) == expected


def test_blocks_against_all_windows():
    text = licenses.words(" ".join(NOTICES.values()).encode())
    known = licenses.index({}, licenses.TEMPLATES, marks={})
    for t in known.templates:
        windows = [len(set(t.tokens).intersection(text[k : k + t.width])) / len(t.tokens) for k in range(len(text))]
        found = [c for label, first, c in licenses.Index([t], {w: [(0, 0)] for w in t.tokens}).matches(text)]
        best = max(windows)
        assert max(found, default=0) == pytest.approx(best if best >= licenses.CONTAINMENT - 1e-9 else 0)


def test_kin_are_told_apart(spark):
    work = "This work is licensed under "
    cases = {
        "Released under the Apache License": "",
        "released under the GPL license": "",
        "The album was released under the name of a label that holds a license": "",
        "released " + "word " * 50 + "under the MIT " + "word " * 50 + "license": "",
        work + "a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        work + "a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
        work + "a Creative Commons Attribution 4.0 International License": "",
        work + "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "",
        work + "the GNU General Public License, version 3": "gpl-3",
        work + "the GNU General Public License, version 2": "",
        work + "the GNU Lesser General Public License, version 3": "",
        "Released under\nthe MIT License": "mit",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license""": "",
        "Permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee": "",
    }
    assert labels(spark, list(cases)) == list(cases.values())
