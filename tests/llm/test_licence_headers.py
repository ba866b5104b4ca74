"""Licence headers as they are written in files, beside SQL."""

from test_links import pandas, same

from colophon.llm import licenses, queries

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2 = GPL3.replace("software:", "software;").replace("version 3", "version 2")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
WRITTEN = {
    "mit-text": MIT, "mit-named": "Released under the MIT License.", "apache-text": APACHE, "apache-named": APACHE.split(";")[0] + ";",
    "gpl3-text": GPL3, "gpl2-text": GPL2, "gpl3-named": "Licensed under the GNU General Public License, version 3.",
    "bsd3-text": BSD3, "bsd2-text": BSD2, "cc-by-named": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-named": "Licensed under CC BY-SA 4.0.", "cc-by-nc-named": "Licensed under CC BY-NC 4.0.", "isc-text": ISC, "mpl-text": MPL,
    "unlicense-text": "This is free and unencumbered software released into the public domain.", "reserved-named": "All rights reserved.",
}


def test_every_rule_on_its_header(spark):
    assert set(WRITTEN) == {r.rule for r in licenses.LICENCE_RULES}
    forms = [lambda t: t, lambda t: "/*\n" + "\n".join(" * " + x if x else " *" for x in t.split("\n")) + "\n */"]
    rows = [(i, rule, f"Some words before.\n\n{form(text)}\n\nint main() {{}}\n") for i, (rule, text, form) in enumerate((r, t, f) for r, t in WRITTEN.items() for f in forms)]
    documents = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    df = licenses.scan_licences(documents)
    assert sorted((r["doc_id"], r["rule"]) for r in df.collect()) == [(i, rule) for i, rule, _ in rows]
    same(df, queries.oracle_sql()["op8_license_scan"], documents=pandas(documents))
