"""Licences in their usual wrapped form, bare and in comments."""

from latticut.llm import licenses

MIT = """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
BSD2 = """Copyright (c) 2020, A. Author

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = (
    BSD2
    + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""
)
APACHE = """Copyright 2020 A. Author

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.
"""
WHOLE = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2}


def shapes(text):
    lines = text.split("\n")
    yield text
    yield text.replace("\n", "\r\n")
    yield "\n".join(f"# {x}".rstrip() for x in lines)
    yield "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */\nint main() { return 0; }"
    yield "\n".join(f"dnl {x}" for x in lines)
    yield "\n\n".join(" ".join(x.split("\n")) for x in text.split("\n\n"))
    yield text.replace("1. ", "(a) ").replace("2. ", "b) ").replace("3. ", " * ")
    yield "\n".join(x for x in lines if x)


def test_wrapped_licences(frame):
    cases = [(licence, "Some text.\n\n" + s) for licence, text in WHOLE.items() for s in shapes(text)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.recognise(frame([(k, s) for k, (_, s) in enumerate(cases)])).collect()}
    assert got == {k: [licence] for k, (licence, _) in enumerate(cases)}


def test_sentences_are_whole(frame):
    rows = ["He said it was released under the MIT license", "Released under. The MIT license of old", "Released\n\nunder the MIT license terms", "MIT\fLicense", "Released under the\nMIT license", MIT.replace("sublicense", "resell").replace("MIT License", "")]
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.recognise(frame(list(enumerate(rows)))).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["mit-title-paren"], 4: ["mit-release"], 5: ["mit-notice"]}
