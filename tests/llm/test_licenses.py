import re

import pytest

from duelytics.llm import licenses
from tests.llm.helpers import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        wanted = phrase.split()
        for k in range(len(words) - len(wanted) + 1):
            if words[k : k + len(wanted)] == wanted:
                places.append(k)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


MIT = licenses.TEMPLATES["mit-text"].replace("[[including the next paragraph]] ", "").replace("{{4}}", "Software")
TEXTS = [
    None, "", "no license", "Released under the MIT License.", "under the\nMIT-license, under the MIT License!",
    "Under the MITE license", "Apache License, Version 2.0", "xapache license version 2", "CC BY-NC 4.0 and cc-by-nc-sa",
    "Über cc by nc é", "under the mit", "under under the mit license", "Licensed under the Apache License, Version 2.0.",
    MIT, "x " * 50_000 + "cc by nc",
]


def test_base_places_against_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[3])]
    got = licenses.scan(documents(spark, rows, clashing=True)).collect()
    found = sorted(((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got), key=repr)
    assert found == sorted(((i, base(t)) for i, t in rows), key=repr)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.scan(documents(spark, [])).count() == 0


def test_templates_add_labels():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    assert "mit-text" in scanner.scan(MIT.upper())[5].split(",")
    assert "mit-text" not in scanner.scan(MIT.replace("free of charge", "for a charge"))[5].split(",")
    assert scanner.scan(MIT)[6] == 1.0
    assert "apache-2-notice" in scanner.scan("under the Apache License 2.0")[5].split(",")


@pytest.mark.parametrize("template, text, end", [
    ("a b c", "a b c d", 3), ("a [[b]] c", "a c", 2), ("a [[b]] c", "a b c", 3), ("a [[b d]] c", "a b c", -1),
    ("a {{2}} c", "a c", 2), ("a {{2}} c", "a x y c", 4), ("a {{2}} c", "a x y z c", -1), ("a [[b {{1}}]]", "a b x y", 3),
    ("[[x]] a", "a", 1), ("[[x]] a", "x a", 2), ("[[x [[y]] ]] a", "x a", 2), ("a {{3}}", "a", 1),
])
def test_automata(template, text, end):
    automaton = licenses.compile_template(template)
    assert automaton.longest([w.encode() for w in text.split()], 0) == end


def test_templates_must_not_be_empty():
    for template in ("[[a]]", "{{3}} a"):
        with pytest.raises(ValueError):
            licenses.compile_template(template)


MIT_END = """The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_END = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_the_end_of_a_license_is_mandatory_too():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    mit = MIT[:MIT.index("the above copyright")] + MIT_END
    assert scanner.scan(mit)[5:] == ("mit-text", 1.0)
    assert "mit-text" not in scanner.scan(mit.replace("WITHOUT WARRANTY", "WITH WARRANTY"))[5]
    assert "mit-text" not in scanner.scan(mit[:mit.index("THE SOFTWARE IS")])[5]
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
           " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list"
           " of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
           " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided"
           " with the distribution. ")
    assert scanner.scan(bsd + "3. " + BSD_END)[5:] == ("bsd-text", 1.0)
    assert scanner.scan(bsd + BSD_END[BSD_END.index("THIS SOFTWARE"):])[5:] == ("bsd-text", 1.0)
    assert scanner.scan(bsd + "3. " + BSD_END.replace("endorse or", ""))[5] == ""
    assert scanner.scan(bsd + BSD_END.replace("EVEN IF", "UNLESS"))[5] == ""
    apache = licenses.TEMPLATES["apache-2-header-notice"].replace("{{12}}", "http www apache org")
    assert "apache-2-header-notice" in scanner.scan(apache)[5] and scanner.scan(apache)[6] == 1.0
    assert "apache-2-header-notice" not in scanner.scan(apache[:apache.index(" see the")])[5]
