from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from siftspark.llm import licenses, url_filter

URLS = [
    ("http://A.example.COM/en/8?x", "a.example.com", "/en/8", "com/en/", "block"), ("http://example.com/en/712#x", "example.com", "/en/712", "example.com/en/7", "allow"), ("https://xcom/en/7", "xcom", "/en/7", None, "allow"), ("http://b.example.net/de/81", "b.example.net", "/de/81", "example.net/de/8", "block"),
    ("http://b.net/de/", "b.net", "/de/", "net/de/", "allow"), ("http://w.org/es/1", "w.org", "/es/1", "org/es/", "block"), (None, "", "", None, "allow"), ("no scheme /en/", "", "", None, "allow"), ("", "", "", None, "allow"), ("x://y://z/q", "y:", "//z/q", None, "allow"),
    ("http://www.cheap-pills.io", "www.cheap-pills.io", "", None, "block"), ("http://www.cheap-pills.net/de/1", "www.cheap-pills.net", "/de/1", "net/de/", "allow"), ("http://pillsbury.io/?a#b", "pillsbury.io", "/", None, "allow"), ("http://h#/en/", "h", "", None, "allow"),
]


def test_verdicts(spark):
    schema = "page_id long, url string, html string, host string, listed string"
    df = spark.createDataFrame([(i, u[0], "h", "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "h", "x", "y")], schema)
    listed = url_filter.hosts_of(df).filter(url_filter.listed_host(F.col("host")))
    for limit in (32 << 20, 4):  # the second needs several passes
        got = url_filter.filter_urls(df, listed, pass_bytes=limit).collect()
        assert len(got) == len(URLS) + 1
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:], r
    assert url_filter.filter_urls(df.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, listed.limit(0)).filter("rule IS NULL").collect()} == {"allow"}


def test_a_list_of_its_own(spark):
    rng = np.random.default_rng(9)
    names = [f"h{rng.integers(1 << 40):x}.example" for _ in range(3000)]  # no pattern tells the listed half
    listed = [n for n in names if rng.random() < 0.5]
    df = spark.createDataFrame([(i, f"https://{n.upper()}/a") for i, n in enumerate(names)] + [(None, None), (0, f"https://{names[0]}/b")], "page_id long, url string")
    keys = spark.createDataFrame([(x,) for x in [*listed, listed[0], None, "of.no.page"]], "host string")
    got = url_filter.filter_urls(df, keys).collect()
    assert len(got) == len(df.collect())
    assert {r.host for r in got if r.listed} == set(listed)
    assert all((r.verdict == "block") == r.listed for r in got)


def test_shards_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 50)
    rng = np.random.default_rng(4)
    names = [f"h{rng.integers(1 << 40):x}.example" for _ in range(600)]
    listed = {n for n in names if rng.random() < 0.3}
    rows = [(i, f"https://{n}/{i % 7}") for i, n in enumerate(names)] + [(10_000 + i, f"https://{names[i % 2]}/hot/{i}") for i in range(900)] + [(None, None), (5, "https://alone")]  # two hosts hold most pages
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(7)
    keys = spark.createDataFrame([(x,) for x in listed], "host string")
    told = lambda **how: sorted(((r.page_id is None, r.page_id), r.host, r.path, r.verdict, r.listed) for r in url_filter.filter_urls(df, keys, **how).collect())
    sharded = told(pass_bytes=0, part_pages=100)
    assert sharded == told() and {x[1] for x in sharded if x[4]} == listed and len(sharded) == len(rows)
    scans = url_filter.filter_urls(df, keys, pass_bytes=0)._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count("MapInArrow") == 1


def test_cascade_is_exact():
    rng = np.random.default_rng(3)
    for a, b in ((1000, 50_000), (1, 5), (0, 10), (10, 0), (5000, 100)):
        h = rng.integers(0, 1 << 63, (2, a + b), np.uint64)
        levels = url_filter.build_levels((h[0, :a], h[1, :a]), (h[0, a:], h[1, a:]))
        assert (url_filter.holds(levels, h[0], h[1]) == (np.arange(a + b) < a)).all()


LICENSED = "x Licensed under the Apache License, Version 2.0. And the MIT license\nMIT\nLicense; General Public License é mit license"


def test_licenses(spark, make):
    rows = [(1, LICENSED), (2, None), (3, ""), (4, "Licensed under the Apache License version 3.0"), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "Licensed under CC BY-NC 4.0"), (7, "This fine piece of work is released under the terms of the MIT License"), (1, LICENSED), (None, "mit-license"), (8, "word " * 30000 + "MIT license")]
    got = {r.doc_id: r for r in licenses.scan_licenses(make(rows)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (21, 5, 4, 19)
    assert got[1].base_labels == "apache,gpl,mit"
    assert "apache-2.0" in got[1].labels.split(",")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0)
    assert got[4].labels == "apache"
    assert got[5].labels == "gpl,gpl-3.0"
    assert (got[6].labels, got[6].score) == ("cc-by-nc-4.0", 1.0)
    assert got[7].labels == "mit,mit-notice"
    assert got[None].base_labels == "mit"
    assert (got[8].n_words, got[8].first_word) == (30002, 30000)
    assert licenses.scan_licenses(make([])).count() == 0


def test_automata_are_regular_expressions(prose):
    template = "permission [[is [[hereby]]]] granted to {{2}} free of charge"
    a = licenses.compile_template("x", template)
    pattern = re.compile(r"permission( is( hereby)?)? granted to( \S+){0,2} free of charge")
    for text in ("permission granted to free of charge", "permission is hereby granted to any person free of charge", "permission hereby granted to a free of charge", "permission is granted to a b c free of charge", "permission is granted to free free of charge", "permission is granted to you for free"):
        words = text.encode().split()
        assert (licenses.accept(a, words, 0) == len(words)) == bool(pattern.fullmatch(text)), text


def test_word_counts(make, prose):
    texts = ["", "a", " a-b_c\x80é 12", "__", prose(3, 200), "\x00x\x7fy"]
    got = {r.doc_id: r.n_words for r in licenses.scan_licenses(make(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        assert got[i] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)), repr(t)


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{}
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""


def test_whole_texts_and_altered_ones(make):
    rows = [(1, MIT.format("")), (2, MIT.format("The Software shall be used for Good, not Evil.")), (3, MIT.format("").replace("merge, ", "")), (4, MIT.format("").split("THE SOFTWARE IS")[0]), (5, APACHE), (6, APACHE.replace("AS IS", "AS WAS")), (7, "x " * 500 + GPL), (8, GPL.replace("redistribute it and/or ", ""))]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan_licenses(make(rows)).collect()}
    assert [i for i in got if "mit-text" in got[i]] == [1]
    assert [i for i in got if "apache-2.0-notice" in got[i]] == [5]
    assert [i for i in got if "gpl-3.0-notice" in got[i]] == [7]


def test_base_columns_are_brute_force(make, spark, sf_dir):
    rng = np.random.default_rng(4)
    words = ["MIT", "license", "Apache", "general", "public", "é", "x-y", "licenses", "mit", "LICENSE"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(200)] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(make(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        assert got[i] == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({y for _, y in places}))), t
