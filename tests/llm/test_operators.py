"""Every operator against a brute-force version, and on nulls, empty and long texts, repeats, ties, empty tables and clashing columns."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from codecorpus.llm import decontam, html_extract, langid, licenses, mix, ngram_join, quality, secrets, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else w + "x" for w in text.split())


@pytest.fixture(scope="module")
def edge_docs(make_docs, with_clashes):
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, prose(1, 60_000)), (6, prose(2, 40)), (6, prose(2, 40)), (7, "é ß 漢字 🙂"), (None, prose(3, 40)), (None, None)]
    return with_clashes(make_docs(rows, source={1: None, 7: "ü"}))


# ---- mixing ----------------------------------------------------------------------------------------------------------


def water(sizes, weights, total, cap=2.0):
    """Targets by sharing again and again."""
    target, free, left = dict.fromkeys(sizes, 0.0), set(sizes), total
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_targets_and_words(make_docs):
    sources = {i: ["a", "b", "c", "d", None][min(i % 11, 4)] for i in range(600)}
    texts = {i: prose(i, 5 + i % 90) for i in range(600)}
    docs = make_docs(texts, source=sources)
    rows = mix.mix(docs).report().collect()
    sizes = Counter()
    for i, t in texts.items():
        sizes[sources[i]] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len(texts[r.doc_id].split()) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 10
    again = {r.doc_id: r.taken for r in mix.mix(docs.repartition(7)).report().collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_mix_rows_follow_the_report(make_docs):
    docs = make_docs({i: prose(i, 10 + i % 30) for i in range(200)}, source={i: f"s{i % 3}" for i in range(200)})
    m = mix.mix(docs)
    copies = {r.doc_id: r.copies for r in m.report().collect()}
    rows = m.rows().collect()
    assert Counter(r.doc_id for r in rows) == Counter({k: v for k, v in copies.items() if v})
    assert {r.shard for r in rows} <= set(range(mix.SHARDS))


def test_split_tree_is_exact():
    out = mix.split_tree([5, 0, 37, 1000], 7, 1)
    assert out.sum(axis=0).tolist() == [5, 0, 37, 1000]
    assert max(out.sum(axis=1)) - min(out.sum(axis=1)) <= 7


def test_mix_edges(edge_docs):
    rows = mix.mix(edge_docs).report().collect()
    assert len(rows) == 10
    assert all(r.taken <= 2 * r.size for r in rows)
    assert {r.doc_id: r.size for r in rows if r.doc_id in (1, 2, 3)} == {1: 0, 2: 0, 3: 0}
    assert mix.mix(edge_docs.limit(0)).report().count() == 0
    assert set(edge_docs.columns) <= set(mix.mix(edge_docs).rows().columns)


# ---- n-gram Jaccard join -----------------------------------------------------------------------------------------------


def corpus():
    texts = {i: prose(i, 30 + i % 50) for i in range(40)}
    base = prose(999, 200)
    for k in range(60):  # a group of near copies, at every distance
        texts[100 + k] = edited(base, k, 0.002 * (k % 20))
    line = prose(5, 30)
    for k in range(30):  # one passage that many share
        texts[300 + k] = prose(2000 + k, 80) + " " + line
    for k in range(5):
        texts[400 + k] = prose(7, 3)
    return texts | {500: None, 501: "", 502: "ALPHA beta Gamma delta epsilon", 503: "alpha BETA gamma delta epsilon"}


def test_join_equals_brute_force(make_docs):
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(make_docs(texts)).collect()}
    assert got == ngram_join.brute_force(texts)


def test_join_with_long_lists_everywhere(make_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 2)
    monkeypatch.setattr(ngram_join, "SHOW", 1)
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(make_docs(texts)).collect()}
    assert got == ngram_join.brute_force(texts)


def test_join_edges(edge_docs):
    got = ngram_join.components(edge_docs).collect()
    assert len(got) == 10
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[4] == (1, 4) and by[6][1] == 6
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.components(edge_docs.limit(0)).count() == 0
    kept = ngram_join.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns and kept.filter("doc_id = 6").count() == 1


# ---- secrets -----------------------------------------------------------------------------------------------------------


def base_by_rule(text):
    out = []
    for kind, pattern, least in (
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        ("access", r"(AKIA[A-Z0-9]+)", 20),
        ("hex", r"([0-9a-f]+)", 24),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), kind, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_secrets_base_spans(make_docs):
    r = random.Random(4)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = {
        1: f'é token = "{hexa(40)}" x', 2: f"PassWord: abcde and passwd=abcdef secret='s-1.2_3' API_KEY:{hexa(30)}", 3: "AKIA" + "A1" * 8 + " AKIASHORT " + "AKIA" + "B" * 30,
        4: hexa(23) + " " + hexa(24) + " g" + hexa(60), 5: None, 6: "", 7: prose(3, 100), 8: "ſecret=abcdef1 toKen=abcdef1",
    }
    rows = {x.doc_id: x for x in secrets.report(make_docs(texts)).collect()}
    for i, t in texts.items():
        want = base_by_rule(t or "")
        got = [s for s in rows[i].spans.split(",") if s and not s.startswith("learned")]
        assert got == want
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
    assert rows[7].n_learned == 0


def test_network_on_findings_held_back():
    made = secrets.made_findings(1_600, seed=50)
    x, y = np.stack([secrets.encode(t, a, b) for t, a, b, _ in made]), np.array([m[3] for m in made], dtype=float)
    net = secrets.CharNet()
    net.fit(x[:1000], y[:1000])
    net.calibrate(x[1000:1300], y[1000:1300])
    p = net.probability(x[1300:]) >= net.threshold
    assert (p == y[1300:]).mean() > 0.93
    assert p[y[1300:] == 1].mean() > 0.85


def test_redaction(make_docs, edge_docs):
    texts = {1: "a token = abcdef0123456789abcdef0123456789 z", 2: None, 3: "clean text"}
    got = {r.doc_id: r.text for r in secrets.redact(make_docs(texts)).collect()}
    assert got[1].startswith("a [REDACTED]") and got[1].endswith(" z") and "abcdef" not in got[1]
    assert got[2] is None and got[3] == "clean text"
    out = secrets.redact(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == 10
    assert secrets.report(edge_docs.limit(0)).count() == 0


# ---- toxicity ----------------------------------------------------------------------------------------------------------


def labelled(spark, labels, name):
    return spark.createDataFrame([(i, y) for i, y in labels.items()], f"doc_id long, {name} int")


def test_toxicity_held_out(spark, make_docs):
    r = random.Random(9)
    bad = ["blarg", "snizzle", "grumpf"]
    texts, labels = {}, {}
    for i in range(1_200):
        words = prose(i, 40 + i % 40).split()
        labels[i] = int(i % 6 == 0)
        if labels[i]:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(bad))
        texts[i] = " ".join(words)
    texts |= {5_000: "alpha Bl4rg beta sn1zzle grumpf", 5_001: "alpha вlаrg snizzle bl@rg beta", 5_002: None, 5_003: "", 5_004: prose(77, 50)}
    rows = toxicity.report(make_docs(texts), labelled(spark, labels, "toxic")).collect()
    by = {x.doc_id: x for x in rows}
    held = [x for x in rows if x.held_out and x.doc_id in labels]
    assert len(held) > 100 and np.mean([x.predicted == labels[x.doc_id] for x in held]) > 0.97
    assert by[5_000].predicted == 1 and by[5_001].predicted == 1
    assert by[5_002].predicted == by[5_003].predicted == by[5_004].predicted == 0
    assert all(0 <= x.score <= 1 for x in rows)


def test_exception_phrases():
    lex = toxicity.Lexicon({"blarg": 3.0, "sniz*": 2.0}, ["blarg soup"])
    assert lex.measure(b"hot blarg soup")[2] == 0
    assert lex.measure(b"you blarg")[2] == 1
    assert lex.measure(b"snizzles and blargs")[2] == 1
    words, weight, hits, top = lex.measure("Ｂｌａｒｇ b​larg x".encode())
    assert (words, hits, top) == (3, 1, 3.0) and 3.0 < weight < 6.0


def test_toxicity_edges(spark, edge_docs):
    labels = labelled(spark, {4: 0, 6: None}, "toxic")
    rows = toxicity.report(edge_docs, labels).collect()
    assert len(rows) == 10 and all(r.predicted == 0 for r in rows)
    assert all(r.held_out is None for r in rows if r.doc_id is None)
    assert toxicity.report(edge_docs.limit(0), labels.limit(0)).count() == 0


# ---- language ----------------------------------------------------------------------------------------------------------


def test_language_held_out_and_mixtures(make_docs):
    words = {"aa": "kala tuva miro senna pola".split(), "bb": "zwix grolf brunk stampf kratz".split(), "cc": "eau oui peu mieux lieu".split()}

    def text(lang, seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(words[lang]) for _ in range(n))

    langs = {i: ["aa", "bb", "cc"][i % 3] for i in range(300)}
    texts = {i: text(langs[i], i, 30) for i in langs}
    texts |= {900: text("aa", 1, 60) + " " + text("bb", 2, 30), 901: None, 902: "12345 !!", 903: ""}
    rows = {r.doc_id: r for r in langid.report(make_docs(texts, lang=langs)).collect()}
    assert all(rows[i].lang_pred == langs[i] for i in langs if rows[i].held_out)
    assert rows[900].lang_pred == "aa" and 0.5 < rows[900].score < 0.8 and "bb" in rows[900].languages
    assert [rows[i].lang_pred for i in (901, 902, 903)] == ["und"] * 3


def test_language_edges(edge_docs):
    rows = langid.report(edge_docs).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert langid.report(edge_docs.limit(0)).count() == 0


# ---- HTML --------------------------------------------------------------------------------------------------------------


def page(body, head="", foot=""):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script><style>p{{}}</style></head><body>{head}{body}{foot}</body></html>"


NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"


def test_html_articles(spark):
    rows = [
        (1, "http://a.example/1", page("<article><h1>Head &amp; more</h1><p>One  two<br>three<p>Four &lt;5</article>", NAV, "<footer>foot</footer>")),
        (2, "http://a.example/2", page("<article><h1>Other</h1><p>Text<!-- no --> here.</p><aside>side</aside><div class='comments'><p>user says</p></div></article>", NAV)),
        (3, "http://b.example/x", page("<div class='cookie-notice'>cookies</div><div id='content'><h2>Plain</h2><p>Body <b>bold</b> text.</p><form><p>Name</p><button>Go</button></form></div><div class='sidebar'>links</div>", "<header>site</header>")),
        (4, None, None),
        (5, "http://a.example/3", ""),
        (6, "http://b.example/y", page("<main><p>&eacute;&#233;&nbsp;x</p></main>", NAV)),
        (7, "not a url", "plain text only"),
        (8, "http://c.example/1", page("<table><tr><td>a<td>b</table>")),
    ]
    got = {r.page_id: r for r in html_extract.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & more\nOne two three\nFour <5"
    assert got[2].text == "Other\nText here."
    assert got[3].text == "Plain\nBody bold text."
    assert got[4].text == "" and got[4].n_chars == 0 and got[5].text == ""
    assert got[6].text == "éé x" and got[6].n_chars == 4
    assert got[7].text == "plain text only"
    assert got[8].text == "a\nb"
    assert html_extract.report(spark.createDataFrame(rows[:0], "page_id long, url string, html string")).count() == 0


# ---- decontamination ---------------------------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark, make_docs, monkeypatch):
    items = [(1, prose(50, 30)), (2, prose(51, 13)), (3, "alpha beta"), (4, None), (5, "!!"), (6, prose(50, 14)), (10, prose(52, 20)), (None, "gamma delta"), (None, "here gamma"), (None, "delta here"), (None, "delta here"), (3, "only gamma")]
    texts = {i: prose(60 + i, 60) for i in range(10)}
    texts |= {20: prose(1, 40) + " " + prose(50, 30) + " " + prose(2, 40), 21: prose(51, 13).upper().replace(" ", ", "), 22: None, 23: "", 24: "Alpha-Beta", 27: "only Gamma, delta here", 25: prose(52, 12), 26: prose(50, 30) + prose(3, 700)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontam.brute_force(texts, items)
    for size in (decontam.BLOCK_BYTES, 200):  # one block, and several
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        rows = decontam.report(make_docs(texts), bench).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in rows} == {k: (a, b, len(c)) for k, (a, b, c) in want.items()}
        assert {r.doc_id: r.items_sha256 for r in rows} == {k: decontam.sha(x for x in v[2] if x is not None) for k, v in want.items()}
        assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in rows)


    assert want[27] == (4, 4, ["3", None, None, None])


def test_longest_matches_have_their_item_place_and_length(spark, make_docs):
    one, two = prose(70, 13), prose(71, 40)
    bench = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    texts = {1: f"{one} {two} end", 2: "start " + " ".join(two.split()[5:35]) + " end"}
    found = decontam.matches(make_docs(texts), bench, ["doc_id"]).select("row.doc_id", "out.matches").collect()
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in found}
    assert got == {1: [("1", 0, 0, 13), ("2", 13, 0, 40)], 2: [("2", 1, 5, 30)]}
    assert {r.doc_id: (r.longest_item, r.longest_match) for r in decontam.report(make_docs(texts), bench).collect()} == {1: ("2", 40), 2: ("2", 30)}


def test_decontamination_edges(spark, edge_docs):
    bench = spark.createDataFrame([(1, prose(2, 20))], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontam.report(edge_docs, bench).collect()}[6]
    assert decontam.decontaminate(edge_docs, bench).count() == 8
    assert decontam.decontaminate(edge_docs, bench.limit(0)).count() == 10
    assert decontam.decontaminate(edge_docs, bench).columns == edge_docs.columns


# ---- quality -----------------------------------------------------------------------------------------------------------


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(len(re.findall(r"[#*$%&|<>]", w)) for w in words), dup, len(covered)


def test_quality_counts_and_verdicts(spark, make_docs):
    r = random.Random(3)
    texts, labels = {}, {}
    for i in range(500):
        junk = i % 5 == 0
        words = prose(i, 60 + i % 100).split()
        if junk:
            words = [w + r.choice(["%%%", "###", "$$$"]) for w in words]
        texts[i] = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
        labels[i] = int(not junk)
    texts |= {900: "a b c " * 60, 901: None, 902: "", 903: "é ü\n\né ü\n é ü", 904: prose(1, 49)}
    rows = {x.doc_id: x for x in quality.report(make_docs(texts), labelled(spark, labels, "quality")).collect()}
    for i, t in texts.items():
        x = rows[i]
        want = base_counts(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (x.base_failed and x.kept)
    good = [i for i in labels if labels[i] and not rows[i].base_failed]
    bad = [i for i in labels if not labels[i]]
    assert np.mean([rows[i].kept for i in good]) > 0.99 and np.mean([rows[i].kept for i in bad]) < 0.05


def test_forest_is_monotonic():
    r = np.random.default_rng(0)
    x = r.normal(size=(2_000, 3))
    y = ((x[:, 0] + np.sin(3 * x[:, 0]) + x[:, 1] + 0.3 * r.normal(size=2_000)) > 0).astype(float)
    f = quality.fit(x, y, [1, 0, -1])
    line = np.zeros((200, 3))
    line[:, 0] = np.linspace(-3, 3, 200)
    for other in r.normal(size=(20, 2)):
        line[:, 1:] = other
        assert (np.diff(f.score(line)) >= -1e-12).all()
    assert (((f.score(x) > 0.5) == y).mean()) > 0.85


def test_quality_edges(spark, edge_docs):
    none = labelled(spark, {4: None}, "quality")
    rows = quality.report(edge_docs, none).collect()
    assert len(rows) == 10 and not any(r.kept for r in rows if r.n_words < 50)
    assert quality.keep_good(edge_docs, none).columns == edge_docs.columns
    assert quality.report(edge_docs.limit(0), none).count() == 0


# ---- licences ----------------------------------------------------------------------------------------------------------


def test_license_places_and_labels(make_docs):
    texts = {
        1: "Released under the MIT License.", 2: "x Licensed under the Apache License, Version 2.0. y under the mit  license", 3: "Licensed under CC BY-NC 4.0.", 4: "This work is licensed under the GNU General Public License, version 3.",
        5: "All rights reserved.", 6: None, 7: "", 8: prose(1, 300), 9: "the mit of the license under apache", 10: "general public version of the gnu license",
    }
    rows = {r.doc_id: r for r in licenses.report(make_docs(texts)).collect()}
    for i, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert r.first_word == min((k for k, _ in places), default=None) and r.last_word == max((k for k, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert rows[4].labels == "gpl-3" and rows[5].labels == "all-rights-reserved" and rows[2].labels == "apache-2,mit"
    assert rows[8].labels == rows[9].labels == rows[10].labels == ""


SHORT_LICENSES = {
    "MIT License Copyright (c) 2020 X": "mit", "SPDX-License-Identifier: GPL-3.0": "gpl-3", "SPDX-License-Identifier: GPL-3.0+": "gpl-3", "GPLv3": "gpl-3", "GNU GPL v2": "gpl-2", "licensed under the BSD license": "bsd",
    "License: Apache 2.0": "apache-2", "Creative Commons Zero v1.0 Universal": "cc0", "SPDX-License-Identifier: BSD-4-Clause": "bsd", "Artistic License 2.0": "artistic-2", "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2,mit",
    "SPDX-License-Identifier: LGPL-2.1-or-later\nint mit = 1;": "lgpl", "The MIT License (MIT)": "mit", "SPDX-License-Identifier: CC-BY-NC-4.0": "cc-by-nc", "SPDX License Identifiers are short": "",
    "The GNU General Public License is a free, copyleft license for software and other kinds of works.": "gpl-3", "he licensed the song to a label in 2020, and the artist was free to leave": "",
}


def test_short_forms_of_licenses(make_docs):
    texts = {i: prose(i, 30) + ". " + t + ". " + prose(100 + i, 30) for i, t in enumerate(SHORT_LICENSES)}
    rows = {r.doc_id: r.labels for r in licenses.report(make_docs(texts)).collect()}
    assert {t: rows[i] for i, t in enumerate(SHORT_LICENSES)} == SHORT_LICENSES


def test_license_edges(edge_docs):
    assert licenses.report(edge_docs).count() == 10
    assert licenses.report(edge_docs.limit(0)).count() == 0


# ---- very long texts full of findings ----------------------------------------------------------------------------------


def test_a_million_words_take_seconds():
    began = time.monotonic()
    lexicon = toxicity.Lexicon({"darn": 3.0, "heck*": 2.0}, ["what the heck"])
    n, weight, hits, top = lexicon.measure(("darn what the heck heckish fine " * 170_000).encode())
    assert (n, hits, top) == (1_020_000, 2, 3.0)
    text = "password = abcdef123 x1y2z3a4b5c6d7e8 " * 100_000
    taken = secrets.base_spans(text)
    assert len(taken) == 100_000 and len(secrets.candidates(text, taken)) == 100_000
    assert time.monotonic() - began < 60
