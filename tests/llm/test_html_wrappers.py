"""Wrappers of hosts: the regular expression accepts every page it was inferred from, and nothing of a page is lost."""

import random
import re

from codecorpus.llm import html_extract as H

COLUMNS = "page_id long, url string, html string"


def pattern(wrapper, letters):
    out = ""
    for flag, body in wrapper:
        inner = re.escape(letters.setdefault(body, chr(0xE000 + len(letters)))) if isinstance(body, str) else pattern(body, letters)
        out += f"(?:{inner})" + {"1": "", "?": "?", "+": "+", "*": "*"}[flag]
    return out


def test_wrapper_accepts_every_stream_of_a_small_host():
    for seed in range(300):
        r = random.Random(seed)
        streams = [[r.choice("abcd") for _ in range(r.randrange(0, 9))] for _ in range(r.randrange(1, 6))]
        streams += [s + r.choice([[], ["b", "c"] * 2, ["d"] * 3]) for s in streams[:2]]
        parts = [H.wrapper_of([H.folded(s) for s in half]) for half in (streams[::2], streams[1::2])]
        for wrapper in (H.wrapper_of([H.folded(s) for s in streams]), H.align(*parts)):
            assert H._unpacked(H._packed(wrapper)) == wrapper
            letters: dict = {}
            accepts = re.compile(pattern(wrapper, letters))
            for s in streams:
                assert accepts.fullmatch("".join(letters[x] for x in s)), (wrapper, s)


def test_groups_and_optional_slots():
    assert H.folded(list("npqpqpqf")) == [("1", "n"), ("+", (("1", "p"), ("1", "q"))), ("1", "f")]
    assert H.folded(list("hppp")) == [("1", "h"), ("+", "p")]
    assert H.align(H.folded(list("hpf")), H.folded(list("hxppf"))) == [("1", "h"), ("?", "x"), ("+", "p"), ("1", "f")]


def test_a_rare_structure_of_a_large_host_is_kept(spark):
    rows = [(i, f"http://h.example/{i}", f"<article><h1>t</h1><p>base</p><x{i // 2}><p>{i}</p></x{i // 2}></article>") for i in range(400)]
    rows.append((999, "http://h.example/q", "<article><h1>t</h1><p>base</p><blockquote><p>quote</p></blockquote></article>"))
    pages = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = {r.page_id: r.text for r in H.report(pages).collect()}
    assert got[999] == "t\nbase\nquote" and got[399] == "t\nbase\n399" and len(got) == 401
    assert H.wrappers(pages).count() == 1


def test_head_without_end_and_parts_of_articles(spark):
    page = (
        "<html><head><title>x</title><meta charset=utf8><body><div class='nav'>n</div><article><div class='section-header'><h1>Title</h1></div>"
        "<p class='related'>Kept</p><div class='related-links'>no</div><p class='notice'>no</p><p>t</p><div class='comments'><p>no</p></div></article>"
    )
    assert [r.text for r in H.report(spark.createDataFrame([(1, "http://k.example", page)], COLUMNS)).collect()] == ["Title\nKept\nt"]


def test_template_texts_and_menus_without_an_article(spark):
    page = "<div>Subscribe now</div><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><div>Body {0} text</div><div>more <a>link {0}</a></div><div>All mine</div>"
    rows = [(i, "http://l.example", page.format(i)) for i in range(5)]
    rows += [(10 + i, "http://m.example", "<div>the same page</div>") for i in range(5)]
    got = {r.page_id: r.text for r in H.report(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got[3] == "Body 3 text\nmore link 3" and got[11] == "the same page"


def test_edges(spark):
    long = "<article>" + "".join(f"<p>part {i}</p>" for i in range(50_000)) + "</article>"
    rows = [(1, "http://a.example", long, "x", 1, "n"), (2, None, None, "y", 2, "n"), (2, None, None, "y", 2, "n"), (None, "http://a.example", "<p>a</p>", None, None, None), (3, "", "", "", 3, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, host string")
    got = H.report(pages).collect()
    assert len(got) == 5 and sorted((r.page_id or 0, r.n_chars) for r in got)[:2] == [(0, 1), (1, len(long) - 9 - 10 - 50_000 * 7 + 49_999)]
    assert [r.text for r in got if r.page_id == 2] == ["", ""]
    assert H.report(pages.limit(0)).count() == 0
