"""Main text, archives, languages and licences."""

import hashlib
import math
import random
import re
import textwrap
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayfarer.llm import html_text, language_id, licenses, warc

ARTICLE = "<article><h1>A head</h1><p>One sentence, and more of it. Another one.<br><p>Second   block &amp; more, of course.</p><p>Short.</article>"
TEXT = "A head\n\nOne sentence, and more of it. Another one.\n\nSecond block & more, of course.\n\nShort."
AROUND = (
    "<!DOCTYPE html><html lang='en'><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<header><h2>Site</h2></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- <p>no</p> --><div class='ad'>Buy, buy, buy.</div>"
    "{}<aside>Elsewhere, too.</aside><div class='cookie-notice'>We use cookies. Agree, please.</div><form><p>Your name, please:</p><input></form>"
    "<section id='comments'><p>Nice, very nice. I like it, really.</p></section><footer>&copy; us, 2024.</footer></body></html>"
)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain words, only", "plain words, only"),
        (AROUND.format(ARTICLE), TEXT),
        (AROUND.format(ARTICLE.replace("article", "main")), TEXT),
        (AROUND.format(ARTICLE.replace("<article>", "<div class='post-body has-sidebar'>").replace("</article>", "</div>")), TEXT),
        ("<article><p>a &lt; b and c < d, e.</p><p>x<b>y</b>z</p><pre>one\n two</pre><blockquote>said, so</blockquote><div class='comments'><p>no, no.</p></div></article>", "a < b and c < d, e.\n\nxyz\n\none two\n\nsaid, so"),
        ("<body><div><a href=1>One</a> <a href=2>Two words</a></div><h1>Head</h1><div><p>Long text, with commas, and such. It goes on.</p><p>Hm.</p></div>", "Long text, with commas, and such. It goes on.\n\nHm."),
        ("<article><p>unclosed <a href='x' title=\"a > b\">link, text</a> on", "unclosed link, text on"),
        ("<article><p>text, here</p><script>if (a < b) document.write('<p>no</p>')", "text, here"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


LONG = "<p>One sentence here, with commas, and more of it. Another one follows, at some length.</p>" * 4


def test_paths_below_the_threshold_go():
    page = f"<body><nav>Home</nav><div class=a>{LONG}<h2>Head</h2><div>Subscribe now</div><p>Short.</p><div class=x>Click here to win</div><ul><li>item</ul></div></body>"
    text = html_text.main_text(page)
    assert "Subscribe" not in text and "Click" not in text and text.endswith("Head\n\nShort.\n\nitem") and text.count("One sentence") == 4


@pytest.mark.parametrize("names", ["class='search-engine-history'", "class='content-with-sidebar'", "id=newsletter"])
def test_names_alone_decide_nothing(names):
    text = html_text.main_text(f"<body><div class=banner>Ad, ad.</div><div {names}>{LONG}</div><div class='comments'><p>Nice, very nice, and so on, and on.</p>{LONG * 3}</div></body>")
    assert text.count("One sentence") == 4 and "Nice" not in text and "Ad" not in text


def test_deep_nesting_takes_linear_time():
    took = []
    for n in (2000, 32_000):
        began = time.process_time()
        assert html_text.main_text("<div>some text, here. " * n + "</b>" * n).count("some text") >= 0.8 * n
        took.append(time.process_time() - began)
    assert took[1] < 64 * took[0]


def random_page(rng):
    """A page and its article's blocks."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join(word() + rng.choice(["", "", "", ","]) for _ in range(rng.randint(6, 18))) + "."
    blocks = [("h1", " ".join(word() for _ in range(4)))]
    for _ in range(rng.randint(4, 15)):
        blocks.append(rng.choice([("p", " ".join(sentence() for _ in range(rng.randint(1, 5))))] * 6 + [("h2", word()), ("li", sentence()), ("p", word() + "."), ("blockquote", sentence())]))
    inner = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>{word()}</a></li>" for i in range(rng.randint(3, 9))) + "</ul>"
    noise = [f"<nav>{menu}</nav>", f"<div class='{word()}'>{menu}</div>", f"<div class='ad-box'><p>{sentence()}</p></div>", f"<aside><p>{sentence()}</p></aside>", f"<form><label>{word()}</label></form>", f"<div id='cookie-bar'>{sentence()}</div>"]
    rng.shuffle(noise)
    wrap = rng.choice(["<article>{}</article>", "<main><div class='post'>{}</div></main>", "<div class='{}'>{{}}</div>".format(word()), "<div id=x><section>{}</section></div>"])
    page = f"<html><head><title>{word()}</title></head><body><header><p>{sentence()}</p></header>{''.join(noise[:3])}{wrap.format(inner)}{''.join(noise[3:])}<section class='comments'><p>{sentence()}</p></section><footer>{sentence()}</footer></body></html>"
    return page, [x for _, x in blocks]


def test_random_pages_against_their_articles():
    rng, right, found, wanted = random.Random(17), 0, 0, 0
    for _ in range(300):
        page, blocks = random_page(rng)
        got, want = Counter(html_text.main_text(page).split("\n\n")), Counter(blocks)
        right, found, wanted = right + sum((got & want).values()), found + sum(got.values()), wanted + sum(want.values())
    assert right >= 0.98 * wanted and right >= 0.98 * found, (right, found, wanted)


def test_articles_of_links_alone():
    assert html_text.main_text("<main><ul><li><a href=x>One</a></li></ul></main>") == ""
    assert html_text.main_text("<article><p><a href=x>All of it, linked.</a></p></article>") == "All of it, linked."


def test_long_pages_are_read_whole():
    page = "<article>" + "".join(f"<p>Paragraph {i}, with text.</p>" for i in range(20_000)) + "</article>"
    assert html_text.main_text(page).count("\n\n") == 19_999


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_extract_keeps_other_columns(spark):
    found = html_text.extract(pages(spark, [(1, "u", ARTICLE), (None, None, None)]))
    assert found.columns == ["page_id", "url", "digest", "main_text"]
    assert {r.main_text for r in found.collect()} == {TEXT, ""}
    assert not html_text.extract(pages(spark, [])).collect()


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(8)
    odd = ["", "\r\n\r\n", "\r\n\r\n" * 40, "x\r\r\n\r\n\n" * 30, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5, "é" * 60, "é" * 49, "a" * 99, "b" * 100, None]
    rows = [(i, f"http://h/{i}", rng.choice(odd)) for i in range(120)] + [(7, "http://h/7", "b" * 100), (None, "bad\r\nX-Page-Id: 5", "b" * 100), (500, None, "last\r\n\r\n")]
    path = str(tmp_path / "warc")
    warc.write_archives(pages(spark, rows).repartition(3), path)
    back = warc.read_archives(spark, path).collect()
    assert len(back) == len(rows)
    first = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 100:
            key = html
            first[key] = i if key not in first else min(first[key], i, key=lambda x: (x is None, x or 0))
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        original = first.get(html, i) if len(data) >= 100 else i
        want[i, len(data), hashlib.sha256(data).hexdigest(), "response" if original == i else "revisit", None if original == i else original] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == want
    texts = {i: html or "" for i, _, html in rows if i is not None and i != 7}
    assert all(r.payload == texts[r.page_id] for r in back if r.record_type == "response" and r.page_id in texts)


def test_payloads_that_end_in_line_breaks(spark, tmp_path):
    ends = ["\r\n", "\r\n\r\n\r\n", "\n", "\r", "\r\n\r", "\n\r\n", "\r\n\r\n\r\n\r\n\r\n", "\r\n\r\n", ""]
    for k in range(len(ends)):  # each of them is the last of a file once
        rows = [(i, f"http://h/{i}", body + e) for i, (e, body) in enumerate((e, b) for b in ("", "abc", "é" * 60) for e in ends[k:] + ends[:k])]
        path = str(tmp_path / f"warc{k}")
        warc.write_archives(pages(spark, rows).coalesce(1), path)
        assert {r.page_id: r.payload for r in warc.read_archives(spark, path).collect()} == {i: html for i, _, html in rows}


def test_empty_archives(spark, tmp_path):
    warc.write_archives(pages(spark, []), str(tmp_path / "none"))
    assert not warc.read_archives(spark, str(tmp_path / "none")).collect()


SYLLABLES = {"en": "the tion ing and er of to", "fr": "eau oi que é ment les ou", "de": "ung sch ein ü ver ich keit"}


def sentences(rng, language, n):
    return " ".join("".join(rng.choice(SYLLABLES[language].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_of_held_out_texts(spark, make_docs):
    rng = random.Random(9)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(900)]
    rows = [(i, sentences(rng, x, rng.randint(3, 60)), f"s{x}{i % 3}", x) for i, x in enumerate(langs)]
    model = language_id.fit(make_docs(rows[:300]))
    found = {r.doc_id: r for r in language_id.identify(make_docs(rows[300:]), model, host="source").collect()}
    assert sum(found[d].lang == x for d, _, _, x in rows[300:]) >= 0.99 * 600


def test_rare_languages_are_fitted(spark, make_docs):
    rng = random.Random(15)
    rows = [(i, sentences(rng, "en", 8), "a", "en") for i in range(12_000)] + [(20_000, sentences(rng, "de", 60), "a", "de"), (None, "один два три четыре пять шесть семь", "a", "ru")]
    docs = make_docs(rows, extra=False)
    assert language_id.fit(docs).languages == ["de", "en", "ru"]
    assert {20_000, None} <= {r.doc_id for r in language_id.drop_unknown(docs).collect()}


def test_other_evidence_decides_where_text_does_not(spark):
    rng = random.Random(10)
    model = language_id.TextModel.fit([(x, sentences(rng, x, 400)) for x in SYLLABLES])
    rows = []
    for i in range(300):
        x = list(SYLLABLES)[i % 3]
        rows.append((i, f"https://{x}{i % 7}.example.{'com' if x == 'en' else x}/{x}/p{i}", f"<html lang='{x}'><p>{sentences(rng, x, 60)}</p>"))
    rows += [(1000, "https://fr1.example.fr/fr/x", "<html lang='fr'><p>zz</p>"), (1001, "https://de1.example.de/de/x", "<html lang=\"de-AT\"><p>zz</p>"), (1002, None, None), (1003, "nonsense", "<p>1234 --</p>")]
    found = {r.page_id: r for r in language_id.identify_pages(pages(spark, rows), model).collect()}
    assert found[1000].lang == "fr" and found[1001].lang == "de"
    assert found[1002].lang == found[1003].lang == "und"
    assert sum(found[i].lang == list(SYLLABLES)[i % 3] for i in range(300)) == 300


def naive_likelihoods(labelled, texts, languages):
    """Whether each text is known, and its log likelihoods, by one trigram after the other."""

    def slots(text):
        words = re.findall(rb"[a-z\x80-\xff]+", "".join(c.lower() if c.isascii() else c for c in text).encode())
        joined = b" " + b" ".join(words) + b" "
        return [(((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (c * 0xC2B2AE3D)) & 0xFFFFFFFF) >> 16 for a, b, c in zip(joined, joined[1:], joined[2:])] if words else []

    counts = {x: Counter(s for language, text in labelled if language == x for s in slots(text)) for x in languages}
    seen = set().union(*counts.values())
    for text in texts:
        held = slots(text)
        logs = [sum(math.log((counts[x][s] + 0.5) / (counts[x].total() + 0.5 * 65536)) for s in held) / 3 for x in languages]
        yield len(held) > 0 and (len(held) < 12 or sum(s in seen for s in held) >= len(held) / 2), logs


def naive_fusion(rows, likelihoods, languages):
    """Language and probability of rows (host, domain, declared, suffix), None where there is no evidence."""
    k, text = len(languages), []
    for known, logs in likelihoods:
        ex = [math.exp(x - max(logs)) for x in logs]
        text.append([x / sum(ex) if known else 0.0 for x in ex])
    overall = [sum(p[j] for p in text) for j in range(k)]
    flat = [(x + 1) / (sum(overall) + k) for x in overall]
    for i, (row, (known, logs)) in enumerate(zip(rows, likelihoods, strict=True)):
        others = lambda at: [sum(p[j] for n, p in enumerate(text) if n != i and row[at] is not None and rows[n][at] == row[at]) for j in range(k)]  # noqa: E731, B023
        prior = flat
        for at, smooth in ((1, 50), (0, 20)):
            sums = others(at)
            prior = [(s + smooth * c) / (sum(sums) + smooth) for s, c in zip(sums, prior, strict=True)]
        post = [x + math.log(c) for x, c in zip(logs, prior, strict=True)]
        for at in (2, 3):
            sums = others(at)
            post = [x + math.log((s + 20 * f) / (f * (sum(sums) + 20))) for x, s, f in zip(post, sums, flat, strict=True)]
        yield (languages[post.index(max(post))], 1 / sum(math.exp(x - max(post)) for x in post)) if known else ("und", 0.0)


def test_fusion_is_recomputed(spark):
    rng = random.Random(21)
    languages = sorted(SYLLABLES)
    labelled = [(x, sentences(rng, x, 60)) for x in SYLLABLES for _ in range(3)]
    rows, texts = [], []
    for i in range(240):
        x = rng.choice(languages)
        texts.append(rng.choice(["", "zz", "один два три четыре", sentences(rng, x, rng.randint(1, 3)), sentences(rng, x, 2).upper()]))
        domain = rng.choice([f"{x}.org", "mixed.org"])
        rows.append(tuple(v if rng.random() < 0.8 else None for v in (f"h{i % 5}.{domain}", domain, x if rng.random() < 0.8 else "fr", f"org/{x}")))
    frame = spark.createDataFrame([(i, t, *r) for i, (t, r) in enumerate(zip(texts, rows, strict=True))], "doc_id long, text string, host string, domain string, declared string, suffix string")
    found = language_id.identify(frame.repartition(3), language_id.TextModel.fit(labelled), host="host", domain="domain", declared="declared", suffix="suffix").collect()
    want = list(naive_fusion(rows, list(naive_likelihoods(labelled, texts, languages)), languages))
    assert len(found) == 240
    for r in found:
        assert r.probability == pytest.approx(want[r.doc_id][1], rel=1e-3) and r.lang == want[r.doc_id][0]


def test_evidence_columns(spark):
    rows = spark.createDataFrame([("https://www.example.co.uk/en/7?x#y", "<!doctype html>\n<HTML class=a LANG=en-GB>"), ("//Host.de:80/a", "<html xml:lang='fr'>"), (None, None), ("mailto:x", "<p lang=de>")], "url string, html string")
    got = [tuple(r) for r in rows.select(language_id.host_of(F.col("url")), language_id.domain_of(language_id.host_of(F.col("url"))), language_id.suffix_of(F.col("url")), language_id.declared_in(F.col("html"))).collect()]
    assert got == [("www.example.co.uk", "co.uk", "uk/en", "en"), ("host.de", "host.de", "de", "fr"), (None, None, None, None), (None, None, None, None)]


def test_unknown_languages_go(odd_docs, no_docs, make_docs):
    left = language_id.drop_unknown(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 2, 2, 6, 6, 7, 8, 9, 10]
    assert not language_id.drop_unknown(no_docs).collect()
    strange = [(i, " ".join(["the ing tion and er"] * 9), "a", "en") for i in range(30)] + [(99, "один два три четыре пять шесть семь", "a", None)]
    assert 99 not in {r.doc_id for r in language_id.drop_unknown(make_docs(strange)).collect()}


def terms(text):
    return Counter(re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", text.lower()))


def cosine_by_hand(unit, texts):
    """(licence, cosine) of a unit, from the templates and the files' texts alone."""
    total, held = len(texts), Counter(w for t in texts for w in terms(t or ""))
    vocabulary = {w for ts in licenses.TEMPLATES.values() for t in ts for w in terms(t)}
    vector = lambda t: {w: (1 + math.log(n)) * (math.log((total + 1) / ((held[w] if w in vocabulary else 0) + 1)) + 1) for w, n in terms(t).items()}
    a, best = vector(unit), (0, None)
    for name, statements in licenses.TEMPLATES.items():
        for b in map(vector, statements):
            norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            best = min(best, (-round(sum(a.get(w, 0) * x for w, x in b.items()) / norm, 9) if norm else 0, name), key=lambda x: (x[0], x[1] or ""))
    return (best[1], -best[0]) if -best[0] >= licenses.THRESHOLD else None


FILES = [
    ("repo/LICENSE", "MIT License\n\nReleased under the MIT License."),
    ("repo/a/b/code.py", "# nothing of that kind\nprint(1)"),
    ("repo/a/x.py", "# Licensed under the Apache License, Version 2.0.\nimport os"),
    ("repo/a/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("repo/c/d.txt", None),
    ("other/e.txt", "the license of this is the general public one under terms"),
    ("top.txt", "Licensed under CC BY-NC 4.0. And so on. This work is licensed under CC BY 4.0."),
    (None, "Released under the MIT License."),
    (None, None),
    ("repo/a/x.py", "# Licensed under the Apache License, Version 2.0.\nimport os"),
]


def test_licences(spark):
    files = spark.createDataFrame([(*f, "x", "y") for f in FILES], "path string, text string, cosine string, depth string")
    found = licenses.scan(files)
    assert set(found.columns) == {"path", "depth", "own_licence", "cosine", "licence", "licence_from"}
    rows = found.collect()
    assert len(rows) == len(FILES)
    texts = [t for _, t in FILES]
    assert licenses.frequencies(files, "text")[0] == len(FILES)
    by_path = {(r.path, r.own_licence): r for r in rows}
    for path, text in FILES:
        whole = [text] if text and path and path.rpartition("/")[2] in ("LICENSE", "COPYING") else []
        hits = [h for s in re.split(r"[\n\r]+|(?<=[.!?])[ \t]+", text or "") + whole + (text or "").split("\n\n") if (h := cosine_by_hand(s, texts))]
        best = min(((-c, n) for n, c in hits), default=(None, None))
        r = by_path[path, best[1]]
        assert (r.cosine is None) == (best[0] is None) and (best[0] is None or math.isclose(r.cosine, -best[0]))
    got = {r.path: (r.licence, r.licence_from) for r in rows if r.path}
    assert got["repo/a/b/code.py"] == ("GPL-3.0", "repo/a") and got["repo/c/d.txt"] == ("MIT", "repo")
    assert got["repo/a/x.py"] == ("Apache-2.0", None) and got["other/e.txt"] == (None, None)
    assert not licenses.scan(files.limit(0)).collect()


def wrapped(text, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(text, 72))


def test_licence_texts(spark):
    full = {name: max(texts, key=len) for name, texts in licenses.TEMPLATES.items()}
    gpl = licenses.TEMPLATES["GPL-3.0"]
    notice = licenses.TEMPLATES["Apache-2.0"][4:6]
    mit = full["MIT"].replace("The above copyright", "\n\nThe above copyright").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS", 1)
    files = {
        "mit/LICENSE": ("MIT", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + "\n\n".join(wrapped(x) for x in mit.split("\n\n"))),
        "bsd2/LICENSE.txt": ("BSD-2-Clause", "Copyright (c) 2019, Any One\nAll rights reserved.\n\n" + wrapped(full["BSD-2-Clause"])),
        "bsd3/licence.md": ("BSD-3-Clause", "Copyright 2019 Any One\n\n" + wrapped(full["BSD-3-Clause"])),
        "isc/COPYING": ("ISC", wrapped(full["ISC"])),
        "gpl/COPYING": ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n\n                            Preamble\n\n" + "\n\n".join(wrapped(x, "  ") for x in gpl[4:])),
        "apache/LICENSE": ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n\n   1. Definitions.\n\n" + wrapped(licenses.TEMPLATES["Apache-2.0"][6], "      ")),
        "a/x.py": ("Apache-2.0", "\n#\n".join(wrapped(x, "# ") for x in ["Copyright 2020 Any One", *notice]) + "\nimport os\n"),
        "a/x.c": ("GPL-2.0", "/*\n" + wrapped(licenses.TEMPLATES["GPL-2.0"][3], " * ") + "\n */\nint main;\n"),
        "a/x.js": ("MPL-2.0", wrapped(licenses.TEMPLATES["MPL-2.0"][1], "// ") + "\nvar x;\n"),
        "none/story.txt": (None, "The software was provided to any person without warranty. " * 40),
        "mit/src/y.rs": (None, "fn main() {}"),
        "long/z.txt": (None, "a story of some length goes on and on " * 30_000),
    }
    rows = [(path, text) for path, (_, text) in files.items()] + [("mit/LICENSE", files["mit/LICENSE"][1])]
    found = licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    assert len(found) == len(rows)
    assert {r.path: r.own_licence for r in found} == {path: name for path, (name, _) in files.items()}
    assert {(r.licence, r.licence_from) for r in found if r.path == "mit/src/y.rs"} == {("MIT", "mit")}


def test_anchors_lose_no_match(spark):
    counts = {w: 3 for _, s in licenses._statements() for w in s}
    _, _, vectors = licenses._vectors(1000, counts)
    anchors = set(licenses.anchors(vectors, licenses.THRESHOLD))
    for _, v in vectors:
        assert sum(x * x for w, x in v.items() if w not in anchors) < licenses.THRESHOLD**2


def test_archives_of_text_keys(spark, tmp_path):
    long = "<p>" + "word " * 60_000 + "</p>"
    rows = [("b\r\nX: 1", "u1", long), ("a%0D", "u2", long), ("", "u3", long), (None, "u4", long), ("é: x", "u5", "short"), ("2024-01", None, None)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    found = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w"), key_type="string").collect()}
    assert set(found) == {r[0] for r in rows}
    assert found[""].record_type == "response" and found[""].payload == long  # the least key
    assert all(found[k].record_type == "revisit" and found[k].refers_to == "" and found[k].payload_bytes == len(long) for k in ("b\r\nX: 1", "a%0D", None))


PARAGRAPH = "<p>" + "This is a long paragraph, with words and commas, that says something of interest. " * 3 + "</p>"


def article(part):
    return f"<html><body><nav><a>Home</a></nav><article><h1>Title</h1>{PARAGRAPH * 4}{part}{PARAGRAPH}</article><footer>foot</footer></body></html>"


@pytest.mark.parametrize(
    ("part", "kept", "gone"),
    [
        ("<section id='related-work'><h2>Related work</h2><p>Others did this before.</p></section>", ["Related work", "Others did this"], []),
        ("<div class='social-history'><p>The history of society, in short.</p></div>", ["The history of society"], []),
        ("<section>Plain section text.</section>", ["Plain section text."], []),
        ("<h2>References</h2><ul><li><a href=x>Smith 2001, On things</a></li><li><a href=y>Jones 2002</a></li></ul>", ["References", "Smith 2001", "Jones 2002"], []),
        ("<ul><li><a href=x>Another post</a></li><li><a href=y>One more</a></li></ul>", [], ["Another post", "One more"]),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be so.</p>", ["Let x=2 be so."], []),
        ("<aside class=pullquote>A quote to pull.</aside><aside>Not this.</aside>", ["A quote to pull."], ["Not this"]),
        ("<p>Accept all cookies</p><div><p>Subscribe now</p></div><p>Subscribe now, they said, and nobody did.</p>", ["they said"], ["Accept all", "Subscribe now\n"]),
        ("<section><h3>Reader responses</h3><p>Great post!</p><p>I agree.</p></section>", [], ["Great post", "Reader responses"]),
        ("<section><h3>12 comments</h3><p>Great post!</p></section><section><h3>Comments on the text</h3><p>By the editor.</p></section>", ["By the editor."], ["Great post"]),
        ("<div class=related-posts><p>Another post, with a teaser.</p></div><div id=cookie-notice><p>We use cookies.</p></div>", [], ["Another post", "We use"]),
    ],
)
def test_parts_of_articles(part, kept, gone):
    text = html_text.main_text(article(part))
    assert all(x in text for x in kept) and not any(x in text for x in gone), text[-400:]
    assert text.startswith("Title\n\nThis is") and "Home" not in text and "foot" not in text


def test_an_article_in_two_elements():
    page = f"<html><body><div id=page><div class=x>{PARAGRAPH * 12}</div><div class=y><p>The ending, which is told here, is in another element, and it is long enough.</p></div></div><div class=z><a>Imprint</a> <a>Contact, and more of it, at this address of ours for all to see</a></div></body></html>"
    text = html_text.main_text(page)
    assert "The ending" in text and "Imprint" not in text and "Contact" not in text


@pytest.mark.parametrize("tag", ["noscript", "iframe", "svg", "template"])
def test_raw_tags_that_do_not_end(tag):
    import time

    began = time.perf_counter()
    assert "long paragraph" in html_text.main_text(f"<html><body>{PARAGRAPH}" + f"<{tag}>" * 60_000)
    assert time.perf_counter() - began < 5
