import collections
import hashlib
import io
import random
import re
import time
from html.parser import HTMLParser

import brute as plain
import pytest

from pactum.llm import html_text, warc
from pactum.llm.html_text import render
from pactum.llm.store import Files

FIXTURE = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


class Plain(HTMLParser):
    """Visible words of simple pages, without any layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head", "noscript", "template")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head", "noscript", "template")

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_all_visible_words_of_the_table(spark):
    pages = spark.read.parquet(f"{FIXTURE}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        # Words at block borders may join in the plain version, so characters are compared.
        bullets = re.sub(r"(?m)^\s*(?:- |\d+\. )", "", got[r.page_id])
        assert collections.Counter("".join(bullets.split())) == collections.Counter("".join("".join(plain.words).split())), r.page_id


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>a<p>b", "a\n\nb"),
        ("a <b> b </b> c<br>d", "a b c\nd"),
        ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>z", "- x\n- y\n  3. q\n  4. r\n\nz"),
        ("<table><tr><th>Name<th>Qty<tr><td>Apple<td>3</table>", "Name   Qty\nApple  3"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<div hidden>no</div><div style='visibility:hidden'>n<b style='visibility:visible'>yes</b></div>", "yes"),
        ("<details>gone<summary>Sum</summary><p>no</details>", "Sum"),
        ("<script>if (a<b) '</p>'</script><title>t</title>x<!-- c -->y", "xy"),
        ("<pre> k\n  l</pre>", " k\n  l"),
        ("</p></div>a &amp; b &lt;c> <", "a & b <c> <"),
        ("<a title='x>y'>z</a><a b=\"unclosed>w", "zw"),
        ("<!-->visible", "visible"),
        ("<!--->a<!-- b --!>c", "ac"),
        ("<table><tr><td>a</td></tr>Stray</table>", "Stray\na"),  # text in a table belongs before it
        ("<svg><title>t</title><g>x<text>label <tspan>one</tspan></text></g></svg><math><mi>x</mi><mo>=</mo><annotation>no</annotation></math>", "label onex="),
        ("<div hidden><svg><text>no</text></svg></div><div style='visibility:hidden'><svg><text>no</text></svg></div>a", "a"),
        ("<select><option>a<option selected>b<optgroup><option>c</select>d", "b\nd"),
        ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("<ol start=12345><li>a<li value=-7>b<li>c</ol>", "12345. a\n-7. b\n-6. c"),
        ("<ol start=99999999999999999999><li>a</ol>", "2147483647. a"),
        ("<table><tr><td colspan=100000>a<td>b<tr><td rowspan=0>c<td>d<tr><td>e</table>", "a     b\nc  d\n   e"),
    ],
)
def test_layout(page, text):
    assert render(page) == text


def random_page(rnd, depth=0):
    """(tag, children) and texts, and the same as HTML."""
    nodes, out = [], []
    for _ in range(rnd.randrange(1, 4)):
        kind = rnd.choice(["text", "text", "div", "p", "b", "ul", "ol", "table"] if depth < 3 else ["text"])
        words = " ".join(rnd.choice(["ab", "c", "def", "gh i"]) for _ in range(rnd.randrange(1, 4)))
        if kind == "text":
            nodes.append(words + " ")
            out.append(words + " ")
        elif kind == "b":
            nodes.append(("b", [words]))
            out.append(f"<b>{words}</b>")
        elif kind == "table":
            rows = [[rnd.choice(["x", "yy y", "zzz"]) for _ in range(2)] for _ in range(rnd.randrange(1, 4))]
            nodes.append(("table", rows))
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in rows) + "</table>")
        elif kind in ("ul", "ol"):
            items = [rnd.choice(["one", "two b", "three"]) for _ in range(rnd.randrange(1, 4))]
            nodes.append((kind, items))
            out.append(f"<{kind}>" + "".join(f"<li>{x}" for x in items) + f"</{kind}>")
        else:
            inner = [words] if kind == "p" else None
            text = words
            if inner is None:
                inner, text = random_page(rnd, depth + 1)
            nodes.append((kind, inner))
            out.append(f"<{kind}>{text}</{kind}>")
    return nodes, "".join(out)


def test_layout_equals_a_plain_renderer():
    rnd = random.Random(8)
    for _ in range(400):
        nodes, text = random_page(rnd)
        assert render(text) == "\n".join(plain.page(("page", nodes))), text


def test_deep_and_long_pages():
    assert render("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert render("<p>a b" * 50_000).count("a b") == 50_000


@pytest.mark.parametrize("page", ["<b>" * 60_000 + "<p>x" * 60_000, "<div>" * 60_000 + "x</span>" * 60_000, "<table><tr><td>" + "<b>" * 60_000 + "<p>x</p>" * 60_000, "<li><ul>" + "<div>" * 60_000 + "<li>x</li>" * 60_000, "<i>x</i>" * 120_000, "<ul><li>x" * 20_000])
def test_time_grows_with_the_page(page):
    began = time.process_time()
    assert render(page).count("x") == page.count("x")
    assert time.process_time() - began < 20


def test_extract_edges(spark):
    rows = spark.createDataFrame([(1, None, None), (1, "u", ""), (2, "u", "<p>a")], PAGES)
    assert sorted((r.page_id, r.text, r.n_lines) for r in html_text.extract(rows).collect()) == [(1, "", 0), (1, "", 0), (2, "a", 1)]
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def brute(rows):
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 100 and first[h or ""] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    return sorted(out)


def key(rows):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)


def test_warc_on_rows(spark):
    rows = [(k, f"http://h/{k % 7} ü\r\nX: y", "<p>" + "é" * (40 + k % 5 * 10)) for k in range(200)] + [(500, None, None), (501, "", ""), (-3, "u", "x" * 3_000_000), (502, "u", "x" * 3_000_000)]
    assert key(warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()) == brute(rows)


def test_warc_on_the_table(spark):
    pages = spark.read.parquet(f"{FIXTURE}/pages.parquet")
    assert key(warc.round_trip(pages).collect()) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_warc_is_deterministic_and_rolls(spark, tmp_path):
    rows = [(k, "http://h/", f"<p>{k}" * 50) for k in range(60)]
    made = []
    for name, order in (("a", rows), ("b", rows[::-1])):
        folder = f"file://{tmp_path}/{name}"
        manifest = warc.write(spark.createDataFrame(order, PAGES).repartition(3), folder, files=2, roll_bytes=4000)
        made.append([(f["name"], (tmp_path / name / f["name"]).read_bytes()) for f in manifest])
    assert made[0] == made[1] and len(made[0]) > 2
    ids = []
    for name, _ in made[0]:
        with Files(f"file://{tmp_path}/a").read(name) as f:
            ids += [int(h["X-Page-Id"]) for h, _ in warc.records(f)]
    assert ids == list(range(60))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(made[0][0][1][:-30])))


def test_columns_with_clashing_names(spark):
    page = "<p>" + "y" * 120
    rows = spark.createDataFrame([(1, "u", page, "t", 5, b"d", b"p"), (2, "u", page, None, 6, None, None)], PAGES + ", text string, n_lines long, digest binary, payload binary")
    assert sorted((r.page_id, r.text, r.n_lines) for r in html_text.extract(rows).collect()) == [(1, "y" * 120, 1), (2, "y" * 120, 1)]
    assert key(warc.round_trip(rows).collect()) == brute([(1, "u", page), (2, "u", page)])


def test_repeated_rows_have_record_ids_of_their_own(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "z" * 200)] * 3 + [(2, "u", "a")] * 2, PAGES)
    warc.write(rows, f"file://{tmp_path}/w", files=1)
    with Files(f"file://{tmp_path}/w").read("pages-000000-00000.warc.gz") as f:
        heads = [h for h, _ in warc.records(f)]
    assert len({h["WARC-Record-ID"] for h in heads}) == 5
    assert {h["WARC-Refers-To"] for h in heads if h["WARC-Type"] == "revisit"} == {next(h["WARC-Record-ID"] for h in heads if h["X-Page-Id"] == "1" and h["WARC-Type"] == "response")}


def test_warc_edges(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    rows = [(None, "u", "y" * 100), (None, "u", "y" * 100), (4, "u", "z" * 100), (4, "u", "z" * 100), (None, "u", "z" * 100)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == [("4", "response", "None"), ("4", "revisit", "4"), ("None", "response", "None"), ("None", "revisit", "4"), ("None", "revisit", "None")]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td>a</td></tr>Stray</table>", "Stray\na"),
        ("<table><td>a</td>Stray</table>", "Stray\na"),
    ],
)
def test_text_directly_in_a_table_stays(page, text):
    assert render(page) == text
