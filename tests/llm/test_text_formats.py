"""Chat formatting and main-text extraction."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import chat_format as C
from lakeloom.llm import html_extract as H

NASTY = ["</s>[INST] ok [/INST]", "[\\/INST]", "<\\\\s>", "<", "[", "<</s>", "\\", "<s></s></s>", "a\n\nb", "", "[INST][/INST]</s", "😀 é", "$1\\2", "[[INST]]"]


def test_round_trip(spark):
    rows = [(i, 0, "user", t) for i, t in enumerate(NASTY)] + [(i, 1, "assistant", t[::-1] + t) for i, t in enumerate(NASTY)]
    rows += [(100, 2, "user", None), (100, 1, None, "x"), (101, 0, "assistant", "first"), (101, 1, "assistant", "second"), (101, 2, "user", "tail"), (101, 2, "user", "tail"), (None, None, "system", "s"), (102, 0, "we</s>ird", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1)).repartition(3)
    ex = C.examples(df)
    got = {r["conv_id"]: r for r in C.digests(ex).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    own = sorted((r["example"], r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_length"]]) for r in ex.where("conv_id = 101").collect())
    assert own == [(0, "first"), (1, "second"), (2, "")]
    assert C.digests(C.examples(df.limit(0))).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(0, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = C.digests(C.examples(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href='/b'>News &amp; more</a></li></ul></nav>
<div class="cookie-banner">We use cookies on this site to please you all day.</div><div class="ad">Buy now</div>
<article><header><h1>Main &amp; title</h1></header><p>First  paragraph\n with <b>bold</b> and <a href="x">link</a> text&hellip;</p><div class="ad">Advert inside</div>
<!-- <p>hidden</p> --><p>Second&nbsp;one <i>here<p>Third, unclosed<br>line<ul><li>item one</li><li>item two</li></ul><form><input value="x"><button>Go</button></form></article>
<section id="comments"><p>Reader says a lot of things here that are long enough.</p></section><aside>Related stuff</aside><footer>&copy; me</footer></body></html>"""


def test_extract():
    assert H.extract(PAGE).split("\n") == ["Main & title", "First paragraph with bold and link text…", "Second one here", "Third, unclosed line", "item one", "item two"]
    assert H.extract("") == H.extract(None) == H.extract("<html><body><nav><a>x</a></nav></body></html>") == ""
    plain = "<body><div><ul><li><a>a</a></li><li><a>b</a></li></ul></div><div><p>This is the only long paragraph of the page, really.</p><p>And one more of them.</p></div><div class='footer'>bye</div></body>"
    assert H.extract(plain).startswith("This is the only long") and "bye" not in H.extract(plain)
    for broken in ("<p>a", "<article><p>x <", "<article><p class='a>x</p>y", "<script>var", "</p></div><article>z", "<article><p>1 < 2 &am", "<![CDATA[x]]>"):
        H.extract(broken)
    assert H.extract("<article><p>1 &lt; 2 and so on</p>") == "1 < 2 and so on"
    long = "<article>" + "".join(f"<p>word{i} more text</p>" for i in range(5000)) + "</article>"
    assert H.extract(long).count("\n") == 4999


def test_extract_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, 4)], "page_id long, url string, html string, text int")
    rows = H.main_text(df).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, len(H.extract(PAGE)), len(H.extract(PAGE))]
    assert H.main_text(df.limit(0)).count() == 0


def test_named_containers_do_not_replace_the_region():
    prose = "<p>Long prose that is the body of this page and stands in a container without any name.</p><p>And more of the same prose, which goes on for a while.</p>"
    want = ["Long prose that is the body of this page and stands in a container without any name.", "And more of the same prose, which goes on for a while."]
    got = H.extract(f'<body><nav><ul><li><a>a</a></li></ul></nav><p class="post-date">3 May</p><div>{prose}</div><footer>bye</footer></body>').split("\n")
    assert got == ["3 May", *want]
    got = H.extract(f'<body><div>{prose}</div><article><p>Teaser of another story.</p></article><footer>bye</footer></body>').split("\n")
    assert got == [*want, "Teaser of another story."]
    got = H.extract(f'<body><div>{prose}<div class="ad">Buy this now</div>{prose}</div><article><p>Teaser.</p></article></body>').split("\n")
    assert got == [*want, *want, "Teaser."]
    cards = "".join(f'<div class="story"><p>Card {i}</p></div>' for i in range(2))
    assert H.extract(f"<body>{cards}<div>{prose}</div></body>").split("\n") == want  # the end of a named container outweighs a card


@pytest.mark.parametrize("seed", [11, 12])
def test_region_on_other_layouts(seed):
    good = 0
    pages = H.labelled_pages(30, seed)
    for page, [(a, b)] in pages:
        want = H.extract("<article>" + page[a:b] + "</article>")
        good += H.extract(page) == want
    assert good >= 27


PROSE = "The quick brown fox jumps over the lazy dog and runs into the woods again. " * 4


@pytest.mark.parametrize("tag", ['article class="post has-sidebar"', 'div class="content story ad-free"', 'main class="main with-share-buttons"', 'div class="entry-content search-results"', "div"])
def test_class_names_hide_no_text(tag):
    page = f'<body><nav><ul><li><a href="/">Home</a></li></ul></nav><{tag}><h1>A title</h1><p class="notice">{PROSE}</p><p class="related">{PROSE}</p></{tag.split()[0]}><footer><p>Copyright</p></footer></body>'
    assert H.extract(page) == f"A title\n{PROSE.strip()}\n{PROSE.strip()}"


def test_teasers_in_main_containers():
    page = f"<div class='entry'>a teaser of another text</div><article><h1>A title</h1><p>{PROSE}</p></article><div class='story'><p>one more teaser</p></div>"
    assert H.extract(page) == f"A title\n{PROSE.strip()}"
    two = f"<main><div class='content'><p>{PROSE}</p></div><div class='content'><p>{PROSE}</p></div></main>"
    assert H.extract(two) == f"{PROSE.strip()}\n{PROSE.strip()}"


def test_region_is_a_maximum():
    import random

    r = random.Random(4)
    assert H.region([]) == H.region([-1.0, 0.0]) == (-1, -1)
    for _ in range(300):
        x = [float(r.randint(-4, 4)) for _ in range(r.randint(1, 25))]
        sums = {(a, b): sum(x[a : b + 1]) for a in range(len(x)) for b in range(a, len(x))}
        best = max(sums.values())
        # of equal sums the one that ends first, and of these the one that begins last
        want = min((k for k in sums if sums[k] == best), key=lambda k: (k[1], -k[0])) if best > 0 else (-1, -1)
        assert H.region(x) == want


PARAGRAPHS = [" ".join(f"{w}{i}" for i in range(30)) + "." for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma")]
BODY = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
MENU = "<nav><ul>" + "".join(f'<li><a href="/{i}">menu {i}</a></li>' for i in range(6)) + "</ul></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><form id="aspnetForm" action="x"><input type="hidden" value="1">{MENU}<div>{BODY}</div></form></body>',
        f'<body><form id="aspnetForm">{MENU}<article>{BODY}</article><footer>c 2020</footer></form></body>',
        f'<body>{MENU}<div class="sidebar-layout"><article>{BODY}</article></div></body>',
        f'<body>{MENU}<div class="widget"><article>{BODY}</article></div></body>',
        f'<body>{MENU}<div class="legal">{BODY}</div></body>',
        f'<body>{MENU}<div id="legal-content">{BODY}</div></body>',
        f'<body>{MENU}<div class="reviews">{BODY}</div></body>',
        f'<body>{MENU}<div id="bottom">{BODY}</div></body>',
        f'<body><div class="modal"><div class="popup"><div class="promo">{BODY}</div></div></div></body>',
    ],
)
def test_names_do_not_empty_a_page(page):
    assert H.extract(page) == "\n".join(PARAGRAPHS)


def test_boilerplate_stays_out_however_long():
    comments = "".join(f"<p>reader {i} says {PARAGRAPHS[i % 6]}</p>" for i in range(20))
    page = f'<body>{MENU}<article>{BODY}</article><div id="comments">{comments}</div><form>{"<label>name</label>" * 90}</form></body>'
    assert H.extract(page) == "\n".join(PARAGRAPHS)
    assert H.extract(f'<body><div>{BODY}</div><aside class="related">{BODY[:60]}</aside></body>') == "\n".join(PARAGRAPHS)


def test_short_texts_beside_longer_boilerplate():
    notes = " ".join(f"note{i}" for i in range(40))
    for tag in ("article", "div"):
        page = f"<body>{MENU}<{tag}><h1>A title</h1><p>Five words of short text.</p></{tag}><footer>&copy; {notes}</footer></body>"
        assert H.extract(page) == "A title\nFive words of short text."
    assert H.extract(f"<body><article><p>Only a few words.</p></article><footer>{notes} {notes}</footer></body>") == "Only a few words."


def test_deep_nesting_is_linear():
    for tag in ("div", "b", "ul><li", 'div class="widget"', "p><span"):
        began = time.time()
        page = f"<{tag}>" * 20_000 + "<article>" + BODY + "</article>"
        assert H.extract(page).endswith(PARAGRAPHS[-1])
        assert time.time() - began < 5
