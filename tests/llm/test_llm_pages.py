"""Pages whose article is easily lost, names of what is none, and pages that nest without end."""

import random
import time

import pytest

from lodestrata.llm import html_extract as H

STORY = "The long story of the river goes on for many lines. " * 12


def texts(spark, pages):
    df = spark.createDataFrame([(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in H.extract(spark, df).orderBy("id").collect()]


@pytest.mark.parametrize("count", [4, 5, 6, 30])
@pytest.mark.parametrize("frame", ["<article><section>{}</section>{}</article>", "<article><div>{}</div>{}</article>", "<div><div class=body>{}</div>{}</div>", "<main><div><section>{}</section></div>{}</main>", "{}{}"])
def test_near_copies_make_no_template(spark, frame, count):
    page = "<body><nav>menu</nav>" + frame.format(f"<h2>Title</h2><p>{STORY}</p><p>Second part. {STORY}</p>", "<p>Seen {} times</p>") + "<div class=foot><span>Our shop, since 1900</span></div></body>"
    pages = [page.replace("{}", str(k)) for k in range(count)]
    if count >= 5:
        pages += [f"<body><div class=foot><span>Our shop, since 1900</span></div><p>other {k} {STORY}{k}</p></body>" for k in range(count)]
    for k, text in enumerate(texts(spark, pages)[:count]):
        assert text.count("The long story") == 24 and f"Seen {k} times" in text


def test_the_story_stands_before_cards():
    page = f"<body><div id=content><h1>Head</h1><p>{STORY}</p></div><article><h3>Teaser one</h3></article><article>Teaser two</article></body>"
    assert H.main_text(page) == f"Head\n\n{STORY.strip()}"
    assert H.main_text(f"<body><div class=x>short</div><article><p>{STORY}</p></article></body>") == STORY.strip()
    assert H.main_text(f"<body><div class=ad>{STORY}</div><article>Short</article></body>") == "Short"
    assert H.main_text(f"<body><div><article><p>One</p></article><p>{STORY}</p></div></body>") == "One"  # the block holds the article


def test_a_form_may_be_the_frame_of_a_page():
    assert H.main_text(f"<body><form action=/><div><p>{STORY}</p><input value=x><button>go</button></div></form></body>") == STORY.strip()
    assert H.main_text(f"<body><p>{STORY}</p><form><p>Your mail</p></form></body>") == STORY.strip()


@pytest.mark.parametrize("mark", ["class='user-comments'", "class=CommentThread", "class='x cookieBanner'", "id=adSlot", "class=newsletterSignup", "class=readerComments", "id=AD_SLOT_2"])
def test_names_part_at_hyphens_and_cases(mark):
    assert H.main_text(f"<body><p>{STORY}</p><div {mark}><p>noise</p></div></body>") == STORY.strip()


@pytest.mark.parametrize("heading", ["Comments", "3 Comments", "Reader comments (12)", "Leave a comment", "<b>Replies:</b>"])
def test_a_heading_of_remarks_marks_its_block(heading):
    assert H.main_text(f"<body><article><p>{STORY}</p><section id='readers-say'> <h2>{heading}</h2><p>noise</p></section></article></body>") == STORY.strip()


def test_innocent_names_and_headings_stay():
    for mark in ("class=adventure", "class='commentary-desk'", "id=bannerman", "class=shareholders"):
        assert "kept" in H.main_text(f"<body><p>{STORY}</p><div {mark}><p>kept</p></div></body>")
    assert "kept" in H.main_text(f"<body><article><p>{STORY}</p><div><h2>Comments on the law</h2><p>kept</p></div></article></body>")
    assert "kept" in H.main_text(f"<body><article><p>{STORY}</p><div><p>x</p><h2>Comments</h2><p>kept</p></div></article></body>")


def plain_main_block(page):
    """The innermost element with over half of the text, by measuring every element by itself."""
    root, every = H.parse(page)

    def size(e):
        return sum(len(x.strip()) if isinstance(x, str) else 0 if x.tag in H.NOT_TEXT and x.tag != "form" else size(x) for x in e.items)

    def shown(e):
        return e is root or (e.tag not in H.NOT_TEXT and shown(e.parent))

    heavy = [e for e in every if 2 * size(e) > size(root) and shown(e)]
    return None if size(root) < H.PARAGRAPH else (heavy[-1] if heavy else root), H._main_block(root), [(e.size, size(e)) for e in every]


def test_the_main_block_is_that_of_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        parts, open_ = [], []
        for _ in range(rng.randrange(40)):
            if open_ and rng.random() < 0.4:
                parts.append(f"</{open_.pop()}>")
            else:
                tag = rng.choice(["div", "section", "p", "b", "form", "nav", "article", "li", "td", "script"])
                parts.append(f"<{tag}>")
                if tag == "script":
                    parts.append("x</script>")
                else:
                    open_.append(tag)
            parts.append(rng.choice(["", "word", STORY[:90]]))
        want, got, sizes = plain_main_block("".join(parts))
        assert got is want and all(a == b for a, b in sizes)


@pytest.mark.parametrize("shape", [lambda n: "<b>" * n + "</i>" * n, lambda n: "<div class=ad>" * n + "x", lambda n: "<p><td>" + "<b>" * n + "<div></div>" * n, lambda n: "<ul>" + "<li><span>" * n, lambda n: "<div>" * n + "</div>" * n, lambda n: "<i><p>" * n])
def test_time_is_linear_in_depth(shape):
    took = []
    for n in (8_000, 32_000):
        each = []
        for _ in range(3):  # the best of three, as other work may slow any of them
            began = time.perf_counter()
            H.main_text(shape(n), 7, lambda asked: [False] * len(asked))
            each.append(time.perf_counter() - began)
        took.append(min(each))
    assert took[1] < 10 * max(took[0], 0.02) and took[1] < 5
