import random
import re

from vocaris.llm import html_extract as X

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{{}}</style><script>var t="</p><article>no";</script></head><body>
<header><div>Site name</div></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>gone</p> --><div class="ad top">Buy now</div>
{article}<footer>&copy; me &middot; All rights</footer></body></html>"""
ARTICLE = """<article class="post related-x"><h1>T&eacute;st &amp; title</h1><p><b>First   line<br><p>Second\n\tline with <a href="x">link</a>.</p>
<aside>See also this</aside><div id="comments"><p>nice post</p></div><form><input><label>mail</label></form><table><tr><td>1</td><td>2</td></tr></table><p>E.</article>"""
TEXT = "Tést & title\nFirst line\nSecond line with link.\n1 2\nE."


def weights():
    return X.weights_of(X.counts(PAGE.format(article=ARTICLE)))


def test_article_without_its_surroundings():
    assert X.extract_text(PAGE.format(article=ARTICLE), weights()) == TEXT
    assert X.extract_text(PAGE.format(article=ARTICLE), X.Weights()) == TEXT


def test_page_without_labels_uses_the_best_region():
    page = PAGE.format(article='<div><p>One two three four.</p><p>Five &lt; six.</p><div class="share">Tweet</div></div>')
    assert X.extract_text(page, weights()) == "One two three four.\nFive < six."


def test_plain_containers_count_on_pages_without_labels():
    page = PAGE.format(article="<div>One two three.<br>Four five.</div>")
    assert X.extract_text(page, weights()) == "One two three.\nFour five."


def test_scan_equals_all_stretches():
    rng = random.Random(5)
    for _ in range(300):
        values = [rng.choice([-2.0, -0.5, 0.0, 1.0, 3.0]) for _ in range(rng.randint(0, 14))]
        sums = [(sum(values[a:b]), -a, a - b, a, b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)]
        best = max(sums, default=(0,))[0]
        a, b = X.best_region(values)
        assert sum(values[a:b]) == max(best, 0.0)


def test_region_decides_between_places():
    w = X.Weights(X.Settings(floor=-1.0), {"p": 1.0, "li": -2.0}, -3.0, {})
    assert X.extract_text("<p>a b</p><li>x x x x x x x x</li><p>c d e</p>", w) == "c d e"
    assert X.extract_text("<p>a b c d</p><li>x</li><p>c d e</p>", w) == "a b c d\nx\nc d e"


def test_label_plays_no_part_in_extraction():
    page = PAGE.format(article=ARTICLE)
    assert X.extract_text(re.sub(r"</?article[^>]*>", "", page), weights()) == TEXT


def test_text_outside_a_small_article_stays():
    body = "<p>" + " ".join(f"w{k}" for k in range(120)) + ".</p>"
    page = PAGE.format(article=f'<article class="teaser"><p>Read on.</p></article><div>{body}</div>')
    assert X.extract_text(page, weights()).split("\n")[0] == "Read on."
    assert "w0 w1" in X.extract_text(page, weights()) and "w119." in X.extract_text(page, weights())


def test_class_parts_and_inline_elements_lose_nothing():
    page = PAGE.format(article='<article><p>One two.</p><section class="social-history"><p>Three <math><mi>x</mi></math> <button>four</button>.</p></section><ul><li>five</li><li>six</li></ul></article>')
    assert X.extract_text(page, weights()) == "One two.\nThree x four.\nfive\nsix"


def test_link_lists_behind_the_text_are_outside_the_region():
    links = "<ul>" + '<li><a href="x">link</a></li>' * 40 + "</ul>"
    page = PAGE.format(article="<p>One two three.</p><p>Four five six.</p><p>Seven.</p>" + links)
    assert X.extract_text(page, weights()) == "One two three.\nFour five six.\nSeven."


def test_weights_learn_unknown_places(spark):
    noise = '<div class="zap"><p>{}</p></div>'
    pages = [(k, f"<body>{noise.format('buy this now ' * 9)}<article><p>{'good text here ' * 9}</p></article></body>") for k in range(20)]
    w = X.learn(spark.createDataFrame(pages, "page_id long, html string"))
    assert w.mark(".zap") < X.SETTINGS.ruled_out and w.mark("p") > 0 and w.mark("body") == 0
    assert X.extract_text(f"<p>Some text.</p>{noise.format('buy this')}<p>More text.</p>", w) == "Some text.\nMore text."


def test_broken_markup():
    w = weights()
    for page in (None, "", " \n", "<", "<p", "<!-- open", "<script>x", "<nav>only menu"):
        assert X.extract_text(page, w) in ("", "<")
    assert X.extract_text("a < b <p title='>'>c &am d &#x41;</p", w) == "a < b\nc &am d A"
    assert X.extract_text("<p>" + "word " * 50000, w) == " ".join(["word"] * 50000)


def test_query_shape(spark):
    df = spark.createDataFrame([(1, "u", PAGE.format(article=ARTICLE), "x"), (1, "u", PAGE.format(article=ARTICLE), "x"), (2, None, None, "y")], "page_id long, url string, html string, Text string")
    out = X.extract(df, X.learn(df), carry=["page_id", "url"])
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(tuple(r) for r in out.where("url is not null").collect()) == [(1, "u", TEXT, len(TEXT))] * 2
    assert out.where("url is null").first().text == "" and X.extract(df.limit(0), X.learn(df.limit(0))).count() == 0
