import pytest
from regspark.llm import mainhtml


@pytest.fixture(scope="module")
def field():
    return mainhtml.train(mainhtml.labelled_pages(200), epochs=8)


def test_held_out_layouts(field):
    right = total = 0
    for blocks, labels in mainhtml.labelled_pages(120, seed=77):
        right += int((field.decode(blocks) == labels).sum())
        total += len(labels)
    assert right >= 0.97 * total


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div>
<article><h1>Heading of it</h1><p>First <b>paragraph</b>,\n   with  blanks &amp; signs &#233;.<br>And a second line.
<p>Second paragraph, not closed &lt;here&gt;. It has two sentences.</article>
<section class="comments"><p>I do not agree with any of this, said a reader.</p></section>
<aside class="sidebar"><p>Read this other story, too.</p></aside>
<script>var t = "<p>no</p>";</script><!-- <p>nor this</p> --><form><p>Your name</p></form>
<footer>&copy; 2024 Somebody</footer></body></html>"""


def test_page(spark, field):
    rows = spark.createDataFrame(
        [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", PAGE[:620]), (1, "u", PAGE),
         (6, "u", "<article>" + "<p>Many words are said here, and more.</p>" * 3000)],
        "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    found = mainhtml.extract(rows, field).collect()
    got = {r.page_id: r for r in found}
    assert len(found) == 7
    assert got[1].text == ("Heading of it\n\nFirst paragraph, with blanks & signs é. And a second line.\n\n"
                           "Second paragraph, not closed <here>. It has two sentences.")
    assert got[2].text == got[3].text == got[4].text == "" and got[2].n_chars == 0
    assert got[5].text.startswith("Heading of it\n\nFirst paragraph")
    assert got[6].text.count("\n\n") == 2999 and got[6].n_chars == len(got[6].text)
    assert mainhtml.extract(rows.limit(0), field).count() == 0


def test_viterbi_beats_all_other_labellings(field):
    from itertools import product

    import numpy as np

    for blocks, _ in mainhtml.labelled_pages(30, seed=5):
        blocks = blocks[:8]
        if not blocks:
            continue
        e = field.emissions(mainhtml.features(blocks))
        score = lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(field.pairs[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B905
        best = max(product((0, 1), repeat=len(blocks)), key=score)
        assert np.isclose(score(best), score(field.decode(blocks)))
