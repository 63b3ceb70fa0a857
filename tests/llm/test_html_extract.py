import random
import time

from latentmesh.llm import html_extract as h

from .fixtures import words

PAGES = "page_id long, url string, html string"


def page(rng, marked=True, body=None):
    body = body or "".join(f"<p>{words(rng, rng.randint(15, 60))}.</p>" for _ in range(rng.randint(2, 5)))
    menu = "".join(f"<li><a href='/{i}'>{words(rng, 1)}</a></li>" for i in range(6))
    article = f"<article>{body}</article>" if marked else f"<div>{body}</div>"
    return f"<html><head><title>{words(rng, 3)}</title><style>p{{}}</style><script>if (a < b) track('</p>');</script></head><body><nav><ul>{menu}</ul></nav><!-- {words(rng, 30)} --><div class=\"ad\">{words(rng, 5)}</div>{article}<footer>{words(rng, 6)} &amp; co</footer></body></html>", body


def text_of(body):
    return " ".join(body.replace("<p>", " ").replace("</p>", " ").split())


def slow_best(counts, tags, w):
    top, found = 0.0, (0, -1)
    for i in range(len(counts)):
        for j in range(i, len(counts)):
            s = w.word * sum(counts[i : j + 1]) + sum(w.of(t) for t in tags[i:j])
            if counts[i] and counts[j] and (s > top + 1e-9 or abs(s - top) < 1e-9 and found[1] >= 0 and i == found[0] and j < found[1]):
                top, found = s, (i, j)
    return top, found


def test_scan_finds_the_best_region():
    rng = random.Random(0)
    for _ in range(400):
        n = rng.randint(1, 12)
        counts = [rng.choice([0, 0, 1, 2, 5, 9]) for _ in range(n)]
        tags = [rng.choice(["p", "a", "div", "article"]) for _ in range(n - 1)]
        w = h.Weights(1.0, {"p": -0.75, "a": -2.5, "div": -6.0})
        a, b = h.best(counts, tags, w)
        top, want = slow_best(counts, tags, w)
        got = 0.0 if b < a else sum(counts[a : b + 1]) + sum(w.of(t) for t in tags[a:b])
        assert abs(got - top) < 1e-9
        if b >= a:
            assert counts[a] and counts[b]
        else:
            assert want == (0, -1)


def test_held_out_pages():
    rng = random.Random(1)
    w = h.fit([page(rng)[0] for _ in range(80)])
    assert all(v < 0 for v in w.tags.values()) and w.word > 0
    right = 0
    for k in range(60):
        source, body = page(rng, marked=k % 2 == 0)
        start, end, text = h.extract(source, w)
        assert 0 <= start < end <= len(source)
        right += " ".join(text.split()) == text_of(body)
    assert right >= 54


def test_awkward_pages(spark):
    rng = random.Random(2)
    w = h.fit([page(rng)[0] for _ in range(30)])
    odd = [(1, "u", None), (2, "u", ""), (3, "u", "no tags at all"), (4, "u", "<div><p>cut off <b"), (5, "u", "<<<>>> a < b"), (6, "u", "<p>" + "w " * 200_000), (None, None, "<p>a</p>"), (7, "u", "<script>x"), (8, "u", "<!-- y"), (9, "u", "<p title=\"a>b\">x&lt;y&eacute;</p>"), (9, "u", "<p title=\"a>b\">x&lt;y&eacute;</p>")]
    table = spark.createDataFrame(odd, PAGES).selectExpr("*", "1 AS start", "2 AS `end`", "'x' AS text")
    got = h.content(table, w).collect()
    assert len(got) == len(odd)
    by = {r.page_id: (r.start, r.end, r.text) for r in got}
    assert by[1] == by[2] == by[7] == by[8] == (0, 0, "")
    assert by[3][2] == "no tags at all"
    assert by[4][2] == "cut off"
    assert len(by[6][2].split()) == 200_000
    assert by[9][2] == "x<yé" and by[None][2] == "a"


def test_trains_on_the_table(spark):
    rng = random.Random(3)
    rows = [(i, "u", page(rng, marked=i % 3 > 0)[0]) for i in range(60)]
    table = spark.createDataFrame(rows, PAGES)
    assert h.train(table, 20) == h.train(table.repartition(3), 20)
    assert h.content(table).count() == 60
    assert h.content(table.where("false")).count() == 0
    assert h.train(table.where("false")) == h.Weights()


def test_quotes_count_in_values_only():
    w = h.Weights()
    for open_tag in ("<p title=don't>", "<p don't>", "<p title = it's>", "<p a='x>y' b=\"<br>\">", "<p a=b='c>", "<p a= >", "<p a=>", '<p "x>', '<p a="never closed>'):
        runs, tags, places = h.pieces(f"{open_tag}first words here</p><p>it's more words</p><p>last</p>")
        assert tags == ["p"] * 6 and places[0] == (0, len(open_tag)), open_tag
    assert h.extract("<p title=don't>first words here </p>", w)[2] == "first words here"
    assert h.pieces("<a href='x>y'>t")[2] == [(0, 14)]


def test_unclosed_quotes_take_linear_time():
    began = time.process_time()
    h.pieces("<a b=\"" + "x<a b='y" * 40_000)
    h.pieces("<a " * 40_000)
    h.pieces("<a b=" * 40_000)
    assert time.process_time() - began < 5


def test_names_and_ids_of_any_kind(spark):
    pages = spark.createDataFrame([("1", "u", "<p>some words</p>"), ("x", "u", "<p>other</p>")], "Page_ID string, `a.b` string, HTML string")
    got = {r.page_id: r.text for r in h.content(pages, h.Weights()).collect()}
    assert got == {1: "some words", None: "other"}
