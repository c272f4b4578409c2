"""Balanced removal of elements against a parser, and frequent values without a shuffle of all."""

import random
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tessellar.operators import curate, insights


class Kept(HTMLParser):
    """The text outside chrome elements of well-formed pages."""

    def __init__(self):
        super().__init__()
        self.text, self.depth, self.inside = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in curate.VOID_TAGS:
            return
        marked = tag in curate.CHROME_TAGS or dict(attrs).get("role") == "navigation" or {"cookie", "breadcrumb"} & set((dict(attrs).get("class") or "").split())
        self.inside.append(bool(marked))

    def handle_startendtag(self, tag, attrs):
        return

    def handle_endtag(self, tag):
        self.inside.pop()

    def handle_data(self, data):
        if not any(self.inside):
            self.text.append(data)


def page(rng, depth=0):
    """A random well-formed tree; same tags nest often."""
    out = []
    for _ in range(rng.randint(1, 3)):
        tag = rng.choice(["div", "div", "span", "nav", "p"])
        attrs = rng.choice(["", "", "", ' class="a cookie b"', " role='navigation'", ' class="cookies"', ' data-x="1"'])
        body = page(rng, depth + 1) if depth < 5 and rng.random() < 0.7 else f"t{rng.randrange(10**6)} "
        out.append(rng.choice([f"<{tag}{attrs}>{body}</{tag}>", f"w{rng.randrange(10**6)} ", "<br>", "<img src='x'/>", f"<{tag}{attrs}>{body}</{tag}>"]))
    return "".join(out)


def plain(html):
    return " ".join(curate.re.sub("<[^>]*>", " ", html).split())


def test_balanced_removal_equals_a_parser():
    rng = random.Random(1)
    for _ in range(400):
        html = page(rng)
        parser = Kept()
        parser.feed(html)
        parser.close()
        assert plain(curate.without_chrome(html)) == " ".join(" ".join(parser.text).split()), html


def test_elements_without_an_end(spark):
    cases = {
        '<div class="cookie"><div>in</div>ad text</div><p>main</p>': "main",
        '<div class="cookie">open <p>main</p>': "open main",
        "<nav>a<nav>b</nav>c</nav>d": "d",
        "<nav>a<nav>b</nav>c": "ac",
        "x<form/>y</form>z": "xyz",
        "</nav>x": "x",
        "<input class='cookie'>x": "x",
        "a<HEADER>b</Header >c": "ac",
        "<script>if (a<nav>b) </script>x<style>nav{}</style>": "x",
        "": "",
    }
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(cases)] + [(99, None)], "i int, html string")
    got = {r.i: r.t for r in rows.select("i", curate.main_text(F.col("html")).alias("t")).collect()}
    assert got.pop(99) is None and {i: " ".join(t.split()) for i, t in got.items()} == dict(enumerate(cases.values()))


def test_most_common_values(spark):
    rng = random.Random(2)
    values = [rng.choice([None, "a", "b", "c"]) if rng.random() < 0.1 else f"v{min(int(rng.expovariate(0.01)), 3000)}" for _ in range(5000)]
    rows = spark.createDataFrame(list(enumerate(values)), "at long, q string")
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    for k in (1, 5, 40, 5000):
        want = sorted(Counter(values).items(), key=lambda x: (-x[1], first[x[0]]))[:k]
        assert [(r.q, r.n) for r in insights.most_common(rows, "q", "at", k).collect()] == want
    assert insights.most_common(rows.limit(0), "q", "at").count() == 0
