"""Markup against the standard library's parser."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from vacantia.functions import pages as P
from vacantia.functions import text as T

HIDDEN = ("script", "style", "template")


class Reader(HTMLParser):
    """The page's text, and text and title of its first ``div`` marked ``x``."""

    def __init__(self):
        super().__init__()
        self.all, self.found, self.depth, self.hidden, self.title = [], None, 0, 0, None

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif not self.hidden:
            self.all.append(" ")
            if self.depth:
                self.depth += tag == "div"
                self.found.append(" ")
            elif self.found is None and tag == "div" and dict(attrs).get("id") == "x":
                self.depth, self.found, self.title = 1, [], dict(attrs).get("title") or ""

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden -= 1
        elif not self.hidden:
            self.all.append(" ")
            if self.depth:
                self.depth -= tag == "div"
                self.found.append(" ")

    def handle_comment(self, data):
        self.all.append(" ")
        if self.depth:
            self.found.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.all.append(data)
            if self.depth:
                self.found.append(data)


def tidy(parts):
    return " ".join("".join(parts).split()) if parts is not None else None


VALUES = ['"a>b"', "'a > b'", '"<div>"', '"</div>"', "'<!-- '", '"-->"', '"1 < 2 && 3 > 2"', "\"it's\"", "'say \"hi\"'", "plain", '"x=\'y>\'"', '""',
          '"&gt;&amp;"', "'<script>'", '"<h1>no</h1>"']


def random_page(rng):
    def tag():
        return f"<{rng.choice(['p', 'b', 'span', 'i'])} data-v={rng.choice(VALUES)} class={rng.choice(VALUES)}>"

    def filler(n):
        return "".join(rng.choice([tag(), "word ", "it's ", 'a = "q" ', "</p>", "</b>", "<br/>", "<!-- <div id='x'> \" -->",
                                   '<script data-a="1>0">var a = "<div>";</script>', "<style>p > b {}</style>", "</span>", "&amp; &lt;p&gt; ",
                                   "<template><p>t</p></template>", f"<div title={rng.choice(VALUES)}>in</div>"]) for _ in range(n))
    closing = rng.choice(["</div>", "</div>", ""])
    return (filler(rng.randrange(6)) + f"<div title={rng.choice(VALUES)} id=\"x\" data-w={rng.choice(VALUES)}>" + filler(rng.randrange(8)) + closing
            + filler(rng.randrange(4)))


def test_values_comments_and_nesting_as_the_parser_reads_them(spark):
    rng = random.Random(21)
    markup = [random_page(rng) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(markup)), "i int, html string")
    clean = T.drop_noise(F.col("html"))
    element = P.first_element(F.col("clean"), F.lit("div"), F.lit(P.open_tag_pattern("div", "id", "x")))
    found = rows.select("i", T.html_to_text(F.col("html")).alias("text"), clean.alias("clean")).select(
        "i", "text", element.alias("e")).select("i", "text", T.tags_to_spaces(F.col("e.inner")).alias("inner"),
                                                P._attribute(F.col("e.opening"), "title").alias("title")).collect()
    for r in found:
        reader = Reader()
        reader.feed(markup[r["i"]])
        reader.close()
        assert r["text"] == tidy(reader.all), markup[r["i"]]
        assert (r["inner"], r["title"]) == (tidy(reader.found), reader.title), markup[r["i"]]


def test_quotes_that_are_no_values(one):
    html = ["<p title=it's>a</p><p class=\"x>\">b</p>", '<p a="never closed>c</p><i t=">">d</i>', "5 > 3 = \"yes\" <b>e</b>", '<a b=">', "<", None]
    assert one(T.html_to_text, *html) == ["a b", '">d', "5 > 3 = \"yes\" e", "", "<", ""]
