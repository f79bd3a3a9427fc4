"""Edge rules of the column expressions, by hand."""

from pyspark.sql import functions as F

from scoreweave.functions import fields, text


def values(spark, rows, expr, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows], schema).withColumn("_i", F.monotonically_increasing_id())
    return [r["v"] for r in df.coalesce(1).orderBy("_i").select(expr.alias("v")).collect()]


def test_sizes(spark):
    x = F.col("x")
    assert values(spark, ["7B", " 1.5 b", "500M", "x", "", None, "1.2.3"], fields.parse_parameters(x)) == [7, 1.5, 500, 0, 0, 0, 0]
    assert values(spark, ["7B", "500 m", "3", "MB", None, "x"], fields.parse_size_billion(x)) == [7, 0.5, 3, 0, 0, 0]
    assert values(spark, ["Net-7B", "net 0.5 b", "Net", "a1b2B"], fields.name_size(x)) == [7, 0.5, 0, 1]
    assert values(spark, ["1,200 items", "", None, "none"], fields.digits_only(x)) == [1200, 0, 0, 0]


def test_dates(spark):
    x = F.col("x")
    rows = ["2025/01/31", "2024/12/31", "2025", "a/b", None, "2026/1"]
    assert values(spark, rows, fields.is_recent(x, "2025/01/15")) == [True, False, False, False, False, True]
    day = F.lit("2025-03-01").cast("date")
    got = values(spark, ["2024/1/5", "2024-01-05", "soon", None], fields.parse_release_date(x, day).cast("string"))
    assert got == ["2024-01-05", "2024-01-05", "2025-01-30", "2025-01-30"]
    ages = values(spark, ["2025-01-30", "2025-01-29", "2024-12-01", "2024-08-01"], fields.time_decay(F.to_date("x"), day))
    assert ages == [1.0, 0.75, 0.75, 0.25]


def test_clip_keeps_null(spark):
    assert values(spark, [None, -1.0, 50.0, 101.0], fields.to_percent(F.col("x"), F.lit(0.0), F.lit(100.0)), "x double") == [None, 0, 50, 100]


def test_links(spark):
    x = F.col("x")
    rows = ["https://huggingface.co/a/b/?x=1", "https://huggingface.co", "https://github.com/o/r.git/tree/x", None]
    got = values(spark, rows, fields.entity_links(x, F.lit("Yes")))
    assert [g["huggingface"] for g in got] == ["a/b", None, None, None]
    assert got[0]["main_url"] == "https://huggingface.co/a/b" and got[2]["code_url"] == rows[2]
    closed = values(spark, rows, fields.entity_links(x, F.lit("No")))
    assert all(g["huggingface"] is None and g["main_url"] is None for g in closed)
    assert values(spark, rows, fields.readme_raw_url(x))[2] == "https://raw.githubusercontent.com/o/r/main/README.md"


def test_empty_fields(spark):
    df = spark.createDataFrame([("", 0, 0.0, False, [], None), ("a", 3, 1.5, True, ["q"], "z")], "s string, i int, d double, b boolean, l array<string>, n string")
    got = [r["m"] for r in df.select(fields.drop_empty_fields(df, df.columns).alias("m")).collect()]
    assert got[0] == {"s": ""}  # empty text stays, zeros and empty lists go
    assert set(got[1]) == {"s", "i", "d", "b", "l", "n"}


def test_fixed_decimals_round_the_binary_value(spark):
    xs = [2.675, 0.125, 1234567.891, -0.004, 66.8]
    assert values(spark, xs, fields.fixed(F.col("x"), 2), "x double") == [f"{v:.2f}" for v in xs]


def test_names(spark):
    x = F.col("x")
    assert values(spark, ["A-b_C. d (v2) e"], text.normalize_name(x, True)) == ["abcde"]
    assert values(spark, ["A-b_C. d (v2)"], text.normalize_name(x)) == ["abcd(v2)"]
    assert values(spark, ["Net-VL v2 (x)", "Plain"], text.search_terms(x)) == [["Net-VL v2", "Net-VL-v2", "Net VL v2"], ["Plain"]]


def test_paper_ids(spark):
    x = F.col("x")
    rows = ["see arXiv:2009.03300v1", "[2101.00001] and https://arxiv.org/pdf/2202.12345v3", "no 2009.0330", None]
    assert values(spark, rows, text.paper_id(x)) == ["2009.03300", "2202.12345", None, None]
    assert values(spark, rows, text.paper_id(x, text.CARD_PAPER_PATTERNS)) == ["2009.03300", "2202.12345", None, None]


def test_json_block(spark):
    rows = ['a ```json {"d": 1} ``` b', '```\n{"d": 2}\n```', 'x {"d": {"e": 3}} y', "nothing", "```json broken", None]
    got = values(spark, rows, text.json_block(F.col("x")))
    assert got == ['{"d": 1}', '{"d": 2}', '{"d": {"e": 3}}', None, None, None]


def test_pages(spark):
    page = "<html><head><style>x{}</style></head><body><NAV>menu</NAV><!-- no --><p>A &amp; B</p> <div>c<br>d</div><footer>f</footer></body></html>"
    nested = "<body><nav>a<nav>b</nav>c</nav><p>t &eacute;</p><script>if (a<b) {}</script></body>"
    assert values(spark, [page, None], text.html_to_text(F.col("x"))) == ["A & B c d", None]
    assert values(spark, [nested], text.html_to_text(F.col("x"))) == ["t é"]
    short, marked, long_marked = "ok " * 10, "Access denied " + "w " * 60, "Access denied " + "w " * 120
    assert values(spark, [short, marked, long_marked, None, "w " * 60], text.is_error_page(F.col("x"))) == [True, True, False, True, False]


def test_pages_against_a_parser(spark):
    """Broken, nested and long pages against the parser of the standard library."""
    import random
    from html.parser import HTMLParser

    class Page(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag in text.DROPPED_TAGS and tag not in ("meta", "link")

        def handle_startendtag(self, tag, attrs):
            pass

        def handle_endtag(self, tag):
            self.depth -= tag in text.DROPPED_TAGS and self.depth > 0

        def handle_data(self, data):
            self.parts += [] if self.depth else [data]

    def plain(page):
        parser = Page()
        parser.feed(page)
        parser.close()
        return " ".join(" ".join(parser.parts).split())

    draw = random.Random(7)
    bits = ["<p>", "</p>", "<nav>", "</nav>", "<NAV a='b'>", "<footer>", "</footer>", "<br/>", "<script>if (a<b) {}</script>", "<style>p{}</style>", "<!-- <nav> -->",
            "word ", " more", "&eacute;", "&mdash;", "&#8217;", "&#x1F600;", "&lt;nav&gt;", "<meta x>", "<aside>", "</aside>", "\n", "<iframe/>"]
    pages = ["".join(draw.choice(bits) for _ in range(draw.randrange(1, 40))) for _ in range(150)]
    pages += ["<p>" + "<b>x</b> &amp; " * 2000 + "<nav>" + "<p>y" * 900 + "</nav>z", "", "plain", "<nav>never closed <p>x"]
    assert values(spark, pages, text.html_to_text(F.col("x"))) == [plain(p) for p in pages]


def test_broken_pages_and_references(spark):
    pages = {
        "a &mdash; b&#8217;s": "a — b’s", "<p>t</p><script>x=1;": "t", "x <!-- open": "x", "&unknown; &#0; &#xD800; &#150; &amp;lt; &copy": "&unknown; � � – &lt; ©",
        "a < b": "a < b", "</nav>x<aside>y</aside>": "x", "&nbsp;\u3000a &nbsp; b": "a b",
    }
    assert values(spark, list(pages), text.html_to_text(F.col("x"))) == list(pages.values())
    assert values(spark, ["<p>" + "word " * 15 + "</p>", "<p>" + "word " * 30 + "</p>", None], text.is_error_page(text.html_to_text(F.col("x")), F.col("x"))) == [True, False, True]


def test_cleaning(spark):
    x = F.col("x")
    assert values(spark, ["[a](http://b) --- === x   y [https://c]"], text.clean_markdown(x)) == ["[a] - = x y "]
    assert values(spark, ["---\nt: 1\n---\n\nbody \n", "--- open", "plain ---"], text.strip_front_matter(x)) == ["body", "--- open", "plain ---"]
    got = values(spark, ["Error: x" + "y" * 200, "z" * 101, "z" * 100, None], text.usable_content(x, F.lit("snip")))
    assert [(g["text"], g["is_full_content"]) for g in got] == [("snip", False), ("z" * 101, True), ("snip", False), ("snip", False)]
