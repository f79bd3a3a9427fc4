"""Column expressions for names, documents and JSON replies."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of pages that hold an error instead of content.
ERROR_MARKERS = (
    "limit exceeded",
    "Error fetching",
    "Invalid bearer token",
    "HTTP error occurred",
    "Connection error",
    "Request timed out",
    "Please turn on Javascript",
    "Enable JavaScript",
    "Please enable cookies",
    "Access Denied",
    "403 Forbidden",
    "404 Not Found",
)

# Elements whose content is not text of the page.
DROPPED_TAGS = ("script", "style", "nav", "footer", "header", "aside", "meta", "link", "noscript", "iframe")

# Notations of paper ids, in order of preference; the first with a hit wins.
CARD_PAPER_PATTERNS = (
    r"(?i)arxiv\.org/abs/(\d{4}\.\d{4,5})",
    r"(?i)arxiv\.org/pdf/(\d{4}\.\d{4,5})",
    r"(?i)arXiv:(\d{4}\.\d{4,5})",
    r"\[(\d{4}\.\d{4,5})\]",
)
README_PAPER_PATTERNS = (
    r"(?i)arxiv[:/](?:abs/)?(\d{4}\.\d{4,5}(?:v\d+)?)",
    r"(?i)https?://arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)",
    r"\[(\d{4}\.\d{4,5})\]",
)
PAPER_NUMBER = r"(\d{4}\.\d{4,5})"
PAPER_KEYS = ("paper_url", "arxiv", "paper")

# What is taken off a name before names are compared, and the version in a name.
REMARK = r"\s*\([^)]*\)"
SEPARATORS = r"[-_.\s]+"
VERSION = r"(?i)[-_]?v?\d+\.?\d*[-_]?"
TRAILING_SIZE = r"\d+b?$"

# Link targets and runs that are shortened in marked-up text.
LINK_TARGETS = r"\(https?:.*?\)|\[https?:.*?\]"
RUNS = (("---", "-"), ("===", "="), ("   ", " "))

# Where a reply holds its JSON, in order of preference.
JSON_FENCE = r"```json\s*([\s\S]*?)\s*```"
ANY_FENCE = r"```\s*([\s\S]*?)\s*```"
BRACES = r"\{[\s\S]*\}"

# The usual lengths, in characters, for those who want texts cut.
PAGE_LIMIT = 15000
MENTION_LIMIT = 2000
CONTEXT_LIMIT = 10000


def _matched(c: Column, pattern: str, group: int = 1) -> Column:
    hit = F.regexp_extract(c, pattern, group)
    return F.when(hit != "", hit)


def _cut(c: Column, limit: int | None) -> Column:
    return c if limit is None else F.substring(c, 1, limit)


def normalize_name(c: Column, strip_parens: bool = False) -> Column:
    """Lower case without blanks, ``_``, ``-`` and ``.``; optionally without bracketed remarks."""
    if strip_parens:
        return F.regexp_replace(F.lower(F.regexp_replace(c, REMARK, "")), SEPARATORS, "")
    return F.translate(F.lower(c), " _-.", "")


def search_terms(name: Column) -> Column:
    """Up to three spellings to look a name up by, in order, without repeats."""
    base = F.trim(F.substring_index(name, "(", 1))
    spellings = F.array(
        base,
        F.replace(base, F.lit(" "), F.lit("-")),
        F.replace(base, F.lit("-"), F.lit(" ")),
        F.regexp_replace(base, VERSION, ""),
    )
    first = F.transform(F.slice(F.array_distinct(spellings), 1, 3), lambda t: F.trim(t))
    return F.filter(first, lambda t: t != "")


def paper_id(text: Column, patterns: tuple[str, ...] = README_PAPER_PATTERNS) -> Column:
    return F.substring_index(F.coalesce(*[_matched(text, p) for p in patterns]), "v", 1)


def paper_ids(text: Column) -> Column:
    """Every paper id of the text, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PAPER_NUMBER), F.lit(1)))


def paper_id_from_card(card: Column) -> Column:
    """Paper id from a stored hub reply: the card's own keys first, then the tags."""
    values = [F.get_json_object(card, f"$.cardData.{key}") for key in PAPER_KEYS]
    from_keys = [F.when(F.lower(v).contains("arxiv"), _matched(v, PAPER_NUMBER)) for v in values]
    tags = F.from_json(F.get_json_object(card, "$.tags"), "ARRAY<STRING>")
    tag_ids = F.filter(
        F.transform(tags, lambda t: F.when(F.lower(t).contains("arxiv"), F.regexp_extract(t, PAPER_NUMBER, 1))),
        lambda t: t != "",
    )
    return F.coalesce(*from_keys, F.try_element_at(tag_ids, F.lit(1)))


#: One piece of a page: a comment, a whole script or style element (ended or not), a declaration, a tag, or text.
_PIECE = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\z)|<[!?/a-z][^>]*(?:>|\z)|[^<]+|<"
_FOLD = 256  # pieces of a page that are folded together
_REFERENCE = "&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});?"


def _references() -> tuple[list[str], list[str]]:
    """Names of character references, and what they stand for; numbers of the old code page among them."""
    table = dict(html5)
    for n in range(128, 160):
        try:
            table[f"#{n};"] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            continue
    return list(table), list(table.values())


def unescape_html(text: Column) -> Column:
    """``text`` with every character reference replaced: names, decimal and hexadecimal numbers. Unknown names stay;
    numbers that are no character become U+FFFD."""
    names, values = _references()
    table = F.map_from_arrays(F.split(F.lit(" ".join(names)), " "), F.split(F.lit("\x01".join(values)), "\x01"))

    def plain(ref: Column) -> Column:
        body = F.rtrim(F.substring(ref, 2, 40), F.lit(";"))
        hexed = body.rlike("^#[xX]")
        digits = F.substring(body, F.when(hexed, 3).otherwise(2), F.lit(40))
        number = F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        odd = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
        char = F.when(odd, "�").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        named = F.when(ref.endswith(";"), F.try_element_at(table, F.concat(body, F.lit(";")))).otherwise(F.try_element_at(table, body))
        numbered = F.coalesce(F.try_element_at(table, F.concat(F.lit("#"), number.cast("string"), F.lit(";"))), char)
        return F.when(body.startswith("#"), numbered).otherwise(F.coalesce(named, ref))

    def joined(gaps: Column, refs: Column) -> Column:
        return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(plain(F.get(refs, i)), F.lit("")))), "")

    pair = F.struct(F.split(text, _REFERENCE).alias("gaps"), F.regexp_extract_all(text, F.lit(f"({_REFERENCE})"), F.lit(1)).alias("refs"))
    return F.when(text.contains("&"), F.get(F.transform(F.array(pair), lambda p: joined(p["gaps"], p["refs"])), F.lit(0))).otherwise(text)


def html_to_text(html: Column, limit: int | None = None) -> Column:
    """Text of a page: what lies outside comments, tags and dropped elements, white space runs as one blank.

    The page is cut into pieces once, and the depth of dropped elements is folded over them, block by block. Elements
    may nest; one that is never closed drops the rest of the page; an end without a start does nothing. Character
    references are replaced in the text, not in tags.
    """
    dropped = "|".join(t for t in DROPPED_TAGS if t not in ("script", "style", "meta", "link"))

    def step(piece: Column) -> Column:
        opens = piece.rlike(rf"(?i)^<(?:{dropped})\b") & ~piece.endswith("/>")
        return F.when(opens, 1).when(piece.rlike(rf"(?i)^</(?:{dropped})\b"), -1).otherwise(0)

    pieces = F.regexp_extract_all(html, F.lit(f"({_PIECE})"), F.lit(1))
    moved = F.transform(pieces, lambda p: F.struct(p.alias("piece"), step(p).alias("step")))

    def blocks(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _FOLD).cast("int"))
        cut = F.transform(numbers, lambda k: F.slice(all_, k * _FOLD + 1, F.lit(_FOLD)))
        # What a block does to the depth: it never falls below 0, so the sum counts from its lowest point.
        ends = F.aggregate(
            cut,
            F.array(F.lit(0)),
            lambda depths, b: F.concat(depths, F.array(F.aggregate(b, F.element_at(depths, -1), lambda d, x: F.greatest(d + x["step"], F.lit(0))))),
        )
        return F.transform(F.arrays_zip(cut.alias("cut"), F.slice(ends, F.lit(1), F.size(cut)).alias("depth")), kept)

    def kept(block: Column) -> Column:
        start = F.struct(block["depth"].alias("depth"), F.array().cast("array<string>").alias("texts"))

        def add(state: Column, x: Column) -> Column:
            text = (state["depth"] == 0) & ~x["piece"].rlike("^<[!?/A-Za-z]")
            return F.struct(
                F.greatest(state["depth"] + x["step"], F.lit(0)).alias("depth"),
                F.when(text, F.concat(state["texts"], F.array(x["piece"]))).otherwise(state["texts"]).alias("texts"),
            )

        return F.aggregate(block["cut"], start, add, lambda state: state["texts"])

    parts = F.get(F.transform(F.array(moved), lambda m: F.when(F.size(m) > 0, F.flatten(blocks(m))).otherwise(F.array().cast("array<string>"))), F.lit(0))
    # The joined text is used several times there, and made once.
    text = F.when(html.isNotNull(), F.get(F.transform(F.array(F.array_join(parts, " ")), unescape_html), F.lit(0)))
    return _cut(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), limit)


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " ")))


def is_error_page(text: Column, html: Column | None = None) -> Column:
    """No text, under 50 characters, or few words with a marker; with ``html`` also a page of under 100 characters."""
    low = F.lower(text)
    marked = F.lit(False)
    for marker in ERROR_MARKERS:
        marked = marked | low.contains(marker.lower())
    short = F.coalesce(F.length(text) < 50, F.lit(True))
    if html is not None:
        short |= F.coalesce(F.length(html) < 100, F.lit(True))
    return short | ((word_count(text) < 100) & marked)


def clean_markdown(text: Column) -> Column:
    """Drop link targets, then shorten rules and runs of three blanks."""
    out = F.regexp_replace(text, LINK_TARGETS, "")
    for run, short in RUNS:
        out = F.replace(out, F.lit(run), F.lit(short))
    return out


def strip_front_matter(text: Column) -> Column:
    end = F.locate("---", text, 4)
    body = F.regexp_replace(F.substr(text, end + 3), r"^\s+|\s+$", "")
    return F.when(text.startswith("---") & (end > 0), body).otherwise(text)


def usable_content(fetched: Column, snippet: Column, limit: int | None = None) -> Column:
    """The fetched text when it is no error and longer than 100 characters, else the snippet; with a flag."""
    good = F.coalesce(~fetched.startswith("Error:") & (F.length(fetched) > 100), F.lit(False))
    return F.struct(
        _cut(F.when(good, fetched).otherwise(snippet), limit).alias("text"), good.alias("is_full_content")
    )


def json_block(text: Column) -> Column:
    """The JSON text of a reply: a fence marked json, else any fence, else first to last brace."""
    marked = F.when(text.contains("```json"), _matched(text, JSON_FENCE))
    fenced = F.when(~text.contains("```json"), _matched(text, ANY_FENCE))
    return F.coalesce(marked, fenced, _matched(text, BRACES, 0))


def json_field(block: Column, name: str) -> Column:
    return F.get_json_object(block, f"$.{name}")


def json_array(block: Column, name: str) -> Column:
    return F.from_json(json_field(block, name), "ARRAY<STRING>")


def known_descriptions(descriptions: Column, allowed: Column) -> Column:
    """Entries of a map of texts whose key is one of the allowed names."""
    return F.map_filter(descriptions, lambda k, v: F.array_contains(allowed, k) & v.isNotNull())
