"""Column expressions for entity and item fields: sizes, dates, ranges, links, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hosts and address formats of public model hubs.
HUB_HOST = "huggingface.co"
CODE_HOST = "github.com"
HUB_URL = "https://huggingface.co/"
RAW_README = "https://raw.githubusercontent.com/{owner}/{repo}/main/README.md"

# The number in a size text, the size in a name, owner and repository in an address.
SIZE_NUMBER = r"([\d.]+)"
NAME_SIZE = r"(?i)(\d+(?:\.\d+)?)\s*B"
CODE_REPOSITORY = r"github\.com/([^/]+)/([^/]+)"

# Scales of the profile vectors.
SIZE_SCALE = 100.0
SAMPLES_SCALE = 50000.0
SUBCATEGORY_SCALE = 50.0


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def parse_parameters(c: Column) -> Column:
    """First number of the text, whatever the unit; 0 when there is none."""
    number = F.regexp_extract(c, SIZE_NUMBER, 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def parse_size_billion(c: Column) -> Column:
    """Size in billions: ``7B`` is 7, ``500M`` is 0.5, a bare number stays; anything else is 0."""
    s = F.upper(F.replace(c, F.lit(" "), F.lit("")))
    plain = F.when(s.contains("B"), F.replace(s, F.lit("B"), F.lit("")).try_cast("double"))
    milli = F.when(s.contains("M"), F.replace(s, F.lit("M"), F.lit("")).try_cast("double") / 1000)
    bare = F.when(~s.contains("B") & ~s.contains("M"), s.try_cast("double"))
    return F.coalesce(plain, milli, bare, F.lit(0.0))


def month_index(c: Column) -> Column:
    """``Y/M/...`` as ``12 * Y + M``; null unless both parts are integers."""
    parts = F.split(c, "/")
    year = F.try_element_at(parts, F.lit(1)).try_cast("int")
    month = F.try_element_at(parts, F.lit(2)).try_cast("int")
    return year * 12 + month


def year_month(c: Column) -> Column:
    parts = F.split(c, "/")
    year = F.try_element_at(parts, F.lit(1)).try_cast("int")
    month = F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.when(year.isNotNull() & month.isNotNull(), F.struct(year.alias("year"), month.alias("month")))


def is_recent(time: Column, cutoff: str) -> Column:
    """Year and month at or after the cutoff; the day is ignored and an unreadable time is old."""
    return F.coalesce(month_index(time) >= month_index(F.lit(cutoff)), F.lit(False))


def digits_only(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c.cast("string"), r"[^\d]", "").try_cast("long"), F.lit(0).cast("long"))


def clip(c: Column, low: float, high: float) -> Column:
    """Like a numeric clip: null stays null (``least``/``greatest`` would skip it)."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def to_percent(score: Column, lo: Column, hi: Column) -> Column:
    return clip((score - lo) / (hi - lo) * 100, 0.0, 100.0)


def from_percent(score: Column, lo: Column, hi: Column) -> Column:
    return score / 100 * (hi - lo) + lo


def with_range(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Add ``lo``, ``hi`` and ``own_range`` per item; items without a range of their own get 0 to 100."""
    known = ranges.select("item", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    out = df.join(known, "item", "left")
    return (
        out.withColumn("lo", F.coalesce("_lo", F.lit(0.0)))
        .withColumn("hi", F.coalesce("_hi", F.lit(100.0)))
        .withColumn("own_range", F.col("_lo").isNotNull())
        .drop("_lo", "_hi")
    )


def drop_empty_fields(df: DataFrame, columns: Sequence[str]) -> Column:
    """Map of the fields that are not null, not an empty list and not equal to false (so 0 goes as well)."""
    entries = []
    for name in columns:
        kind = df.schema[name].dataType.typeName()
        c = F.col(name)
        if kind == "array":
            value = F.when(F.size(c) > 0, F.to_json(c))
        elif kind == "boolean":
            value = F.when(c, F.lit("true"))
        elif kind in ("string", "date", "timestamp"):
            value = c.cast("string")
        elif kind in ("map", "struct"):
            value = F.to_json(c)
        else:
            value = F.when(c != 0, c.cast("string"))
        entries.append(F.struct(F.lit(name).alias("key"), value.alias("value")))
    kept = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return F.map_from_entries(kept)


def hub_id(url: Column) -> Column:
    """Repository id after the hub host, up to a query mark, without trailing slashes."""
    tail = F.try_element_at(F.split(url, HUB_HOST.replace(".", r"\.") + "/"), F.lit(2))
    return F.regexp_replace(F.substring_index(tail, "?", 1), r"/+$", "")


def entity_links(url: Column, open_source: Column) -> Column:
    """Hub id, code address and main address. Ids and addresses are given for open entities only."""
    found = _blank_to_null(F.when(url.contains(HUB_HOST), hub_id(url)))
    code = F.when(url.contains(CODE_HOST) & ~url.contains(HUB_HOST), url)
    opened = F.coalesce(open_source == "Yes", F.lit(False))
    return F.struct(
        F.when(opened, found).alias("huggingface"),
        code.alias("code_url"),
        F.when(opened & found.isNotNull(), F.concat(F.lit(HUB_URL), found)).alias("main_url"),
    )


def readme_raw_url(url: Column) -> Column:
    owner = F.regexp_extract(url, CODE_REPOSITORY, 1)
    repo = F.replace(F.regexp_extract(url, CODE_REPOSITORY, 2), F.lit(".git"), F.lit(""))
    head, middle, tail = RAW_README.replace("{owner}", "\0").replace("{repo}", "\0").split("\0")
    return F.when(owner != "", F.concat(F.lit(head), owner, F.lit(middle), repo, F.lit(tail)))


def family_fallback(name: Column) -> Column:
    return F.substring_index(name, "-", 1)


def first_component(c: Column) -> Column:
    return _blank_to_null(F.trim(F.substring_index(c, "<br>", 1)))


def hype_level(mentions: Column) -> Column:
    return F.when(mentions < 5, "low").when(mentions < 20, "medium").otherwise("high")


def time_decay(release: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, release)
    return F.when(days <= 30, 1.0).when(days <= 90, 0.75).when(days <= 180, 0.5).otherwise(0.25)


def mention_confidence(mentions: Column, enough: int) -> Column:
    """Share of ``enough`` mentions, at most 1; ``enough`` is 30 for families and 50 for entities."""
    return F.least(mentions / enough, F.lit(1.0))


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.7, "Positive").when(score >= 0.4, "Neutral").otherwise("Negative")


def direction(adjustment: Column) -> Column:
    return F.when(adjustment > 0.5, "up").when(adjustment < -0.5, "down").otherwise("keep")


def parse_release_date(c: Column, as_of: Column) -> Column:
    """Date from ``Y/M/D`` or ``Y-M-D``; otherwise 30 days before ``as_of``."""
    slash = F.try_to_timestamp(c, F.lit("y/M/d")).cast("date")
    dash = F.try_to_timestamp(c, F.lit("y-M-d")).cast("date")
    return F.coalesce(slash, dash, F.date_sub(as_of, 30))


def standardize(score: Column, mu: Column, sigma: Column) -> Column:
    return (score - mu) / sigma


def unstandardize(score: Column, mu: Column, sigma: Column) -> Column:
    return score * sigma + mu


def name_size(name: Column) -> Column:
    """First ``number B`` in a name, 0 when there is none."""
    number = F.regexp_extract(name, NAME_SIZE, 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def fixed(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded from the exact binary value (``%.2f`` of other tools)."""
    return F.call_function("format_number", c, F.lit("0." + "0" * digits))
