"""Name resolution: exact and containment joins, repository and dataset matching, rule lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.functions.fields import family_fallback
from scoreweave.functions.text import TRAILING_SIZE, normalize_name
from scoreweave.session import cut_lineage

_GRAM = 3  # characters of a needle that are looked up before the needle itself
_PIECE = 8192  # characters of a text that one row covers; more if a needle is longer
_WINDOW = 256  # characters whose places one row looks up
_MAX_RULES = 200  # rules that become one expression; more are joined as a table
_MAX_PROFILES = 2000  # profiles of one expression; with_organization_profile takes any number
_RULES_ROW = 256  # rules of one beginning in one row of their table

# Words that place an organization without a profile, and the profiles of such organizations.
REGION_WORDS = ("china", "chinese", "beijing", "shanghai", "shenzhen", "tsinghua", "peking")
NO_NAME_PROFILE = ("Unknown", "unknown", 0.50, False)
REGION_WORD_PROFILE = ("CN", "small", 0.70, True)
OTHER_PROFILE = ("Unknown", "small", 0.60, False)


def containments(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """All ``(needle, hay, sides)`` with a needle of ``needles(text, sides)`` inside a text of ``hays(text, sides)``.

    ``sides`` are bits: a needle is looked for in the texts it shares a bit with, and the result has the shared bits.
    So several searches, and both directions of one, take one pass. Empty and null texts match nothing.

    No theta join. Each needle is found by its rarest gram of three characters: a table of how often grams occur in the
    texts names it. Texts are cut into overlapping pieces; each place in a piece looks its gram up once, and where it
    is some needle's rarest, the characters there that such a needle would cover are compared with the needles by
    equality. Shuffles carry places and short strings, never the texts of both sides, and work grows with the texts
    and with what is found, however common a character is.
    """
    sized = lambda df: df.filter("text <> ''").groupBy("text").agg(F.bit_or(F.col("sides").cast("long")).alias("sides"))
    h = cut_lineage(sized(hays).withColumn("hid", F.unhex(F.md5(F.col("text").cast("binary")))))
    most = h.agg(F.coalesce(F.max(F.length("text")), F.lit(0))).first()[0]
    n = cut_lineage(sized(needles).withColumn("len", F.length("text")).filter(F.col("len") <= most))
    longest, shortest = n.agg(F.coalesce(F.max("len"), F.lit(1)), F.coalesce(F.min("len"), F.lit(_GRAM))).first()
    step = max(_PIECE, longest)
    begin = F.greatest(F.lit(0), F.col("k") * step - longest)
    pieces = h.select("hid", "sides", "text", F.explode(F.sequence(F.lit(0), F.expr(f"(length(text) - 1) div {step}").cast("int"))).alias("k"))
    pieces = pieces.select("hid", "sides", "k", F.substr("text", begin + 1, F.lit(step + 2 * longest)).alias("piece"), (F.col("k") * step - begin).alias("own"))

    # Grams are read from short windows: a place in a long text costs the way to it.
    length = F.least(F.lit(step), F.length("piece") - F.col("own"))
    windows = pieces.withColumn("n", length)
    windows = windows.select("hid", "sides", "k", "piece", "own", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {_WINDOW}").cast("int"))).alias("w"))
    at = F.col("own") + F.col("w") * _WINDOW
    windows = windows.select("hid", "sides", "k", at.alias("first"), F.least(F.lit(_WINDOW), F.col("n") - F.col("w") * _WINDOW).alias("n"), F.substr("piece", at + 1, F.lit(_WINDOW + _GRAM - 1)).alias("window"))

    def grams(width: int) -> Column:
        """The grams of a window's own places."""
        last = F.least(F.col("n"), F.length("window") - width + 1) - 1
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct((F.col("first") + i).alias("at"), F.substr("window", i + 1, F.lit(width)).alias("gram")))

    # Needles of up to three characters are their own gram; their widths are looked at only if there are such needles.
    every = F.concat(*[grams(w) for w in range(min(shortest, _GRAM), _GRAM + 1)])
    spots = windows.select("hid", "sides", "k", F.explode(every).alias("s")).select("hid", "sides", "k", "s.at", "s.gram")
    short = spots.join(n.filter(F.col("len") <= _GRAM).select(F.col("text").alias("gram")), "gram", "left_semi").select("hid", "sides", F.col("gram").alias("needle")).distinct()
    width = F.lit(_GRAM)
    n, whole = n.filter(F.col("len") > _GRAM), n
    own = F.transform(F.sequence(F.lit(0), F.col("len") - width), lambda o: F.struct(o.alias("off"), F.substr("text", o + 1, width).alias("gram")))
    parts = n.select("text", "len", F.explode(own).alias("g")).select("text", "len", "g.off", "g.gram")
    often = spots.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rank = F.struct(F.coalesce("often", F.lit(0)).alias("often"), "off", "gram")
    rarest = parts.join(often, "gram", "left").groupBy("text", "len").agg(F.min(rank).alias("r")).filter("r.often > 0")
    anchors = cut_lineage(rarest.groupBy("r.gram").agg(F.collect_set(F.struct("r.off", "len")).alias("forms")))
    hits = spots.join(anchors, "gram").select("hid", "k", "at", F.explode("forms").alias("f"))
    hits = hits.select("hid", "k", F.struct((F.col("at") - F.col("f.off")).alias("start"), F.col("f.len").alias("len")).alias("cut")).filter("cut.start >= 0")
    cuts = hits.groupBy("hid", "k").agg(F.collect_set("cut").alias("cuts"))
    words = F.array_distinct(F.transform("cuts", lambda c: F.substr("piece", c["start"] + 1, c["len"])))
    found = pieces.join(cuts, ["hid", "k"]).select("hid", "sides", F.explode(words).alias("needle")).unionByName(short)
    wanted = whole.select(F.col("text").alias("needle"), F.col("sides").alias("wanted"))
    shared = F.col("sides").bitwiseAND(F.col("wanted"))
    pairs = found.join(wanted, "needle").filter(shared != 0).select("needle", "hid", shared.alias("sides")).distinct()
    return pairs.join(h.select("hid", F.col("text").alias("hay")), "hid").select("needle", "hay", "sides")


def contained_pairs(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """All pairs ``(needle, hay)`` of distinct, non-empty strings with the needle inside the hay; see ``containments``."""
    one = lambda df: df.select(F.col(df.columns[0]).alias("text"), F.lit(1).alias("sides"))
    return containments(one(needles), one(hay)).select("needle", "hay")


def resolve(
    names: DataFrame,
    dictionary: DataFrame,
    *,
    normalize=F.lower,
    both_ways: bool = True,
    normalized_exact: bool = False,
) -> DataFrame:
    """Map each ``name`` to one ``key`` of ``dictionary(key, ord)``; names without a match keep a null key.

    Tiers: the very same text; with ``normalized_exact`` equal normalised text; then containment of
    normalised texts, either way or only name in key. Within a tier the lowest ``ord`` wins.
    """
    wanted = names.select("name").distinct().withColumn("_n", normalize(F.col("name")))
    keys = dictionary.select("key", "ord", normalize(F.col("key")).alias("_k"))
    hits = wanted.join(keys, F.col("name") == F.col("key")).select("name", F.lit(0).alias("tier"), "ord", "key")
    if normalized_exact:
        same = wanted.join(keys.filter("_k <> ''"), F.col("_n") == F.col("_k"))
        hits = hits.unionByName(same.select("name", F.lit(1).alias("tier"), "ord", "key"))
    first = keys.groupBy("_k").agg(F.min(F.struct("ord", "key")).alias("best"))
    side = lambda df, c, bits: df.select(F.col(c).alias("text"), F.lit(bits).alias("sides"))
    if both_ways:
        pairs = containments(side(wanted, "_n", 1).unionByName(side(keys, "_k", 2)), side(keys, "_k", 1).unionByName(side(wanted, "_n", 2)))
        inside = F.col("sides").bitwiseAND(F.lit(1)) != 0
        around = F.col("sides").bitwiseAND(F.lit(2)) != 0
        both = F.array(F.when(inside, F.struct(F.col("needle").alias("_n"), F.col("hay").alias("_k"))), F.when(around, F.struct(F.col("hay").alias("_n"), F.col("needle").alias("_k"))))
        near = pairs.select(F.explode(F.array_compact(both)).alias("p")).select("p.*")
    else:
        near = contained_pairs(wanted.select("_n"), keys.select("_k")).toDF("_n", "_k")
    best = near.join(first, "_k").groupBy("_n").agg(F.min("best").alias("best"))
    contained = wanted.join(best, "_n").select("name", F.lit(2).alias("tier"), "best.ord", "best.key")
    found = hits.unionByName(contained).groupBy("name").agg(F.min(F.struct("tier", "ord", "key")).alias("m"))
    return wanted.join(found, "name", "left").select("name", F.col("m.key").alias("key"), F.col("m.tier").alias("tier"))


def resolve_component(names: DataFrame, components: DataFrame) -> DataFrame:
    return resolve(names, components, both_ways=False)


def resolve_item(names: DataFrame, items: DataFrame) -> DataFrame:
    return resolve(names, items)


def resolve_entity(names: DataFrame, entities: DataFrame) -> DataFrame:
    return resolve(names, entities, normalize=normalize_name, normalized_exact=True)


def organization_profile(name: Column, profiles: Sequence[tuple]) -> Column:
    """Profile of an organization as a struct; ``profiles`` is the user's short ordered list of
    ``(name, region, size, credibility, local_focus, specialties)``.

    The list is a constant of the program, so it becomes one expression and no join at all.
    """
    if len(profiles) > _MAX_PROFILES:
        raise ValueError(f"{len(profiles)} profiles; with_organization_profile takes a table of any length")

    def struct(region, size, credibility, focus, specialties=()):
        words = F.array(*[F.lit(s) for s in specialties]).cast("array<string>")
        return F.struct(
            F.lit(region).alias("region"),
            F.lit(size).alias("size"),
            F.lit(float(credibility)).alias("credibility"),
            F.lit(focus).alias("local_focus"),
            words.alias("specialties"),
        )

    low = F.lower(name)
    out = F.when(name.isNull() | (name == ""), struct(*NO_NAME_PROFILE))
    for profile in profiles:
        out = out.when(name == profile[0], struct(*profile[1:]))
    for profile in profiles:
        key = profile[0].lower()
        out = out.when(low.contains(key) | F.lit(key).contains(low), struct(*profile[1:]))
    worded = reduce(lambda a, b: a | b, [low.contains(w) for w in REGION_WORDS])
    return out.when(worded, struct(*REGION_WORD_PROFILE)).otherwise(struct(*OTHER_PROFILE))


def with_organization_profile(df: DataFrame, column: str, profiles: DataFrame, out: str = "profile") -> DataFrame:
    """``df`` with the profile of the organization in ``column`` as a struct, from a table of any length
    ``profiles(name, ord, region, size, credibility, local_focus, specialties)``; the rules of ``organization_profile``.

    Names are resolved once each, by the containment join; rows then meet their profile by the name.
    """
    fields = ("region", "size", "credibility", "local_focus", "specialties")
    types = "struct<region:string,size:string,credibility:double,local_focus:boolean,specialties:array<string>>"
    wide = lambda fixed: F.struct(*[F.lit(x).alias(f) for f, x in zip(fields, fixed, strict=False)], F.array().cast("array<string>").alias("specialties")).cast(types)
    known = profiles.groupBy("name").agg(F.min_by(F.struct("ord", F.struct(*fields).cast(types).alias("p")), "ord").alias("first"))
    names = df.select(F.col(column).alias("name")).filter("name <> ''").distinct()
    found = resolve(names, known.select(F.col("name").alias("key"), "first.ord"))
    found = found.join(known.select(F.col("name").alias("key"), F.col("first.p").alias("_profile")), "key").select(F.col("name").alias("_name"), "_profile")
    worded = reduce(lambda a, b: a | b, [F.lower(column).contains(w) for w in REGION_WORDS])
    rest = F.when(F.col(column).isNull() | (F.col(column) == ""), wide(NO_NAME_PROFILE)).when(worded, wide(REGION_WORD_PROFILE)).otherwise(wide(OTHER_PROFILE))
    return df.join(found, F.col(column) == F.col("_name"), "left").select(*df.columns, F.coalesce("_profile", rest).alias(out))


def literal_prefix(pattern: Column) -> Column:
    """Characters that every match of the pattern from the start of a name begins with; empty if there may be none."""
    plain = F.regexp_extract(pattern, r"^((?:[A-Za-z0-9 _/:,=#@~-]|\\[^A-Za-z0-9])*)", 1)
    after = F.substring(pattern, F.length(plain) + 1, F.lit(1))
    # A quantifier that allows none takes the character before it away.
    kept = F.when(after.isin("*", "?", "{"), F.regexp_replace(plain, r"(?:\\)?.$", "")).otherwise(plain)
    return F.when(pattern.contains("|"), "").otherwise(F.regexp_replace(kept, r"\\(.)", "$1"))


def assign_family(entities: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Add ``family`` and ``rule_organization``: the first rule ``(family, pattern, organization)`` that
    matches from the start of the name, else the text before the first dash and no organization.

    A short list becomes one expression. A longer one, or a table ``rules(rule_no, family, pattern, organization)``, is
    joined: names meet the rules whose literal beginning they share, and only those patterns are tried.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= _MAX_RULES:
            return _assign_by_list(entities, rules)
        rows = [(k, *map(str, rule)) for k, rule in enumerate(rules)]
        rules = entities.sparkSession.createDataFrame(rows, "rule_no long, family string, pattern string, organization string")
    rule = F.struct("rule_no", "family", "organization", F.concat(F.lit("^(?:"), "pattern", F.lit(")")).alias("pattern"))
    indexed = rules.select(literal_prefix(F.col("pattern")).alias("prefix"), F.col("rule_no").alias("no"), rule.alias("rule"))
    # Rules of one beginning in rows of at most some hundreds.
    indexed = cut_lineage(indexed.groupBy("prefix", F.expr(f"no div {_RULES_ROW}").alias("part")).agg(F.sort_array(F.collect_list("rule")).alias("rules")))
    longest = indexed.select(F.coalesce(F.max(F.length("prefix")), F.lit(0))).scalar()
    names = entities.select("entity").filter("entity IS NOT NULL").distinct()
    starts = names.select("entity", F.explode(F.sequence(F.lit(0), F.least(F.length("entity"), longest))).alias("n"))
    met = starts.select("entity", F.substring("entity", F.lit(1), F.col("n")).alias("prefix")).join(indexed, "prefix")
    first = F.get(F.filter("rules", lambda r: F.rlike(F.col("entity"), r["pattern"])), F.lit(0))
    best = met.select("entity", first.alias("hit")).groupBy("entity").agg(F.min_by("hit", "hit.rule_no").alias("hit"))
    out = entities.join(best.withColumnRenamed("entity", "_entity"), F.col("entity") == F.col("_entity"), "left")
    return out.select(
        *entities.columns, F.coalesce("hit.family", family_fallback(F.col("entity"))).alias("family"), F.col("hit.organization").alias("rule_organization")
    )


def _assign_by_list(entities: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    family, organization = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, org in reversed(list(rules)):
        hit = F.col("entity").rlike(f"^(?:{pattern})")
        family = F.when(hit, F.lit(name)).otherwise(family)
        organization = F.when(hit, F.lit(org)).otherwise(organization)
    return entities.withColumn("family", F.coalesce(family, family_fallback(F.col("entity")))).withColumn(
        "rule_organization", organization
    )


def match_repository(names: DataFrame, repositories: DataFrame) -> DataFrame:
    """Best repository per ``name`` among ``repositories(repo, downloads)``.

    Equal normalised names win; otherwise a score: 100 less the difference in length when one contains the
    other, at least 90 when both agree without a trailing size, at least 70 when one then contains the
    other. Scores above 50 count; ties go to more downloads, then to the repository id.
    """

    def bare(c):
        return F.regexp_replace(c, TRAILING_SIZE, "")

    wanted = names.select("name").distinct()
    wanted = wanted.withColumn("_n", normalize_name(F.substring_index("name", "(", 1), strip_parens=True))
    wanted = wanted.withColumn("_nb", bare(F.col("_n")))
    repos = repositories.withColumn("_r", normalize_name(F.substring_index("repo", "/", -1), strip_parens=True))
    # One row per normalised name: copies of a name cannot multiply the pairs below.
    repos = repos.groupBy("_r").agg(F.min(F.struct((-F.col("downloads")).alias("less"), "repo")).alias("top"))
    repos = repos.withColumn("_rb", bare(F.col("_r")))
    # Whole names and bases, names in repositories and repositories in names: one pass over all four.
    side = lambda df, c, bits: df.select(F.col(c).alias("text"), F.lit(bits).alias("sides"))
    wants = side(wanted, "_n", 1).unionByName(side(repos, "_r", 2)).unionByName(side(wanted, "_nb", 4)).unionByName(side(repos, "_rb", 8))
    texts = side(repos, "_r", 1).unionByName(side(wanted, "_n", 2)).unionByName(side(repos, "_rb", 4)).unionByName(side(wanted, "_nb", 8))
    pairs = cut_lineage(containments(wants, texts))

    def either_way(bit: int, a: str, b: str) -> DataFrame:
        has = lambda x: F.col("sides").bitwiseAND(F.lit(x)) != 0
        one = pairs.filter(has(bit)).select(F.col("needle").alias(a), F.col("hay").alias(b))
        return one.unionByName(pairs.filter(has(2 * bit)).select(F.col("hay").alias(a), F.col("needle").alias(b))).distinct()

    def order(exact, score):
        return F.struct(
            (~exact).alias("inexact"),
            F.when(exact, 0).otherwise(-score).alias("lower"),
            F.col("top.less").alias("less"),
            F.col("top.repo").alias("repo"),
        )

    exact = F.col("_n") == F.col("_r")
    score = 100 - F.abs(F.length("_n") - F.length("_r"))
    whole = either_way(1, "_n", "_r").filter((score > 50) | exact).join(repos, "_r")
    whole = whole.groupBy("_n").agg(F.min(order(exact, score)).alias("b"))
    # Names that share a base share their best match by base: one row per base, never all members of both.
    bases = repos.groupBy("_rb").agg(F.min("top").alias("top"))
    same = F.when(F.col("_nb") == F.col("_rb"), 90).otherwise(70)
    based = either_way(4, "_nb", "_rb").join(bases, "_rb")
    based = based.groupBy("_nb").agg(F.min(order(F.lit(False), same)).alias("b"))
    found = wanted.join(whole, "_n").select("name", "b").unionByName(wanted.join(based, "_nb").select("name", "b"))
    best = found.groupBy("name").agg(F.min("b").alias("b"))
    return wanted.join(best, "name", "left").select(
        "name", F.col("b.repo").alias("repo"), (-F.col("b.lower")).alias("score"), (~F.col("b.inexact")).alias("exact")
    )


def _dataset_name(c: str) -> Column:
    return normalize_name(F.substring_index(c, "/", -1))


def match_dataset(names: DataFrame, datasets: DataFrame) -> DataFrame:
    """Best dataset per ``name`` in a whole catalog ``datasets(dataset, downloads)``: equal normalised name, else one
    that starts or ends with the name, else one that contains it; more downloads first, then the id. A catalog has no
    order of hits; for the results of a search use ``best_hit``."""
    wanted = names.select("name").distinct().withColumn("_n", normalize_name(F.col("name")))
    sets = datasets.withColumn("_d", _dataset_name("dataset"))
    sets = sets.groupBy("_d").agg(F.min(F.struct((-F.col("downloads")).alias("less"), "dataset")).alias("top"))
    pairs = contained_pairs(wanted.select("_n"), sets.select("_d")).toDF("_n", "_d")
    tier = (
        F.when(F.col("_n") == F.col("_d"), 0)
        .when(F.col("_d").startswith(F.col("_n")) | F.col("_d").endswith(F.col("_n")), 1)
        .otherwise(2)
    )
    best = (
        pairs.join(sets, "_d")
        .groupBy("_n")
        .agg(F.min(F.struct(tier.alias("tier"), "top.less", "top.dataset")).alias("b"))
    )
    return wanted.join(best, "_n", "left").select(
        "name", F.col("b.dataset").alias("dataset"), F.col("b.tier").alias("tier")
    )


def best_hit(hits: DataFrame) -> DataFrame:
    """Best dataset per ``subject`` among its search results ``hits(subject, dataset, downloads, position)``.

    The first hit with an equal normalised name; else, of those that start or end with the name, the one with most
    downloads (then the earlier one); else the first hit of all, if it contains the name. One aggregation, no pairs.
    """
    n, d = normalize_name(F.col("subject")), _dataset_name("dataset")
    rows = hits.select("subject", "dataset", "downloads", "position", n.alias("_n"), d.alias("_d"))
    equal = F.col("_n") == F.col("_d")
    near = F.col("_d").startswith(F.col("_n")) | F.col("_d").endswith(F.col("_n"))
    best = rows.groupBy("subject").agg(
        F.min(F.when(equal, F.struct("position", "dataset"))).alias("same"),
        F.min(F.when(near, F.struct((-F.col("downloads")).alias("less"), "position", "dataset"))).alias("near"),
        F.min(F.struct("position", "dataset", F.col("_d").contains(F.col("_n")).alias("holds"))).alias("lead"),
    )
    lead = F.when(F.col("lead.holds"), F.col("lead.dataset"))
    tier = F.when(F.col("same").isNotNull(), 0).when(F.col("near").isNotNull(), 1).when(F.col("lead.holds"), 2)
    return best.select("subject", F.coalesce("same.dataset", "near.dataset", lead).alias("dataset"), tier.alias("tier"))


def unique_hits(hits: DataFrame) -> DataFrame:
    """Search hits once per (subject, id), at their first position; hits without an id are dropped."""
    return hits.filter("id <> ''").groupBy("subject", "id").agg(F.min("position").alias("position"))
