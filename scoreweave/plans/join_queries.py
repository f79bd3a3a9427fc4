"""Joins, lookups and name matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreweave.operators import dimensions, evidence, matching, similar, split
from scoreweave.plans.registry import query, rounded
from scoreweave.plans.views import CUTOFF

# Fixed values of the stand-in data: an ordered list in which order, exact and contained names all matter.
PROFILES = (
    ("nation_2", "CN", "large", 0.9, True, ("language",)),
    ("NATION_21", "US", "large", 0.95, False, ("reasoning", "general")),
    ("NATION_1", "EU", "medium", 0.85, False, ("efficiency",)),
    ("The NATION_7 group", "AE", "small", 0.7, False, ()),
    ("NATION_8 Beijing", "JP", "large", 0.85, False, ("imaging",)),
)
REGION = """CASE WHEN {0} = 'NATION_21' THEN 'US' WHEN {0} LIKE '%NATION_2%' THEN 'CN' WHEN {0} LIKE '%NATION_1%' THEN 'EU' WHEN {0} = 'NATION_7' THEN 'AE' WHEN {0} = 'NATION_8' THEN 'JP'
    WHEN lower({0}) LIKE '%shanghai%' THEN 'CN' ELSE 'Unknown' END"""


@query("J1_align_targets", "SELECT t.entity, t.item, t.score FROM scores t WHERE t.entity IN (SELECT entity FROM train WHERE score < 8 AND item > 'Brand#2')")
def _(t):
    """Of all scores those of entities that have a low one in train: some entities have none."""
    return split.align_targets(t.scores, t.training.filter("score < 8 AND item > 'Brand#2'"))


@query(
    "J2_entity_profile_lookup",
    """SELECT entity, try_cast(regexp_extract(parameters, '([0-9.]+)', 1) AS DOUBLE) + CASE WHEN open_source THEN 1000 ELSE 0 END AS size,
    CASE WHEN open_source THEN organization END AS organization FROM entities""",
)
def _(t):
    # The feature table knows the open entities, under another size than the entities' own rows.
    bare = F.regexp_replace("parameters", "[BM]", "").cast("int")
    known = t.entities.filter("open_source").withColumn("parameters", F.concat((bare + 1000).cast("string"), F.lit("B")))
    return dimensions.profile_fields(t.entities, known)


@query(
    "J3_entity_family",
    """SELECT s.entity, e.organization, e.family, e.parameters FROM (SELECT DISTINCT entity FROM scores) s LEFT JOIN entities e ON s.entity = e.entity""",
)
def _(t):
    tree = t.entities.select("entity", "organization", "family", "parameters", "ord")
    late = tree.withColumn("family", F.lit("later")).withColumn("ord", F.col("ord") + 1_000_000_000)
    return dimensions.entity_family(t.scores.select("entity").distinct(), tree.unionByName(late))


_MAKERS = "SELECT DISTINCT organization FROM entities UNION SELECT DISTINCT concat(r_name, ' Shanghai') FROM region UNION SELECT ''"


@query(
    "J4_resolve_organization",
    f"""SELECT organization, CASE WHEN organization = '' THEN 'Unknown' ELSE {REGION.format("organization")} END AS region,
    CASE WHEN organization = '' THEN 0.5 ELSE CASE {REGION.format("organization")} WHEN 'US' THEN 0.95 WHEN 'EU' THEN 0.85 WHEN 'AE' THEN 0.7 WHEN 'JP' THEN 0.85 WHEN 'Unknown' THEN 0.6
      ELSE CASE WHEN organization LIKE '%NATION%' THEN 0.9 ELSE 0.7 END END END::DOUBLE AS credibility FROM ({_MAKERS}) x""",
)
def _(t):
    rows = t.sql(_MAKERS).withColumn("p", matching.organization_profile(F.col("organization"), PROFILES))
    return rows.select("organization", "p.region", "p.credibility")


_RESOLVE = """WITH names AS ({names}), keys AS ({keys}), hits AS (
  SELECT n.name, k.key, k.ord, CASE WHEN n.name = k.key THEN 0 WHEN {same} THEN 1 ELSE 2 END AS tier FROM names n JOIN keys k ON {match})
SELECT n.name, h.key, CAST(h.tier AS INT) AS tier FROM names n LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, ord, key) AS rn FROM hits) h ON n.name = h.name AND h.rn = 1"""

_COMPONENT_NAMES = """SELECT DISTINCT split_part(language_model, '<br>', 1) AS name FROM entities
  UNION SELECT DISTINCT lower(vision_model) FROM entities UNION SELECT DISTINCT organization FROM entities UNION SELECT DISTINCT substr(organization, 2, 3) FROM entities"""
_COMPONENT_KEYS = """SELECT key, -length(key) AS ord FROM (SELECT DISTINCT language_model AS key FROM entities
  UNION SELECT DISTINCT vision_model FROM entities UNION SELECT DISTINCT family FROM entities) x"""


def _names(t, text):
    return t.sql(text.replace("split_part(language_model, '<br>', 1)", "substring_index(language_model, '<br>', 1)"))


@query(
    "J5_resolve_component",
    _RESOLVE.format(names=_COMPONENT_NAMES, keys=_COMPONENT_KEYS, same="false", match="contains(lower(k.key), lower(n.name))"),
)
def _(t):
    return matching.resolve_component(_names(t, _COMPONENT_NAMES), t.sql(_COMPONENT_KEYS))


_ITEM_NAMES = "SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT lower(p_brand) FROM part UNION SELECT DISTINCT concat(p_type, ' v2') FROM part"
_ITEM_KEYS = "SELECT key, length(key) AS ord FROM (SELECT DISTINCT p_brand AS key FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part) x"


@query(
    "J6_resolve_item",
    _RESOLVE.format(names=_ITEM_NAMES, keys=_ITEM_KEYS, same="false", match="(contains(lower(k.key), lower(n.name)) OR contains(lower(n.name), lower(k.key)))"),
)
def _(t):
    return matching.resolve_item(t.sql(_ITEM_NAMES), t.sql(_ITEM_KEYS.replace("split_part(p_name, ' ', 1)", "substring_index(p_name, ' ', 1)")))


_ENTITY_NAMES = """SELECT DISTINCT lower(replace(p_name, ' ', '_')) AS name FROM part UNION SELECT DISTINCT p_type FROM part
  UNION SELECT DISTINCT concat('the ', p_name, ' one') FROM part UNION SELECT DISTINCT substr(p_name, 3, 5) FROM part"""
_ENTITY_KEYS = "SELECT key, -length(key) AS ord FROM (SELECT DISTINCT p_name AS key FROM part) x"
_NORM = "translate(lower({0}), ' _-.', '')"


@query(
    "J7_resolve_entity",
    _RESOLVE.format(
        names=_ENTITY_NAMES, keys=_ENTITY_KEYS,
        same=_NORM.format("n.name") + " = " + _NORM.format("k.key"),
        match=f"(contains({_NORM.format('k.key')}, {_NORM.format('n.name')}) OR contains({_NORM.format('n.name')}, {_NORM.format('k.key')}))",
    ).replace("translate(lower(n.name), ' _-.', '')", "regexp_replace(lower(n.name), '[ _.-]', '', 'g')").replace("translate(lower(k.key), ' _-.', '')", "regexp_replace(lower(k.key), '[ _.-]', '', 'g')"),
)
def _(t):
    return matching.resolve_entity(t.sql(_ENTITY_NAMES), t.sql(_ENTITY_KEYS))


_TIDY = "regexp_replace(lower(regexp_replace({0}, '\\s*\\([^)]*\\)', '', 'g')), '[-_.\\s]+', '', 'g')"


@query(
    "J8_match_repository",
    f"""WITH n AS (SELECT DISTINCT p_name AS name, {_TIDY.format("p_name")} AS a FROM part),
    r AS (SELECT repo, downloads, {_TIDY.format("split_part(repo, '/', 2)")} AS b FROM hub),
    c AS (SELECT name, repo, downloads, a = b AS exact, greatest(
        CASE WHEN contains(a, b) OR contains(b, a) THEN 100 - abs(length(a) - length(b)) ELSE 0 END,
        CASE WHEN ab = '' OR bb = '' THEN 0 WHEN ab = bb THEN 90 WHEN contains(ab, bb) OR contains(bb, ab) THEN 70 ELSE 0 END) AS score
      FROM (SELECT *, regexp_replace(a, '\\d+b?$', '') AS ab, regexp_replace(b, '\\d+b?$', '') AS bb FROM n, r) x),
    best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY exact DESC, CASE WHEN exact THEN 0 ELSE -score END, downloads DESC, repo) AS rn FROM c WHERE score > 50 OR exact)
    SELECT n.name, b.repo, b.exact FROM n LEFT JOIN best b ON n.name = b.name AND rn = 1""",
)
def _(t):
    return matching.match_repository(t.part.select(F.col("p_name").alias("name")), t.hub).select("name", "repo", "exact")


_DATASETS = "SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part UNION SELECT DISTINCT p_name FROM part"


@query(
    "J9_match_dataset",
    f"""WITH n AS (SELECT name, regexp_replace(lower(name), '[ _.-]', '', 'g') AS a FROM ({_DATASETS}) x),
    r AS (SELECT repo, downloads, regexp_replace(lower(split_part(repo, '/', 2)), '[ _.-]', '', 'g') AS b FROM hub),
    c AS (SELECT name, repo, downloads, CASE WHEN a = b THEN 0 WHEN starts_with(b, a) OR ends_with(b, a) THEN 1 ELSE 2 END AS tier FROM n JOIN r ON contains(b, a)),
    best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, downloads DESC, repo) AS rn FROM c)
    SELECT n.name, b.repo AS dataset, CAST(b.tier AS INT) AS tier FROM n LEFT JOIN best b ON n.name = b.name AND rn = 1""",
)
def _(t):
    names = t.sql(_DATASETS.replace("split_part(p_name, ' ', 1)", "substring_index(p_name, ' ', 1)"))
    return matching.match_dataset(names, t.hub.withColumnRenamed("repo", "dataset"))


# Search results of the stand-in data: for each first word of a part's name some repositories, in an order of their own.
_HITS = """SELECT subject, repo AS dataset, downloads, row_number() OVER (PARTITION BY subject ORDER BY md5(concat(subject, repo)), repo) AS position
    FROM (SELECT DISTINCT {0} AS subject FROM part UNION SELECT DISTINCT p_name FROM part) s JOIN hub h ON h.downloads % 7 = length(s.subject) % 7"""


@query(
    "J9_best_hit",
    f"""WITH h AS (SELECT *, regexp_replace(lower(subject), '[ _.-]', '', 'g') AS a, regexp_replace(lower(split_part(dataset, '/', 2)), '[ _.-]', '', 'g') AS b FROM ({_HITS.format("split_part(p_name, ' ', 1)")}) x),
    c AS (SELECT *, CASE WHEN a = b THEN 0 WHEN starts_with(b, a) OR ends_with(b, a) THEN 1 WHEN position = 1 AND contains(b, a) THEN 2 END AS tier FROM h),
    best AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY tier, CASE WHEN tier = 1 THEN -downloads ELSE 0 END, position) AS rn FROM c WHERE tier IS NOT NULL)
    SELECT s.subject, best.dataset, CAST(best.tier AS INT) AS tier FROM (SELECT DISTINCT subject FROM h) s LEFT JOIN best ON best.subject = s.subject AND rn = 1""",
)
def _(t):
    return matching.best_hit(t.sql(_HITS.format("substring_index(p_name, ' ', 1)")))


# Fixed values of the stand-in data: the second rule needs a lookahead, the last one is hidden by the first.
RULES = (
    ("Sixteen build", r"NATION_16-BUILD.*", "A"),
    ("Sixteen", r"NATION_16-(?!MACH).*", "B"),
    ("Teens", r"NATION_1\d-\w+", "C"),
    ("Any furniture", r".*FURNITURE|NATION_16-BUILDING", "D"),
)
_RULED = """CASE WHEN family LIKE 'NATION_16-BUILD%' THEN {0} WHEN family LIKE 'NATION_16-%' AND family NOT LIKE '%-MACH%' THEN {1}
    WHEN regexp_matches(family, '^NATION_1[0-9]-[A-Z]+') THEN {2} WHEN family LIKE '%FURNITURE%' THEN {3} ELSE {4} END"""


_RULED_SQL = f"""SELECT family AS entity, {_RULED.format("'Sixteen build'", "'Sixteen'", "'Teens'", "'Any furniture'", "split_part(family, '-', 1)")} AS family,
    {_RULED.format("'A'", "'B'", "'C'", "'D'", "NULL")} AS rule_organization FROM (SELECT DISTINCT family FROM entities) x"""


@query("J10_assign_family", _RULED_SQL)
def _(t):
    names = t.entities.select(F.col("family").alias("entity")).distinct()
    return matching.assign_family(names, RULES)


@query("J10_rule_table", _RULED_SQL)
def _(t):
    names = t.entities.select(F.col("family").alias("entity")).distinct()
    rules = t.spark.createDataFrame([(k, *r) for k, r in enumerate(RULES)], "rule_no long, family string, pattern string, organization string")
    return matching.assign_family(names, rules)


@query(
    "J11_family_scores",
    """SELECT t.entity, t.item, e.family, count(s.score) AS sibling_count, round(avg(s.score), 10) AS sibling_mean, min(s.score) AS sibling_min, max(s.score) AS sibling_max
    FROM test_cells t JOIN entities e ON t.entity = e.entity
    LEFT JOIN (SELECT tr.entity, tr.item, tr.score, m.family FROM train tr JOIN entities m ON tr.entity = m.entity) s
      ON s.family = e.family AND s.item = t.item AND s.entity <> t.entity GROUP BY 1, 2, 3""",
)
def _(t):
    out = evidence.sibling_summary(t.held_out.select("entity", "item"), t.entities, t.training)
    return out.withColumn("sibling_mean", rounded("sibling_mean", 10))


@query(
    "J11_family_members_all_cells",
    """SELECT s.entity, s.item, e.family, count(o.score) AS sibling_count, round(avg(o.score), 10) AS sibling_mean, min(o.score) AS sibling_min, max(o.score) AS sibling_max
    FROM scores s JOIN entities e ON s.entity = e.entity
    LEFT JOIN (SELECT x.entity, x.item, x.score, m.family FROM scores x JOIN entities m ON x.entity = m.entity) o
      ON o.family = e.family AND o.item = s.item AND o.entity <> s.entity GROUP BY 1, 2, 3""",
)
def _(t):
    out = evidence.sibling_summary(t.scores.select("entity", "item"), t.entities, t.scores)
    return out.withColumn("sibling_mean", rounded("sibling_mean", 10))


@query("J12_restrict_to_leaderboard", "SELECT entity, family FROM entities WHERE entity IN (SELECT entity FROM scores)")
def _(t):
    return dimensions.restrict_to_leaderboard(t.entities, t.scores).select("entity", "family")


@query(
    "J13_resume",
    """SELECT entity, item FROM scores s WHERE NOT EXISTS (SELECT 1 FROM test_cells t WHERE t.entity = s.entity AND t.item = s.item)""",
)
def _(t):
    return split.resume(t.scores.select("entity", "item"), t.held_out)


@query(
    "J13_described_documents",
    "SELECT d.doc_id FROM documents d WHERE length(d.text) <= 500 OR d.text IS NULL",
)
def _(t):
    done = split.described(t.documents, "text", 500)
    return split.resume(t.documents.select("doc_id"), done, ["doc_id"])


@query(
    "J14_item_subcategories",
    """SELECT i.item, CASE WHEN i.n_subcategories % 3 = 0 THEN string_agg(DISTINCT 'listed', ',') WHEN i.n_subcategories % 3 = 1 THEN 'variant'
    ELSE (SELECT string_agg(DISTINCT p_type, ',' ORDER BY p_type) FROM part WHERE p_brand = i.item) END AS subcategories FROM items i GROUP BY i.item, i.n_subcategories""",
)
def _(t):
    def given(condition, label):
        return t.items.select("item", F.when(F.expr(condition), F.array(F.lit(label))).otherwise(F.array().cast("array<string>")).alias("subcategories"))

    found = t.part.groupBy(F.col("p_brand").alias("item")).agg(F.sort_array(F.collect_set("p_type")).alias("subcategories"))
    out = dimensions.item_subcategories(
        t.items, given("n_subcategories % 3 = 0", "listed"), given("n_subcategories % 3 < 2", "variant"), found
    )
    return out.select("item", F.array_join("subcategories", ",").alias("subcategories"))


NEIGHBOURS = """ranked AS MATERIALIZED (SELECT item, entity, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, entity) AS rank, count(*) OVER (PARTITION BY item) AS n FROM train),
    near AS MATERIALIZED (SELECT p.entity, p.item, r.rank, r.n, row_number() OVER (PARTITION BY p.entity, p.item ORDER BY abs(r.score - p.prediction), r.rank) AS rn
      FROM predictions p JOIN ranked r ON p.item = r.item WHERE r.n >= 3),
    peers AS MATERIALIZED (SELECT q.entity, q.item, q.rank AS predicted_rank, q.n AS n_ranked, r.rank, r.entity AS peer, r.score AS peer_score
      FROM near q JOIN ranked r ON r.item = q.item AND r.rank BETWEEN q.rank - 4 AND q.rank + 4 WHERE q.rn = 1)"""


@query("J15_rank_neighbours", f"WITH {NEIGHBOURS} SELECT * FROM peers")
def _(t):
    return evidence.rank_neighbours(t.predicted, t.training)


def details(t):
    tree = t.entities.withColumn("technical_summary", F.repeat("family", 20))
    vision = t.sql("SELECT DISTINCT vision_model AS component, 'maker' AS organization FROM entities WHERE vision_model > 'VM-B'")
    return evidence.neighbour_details(evidence.rank_neighbours(t.predicted, t.training), tree, PROFILES, vision)


@query(
    "J16_neighbour_details",
    f"""WITH {NEIGHBOURS} SELECT p.entity, p.item, p.rank, p.peer, e.organization,
    {REGION.format("e.organization")} AS region,
    CASE WHEN e.vision_model > 'VM-B' THEN 'maker' ELSE 'Unknown' END AS vision_model_organization,
    coalesce(e.release_date, 'Unknown') AS release_date, repeat(e.family, 20) AS technical_summary
    FROM peers p JOIN entities e ON p.peer = e.entity""",
)
def _(t):
    return details(t).select(
        "entity", "item", "rank", "peer", "organization", "region", "vision_model_organization", "release_date", "technical_summary"
    )


# Profile of an entity: its size and which organization it belongs to, as one dense vector.
_PROFILE = """profile AS (SELECT entity, organization, coalesce(release_date >= '2001/07', false) AS recent,
    try_cast(regexp_extract(parameters, '([0-9.]+)', 1) AS DOUBLE) / 100 AS size FROM entities)"""


def profile_vectors(t):
    from scoreweave.functions.fields import is_recent
    from scoreweave.session import cut_lineage

    t.keep("entities")
    features = ["size"] + [f"organization={r[0]}" for r in t.nation.select("n_name").collect()]  # 25 nations
    dense = dimensions.dense_profiles(dimensions.entity_profiles(dimensions.profile_fields(t.entities, t.entities)), features)
    flag = t.entities.select(F.col("entity").alias("id"), is_recent(F.col("release_date"), CUTOFF).alias("recent"))
    rows = cut_lineage(dense.join(flag, "id"))  # both sides of the search are read again and again
    return rows.filter("recent").drop("recent"), rows.filter("NOT recent").drop("recent")


SIMILAR = f"""{_PROFILE},
    pairs AS (SELECT a.entity AS id, b.entity AS known_id,
      round((a.size * b.size + CASE WHEN a.organization = b.organization THEN 1 ELSE 0 END)
        / ((sqrt(a.size * a.size + 1) + 1e-8) * (sqrt(b.size * b.size + 1) + 1e-8)), 9) AS s
      FROM profile a, profile b WHERE a.recent AND NOT b.recent),
    best AS (SELECT id, known_id, s AS similarity, row_number() OVER (PARTITION BY id ORDER BY s DESC, known_id) AS rank FROM pairs)"""


@query("J17_top_k_similar", f"WITH {SIMILAR} SELECT id, known_id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM best WHERE rank <= 5")
def _(t):
    new, known = profile_vectors(t)
    return similar.top_k_similar(new, known).withColumn("similarity", rounded("similarity"))


@query(
    "J17_similar_embeddings",
    """WITH dims AS (SELECT label, i, avg(embedding[i]) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) r GROUP BY 1, 2),
    pairs AS (SELECT CAST(d.label AS VARCHAR) AS id, CAST(e.vec_id AS VARCHAR) AS known_id,
      round(sum(d.x * e.embedding[d.i]) / ((sqrt(sum(d.x * d.x)) + 1e-8) * (sqrt(sum(CAST(e.embedding[d.i] AS DOUBLE) * e.embedding[d.i])) + 1e-8)), 9) AS s
      FROM dims d, embeddings e GROUP BY 1, 2),
    best AS (SELECT id, known_id, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, known_id) AS rank FROM pairs)
    SELECT id, known_id, round(s, 5) AS similarity, CAST(rank AS INT) AS rank FROM best WHERE rank <= 5""",
)
def _(t):
    centres = t.embeddings.groupBy(F.col("label").cast("string").alias("id")).agg(
        F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(64)]).alias("vec")
    )
    known = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return similar.top_k_similar(centres, known).withColumn("similarity", rounded("similarity", 5))


@query("J17_hashed_recall", "SELECT 5 * count(*) AS asked, count(*) AS vectors, true AS reached FROM embeddings")
def _(t):
    """Neighbours from hashed buckets against the exact ones, for every vector: at least nine tenths are found."""
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    exact = similar.top_k_similar(vectors, vectors, 5)
    hashed = similar.top_k_similar(vectors, vectors, 5, hashing=similar.Hashing(bucket=32))
    both = exact.join(hashed.select("id", "known_id", F.lit(1).alias("hit")), ["id", "known_id"], "left")
    return both.agg(
        F.count(F.lit(1)).alias("asked"), F.count_distinct("id").alias("vectors"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("reached")
    )


@query(
    "J18_listings",
    """SELECT 'in organization' AS kind, entity AS name, CAST(1 AS BIGINT) AS n FROM entities WHERE contains(lower(organization), 'nation_1')
    UNION ALL SELECT 'open', entity, 1 FROM entities WHERE open_source
    UNION ALL SELECT 'family', family, count(*) FROM entities GROUP BY family, organization
    UNION ALL SELECT 'family here', family, count(*) FROM entities WHERE contains(lower(organization), 'ion_2') GROUP BY family, organization""",
)
def _(t):
    def rows(df, kind, name, n=F.lit(1).cast("long")):
        return df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), n.alias("n"))

    e, n = t.entities, F.col("n_entities")
    out = rows(dimensions.org_entities(e, "Nation_1"), "in organization", "entity")
    out = out.unionByName(rows(dimensions.open_source_entities(e), "open", "entity"))
    out = out.unionByName(rows(dimensions.list_families(e), "family", "family", n))
    return out.unionByName(rows(dimensions.list_families(e, "ION_2"), "family here", "family", n))
