"""Names, documents and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreweave.functions import text
from scoreweave.operators import dimensions, evidence
from scoreweave.plans.registry import query
from scoreweave.sources import knowledge


@query(
    "F1_normalize_name",
    """SELECT repo, regexp_replace(lower(regexp_replace(concat(repo, ' (v2)'), '\\s*\\([^)]*\\)', '', 'g')), '[-_.\\s]+', '', 'g') AS without_remarks,
    regexp_replace(lower(concat(repo, ' (v2)')), '[ _.-]', '', 'g') AS plain FROM hub""",
)
def _(t):
    name = F.concat("repo", F.lit(" (v2)"))
    return t.hub.select("repo", text.normalize_name(name, True).alias("without_remarks"), text.normalize_name(name).alias("plain"))


@query(
    "F2_search_terms",
    """WITH b AS (SELECT DISTINCT name, trim(split_part(name, '(', 1)) AS base FROM (SELECT concat(p_name, ' v', cast(p_size AS string), ' (x)') AS name FROM part) x),
    s AS (SELECT name, base AS term, 1 AS pos FROM b UNION ALL SELECT name, replace(base, ' ', '-'), 2 FROM b UNION ALL SELECT name, replace(base, '-', ' '), 3 FROM b
      UNION ALL SELECT name, regexp_replace(base, '[-_]?[vV]?[0-9]+\\.?[0-9]*[-_]?', '', 'g'), 4 FROM b),
    d AS (SELECT name, term, min(pos) AS pos FROM s GROUP BY name, term), o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS rn FROM d)
    SELECT name, string_agg(trim(term), '|' ORDER BY pos) AS terms FROM o WHERE rn <= 3 AND trim(term) <> '' GROUP BY name""",
)
def _(t):
    names = t.part.select(F.concat("p_name", F.lit(" v"), F.col("p_size").cast("string"), F.lit(" (x)")).alias("name")).distinct()
    return names.select("name", F.array_join(text.search_terms(F.col("name")), "|").alias("terms"))


@query(
    "F3_paper_ids",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN lpad(cast(doc_id % 10000 AS string), 4, '0') || '.' || lpad(cast(doc_id AS string), 5, '0') END AS card_id,
    CASE WHEN doc_id % 4 < 2 THEN lpad(cast(doc_id % 10000 AS string), 4, '0') || '.' || lpad(cast(doc_id AS string), 5, '0') END AS readme_id,
    len(list_distinct(regexp_extract_all(text, '[0-9]{4}\\.[0-9]{4,5}')))::INT AS n_ids FROM papers""",
)
def _(t):
    c = F.col("text")
    return t.papers.select(
        "doc_id", text.paper_id(c, text.CARD_PAPER_PATTERNS).alias("card_id"), text.paper_id(c).alias("readme_id"),
        F.size(text.paper_ids(c)).alias("n_ids"),
    )


@query(
    "F4_paper_id_from_card",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lpad(cast(doc_id AS string), 4, '0') || '.00001' WHEN 1 THEN '2105.0' || lpad(cast(doc_id % 1000 AS string), 4, '0') END AS paper FROM documents""",
)
def _(t):
    cards = t.sql("""
SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN concat('{"cardData":{"license":"x","arxiv":"arXiv:', lpad(cast(doc_id AS string), 4, '0'), '.00001"},"tags":["arxiv:2001.00009"]}')
  WHEN 1 THEN concat('{"cardData":{"paper":"none"},"tags":["lang:', lang, '","arXiv:2105.0', lpad(cast(doc_id % 1000 AS string), 4, '0'), '","arxiv:2001.00009"]}')
  WHEN 2 THEN '{"tags":["2001.00009"]}' ELSE 'not json' END AS card FROM documents""")
    return cards.select("doc_id", text.paper_id_from_card(F.col("card")).alias("paper"))


_DROPPED = "|".join(t for t in text.DROPPED_TAGS if t not in ("script", "style", "meta", "link"))


def _page_text_sql(table):
    """CTEs that end in ``page_text(page_id, url, html, b)``: pieces as rows, the depth of dropped elements by windows."""
    piece = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\z)|<[!?/a-z][^>]*(?:>|\z)|[^<]+|<"
    return f"""page_pieces AS (SELECT page_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '{piece}') AS ps FROM {table}) x),
    page_steps AS (SELECT page_id, i, ps[i] AS p, CASE WHEN regexp_matches(ps[i], '(?i)^<({_DROPPED})\\b') AND NOT ends_with(ps[i], '/>') THEN 1
      WHEN regexp_matches(ps[i], '(?i)^</({_DROPPED})\\b') THEN -1 ELSE 0 END AS s FROM page_pieces),
    page_sums AS (SELECT *, sum(s) OVER (PARTITION BY page_id ORDER BY i) AS c FROM page_steps),
    page_depths AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM page_sums),
    page_parts AS (SELECT page_id, string_agg(p, ' ' ORDER BY i) AS t FROM page_depths WHERE depth = 0 AND NOT regexp_matches(p, '^<[!?/A-Za-z]') GROUP BY page_id),
    page_text AS (SELECT w.page_id, w.url, w.html, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(t, ''), '&quot;?', '"', 'g'),
      '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS b FROM {table} w LEFT JOIN page_parts p ON p.page_id = w.page_id)"""


@query("F5_html_to_text", f"WITH {_page_text_sql('pages')} SELECT page_id, md5(b) AS digest, CAST(length(b) AS INT) AS n FROM page_text")
def _(t):
    rows = t.pages.select("page_id", text.html_to_text(F.col("html")).alias("text"))
    return rows.select("page_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("n"))


_MARKED = " OR ".join(f"contains(lower(b), '{m.lower()}')" for m in text.ERROR_MARKERS)


@query(
    "F6_is_error_page",
    f"""WITH {_page_text_sql('web')} SELECT page_id, (length(html) < 100 OR length(b) < 50 OR (len(string_split(b, ' ')) < 100 AND ({_MARKED}))) AS error FROM page_text""",
)
def _(t):
    return t.web.select("page_id", text.is_error_page(text.html_to_text(F.col("html")), F.col("html")).alias("error"))


_MARKDOWN = "concat(text, ' (https://x.y/z) === --- [http://a] (kept)   end')"


@query(
    "F7_clean_markdown",
    f"""SELECT doc_id, md5(replace(replace(replace(regexp_replace({_MARKDOWN}, '\\(https?:.*?\\)|\\[https?:.*?\\]', '', 'g'), '---', '-'), '===', '='), '   ', ' ')) AS digest FROM papers""",
)
def _(t):
    out = text.clean_markdown(F.expr(_MARKDOWN))
    return t.papers.select("doc_id", F.md5(out.cast("binary")).alias("digest"))


@query(
    "F8_strip_front_matter",
    """SELECT doc_id, md5(CASE WHEN starts_with(text, '---') AND instr(substr(text, 4), '---') > 0
      THEN regexp_replace(substr(text, instr(substr(text, 4), '---') + 6), '^\\s+|\\s+$', '', 'g') ELSE text END) AS digest FROM papers""",
)
def _(t):
    return t.papers.select("doc_id", F.md5(text.strip_front_matter(F.col("text")).cast("binary")).alias("digest"))


@query(
    "F9_usable_content",
    f"""WITH {_page_text_sql('web')} SELECT page_id, (length(b) > 100) AS is_full_content, md5(CASE WHEN length(b) > 100 THEN b ELSE url END) AS digest FROM page_text""",
)
def _(t):
    rows = t.web.select("page_id", text.usable_content(text.html_to_text(F.col("html")), F.col("url")).alias("u"))
    return rows.select("page_id", "u.is_full_content", F.md5(F.col("u.text").cast("binary")).alias("digest"))


_BLOCK = "coalesce(nullif(regexp_extract(text, '```json\\s*([\\s\\S]*?)\\s*```', 1), ''), nullif(regexp_extract(text, '\\{[\\s\\S]*\\}', 0), ''))"


@query("F10_extract_json_block", f"SELECT entity, item, {_BLOCK} AS block, try_cast(json_extract_string({_BLOCK}, '$.delta') AS INT) AS delta FROM replies")
def _(t):
    block = text.json_block(F.col("text"))
    return t.replies.select("entity", "item", block.alias("block"), text.json_field(block, "delta").try_cast("int").alias("delta"))


@query("F11_validate_descriptions", "SELECT DISTINCT p_brand AS item, p_type AS sub_item, concat('about ', p_type) AS description FROM part WHERE p_type <> 'STANDARD'")
def _(t):
    rows = t.part.groupBy(F.col("p_brand").alias("item")).agg(F.sort_array(F.collect_set("p_type")).alias("types"))
    told = F.map_from_arrays(
        F.concat("types", F.array(F.lit("made up"))),
        F.transform(F.concat("types", F.array(F.lit("x"))), lambda x: F.when(x != "STANDARD", F.concat(F.lit("about "), x))),
    )
    kept = text.known_descriptions(told, F.col("types"))
    return rows.select("item", F.explode(kept).alias("sub_item", "description"))


@query(
    "F12_assemble_context",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rn FROM conversations)
    SELECT conv_id AS subject, 0 AS page, count(*) AS n_docs, md5(string_agg(concat(chr(10), '[', coalesce(role, ''), '] ', coalesce(role, ''), chr(10), coalesce(text, ''), chr(10)), '' ORDER BY turn, role)) AS digest FROM r GROUP BY conv_id""",
)
def _(t):
    docs = t.conversations.select(
        F.col("conv_id").alias("subject"), F.col("turn").alias("pos"), F.col("role").alias("title"), F.col("role").alias("source"), "text"
    )
    out = evidence.assemble_context(docs)
    return out.select("subject", "page", "n_docs", F.md5(F.col("context").cast("binary")).alias("digest"))


@query(
    "F13_feature_text",
    """SELECT item AS name, concat_ws(chr(10), 'item: ' || item, 'category: ' || category, 'num samples: ' || num_samples) || chr(10) || chr(10) || 'subcategory descriptions: a=first; b=second'
      || chr(10) || chr(10) || 'links: x; y' AS text FROM items
    UNION ALL SELECT entity, concat_ws(chr(10) || chr(10), concat_ws(chr(10), 'entity: ' || entity, 'organization: ' || organization, 'family: ' || family, 'release date: ' || release_date, 'open source: ' || CASE WHEN open_source THEN 'yes' ELSE 'no' END),
      concat_ws(chr(10), 'parameters: ' || parameters, 'language model: ' || language_model, 'vision model: ' || vision_model), 'intro url: ' || CASE WHEN open_source THEN 'https://' || entity END) FROM entities""",
)
def _(t):
    items = t.items.select(
        "item", "category", "num_samples", F.lit("").alias("task"), F.lit(None).cast("string").alias("evaluation_metric"),
        F.create_map(F.lit("b"), F.lit("second"), F.lit("a"), F.lit("first")).alias("subcategory_descriptions"), F.array(F.lit("x"), F.lit("y")).alias("links"),
    )
    rows = dimensions.item_text(items).withColumnRenamed("item", "name")
    entities = t.entities.withColumn("intro_url", F.when(F.col("open_source"), F.concat(F.lit("https://"), "entity")))
    return rows.unionByName(dimensions.entity_text(entities).select(F.col("entity").alias("name"), "text"))


@query(
    "F13_family_text",
    """WITH r AS (SELECT family, organization, entity, row_number() OVER (PARTITION BY family ORDER BY entity) AS rn FROM entities)
    SELECT family, concat_ws(chr(10), 'family: ' || family, 'organization: ' || any_value(organization), 'n members: ' || count(*), 'first members: ' || string_agg(entity, '; ' ORDER BY entity) FILTER (WHERE rn <= 3), 'intro url: u')
      || chr(10) || chr(10) || concat_ws(chr(10), 'sentiment score: 0.50', 'web mentions count: 0', 'positive aspects: p; q') AS text FROM r GROUP BY family
    UNION ALL SELECT 'nobody', concat_ws(chr(10), 'family: nobody', 'n members: 0')""",
)
def _(t):
    families = t.entities.select("family", "organization").distinct()
    families = families.select(
        "*", F.lit("u").alias("intro_url"), F.lit("").alias("technical_summary"), F.lit(0.5).alias("sentiment_score"), F.lit(0).alias("web_mentions_count"),
        F.array(F.lit("p"), F.lit("q")).alias("positive_aspects"),
    )
    nobody = families.limit(1).select(F.lit("nobody").alias("family"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in families.schema.fields[1:]])
    return dimensions.family_text(families.unionByName(nobody), t.entities, shown=3)


@query(
    "J18_entity_info",
    """SELECT e.entity, organization, parameters, e.family, 'about ' || e.family AS family_technical_summary, 'u' AS family_intro_url FROM entities e UNION ALL SELECT 'nobody', NULL, NULL, NULL, NULL, NULL""",
)
def _(t):
    families = t.entities.select("family", F.concat(F.lit("about "), "family").alias("technical_summary"), F.lit("u").alias("intro_url")).distinct()
    names = t.entities.select("entity").unionByName(t.entities.limit(1).select(F.lit("nobody").alias("entity")))
    out = dimensions.entity_info(names, t.entities, families)
    return out.select("entity", "organization", "parameters", "family", "family_technical_summary", "family_intro_url")


@query("F14_search_hits", "SELECT page_id AS subject, CAST(p AS INT) AS position, CASE p WHEN 0 THEN 'first' ELSE '' END AS title, url FROM pages, (SELECT unnest([0, 1]) AS p) x")
def _(t):
    docs = t.pages.select(
        F.col("page_id").alias("subject"),
        F.to_json(
            F.struct(F.array(F.struct(F.lit("first").alias("title"), F.col("url").alias("link")), F.struct(F.lit(None).cast("string").alias("title"), F.col("url").alias("link"))).alias("items"))
        ).alias("doc"),
    )
    return knowledge.search_hits(docs).select("subject", "position", "title", "url")


@query("F14_discussion_hits", "SELECT doc_id AS subject, 0 AS position, source AS title, text FROM documents UNION ALL SELECT doc_id, 1, '', concat('more ', source) FROM documents")
def _(t):
    docs = t.documents.select(
        F.col("doc_id").alias("subject"),
        F.to_json(F.struct(F.array(F.struct(F.col("source").alias("title"), F.col("text").alias("content")), F.struct(F.lit(None).cast("string").alias("title"), F.concat(F.lit("more "), "source").alias("content"))).alias("discussions"))).alias("doc"),
    )
    return knowledge.discussion_hits(docs).select("subject", "position", "title", "text")


@query("F14_paper_feed", "SELECT doc_id AS subject, concat('On ', lang) AS title, concat('from ', source, ' text') AS abstract FROM documents")
def _(t):
    docs = t.sql("""
SELECT doc_id AS subject, concat('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title> On ', lang, ' </title><summary>from ', source, chr(10),
  'text</summary></entry><entry><title>second</title></entry></feed>') AS doc FROM documents""")
    return knowledge.paper_feed(docs)
