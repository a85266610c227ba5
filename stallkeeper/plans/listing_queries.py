"""Queries over listing texts and names: normalisation, dictionaries, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import deals, feed, terms
from ..operators.common import dedupe, head_by
from ..sources.readers import quoted_pairs, read_catalogue, read_placed_pairs, read_terms, write_catalogue, write_terms
from ..staging import new_folder, spread, table
from .registry import query

# Wear wordings that the derived listings take in turn.
LISTED_WEARS = ["崭新出厂", "略有磨损", "久經沙場", "战痕累累", "戰痕累累", "略磨"]
_CASE = "CASE l_partkey % 6 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(LISTED_WEARS)) + " END"
#: Listings derived from lineitem and part, as Spark and DuckDB both read it.
LISTING_SQL = f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_partkey AS part_key, l_extendedprice / l_quantity AS ask,
  concat('【售】', p_name, ' ', p_brand, ' ', {_CASE}, CASE l_linenumber % 3 WHEN 0 THEN ' 算' WHEN 1 THEN ' =' ELSE ' 賣 ' END,
    CAST(CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS VARCHAR(20)), CASE WHEN l_linenumber % 3 = 2 THEN ' TWD' ELSE '' END) AS content
  FROM lineitem JOIN part ON l_partkey = p_partkey"""


def listing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    wear = F.get(F.array(*map(F.lit, LISTED_WEARS)), (F.col("l_partkey") % 6).cast("int"))
    ask = F.col("l_extendedprice") / F.col("l_quantity")
    line = F.col("l_linenumber") % 3
    lead = F.when(line == 0, " 算").when(line == 1, " =").otherwise(" 賣 ")
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"), "l_orderkey", "l_linenumber")
    joined = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_partkey").alias("part_key"), ask.alias("ask"),
                         F.concat(F.lit("【售】"), "p_name", F.lit(" "), "p_brand", F.lit(" "), wear, lead, F.floor(ask).cast("string"),
                                  F.when(line == 2, " TWD").otherwise("")).alias("content"))


def sql_rules(rules, col: str, default: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({col}, '{t}')" for t in ts) + f" THEN '{w}'" for ts, w in rules)
    return f"CASE {whens} ELSE {default} END"


WEAR_SQL = sql_rules(X.WEAR_RULES, "content", "'Field-Tested'")
_RANK = "CASE {} " + " ".join(f"WHEN '{w}' THEN {i + 1}" for i, w in enumerate(X.WEARS)) + " ELSE 0 END"


@query(f"""WITH l AS ({LISTING_SQL}), w AS (SELECT id, {WEAR_SQL} AS wear, {sql_rules(X.NARROW_WEAR_RULES, "content", "'Field-Tested'")} AS narrow_wear,
  {sql_rules(X.WEAR_RULES, "content", "NULL")} IS NULL AS is_default FROM l)
  SELECT id, wear, narrow_wear, is_default, CAST({_RANK.format("wear")} AS BIGINT) AS wear_rank,
  CASE wear {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.WEAR_LABELS.items())} ELSE '' END AS label FROM w""")
def wear_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    rows = listing_text(spark, sf_dir).select("id", X.wear_to_en(c).alias("wear"), X.wear_to_en(c, X.NARROW_WEAR_RULES).alias("narrow_wear"), X.wear_is_default(c).alias("is_default"))
    return rows.withColumns({"wear_rank": X.wear_rank(F.col("wear")), "label": X.wear_label(F.col("wear"))})


PRICE_SQL = r"""coalesce(TRY_CAST(coalesce(nullif(regexp_extract(content, '算(?:你|給|到)?\s*([0-9]+)', 1), ''), nullif(regexp_extract(content, '=\s*([0-9]+)', 1), ''),
  list_extract(regexp_extract_all(content, '(^|[^0-9.])([0-9]{3,})', 2), -1)) AS BIGINT), -1)"""


@query(f"""WITH l AS (SELECT id, content || CASE part_key % 3 WHEN 0 THEN ' 暗金' WHEN 1 THEN ' StatTrak' ELSE '' END AS content FROM ({LISTING_SQL})) SELECT id, contains(content, '暗金') OR contains(content, 'StatTrak') AS special FROM l""")
def special_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("part_key") % 3 == 0, " 暗金").when(F.col("part_key") % 3 == 1, " StatTrak").otherwise("")
    return listing_text(spark, sf_dir).select("id", X.is_special(F.concat("content", mark)).alias("special"))


@query(f"WITH l AS ({LISTING_SQL}) SELECT id, {PRICE_SQL} AS price, CAST(floor(ask) AS BIGINT) AS floor_ask, content LIKE '【售】%' AS sells FROM l")
def price_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return listing_text(spark, sf_dir).select("id", X.extract_price(c).alias("price"), F.floor("ask").alias("floor_ask"), (X.listing_side(c) == "seller").alias("sells"))


@query(f"""WITH l AS ({LISTING_SQL}), n AS (SELECT id, {WEAR_SQL} AS wear, p_name, p_brand, p_partkey % 5 = 0 AS special FROM l JOIN part ON part_key = p_partkey)
  SELECT id, CASE WHEN special THEN 'StatTrak™ ' ELSE '' END || p_brand || ' | ' || p_name || ' (' || wear || ')' AS pattern_name,
  CASE WHEN special THEN 'StatTrak™ ' ELSE '' END || p_name || ' ' || p_brand || ' (' || wear || ')' AS full_name FROM n""")
def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = listing_text(spark, sf_dir).join(part, F.col("part_key") == F.col("p_partkey"))
    wear, special = X.wear_to_en(F.col("content")), F.col("p_partkey") % 5 == 0
    return rows.select("id", X.canonical_name(F.col("p_name"), F.col("p_brand"), wear, special).alias("pattern_name"),
                       X.canonical_name(F.concat_ws(" ", "p_name", "p_brand"), F.col("p_brand"), wear, special, "full").alias("full_name"))


#: Full item names derived from part: prefixes and wears in turn, every 7th without a wear.
NAMES_SQL = f"""SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN '★ StatTrak™ ' WHEN 1 THEN 'StatTrak™ ' WHEN 2 THEN 'Souvenir ' WHEN 3 THEN '★ ' ELSE '' END,
  p_brand, ' | ', p_name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat(' (', CASE p_partkey % 5 {" ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(X.WEARS))} END, ')') END) AS name FROM part"""


def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    start = F.get(F.array(*map(F.lit, ["★ StatTrak™ ", "StatTrak™ ", "Souvenir ", "★ ", ""])), (k % 5).cast("int"))
    wear = F.get(F.array(*map(F.lit, X.WEARS)), (k % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(start, "p_brand", F.lit(" | "), "p_name", F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(" ("), wear, F.lit(")")))).alias("name"))


_WEAR_RE = "|".join(X.WEARS)


@query(f"""WITH n AS ({NAMES_SQL}), w AS (SELECT *, regexp_extract(name, '\\(({_WEAR_RE})\\)$', 1) AS wear, trim(regexp_replace(name, '\\(({_WEAR_RE})\\)$', '')) AS bare FROM n),
  p AS (SELECT *, CASE WHEN wear = '' THEN '' WHEN bare LIKE '★ StatTrak™ %' THEN '🔟★' WHEN bare LIKE 'StatTrak™ %' THEN '🔟' WHEN bare LIKE 'Souvenir %' THEN '🎁' WHEN bare LIKE '★ %' THEN '★' ELSE '' END AS prefix,
  CASE WHEN wear = '' THEN name WHEN bare LIKE '★ StatTrak™ %' THEN substr(bare, 13) WHEN bare LIKE 'StatTrak™ %' THEN substr(bare, 11) WHEN bare LIKE 'Souvenir %' THEN substr(bare, 10) WHEN bare LIKE '★ %' THEN substr(bare, 3) ELSE bare END AS base FROM w)
  SELECT p_partkey, base, wear, prefix, trim(prefix || ' ' || base) AS display_key, coalesce(CASE wear {" ".join(f"WHEN '{w}' THEN '{c}'" for w, c in zip(X.WEARS, X.WEAR_CODES))} END, '-') AS code,
  trim(split_part(name, '|', 2)) AS pattern FROM p""")
def item_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return item_names(spark, sf_dir).withColumn("p", X.parse_item_name(n)).select("p_partkey", "p.*", F.coalesce(X.wear_code(n), F.lit("-")).alias("code"), X.extract_pattern(n).alias("pattern"))


@query(f"""WITH n AS ({NAMES_SQL}), a AS (SELECT p_partkey, replace(replace(replace(replace(replace(replace(lower(name), '''', ''), '(', ''), ')', ''), '★ ', ''), ' | ', '-'), ' ', '-') AS s FROM n)
  SELECT p_partkey, trim(regexp_replace(regexp_replace(s, '-(fn|mw|ft|ww|bs)$', ''), '-({"|".join(w.lower().replace(" ", "-") for w in X.WEARS)})$', ''), '-') AS slug FROM a""")
def slug_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_names(spark, sf_dir).select("p_partkey", X.slug_v1(F.col("name")).alias("slug"))


def _drop_wears(s: str) -> str:
    for w in X.WEARS:
        s = f"replace(replace({s}, ' {w}', ''), '-{w.lower()}', '')"
    return s


_V2 = "replace(replace(replace(replace(replace(replace(replace(name, '★ ', ''), '™', ''), ' | ', '-'), '(', ''), ')', ''), '''', ''), '  ', ' ')"


@query(f"WITH n AS ({NAMES_SQL}) SELECT p_partkey, replace(replace(trim(lower({_drop_wears(_V2)})), ' ', '-'), '--', '-') AS slug FROM n")
def slug_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_names(spark, sf_dir).select("p_partkey", X.slug_v2(F.col("name")).alias("slug"))


@query("""WITH t AS (SELECT item_id AS ord, text AS term, 'B' || item_id AS target FROM benchmark WHERE text <> ''),
  h AS (SELECT doc_id, term, target, row_number() OVER (PARTITION BY doc_id ORDER BY ord, term) AS rn FROM documents JOIN t ON contains(text, term))
  SELECT doc_id, term, target FROM h WHERE rn = 1""")
def dict_match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first benchmark text that each document contains whole."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("term"), F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("target"))
    return terms.match_terms(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), words, "doc_id", "text")


#: Two dictionaries out of part: full names of some parts, patterns of all.
TERMS_SQL = """f AS (SELECT p_name || ' ' || p_brand AS term, min(p_partkey) AS ord FROM part WHERE p_size <= 25 GROUP BY 1),
  p AS (SELECT p_name AS term, min(p_partkey) AS ord FROM part WHERE length(p_name) >= 2 GROUP BY 1),
  d AS (SELECT 'full' AS mode, 0 AS k, term, ord FROM f UNION ALL SELECT 'pattern', 1, term, ord FROM p)"""


def dictionaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    named = lambda df, term: df.groupBy(term.alias("term")).agg(F.min("p_partkey").alias("ord")).withColumn("target", F.upper("term"))
    return named(part.filter("p_size <= 25"), F.concat_ws(" ", "p_name", "p_brand")), named(part, F.col("p_name"))


@query(f"""WITH l AS MATERIALIZED (SELECT row_number() OVER () AS row, id, content FROM ({LISTING_SQL})), {TERMS_SQL},
  h AS (SELECT row, id, mode, term, row_number() OVER (PARTITION BY row ORDER BY k, ord, term) AS rn FROM l JOIN d ON contains(content, term))
  SELECT id, mode, term, upper(term) AS target FROM h WHERE rn = 1""")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each listing row that has a term; an id that comes twice is looked up twice."""
    listings = listing_text(spark, sf_dir).select("id", "content")
    return terms.dictionary_lookup(listings, *dictionaries(spark, sf_dir), "id", "content").select("id", "mode", "term", "target")


@query("""WITH t AS (SELECT p_name AS term, min(p_brand) AS target FROM part WHERE p_size <= 10 AND p_retailprice > 950 GROUP BY 1), r AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT 'no such term')
  SELECT r.term, coalesce(t.target, '(missing)') AS target FROM r LEFT JOIN t USING (term)""")
def dict_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    have = part.filter("p_size <= 10 and p_retailprice > 950").select(F.col("p_name").alias("term"), F.col("p_brand").alias("target"))
    required = part.select(F.col("p_name").alias("term")).distinct().union(spark.sql("SELECT 'no such term'"))
    return terms.coverage(have, required)


def _category_sql(words) -> str:
    return sql_rules([([w], n) for w, n in words], "t", "NULL")


_CATEGORY_TEXT = "concat(p_name, ' ', CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, (w, _) in enumerate(X.CATEGORIES[5:13])) + " END)"


@query(f"""WITH c AS (SELECT p_partkey, {_CATEGORY_TEXT} AS t FROM part), m AS (SELECT p_partkey, {_category_sql(X.CATEGORIES)} AS first_category,
  {_category_sql(sorted(X.CATEGORIES, key=lambda x: -len(x[0])))} AS category FROM c)
  SELECT *, coalesce({" OR ".join(f"contains(category, '{w}')" for w in X.STARRED)}, false) AS starred FROM m""")
def category_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.get(F.array(*[F.lit(w) for w, _ in X.CATEGORIES[5:13]]), (F.col("p_partkey") % 8).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", word).alias("t"))
    rows = rows.select("p_partkey", X.match_category(F.col("t"), "first").alias("first_category"), X.match_category(F.col("t")).alias("category"))
    return rows.withColumn("starred", X.is_starred(F.col("category")))


@query("""WITH m AS (SELECT p_partkey, p_brand AS term, p_name AS target, 1 AS priority FROM part UNION ALL SELECT p_partkey, p_brand, p_type, 2 FROM part WHERE p_size < 5 UNION ALL SELECT p_partkey, p_name, p_type, 3 FROM part WHERE p_size > 45),
  g AS (SELECT term, arg_max(target, priority * 1000000000000 + p_partkey) AS target, min(priority * 1000000000000 + p_partkey) AS f FROM m GROUP BY term),
  k AS (SELECT count(*) AS n FROM g) SELECT term, target, CAST(f // 1000000000000 AS INTEGER) AS first_priority, f % 1000000000000 AS first_pos, (SELECT n FROM k) AS n_terms FROM g""")
def merge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")

    def source(df: DataFrame, term: str, target: str, priority: int) -> DataFrame:
        return df.select(F.lit("full").alias("kind"), F.col(term).alias("term"), F.col(target).alias("target"), F.lit(priority).alias("priority"), F.col("p_partkey").alias("pos"))

    merged = terms.merge_terms(source(part, "p_brand", "p_name", 1), source(part.filter("p_size < 5"), "p_brand", "p_type", 2), source(part.filter("p_size > 45"), "p_name", "p_type", 3))
    counts = terms.term_counts(merged).withColumnRenamed("n", "n_terms")
    return merged.join(counts, "kind").drop("kind")


@query("""SELECT 'zh-CN' AS lang, CAST(p_partkey AS VARCHAR) AS id, p_brand || ' ' || p_partkey AS term, p_name AS target FROM part WHERE p_partkey % 4 <> 0 AND p_name <> ''
  UNION ALL SELECT 'zh-TW', CAST(p_partkey AS VARCHAR), p_type, p_name FROM part WHERE p_partkey % 5 <> 0 AND p_name <> '' AND p_type <> ''""")
def catalogue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues in three languages written as JSON arrays, read back and joined by id; names that are empty are left out."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    named = lambda lang, name: part.select(F.lit(lang).alias("lang"), key.cast("string").alias("id"), name.alias("name"))
    rows = named("en", F.col("p_name")).unionByName(named("zh-CN", F.when(key % 4 == 0, "").otherwise(F.concat_ws(" ", "p_brand", key.cast("string")))))
    rows = rows.unionByName(named("zh-TW", F.when(key % 5 == 0, "").otherwise(F.col("p_type"))))
    path = new_folder(spark, "catalogue")
    write_catalogue(rows, path, F.floor(F.col("id").cast("long") / 100))
    return terms.translate_catalogue(read_catalogue(spark, path, whole_files=False)).select("lang", "id", "term", "target")


@query("""WITH n AS (SELECT p_partkey AS k, p_brand || ' | ' || p_name AS target, CASE WHEN p_partkey % 5 = 0 THEN '新' ELSE '' END AS mark, '品' || p_partkey % 50 || ' | ' || CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS name FROM part),
  x AS (SELECT 2 AS priority, k, mark || name AS term, target FROM n WHERE k % 4 <> 0 UNION ALL SELECT 3, k, CASE WHEN k % 7 = 0 THEN name ELSE '繁' || name END, target FROM n WHERE k % 2 = 0),
  m AS (SELECT 'full' AS kind, term, target, priority, k FROM x UNION ALL
    SELECT 'pattern', trim(split_part(term, '|', 2)), trim(split_part(target, '|', 2)), priority, k FROM x WHERE trim(split_part(term, '|', 2)) <> trim(split_part(target, '|', 2)) UNION ALL
    SELECT 'full', name, upper(target), 1, k FROM n WHERE k % 3 = 1 UNION ALL SELECT 'pattern', p_type, min(upper(p_name)), 4, min(p_partkey) FROM part WHERE p_size = 7 GROUP BY 2),
  g AS (SELECT kind, term, arg_max(target, priority * 1000000000000 + k) AS target, min(priority * 1000000000000 + k) AS f FROM m GROUP BY 1, 2)
  SELECT kind, term, target, CASE f // 1000000000000 WHEN 1 THEN 'pairs' WHEN 2 THEN 'zh-CN' WHEN 3 THEN 'zh-TW' ELSE 'own' END AS source, CAST(f // 1000000000000 AS INTEGER) AS priority,
    row_number() OVER (PARTITION BY kind ORDER BY f, term) - 1 AS ord FROM g""")
def catalogue_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues in three languages (ids that come twice, arrays and objects) and quoted pairs, read from files and merged with own terms into the term store."""
    part, k, path = table(spark, sf_dir, "part"), F.col("p_partkey"), new_folder(spark, "dictionary")
    name = F.concat(F.lit("品"), (k % 50).cast("string"), F.lit(" | "), F.when(k % 3 == 0, F.col("p_name")).otherwise(F.col("p_type")))
    target = F.concat("p_brand", F.lit(" | "), "p_name")
    entry = lambda lang, name, at=0: part.select(F.lit(lang).alias("lang"), F.format_string("%012d", k).alias("id"), name.alias("name"), (2 * k + at).alias("at"))
    rows = entry("en", F.lit("old")).unionByName(entry("en", target, 1)).unionByName(entry("zh-CN", name).filter("at % 8 <> 0")).unionByName(entry("zh-CN", F.concat(F.lit("新"), name), 1).filter("at % 10 = 1 and at % 8 <> 1"))
    write_catalogue(rows, f"{path}/catalogue", F.floor(F.col("at") / 200), "at")
    block = part.filter(k % 2 == 0).select(F.floor(k / 100).alias("b"), k.alias("k"), F.format_string("%012d", k).alias("id"), F.when(k % 7 == 0, name).otherwise(F.concat(F.lit("繁"), name)).alias("name"))
    objects = block.groupBy("b").agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("k", "id", "name"))), lambda x: F.struct(x["id"], x["name"])))).alias("value"))
    objects.repartitionByRange(4, "b").sortWithinPartitions("b").select("value").write.text(f"{path}/catalogue/lang=zh-TW")
    pairs = part.filter(k % 3 == 1).select(k.alias("k"), F.concat(F.lit(" '"), name, F.lit("': '"), F.upper(target), F.lit("',")).alias("value"))
    pairs.repartitionByRange(4, "k").sortWithinPartitions("k").select("value").write.text(f"{path}/pairs")
    api = terms.catalogue_terms(terms.translate_catalogue(read_catalogue(spark, f"{path}/catalogue", whole_files=False)), {"zh-CN": 2, "zh-TW": 3})
    said = read_placed_pairs(spark, f"{path}/pairs").select(F.lit("full").alias("kind"), "term", "target", F.lit(1).alias("priority"), "pos")
    place = F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.min(k).cast("long").alias("line"), F.lit(0).alias("entry"))
    own = part.filter("p_size = 7").groupBy(F.col("p_type").alias("term")).agg(F.min(F.upper("p_name")).alias("target"), place.alias("pos"))
    merged = terms.merge_terms(api, said, own.select(F.lit("pattern").alias("kind"), "term", "target", F.lit(4).alias("priority"), "pos"))
    write_terms(terms.stored_terms(merged, {1: "pairs", 2: "zh-CN", 3: "zh-TW", 4: "own"}), f"{path}/terms")
    return read_terms(spark, f"{path}/terms")


@query("""WITH e AS (SELECT p_size AS id, arg_max(p_name, p_partkey) AS target FROM part WHERE p_brand = 'Brand#1' GROUP BY 1),
  o AS (SELECT p_brand AS lang, p_size AS id, arg_max(p_name, p_partkey) AS term FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1, 2)
  SELECT o.lang, o.id, o.term, e.target FROM o JOIN e USING (id)""")
def catalogue_idjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("lang"), F.col("p_size").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    return terms.translate_catalogue(rows, "Brand#1").select("lang", "id", "term", "target")


@query("SELECT p_partkey, p_name AS term, p_brand AS target FROM part")
def quoted_pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("  '"), F.col("p_partkey").cast("string"), F.lit("#"), "p_name")
    pairs = quoted_pairs(table(spark, sf_dir, "part").select(F.concat(key, F.lit("': '"), "p_brand", F.lit("',\t")).alias("value")))
    return pairs.select(F.split("term", "#")[0].cast("long").alias("p_partkey"), F.split("term", "#")[1].alias("term"), "target")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY substr(c_name, 1, 4), c_nationkey, c_mktsegment ORDER BY c_custkey) AS rn FROM customer)
  SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM r WHERE rn = 1""")
def dedupe_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return dedupe(rows, [F.substring("c_name", 1, 4), "c_nationkey", "c_mktsegment"], ["c_custkey"])


@query("""WITH b AS (SELECT page_id, trim(substr(url, 1, 40)) AS s FROM pages), a AS (SELECT page_id AS left_id, trim(substr(url, position('://' IN url) + 3, 40)) AS s FROM pages)
  SELECT a.left_id, min(b.page_id) AS right_pos FROM a JOIN b ON a.s <> '' AND b.s <> '' AND (contains(b.s, substr(a.s, 1, 15)) OR contains(a.s, substr(b.s, 1, 15))) GROUP BY 1""")
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    left = pages.select(F.col("page_id").alias("left_id"), F.expr("substring(url, position('://', url) + 3, 40)").alias("t"))
    return feed.prefix_match(left, pages.withColumnRenamed("page_id", "right_pos"), "left_id", "t", "right_pos", "url")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15")
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head_by(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 15)


@query(f"""WITH l AS ({LISTING_SQL}) SELECT id, 100 * CAST(part_key AS BIGINT) AS base, 4.4::DOUBLE AS rate, CAST(floor(ask) AS BIGINT) AS quoted,
  CAST(floor(100 * part_key * 4.4::DOUBLE / 100) AS BIGINT) * 100 AS computed FROM l WHERE part_key > 0""")
def quoted_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("底"), (F.col("part_key") * 100).cast("string"), F.lit("*4.4="), F.floor("ask").cast("string"))
    return listing_text(spark, sf_dir).filter("part_key > 0").select("id", X.quoted_rate(said).alias("q")).select("id", "q.*")


@query(f"""WITH l AS ({LISTING_SQL}) SELECT id, substr('[圖片] 售 ' || CASE WHEN p_partkey % 5 = 0 THEN 'StatTrak ' ELSE '' END || p_name || ' ' || p_brand || ' ' || CAST(CAST(floor(ask) AS BIGINT) AS VARCHAR) || 'TWD', 1, 30) AS content
  FROM l JOIN part ON part_key = p_partkey""")
def render_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing_text(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("part_key") == F.col("p_partkey"))
    return rows.select("id", X.render_item(F.col("p_name"), F.col("p_brand"), F.floor("ask"), F.lit("TWD"), F.col("p_partkey") % 5 == 0, 30).alias("content"))


@query("""SELECT l_partkey % 2 = 0 AS even, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""")
def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_returnflag") == "N", "NONE").otherwise(F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").withColumn("name", name).filter(X.valid_name(F.col("name")))
    return rows.groupBy((F.col("l_partkey") % 2 == 0).alias("even")).agg(F.count("*").alias("n"))


@query("""SELECT c_nationkey, o_totalprice AS price, n AS items, author, CASE WHEN n = 1 THEN f ELSE f || ' 等 ' || n || ' 件' END AS bundle FROM (
  SELECT c_nationkey, floor(o_totalprice / 100000) AS o_totalprice, count(*) AS n, arg_min(c_name, o_orderkey) AS author, arg_min(o_orderpriority, o_orderkey) AS f
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE floor(o_totalprice / 100000) > 0 GROUP BY 1, 2)""")
def bundle_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    author = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 4, "0"), "c_name")
    rows = rows.select(author.alias("author"), F.col("o_orderpriority").alias("name"), F.floor(F.col("o_totalprice") / 100000).cast("double").alias("price"), F.col("o_orderkey").alias("pos"))
    out = deals.bundle_listings(rows)
    return out.select(F.col("author_key").cast("int").alias("c_nationkey"), "price", "items", F.substring("author", 5, 100).alias("author"), F.regexp_extract("content", "^【售】(.*)\n", 1).alias("bundle"))

