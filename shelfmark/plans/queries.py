"""Queries over the shared tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions import evidence, numbers as N, text as X
from shelfmark.operators import audit, checksum, explain, folds, groups, images, manifest, metrics, models, retrieval, routing, rules, tfidf, visual
from shelfmark.contracts import IMAGE_HASHES, conform, id_differences
from shelfmark.sources.scratch import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str, labelled: bool = False) -> DataFrame:
    """Documents as products: source is the name, text the description, lang the category, quality the label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    both = docs.join(labels, "doc_id", "inner" if labelled else "left")
    return both.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("description"), F.col("lang").alias("category"), F.col("quality").cast("long").alias("label"))


PRODUCTS = "(SELECT d.doc_id AS id, d.source AS name, d.text AS description, d.lang AS category, l.quality::BIGINT AS label FROM documents d LEFT JOIN labels l USING (doc_id))"
LABELLED = "(SELECT d.doc_id AS id, d.source AS name, d.text AS description, d.lang AS category, l.quality::BIGINT AS label FROM documents d JOIN labels l USING (doc_id))"
LANGS = ("de", "en", "fr")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document twice, once with other blanks and marks, with made-up labels: near duplicates and conflicts."""
    docs = table(spark, sf_dir, "documents")
    plain = docs.select((F.col("doc_id") * 2).alias("id"), F.col("source").alias("name"), F.col("text").alias("description"), F.col("lang").alias("category"), (F.col("doc_id") % 2).alias("label"))
    varied = docs.select((F.col("doc_id") * 2 + 1).alias("id"), F.col("source").alias("name"), F.concat(F.lit("  "), "text", F.lit("!!")).alias("description"), F.col("lang").alias("category"), (F.col("doc_id") % 3 % 2).alias("label"))
    return plain.unionByName(varied)


CATALOGUE = """(SELECT doc_id * 2 AS id, source AS name, text AS description, lang AS category, doc_id % 2 AS label FROM documents
    UNION ALL SELECT doc_id * 2 + 1, source, '  ' || text || '!!', lang, doc_id % 3 % 2 FROM documents)"""


def norm(c: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def gid(text: str) -> str:
    return f"'g_' || substr(sha256({text}), 1, 24)"


GROUPED = f"""(WITH k AS (SELECT id, category, label, {gid(norm("name") + " || chr(9247) || " + norm("description"))} AS group_id,
        coalesce(name, '<NULL>') || chr(9247) || coalesce(description, '<NULL>') AS raw FROM {CATALOGUE}),
    s AS (SELECT group_id, count(*) AS group_size, count(DISTINCT raw) AS v FROM k GROUP BY group_id),
    c AS (SELECT group_id, category, count(DISTINCT label) > 1 AS label_conflict FROM k GROUP BY ALL)
    SELECT id, category, label, group_id, group_size, CASE WHEN group_size = 1 THEN 'unique' WHEN v = 1 THEN 'exact' ELSE 'normalized' END AS duplicate_kind, label_conflict
    FROM k JOIN s USING (group_id) JOIN c USING (group_id, category))"""


def joined(c: str) -> F.Column:
    """A list of ids as text, to compare it whole."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@register(f"SELECT category, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY category) AS share FROM {LABELLED} GROUP BY category, label")
def class_balance(spark, sf_dir):
    return audit.class_balance(products(spark, sf_dir, labelled=True))


@register(
    f"""SELECT 'name' AS column_name, count(*) FILTER (name IS NULL) AS nulls, count(*) FILTER (regexp_full_match(name, '\\s*')) AS blanks FROM {PRODUCTS}
    UNION ALL SELECT 'description', count(*) FILTER (description IS NULL), count(*) FILTER (regexp_full_match(description, '\\s*')) FROM {PRODUCTS}"""
)
def missing_values(spark, sf_dir):
    return audit.missing_values(products(spark, sf_dir))


@register(f"SELECT {', '.join(f'count(*) FILTER ({c} IS NULL) AS {c}' for c in ('id', 'name', 'description', 'category', 'label'))} FROM {PRODUCTS}")
def null_counts(spark, sf_dir):
    return audit.null_counts(products(spark, sf_dir))


@register(
    f"""WITH p AS {PRODUCTS}, g AS (SELECT id, count(*) AS n FROM p GROUP BY id)
    SELECT (SELECT count(*) FROM p) AS rows, (SELECT count(*) FROM g) AS unique_ids, (SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM g) AS duplicate_id_rows,
    (SELECT count(*) FROM p WHERE category IS NULL OR category NOT IN ('de', 'en', 'fr')) AS unknown_categories, (SELECT count(*) FROM p WHERE label IS NULL OR label NOT IN (0, 1)) AS invalid_labels"""
)
def profile_summary(spark, sf_dir):
    return audit.profile(products(spark, sf_dir), LANGS)


_EXACT = f"SELECT category, name, description, count(*) AS size, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, count(DISTINCT label) > 1 AS label_conflict FROM {CATALOGUE} GROUP BY ALL HAVING count(*) > 1"


@register(f"SELECT category, name, sha256(description) AS description_sha256, size, ids, label_conflict FROM ({_EXACT})")
def exact_duplicates(spark, sf_dir):
    found = audit.exact_duplicates(catalogue(spark, sf_dir))
    return found.select("category", "name", F.sha2("description", 256).alias("description_sha256"), "size", joined("ids"), "label_conflict")


_NEAR = f"""SELECT category, nn AS normalized_name, nd, count(*) AS size, count(DISTINCT raw) AS raw_variants, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, count(DISTINCT label) > 1 AS label_conflict
    FROM (SELECT *, {norm("name")} AS nn, {norm("description")} AS nd, coalesce(name, '') || chr(9247) || coalesce(description, '') AS raw FROM {CATALOGUE}) GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT raw) > 1"""


@register(f"SELECT category, normalized_name, size, raw_variants, ids, label_conflict FROM ({_NEAR})")
def near_duplicates(spark, sf_dir):
    return audit.near_duplicates(catalogue(spark, sf_dir)).select("category", "normalized_name", "size", "raw_variants", joined("ids"), "label_conflict")


@register(f"SELECT count(*) AS groups, coalesce(sum(size), 0)::BIGINT AS rows, coalesce(sum(size - 1), 0)::BIGINT AS extra_rows, count(*) FILTER (label_conflict) AS conflicting FROM ({_NEAR})")
def duplicate_counters(spark, sf_dir):
    return audit.duplicate_counters(audit.near_duplicates(catalogue(spark, sf_dir)))


@register(f"SELECT doc_id, sha256({norm('text')}) AS normalized_sha256, length({norm('text')})::BIGINT AS normalized_chars FROM documents")
def normalized_text(spark, sf_dir):
    t = X.normalized_text("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("normalized_sha256"), F.length(t).cast("long").alias("normalized_chars"))


@register(f"SELECT doc_id, {gid(norm('source') + ' || chr(9247) || ' + norm('text'))} AS group_id FROM documents")
def stable_group_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.stable_id(X.signature(X.normalized_text("source"), X.normalized_text("text"))).alias("group_id"))


@register(f"SELECT * FROM {GROUPED}")
def text_groups(spark, sf_dir):
    return groups.text_groups(catalogue(spark, sf_dir))


@register(f"SELECT * FROM {GROUPED} WHERE label_conflict")
def label_conflicts(spark, sf_dir):
    return groups.label_conflicts(groups.text_groups(catalogue(spark, sf_dir)))


@register(f"SELECT duplicate_kind, count(DISTINCT group_id) AS groups, count(*) AS rows FROM {GROUPED} GROUP BY ALL")
def group_kind_histogram(spark, sf_dir):
    return groups.group_kinds(groups.text_groups(catalogue(spark, sf_dir)))


@register(
    f"""SELECT count(DISTINCT group_id) AS groups, max(group_size) AS largest_group, count(DISTINCT (group_id, category)) FILTER (label_conflict) AS conflicting_pairs, count(*) FILTER (label_conflict) AS conflicting_rows
    FROM {GROUPED}"""
)
def group_summary(spark, sf_dir):
    return groups.group_summary(groups.text_groups(catalogue(spark, sf_dir)))


@register(f"SELECT DISTINCT group_id, group_size, duplicate_kind FROM {GROUPED} WHERE group_size > 1 ORDER BY group_size DESC, group_id LIMIT 15")
def largest_groups(spark, sf_dir):
    return groups.largest_groups(groups.text_groups(catalogue(spark, sf_dir)))


def image_links(spark, sf_dir):
    """A made-up pair of products for each document, few of which are trusted."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    there = docs.select((F.col("doc_id") - 7).alias("doc_id"))
    return docs.join(there, "doc_id", "left_semi").select((F.col("doc_id") * 2).alias("left_id"), (F.col("doc_id") * 2 + 14).alias("right_id"), (F.col("doc_id") % 25 < 2).alias("auto_merge"))


@register(
    f"""WITH RECURSIVE g AS MATERIALIZED (SELECT * FROM {GROUPED}),
    e AS MATERIALIZED (SELECT DISTINCT a.group_id AS a, b.group_id AS b FROM documents d JOIN documents o ON o.doc_id = d.doc_id + 7 JOIN g a ON a.id = d.doc_id * 2 JOIN g b ON b.id = d.doc_id * 2 + 14
        WHERE d.doc_id % 25 < 2 AND a.group_id <> b.group_id),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(n, m) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, r.m FROM r JOIN s ON s.a = r.n),
    p AS MATERIALIZED (SELECT n AS group_id, min(m) AS part FROM r GROUP BY n),
    k AS (SELECT part, 'g_' || substr(sha256('visual' || chr(9247) || string_agg(DISTINCT group_id, chr(9247) ORDER BY group_id)), 1, 24) AS new_id,
        CASE WHEN bool_and(duplicate_kind = 'unique') THEN 'visual' ELSE 'mixed' END AS new_kind FROM p JOIN (SELECT DISTINCT group_id, duplicate_kind FROM g) USING (group_id) GROUP BY part),
    t AS (SELECT id, category, label, coalesce(new_id, group_id) AS group_id, coalesce(new_kind, duplicate_kind) AS duplicate_kind FROM g LEFT JOIN p USING (group_id) LEFT JOIN k USING (part))
    SELECT id, category, label, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, duplicate_kind, c.label_conflict
    FROM t JOIN (SELECT group_id, category, count(DISTINCT label) > 1 AS label_conflict FROM t GROUP BY ALL) c USING (group_id, category)"""
)
def visual_merge_groups(spark, sf_dir):
    return groups.merge_visual(groups.text_groups(catalogue(spark, sf_dir)), image_links(spark, sf_dir))


def hashed_folds(spark, sf_dir):
    """Folds by a digit of the group id: never a split group, whatever the balance."""
    g = groups.text_groups(catalogue(spark, sf_dir))
    return g.select("id", "category", "label", "group_id", (F.conv(F.substring("group_id", 3, 4), 16, 10).cast("long") % 5).cast("byte").alias("fold"))


FOLDED = f"(SELECT id, category, label, group_id, (('0x' || substr(group_id, 3, 4))::BIGINT % 5)::TINYINT AS fold FROM {GROUPED})"
_BALANCE = f"(WITH f AS MATERIALIZED (SELECT * FROM {FOLDED}) SELECT s.category, s.label, k.fold, count(f.id) AS n FROM (SELECT DISTINCT category, label FROM f) s CROSS JOIN (SELECT DISTINCT fold FROM f) k LEFT JOIN f ON f.category = s.category AND f.label = s.label AND f.fold = k.fold GROUP BY ALL)"


@register(f"SELECT * FROM {_BALANCE}")
def fold_balance(spark, sf_dir):
    return folds.fold_balance(hashed_folds(spark, sf_dir))


@register(f"SELECT max(abs(n - e) / e) AS max_deviation FROM (SELECT n, avg(n) OVER (PARTITION BY category, label) AS e FROM {_BALANCE})")
def fold_max_deviation(spark, sf_dir):
    return folds.max_deviation(hashed_folds(spark, sf_dir))


@register(f"SELECT group_id, count(DISTINCT id % 5) AS folds FROM {GROUPED} GROUP BY group_id HAVING count(DISTINCT id % 5) > 1")
def fold_leak_check(spark, sf_dir):
    return folds.leaks(groups.text_groups(catalogue(spark, sf_dir)).withColumn("fold", F.col("id") % 5))


@register()
def stratified_group_folds(spark, sf_dir):
    return folds.stratified_group_folds(groups.text_groups(catalogue(spark, sf_dir)))


@register(f"SELECT category, label, count(*) AS rows, count(DISTINCT group_id) AS groups, 5 AS folds, 0 AS split_groups, true AS even FROM {GROUPED} GROUP BY category, label")
def fold_checks(spark, sf_dir):
    """stratified_group_folds by stratum: all rows and groups there, no group in two folds, folds within a tenth of an even share and a group's size."""
    g = groups.text_groups(catalogue(spark, sf_dir))
    f = materialise(folds.stratified_group_folds(g), "folds")
    split = folds.leaks(f).select("group_id", F.lit(1).alias("split"))
    cells = f.groupBy("category", "label", "fold").agg(F.count("*").alias("n")).groupBy("category", "label").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("all"), F.count("*").alias("folds"))
    most = g.agg(F.max("group_size").alias("most"))
    sums = f.join(split, "group_id", "left").groupBy("category", "label").agg(F.count("*").alias("rows"), F.countDistinct("group_id").alias("groups"), F.coalesce(F.sum("split"), F.lit(0)).cast("int").alias("split_groups"))
    even = (F.col("hi") - F.col("lo") <= F.col("all") / 10 + F.col("most"))
    return sums.join(cells, ["category", "label"]).crossJoin(most).select("category", "label", "rows", "groups", F.col("folds").cast("int").alias("folds"), "split_groups", even.alias("even"))  # most is one row


@register("SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS side FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def id_set_differences(spark, sf_dir):
    return id_differences(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


def conversation_images(spark, sf_dir):
    """Turns of conversations as the images of products: id and index, user turns readable."""
    rows = table(spark, sf_dir, "conversations")
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"))
    both = rows.join(ids, rows["conv_id"] == ids["_id"], "left")
    return both.select(F.col("conv_id").alias("id"), F.col("turn").alias("image_index"), F.when(F.col("role") == "user", "ok").otherwise("error").alias("status"), F.col("_id").isNotNull().alias("in_dataset"), F.length("text").alias("width"), F.length("role").alias("height"))


_IMAGES = "(SELECT conv_id AS id, turn AS image_index, CASE WHEN role = 'user' THEN 'ok' ELSE 'error' END AS status, conv_id IN (SELECT doc_id FROM documents) AS in_dataset, length(text)::INT AS width, length(role)::INT AS height FROM conversations)"


@register("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)")
def missing_ids(spark, sf_dir):
    return images.missing_ids(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), conversation_images(spark, sf_dir))


@register("SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents)")
def orphan_ids(spark, sf_dir):
    return images.orphan_ids(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), conversation_images(spark, sf_dir))


@register(
    f"""WITH i AS {_IMAGES}, p AS (SELECT id, count(*) AS f, count(*) FILTER (status = 'ok') AS k FROM i GROUP BY id), d AS (SELECT DISTINCT doc_id AS id, true AS mine FROM documents),
    m AS (SELECT coalesce(mine, false) AS mine, coalesce(f, 0) AS f, coalesce(k, 0) AS k FROM d FULL JOIN p USING (id))
    SELECT count(*) FILTER (mine) AS dataset_items, count(*) FILTER (mine AND f > 0) AS items_with_files, count(*) FILTER (mine AND k > 0) AS items_with_readable_files, count(*) FILTER (mine AND f = 0) AS missing_ids,
    count(*) FILTER (mine AND k = 0) AS ids_without_readable_files, count(*) FILTER (NOT mine) AS orphan_ids, coalesce(sum(f) FILTER (NOT mine), 0)::BIGINT AS orphan_files,
    (SELECT count(*) FROM i) AS image_files, (SELECT count(*) FROM i WHERE status = 'ok') AS readable_files, (SELECT count(*) FROM i WHERE status = 'error') AS unreadable_files,
    (SELECT count(*) FROM i WHERE id IS NULL) AS invalid_id_paths, (SELECT count(*) FROM i WHERE image_index IS NULL) AS invalid_image_indices,
    (SELECT count(*) FROM (SELECT 1 FROM i GROUP BY id, image_index HAVING count(*) > 1)) AS duplicate_slots FROM m"""
)
def image_coverage(spark, sf_dir):
    return images.coverage(conversation_images(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@register("SELECT role_id AS id, turn AS image_index, count(*) AS files FROM (SELECT turn, length(role)::BIGINT AS role_id FROM conversations) GROUP BY ALL HAVING count(*) > 1")
def duplicate_slots(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.length("role").cast("long").alias("id"), F.col("turn").alias("image_index"))
    return images.duplicate_slots(rows)


@register(f"SELECT width, height, count(*) AS files FROM {_IMAGES} WHERE status = 'ok' GROUP BY ALL ORDER BY files DESC, width, height LIMIT 12")
def top_resolutions(spark, sf_dir):
    return images.top_sizes(conversation_images(spark, sf_dir))


_COUNTS = f"(SELECT id, count(*) AS image_count FROM {_IMAGES} WHERE in_dataset AND status = 'ok' GROUP BY id)"


def document_manifest(spark, sf_dir):
    """A manifest of documents: their groups, folds by group and readable turns."""
    source = products(spark, sf_dir)
    g = groups.text_groups(source)
    f = g.select("id", (F.conv(F.substring("group_id", 3, 4), 16, 10).cast("long") % 5).cast("byte").alias("fold"))
    return manifest.product_manifest(source, g, f, conversation_images(spark, sf_dir).filter("in_dataset"))


@register(
    f"""WITH p AS {PRODUCTS}, k AS (SELECT *, {norm("name")} AS nn, {norm("description")} AS nd, coalesce(name, '<NULL>') || chr(9247) || coalesce(description, '<NULL>') AS raw FROM p),
    g AS (SELECT *, {gid("nn || chr(9247) || nd")} AS group_id FROM k), s AS (SELECT group_id, count(*) AS n, count(DISTINCT raw) AS v FROM g GROUP BY ALL), c AS (SELECT group_id, category, count(DISTINCT label) > 1 AS label_conflict FROM g GROUP BY ALL)
    SELECT id, name, sha256(description) AS description_sha256, category, label, nn AS normalized_name, group_id, CASE WHEN n = 1 THEN 'unique' WHEN v = 1 THEN 'exact' ELSE 'normalized' END AS duplicate_type, label_conflict,
    coalesce(image_count, 0) AS image_count, (('0x' || substr(group_id, 3, 4))::BIGINT % 5)::TINYINT AS fold FROM g JOIN s USING (group_id) JOIN c USING (group_id, category) LEFT JOIN {_COUNTS} USING (id)"""
)
def product_manifest(spark, sf_dir):
    return document_manifest(spark, sf_dir).select("id", "name", F.sha2("description", 256).alias("description_sha256"), "category", "label", "normalized_name", "group_id", "duplicate_type", "label_conflict", "image_count", "fold")


@register(f"SELECT min(image_count) AS least, median(image_count) AS median, avg(image_count) AS mean, max(image_count) AS most FROM {_COUNTS}")
def item_count_distribution(spark, sf_dir):
    return manifest.count_distribution(document_manifest(spark, sf_dir))


def planted_hashes(spark, sf_dir):
    """60-bit hashes: four documents share one but for a bit each."""
    base = F.conv(F.substring(F.md5(F.floor(F.col("doc_id") / 4).cast("string")), 1, 15), 16, 10).cast("long")
    return table(spark, sf_dir, "documents").select(base.bitwiseXOR(F.expr("shiftleft(1L, cast(doc_id % 4 * 13 as int))")).alias("h"))


@register(
    """WITH h AS (SELECT DISTINCT xor(('0x' || substr(md5((doc_id // 4)::VARCHAR), 1, 15))::BIGINT, 1::BIGINT << (doc_id % 4 * 13)::INT) AS h FROM documents)
    SELECT a.h AS a, b.h AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 6"""
)
def hamming_pairs(spark, sf_dir):
    return visual.hamming_pairs(planted_hashes(spark, sf_dir), 6)


@register("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: (x::DOUBLE > list_median(embedding::DOUBLE[]))::INT), '') AS bits FROM embeddings")
def embedding_sign_hash(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    order, n = F.array_sort(x), F.size(x)
    middle = (F.element_at(order, (n / 2).cast("int")) + F.element_at(order, (n / 2 + 1).cast("int"))) / 2
    rows = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), F.when(n % 2 == 0, middle).otherwise(F.element_at(order, ((n + 1) / 2).cast("int"))).alias("m"))
    return rows.select("vec_id", F.array_join(F.transform("x", lambda v: (v > F.col("m")).cast("int").cast("string")), "").alias("bits"))


def document_images(spark, sf_dir):
    """Documents as image files: three to a product, equal texts as equal files."""
    return table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 3).cast("long").alias("id"), (F.col("doc_id") % 3).alias("image_index"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("relative_path"), F.sha2("text", 256).alias("file_sha256")
    )


_FILES = "(SELECT doc_id // 3 AS id, doc_id % 3 AS image_index, lpad(doc_id::VARCHAR, 12, '0') AS relative_path, sha256(text) AS file_sha256 FROM documents)"


def _pairs_sql(most: int) -> str:
    side = "least(l.id, r.id) AS left_id, greatest(l.id, r.id) AS right_id, CASE WHEN l.id < r.id THEN l.relative_path ELSE r.relative_path END AS left_path, CASE WHEN l.id < r.id THEN r.relative_path ELSE l.relative_path END AS right_path, l.image_index = 0 AND r.image_index = 0 AS \"primary\""
    return f"""(WITH f AS {_FILES}, c AS (SELECT file_sha256, count(DISTINCT id) AS p FROM f GROUP BY ALL HAVING count(DISTINCT id) > 1), x AS (SELECT * FROM f JOIN c USING (file_sha256)),
    o AS (SELECT * FROM x WHERE p > {most} QUALIFY row_number() OVER (PARTITION BY file_sha256, id ORDER BY relative_path) = 1), m AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY file_sha256 ORDER BY id) = 1)
    SELECT {side}, true AS trusted FROM x l JOIN x r ON l.file_sha256 = r.file_sha256 AND l.relative_path < r.relative_path AND l.id <> r.id AND l.p <= {most}
    UNION ALL SELECT {side}, false FROM m l JOIN o r ON l.file_sha256 = r.file_sha256 AND l.id <> r.id)"""


@register(f"SELECT * FROM {_pairs_sql(20)}")
def exact_hash_pairs(spark, sf_dir):
    return visual.exact_pairs(document_images(spark, sf_dir))


@register(f"SELECT * FROM {_pairs_sql(2)}")
def popular_hash_star(spark, sf_dir):
    return visual.exact_pairs(document_images(spark, sf_dir), most_products=2)


def hashed_images(spark, sf_dir):
    """document_images with hashes: four documents in a row are near each other, and a third of all products share one perceptual hash."""
    quarter, k = F.floor(F.col("d") / 4).cast("string"), F.col("d") % 4
    spread = lambda text: F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    p = F.when(F.col("id") % 3 == 0, F.lit(0xFF00FF00FF00FF)).otherwise(spread(quarter).bitwiseXOR(F.expr("shiftleft(1L, cast(d % 4 * 13 as int))")))
    d = spread(F.concat(F.lit("d"), F.when(F.col("id") % 3 == 0, F.col("d").cast("string")).otherwise(quarter))).bitwiseXOR(F.expr("shiftleft(1L, cast(d % 4 * 3 as int)) - 1"))
    rows = document_images(spark, sf_dir).withColumn("d", F.col("relative_path").cast("long"))
    return conform(
        rows.select("id", "image_index", "relative_path", "file_sha256", N.hex_of_long(p).alias("phash"), N.hex_of_long(d).alias("dhash"), (100 + k).alias("width"), F.lit(100).alias("height"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")),
        IMAGE_HASHES,
    )


_HASHED = f"""(SELECT *, doc // 4 AS q, doc % 4 AS k, (CASE WHEN id % 3 = 0 THEN 71777214294589695 ELSE xor(('0x' || substr(md5((doc // 4)::VARCHAR), 1, 15))::BIGINT, 1::BIGINT << (doc % 4 * 13)::INT) END) AS p,
    xor(('0x' || substr(md5('d' || (CASE WHEN id % 3 = 0 THEN doc ELSE doc // 4 END)::VARCHAR), 1, 15))::BIGINT, (1::BIGINT << (doc % 4 * 3)::INT) - 1) AS dh, (100 + doc % 4) / 100 AS ar FROM (SELECT *, relative_path::BIGINT AS doc FROM {_FILES}))"""
_NEAR_IMAGES = f"""(WITH i AS MATERIALIZED (SELECT * FROM {_HASHED}), m AS (SELECT l.id AS li, r.id AS ri, l.relative_path AS lp, r.relative_path AS rp, l.image_index = 0 AND r.image_index = 0 AS "primary",
        bit_count(xor(l.p, r.p))::INT AS pd, bit_count(xor(l.dh, r.dh))::INT AS dd, abs(l.ar - r.ar) / greatest(l.ar, r.ar) AS ad FROM i l JOIN i r ON l.relative_path < r.relative_path AND l.id <> r.id AND l.file_sha256 <> r.file_sha256)
    SELECT least(li, ri) AS left_id, greatest(li, ri) AS right_id, CASE WHEN li < ri THEN lp ELSE rp END AS left_path, CASE WHEN li < ri THEN rp ELSE lp END AS right_path, "primary", pd, dd, ad FROM m WHERE pd <= 6 AND dd <= 10 AND ad <= 0.05)"""


@register(f"SELECT left_id, right_id, left_path, right_path, \"primary\", pd, dd, round(ad, 12) AS ad FROM {_NEAR_IMAGES}")
def near_image_pairs(spark, sf_dir):
    return visual.near_pairs(hashed_images(spark, sf_dir)).withColumn("ad", F.round("ad", 12))


@register(
    f"""WITH e AS (SELECT left_id, right_id, left_path, right_path, "primary", trusted, true AS equal, -1 AS pd, -1 AS dd, 0.0::DOUBLE AS ad FROM {_pairs_sql(20)}),
    u AS (SELECT * FROM e UNION ALL SELECT left_id, right_id, left_path, right_path, "primary", false, false, pd, dd, ad FROM {_NEAR_IMAGES}),
    r AS (SELECT left_id, right_id, left_path, right_path, bool_or("primary") AS "primary", bool_or(trusted) AS trusted, bool_or(equal) AS equal, min(pd) AS pd, min(dd) AS dd, min(ad) AS ad FROM u GROUP BY ALL),
    s AS (SELECT *, NOT equal AND pd <= 4 AND dd <= 4 AND ad <= 0.02 AS strong, NOT equal AND pd <= 1 AND dd <= 1 AND ad <= 0.01 AS very FROM r),
    g AS (SELECT left_id, right_id, first(left_path ORDER BY pd, dd, ad, left_path, right_path) AS left_path, first(right_path ORDER BY pd, dd, ad, left_path, right_path) AS right_path, first(pd ORDER BY pd, dd, ad, left_path, right_path) AS pd,
        first(dd ORDER BY pd, dd, ad, left_path, right_path) AS dd, first(ad ORDER BY pd, dd, ad, left_path, right_path) AS ad, count(*) FILTER (trusted) AS e, count(*) FILTER (strong) AS s, count(*) AS n,
        bool_or(trusted AND "primary") AS pe, bool_or((strong OR very) AND "primary") AS pn, bool_or(equal) AS any_equal FROM s GROUP BY left_id, right_id)
    SELECT left_id, right_id, left_path, right_path, CASE WHEN e > 0 AND (pe OR e >= 2) THEN 'exact' WHEN e > 0 THEN 'exact_candidate' WHEN any_equal THEN 'common_image' ELSE 'near_candidate' END AS match_kind,
        e AS exact_image_pairs, s AS strong_image_pairs, n AS candidate_image_pairs, greatest(pd, 0)::SMALLINT AS phash_distance, greatest(dd, 0)::SMALLINT AS dhash_distance, round(ad, 12) AS aspect_ratio_delta,
        pe OR pn AS primary_match, pe OR e >= 2 AS auto_merge FROM g"""
)
def pair_rollup(spark, sf_dir):
    return visual.visual_pairs(hashed_images(spark, sf_dir)).withColumn("aspect_ratio_delta", F.round("aspect_ratio_delta", 12))


#: Product texts with the verdict that the rules must give: category (0: first), name, description, rule, verdict, conflict.
CARDS = [
    (0, "Витамины", "Продукт является биологически активной добавкой к пище", "EXPLICIT_BAD_MARKER", 1, False),
    (0, "Травяной чай", "Не является биологически активной добавкой", "EXPLICIT_NOT_BAD", 0, False),
    (0, "BCAA 2:1:1", "Аминокислоты, спортивное питание", "SPORT_NUTRITION", 0, False),
    (0, "БАД в капсулах", "Также указано: спортивное питание", "INSUFFICIENT_EVIDENCE", None, True),
    (0, "Omega", "A dietary supplement", "DIETARY_SUPPLEMENT_MARKER", 1, False),
    (1, "Спички хозяйственные", "Предназначены для создания открытого огня", "INDEPENDENT_IGNITION_SOURCE", 1, False),
    (1, "Чехол для зажигалки", "Защитный кожаный футляр для зажигалки", "INSUFFICIENT_EVIDENCE", None, False),
    (1, "Газовая горелка", "Работает от внешнего баллона. Баллон приобретается отдельно", "DEVICE_WITHOUT_INCLUDED_FUEL", 0, False),
    (1, "Газовый баллон 12 л (пустой)", "Пустой баллон поставляется без газа", "NO_FLAMMABLE_CONTENT", 0, False),
    (1, "Газовая плита", "Оснащена встроенным электроподжигом", "DEVICE_WITH_EMBEDDED_IGNITION", 0, False),
    (1, "Фильтр для воды", "Картридж с активированным углём", "FLAMMABLE_COMPONENT_ONLY", 0, False),
    (1, "Газ для зажигалок", "Баллон заправлен газом, но поставляется без газа", "INSUFFICIENT_EVIDENCE", None, True),
]
_CARD_SQL = "(VALUES " + ", ".join(f"({i}, '{rules.S.FLAMMABLE if c else rules.S.SUPPLEMENT}', '{r}', {'NULL' if v is None else v}, {str(k).lower()})" for i, (c, _, _, r, v, k) in enumerate(CARDS)) + ") c(card, category, rule_id, verdict, conflict)"
_CARD_ROWS = f"(SELECT doc_id AS id, c.category, c.rule_id, c.verdict::TINYINT AS verdict, c.conflict, doc_id % 5 % 2 AS true_label FROM documents d JOIN {_CARD_SQL} ON c.card = d.doc_id % {len(CARDS)})"


def card_products(spark, sf_dir):
    """Every document with a product card's texts put around its own."""
    cards = spark.createDataFrame([(i, (rules.S.FLAMMABLE if c else rules.S.SUPPLEMENT), n, d) for i, (c, n, d, *_) in enumerate(CARDS)], "card long, category string, name string, lead string")
    docs = table(spark, sf_dir, "documents").withColumn("card", F.col("doc_id") % len(CARDS))
    return docs.join(cards, "card").select(F.col("doc_id").alias("id"), "name", F.concat("lead", F.lit(" . "), "text").alias("description"), "category")


def card_features(spark, sf_dir):
    rows = card_products(spark, sf_dir)
    f = rows.select("id", "category", (F.col("id") % 5 % 2).alias("label"), F.concat(F.lit("g"), F.col("id").cast("string")).alias("group_id"), (F.col("id") % 3).cast("byte").alias("fold"))
    return rules.rule_features(rows, f)


@register(f"SELECT id, category, rule_id, verdict, conflict FROM {_CARD_ROWS}")
def rule_verdicts(spark, sf_dir):
    return rules.decide(card_products(spark, sf_dir)).select("id", "category", F.col("text_rule_id").alias("rule_id"), F.col("text_rule_verdict").alias("verdict"), F.col("text_rule_conflict").alias("conflict"))


@register()
def rule_features(spark, sf_dir):
    return card_features(spark, sf_dir)


@register(
    f"""SELECT category, count(*) AS rows, count(verdict) AS decided, count(*) FILTER (conflict) AS conflicts, count(*) FILTER (verdict = true_label) AS "right", count(verdict) / count(*) AS coverage,
    count(*) FILTER (verdict = true_label) / nullif(count(verdict), 0) AS accuracy FROM {_CARD_ROWS} GROUP BY category"""
)
def rule_coverage(spark, sf_dir):
    return rules.rule_coverage(card_features(spark, sf_dir))


@register(f"SELECT category, rule_id AS text_rule_id, count(*) AS rows FROM {_CARD_ROWS} GROUP BY ALL")
def rule_id_distribution(spark, sf_dir):
    return rules.rule_distribution(card_features(spark, sf_dir))


@register(f"SELECT category, verdict AS text_rule_verdict, count(*) AS rows, avg((verdict = true_label)::INT) AS accuracy FROM {_CARD_ROWS} WHERE verdict IS NOT NULL GROUP BY ALL")
def verdict_quality(spark, sf_dir):
    return rules.verdict_quality(card_features(spark, sf_dir))


@register(
    f"""SELECT id, category, (id % 3)::TINYINT AS fold, 'g' || id AS group_id, true_label, rule_id AS text_rule_id, verdict AS text_rule_verdict, verdict IS NOT NULL AS has_verdict, conflict,
    (category = '{rules.S.SUPPLEMENT}')::INT AS marker_sources, (category = '{rules.S.FLAMMABLE}')::INT AS object_types, true AS counts_agree, true AS values_whole, 0 AS faulty_facts FROM {_CARD_ROWS}"""
)
def rule_feature_checks(spark, sf_dir):
    """rule_features' rows with what must hold of the columns whose values SQL cannot give."""
    f = card_features(spark, sf_dir)
    ones = lambda prefix: sum((F.col(c).cast("int") for c in f.columns if c.startswith(prefix)), F.lit(0))
    listed, category = evidence.facts(F.col("text_evidence_json")), F.col("category")
    return f.select(
        "id", "category", "fold", "group_id", "true_label", "text_rule_id", "text_rule_verdict", F.col("text_rule_has_verdict").alias("has_verdict"), F.col("text_rule_conflict").alias("conflict"),
        ones("text_marker_source_").alias("marker_sources"), ones("text_object_type_").alias("object_types"),
        ((F.col("text_evidence_count") == F.col("text_name_evidence_count") + F.col("text_description_evidence_count")) & (F.size(listed) == F.col("text_evidence_count"))).alias("counts_agree"),
        (F.size(evidence.value_faults(category, F.col("text_values_json"))) == 0).alias("values_whole"),
        F.size(F.filter(listed, lambda x: F.size(evidence.fact_faults(category, x)) > 0)).alias("faulty_facts"),
    )


def made_facts(spark, sf_dir):
    """A fact for each document, right or wrong in field, value, source, text and index by its id."""
    pick = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("doc_id") / n) % len(values) + 1).cast("int"))
    fact = F.concat(F.lit('{"field":"'), pick(1, _FACT_FIELDS), F.lit('","value":'), pick(3, _FACT_VALUES), F.lit(',"source":"'), pick(5, _FACT_SOURCES), F.lit('"'), pick(7, _FACT_TEXTS), pick(11, _FACT_INDEXES), F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(rules.S.SUPPLEMENT).alias("category"), fact.alias("fact"))


_FACT_FIELDS, _FACT_VALUES, _FACT_SOURCES = ("sport_nutrition", "marker_source", "no_such"), ("true", "1", '"ocr"', '"unknown"', "null"), ("name", "ocr", "image", "label")
_FACT_TEXTS, _FACT_INDEXES = ("", ',"text":"seen"', ',"text":"  "', ',"text":null', ',"text":7'), ("", ',"image_index":0', ',"image_index":-1', ',"image_index":"0"', ',"image_index":0,"label":1')
_chosen = lambda n, values: "(CASE (doc_id // %d) %% %d %s END)" % (n, len(values), " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)))


@register(
    f"""WITH f AS (SELECT doc_id, {_chosen(1, _FACT_FIELDS)} AS f, {_chosen(3, _FACT_VALUES)} AS v, {_chosen(5, _FACT_SOURCES)} AS s, {_chosen(7, _FACT_TEXTS)} AS t, {_chosen(11, _FACT_INDEXES)} AS i FROM documents),
    b AS (SELECT *, t IN (',"text":"seen"', ',"text":"  "', ',"text":7') AS has_text, i <> '' AS has_index FROM f)
    SELECT doc_id, concat_ws(',', CASE WHEN i LIKE '%label%' THEN 'shape' END, CASE WHEN f = 'no_such' THEN 'field' END,
        CASE WHEN NOT ((f = 'sport_nutrition' AND v IN ('true', '"unknown"')) OR (f = 'marker_source' AND v IN ('"ocr"', '"unknown"'))) THEN 'value' END, CASE WHEN v = '"unknown"' THEN 'unknown' END, CASE WHEN s = 'label' THEN 'source' END,
        CASE WHEN (has_text AND t <> ',"text":"seen"') OR (s IN ('name', 'ocr') AND NOT has_text) THEN 'text' END,
        CASE WHEN (has_index AND i NOT LIKE ',"image_index":0%') OR (s IN ('ocr', 'image') AND NOT has_index) OR (s = 'name' AND has_index) THEN 'image_index' END) AS faults FROM b"""
)
def evidence_faults(spark, sf_dir):
    return made_facts(spark, sf_dir).select("doc_id", F.array_join(evidence.fact_faults(F.col("category"), F.col("fact")), ",").alias("faults"))


@register(f"SELECT id, coalesce(verdict, 1)::INT AS verdict, true AS length_fits, rule_id <> 'INSUFFICIENT_EVIDENCE' AS quotes FROM {_CARD_ROWS}")
def explanation_checks(spark, sf_dir):
    """template_explanations' rows: verdict, whether the comment is of the length asked for, whether it quotes a phrase."""
    size = F.length("result") - 1
    done = explain.explained(rules.decide(card_products(spark, sf_dir)))
    return done.select("id", F.substring("result", -1, 1).cast("int").alias("verdict"), size.between(explain.LEAST, explain.MOST).alias("length_fits"), F.col("result").contains("«").alias("quotes"))


@register()
def template_explanations(spark, sf_dir):
    return explain.explained(rules.decide(card_products(spark, sf_dir)))


_WORD_COUNTS = r"""w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}') AS l FROM documents),
    t AS (SELECT id, unnest(l || list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS term FROM w), c AS (SELECT id, term, count(*) AS n FROM t GROUP BY ALL)"""


@register(
    f"""WITH {_WORD_COUNTS}, d AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2),
    r AS (SELECT id, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN d USING (term))
    SELECT id, count(*) AS terms, round(sum(w) / sqrt(sum(w * w)), 6) AS weight_sum FROM r GROUP BY id"""
)
def word_tfidf(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    done = tfidf.tfidf(rows, tfidf.word_terms)
    return done.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("weight_sum"))


@register(
    r"""WITH w AS (SELECT doc_id AS id, ' ' || unnest(regexp_split_to_array(lower(text), '\s+')) || ' ' AS p FROM documents), v AS (SELECT id, p FROM w WHERE length(p) > 2),
    g AS (SELECT id, unnest(list_transform(range(1, length(p) - n + 2), lambda i: substr(p, i, n))) AS term FROM v CROSS JOIN (VALUES (3), (4), (5)) x(n) WHERE length(p) >= n)
    SELECT term, count(DISTINCT id) AS df, count(*) AS total FROM g GROUP BY term"""
)
def char_ngram_df(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return tfidf.term_stats(rows, tfidf.char_terms)


@register()
def oof_predictions(spark, sf_dir):
    rows = products(spark, sf_dir, labelled=True)
    f = folds.stratified_group_folds(groups.text_groups(rows), n_splits=3)
    return models.out_of_fold(models.texts_of(rows, f), models.Settings(max_iter=500, categories=()))


@register(f"SELECT id, category, label AS true_label, true AS in_range, true AS consistent FROM {LABELLED}")
def oof_checks(spark, sf_dir):
    """oof_predictions' rows, with the operator's own number of iterations, and what must hold of scores and disagreement."""
    rows = products(spark, sf_dir, labelled=True)
    f = folds.stratified_group_folds(groups.text_groups(rows), n_splits=3)
    done = models.out_of_fold(models.texts_of(rows, f), models.Settings(categories=()))
    votes = [F.col("word_svc_margin") >= 0, F.col("char_svc_margin") >= 0, F.col("text_logreg_probability") >= 0.5]
    agree = (votes[0] == votes[1]) & (votes[1] == votes[2])
    return done.select("id", "category", "true_label", F.col("text_logreg_probability").between(0, 1).alias("in_range"), ((F.col("text_models_disagree") == 1) == ~agree).alias("consistent"))


@register("SELECT doc_id AS id, lang AS category, true AS in_range FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang IN (SELECT lang FROM documents JOIN labels USING (doc_id))")
def score_new_rows(spark, sf_dir):
    """Models learned from all labelled documents score those without a label."""
    rows = products(spark, sf_dir, labelled=True)
    f = folds.stratified_group_folds(groups.text_groups(rows), n_splits=3)
    fitted = models.final_models(models.texts_of(rows, f), models.Settings(categories=()))
    new = products(spark, sf_dir).filter(F.col("label").isNull() & F.col("category").isin(*fitted.models))
    done = models.score(new.select("id", "category", X.composed("name", "description").alias("text")), fitted)
    return done.select("id", "category", F.col("text_logreg_probability").between(0, 1).alias("in_range"))


def scored(spark, sf_dir):
    """Labelled documents with three made-up scores."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("quality").cast("long").alias("true_label"), (F.col("n_chars") % 7 - 3).cast("float").alias("word_svc_margin"),
        (F.col("n_chars") % 11 - 4).cast("float").alias("char_svc_margin"), (F.col("n_chars") % 100 / 100).cast("float").alias("text_logreg_probability"),
    )


_SCORED = "(SELECT lang AS category, quality AS y, (n_chars % 7 >= 3)::INT AS w, (n_chars % 11 >= 4)::INT AS c, (n_chars % 100 >= 50)::INT AS g, (n_chars % 100) / 100 AS score, doc_id AS id FROM documents JOIN labels USING (doc_id))"
_F1 = "CASE WHEN count(*) FILTER (y = 1 OR p = 1) = 0 THEN 0.0 ELSE 2 * count(*) FILTER (y = 1 AND p = 1) / (2 * count(*) FILTER (y = 1 AND p = 1) + count(*) FILTER (y <> p)) END"


@register(f"SELECT {_F1} AS f1 FROM (SELECT y, w AS p FROM {_SCORED})")
def binary_f1(spark, sf_dir):
    return metrics.binary_f1(metrics.votes(scored(spark, sf_dir)), predicted="word_svc")


@register(f"SELECT category, {_F1} AS f1 FROM (SELECT category, y, c AS p FROM {_SCORED}) GROUP BY category")
def category_f1(spark, sf_dir):
    return metrics.category_f1(metrics.votes(scored(spark, sf_dir)), predicted="char_svc")


@register(f"SELECT max(f1) FILTER (category = 'de') AS f1_0, max(f1) FILTER (category = 'en') AS f1_1, max(f1) FILTER (category = 'es') AS f1_2, max(f1) FILTER (category = 'fr') AS f1_3, avg(f1) AS mean_f1 FROM (SELECT category, {_F1} AS f1 FROM (SELECT category, y, w AS p FROM {_SCORED}) GROUP BY category)")
def mean_f1(spark, sf_dir):
    return metrics.mean_f1(metrics.votes(scored(spark, sf_dir)), ("de", "en", "es", "fr"), predicted="word_svc")


@register(
    f"""WITH v AS (SELECT category, y, unnest(['word_svc', 'char_svc', 'logistic_regression', 'majority_vote']) AS model, unnest([w, c, g, (w + c + g >= 2)::INT]) AS p FROM {_SCORED})
    SELECT model, category, {_F1} AS f1 FROM v GROUP BY ALL"""
)
def model_evaluation(spark, sf_dir):
    return metrics.evaluate(scored(spark, sf_dir))


@register(f"SELECT id, (w + c + g >= 2)::INT AS majority_vote, NOT (w = c AND c = g) AS disagree FROM {_SCORED}")
def majority_vote(spark, sf_dir):
    return metrics.votes(scored(spark, sf_dir)).select("id", "majority_vote", "disagree")


@register(f"SELECT category, avg((NOT (w = c AND c = g))::INT) AS share FROM {_SCORED} GROUP BY category")
def disagreement_share(spark, sf_dir):
    return metrics.disagreement(scored(spark, sf_dir))


@register(
    f"""WITH b AS (SELECT category, score AS threshold, sum(y) AS pos, count(*) AS n FROM {_SCORED} GROUP BY ALL),
    t AS (SELECT category, threshold, CASE WHEN sum(n) OVER d + sum(pos) OVER (PARTITION BY category) = 0 THEN 0.0 ELSE 2 * sum(pos) OVER d / (sum(n) OVER d + sum(pos) OVER (PARTITION BY category)) END AS f1 FROM b WINDOW d AS (PARTITION BY category ORDER BY threshold DESC))
    SELECT category, threshold, f1 FROM t QUALIFY row_number() OVER (PARTITION BY category ORDER BY f1 DESC, threshold DESC) = 1"""
)
def best_threshold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return routing.best_threshold(docs.select(F.col("lang").alias("category"), (F.col("n_chars") % 100 / 100).alias("score"), F.col("quality").alias("true_label")))


@register(f"SELECT category, least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS n, avg(score) AS mean_score, avg(y) AS positive_share FROM {_SCORED} GROUP BY ALL")
def calibration_bins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return routing.calibrated(docs.select(F.col("lang").alias("category"), (F.col("n_chars") % 100 / 100).alias("score"), F.col("quality").alias("true_label")))


def routed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    help_images, help_lora = F.col("n_chars") % 10 / 10, F.col("n_chars") % 7 / 7
    return docs.select(F.col("doc_id").alias("id"), routing.route(help_images, help_lora).alias("route"), (F.col("n_chars") % 13).alias("ocr_score"), (F.col("n_chars") % 17).alias("lora_score"))


_ROUTED = "(SELECT doc_id AS id, CASE WHEN n_chars % 10 / 10 < 0.5 THEN 'A' WHEN n_chars % 7 / 7 < 0.5 THEN 'B' ELSE 'C' END AS route, n_chars % 13 AS o, n_chars % 17 AS l FROM documents)"


@register(
    f"""SELECT id, route, CASE WHEN route <> 'A' THEN o END AS ocr_score, CASE WHEN route = 'C' THEN l END AS lora_score, (route <> 'A')::TINYINT AS has_ocr, 0::TINYINT AS has_embeddings, 0::TINYINT AS has_retrieval, (route = 'C')::TINYINT AS has_lora
    FROM {_ROUTED}"""
)
def route_simulation(spark, sf_dir):
    return routing.simulate(routed(spark, sf_dir), {"ocr": ["ocr_score"], "lora": ["lora_score"]})


@register(f"SELECT route, count(*) AS rows, count(*) / sum(count(*)) OVER () AS share, count(*) * max(CASE route WHEN 'A' THEN 0.1 WHEN 'B' THEN 1.5 ELSE 4.0 END)::DOUBLE AS cost FROM {_ROUTED} GROUP BY route")
def route_costs(spark, sf_dir):
    return routing.route_costs(routed(spark, sf_dir), {"A": 0.1, "B": 1.5, "C": 4.0})


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5).cast("int").alias("fold"), F.col("embedding").alias("vector"), (F.col("label") % 2).alias("label"))


_NEIGHBORS = """(WITH v AS MATERIALIZED (SELECT vec_id AS id, vec_id % 5 AS fold, embedding::DOUBLE[] AS x, label % 2 AS label FROM embeddings)
    SELECT a.id, b.id AS neighbor, b.label, round(1 - list_cosine_similarity(a.x, b.x), 9) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY round(1 - list_cosine_similarity(a.x, b.x), 9), b.id) AS rank
    FROM v a JOIN v b ON a.fold <> b.fold QUALIFY rank <= 10)"""


@register(f"SELECT id, rank::INT AS rank, neighbor, round(distance, 6) AS distance FROM {_NEIGHBORS}")
def fold_safe_knn(spark, sf_dir):
    return retrieval.fold_safe_neighbors(vectors(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@register(
    f"""SELECT id, avg(label) FILTER (rank <= 3) AS positive_share_3, avg(label) FILTER (rank <= 5) AS positive_share_5, avg(label) AS positive_share_10, round(min(distance) FILTER (label = 1), 6) AS nearest_positive_distance,
    round(min(distance) FILTER (label = 0), 6) AS nearest_negative_distance, round(min(distance), 6) AS ood_distance, round(min(distance) FILTER (label = 0) - min(distance) FILTER (label = 1), 6) AS neighbor_margin FROM {_NEIGHBORS} GROUP BY id"""
)
def neighbor_features(spark, sf_dir):
    v = vectors(spark, sf_dir)
    done = retrieval.neighbor_features(retrieval.fold_safe_neighbors(v), v.select("id", "label"))
    return done.withColumns({c: F.round(c, 6) for c in ("nearest_positive_distance", "nearest_negative_distance", "ood_distance", "neighbor_margin")})


@register(r"SELECT page_id, sha256(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g')) AS stripped_sha256 FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "), 256).alias("stripped_sha256"))


@register()
def plain_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.plain_text_of("html").alias("text"))


@register("SELECT doc_id, coalesce(regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(not|no|without|nicht|sans|sin)($|[^\\p{L}\\p{N}_])'), false) AS negated FROM documents")
def negation_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.lower("text").rlike(r"(?U)(?<!\w)(not|no|without|nicht|sans|sin)(?!\w)"), F.lit(False)).alias("negated"))


@register("SELECT doc_id, CASE WHEN toxic IS NULL THEN 'label_only' WHEN quality = 1 AND toxic = 0 THEN 'gold' WHEN toxic = 0 AND quality = 0 THEN 'silver_high' ELSE 'label_only' END AS tier FROM documents LEFT JOIN labels USING (doc_id)")
def quality_tiers(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    known, toxic = F.col("toxic").isNotNull(), F.coalesce(F.col("toxic") == 1, F.lit(True))
    return both.select("doc_id", routing.quality_tier(known & (F.col("quality") == 1) & ~toxic, known, toxic, F.lit(True)).alias("tier"))


@register()
def multiset_checksum(spark, sf_dir):
    return checksum.multiset_checksum(table(spark, sf_dir, "documents"))


@register("SELECT doc_id, left_tri, one_en, one_de FROM (SELECT doc_id, coalesce(toxic, -1)::TINYINT AS left_tri, coalesce(lang = 'en', false)::TINYINT AS one_en, coalesce(lang = 'de', false)::TINYINT AS one_de FROM documents LEFT JOIN labels USING (doc_id))")
def encoded_features(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.select("doc_id", N.tri_state("toxic").alias("left_tri"), *N.one_hot("lang", ("en", "de"), "one"))
