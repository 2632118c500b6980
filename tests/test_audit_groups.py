import pytest
from pyspark.sql import functions as F

from shelfmark.contracts import CATEGORIES
from shelfmark.operators import audit, folds, groups

B, FL = CATEGORIES
COLUMNS = "id long, name string, description string, category string, label long"
AUDIT = [(10, "Product A", "Same", B, 1), (11, "Product A", "Same", B, 0), (12, " product a ", " Same!! ", B, 1), (13, "Grill", "Device", FL, 0), (14, "Fuel", None, FL, 1)]
GROUPS = [
    (10, "Product A", "Same", B, 1), (11, "Product A", "Same", B, 0), (12, " product a ", " Same!! ", B, 1), (13, "Product A", "Same", FL, 0),
    (14, "Unique", "Only", FL, 0), (20, "Exact", "Raw", B, 1), (21, "Exact", "Raw", B, 1), (30, "Other", None, FL, 1),
]


@pytest.fixture(scope="module")
def cards(spark):
    return spark.createDataFrame(AUDIT, COLUMNS)


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(GROUPS, COLUMNS)


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_balance_and_gaps(cards):
    assert {(r.category, r.label): (r.n, round(r.share, 4)) for r in audit.class_balance(cards).collect()} == {(B, 0): (1, 0.3333), (B, 1): (2, 0.6667), (FL, 0): (1, 0.5), (FL, 1): (1, 0.5)}
    assert {r.column_name: (r.nulls, r.blanks) for r in audit.missing_values(cards).collect()} == {"name": (0, 0), "description": (1, 0)}


def test_blank_is_any_white_space(spark):
    df = spark.createDataFrame([(1, "  \t", "x", B, 1), (2, "", None, B, 1)], COLUMNS)
    assert {r.column_name: (r.nulls, r.blanks) for r in audit.missing_values(df).collect()} == {"name": (0, 2), "description": (1, 0)}


def test_profile(spark, cards):
    odd = cards.union(spark.createDataFrame([(10, "n", "d", "other", 7), (None, "n", "d", B, None)], COLUMNS))
    r = audit.profile(odd).first()
    assert (r["rows"], r.unique_ids, r.duplicate_id_rows, r.unknown_categories, r.invalid_labels) == (7, 6, 2, 1, 2)
    indexed = cards.withColumn("_c0", F.col("id") - 10)
    assert audit.unexpected_columns(indexed) == ["_c0"] and audit.index_like_columns(indexed) == ["_c0"]
    assert audit.index_like_columns(cards.withColumn("_c0", F.col("id"))) == []
    with pytest.raises(ValueError, match="missing required columns: label"):
        audit.profile(cards.drop("label"))


def test_duplicates(cards):
    exact = audit.exact_duplicates(cards).collect()
    assert [(r.ids, r.labels, r.label_conflict) for r in exact] == [([10, 11], [0, 1], True)]
    near = audit.near_duplicates(cards).collect()
    assert [(r.ids, r.raw_variants, r.label_conflict) for r in near] == [([10, 11, 12], 2, True)]
    assert tuple(audit.duplicate_counters(audit.near_duplicates(cards)).first()) == (1, 3, 2, 1)


def test_null_labels_conflict_with_known_ones(spark):
    df = spark.createDataFrame([(1, "a", "b", B, 1), (2, "a", "b", B, None)], COLUMNS)
    assert [(r.labels, r.label_conflict) for r in audit.exact_duplicates(df).collect()] == [([1, None], True)]


def test_text_groups(source):
    g = by_id(groups.text_groups(source))
    assert {(g[i].group_id, g[i].group_size, g[i].duplicate_kind) for i in (10, 11, 12, 13)} == {(g[10].group_id, 4, "normalized")}
    assert {(g[i].group_size, g[i].duplicate_kind) for i in (20, 21)} == {(2, "exact")} and g[14].duplicate_kind == g[30].duplicate_kind == "unique"
    assert [g[i].label_conflict for i in (10, 11, 12, 13)] == [True, True, True, False]
    assert all(len(r.group_id) == 26 and r.group_id.startswith("g_") for r in g.values())
    groups.validate_groups(groups.text_groups(source), source)
    groups.check_collisions(source)


def test_group_ids_do_not_depend_on_order(source):
    assert by_id(groups.text_groups(source.orderBy(F.desc("id")))) == by_id(groups.text_groups(source))


@pytest.mark.parametrize(
    ("edges", "want"),
    [
        ([(14, 20, True), (20, 21, True), (30, 14, False)], {14: (3, "mixed"), 20: (3, "mixed"), 21: (3, "mixed"), 30: (1, "unique")}),
        ([(14, 30, True)], {14: (2, "visual"), 30: (2, "visual"), 20: (2, "exact")}),
        ([(14, 30, False)], {14: (1, "unique")}),
    ],
)
def test_visual_merge(spark, source, edges, want):
    text = groups.text_groups(source)
    merged = by_id(groups.merge_visual(text, spark.createDataFrame(edges, "left_id long, right_id long, auto_merge boolean")))
    assert {i: (merged[i].group_size, merged[i].duplicate_kind) for i in want} == want
    if (14, 30, True) in edges:
        assert merged[14].label_conflict and merged[30].label_conflict
    assert merged[10].group_id == by_id(text)[10].group_id


def test_group_rejections(spark, source):
    pairs = spark.createDataFrame([(14, 999, True)], "left_id long, right_id long, auto_merge boolean")
    with pytest.raises(ValueError, match="unknown ids"):
        groups.merge_visual(groups.text_groups(source), pairs)
    with pytest.raises(ValueError, match="duplicate id"):
        groups.validate_source(source.union(source.limit(1)))
    with pytest.raises(ValueError, match="actual group size"):
        groups.validate_groups(groups.text_groups(source).withColumn("group_size", F.lit(999).cast("long")), source)
    with pytest.raises(ValueError, match="no rows"):
        groups.validate_source(source.limit(0))


@pytest.fixture(scope="module")
def members(spark):
    rows, i = [], 0
    for c in CATEGORIES:
        for label in (0, 1):
            for n in range(3):
                rows.append((i, c, label, f"group-{c}-{label}-{n}"))
                i += 1
    return spark.createDataFrame([*rows, (12, B, 0, "conflicting-group"), (13, B, 1, "conflicting-group")], "id long, category string, label long, group_id string")


def test_folds(members):
    f = folds.stratified_group_folds(members, 3)
    rows = f.collect()
    assert f.columns == ["id", "category", "label", "group_id", "fold"] and len(rows) == 14 and {r.fold for r in rows} == {0, 1, 2}
    folds.validate_folds(f, members, 3)
    assert folds.leaks(f).isEmpty() and len({r.fold for r in rows if r.group_id == "conflicting-group"}) == 1
    again = folds.stratified_group_folds(members.orderBy(F.desc("id")), 3)
    assert sorted(again.collect()) == sorted(rows)
    assert sorted(folds.stratified_group_folds(members, 3, seed=43).collect()) != sorted(rows)
    assert folds.max_deviation(f).first().max_deviation < 0.8687


def test_folds_of_many_groups_are_even(spark):
    many = spark.range(4000).select("id", F.lit(B).alias("category"), (F.col("id") % 10 == 0).cast("long").alias("label"), F.concat(F.lit("g"), (F.col("id") / 2).cast("long").cast("string")).alias("group_id"))
    f = folds.stratified_group_folds(many, 5)
    folds.validate_folds(f, many, 5)
    assert folds.max_deviation(f).first().max_deviation < 0.02


def test_fold_rejections(members):
    with pytest.raises(ValueError, match="at least 2"):
        folds.validate_inputs(members, members, 1)
    with pytest.raises(ValueError, match="category/label values differ"):
        folds.validate_inputs(members.withColumn("label", 1 - F.col("label")), members, 3)
    with pytest.raises(ValueError, match="fewer than"):
        folds.validate_inputs(members, members, 99)
    with pytest.raises(ValueError, match="string"):
        folds.validate_inputs(members, members.withColumn("group_id", F.lit(1)), 3)
    folds.validate_inputs(members, members, 3)


def test_empty_cells_count_as_zero(spark):
    f = spark.createDataFrame([(1, B, 0, "a", 0), (2, B, 1, "b", 1)], "id long, category string, label long, group_id string, fold int")
    assert {(r.label, r.fold): r.n for r in folds.fold_balance(f).collect()} == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1}
    assert folds.max_deviation(f).first().max_deviation == 1.0
