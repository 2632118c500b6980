from shelfmark.operators import audit, groups
from shelfmark.plans import queries as catalogue


def passes(df):
    """How often the plan normalises texts."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")


def test_groups_read_texts_once(spark):
    g = groups.text_groups(catalogue.catalogue(spark, "/root/testdata/sf0.001"))
    assert passes(g) == 0 and g.count() == 400


def test_duplicates_normalise_texts_once(spark):
    found = audit.near_duplicates(catalogue.catalogue(spark, "/root/testdata/sf0.001"))
    assert passes(found.select("category", "size", "ids")) == 0 and passes(found) <= 2  # a group's own name and description


def test_duplicates_with_ids_that_repeat(spark):
    rows = [(1, "a", "x!"), (1, "b", "y"), (2, "A", "x"), (2, "b", "y"), (2, "b", "y?"), (None, "q", None), (None, "q ", "")]
    df = spark.createDataFrame([(i, "c", 0, n, d) for i, n, d in rows], "id long, category string, label long, name string, description string")
    near = {(r.normalized_name, r.normalized_description, r.size, r.raw_variants) for r in audit.near_duplicates(df).collect()}
    assert near == {("a", "x", 2, 2), ("b", "y", 3, 2), ("q", "", 2, 2)}
    assert [tuple(r)[1:4] for r in audit.exact_duplicates(df).collect()] == [("b", "y", 2)]
