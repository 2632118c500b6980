import itertools
import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark import cli
from shelfmark.contracts import CATEGORIES, FOLDS, IMAGE_HASHES, check_alignment, conform, join_one_to_one, require_columns, same_rows
from shelfmark.functions import numbers
from shelfmark.operators import checksum, images, manifest, metrics, models, retrieval, routing, rules, tfidf, visual
from shelfmark.plans import queries as catalogue
from shelfmark.sources import tables

B, FL = CATEGORIES


def png(pixels):
    """A PNG of rows of (r, g, b)."""
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def drawing(variant, w=96, h=72, noise=0):
    r = random.Random(variant)
    boxes = [(r.randrange(w), r.randrange(h), r.randrange(8, 40), r.randrange(8, 40), tuple(r.randrange(256) for _ in range(3))) for _ in range(12)]
    n = random.Random(99)

    def at(x, y):
        c = (240, 240, 240)
        for bx, by, bw, bh, colour in boxes:
            if bx <= x < bx + bw and by <= y < by + bh:
                c = colour
        return tuple(min(255, max(0, v + n.randrange(-noise, noise + 1))) for v in c) if noise else c

    return [[at(x, y) for x in range(w)] for y in range(h)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    good, other = png(drawing(1, 12, 7)), png(drawing(2, 8, 9))
    for path, data in {"1/0.png": good, "1/1.png": other, "1/not_number.png": good, "99/0.png": good, "invalid/0.png": good, "root.png": good, "1/.hidden.png": good, "__MACOSX/metadata.png": good, ".DS_Store": b"x", "2/0.jpg": b"broken"}.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(root)


def test_discovery(folder):
    files, ignored = tables.discover_files(folder)
    assert len(files) == 7 and ignored == [".DS_Store", "1/.hidden.png", "__MACOSX/metadata.png"]
    with pytest.raises(FileNotFoundError):
        tables.discover_files(folder + "/none")


def test_scan(spark, folder):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    found = images.scan_images(spark, folder, ids)
    images.validate_images(found, ids)
    rows = {r.relative_path: r for r in found.collect()}
    assert len(rows) == 7
    assert (rows["1/0.png"].width, rows["1/0.png"].height, rows["1/0.png"].format, rows["1/0.png"].mode, rows["1/0.png"].extension) == (12, 7, "PNG", "RGB", ".png")
    assert rows["invalid/0.png"].id is None and rows["root.png"].id is None and rows["1/not_number.png"].image_index is None
    bad = rows["2/0.jpg"]
    assert bad.status == "error" and bad.error and bad.format is None and bad.in_dataset and not rows["99/0.png"].in_dataset
    c = images.coverage(found, ids).first()
    assert (c.missing_ids, c.orphan_ids, c.orphan_files, c.ids_without_readable_files, c.unreadable_files, c.invalid_id_paths, c.invalid_image_indices) == (1, 1, 1, 2, 1, 2, 2)
    hashes = images.hash_images(spark, folder, found)
    visual.validate_hashes(hashes, found)
    assert hashes.count() == 2 and all(len(r.phash) == 16 == len(r.dhash) for r in hashes.collect())


def test_hashes_of_close_and_different_pictures():
    gray = lambda p: np.array(p, float) @ np.array([0.299, 0.587, 0.114])
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    base, close, other = (gray(drawing(*x)) for x in ((1, 96, 72, 0), (1, 96, 72, 6), (7, 96, 72, 0)))
    assert bits(images.phash(base), images.phash(close)) <= 6 and bits(images.phash(base), images.phash(other)) > 10
    assert images.shrink(np.arange(12.0).reshape(3, 4), 3, 4).tolist() == np.arange(12.0).reshape(3, 4).tolist()


def exif(turn, order="II"):
    pack = "<" if order == "II" else ">"
    tiff = order.encode() + struct.pack(pack + "HIHHHIHHHHIHH", 42, 8, 2, 0x0100, 4, 1, 0, 0, 0x0112, 3, 1, turn, 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_orientation():
    assert [images.orientation(exif(k, o)) for o in ("II", "MM") for k in range(1, 9)] == [*range(1, 9)] * 2
    assert [images.orientation(x) for x in (b"", b"\xff\xd8\xff\xda", png([[(0, 0, 0)]]), exif(9), exif(6)[:20])] == [1] * 5
    gray = np.floor(np.random.default_rng(2).random((40, 56)) * 256)
    gray[:20, :30] = 250
    for k, (p, d) in zip(images.TURNS, images.turned_hashes(gray), strict=True):
        whole = images.TURNS[k](gray)
        bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
        assert bits(p, images.phash(whole)) <= 2 and bits(d, images.dhash(whole)) <= 2
    assert images.turned_hashes(gray)[0] == (images.phash(gray), images.dhash(gray))
    assert images.TURNS[6](np.array([[1, 2], [3, 4]])).tolist() == [[3, 1], [4, 2]]  # a quarter to the right


def test_shrink_is_a_windowed_sinc():
    w = images._lanczos(12, 4)
    want = np.array([[np.sinc((j + 0.5 - (i + 0.5) * 3) / 3) * np.sinc((j + 0.5 - (i + 0.5) * 3) / 9) if abs(j + 0.5 - (i + 0.5) * 3) < 9 else 0 for j in range(12)] for i in range(4)])
    assert np.allclose(w, want / want.sum(axis=1, keepdims=True))
    assert images.shrink(np.full((50, 70), 77.0), 8, 9).tolist() == np.full((8, 9), 77.0).tolist()


def hash_rows(spark, rows):
    full = [(i, k, f"{i}/{k}.png", sha, p, d, 100, 80, "ok", None) for i, k, sha, p, d in rows]
    return spark.createDataFrame(full, IMAGE_HASHES)


ZERO = "0" * 16


def test_pairs(spark):
    far, near = "f" * 16, "000000000000000f"
    rows = [(1, 0, "a", "00ff00ff00ff00ff", ZERO), (2, 0, "a", "00ff00ff00ff00ff", ZERO), (3, 1, "b", far, ZERO), (4, 1, "b", far, ZERO), (5, 0, "c", ZERO, ZERO), (6, 0, "d", near, ZERO)]
    got = {(r.left_id, r.right_id): r for r in visual.visual_pairs(hash_rows(spark, rows)).collect()}
    assert set(got) == {(1, 2), (3, 4), (5, 6)}
    assert (got[1, 2].match_kind, got[1, 2].primary_match, got[1, 2].auto_merge, got[1, 2].phash_distance) == ("exact", True, True, 0)
    assert (got[3, 4].match_kind, got[3, 4].primary_match, got[3, 4].auto_merge) == ("exact_candidate", False, False)
    assert (got[5, 6].match_kind, got[5, 6].phash_distance, got[5, 6].primary_match, got[5, 6].auto_merge) == ("near_candidate", 4, True, False)
    visual.validate_pairs(visual.visual_pairs(hash_rows(spark, rows)), spark.range(1, 7))


def test_common_files_make_a_star(spark):
    rows = hash_rows(spark, [(i, 0, "same", ZERO, ZERO) for i in (3, 1, 2)])
    got = visual.visual_pairs(rows, visual.Limits(most_products=2)).collect()
    assert sorted((r.left_id, r.right_id, r.match_kind, r.auto_merge) for r in got) == [(1, 2, "common_image", False), (1, 3, "common_image", False)]


def test_hamming_join_misses_nothing(spark):
    r = random.Random(5)
    own = {r.getrandbits(64) - 2**63 for _ in range(40)}
    own |= {h ^ sum(1 << b for b in r.sample(range(63), r.randrange(1, 8))) for h in list(own)}
    got = {(x.a, x.b): x.distance for x in visual.hamming_pairs(spark.createDataFrame([(h,) for h in own], "h long"), 6).collect()}
    want = {(a, b): ((a ^ b) & (2**64 - 1)).bit_count() for a, b in itertools.permutations(own, 2) if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 6}
    assert got == want
    assert spark.range(1).select(numbers.long_of_hex(F.lit("ffffffffffffffff")).alias("x"), numbers.hex_of_long(F.lit(255)).alias("y")).first() == (-1, "00000000000000ff")


def parts(spark):
    source = spark.createDataFrame([(1, " Product A! ", "TEXT", B, 0), (2, "Product A", None, B, 1), (3, "Match", "Near", FL, 0), (4, "Solo", "Other", FL, 1)], "id long, name string, description string, category string, label long")
    g = spark.createDataFrame([(1, B, 0, "g1", 2, "mixed", True), (2, B, 1, "g1", 2, "mixed", True), (3, FL, 0, "g2", 1, "unique", False), (4, FL, 1, "g3", 1, "unique", False)], "id long, category string, label long, group_id string, group_size long, duplicate_kind string, label_conflict boolean")
    f = conform(spark.createDataFrame([(1, B, 0, "g1", 0), (2, B, 1, "g1", 0), (3, FL, 0, "g2", 1), (4, FL, 1, "g3", 0)], "id long, category string, label long, group_id string, fold int"), FOLDS)
    i = spark.createDataFrame([(1, "ok", True), (1, "ok", True), (2, "error", True), (4, "ok", True)], "id long, status string, in_dataset boolean")
    return source, g, f, i


def test_manifest(spark):
    source, g, f, i = parts(spark)
    m = manifest.product_manifest(source, g, f, i)
    rows = m.orderBy("id").collect()
    assert [r.normalized_name for r in rows] == ["product a", "product a", "match", "solo"] and [r.normalized_description for r in rows] == ["text", "", "near", "other"]
    assert [r.image_count for r in rows] == [2, 0, 0, 1]
    manifest.validate_manifest(m, source, g, f, i)
    with pytest.raises(ValueError, match="several folds"):
        manifest.validate_manifest(m.withColumn("fold", F.when(F.col("id") == 2, 1).otherwise(F.col("fold")).cast("byte")), source, g, f, i)
    with pytest.raises(ValueError, match="unknown"):
        manifest.product_manifest(source, g, f, i.union(spark.createDataFrame([(999, "ok", True)], "id long, status string, in_dataset boolean")))
    with pytest.raises(ValueError, match="values differ"):
        check_alignment(source, g.withColumn("label", 1 - F.col("label")))


def test_contract_helpers(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    with pytest.raises(ValueError, match="repeats"):
        join_one_to_one(a.union(a), a.withColumnRenamed("v", "w"))
    with pytest.raises(ValueError, match="id sets differ"):
        join_one_to_one(a, a.filter("id = 1").withColumnRenamed("v", "w"))
    with pytest.raises(ValueError, match="missing required columns: w"):
        require_columns(a, ["w"])
    assert same_rows(a, a.orderBy(F.desc("id"))) and not same_rows(a, a.union(a))
    with pytest.raises(Exception, match="no entry"):
        a.select(numbers.mapped("v", {"x": 1})).collect()


@pytest.mark.parametrize(("rows", "want"), [([(1, 1), (1, 0), (0, 1), (0, 0)], 0.5), ([(0, 0)], 0.0), ([(1, 1)], 1.0)])
def test_binary_f1(spark, rows, want):
    assert metrics.binary_f1(spark.createDataFrame(rows, "true_label int, prediction int")).first().f1 == want


def test_mean_f1(spark):
    df = spark.createDataFrame([(1, 1, B), (1, 0, B), (0, 1, B), (0, 0, B), (1, 1, FL), (0, 0, FL)], "true_label int, prediction int, category string")
    assert tuple(metrics.mean_f1(df).first()) == (0.5, 1.0, 0.75)
    with pytest.raises(ValueError, match="absent"):
        metrics.mean_f1(df.filter(F.col("category") == B))
    with pytest.raises(ValueError, match="outside 0/1"):
        metrics.mean_f1(df.withColumn("prediction", F.lit(2)))


def test_checksums(spark):
    a = spark.createDataFrame([(2, "б"), (1, None)], "id long, v string")
    assert checksum.ordered_checksum(a) == checksum.ordered_checksum(a.orderBy("id")) != checksum.ordered_checksum(a.filter("id = 1"))
    assert checksum.multiset_checksum(a).first() == checksum.multiset_checksum(a.repartition(3)).first()
    assert checksum.multiset_checksum(a.limit(0)).first()["rows"] == 0


def test_char_terms():
    got = tfidf.char_terms("a  bcd")
    assert sorted(got) == sorted([" a ", " bc", "bcd", "cd ", " bcd", "bcd ", " bcd "])


def test_word_terms():
    got = tfidf.word_terms("ёж и лес x лес")
    assert sorted(got) == sorted(["ёж", "лес", "лес", "ёж лес", "лес лес"])


def test_tfidf_weights(spark):
    rows = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, "")], "id long, text string")
    got = {(r.id, r.term): r.weight for r in tfidf.tfidf(rows, lambda t: tfidf.word_terms(t, 1, 1), min_df=1).collect()}
    idf = lambda df: np.log(4 / (1 + df)) + 1
    a, b = (1 + np.log(2)) * idf(1), idf(2)
    assert got[1, "aa"] == pytest.approx(a / np.hypot(a, b)) and got[1, "bb"] == pytest.approx(b / np.hypot(a, b))


@pytest.fixture(scope="module")
def cards(spark):
    """Two categories, three folds, labels told apart by words; one group per row."""
    rows, i = [], 0
    for c, good, bad in ((B, "капсулы добавка", "спортивный протеин"), (FL, "зажигалка газовая", "чехол защитный")):
        for fold in range(3):
            for label in (0, 0, 1, 1):
                rows.append((i, f"{good if label else bad} {i}", f"особый{fold}{'б' if c == B else 'л'}", c, label, fold))
                i += 1
    df = spark.createDataFrame(rows, "id long, name string, description string, category string, label long, fold int")
    f = conform(df.withColumn("group_id", F.concat(F.lit("g"), "id")), FOLDS)
    return df.drop("fold"), f


def test_oof_query_fits_whole_models(spark, monkeypatch):
    """Vocabularies, iterations and class weights are those of the reference's fast_models.yaml."""
    seen = []
    monkeypatch.setattr(models, "out_of_fold", lambda texts, settings: seen.append(settings))
    catalogue.QUERIES["oof_predictions"](spark, "/root/testdata/sf0.001")
    assert [(b.name, b.most_terms, b.min_df) for b in seen[0].blocks] == [("word", 80_000, 2), ("char", 120_000, 2)]
    assert (seen[0].c, seen[0].max_iter, seen[0].balanced) == (1.0, 500, models.Settings().balanced)


SMALL = models.Settings(max_iter=10, blocks=(tfidf.Block("word", 500, 1), tfidf.Block("char", 1000, 1)))


def test_split_vocabulary_leaves_out_the_held_back_fold(cards):
    source, f = cards
    found = tfidf.vocabulary(models.texts_of(source, f), SMALL.blocks[0])
    seen = {(r.category, r.split, r.term) for r in found.collect()}
    assert (B, 0, "особый0б") not in seen and (B, 1, "особый0б") in seen


def test_oof(spark, cards):
    source, f = cards
    r = rules.rule_features(source, f)
    oof = models.oof_table(source, f, r, SMALL)
    models.validate_oof(oof)
    assert oof.count() == 24 and metrics.evaluate(oof).filter("model = 'majority_vote'").agg(F.min("f1")).first()[0] == 1.0
    with pytest.raises(ValueError, match="base columns differ"):
        models.validate_inputs(source, f, conform(r.withColumn("true_label", 1 - F.col("true_label")), rules.FEATURES))


def test_models_score_new_rows(spark, cards, tmp_path):
    source, f = cards
    texts = models.texts_of(source, f)
    fitted, folder = models.final_models(texts, SMALL), str(tmp_path / "m")
    models.save_models(fitted, folder, spark)
    again = models.load_models(folder, spark)
    new = spark.createDataFrame([(100, B, "__name__ капсулы добавка __description__ новое"), (101, B, "__name__ спортивный протеин __description__"), (102, FL, None), (103, FL, "слова которых нет")], "key long, category string, text string")
    a, b = ({r.key: r for r in models.score(new, m).collect()} for m in (fitted, again))
    assert a == b and set(a) == {100, 101, 102, 103}
    assert a[100].text_logreg_probability > 0.5 > a[101].text_logreg_probability and a[100].word_svc_margin > 0 > a[101].word_svc_margin
    assert a[102].word_svc_margin == pytest.approx(fitted.models[FL]["word_svc"].intercept, abs=1e-5)  # no known term: the intercept alone
    seen = {r.id: r.text_logreg_probability for r in models.score(texts.select("id", "category", "text"), again).collect()}
    assert all((seen[r.id] > 0.5) == bool(r.label) for r in source.collect())
    with pytest.raises(Exception, match="no vocabulary for category"):
        models.score(new.withColumn("category", F.lit("x")), again).collect()
    manifest_ = [json.loads(r.value) for r in spark.read.text(f"{folder}/manifest").collect()]
    for change, match in (({"version": 9}, "version"), ({"sha256": "0"}, "not the model that was saved")):
        bad = [json.dumps(e | change) if "blocks" not in e or "version" in change else json.dumps(e) for e in manifest_]
        spark.createDataFrame([(x,) for x in bad], "value string").write.mode("overwrite").text(f"{folder}/manifest")
        with pytest.raises(ValueError, match=match):
            models.load_models(folder, spark)


def test_features_of_a_split_are_those_of_a_table_without_the_fold(spark, cards):
    """Vectors and vocabulary of a split equal those learned from the other folds alone."""
    source, f = cards
    texts = models.texts_of(source, f).filter(F.col("category") == B)
    block = SMALL.blocks[1]
    own = tfidf.spaces(texts, (block,))[B]["char"]
    alone = tfidf.spaces(texts.filter("fold <> 1"), (block,), hold_back=False)[B]["char"]
    assert {t: w for t, w in zip(own.terms, own.idf[1]) if w} == pytest.approx(dict(zip(alone.terms, alone.idf[tfidf.WHOLE])))
    rows = tfidf.weighted(tfidf.frequencies(texts, {B: {"char": own}}, (block,)), {"char": own}, 1, (block,)).filter("fold = 1").collect()
    text = {r.id: r.text for r in texts.collect()}
    for r in rows:
        n = {t: tfidf.char_terms(text[r.id]).count(t) for t in alone.terms}
        want = np.array([(1 + np.log(n[t])) * w if n.get(t) else 0 for t, w in zip(own.terms, own.idf[1])])
        assert np.allclose(r.char.toArray(), want / (np.linalg.norm(want) or 1))


def test_neighbors_by_blocks_and_broadcast_agree(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, int(i % 3), r.normal(size=8).round(2).tolist()) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, fold int, vector array<double>")
    a = retrieval.fold_safe_neighbors(v, 4).orderBy("id", "rank").collect()
    x = np.array([x for *_, x in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(60):
        far = sorted((round(1 - float(x[i] @ x[j]), 9), j) for j in range(60) if j % 3 != i % 3)[:4]
        assert [n.neighbor for n in a if n.id == i] == [j for _, j in far]
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 0)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 20)
    assert retrieval.fold_safe_neighbors(v, 4).orderBy("id", "rank").collect() == a
    folds_ = spark.createDataFrame([(i, i % 3, f"g{i}") for i in range(60)], "id long, fold int, group_id string")
    routing.check_fold_safe(retrieval.fold_safe_neighbors(v, 4), folds_)
    with pytest.raises(ValueError, match="within their fold"):
        routing.check_fold_safe(retrieval.fold_safe_neighbors(v, 4), folds_.withColumn("fold", F.lit(0)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "id long, label int")
    assert retrieval.neighbor_features(retrieval.fold_safe_neighbors(v, 4), labels, (3,)).count() == 60


def test_indexed_neighbors_find_most_and_lose_no_list(spark, monkeypatch):
    r = np.random.default_rng(6)
    middles = r.normal(size=(40, 16))
    rows = [(i, int(i % 5), (middles[i % 40] + r.normal(size=16) * 0.7).tolist()) for i in range(3000)]
    v = spark.createDataFrame(rows, "id long, fold int, vector array<double>")
    exact = {(x.id, x.neighbor) for x in retrieval.fold_safe_neighbors(v, 10).collect()}
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 64)
    got = retrieval.indexed_neighbors(v, 10).collect()
    assert len({(x.id, x.neighbor) for x in got} & exact) / len(exact) >= 0.9 and all(x.id % 5 != x.neighbor % 5 for x in got)
    monkeypatch.setattr(retrieval, "SAMPLE_LIST", 4096)
    few = retrieval.indexed_neighbors(v, 10, queries=v.filter("id % 20 = 0")).collect()  # one list: exact
    assert {(x.id, x.neighbor) for x in few} == {x for x in exact if x[0] % 20 == 0}
    assert retrieval.indexed_neighbors(v.limit(0), 3).count() == 0


def test_text_image_similarity(spark):
    rows = [(1, "text", [1.0, 0.0]), (1, "image", [1.0, 0.0]), (1, "image", [0.0, 2.0]), (2, "text", [1.0, 1.0]), (3, "image", [1.0, 1.0]), (4, "text", [0.0, 0.0]), (4, "image", [1.0, 0.0])]
    got = {r.id: tuple(r)[1:] for r in retrieval.text_image_similarity(spark.createDataFrame(rows, tables.EMBEDDINGS)).collect()}
    assert got == {1: (0.5, 1.0, 1.0), 4: (0.0, 0.0, 0.0)}


def test_calibrator(spark):
    r = random.Random(4)
    rows = [(B, s := r.random(), int(r.random() < s * s)) for _ in range(4000)] + [(FL, 0.2, 1), (FL, 0.8, 0)]
    df = spark.createDataFrame(rows, "category string, score double, true_label int")
    fitted = routing.fit_calibrator(df, bins=50)
    p = {(x.category, x.bin): x.probability for x in fitted.collect()}
    own = [p[B, b] for b in range(50)]
    assert len(p) == 100 and own == sorted(own) and max(abs(x - ((b + 0.5) / 50) ** 2) for b, x in enumerate(own)) < 0.15
    assert {p[FL, b] for b in range(50)} == {0.5}
    got = routing.apply_calibrator(spark.createDataFrame([(B, 1.0), (B, None), ("x", 0.5)], "category string, score double"), fitted, bins=50)
    assert {(x.category, x.score): x.probability for x in got.collect()} == {(B, 1.0): own[-1], (B, None): None, ("x", 0.5): None}


def test_best_threshold_over_many_values(spark):
    r = random.Random(9)
    rows = [(c, round(r.random(), 4), int(r.random() < 0.4)) for c in (B, FL) for _ in range(3000)]
    df = spark.createDataFrame(rows, "category string, score double, true_label int")
    for x in routing.best_threshold(df, parts=16).collect():
        own = [(s, y) for c, s, y in rows if c == x.category]
        pos = sum(y for _, y in own)
        f1 = {t: 2 * sum(y for s, y in own if s >= t) / (sum(s >= t for s, _ in own) + pos) for t in {s for s, _ in own}}
        best = max(f1.values())
        assert x.f1 == pytest.approx(best) and x.threshold == max(t for t, f in f1.items() if abs(f - best) < 1e-12)


def test_hard_examples(spark):
    oof = spark.createDataFrame([(1, 0, 0.95, 1, 0), (2, 1, 0.5, 0, 1)], "id long, true_label long, text_logreg_probability double, text_rule_conflict int, text_models_disagree int")
    n = spark.createDataFrame([(1, 2, 0.05), (2, 1, 0.5)], "id long, neighbor long, distance double")
    got = retrieval.hard_examples(oof, n, spark.createDataFrame([(1, 0), (2, 1)], "id long, label int"))
    assert {tuple(r) for r in got.collect()} == {(1, "confident_wrong"), (1, "conflict"), (2, "disagreement"), (1, "near_opposite")}


def test_tabular_models_score_each_fold_from_the_others(spark):
    rows = [(i, B if i < 40 else FL, i % 4, float(i % 2), None if i % 5 == 0 else 1.0, i % 2 if i < 40 else 1) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, category string, fold int, a double, b double, y int")
    got = {r.id: r.score for r in models.tabular_oof(df, ["a", "b"], "y", ["a", "b"], at_once=2).collect()}
    assert len(got) == 60 and all((got[i] > 0.5) == bool(i % 2) for i in range(40)) and {got[i] for i in range(40, 60)} == {1.0}
    with pytest.raises(ValueError, match="not allowed"):
        models.tabular_oof(df, ["a"], "y", ["b"])


def test_ocr_disagreement(spark):
    df = spark.createDataFrame([(1, "БАД", "", "спортивное питание", B), (2, "БАД", "", None, B)], "id long, name string, description string, ocr_text string, category string")
    assert {r.id: (r.text_verdict, r.ocr_verdict, r.text_ocr_disagreement) for r in rules.ocr_disagreement(df).collect()} == {1: (1, 0, True), 2: (1, None, False)}


def test_dataset_ids(spark):
    images.validate_ids(spark.range(3))
    with pytest.raises(ValueError, match="repeat"):
        images.validate_ids(spark.range(3).union(spark.range(1)))
    with pytest.raises(ValueError, match="negative"):
        images.validate_ids(spark.range(-1, 2))


def test_routing(spark):
    rows = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "route string, ocr int")
    got = {r.route: (r.ocr, r.has_ocr, r.has_lora) for r in routing.simulate(rows, {"ocr": ["ocr"], "lora": []}).collect()}
    assert got == {"A": (None, 0, 0), "B": (2, 1, 0), "C": (3, 1, 1)}
    with pytest.raises(ValueError, match="forbidden input label"):
        routing.check_inputs(["label"], ["label"])
    scores = spark.createDataFrame([(B, 0.9, 1), (B, 0.6, 1), (B, 0.5, 0), (B, 0.1, 0)], "category string, score double, true_label int")
    assert tuple(routing.best_threshold(scores).first()) == (B, 0.6, 1.0)


def test_csv_and_jsonl_and_cache(spark, tmp_path):
    (tmp_path / "d.csv").write_text(',id,name,description,category,label,more\n0,1,"a ""q"", b\nc",,x,1,m\n1,2,,"",x,0,\n')
    rows = tables.read_products(spark, str(tmp_path / "d.csv")).orderBy("id").collect()
    assert rows[0].name == 'a "q", b\nc' and rows[0].description is None and rows[1].description == "" and rows[1]._c0 == 1 and rows[0].more == "m"
    schema = tables.OCR_TEXT
    compute = lambda df: df.select("id", F.lit(1).cast("long").alias("source_image_id"), F.lit("t").alias("ocr_text"), F.lit(0.5).alias("ocr_quality"))
    for n, want in ((3, 3), (5, 5)):
        assert tables.append_missing(spark, spark.range(n), str(tmp_path / "ocr"), schema, "id", compute).count() == want
    built = []
    make = lambda: (built.append(1), spark.range(3))[1]
    for _ in range(2):
        df, _reused = tables.reuse_or_build(spark, str(tmp_path / "t"), make, lambda d: None)
    assert len(built) == 1 and df.count() == 3
    tables.write_jsonl(rows_ := spark.createDataFrame([(1, None), (2, "é")], "a long, b string"), str(tmp_path / "j"))
    assert same_rows(tables.read_jsonl(spark, str(tmp_path / "j"), rows_.schema), rows_)
    tables.write_stats(str(tmp_path / "s.json"), n=1)
    with pytest.raises(ValueError, match="missing m"):
        tables.read_stats(str(tmp_path / "s.json"), ("m",))


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("version: 1\nmodel:\n  c: 1.0\n")
    assert tables.read_config(str(p), {"version": int, "model.c": float}) == {"version": 1, "model.c": 1.0}
    for text, match in (("version: 2\nmodel: {c: 1.0}", "version"), ("version: 1", "missing model.c"), ("version: 1\nmodel: {c: x}", "not float"), ("version: 1\nmodel: {c: 1.0}\nx: 1", "unknown x"), ("[]", "mapping")):
        p.write_text(text)
        with pytest.raises(ValueError, match=match):
            tables.read_config(str(p), {"version": int, "model.c": float})


def test_command_line(spark, cards, tmp_path):
    source, _ = cards
    t = {k: str(tmp_path / k) for k in ("data", "groups", "folds", "rules", "oof", "images", "manifest", "sub", "pics", "hashes", "pairs")}
    source.coalesce(1).write.csv(t["data"], header=True, escape='"')
    for i in range(3):
        (tmp_path / "pics" / str(i)).mkdir(parents=True)
        (tmp_path / "pics" / str(i) / "0.png").write_bytes(png(drawing(1 if i < 2 else 2, 40, 30)))
    run = lambda *a: cli.main([x if x.startswith("-") else t.get(x, x) for x in a], spark)
    report = lambda n: str(tmp_path / f"{n}.md")
    assert cli.main(["audit", "--data", t["data"], "--report", report("audit")], spark) == 0
    cli.main(["images", "--data", t["data"], "--images", t["pics"], "--output", t["images"], "--report", report("images")], spark)
    cli.main(["visual", "--data", t["data"], "--images", t["pics"], "--manifest", t["images"], "--hashes", t["hashes"], "--output", t["pairs"], "--stats", str(tmp_path / "s.json")], spark)
    cli.main(["groups", "--data", t["data"], "--pairs", t["pairs"], "--output", t["groups"], "--report", report("groups")], spark)
    cli.main(["folds", "--data", t["data"], "--groups", t["groups"], "--output", t["folds"], "--report", report("folds"), "--splits", "3"], spark)
    cli.main(["manifest", "--data", t["data"], "--groups", t["groups"], "--folds", t["folds"], "--images", t["images"], "--output", t["manifest"], "--report", report("manifest")], spark)
    cli.main(["rules", "--data", t["data"], "--folds", t["folds"], "--output", t["rules"], "--report", report("rules")], spark)
    cli.main(["explain", "--data", t["data"], "--output", t["sub"]], spark)
    assert spark.read.parquet(t["pairs"]).select("left_id", "right_id", "auto_merge").collect() == [(0, 1, True)]
    assert spark.read.parquet(t["groups"]).filter("group_size = 2").count() == 2
    assert spark.read.csv(t["sub"], header=True).count() == 24 and "| fold |" in (tmp_path / "folds.md").read_text()
    with pytest.raises(SystemExit):
        run("nothing")
