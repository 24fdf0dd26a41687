"""Scalar functions against hand-made values."""

import hashlib

from pyspark.sql import functions as F

from lodestone import sources
from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.plans import catalogue


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", int: "long", list: "array<double>", type(None): "string"}
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(values[n])]}" for n in names))
    return rows.select(column.alias("x")).first()[0]


def test_hash_cares_for_blanks_and_case(spark):
    for text in ("", "ü ñ", "a ", "A", "a" * 5000):
        assert one(spark, tx.content_hash(F.col("t")), t=text) == hashlib.sha256(text.encode()).hexdigest()


def test_preview_of_300_characters_is_203_long(spark):
    made = one(spark, tx.preview(F.col("t")), t="x" * 300)
    assert len(made) == 203 and made.endswith("...")
    assert one(spark, tx.preview(F.col("t")), t="x" * 200) == "x" * 200


def test_collapsed_preview_measures_the_raw_text(spark):
    assert one(spark, tx.collapsed_preview(F.col("t"), 10), t="  a \n\n b   c      ") == "a b c..."


def test_title_falls_back(spark):
    assert one(spark, tx.title(F.col("t"), F.lit("src")), t="\nrest") == "src"
    assert one(spark, tx.title(F.col("t"), F.lit("src")), t="Head\nrest") == "Head"


def test_query_terms(spark):
    assert one(spark, tx.query_terms(F.col("t")), t="What is the Latency of it") == ["latency"]
    assert one(spark, tx.query_terms(F.col("t")), t="is it") == ["is", "it"]


def test_variants_are_distinct_and_in_order(spark):
    made = one(spark, tx.variants(F.col("t"), F.col("p")), t="q", p="q")
    assert made[0] == "q" and len(made) == 6 and made[1] == "What is q?"


def test_ids_of_paths(spark):
    path = "src/dsid_" + "a1" * 16 + "__slug.txt"
    assert one(spark, tx.bare_id(F.col("t")), t=path) == "dsid_" + "a1" * 16
    assert one(spark, tx.id_before_slug(F.col("t")), t=path) == "src/dsid_" + "a1" * 16


def test_zero_vector_is_safe(spark):
    assert one(spark, vx.normalised(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vx.quantise_scale(F.col("v")), v=[0.0, 0.0]) == 1.0


def test_quantisation_rounds_half_even(spark):
    assert one(spark, vx.quantised(F.col("v"), F.lit(2.0)), v=[1.0, 3.0, 254.0, -300.0]) == [0, 2, 127, -128]


def test_codes_come_from_the_exact_scale(spark, tmp_path):
    import numpy as np

    vectors = {1: [0.24562455713748932, 0.3524781763553619, -0.1], 2: [1e-10, -3e-9, 127e-10], 3: [0.5, -1.0, 0.25]}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: (r.scale, r.q) for r in catalogue.queries()["PRJ11_quantise"](spark, str(tmp_path)).collect()}
    for k, v in vectors.items():
        x = np.array(v, np.float32).astype(float)
        scale = np.abs(x).max() / 127
        assert got[k] == (round(scale, 9), np.rint(x / scale).astype(int).tolist())
        if k == 1:  # this value's code would be another by the rounded scale
            assert np.rint(x[0] / scale) != np.rint(x[0] / round(scale, 9))


def test_maxsim_of_an_empty_document_is_zero(spark):
    rows = spark.sql("select array(array(1d, 0d), array(0d, 1d)) q, cast(array() as array<array<double>>) e, array(array(.5d, 0d), array(.2d, .9d), array(0d, 0d)) d")
    assert rows.select(vx.maxsim(F.col("q"), F.col("e"))).first()[0] == 0
    assert abs(rows.select(vx.maxsim(F.col("q"), F.col("d"))).first()[0] - 1.4) < 1e-12


def test_packed_maxsim_agrees(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    q, d = rng.integers(-127, 128, (2, 128), np.int8), rng.integers(-127, 128, (3, 128), np.int8)
    rows = spark.createDataFrame([(bytearray(q.tobytes()), 0.01, bytearray(d.tobytes()), 0.02)], "q binary, qs double, d binary, ds double")
    got = rows.select(vx.maxsim_packed("q", "qs", "d", "ds")).first()[0]
    assert abs(got - ((q * 0.01) @ (d * 0.02).T).max(1).sum()) < 1e-9


def test_texts_that_are_no_utf8_are_read(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"ok \xff end")
    (tmp_path / "a" / "y.md").write_text("no")
    rows = sources.text_tree(spark, f"file://{tmp_path}").collect()
    assert [(r.path, r.source, r.size) for r in rows] == [("a/x.txt", "a", 8)] and "�" in rows[0].text


def test_flat_texts_skip_blank_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one \n")
    (tmp_path / "b.txt").write_text(" \n")
    assert [(r.id, r.text) for r in sources.flat_texts(spark, str(tmp_path)).collect()] == [("a", "one")]


def test_numpy_vectors(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    rows = sources.numpy_vectors(spark, str(tmp_path)).orderBy("row").collect()
    assert [list(r.vector) for r in rows] == [[0, 1, 2], [3, 4, 5]]


def test_fingerprint_needs_no_order(spark):
    a = spark.createDataFrame([("x",), ("y",)], "p string")
    assert sources.fingerprint(a, "p").first() == sources.fingerprint(a.orderBy(F.desc("p")), "p").first()
    assert sources.fingerprint(a.limit(0), "p").first().n == 0
