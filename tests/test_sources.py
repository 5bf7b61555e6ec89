import pytest
from pyspark.sql import functions as F

from lumenframe.sources import sinks, text


def lines(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, value string")


def test_ratings_default_to_one(spark):
    got = text.parse_ratings(lines(spark, "1,2,3.5", "4,5")).collect()
    assert [tuple(r) for r in got] == [(1, 2, 3.5), (4, 5, 1.0)]


def test_libsvm_several_labels_keeps_indices(spark):
    rows = text.parse_libsvm(lines(spark, "4,5,2  10:1.12345 20:-2.12345", "1  3:0 4:1"), id_col="id", positive_class=2, num_features=21)
    assert sorted(tuple(r) for r in rows.collect()) == [(0, 1, 10, 1.12345), (0, 1, 20, -2.12345), (1, 0, 4, 1.0)]


def test_libsvm_single_label(spark):
    rows = text.parse_libsvm(lines(spark, "+1 10:1", "-1 10:1"), id_col="id", multi_label=False)
    assert sorted((r.id, r.label) for r in rows.collect()) == [(0, 1), (1, 0)]


def test_libsvm_needs_a_class_and_checks_dims(spark):
    with pytest.raises(ValueError):
        text.parse_libsvm(lines(spark, "1 1:1"), id_col="id")
    with pytest.raises(Exception, match="beyond"):
        text.parse_libsvm(lines(spark, "1 9:1"), id_col="id", positive_class=1, num_features=3).collect()


def test_rcv1(spark):
    vectors = text.parse_rcv1_vectors(lines(spark, "7 1:0.5 2:0.25", "8 1:1"))
    positive = text.parse_rcv1_labels(lines(spark, "CCAT 7 1", "GCAT 8 1"), "ccat")
    assert sorted((r.id, r.dim, r.label) for r in text.label_by_id(vectors, positive).collect()) == [(7, 1, 1), (7, 2, 1), (8, 1, 0)]


def test_csv_matrix_in_the_requested_order(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('"a1","b2","c3","d4"\n1, 2, 3, 4\n21, 22, 23, 24\n')
    rows = text.read_csv_matrix(spark, str(path), ["c3", "a1", "d4"], "b2", bias=True).collect()
    assert list(rows[1]) == [1.0, 23.0, 21.0, 24.0, 22.0]
    with pytest.raises(ValueError):
        text.read_csv_matrix(spark, str(path), ["zz"])


def test_samples_points_and_scaling(spark):
    samples = text.parse_samples(lines(spark, "0 1 255 0", "1 2 51 51", "2 3 1 1"))
    scaled = text.scale_labelled(samples, 255.0, [1, 2]).orderBy("id").collect()
    assert [r.features for r in scaled] == [[1.0, 0.0], [0.2, 0.2]]
    assert text.parse_points(lines(spark, "3|1.5|2.5|"), sep="|").first().point == [1.5, 2.5]
    assert text.parse_points(lines(spark, "1,2,3")).first().point == [1.0, 2.0, 3.0]


def test_idx_images(spark, tmp_path):
    (tmp_path / "i").write_bytes(bytes([0, 0, 8, 3, 0, 0, 0, 2, 0, 0, 0, 1, 0, 0, 0, 2, 128, 0, 64, 32]))
    (tmp_path / "l").write_bytes(bytes([0, 0, 8, 1, 0, 0, 0, 2, 7, 9]))
    rows = text.read_idx_images(spark, str(tmp_path / "i"), str(tmp_path / "l")).orderBy("id").collect()
    assert [(r.label, r.features) for r in rows] == [(7, [0.5, 0.0]), (9, [0.25, 0.125])]


def test_generators(spark):
    assert text.weight_vector(spark, 3, 2).orderBy("dim").collect()[2].weight == 2.0
    with pytest.raises(ValueError):
        text.weight_vector(spark, 0)
    assert text.empty_model(spark).count() == 0
    assert text.single_value(spark, "a int", 4).first().a == 4
    assert text.generated(spark, 3, square=F.col("id") * F.col("id")).agg(F.sum("square")).first()[0] == 5


def test_sinks(spark, tmp_path):
    similar = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25), (2, 3, 1.0)], "i long, j long, similarity double")
    assert sorted(r.value for r in sinks.similarity_text(similar).collect()) == ["1\n2:0.500000\n3:0.250000", "2\n3:1.000000"]
    gains = spark.createDataFrame([(1, 0.5, 2.0), (2, 1.5, 3.0)], "dim int, gain double, coefficient double")
    sinks.gains_text(gains).write.text(str(tmp_path / "g"))
    assert [r.dim for r in sinks.read_gains(spark, str(tmp_path / "g")).collect()] == [2, 1]
    model = sinks.decode_model(spark, sinks.encode_model(gains))
    assert model.collect() == gains.collect()
    sinks.write_many({"a": gains, "b": similar}, str(tmp_path / "many"))
    assert spark.read.parquet(str(tmp_path / "many/b")).count() == 3
    sinks.write_csv(gains, str(tmp_path / "c"), sep=";")
    assert spark.read.text(str(tmp_path / "c")).first().value.count(";") == 2
