from pyspark.sql import functions as F

from palimpsest.functions import text as X


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "v string").select(*columns).first())


def test_names(spark):
    cases = {"healthy_00123": ("healthy", 123), "V01HE05": ("V01HE", 5), "plain": ("plain", -1), "a__7": ("a_", 7), "99999999999": ("", None)}
    for stem, (prefix, number) in cases.items():
        assert one(spark, stem, *X.name_and_number(F.col("v"))) == (prefix, number)


def test_class_is_split_at_the_first_blank(spark):
    assert one(spark, "parkinson big wave", *X.class_parts(F.col("v"))) == ("parkinson", "big wave")
    assert one(spark, "healthy", *X.class_parts(F.col("v"))) == ("healthy", "")


def test_augmented_stems(spark):
    for stem, want in {"a_aug1_aug22": ("a", True), "a.rf.0123abcd": ("a", True), "a_augx": ("a_augx", False), "a.rf.0123": ("a.rf.0123", False)}.items():
        assert one(spark, stem, *X.augmented_base(F.col("v"))) == want


def test_split_aliases_differ_between_the_two_tables(spark):
    p = "/d/Training/x/valid/a.png"
    assert one(spark, p, X.split_of_path(F.col("v")), X.split_of_path(F.col("v"), X.INSPECTION_SPLITS)) == ("val", "train")
    assert one(spark, "C:\\d\\test\\a.png", X.split_of_path(F.col("v"))) == ("test",)
    assert one(spark, "/d/a.png", X.split_of_path(F.col("v"))) == ("?",)


def test_subject_and_label_path(spark):
    for stem, want in {"wave paciente_031": "031", "pt44-left": "44", "a-SUJEITO-9": "9", "x_pac5_p6": "5", "208_spiral": "208", "17-b": "17", "id12": None, "s7": None, "12x_1": None, "map3": None, "V20PA11": None}.items():
        assert one(spark, stem, X.subject_of(F.col("v"))) == (want,), stem
    assert one(spark, "/images/a/Images/b.PNG", X.label_path(F.col("v"))) == ("/images/a/labels/b.txt",)


def test_keys_and_cells(spark):
    for header, key in {" Mean-Width ": "mean_width", "n__rows_": "n__rows", "a (%) b": "a_b"}.items():
        assert one(spark, header, X.metric_key(F.col("v"))) == (key,)
    assert one(spark, "paper, frame & (all) the speckles of it", X.slug(F.col("v"))) == ("paper_frame_all_the_spec",)
    assert one(spark, "x", X.interval_text(F.lit(1.23456), F.lit(0.5), F.lit(2.0))) == ("1.235 [0.500-2.000]",)


def test_readings_name_the_nearer_side(spark):
    low, high, none = one(spark, "x", *[X.reading(F.lit(v).cast("double")) for v in (0.123, 0.5, None)])
    assert low.startswith("Score 0.12, nearer to the healthy") and high.startswith("Score 0.50, nearer to the parkinson") and none is None


def test_nulls_stay_null(spark):
    v = F.col("v")
    for c in (X.slug(v), X.subject_of(v), X.label_path(v), X.positive(v), X.metric_key(v)):
        assert one(spark, None, c) == (None,)
