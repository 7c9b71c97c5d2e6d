import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from examlake.fixed_values import MEAN_BANDS
from examlake.functions import numeric, text


def values(spark, inputs, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


def test_parse_number(spark):
    texts = ["550,5", " 12 ", "1.234,5", "", None, "abc", "1d", "NaN", "inf", "1e3", "-7", ".5", "5."]
    want = [550.5, 12.0, None, None, None, None, None, None, None, 1000.0, -7.0, 0.5, 5.0]
    assert values(spark, texts, "string", numeric.parse_number) == want


def test_parse_integer_rounds_half_even(spark):
    assert values(spark, ["2,5", "3,5", "18", "x", None], "string", numeric.parse_integer) == [2, 4, 18, None, None]


def test_within_drops_outside_values(spark):
    got = values(spark, [-1.0, 0.0, 1000.0, 1000.1, None], "double", lambda c: numeric.within(c, 0, 1000))
    assert got == [None, 0.0, 1000.0, None, None]
    nan = values(spark, [float("nan")], "double", lambda c: numeric.within(numeric.drop_nan(c), 0, 1000))
    assert nan == [None]


def test_round_half_even_matches_numpy(spark):
    xs = [399.995, 400.005, 0.125, 0.375, 549.994999, 2.675, 1.005]
    got = values(spark, xs, "double", lambda c: numeric.round_half_even(c, 2))
    assert got == list(np.round(np.array(xs), 2))


def test_bin_index_matches_numpy(spark):
    rng = np.random.default_rng(1)
    edges = np.linspace(0, 1000, 51)
    near = [np.nextafter(e, d) for e in edges for d in (-np.inf, np.inf)]
    xs = [float(x) for x in [*edges, *near, *rng.uniform(0, 1000, 300)] if 0 <= x <= 1000]
    got = values(spark, xs, "double", lambda c: numeric.bin_index(c, 0, 1000, 50))
    assert np.bincount(got, minlength=50).tolist() == np.histogram(xs, bins=edges)[0].tolist()


@pytest.mark.parametrize(
    "mean, band", [(0.0, 1), (399.99, 1), (400.0, 2), (599.9, 2), (600.0, 3), (800.0, 4), (1000.0, 4), (1000.1, 1)]
)
def test_bands(spark, mean, band):
    assert values(spark, [mean], "double", lambda c: numeric.band_case(c, MEAN_BANDS, 0)) == [band]


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 5.0), (None, None)], "a double, b double")
    got = [r[0] for r in df.select(numeric.row_mean([F.col("a"), F.col("b")])).collect()]
    assert got == [2.0, 5.0, None]


def test_title_case_matches_python(spark):
    names = ["SANTA BÁRBARA D'OESTE", "x-y", "olho-d'água 2a", "são josé", "", "ÓBIDOS"]
    assert values(spark, names, "string", text.title_case) == [n.title() for n in names]


def test_fold_agrees_with_parameters(spark):
    names = ["São Paulo", "AMÉLIA", "Ceará-Mirim", "Içara"]
    assert values(spark, names, "string", text.fold) == [text.fold_text(n) for n in names]
    assert text.fold_text("  amélia ") == "AMELIA"
    assert text.fold_text(None) == ""


def test_slug(spark):
    names = ["Não Declarado", "Indígena", "Não Disp.", "Outros (9)"]
    want = ["Nao_Declarado", "Indigena", "Nao_Disp_", "Outros_9_"]
    assert values(spark, names, "string", text.slug) == want
    assert [text.slug_text(n) for n in names] == want


def test_masks(spark):
    raw = ["12345678", "1234", "12345", "", None, "nan", "None"]
    assert values(spark, raw, "string", text.mask) == ["12****78", "****", "12*45", "", "", "", ""]
    hashed = values(spark, ["12345678"], "string", lambda c: text.mask(c, "hash"))
    assert hashed == ["ef797c8118f02dfb"]
    assert values(spark, ["12345678"], "string", lambda c: text.mask(c, "all")) == ["********"]


def test_clean_cell(spark):
    raw = ["a\n\tb", ' "x" ', "]+|", "[", " y "]
    assert values(spark, raw, "string", text.clean_cell) == ["a b", '"x"', "", "", "y"]


def test_one_decimal(spark):
    assert values(spark, [1.25, 3.0, None, math.pi], "double", text.one_decimal) == ["1.3", "3.0", None, "3.1"]
