from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.functions import text as T
from tessera.operators import labels as L
from tessera.operators import wellness as H


@pytest.mark.parametrize("z, sd, flag", [(-2.3, 1.0, -2), (-1.0, 1.0, -1), (0.99, 1.0, 0), (1.0, 1.0, 1), (2.0, 1.0, 2), (5.0, None, None), (5.0, 0.0, 0)])
def test_z_flag(one, z, sd, flag):
    assert one(K.z_flag(F.lit(z), F.lit(sd).cast("double"))) == flag


def test_safe_arithmetic(one):
    assert one(K.z_value(F.lit(3.0), F.lit(1.0), F.lit(0.0))) is None
    assert one(K.rain_intensity(F.lit(3.0), F.lit(0.0))) == 0.0
    assert one(K.strict_greatest(F.lit(None).cast("double"), F.lit(0.0))) is None
    assert one(K.aligned_wind(F.lit(10.0), F.lit(90.0), F.lit(90.0))) == 10.0


def test_blend_is_null_with_a_missing_part(one):
    assert one(K.blend([(0.5, F.lit(1.0)), (0.5, F.lit(None).cast("double"))])) is None
    assert one(K.blend([(0.5, F.lit(1.0)), (0.3, F.lit(1.0)), (0.2, F.lit(2.0))])) == pytest.approx(1.2)


def test_stress_of_rides(one):
    assert one(K.tss_from_power(F.lit(200.0), F.lit(3600), F.lit(250.0))) == pytest.approx(64)
    assert 180 < one(K.tss_from_power(F.lit(203.3), F.lit(9645), F.lit(225.0))) < 260


@pytest.mark.parametrize("tss, effort, out", [(104.0, 73.0, 73), (70.0, 40.0, 70), (110.0, 0.0, 110), (0.0, 73.0, 73)])
def test_effective_tss(one, tss, effort, out):
    assert one(K.effective_tss(F.lit(tss), F.lit(effort))) == out


@pytest.mark.parametrize("tss, effort, tier", [(50.0, 0.0, "easy"), (75.0, 0.0, "moderate"), (110.0, 0.0, "hard"), (140.0, 0.0, "very_hard"), (110.0, 73.0, "moderate"), (110.0, 105.0, "hard")])
def test_intensity(one, tss, effort, tier):
    assert one(H.intensity_label(F.lit(tss), F.lit(effort), F.lit(0.0))) == tier


def test_untrusted_cache(one):
    c = {"seconds": F.lit(9645), "watts": F.lit(198.0), "effort": F.lit(196.0), "heart_rate": F.lit(None).cast("double"), "cached": F.lit(0.06), "source": F.lit("power"), "power": F.lit(None).cast("double")}
    out = one(H.activity_stress(c, 225, 170))
    assert (out["tss"], out["source"]) == (196.0, "suffer_score")


@pytest.mark.parametrize("before, now, label", [(2, 1, "Down"), (1, 3, "Up"), (2, 2, "Stable")])
def test_trend(one, before, now, label):
    assert one(K.trend_label(F.lit(before), F.lit(now))) == label


def test_outlook(one):
    m = lambda v: F.create_map(F.lit("a"), F.lit(float(v)))
    assert one(K.outlook_trend(m(40), m(50))) == "worsening"
    assert one(K.outlook_trend(m(50), m(40))) == "improving"
    assert one(K.outlook_trend(m(50), F.create_map(F.lit("b"), F.lit(1.0)), "same")) == "same"


def test_anchor_percentile(one):
    anchors = [(20, F.lit(10.0)), (80, F.lit(20.0)), (95, F.lit(30.0))]
    at = lambda v: one(K.anchor_percentile(F.lit(v), anchors))
    assert (at(15.0), at(5.0), at(30.0)) == (50.0, 10.0, 95.0)
    assert at(1000.0) == pytest.approx(97.5) or at(1000.0) == 100.0
    assert one(K.anchor_percentile(F.lit(1.0), [(20, F.lit(10.0))])) is None


@pytest.mark.parametrize("hint, seconds", [("1785566725", 1785566725), ("1785566725000", 1785566725), ("Tue, 01 Jul 2026 10:00:00 +0000", 1782900000), ("not-a-date", None), ("", None), (None, None)])
def test_timestamp_hints(one, hint, seconds):
    assert one(F.unix_timestamp(T.flexible_timestamp(F.lit(hint).cast("string")))) == seconds


def test_dates(one):
    assert one(T.iso_week(F.lit("2024-12-30").cast("date"))) == "2025-W01"
    assert one(T.us_date(F.lit("07/04/2020 12:00:00 AM"))) == date(2020, 7, 4)
    assert one(*T.time_window(F.lit("09:30–17:05"))) == (570, 1025)


def test_text(one):
    assert one(T.slug(F.lit("São Kraków"))) == "sao_krakow"
    assert one(T.html_text(F.lit("<p>a &amp; b</p><script>x()</script><br>c"))) == "a & b\nc"
    assert one(T.truncate_sentences(F.lit("One. Two! Three?"))) == "One. Two!"
    assert one(T.clean_answer(F.lit('1. "Rain ahead. More."'))) == "Rain ahead."
    assert one(T.slug_candidates(F.lit("Acme Labs GmbH")))[:2] == ["acmelabs", "acme-labs"]
    assert one(*T.parse_board_url(F.lit("https://jobs.lever.co/acme/1"))) == ("lever", "acme")
    assert one(T.looks_like_posting(F.lit("Acme | Engineer | Berlin"), F.lit(""))) is True


def test_title_gate(one):
    gate = lambda t: one(T.title_gate(F.lit(t), ["data engineer"], ["sales"], ["principal"])[1])
    assert [gate(t) for t in ("Data Engineer", "Sales Data Engineer", "Principal Data Engineer", "Cook", "")] == ["include", "exclude", "seniority", "no_match", "empty"]


def test_climate_indices(one):
    months = F.array(*[F.lit(10.0)] * 12)
    assert one(K.seasonality(months)) == 0.0
    assert one(K.entropy(F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.6931, abs=1e-4)
    assert 300 < one(K.thornthwaite(F.array(*map(F.lit, (1.0, 2.0, 5.0, 9.0, 13.0, 17.0, 19.0, 19.0, 15.0, 10.0, 5.0, 2.0))), 50.0)) < 900


def test_gamma_and_quantile(spark, one):
    import math
    from statistics import NormalDist

    from tessera.functions import special

    cdf = lambda x, a: one(special.gamma_cdf(F.lit(x), F.lit(a)))
    assert [cdf(1.0, 1.0), cdf(2.0, 1.0)] == pytest.approx([0.6321205588, 0.8646647168])
    assert [cdf(0.5, 2.5), cdf(5.0, 2.5), cdf(0.0, 2.0)] == pytest.approx([0.0374342268, 0.9247647539, 0.0], abs=1e-8)
    for n in (1, 3, 40, 400):  # whole shapes: one less the Poisson sum
        for x in (0.3 * n, 0.9 * n, float(n), n + 1.0, 1.3 * n):
            want = 1 - math.fsum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(n))
            assert cdf(x, float(n)) == pytest.approx(want, rel=1e-10, abs=1e-12)
    assert one(special.log_gamma(F.lit(123.4))) == pytest.approx(math.lgamma(123.4), rel=1e-13)
    for p in (1e-12, 1e-6, 0.01, 0.07, 0.3, 0.5, 0.77, 0.93, 1 - 1e-6):
        assert one(special.normal_quantile(F.lit(p))) == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-14)


def test_index_of_a_series(spark):
    """Against a plain version: moments of the positive sums, a mass at zero, an early part without enough rows."""
    from datetime import date, timedelta
    from statistics import NormalDist, fmean, variance

    import numpy as np

    from tessera.functions import special

    v = np.where(np.arange(400) % 90 < 40, 0.0, np.random.default_rng(1).gamma(2, 3, 400))
    rows = [("a", date(2020, 1, 1) + timedelta(i), float(x)) for i, x in enumerate(v)] + [("flat", date(2020, 1, 1) + timedelta(i), 1.0 if i < 60 else None) for i in range(70)] + [("dry", date(2020, 1, 1) + timedelta(i), 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "region string, date date, precipitation double")
    got = {r: [x.spi30 for x in L.spi30(df).filter(F.col("region") == r).orderBy("date").collect()] for r in ("a", "flat", "dry")}
    sums = [sum(v[max(0, i - 29) : i + 1]) if i >= 14 else None for i in range(400)]
    pos = [x for x in sums if x]
    zero = sum(x == 0 for x in sums) / sum(x is not None for x in sums)
    mean, var = fmean(pos), variance(pos)
    known = [x for x in sums if x is not None]
    cdf = spark.createDataFrame([(float(x),) for x in known], "x double").select(special.gamma_cdf(F.col("x") * mean / var, F.lit(mean**2 / var))).collect()
    want = [NormalDist().inv_cdf(min(max(zero + (1 - zero) * c[0] if x > 0 else zero, 1e-6), 1 - 1e-6)) for x, c in zip(known, cdf, strict=True)]
    assert got["a"][:14] == [None] * 14 and got["a"][14:] == pytest.approx(want, abs=1e-9)
    assert got["dry"] == [None] * 40 and got["flat"][:14] == [None] * 14


def test_region_type_and_thresholds(one):
    assert one(L.region_type(F.lit(0.1), F.lit(1.0))) == "desert"
    assert one(L.threshold_class(F.array(*map(F.lit, (0.5, 0.1, 0.1, 0.3))), 0.4, 0.3)) == 3
    assert one(L.threshold_class(F.array(*map(F.lit, (0.5, 0.1, 0.4, 0.0))), 0.4, 0.3)) == 2
    assert datetime.fromtimestamp(0, timezone.utc).year == 1970
