"""Survey files to analysis tables on small frames, checked with pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from natal import rules
from natal.plans import survey_tables as plan

COUNTRIES = {"Mexico": 70, "Venezuela": 101, "United Kingdom": 200, "Russia": 365, "USSR": 365, "Germany": 255, "Germany, West": 255,
             "Korea, DPR": 732, "South Korea": 732}
CODES = [("Code", "Label"), (None, "NORTH AMERICA"), ("20000", "Mexico"), (None, None), ("30060", "Venezuala"), ("41000", "England"),
         ("41100", "Scotland"), ("46500", "Russia"), ("45700", "Serbia"), ("96000", "OTHER, n.e.c. and unknown")]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(list(COUNTRIES.items()), "name string, code int")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [("VOTED", "1", "Did not vote"), ("VOTED", "2", "Voted"), ("VOTED", "96", "Refused"), ("VOTED", "99", "Not in universe")]
    rows += [("CITIZEN", str(i), t) for i, t in enumerate([*rules.CITIZEN_BY_BIRTH, "Naturalized citizen", "Not a citizen"], 1)]
    return spark.createDataFrame(rows, "var string, code string, label string")


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(3)
    n = 400
    return pd.DataFrame(
        {
            "YEAR": rng.choice([2000, 2004, 2008, 2012, 2016], n),
            "CPSIDP": np.arange(n) + 10_000_000_000,
            "STATEFIP": rng.choice([1, 6, 36, 99], n),
            "METFIPS": rng.integers(1, 9, n),
            "AGE": rng.integers(16, 90, n),
            "SEX": rng.integers(1, 3, n),
            "EDUC99": rng.integers(0, 19, n),
            "FAMINC": rng.choice([100, 720, 830, 841, 843, 999], n),
            "CITIZEN": rng.integers(1, 6, n),
            "FBPL": rng.choice([20000, 30060, 41000, 46500, 9900, 12090, 96000], n),
            "MBPL": rng.choice([20000, 41100, 45700, 11000], n),
            "VOTED": rng.choice([1, 2, 96, 99], n),
            "VOSUPPWT": rng.random(n),
        }
    )


@pytest.fixture(scope="module")
def citizens(spark, people, labels):
    df = spark.createDataFrame(people).withColumn("FBPL", F.nullif("FBPL", F.lit(96000)))
    return plan.citizens_by_birth(plan.in_universe(df, labels), labels)


@pytest.fixture(scope="module")
def codes(spark, names):
    return plan.birthplace_codes(spark.createDataFrame(CODES, "cps_country_code string, cps_country_name string"), names)


@pytest.fixture(scope="module")
def panels(spark):
    rng = np.random.default_rng(4)
    cells = [(c, y) for c in (70, 101, 200, 365) for y in range(1930, 2017)]
    polity = [(c, y, -66.0 if rng.random() < 0.1 else float(rng.integers(-10, 11))) for c, y in cells if not (c == 365 and y < 1960)]
    vdem = [(c, c + 1000, f"n{c}", y, float(rng.random()), float(rng.random())) for c, y in cells]
    wdi = [(n, y, float(1000 + 100 * rng.random())) for n in ("Mexico", "Venezuela", "United Kingdom", "Russia", "World") for y in range(1960, 2017)]
    mad = [(n, y, 0.0 if n == "Mexico" and y == 1950 else float(500 + y)) for n in ("Mexico", "Venezuela", "United Kingdom", "Russia", "Former USSR") for y in range(1930, 2017)]
    return {
        "polity": spark.createDataFrame(polity, "cowcode int, year int, polity2 double"),
        "vdem": spark.createDataFrame(
            vdem, "cowcode int, vdem_country_code int, vdem_country_name string, year int, vdem_turnout_vap double, vdem_corrupt double"),
        "wdi": spark.createDataFrame(wdi, "country string, year int, wdi_gdpcap double"),
        "mad": spark.createDataFrame(mad, "country string, year int, mad_gdpcap double"),
    }


def test_code_list(codes):
    got = {r["cps_country_name"]: (r["cps_country_code"], r["cowcode"]) for r in codes.collect()}
    assert got == {"Mexico": (20000, 70), "Venezuala": (30060, 101), "England": (41000, 200), "Scotland": (41100, 200),
                   "Russia": (46500, 365), "Serbia": (45700, 345)}


def expected_base(people, birthplace):
    df = people[(people.VOTED != 99) & people.CITIZEN.isin([1, 2, 3])]
    return df[~df[birthplace].isin(rules.US_BIRTHPLACES)]


@pytest.mark.parametrize("parent", [plan.FATHER, plan.MOTHER])
def test_baseline(citizens, codes, people, parent):
    out = plan.baseline(citizens, codes, parent)
    assert parent.birthplace not in out.columns and "cps_country_code" in out.columns
    assert out.count() == len(expected_base(people, parent.birthplace))
    if parent is plan.FATHER:
        # a missing birthplace stays
        assert out.filter("cps_country_code is null").count() == (expected_base(people, "FBPL").FBPL == 96000).sum()


def test_risk_panel(spark, names):
    wide = spark.createDataFrame(
        [("USSR", 1.0, 2.0, None), ("Russia", None, None, 4.0), ("Serbia-Montenegro", 1.0, 1.0, 1.0), ("Serbia", 9.0, 9.0, 9.0),
         ("Korea, DPR", 5.0, 5.0, 5.0), ("Atlantis", 1.0, 1.0, 1.0)],
        "country string, `01/1991` double, `02/1991` double, `01/1992` double",
    )
    out = plan.risk_panel(wide, names, wide.columns[1:])
    got = {(r["country"], r["year"]): (r["cowcode"], r["icrg_corrupt"]) for r in out.collect()}
    assert got == {
        ("USSR", 1991): (365, 1.5), ("Russia", 1992): (365, 4.0), ("Serbia-Montenegro", 1991): (345, 1.0),
        ("Serbia-Montenegro", 1992): (345, 1.0), ("Korea, DPR", 1991): (731, 5.0), ("Korea, DPR", 1992): (731, 5.0),
    }


def test_long_run_income(panels, names, spark):
    extra = spark.createDataFrame([("United Arab Emirates", 1991, 0.0)], "country string, year int, mad_gdpcap double")
    more = names.unionByName(spark.createDataFrame([("United Arab Emirates", 696), ("Former USSR", 365)], "name string, code int"))
    out = plan.long_run_income_panel(panels["mad"].unionByName(extra), more)
    assert out.filter("cowcode = 696").first()["mad_gdpcap"] is None
    assert out.filter("cowcode = 365").count() == 87


def final_checks(table, z):
    df = table.toPandas()
    assert len(df) > 20 and not df[z].isna().any().any()
    for c in z:
        assert df[f"{c}_z"].mean() == pytest.approx(0, abs=1e-9)
        assert df[f"{c}_z"].std() == pytest.approx(1)
    assert set(df.voted_re) == {0.0, 1.0} and set(df.age_re) <= set(rules.AGE_LEVELS)
    assert set(df[df.statefip == 36].state_abb) == {"NY"}
    return df


def test_contemporaneous(citizens, codes, panels, names, people):
    base = plan.baseline(citizens, codes, plan.FATHER)
    wdi = plan.income_panel(panels["wdi"], names)
    icrg = panels["vdem"].select("cowcode", "year", F.col("vdem_turnout_vap").alias("icrg_corrupt"))
    polity = plan.regime_panel(panels["polity"])
    out = plan.contemporaneous(base, polity, panels["vdem"], wdi, icrg, unique_countries=True)
    df = final_checks(out, ["icrg_corrupt", "vdem_corrupt", "polity2", "wdi_gdpcap", "ln_wdi_gdpcap", "age"])
    pdf = panels["polity"].toPandas()
    mean = pdf[(pdf.polity2 != -66) & pdf.year.between(2000, 2016) & (pdf.cowcode == 70)].polity2.mean()
    assert df[df.cowcode == 70].polity2.iloc[0] == pytest.approx(mean)
    want = expected_base(people, "FBPL")
    want = want[want.FBPL.isin([20000, 30060, 41000, 46500]) & want.VOTED.isin([1, 2]) & (want.AGE >= 18) & (want.FAMINC != 999)]
    want = want[want.EDUC99.isin([1, *range(4, 19)]) & (want.STATEFIP > 0)]
    assert sorted(df.cpsidp) == sorted(want.CPSIDP)


def test_lagged_uses_independent_years_only(citizens, codes, panels, names, spark):
    polity = plan.regime_panel(panels["polity"].filter("not (cowcode = 70 and year between 1970 and 1975)"))
    base = plan.baseline(citizens, codes, plan.FATHER)
    out = plan.lagged(base, polity, panels["vdem"], plan.income_panel(panels["wdi"], names))
    df = final_checks(out, ["age", "lagged_polity2_7079", "lagged_vdem_turnout_vap_7079", "lagged_vdem_corrupt_7079", "lagged_ln_wdi_gdpcap_7079"])
    v = panels["vdem"].toPandas()
    mean = v[(v.cowcode == 70) & v.year.between(1976, 1979)].vdem_corrupt.mean()
    assert df[df.cowcode == 70].lagged_vdem_corrupt_7079.iloc[0] == pytest.approx(mean)


def test_two_entries_of_a_code_double_respondents(citizens, codes, panels, names):
    base = plan.baseline(citizens, codes, plan.FATHER)
    polity, wdi = plan.regime_panel(panels["polity"]), plan.income_panel(panels["wdi"], names)
    twice = panels["vdem"].unionByName(panels["vdem"].filter("cowcode = 70").withColumn("vdem_country_code", F.lit(9)))
    once, doubled = (plan.lagged(base, polity, v, wdi).groupBy("cowcode").count() for v in (panels["vdem"], twice))
    a, b = ({r[0]: r[1] for r in d.collect()} for d in (once, doubled))
    assert b[70] == 2 * a[70] and b[101] == a[101]
    with pytest.raises(Exception, match="keys .* repeat"):
        plan.lagged(base, polity, twice, wdi, unique_countries=True).collect()


@pytest.mark.parametrize("parent", [plan.FATHER, plan.MOTHER])
def test_exposure(citizens, codes, panels, names, parent):
    base = plan.baseline(citizens, codes, parent)
    source = plan.source_panel(plan.regime_panel(panels["polity"]), panels["vdem"], plan.long_run_income_panel(panels["mad"], names))
    out = plan.exposure_table(base, source, parent)
    fuzzy = ["fuzzy_vdem_corrupt", "fuzzy_polity2", "fuzzy_mad_gdpcap", "fuzzy_ln_mad_gdpcap"]
    df = final_checks(out, ["age", *fuzzy])
    assert (df[parent.arrival] == df.year - df.age).all() and (df.year_diff <= 0).all()
    s = source.toPandas()
    for _, r in df.head(15).iterrows():
        w = s[(s.cowcode == r.cowcode) & s.src_year.between(r[parent.arrival] - 20, r[parent.arrival])]
        assert r.fuzzy_vdem_corrupt == pytest.approx(w.vdem_corrupt.mean())
        assert r.fuzzy_polity2 == pytest.approx(w.polity2.mean())
        assert r.year_diff == w.src_year.min() - r[parent.arrival]
    same = plan.exposure_table(base, source, parent, unique=True).toPandas()
    pd.testing.assert_frame_equal(
        df.sort_values("cpsidp").reset_index(drop=True)[same.columns], same.sort_values("cpsidp").reset_index(drop=True)
    )
