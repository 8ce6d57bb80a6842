"""Survey files and country panels to analysis tables.

Every function covers father and mother: pass the birthplace column of the parent.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal import rules
from natal.functions import columns as C
from natal.functions.names import containing, with_clean_names
from natal.operators import entity, exposure, joins
from natal.operators.panel import annual_mean, keep_panel, period_mean, splice, split_name, wide_to_long
from natal.plans.tables import analysis_table
from natal.sources.codebook import with_label


@dataclass(frozen=True)
class Parent:
    """Which parent's birthplace defines the origin country."""

    birthplace: str
    arrival: str


FATHER = Parent("FBPL", "dad_arr_year")
MOTHER = Parent("MBPL", "mom_arr_year")


# --- respondents ---------------------------------------------------------------------------


def in_universe(microdata: DataFrame, labels: DataFrame) -> DataFrame:
    """Label the vote and drop respondents outside the voting universe."""
    return with_label(microdata, labels, "VOTED").filter(F.col("VOTED_factor") != rules.NOT_IN_UNIVERSE)


def citizens_by_birth(microdata: DataFrame, labels: DataFrame) -> DataFrame:
    labelled = with_label(microdata, labels, "CITIZEN")
    return labelled.filter(C.in_set("CITIZEN_factor", rules.CITIZEN_BY_BIRTH))


def birthplace_codes(code_list: DataFrame, names: DataFrame) -> DataFrame:
    """Clean the birthplace list and give each place its country code.

    Places without a country (regions, dependencies) go.
    """
    cleaned = entity.clean_code_list(code_list, "cps_country_code")
    fixed = entity.fix_names(cleaned, "cps_country_name", "country_name")
    coded = entity.attach_code(fixed, names, "country_name", overrides={"Serbia": rules.CODE_OVERRIDES["Serbia"]})
    return coded.filter(F.col("cowcode").isNotNull()).select("cps_country_code", "cps_country_name", "cowcode")


def baseline(citizens: DataFrame, codes: DataFrame, parent: Parent) -> DataFrame:
    """Respondents whose parent was born abroad, with the origin country attached.

    A missing birthplace stays. The birthplace column takes the name of the code list's key.
    """
    abroad = citizens.filter(C.not_in(parent.birthplace, rules.US_BIRTHPLACES))
    return joins.keep_all_right(codes, abroad, "cps_country_code", parent.birthplace)


# --- country panels ------------------------------------------------------------------------


def regime_panel(polity: DataFrame) -> DataFrame:
    return polity.withColumn("polity2", C.null_if("polity2", rules.REGIME_MISSING))


def income_panel(wdi: DataFrame, names: DataFrame) -> DataFrame:
    """Yearly income with its log, coded by country."""
    logged = wdi.filter(F.col("year").between(*rules.INCOME_PANEL_YEARS)).withColumn("ln_wdi_gdpcap", C.log("wdi_gdpcap"))
    coded = entity.attach_code(logged, names, "country", overrides={"Serbia": rules.CODE_OVERRIDES["Serbia"]})
    return coded.filter(F.col("cowcode").isNotNull())


def long_run_income_panel(maddison: DataFrame, names: DataFrame) -> DataFrame:
    """Long-run income: false zeros nulled before the log, double-counted unions dropped."""
    false_zero = (F.col("country") == rules.FALSE_ZERO_ENTITY) & F.col("year").isin(*rules.FALSE_ZERO_YEARS)
    cleaned = maddison.withColumn("mad_gdpcap", C.null_where("mad_gdpcap", false_zero))
    logged = cleaned.withColumn("ln_mad_gdpcap", C.log("mad_gdpcap"))
    coded = entity.attach_code(logged, names, "country", overrides={}).filter(F.col("cowcode").isNotNull())
    return coded.filter(C.not_in("country", rules.DROPPED_ENTITIES)).drop("country")


def risk_panel(wide: DataFrame, names: DataFrame, months: Sequence[str]) -> DataFrame:
    """Wide monthly sheet to one row per country and year, successor states spliced."""
    long = split_name(wide_to_long(wide, ["country"], months), "name", ["month", "year"])
    annual = annual_mean(long, ["country"], "value", "icrg_corrupt")
    coded = entity.attach_code(annual, names, "country").filter(F.col("cowcode").isNotNull())
    return splice(coded, rules.SPLICES)


# --- cross-sections and final tables -------------------------------------------------------


def democracy_means(vdem: DataFrame, period: tuple[int, int], lagged: bool) -> DataFrame:
    """Means per country entry; a code with two entries keeps both rows."""
    keys = ["cowcode", "vdem_country_code", "vdem_country_name"]
    means = period_mean(vdem, keys, ["vdem_turnout_vap", "vdem_corrupt"], *period, lagged=lagged)
    return means.filter(F.col("cowcode").isNotNull())


_IDS = ["cowcode", "cps_country_name", "cpsidp", "statefip", "metfips", "year", "voted", "age", "educ99", "faminc", "sex"]


def contemporaneous(
    base: DataFrame, polity: DataFrame, vdem: DataFrame, wdi: DataFrame, icrg: DataFrame, unique_countries: bool = False
) -> DataFrame:
    """Origin-country means over the survey years themselves."""
    period = rules.CONTEMPORARY_PERIOD
    sections = [
        period_mean(polity, ["cowcode"], ["polity2"], *period),
        democracy_means(vdem, period, lagged=False),
        period_mean(wdi, ["cowcode"], containing(wdi, "gdp"), *period),
        period_mean(icrg, ["cowcode"], ["icrg_corrupt"], *period),
    ]
    measures = ["icrg_corrupt", "vdem_corrupt", "polity2", "wdi_gdpcap", "ln_wdi_gdpcap"]
    return _finish(base, sections, measures, [*measures, "age"], unique_countries)


def lagged(
    base: DataFrame, polity: DataFrame, vdem: DataFrame, wdi: DataFrame, unique_countries: bool = False
) -> DataFrame:
    """Origin-country means over an earlier decade, limited to independent country-years."""
    period = rules.LAGGED_PERIOD
    independent = keep_panel(polity.select("cowcode", "year"), vdem, ["cowcode", "year"])
    sections = [
        period_mean(polity, ["cowcode"], ["polity2"], *period, lagged=True),
        democracy_means(independent, period, lagged=True),
        period_mean(wdi, ["cowcode"], containing(wdi, "gdp"), *period, lagged=True),
    ]
    measures = [c for xs in sections for c in containing(xs, "lagged")]
    return _finish(base, sections, measures, ["age", *measures], unique_countries)


def _finish(base, sections, measures, z_columns, unique_countries):
    if unique_countries:
        sections = [joins.assert_unique(xs, ["cowcode"]) for xs in sections]
    enriched = joins.enrich(with_clean_names(base), sections, "cowcode")
    table = analysis_table(enriched, [*_IDS, *measures], z_columns)
    return entity.attach_state(table)


def source_panel(polity: DataFrame, vdem: DataFrame, maddison: DataFrame) -> DataFrame:
    """Yearly source-country conditions of independent countries, trimmed to usable years."""
    keys = ["cowcode", "year"]
    joined = keep_panel(keep_panel(polity, vdem, keys), maddison, keys)
    return joined.filter(F.col("year").between(*rules.PANEL_TRIM)).withColumnRenamed("year", "src_year")


def exposed(base: DataFrame, panel: DataFrame, parent: Parent, window: int = rules.EXPOSURE_WINDOW, unique: bool = False) -> DataFrame:
    """Mean source-country conditions in the years before the parent's arrival.

    The parent is taken to have arrived by the respondent's birth year.
    """
    # The survey's year and the panel's year stay apart by name.
    people = with_clean_names(base).withColumn(parent.arrival, F.col("year") - F.col("age"))
    return exposure.exposure_mean(
        people,
        panel,
        "cpsidp",
        "cowcode",
        parent.arrival,
        ["vdem_corrupt", "polity2", "mad_gdpcap", "ln_mad_gdpcap"],
        window,
        unique=unique,
    )


def exposure_table(base: DataFrame, panel: DataFrame, parent: Parent, unique: bool = False) -> DataFrame:
    people = exposed(base, panel, parent, unique=unique)
    fuzzy = containing(people, "fuzzy")
    # Rows and their statistics read one shuffle, which the planner uses twice.
    keep = [*_IDS, parent.arrival, "year_diff", *fuzzy]
    table = analysis_table(people, keep, ["age", *fuzzy])
    return entity.attach_state(table)
