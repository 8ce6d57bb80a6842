"""Survey respondents joined to country-year panels, as Spark DataFrame jobs."""

__version__ = "0.1.0"
