"""Metadata filters and request checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {"ciks": "cik", "tickers": "ticker", "form_types": "form_type", "fiscal_years": "fiscal_year", "items": "item", "parts": "part"}


def metadata_predicate(wanted: dict | None, columns: dict[str, str] | None = None) -> Column:
    """One of the values within a field, all fields; an absent or empty field does not constrain, an unknown
    value fits nothing. Values are compared as upper-case strings, null as the empty one."""
    out = F.lit(True)
    for field, values in (wanted or {}).items():
        if field not in FIELDS:
            raise KeyError(field)
        if values:
            column = (columns or FIELDS)[field]
            mine = F.upper(F.coalesce(F.col(column).cast("string"), F.lit("")))
            out = out & mine.isin([("" if v is None else str(v)).upper() for v in values])
    return out


def relevance_predicate(text: Column, ticker: Column, year: Column, item: Column, rule: Column, lowered: bool = False) -> Column:
    """Whether a chunk fits a rule struct: ticker in any case, year and item exactly, every phrase contained
    in any case; empty parts fit everything. ``lowered``: the text is in lower case already."""
    free = lambda c: c.isNull() | (F.size(c) == 0)
    upper = lambda c: F.transform(c, lambda x: F.upper(x))
    low = text if lowered else F.lower(text)
    return (
        (free(rule["tickers"]) | F.array_contains(upper(rule["tickers"]), F.upper(F.coalesce(ticker, F.lit("")))))
        & (free(rule["fiscal_years"]) | F.array_contains(rule["fiscal_years"], year))
        & (free(rule["items"]) | F.array_contains(rule["items"], F.coalesce(item, F.lit(""))))
        & (free(rule["must_contain"]) | F.forall(rule["must_contain"], lambda p: F.contains(low, F.lower(p))))
    )


def select_filings(filings: DataFrame, tickers: list[str] | None = None, filing_ids: list[str] | None = None) -> DataFrame:
    out = filings
    if tickers:
        out = out.filter(F.upper("ticker").isin([t.upper() for t in tickers]))
    if filing_ids:
        out = out.filter(F.concat_ws("/", "cik", "accession_number").isin(filing_ids))
    return out.filter(F.col("storage_key").isNotNull())


def check_request(question: str, top_k: int = 5, mode: str = "hybrid") -> None:
    if not 1 <= len(question) <= 1000:
        raise ValueError("a question has 1 to 1000 characters")
    if not 1 <= top_k <= 20:
        raise ValueError("top_k is 1 to 20")
    if not re.fullmatch("dense|sparse|hybrid", mode):
        raise ValueError(f"unknown mode {mode!r}")


def check_user_agent(agent: str) -> None:
    """A contact address is asked for by the public archive's access rules."""
    if "@" not in agent or "example.com" in agent:
        raise ValueError("the user agent needs a real contact address")
