"""Schemas of the stages, as DDL."""

FILING = (
    "cik string, ticker string, company_name string, form_type string, accession_number string, filing_date date, "
    "fiscal_year int, fiscal_period string, source_url string, storage_key string"
)
SECTION = "filing_id string, item string, title string, text string, order int, part string"
METADATA = (
    "cik string, ticker string, company_name string, form_type string, accession_number string, filing_date date, "
    "fiscal_year int, fiscal_period string, item string, part string"
)
CHUNK = f"chunk_id string, filing_id string, text string, metadata struct<{METADATA.replace(' ', ':').replace(',:', ',')}>, token_count int, order int"
RULE = "struct<tickers:array<string>,fiscal_years:array<int>,items:array<string>,must_contain:array<string>>"
FILTER = "struct<ciks:array<string>,tickers:array<string>,form_types:array<string>,items:array<string>,parts:array<string>,fiscal_years:array<int>>"
QUESTION = f"id string, question string, category string, answerable boolean, filters {FILTER}, relevance {RULE}, expected_figures array<string>"
QUERY_LOG = (
    "query_id string, question string, answer string, mode string, top_k int, filters string, model string, latency_ms double, "
    "input_tokens long, output_tokens long, is_grounded boolean, ungrounded_figures array<string>, created_at timestamp"
)
CITATION_LOG = "query_id string, rank int, chunk_id string, citation string, excerpt string"
TICKERS = "map<string, struct<cik_str:bigint, ticker:string, title:string>>"
SUBMISSIONS = (
    "struct<fiscalYearEnd:string, filings:struct<recent:struct<form:array<string>, accessionNumber:array<string>, "
    "filingDate:array<string>, reportDate:array<string>, primaryDocument:array<string>>>>"
)
FORM_TYPES = ("10-K", "10-Q")
