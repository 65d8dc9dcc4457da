"""Spark-first engine for structured legal documents."""

from .functions.dom import cell_text, is_list_table, noteless
from .functions.text import name_from_url, normalize_text
from .operators.citations import extract_citations, resolved_citations
from .operators.scan import units_of
from .operators.structure import Act, read_act
from .operators.summary import read_summary, summaries
from .plans.batch import audit, audit_payloads, download_and_parse, report, run_batch
from .plans.parse import Parsed, parse_column, parse_documents, parse_files, parse_html
from .schema import MODELS, json_schemas, schema_field
from .sources.documents import DOWNLOAD, browser_fetch, fetched, html_files, http_fetch, landed, links_csv, links_json

#: Types of the tables, by the name of what a row is.
Citation, Unit, DocumentMetadata, Summary, SummarySection, ValidationReport = (MODELS[n] for n in ("Citation", "Unit", "DocumentMetadata", "Summary", "SummarySection", "ValidationReport"))

__all__ = [
    "Act", "Citation", "DOWNLOAD", "DocumentMetadata", "MODELS", "Parsed", "Summary", "SummarySection", "Unit", "ValidationReport", "audit", "audit_payloads", "browser_fetch", "cell_text", "download_and_parse", "extract_citations",
    "fetched", "html_files", "http_fetch", "is_list_table", "json_schemas", "landed", "links_csv", "links_json", "name_from_url", "normalize_text", "noteless", "parse_column", "parse_documents", "parse_files", "parse_html",
    "read_act", "read_summary", "report", "resolved_citations", "run_batch", "schema_field", "summaries", "units_of",
]
