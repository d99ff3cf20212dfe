"""Schemas of the tables that the operators exchange."""

PAGES = "doc_id string, page_number int, text string"
CHUNKS = "chunk_id string, doc_id string, source_file string, chunk_text string, char_start int, char_end int, token_count int, page_number int, section_header string, ord long"
RANKINGS = "query_id long, side string, variant_no int, chunk_id long, score double, rank int"
CONFIDENCE = ("high", "medium", "low")
