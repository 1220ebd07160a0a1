"""Declared schemas of the engine's tables."""

META = (
    "id string, ingest_seq long, original_path string, name string, num_pages int, doc_type string, word_count long, file_size long, "
    "content_hash string, language string, indexed_at string, updated_at string, classification_source string, classification_confidence double, "
    "ocr_percentage int, ocr_avg_confidence double, summary string, subject string, tags array<string>, confidentiality string, parties array<string>"
)
PAGES = "file_id string, page int, text string"
POSTINGS = "token string, file_id string, page int, pos int"
EMBEDDINGS = "file_id string, model string, embedding array<float>, indexed_at string"
ANNOTATIONS = "id string, file_id string, type string, text string, color string, note string, page int, x double, y double, created_at string, updated_at string"
AUDIT = "timestamp string, action string, details string, level string"
SAVED_SEARCHES = "name string, query string, created_at string, updated_at string, last_run_at double, last_seen array<string>"
TOMBSTONES = "file_id string, metadata string, deleted_at double, deleted_iso string"
ACL = "user string, allowed array<string>, deny array<string>"
FEEDBACK = "file_id string, text_snippet string, correct_type string, source string, added_at string"

#: Version of the catalog's layout, and what a record of an earlier one lacks.
VERSION = 3
DEFAULTS = {"doc_type": "documento", "word_count": 0, "file_size": 0, "num_pages": 0}
