"""Schemas of the derived tables, as DDL."""

DOCUMENTS = (
    "id string, path string, title string, category string, source string, source_ref string, content_hash string, body_hash string, "
    "frontmatter string, tags array<string>, created timestamp, updated timestamp, status string, importance int, pinned boolean, "
    "expires timestamp, last_access timestamp, access_count int, prune_score double"
)
CHUNKS = "chunk_id string, document_id string, ordinal int, heading_path string, headings array<string>, page int, text string, token_count int, embedding array<float>, dim int"
LINKS = "src_document string, dst_target string, dst_document string, rel string"
EVENTS = "id string, document_id string, title string, start_at string, start_ts timestamp, end_at string, end_ts timestamp, source string"
DUPLICATES = "path string, canonical_id string, body_hash string"
TOMBSTONES = "id string, document_id string, action string, reason string, prev_path string, payload string, at timestamp, batch string"
CATALOG = (
    "id long, content_hash string, course string, subpath string, original_filename string, current_path string, descriptive_name string, doc_type string, "
    "title string, extension string, size_bytes long, pages int, mtime double, cataloged_at timestamp, renamed boolean, missing boolean"
)
DUP_PATHS = "document_id long, path string, size_bytes long, found_at timestamp"
GRAPH_NODES = "id string, kind string, title string, source string, heading_path string, page int"
GRAPH_EDGES = "src string, dst string, kind string"
SIGNALS = "document_id string, last_access timestamp, access_count int"
CURSORS = "source string, cursor string, last_sync timestamp, items int"
MANIFEST = "key string, hash string, chunks int, corpus string"
ENTITIES = "id string, name string, kind string, document_id string"
