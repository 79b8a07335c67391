"""The store's tables."""

DOCUMENTS = "id string, title string, source string, content_type string, metadata string, chunk_count int, created_at long, updated_at long, content_hash string"
CHUNKS = "id string, doc_id string, idx int, content string, embedding array<double>, token_count int, created_at long"
MEMORIES = "id string, type string, content string, importance double, embedding array<double>, tags array<string>, recall_count int, last_recalled long, created_at long, updated_at long"
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "memories": MEMORIES}
#: What a change of a table goes by; a document's chunks change together.
KEYS = {"documents": "id", "chunks": "doc_id", "memories": "id"}
