"""Table schemas, vocabularies and natural keys of the fact tables."""

from __future__ import annotations

from pyspark.sql import types as T

_KIND = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType()}


def _table(spec: str) -> T.StructType:
    """``name:kind`` words; a trailing ``?`` marks a nullable column."""
    fields = []
    for word in spec.split():
        name, kind = word.split(":")
        fields.append(T.StructField(name, _KIND[kind[0]], kind.endswith("?")))
    return T.StructType(fields)


_RANGE = "start_line:l end_line:l start_byte:l end_byte:l"
_STAMP = "index_run_id:s? parser_version:s?"

TABLES: dict[str, T.StructType] = {
    "repositories": _table("id:s root_path:s created_at:t updated_at:t"),
    "repository_refs": _table("id:s repository_id:s ref_kind:s ref_name:s? ref_identity:s head_oid:s? is_current:b last_seen_at:t? deleted_at:t? created_at:t updated_at:t"),
    "ref_files": _table("repository_ref_id:s repository_id:s path:s file_id:s indexed_at:t index_run_id:s?"),
    "index_runs": _table("id:s repository_id:s repository_ref_id:s? started_at:t finished_at:t? status:s embedding_model:s embedding_dimension:l? files_seen:l files_indexed:l chunks_embedded:l error_summary:s? parser_version:s? indexer_version:s? run_kind:s"),
    "file_index_events": _table("id:s index_run_id:s repository_id:s repository_ref_id:s? path:s old_content_hash:s? new_content_hash:s? action:s reason:s status:s error_summary:s? occurred_at:t"),
    "watchers": _table("repository_id:s root_path:s mode:s owner_kind:s owner_pid:l? socket_path:s? state:s started_at:t? updated_at:t? heartbeat_at:t? files_seen:l queued_events:l last_indexed_path:s? last_error:s? active_layer:s? quality_status:s? quality_pending_jobs:l quality_running_jobs:l quality_failed_jobs:l quality_stale_jobs:l"),
    "watcher_clients": _table("repository_id:s client_id:s client_kind:s pid:l? started_at:t heartbeat_at:t last_seen_at:t"),
    "files": _table(f"id:s repository_id:s path:s language:s content_hash:s indexed_at:t? {_STAMP}"),
    "symbols": _table(f"id:s file_id:s parent_symbol_id:s? name:s qualified_name:s? kind:s signature:s? {_RANGE} {_STAMP}"),
    "chunks": _table(f"id:s file_id:s symbol_id:s? kind:s text_hash:s {_RANGE} vector_point_id:s? excluded_reason:s? {_STAMP} embedding_model:s? embedding_dimension:l? embedded_at:t?"),
    "calls": _table(f"id:s caller_symbol_id:s callee_text:s callee_symbol_id:s? call_line:l confidence:d resolution_status:s {_STAMP}"),
    "symbol_references": _table(f"id:s file_id:s source_symbol_id:s? target_symbol_id:s? reference_text:s reference_kind:s line:l confidence:d resolution_status:s {_STAMP}"),
    "dependencies": _table(f"id:s repository_id:s file_id:s manifest_path:s package_manager:s dependency_name:s package_name:s version_req:s? dependency_kind:s {_STAMP} indexed_at:t?"),
    "dependency_usages": _table(f"id:s repository_id:s dependency_id:s file_id:s source_symbol_id:s? usage_kind:s import_path:s referenced_symbol:s? line:l confidence:d reason:s {_STAMP}"),
    "tests": _table(f"id:s repository_id:s file_id:s path:s symbol_id:s? name:s qualified_name:s framework:s language:s {_RANGE} {_STAMP}"),
    "test_targets": _table(f"id:s repository_id:s test_id:s target_symbol_id:s? target_file_id:s relationship_kind:s confidence:d reason:s {_STAMP}"),
    "semantic_generations": _table("id:s repository_id:s fast_model:s fast_dimension:l fast_completed_at:t quality_model:s? quality_dimension:l? quality_status:s quality_started_at:t? quality_completed_at:t? active_layer:s files_seen:l embeddable_chunks:l fast_embedded_chunks:l quality_embedded_chunks:l created_at:t updated_at:t"),
    "semantic_generation_refs": _table("repository_ref_id:s repository_id:s generation_id:s linked_at:t"),
    "chunk_embeddings": _table("id:s repository_id:s file_id:s chunk_id:s semantic_layer:s embedding_model:s embedding_dimension:l content_hash:s text_hash:s vector_table:s vector_point_id:s generation_id:s embedded_at:t status:s"),
    "quality_embedding_jobs": _table("id:s repository_id:s generation_id:s chunk_id:s file_id:s path:s content_hash:s text_hash:s status:s attempts:l error_summary:s? created_at:t updated_at:t"),
    "runtime_observations": _table("id:s repository_id:s observation_id:s input_hash:s observation_kind:s ordinal:l? runtime_symbol:s? runtime_path:s? normalized_path:s? line:l? column:l? failing_test_name:s? mapped_test_name:s? matched:b match_kind:s match_summary:s observed_at:t expires_at:t"),
}
TABLES["vector_points"] = T.StructType(
    [
        *_table(f"vector_store:s vector_table:s vector_rowid:l vector_point_id:s repository_id:s file_id:s chunk_id:s symbol_id:s? path:s language:s chunk_kind:s symbol_name:s? content_hash:s text_hash:s start_line:l end_line:l embedding_model:s embedding_dimension:l semantic_layer:s generation_id:s? embedded_at:t?").fields,
        T.StructField("embedding", T.ArrayType(T.FloatType()), False),
    ]
)

#: Natural keys, used by merges.
KEYS: dict[str, tuple[str, ...]] = {name: ("id",) for name in TABLES} | {
    "ref_files": ("repository_ref_id", "path"),
    "watchers": ("repository_id",),
    "watcher_clients": ("repository_id", "client_id"),
    "semantic_generation_refs": ("repository_ref_id",),
    "chunk_embeddings": ("chunk_id", "semantic_layer", "embedding_model", "embedding_dimension"),
    "vector_points": ("vector_store", "vector_table", "vector_point_id"),
    "quality_embedding_jobs": ("repository_id", "generation_id", "chunk_id"),
}

#: Column whose hash puts a row into a bucket: rows of one key are in one bucket,
#: and the facts of a file (or of a caller) are together.
BUCKET_BY: dict[str, str] = {name: key[0] for name, key in KEYS.items()} | {
    **dict.fromkeys(("symbols", "chunks", "symbol_references", "dependencies", "tests"), "file_id"),
    "calls": "caller_symbol_id",
    "dependency_usages": "repository_id",
    "test_targets": "repository_id",
    "vector_points": "vector_point_id",
    "quality_embedding_jobs": "chunk_id",
}

# Closed vocabularies.
VOCABULARY: dict[str, tuple[str, ...]] = {
    "language": ("csharp", "json", "javascript", "rust", "toml", "typescript", "yaml"),
    "chunk_kind": ("function", "method", "impl_summary", "type_definition", "module", "file_fallback"),
    "symbol_kind": ("function", "method"),
    "resolution_status": ("resolved_exact", "resolved_local_candidate", "unresolved", "ambiguous"),
    "reference_kind": ("import", "type_reference", "implementation", "attribute", "inheritance", "decorator", "config_link"),
    "semantic_layer": ("fast", "quality"),
    "semantic_mode": ("auto", "fast", "quality"),
    "semantic_status": ("missing", "fast_ready", "quality_pending", "quality_ready", "quality_stale", "quality_blocked", "quality_failed"),
    "freshness": ("fresh", "stale", "deleted", "missing", "unknown"),
    "trust_level": ("high", "medium", "low", "minimal"),
    "run_status": ("running", "success", "skipped", "partial", "failed"),
    "run_kind": ("offline", "semantic", "watch"),
    "job_status": ("pending", "running", "succeeded", "failed", "skipped_stale", "skipped_excluded"),
    "embedding_status": ("current", "stale", "blocked", "failed"),
    "test_relationship": ("direct_call", "same_module", "naming_convention", "fixture_path"),
    "database_role": ("structural", "fast_semantic", "quality_semantic", "watch", "events", "runtime"),
    "ref_kind": ("branch", "detached", "other", "non_git"),
    "coverage_status": ("covered", "metadata-only", "excluded", "stale", "missing-vector"),
    "health": ("Ok", "Warning", "Error"),
}
#: Extension -> language.
EXTENSIONS: dict[str, str] = {
    "cs": "csharp", "json": "json", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust",
    "toml": "toml", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "yaml": "yaml", "yml": "yaml",
}
SOURCE_RANK = {"both": 0, "structural": 1, "semantic": 2}
KIND_RANK = {"symbol": 0, "call": 1, "chunk": 2}
