"""Schemas of the logical tables, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import types as T

_DDL = {
    "images": "key string, id string, filename string, filepath string, date_taken string, rating long, pick long, color_label string, keywords string, title string, caption string, description string, copyright string, camera_make string, camera_model string, lens string, focal_length string, aperture string, shutter_speed string, iso string, gps_latitude double, gps_longitude double, width long, height long, file_size long, instagram_posted long, image_hash string, analyzed_at string, phash string, exif string, catalog_path string",
    "vision_cache": "key string, compressed_path string, phash string, compressed_at string, original_mtime double",
    "image_descriptions": "image_key string, image_type string, summary string, composition string, perspectives string, technical string, subjects string, best_perspective string, model_used string, described_at string, dominant_colors string, mood_tags string, has_repetition long, description_search_document string",
    "perspectives": "id long, slug string, display_name string, description string, prompt_markdown string, active long, optional long, source_filename string, updated_at string, created_at string",
    "image_scores": "id long, image_key string, image_type string, perspective_slug string, score long, rationale string, model_used string, prompt_version string, scored_at string, is_current long, repaired_from_malformed long, not_attempted long",
    "image_stacks": "stack_id long, representative_key string, stack_size long, user_modified long, created_at string",
    "image_stack_members": "stack_id long, image_key string",
    "catalog_similarity_groups": "group_id long, seed_key string, candidate_count long, best_similarity double, job_id string, created_at string",
    "catalog_similarity_candidates": "group_id long, candidate_key string, similarity double, rank long, why_matched string",
    "catalog_similarity_rejections": "key_a string, key_b string, rejected_at string",
    "image_clip_embeddings": "image_key string, embedding array<float>",
    "jobs": "id string, type string, status string, progress long, current_step string, logs string, result string, error string, error_severity string, created_at string, started_at string, completed_at string, metadata string",
    "job_logs": "id long, job_id string, ts string, level string, message string",
    "provider_models": "provider_id string, model_id string, model_name string, vision long",
}

#: Table name to its StructType.
TABLES: dict[str, T.StructType] = {name: T.StructType.fromDDL(ddl) for name, ddl in _DDL.items()}
