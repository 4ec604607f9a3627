"""The catalogue's schemas, as DDL, and their versions."""

from __future__ import annotations

RECORD_SCHEMA, INDEX_VERSION, PROFILE_PROMPT, JUDGE_PROMPT, DATASET_SCHEMA = 2, 3, 2, 3, 1

GITHUB = (
    "description STRING, topics ARRAY<STRING>, stars BIGINT, forks BIGINT, language STRING, license STRING, archived BOOLEAN, disabled BOOLEAN, "
    "homepage STRING, default_branch STRING, created_at STRING, updated_at STRING, pushed_at STRING, open_issues BIGINT"
)
PROFILE = (
    "summary STRING, use_cases ARRAY<STRING>, capabilities ARRAY<STRING>, not_for ARRAY<STRING>, aliases ARRAY<STRING>, project_type STRING, "
    "ecosystem ARRAY<STRING>, replaces ARRAY<STRING>, related_projects ARRAY<STRING>, search_text STRING, search_phrases ARRAY<STRING>, "
    "confidence STRING, abstained BOOLEAN, provider STRING, model STRING, generated_at STRING, prompt_version INT, prompt_hash STRING"
)
RECORD = (
    "schema_version INT, repo_id_requested STRING, repo_id STRING, platform STRING, owner STRING, name STRING, url STRING, "
    f"github STRUCT<{GITHUB.replace(' ', ': ').replace(',:', ',')}>, readme STRING, "
    "structure STRUCT<signals: ARRAY<STRING>, tree_file_count: INT, tree_truncated: BOOLEAN>, "
    "evidence ARRAY<STRUCT<kind: STRING, text: STRING, source_url: STRING>>, evidence_gaps ARRAY<STRING>, "
    f"llm_profile STRUCT<{PROFILE.replace(' ', ': ').replace(',:', ',')}>, lifecycle_state STRING, snapshot_source STRING, snapshot_time STRING"
)
METADATA = (
    "schema_version: INT, name: STRING, url: STRING, aliases: ARRAY<STRING>, description: STRING, topics: ARRAY<STRING>, language: STRING, stars: STRING, "
    "forks: BIGINT, archived: BOOLEAN, disabled: BOOLEAN, pushed_at: STRING, summary: STRING, use_cases: ARRAY<STRING>, capabilities: ARRAY<STRING>, "
    "project_type: STRING, ecosystem: ARRAY<STRING>, replaces: ARRAY<STRING>, related_projects: ARRAY<STRING>, search_text: STRING, search_phrases: ARRAY<STRING>"
)
ENTRY = f"repo_id STRING, embedding_input_fingerprint STRING, vector ARRAY<FLOAT>, metadata STRUCT<{METADATA}>, pos BIGINT"
#: Metadata fields by kind.
SCALARS = ["name", "url", "description", "language", "stars", "forks", "archived", "disabled", "pushed_at", "summary", "project_type", "search_text"]
LISTS = ["aliases", "topics", "use_cases", "capabilities", "ecosystem", "replaces", "related_projects", "search_phrases"]
