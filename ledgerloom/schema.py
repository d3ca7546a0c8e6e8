"""Schemas of the relations, always given and never inferred."""

from pyspark.sql import types as T

FILES = "path string, kind string, source string, ingested_at string, last_modified_at string, mtime double, n_tests int, frontmatter string, body string"
EDGES = "src string, dst string, edge_type string"
TESTS = "path string, id int, q string, a string"
VECTORS = "path string, embedding array<float>"
RECALL = (
    "ts string, session_id string, question string, topic_hint string, "
    "probes struct<naked:struct<ans:string,rationale:string>,kb:struct<ans:string,rationale:string,top_score:double>,web:struct<ans:string,rationale:string,url:string>>, "
    "reconciliation_pattern string, decided_source string, decided_answer string, ingested boolean, ingested_path string, duration_ms double, "
    "substrate_confusion struct<original_answer:string,revised_answer:string,source_path:string>"
)
DREAM = (
    "ts string, session_id string, stats_snapshot string, meta_audit string, "
    "actions struct<coverage_ingests:array<string>,quality_repairs:array<string>,staleness_supersedes:array<string>,contested_resolved:array<string>,gaps_surfaced:array<string>,transients:array<string>>, "
    "duration_ms double"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
