"""Table schemas and the fixed seed tables.  Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id string, doc_type string, status string, title string, path string, project string"

COMPONENTS = (
    "doc_id string, comp_path array<bigint>, parent_path array<bigint>, parent_name string, depth int, "
    "ord bigint, name string, comp_id string, attrs map<string,string>, body_text string, "
    "line int, col int, byte_offset bigint"
)

COMPONENT_DEFS = (
    "name string, referenceable boolean, verifiable boolean, target_component string, "
    "attributes array<struct<name:string,required:boolean,list:boolean>>"
)

TARGETS = "array<struct<doc_id:string,target_id:string>>"
TEST = "struct<file:string,name:string,kind:string>"
PROVENANCE = (
    "struct<kind:string,doc_id:string,tag:string,paths:array<string>,file:string,line:int,col:int>"
)
EVIDENCE_RAW = (
    f"targets {TARGETS}, test {TEST}, file string, line int, col int, "
    f"provenance array<{PROVENANCE}>, metadata map<string,string>, ord bigint"
)

FINDINGS = (
    "rule string, doc_id string, message string, line int, col int, subject string, suggestion string"
)

# --- fixed values: component definitions -------------------------------------------------
# name, referenceable, verifiable, target component, attributes as (name, required, list)
BUILTIN_COMPONENTS = [
    ("AcceptanceCriteria", False, False, None, []),
    ("Criterion", True, True, None, [("id", True, False)]),
    ("References", False, False, None, [("refs", True, True)]),
    ("VerifiedBy", False, False, None,
     [("strategy", True, False), ("tag", False, False), ("paths", False, True)]),
    ("Implements", False, False, None, [("refs", True, True)]),
    ("DependsOn", False, False, None, [("refs", True, True)]),
    ("Task", True, False, None,
     [("id", True, False), ("status", False, False), ("implements", False, True),
      ("depends", False, True)]),
    ("TrackedFiles", False, False, None, [("paths", True, True)]),
    ("Decision", True, False, None, [("id", True, False), ("standalone", False, False)]),
    ("Rationale", False, False, None, []),
    ("Alternative", True, False, None, [("id", True, False), ("status", True, False)]),
]

# --- fixed values: document types and their status vocabularies --------------------------
DOCUMENT_TYPES = [
    ("requirements", ["draft", "review", "approved", "implemented"]),
    ("design", ["draft", "review", "approved"]),
    ("tasks", ["draft", "ready", "in-progress", "done"]),
    ("adr", ["draft", "review", "accepted", "superseded"]),
]

# --- fixed values: rules and their default severities ------------------------------------
RULE_SEVERITY = {
    "missing_verification_evidence": "error",
    "missing_test_files": "error",
    "zero_tag_matches": "warning",
    "empty_tracked_glob": "warning",
    "orphan_test_tag": "warning",
    "invalid_id_pattern": "warning",
    "isolated_document": "off",
    "status_inconsistency": "warning",
    "broken_ref": "error",
    "invalid_verified_by_placement": "error",
    "invalid_rationale_placement": "warning",
    "invalid_alternative_placement": "warning",
    "duplicate_rationale": "warning",
    "invalid_alternative_status": "warning",
    "sequential_id_order": "warning",
    "sequential_id_gap": "warning",
    "incomplete_decision": "warning",
    "orphan_decision": "warning",
    "missing_decision_coverage": "off",
    "plugin_discovery_failure": "warning",
    "plugin_discovery_warning": "warning",
    "empty_project": "warning",
}

# --- fixed values: ordered severities ----------------------------------------------------
SEVERITY_RANK = {"off": 0, "info": 1, "warning": 2, "error": 3}

# --- fixed values: vocabulary ------------------------------------------------------------
EDGE_COMPONENTS = {"Implements": "implements", "DependsOn": "depends-on", "References": "references"}
ALTERNATIVE_STATUSES = ["rejected", "deferred", "superseded"]
OUTLINE_KINDS = ["Criterion", "Task", "Decision", "Rationale", "Alternative"]
TYPE_ORDER = ["requirements", "design", "tasks", "adr", "documentation"]
SETTLED_STATUSES = ["stable", "superseded"]
MARKER_KINDS = [
    "duplicate_id", "unresolved_ref", "unparseable_ref", "missing_context", "unsupported_feature",
]


def component_defs(spark: SparkSession, user_defs: DataFrame | None = None) -> DataFrame:
    """Built-in definitions, overridden by name by the user's rows."""
    def sql(value) -> str:
        return "null" if value is None else f"'{value}'" if isinstance(value, str) else str(value).lower()

    rows = ", ".join(
        "({}, array({}))".format(
            ", ".join(sql(x) for x in head),
            ", ".join(f"named_struct('name', '{a}', 'required', {sql(r)}, 'list', {sql(many)})"
                      for a, r, many in attributes))
        for *head, attributes in BUILTIN_COMPONENTS)
    builtin = spark.sql(
        "SELECT name, referenceable, verifiable, CAST(target_component AS string) AS target_component, "
        "CAST(attributes AS array<struct<name:string,required:boolean,list:boolean>>) AS attributes "
        f"FROM VALUES {rows} AS t(name, referenceable, verifiable, target_component, attributes)")
    if user_defs is None:
        return builtin
    return user_defs.select(*builtin.columns).unionByName(
        builtin.join(user_defs.select("name"), "name", "left_anti")
    )
