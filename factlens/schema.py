"""Schemas of the fact relations."""

from __future__ import annotations

TARGET = "struct<kind:string,a:string,b:string,c:string>"
SITE = f"file string, line bigint, item_kind string, target {TARGET}, canonical_path string"

#: One Spark DDL for each relation; every relation that points at code ends with the columns of SITE.
RELATIONS = {
    "items": "file string, line bigint, kind string, name string, variant_count int, methods array<struct<name:string,sig:string>>, attr_paths array<string>, doc string, body_calls array<string>, body_macros array<string>, is_async boolean, is_unsafe boolean, is_const boolean, impl_trait string, derives array<string>, serde_args array<string>, structural_digest string, shape_digest string",
    "classes": "name string, type_name string, family string, summary string, pattern string, category array<string>, provenance string, presentation string, file string, line bigint, canonical_path string",
    "sites": f"class string, match_kind string, inherited_from array<struct<class:string,canonical_path:string>>, structural_digest string, requires string, proof string, {SITE}",
    "immunities": f"class string, witness string, requires string, structural_digest string, {SITE}",
    "defenses": f"class string, {SITE}",
    "tolerances": f"class string, rationale string, until string, see array<string>, requires string, structural_digest string, {SITE}",
    "lineage": "child string, parent string, child_path string, parent_path string, file string, line bigint",
    "deferred": f"kind string, class string, text string, until string, since string, duration_cap bigint, signed_by string, see array<string>, learning_path string, learn_until string, {SITE}",
    "evidence": f"kind string, class string, modalities array<string>, min_independent bigint, iterations bigint, seed_kind string, historical_span bigint, min_reattestations bigint, witnesses array<string>, fingerprints array<string>, {SITE}",
    "recurrent": f"kind string, name string, class string, instances bigint, since string, from_itches array<string>, anchored_by array<string>, managed_by string, contributing_to string, text string, rationale string, {SITE}",
    "boundaries": f"tag string, boundary_kind string, rationale string, handled_by string, accepts string, reviewed_by string, until string, {SITE}",
    "work_orders": f"kind string, items array<string>, filled_by array<string>, reviewed_by array<string>, ordered_by string, frame string, need_text string, label string, structural_digest string, {SITE}",
    "generators": "class string, rationale string, macro_name string, file string, line bigint, canonical_path string",
    "marks": "marker string, magnitude string, certainty string, trigger string, structural_digest string, shape_digest string, file string, line bigint",
    "triage_commits": f"decision string, rollback_target string, triaged_by string, rationale string, due_minutes bigint, {SITE}",
    "parse_failures": "file string, error string",
    "coverage": "enumerated array<string>, scanned array<string>",
    "findings": "schema_version int, file string, line bigint, structural_digest string, shape_digest string, cluster_key string, severity string, source string, class_provenance string, presentation string, ts bigint, origin_stage string, body struct<kind:string,class:string,tier:string,magnitude:string,certainty:string,trigger:string>",
    "functions": "name string, file string, kind string",
    "commits": "id string, parent string, subject string, files array<string>, cosmetic_only boolean, seq bigint",
    "blamed": "fix_id string, introducing_commit string, path string",
    "deps": "name string, version string, section string",
    "sidecars": "item_path string, current_digest string, signers array<struct<name:string,role:string,date:date,against:string,basis:struct<kind:string,prior:string,root:string,depth:int,rationale:string>,strength:string>>, oracles array<struct<path:string,state:string,invalidates:boolean,stewards:array<struct<name:string,basis:string>>,transitions:array<struct<from:string,to:string,by:string,at:date,rationale:string>>>>, trailers array<string>, fresh_through date, oracle_files map<string,string>",
    "scores": "class string, seq bigint, recall double, precision double",
    "nodes": "fq_path string, tier string, identity_digest string, cfg_set string, kind string, shape_digest string, revision bigint",
    "edges": "src string, dst string, kind string, tier string",
}


def empty(spark, relation: str):
    return spark.createDataFrame([], RELATIONS[relation])


def missing_columns(frame, relation: str) -> list[str]:
    """Columns of a relation that a frame lacks; later schema versions only add columns, which then default to null."""
    from pyspark.sql.types import StructType

    return [f.name for f in StructType.fromDDL(RELATIONS[relation]) if f.name not in frame.columns]


def conform(frame, relation: str):
    """The frame in the relation's schema: absent columns null, further columns dropped, types cast."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(RELATIONS[relation])
    return frame.select(*((F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
