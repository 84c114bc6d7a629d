"""Closed vocabularies, limits and kind rules. Fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

NODE_KINDS = tuple(
    """repository component file package module function method test type class interface field variable parameter
    sql_query table view column index config_key endpoint event document_section external godot_scene godot_resource
    godot_scene_node godot_autoload godot_input_action godot_node_group transport_operation""".split()
)
EDGE_KINDS = tuple(
    """contains declares imports exports calls tests embeds extends implements reads_config defines exposes handled_by
    uses_middleware publishes subscribes references reads writes encodes decodes sends receives carries has_field
    assigns returns passes requests depends_on documents generated_from returns_error propagates_error handles_error
    wraps_error panics recovers defers instantiates attaches_script autoloads uses_input_action in_group
    uses_group""".split()
)
MEMBER_KINDS = ("parameter", "variable", "field", "column")
CANDIDATE_KINDS = ("function", "method", "type", "class", "interface", "endpoint")
DATA_KINDS = ("table", "view")
TEST_ROLES = ("helper", "lifecycle", "scope")
CALLER_RELATIONS = ("calls", "handled_by")
IMPACT_RELATIONS = tuple(
    """calls handled_by uses_middleware imports extends implements embeds references reads writes encodes decodes sends
    receives carries assigns returns passes requests depends_on reads_config defines exposes publishes
    subscribes""".split()
)
PUBLIC_CONFIG_PROPERTIES = ("defined", "format", "section", "resource", "uid", "unresolved")
FAILURE_SECTIONS = {
    "returns_error": "error_returns", "propagates_error": "escaping", "wraps_error": "escaping",
    "handles_error": "handled", "panics": "panics", "recovers": "recovers", "defers": "deferred_cleanup",
}

_CALLABLE = ("function", "method", "test")
_SCENES = ("godot_scene", "godot_resource")
#: edge kind -> node kinds that a target named without a kind may have; edge kinds
#: that are not listed allow every node kind.
TARGET_KINDS: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("calls", "passes", "handled_by", "uses_middleware"), _CALLABLE),
    **dict.fromkeys(("reads", "writes"), DATA_KINDS),
    **dict.fromkeys(("encodes", "decodes", "carries"), ("type",)),
    **dict.fromkeys(("sends", "receives"), ("transport_operation",)),
    "references": ("config_key", *DATA_KINDS, "godot_autoload", "godot_scene", "godot_resource", "godot_scene_node"),
    **dict.fromkeys(("imports", "depends_on"), ("module", "package", *_SCENES)),
    "instantiates": _SCENES,
    "attaches_script": ("module", "class"),
    "autoloads": ("module", "class", "godot_scene"),
    "uses_input_action": ("godot_input_action",),
    **dict.fromkeys(("in_group", "uses_group"), ("godot_node_group",)),
    **dict.fromkeys(("extends", "implements", "embeds"), ("type", "class", "interface")),
}
#: The same across repositories: tests are no targets, configuration and request
#: edges are restricted, codecs and their fields must be protobuf declarations.
PEER_TARGET_KINDS: dict[str, tuple[str, ...]] = {
    **TARGET_KINDS,
    **dict.fromkeys(("calls", "passes", "handled_by", "uses_middleware"), ("function", "method")),
    "requests": ("endpoint",),
    "reads_config": ("config_key",),
    **dict.fromkeys(("reads", "writes"), (*DATA_KINDS, "field")),
    "generated_from": ("type", "field"),
}
PEER_PROTOBUF = (("reads", "field"), ("writes", "field"), ("encodes", "type"), ("decodes", "type"), ("carries", "type"), ("generated_from", "type"), ("generated_from", "field"))

EXTERNAL_OWNER = "__external__"
WORKSPACE_OWNER = "__workspace__"

_PROPS = T.MapType(T.StringType(), T.StringType())


def _schema(text: str) -> T.StructType:
    names = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "map": _PROPS}
    return T.StructType([T.StructField(n, names[k]) for n, k in (p.split(":") for p in text.split())])


NODES = _schema(
    "repository:string id:string kind:string name:string qualified_name:string language:string path:string line:int "
    "column_no:int end_line:int properties:map owner_file:string external:boolean"
)
FACTS = _schema(
    "repository:string id:string from_id:string source:string source_kind:string kind:string producer:string "
    "target_id:string target:string target_kind:string path:string line:int column_no:int end_line:int properties:map "
    "owner_file:string"
)
EDGES = _schema(
    "repository:string id:string fact_id:string from_id:string to_id:string kind:string producer:string path:string "
    "line:int column_no:int end_line:int properties:map"
)
FILES = _schema("repository:string path:string hash:string language:string size:long modified_ns:long evidence_digest:string")
DIAGNOSTICS = _schema("repository:string path:string line:int level:string message:string")


def checked_kind(value: str, kinds: tuple[str, ...] = NODE_KINDS) -> str:
    """A kind, trimmed and in lower case; '' stands for any; others raise."""
    kind = value.strip().lower()
    if kind and kind not in kinds:
        raise ValueError(f"unknown kind {value!r}; known: {', '.join(kinds)}")
    return kind
