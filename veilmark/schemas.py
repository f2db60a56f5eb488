"""Explicit schemas; nothing in the library infers one."""

DOCS = "doc_id BIGINT, text STRING"
RULES = (
    "id STRING, framework STRING, rule STRING, entity_types ARRAY<STRING>, "
    "description STRING, risk STRING"
)
MODEL_HITS = (
    "doc_id BIGINT, chunk INT, label STRING, span_start INT, span_end INT, "
    "value STRING, score DOUBLE"
)

# One finding inside a document row.  Field order is the sort order of the
# overlap scan: start, falling score, arrival order.  The order goes by layer first:
# rules and names, then labels and models, then regex.
LAYER_SPAN = 1_000_000_000_000
LAYERS = {"rules": 0, "ner": 1, "regex": 2}
HIT = (
    "struct<st:int,neg:double,ord:bigint,en:int,sc:double,entity_type:string,"
    "category:string,value:string,risk:string,source:string,reason:string>"
)
HITS = f"array<{HIT}>"

FINDING_COLUMNS = [
    "doc_id", "entity_type", "category", "value", "span_start", "span_end",
    "score", "risk", "source", "reason",
]
MATCH = (
    "struct<rank:int,id:string,framework:string,rule:string,description:string,"
    "entity_types:array<string>,risk:string,relevance:double>"
)
