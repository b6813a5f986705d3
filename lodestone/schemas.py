"""Row types and vocabularies of the support corpus."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SECTION = _struct(level=_I, text=_S)
LINK = _struct(text=_S, url=_S)
RAW_PAGE = _struct(page_id=_L, url=_S, html=_S)
PAGE = _struct(url=_S, title=_S, content=_S, sections=T.ArrayType(SECTION), code_blocks=T.ArrayType(_S), links=T.ArrayType(LINK))
DOCUMENT = _struct(source=_S, content=_S, type=_S, title=_S, sections=T.ArrayType(SECTION), code_blocks=T.ArrayType(_S))
CHUNK = _struct(source=_S, chunk_ix=_I, chunk_id=_S, text=_S)
INDEX = _struct(index=_L, source=_S, text=_S, embedding=T.ArrayType(T.FloatType()))
CLASSIFICATION = _struct(topic=_S, sentiment=_S, priority=_S)
ANSWER = _struct(query=_S, answer=_S, analysis=CLASSIFICATION, sources=T.ArrayType(_S))
UPLOAD = _struct(file_id=_S, filename=_S, file_path=_S, content_type=_S, size=_L, content=_S)
TICKET = _struct(
    id=_L, ticket_number=_S, query=_S, topic=_S, sentiment=_S, priority=_S, response=_S, full_response=_S,
    created_at=T.TimestampType(), status=_S, sources=T.ArrayType(_S),
)
LOG = _struct(id=_L, ts=T.TimestampType(), level=_S, message=_S, type=_S)

# Names that results must agree on.
TOPICS = ["How-to", "Product", "API/SDK", "SSO", "Connector", "Lineage", "Glossary", "Best practices", "Sensitive data"]
SENTIMENTS = ["Frustrated", "Curious", "Angry", "Neutral"]
PRIORITIES = ["P0 (High)", "P1 (Medium)", "P2 (Low)"]
ANSWERED_TOPICS = ["How-to", "Product", "API/SDK", "SSO", "Best practices"]
FALLBACK = {"topic": "Unknown", "sentiment": "Neutral", "priority": "P2"}
UPLOAD_TYPES = [
    "text/plain", "text/csv", "application/pdf", "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/json", "text/markdown",
    "image/jpeg", "image/png", "image/gif",
]
UPLOAD_LIMIT = 10 * 1024 * 1024
LOG_LEVELS = ["INFO", "WARN", "ERROR"]
LOG_TYPES = ["user", "system", "api", "error", "escalation", "response"]
