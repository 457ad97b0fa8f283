"""Table schemas and the constants that are part of the results."""

from __future__ import annotations

from pyspark.sql import types as T

# Scoring.
K1 = 1.2
B = 0.75
TITLE_REPEAT = 3
SUMMARY_REPEAT = 2
TEXT_TOKENS = 400
ENTITY_TOKENS = 24
TOP_K = 5
MOST_TOP_K = 12
SNIPPET = 700

# Chunks.
CHUNK_TARGET = 900
CHUNK_HARD = 1200
SECTION_LEAST = 320
TITLE_LEVEL = 3
CHUNK_ENTITIES = 12
CHUNK_LINKS = 8

# Outlines and exports.
OUTLINE_ENTRIES = 6000
MAP_NODES = 320
FOLD_TITLES = 12
TITLE_LENGTH = 90
SECTION_ENTITIES = 6
MAP_ENTITIES = 12

# Reading, asking, enriching, folders, tags, graph.
PAGE_CHARS = 12_000
PASSAGE_CHARS = 1200
LEAST_PASSAGES = 2
TAG_LENGTH = 32
TAGS_PER_DOC = 20
FOLDER_NAME = 60
FOLDER_DEPTH = 5
GRAPH_NODES = 600
GRAPH_EDGES = 4000

STATUSES = ("queued", "extracting", "parsing", "extracted", "indexing", "enriching", "done", "error", "cancelled")
#: A run in one of these was cut off and can be taken up again.
RESUMABLE = ("queued", "extracting", "parsing", "enriching", "indexing")

OUTLINE_ENTRY = T.StructType(
    [
        T.StructField("level", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("path", T.ArrayType(T.StringType())),
    ]
)

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("original_name", T.StringType()),
        T.StructField("mime", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("uploaded_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("progress", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("warning", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("outline", T.ArrayType(OUTLINE_ENTRY)),
        T.StructField("outline_source", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("folder_id", T.StringType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("tokens", T.IntegerType()),
        T.StructField("entities", T.ArrayType(T.StringType())),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("summary", T.StringType()),
        T.StructField("heading", T.BooleanType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("section_path", T.ArrayType(T.StringType())),
    ]
)

FOLDERS = T.StructType(
    [
        T.StructField("folder_id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("ord", T.LongType()),
    ]
)
