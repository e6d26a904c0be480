"""Record types. A field marked not nullable reads as zero, false or an empty
text where the input lacks it; a nullable one stays null."""

from __future__ import annotations

from pyspark.sql import types as T


def _f(name: str, kind: T.DataType, nullable: bool = False) -> T.StructField:
    return T.StructField(name, kind, nullable)


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

DIGEST_ANALYSIS = T.StructType([
    _f("digest", _S), _f("size", _L), _f("repos", T.ArrayType(_S), True), _f("repo_count", _I, True),
])

REPOSITORY = T.StructType([
    _f("repo_name", _S), _f("repo_owner", _S), _f("short_description", _S),
    _f("is_automated", _B), _f("is_official", _B), _f("pull_count", _L), _f("star_count", _L),
])

# The population statistics tell a missing count from a zero.
REPOSITORY_COUNTS = T.StructType([
    _f("pull_count", _L, True), _f("star_count", _L, True), _f("is_official", _B),
])

TAG = T.StructType([
    _f("repo_name", _S), _f("digest", _S), _f("architecture", _S), _f("os", _S),
    _f("size", _L, True), _f("status", _S, True), _f("last_pulled", _S), _f("last_pushed", _S),
])

IMAGE = T.StructType([
    _f("architecture", _S), _f("os", _S), _f("last_pulled", _S), _f("last_pushed", _S),
    _f("size", _L, True), _f("digest", _S), _f("status", _S, True),
])

TAG_PAGE = T.StructType([
    _f("repo_name", _S), _f("images", T.ArrayType(IMAGE), True), _f("tag_last_pushed", _S),
])

MANIFEST_LAYER = T.StructType([
    _f("repo", _S, True), _f("layer_digest", _S, True), _f("size", _L, True), _f("tag_digest", _S, True),
])

LAYER_SAMPLE = T.StructType([
    _f("layer_digest", _S), _f("layer", _S), _f("repo", _S), _f("size", _S, True),
])

LAYER = T.StructType([
    _f("digest", _S), _f("file_count", _I, True), _f("max_depth", _I, True),
    _f("uncompressed_size", _L, True), _f("secrets", T.ArrayType(_S), True),
])

SECRET_RECORD = T.StructType([
    _f("fragment_hash", _S),
    _f("secrets", T.StructType([
        _f("file", _S), _f("file_type", _S), _f("file_size", _L, True),
        _f("origin", _S), _f("secret", _S), _f("start_line", _I),
    ]), True),
])

SEARCH_ROW = T.StructType([
    _f("repo_name", _S, True), _f("query", _S, True), *REPOSITORY.fields[1:],
])

HISTOGRAM = T.StructType([_f("key", _S), _f("count", _L)])
SERIES = T.StructType([_f("value", _L)])
LAYER_TSV = T.StructType([_f("layer", _S, True), _f("repo", _S, True), _f("size", _L, True)])
