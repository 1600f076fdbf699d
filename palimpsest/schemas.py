"""Schemas of the stages; text fields stay strings, so that readers never guess a type."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


REVISION = _strings("page_title", "page_id", "rev_id", "parent_id", "timestamp", "username", "userid", "userip", "comment", "text")
REVISION_PAIR = _strings("rev_id", "page_id", "parent_id", "src_text", "tgt_text", "comment_text", "section_title", "page_title", "timestamp", "diff_url")
TRIPLE = _strings("prefix", "original", "edited", "rev_id", "page_id", "parent_id", "timestamp", "diff_url")
ABLATION = _strings("grounding_true", "grounding_false", "context", "target")
CRAWL_META = _strings("filename", "offset", "length", "status")
SYNTHETIC_EXAMPLE = _strings("source", "new_source", "context", "target", "new_target")
