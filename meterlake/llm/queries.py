"""The training-data queries and, where SQL can say them, their oracles."""

from __future__ import annotations

from .bpe import token_report
from .centroids import CLUSTERS_SQL, clusters
from .common import table
from .embeddings import similar_vectors
from .fingerprints import fingerprint_report
from .langid import language_report
from .licenses import license_report
from .mixing import MIX_SQL, mix_report
from .neardup import near_duplicate_report
from .personal import personal_report
from .repair import REPAIR_SQL, repaired
from .secrets import secret_report
from .toolcalls import CHAT_SQL, format_chat
from .warc import ARCHIVE_SQL, archive_report


def op1_language_id(spark, sf_dir):
    return language_report(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark, sf_dir):
    return mix_report(table(spark, sf_dir, "documents"))


def op3_minhash_neardup(spark, sf_dir):
    return near_duplicate_report(table(spark, sf_dir, "documents"))


def op4_warc_archive(spark, sf_dir):
    return archive_report(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark, sf_dir):
    return secret_report(table(spark, sf_dir, "documents"))


def op6_embedding_neardup(spark, sf_dir):
    return similar_vectors(table(spark, sf_dir, "embeddings"))


def op7_license_scan(spark, sf_dir):
    return license_report(table(spark, sf_dir, "documents"))


def op8_chat_tool_calls(spark, sf_dir):
    return format_chat(table(spark, sf_dir, "conversations"))


def op9_document_fingerprints(spark, sf_dir):
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark, sf_dir):
    return token_report(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark, sf_dir):
    return clusters(table(spark, sf_dir, "embeddings"))


def op12_personal_data(spark, sf_dir):
    return personal_report(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return repaired(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_source_mixing, op3_minhash_neardup, op4_warc_archive, op5_secret_scan, op6_embedding_neardup, op7_license_scan, op8_chat_tool_calls, op9_document_fingerprints, op10_byte_bpe, op11_centroid_clusters, op12_personal_data, op13_conversation_repair)}
ORACLES: dict[str, str] = {"op2_source_mixing": MIX_SQL, "op4_warc_archive": ARCHIVE_SQL, "op8_chat_tool_calls": CHAT_SQL, "op11_centroid_clusters": CLUSTERS_SQL, "op13_conversation_repair": REPAIR_SQL}
