"""The queries of this subpackage, for registration."""

from __future__ import annotations

from . import bpe, collocation, importance, lines, media, mixing, quality, secrets, sharding, simhash, tokenfile, topk, warc

QUERIES = {
    "op1_sharding": sharding.documents_to_shards,
    "op2_simhash": simhash.document_groups,
    "op3_quality": quality.document_quality,
    "op4_media": media.document_media,
    "op5_mixing": mixing.document_mix,
    "op6_bpe": bpe.document_ids,
    "op7_tokenfile": tokenfile.document_file,
    "op8_secrets": secrets.document_secrets,
    "op9_warc": warc.page_archive,
    "op10_topk": topk.vector_search,
    "op11_collocation": collocation.document_phrases,
    "op12_lines": lines.document_lines,
    "op13_importance": importance.document_draw,
}
#: Queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op5_mixing": mixing.oracle_sql(),
    "op11_collocation": collocation.oracle_sql(),
    "op12_lines": lines.oracle_sql(),
    "op13_importance": importance.oracle_sql(),
}
