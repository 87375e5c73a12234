"""Queries of the llm operators; none of them is within reach of plain SQL except where ``ORACLE`` has it."""

from __future__ import annotations

from arborine.llm.docpairs import code_description_pairs, documented_symbols
from arborine.llm.handwritten import file_labels, label_shares
from arborine.llm.mixing import mixed
from arborine.llm.pagespam import page_labels, spam_pages
from arborine.llm.syntax import syntax_rates, syntax_repairs
from arborine.llm.tokenizer import encoded
from arborine.sources.tables import table


def p2_found(spark, d):
    return file_labels(table(spark, d, "documents")).where("label <> 'hand'").select("doc_id")


def p2_shares(spark, d):
    return label_shares(file_labels(table(spark, d, "documents")))


def p3_found(spark, d):
    return syntax_repairs(table(spark, d, "documents")).where("cost > 0").select("doc_id")


def p3_rates(spark, d):
    return syntax_rates(syntax_repairs(table(spark, d, "documents")))


def p4_found(spark, d):
    return documented_symbols(table(spark, d, "symbols"), table(spark, d, "documents"))


def p4_pairs(spark, d):
    return code_description_pairs(table(spark, d, "symbols"), table(spark, d, "documents"))


def p7_ids(spark, d):
    return encoded(table(spark, d, "documents"))


def p8_copies(spark, d):
    return mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark, d):
    return mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark, d):
    return spam_pages(table(spark, d, "documents"))


def p9_labels(spark, d):
    return page_labels(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_shares, p3_found, p3_rates, p4_found, p4_pairs, p7_ids, p8_copies, p8_shares, p9_found, p9_labels)}
ORACLE: dict = {}
