"""All registered queries of this subpackage."""

from sitescope.llm import bpe, jaccard, merkle, packing, quality, resampling, secrets, simhash, substrings, suffix_tree, toxicity, url_filters, warc

MODULES = (secrets, packing, substrings, quality, bpe, simhash, url_filters, suffix_tree, jaccard, warc, merkle, resampling, toxicity)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
