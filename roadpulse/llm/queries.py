"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import corpus_pipeline

from .decontaminate import op1_benchmark_decontamination
from .oracles import SQL  # noqa: F401  (DuckDB SQL of the queries that SQL can express)
from .mixing import op13_mixing
from .packing import op10_packing
from .htmlmain import op4_html_main_text
from .permutation import op2_permutation_index
from .pii import op9_pii_pseudonyms
from .prefixtrie import op11_prefix_trie
from .quotes import op8_quotation_linking
from .sharding import op5_sharding
from .simhash import op7_simhash_near_dedup
from .toxicity import op6_toxicity_chain
from .vectorcodes import op12_vector_codes
from .warc import op3_warc_transactions

REGISTRY = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_permutation_index, op3_warc_transactions, op4_html_main_text, op5_sharding,
    op6_toxicity_chain, op7_simhash_near_dedup, op8_quotation_linking, op9_pii_pseudonyms, op10_packing, op11_prefix_trie, op12_vector_codes,
    op13_mixing)}
REGISTRY["pipeline"] = corpus_pipeline.run
