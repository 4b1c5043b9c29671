"""The queries of this package and their SQL, by the names under which they are registered."""

from __future__ import annotations

from . import pii, quality
from .bpe import op1_bpe_tree
from .chunks import op5_chunk_fingerprints
from .language import op6_language_id
from .packing import op4_best_fit_packing
from .secrets import op9_secret_scan
from .sharding import op8_sampled_splitters
from .simhash import op3_simhash_bk_trees
from .toxicity import op10_toxicity_grammar

QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_tree,
        quality.op2_quality_rules,
        op3_simhash_bk_trees,
        op4_best_fit_packing,
        op5_chunk_fingerprints,
        op6_language_id,
        pii.op7_pii,
        op8_sampled_splitters,
        op9_secret_scan,
        op10_toxicity_grammar,
    )
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op2_quality_rules": quality.ORACLE, "op7_pii": pii.ORACLE}
