"""The queries of this subpackage and the SQL of those that SQL can express."""

from therascape.llm.chunk_dedup import op3_chunk_dedup
from therascape.llm.decontaminate import OP6_SQL, op6_decontaminate
from therascape.llm.divergence import OP11_SQL, op11_source_divergence
from therascape.llm.licenses import op9_license_scan
from therascape.llm.manifest import OP12_SQL, op12_dataset_manifest
from therascape.llm.merkle import op4_merkle_fingerprints
from therascape.llm.mixing import OP1_SQL, op1_mix_sources
from therascape.llm.quality import op5_quality_nbsvm
from therascape.llm.sharding import OP13_SQL, op13_shard_histogram
from therascape.llm.simhash_dedup import op8_simhash_bktree
from therascape.llm.suffix_dedup import op2_suffix_dedup
from therascape.llm.token_counts import op10_token_counts
from therascape.llm.toxicity import op7_toxicity_ordinal

QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_suffix_dedup, op3_chunk_dedup, op4_merkle_fingerprints, op5_quality_nbsvm, op6_decontaminate, op7_toxicity_ordinal, op8_simhash_bktree, op9_license_scan, op10_token_counts, op11_source_divergence, op12_dataset_manifest, op13_shard_histogram)
}
ORACLE_SQL = {"op1_mix_sources": OP1_SQL, "op6_decontaminate": OP6_SQL, "op11_source_divergence": OP11_SQL, "op12_dataset_manifest": OP12_SQL, "op13_shard_histogram": OP13_SQL}
