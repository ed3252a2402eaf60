"""The queries of this subpackage, by the names under which __spark_entry__ registers them."""

from __future__ import annotations

from .bayes_jaccard import op8_bayes_jaccard
from .e8_neardup import op5_e8_neardup
from .kd_shards import op3_kd_shards
from .kneser_ney import op10_kneser_ney
from .line_dedup import op2_line_dedup
from .maxent_lm import op13_maxent_lm
from .ranked_varint import op4_ranked_varint
from .sentencepiece_codec import op7_sentencepiece
from .slack_packing import op6_slack_packing
from .source_audit import ORACLE as OP12_SQL
from .source_audit import op12_source_audit
from .token_count import op9_token_counts
from .toxicity_cnn import op1_toxicity_cnn
from .wavelet_search import ORACLE as OP11_SQL
from .wavelet_search import op11_wavelet_search

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity_cnn,
        op2_line_dedup,
        op3_kd_shards,
        op4_ranked_varint,
        op5_e8_neardup,
        op6_slack_packing,
        op7_sentencepiece,
        op8_bayes_jaccard,
        op9_token_counts,
        op10_kneser_ney,
        op11_wavelet_search,
        op12_source_audit,
        op13_maxent_lm,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op11_wavelet_search": OP11_SQL, "op12_source_audit": OP12_SQL}
