"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tracewright.llm.bpe import op1_bpe
from tracewright.llm.divergence import op11_divergence, op11_sql
from tracewright.llm.fingerprint import op5_fingerprints
from tracewright.llm.line_dedup import op3_line_dedup
from tracewright.llm.lm import op2_lm
from tracewright.llm.media import op8_media
from tracewright.llm.mixing import op10_mixing
from tracewright.llm.ngram_join import op9_ngram_join
from tracewright.llm.quality import op4_quality
from tracewright.llm.sharding import op6_sharding, op6_sql
from tracewright.llm.toxicity import op7_toxicity
from tracewright.llm.warc import op13_sql, op13_warc
from tracewright.llm.whitening import op12_whitening

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_lm": op2_lm,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_media": op8_media,
    "op9_ngram_join": op9_ngram_join,
    "op10_mixing": op10_mixing,
    "op11_divergence": op11_divergence,
    "op12_whitening": op12_whitening,
    "op13_warc": op13_warc,
}
ORACLES: dict[str, str] = {
    "op6_sharding": op6_sql(),
    "op11_divergence": op11_sql(),
    "op13_warc": op13_sql(),
}
