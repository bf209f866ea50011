"""The operators' queries by name, and the SQL of those that SQL can state."""

from __future__ import annotations

from quillgate.llm.decontaminate import OP2_SQL, op2_decontamination
from quillgate.llm.hamming_dedup import op11_hamming_dedup
from quillgate.llm.jaccard_join import op10_jaccard_join
from quillgate.llm.line_dedup import OP8_SQL, op8_line_dedup
from quillgate.llm.merkle import OP13_SQL, op13_merkle
from quillgate.llm.mixing import op4_mixing
from quillgate.llm.quality import op5_quality
from quillgate.llm.secret_scan import op3_secret_scan
from quillgate.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from quillgate.llm.toxicity import op1_toxicity
from quillgate.llm.url_filter import op7_url_filter
from quillgate.llm.warc import OP9_SQL, op9_warc
from quillgate.llm.whitening import op12_whitening

LLM_QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_hamming_dedup": op11_hamming_dedup,
    "op12_whitening": op12_whitening,
    "op13_merkle": op13_merkle,
}

LLM_ORACLES = {
    "op2_decontamination": OP2_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_warc": OP9_SQL,
    "op13_merkle": OP13_SQL,
}
