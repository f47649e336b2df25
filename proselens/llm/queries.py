"""The queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from proselens.llm.decontamination import op7_decontamination
from proselens.llm.quality import OP5_SQL, op5_quality
from proselens.llm.sentencepiece_codec import op8_sentencepiece
from proselens.llm.sharding import op9_sharding
from proselens.llm.simhash import op3_simhash
from proselens.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from proselens.llm.suffix_dedup import op10_suffix_dedup
from proselens.llm.token_counts import op6_token_counts
from proselens.llm.url_reputation import OP2_SQL, op2_url_filter
from proselens.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_sharding": op9_sharding,
    "op10_suffix_dedup": op10_suffix_dedup,
}

SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op2_url_filter": OP2_SQL,
    "op4_warc": OP4_SQL,
    "op5_quality": OP5_SQL,
}
