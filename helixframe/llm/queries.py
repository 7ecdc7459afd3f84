"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from . import decontaminate, exact_dedup, language, mixing, packing, pii, quality, repeats, simhash, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_warc": warc.op2_warc,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_simhash": simhash.op4_simhash,
    "op5_language": language.op5_language,
    "op6_pii": pii.op6_pii,
    "op7_repeats": repeats.op7_repeats,
    "op8_quality": quality.op8_quality,
    "op9_mixing": mixing.op9_mixing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL = {
    "op2_warc": warc.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
}
