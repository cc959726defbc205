"""The registered queries of this subpackage and their DuckDB statements."""

from barloom.llm import (
    bpe, chat, exact_dedup, langid, licenses, near_dedup, packing, periodic, pii, sharding, tiff, warc, whitening,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_chat": chat.op2_chat,
    "op3_sharding": sharding.op3_sharding,
    "op4_language": langid.op4_language,
    "op5_bpe": bpe.op5_bpe,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_pii": pii.op7_pii,
    "op8_tiff": tiff.op8_tiff,
    "op9_packing": packing.op9_packing,
    "op10_licenses": licenses.op10_licenses,
    "op11_warc": warc.op11_warc,
    "op12_periodic": periodic.op12_periodic,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE = {**exact_dedup.ORACLE, **chat.ORACLE, **warc.ORACLE}
