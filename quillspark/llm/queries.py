"""The queries of this subpackage and their DuckDB SQL."""

from quillspark.llm import bpe, chat, langid, mixing, neardup, quality, search, secrets, toxicity, warc

QUERIES = {
    "op1_secret_ledger": secrets.op1_secret_ledger,
    "op2_neardup": neardup.op2_neardup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality": quality.op5_quality,
    "op6_langid": langid.op6_langid,
    "op7_warc": warc.op7_warc,
    "op8_search": search.op8_search,
    "op9_bpe": bpe.op9_bpe,
    "op10_chat": chat.op10_chat,
    "quality_base": quality.quality_base,
}

ORACLE_SQL = {
    "op1_secret_ledger": secrets.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_search": search.OP8_SQL,
    "op10_chat": chat.OP10_SQL,
    "quality_base": quality.QUALITY_BASE_SQL,
}
