"""The corpus operators as named queries, and the SQL of those that SQL expresses."""

from __future__ import annotations

from treesum.llm import chat, jaccard, lexical, licenses, mixing, topk, vafile, vectors
from treesum.llm.chat import op7_chat
from treesum.llm.jaccard import op6_jaccard
from treesum.llm.language import op2_language
from treesum.llm.lexical import op13_wand
from treesum.llm.licenses import op9_licenses
from treesum.llm.mixing import op5_mixing
from treesum.llm.quality import op3_quality
from treesum.llm.sharding import op12_sharding
from treesum.llm.store import op10_store
from treesum.llm.tokens import op8_byte_bpe
from treesum.llm.topk import op1_topk
from treesum.llm.vafile import op11_vafile
from treesum.llm.vectors import op4_nndescent

QUERIES = {
    "op1_topk": op1_topk,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_nndescent": op4_nndescent,
    "op5_mixing": op5_mixing,
    "op6_jaccard": op6_jaccard,
    "op7_chat": op7_chat,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_licenses": op9_licenses,
    "op10_store": op10_store,
    "op11_vafile": op11_vafile,
    "op12_sharding": op12_sharding,
    "op13_wand": op13_wand,
}
ORACLES: dict[str, str] = {
    "op1_topk": topk.ORACLE,
    "op4_nndescent": vectors.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op6_jaccard": jaccard.ORACLE,
    "op7_chat": chat.oracle(),
    "op9_licenses": licenses.oracle(),
    "op11_vafile": vafile.oracle(),
    "op13_wand": lexical.ORACLE,
}
