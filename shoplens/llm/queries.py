"""Registered queries of this package, and the SQL that some of them must agree with."""

from __future__ import annotations

from shoplens.llm.embedding_dedup import OP5_SQL, op5_embeddings
from shoplens.llm.jaccard_join import OP9_SQL, op9_jaccard
from shoplens.llm.language_id import op10_language
from shoplens.llm.line_quality import OP4_SQL, op4_quality
from shoplens.llm.mixing import op8_mixing
from shoplens.llm.packing import op1_packing
from shoplens.llm.prefix_trie import OP11_SQL, op11_prefixes
from shoplens.llm.secrets import op3_secrets
from shoplens.llm.substring_dedup import op2_passages
from shoplens.llm.toxicity import op12_toxicity
from shoplens.llm.transcripts import op6_transcripts
from shoplens.llm.vector_codes import OP13_SQL, op13_codes
from shoplens.llm.warc import OP7_SQL, op7_warc

QUERIES = {f.__name__: f for f in (op1_packing, op2_passages, op3_secrets, op4_quality, op5_embeddings, op6_transcripts, op7_warc, op8_mixing, op9_jaccard, op10_language, op11_prefixes, op12_toxicity, op13_codes)}
ORACLES: dict[str, str] = {"op4_quality": OP4_SQL, "op5_embeddings": OP5_SQL, "op7_warc": OP7_SQL, "op9_jaccard": OP9_SQL, "op11_prefixes": OP11_SQL, "op13_codes": OP13_SQL}
