"""Queries of this subpackage and their SQL."""
from __future__ import annotations

from spreadlens.llm.bpe import op13_bpe
from spreadlens.llm.collocations import OP11_SQL, op11_collocations
from spreadlens.llm.decontamination import OP7_SQL, op7_decontamination
from spreadlens.llm.language import op8_language
from spreadlens.llm.linededup import OP2_SQL, op2_line_dedup
from spreadlens.llm.nearest import op6_nearest
from spreadlens.llm.packing import op9_packing
from spreadlens.llm.quality import op3_quality
from spreadlens.llm.secrets import op10_secrets
from spreadlens.llm.simhash import op5_simhash
from spreadlens.llm.tokencounts import op4_token_counts
from spreadlens.llm.toxicity import op1_toxicity
from spreadlens.llm.vectorcodes import OP12_SQL, op12_vector_codes

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_quality, op4_token_counts, op5_simhash, op6_nearest,
                                   op7_decontamination, op8_language, op9_packing, op10_secrets, op11_collocations, op12_vector_codes, op13_bpe)}
ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op7_decontamination": OP7_SQL, "op11_collocations": OP11_SQL, "op12_vector_codes": OP12_SQL}
