"""Registered queries of the training-data operators and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from lodestar.llm import decontaminate, mixing, warc
from lodestar.llm.ann import op2_ann
from lodestar.llm.decontaminate import op10_decontaminate
from lodestar.llm.hmm import op4_hmm
from lodestar.llm.mixing import op9_mixing
from lodestar.llm.pii import op7_pii
from lodestar.llm.quality import op1_quality
from lodestar.llm.repeats import op5_repeats
from lodestar.llm.secrets import op3_secrets
from lodestar.llm.simhash import op6_simhash
from lodestar.llm.warc import op8_warc


def queries() -> dict:
    return {"op1_quality": op1_quality, "op2_ann": op2_ann, "op3_secrets": op3_secrets, "op4_hmm": op4_hmm, "op5_repeats": op5_repeats, "op6_simhash": op6_simhash, "op7_pii": op7_pii, "op8_warc": op8_warc, "op9_mixing": op9_mixing, "op10_decontaminate": op10_decontaminate}


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": warc.ORACLE, "op9_mixing": mixing.ORACLE, "op10_decontaminate": decontaminate.ORACLE}
