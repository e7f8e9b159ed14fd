"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vidcohort.llm import linededup, pipeline
from vidcohort.llm.bpe import op7_bpe
from vidcohort.llm.convrepair import op13_convrepair
from vidcohort.llm.decontam import op4_decontam
from vidcohort.llm.langid import op10_langid
from vidcohort.llm.lmscore import op9_lmscore
from vidcohort.llm.media import op5_media
from vidcohort.llm.pii import op12_pii
from vidcohort.llm.simhash import op1_simhash
from vidcohort.llm.spelling import op11_spelling
from vidcohort.llm.suffixdedup import op3_suffixdedup
from vidcohort.llm.toxicity import op2_toxicity
from vidcohort.llm.urlfilter import op6_urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_toxicity": op2_toxicity,
        "op3_suffixdedup": op3_suffixdedup,
        "op4_decontam": op4_decontam,
        "op5_media": op5_media,
        "op6_urlfilter": op6_urlfilter,
        "op7_bpe": op7_bpe,
        "op8_linededup": linededup.op8_linededup,
        "op9_lmscore": op9_lmscore,
        "op10_langid": op10_langid,
        "op11_spelling": op11_spelling,
        "op12_pii": op12_pii,
        "op13_convrepair": op13_convrepair,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_linededup": linededup.ORACLE_SQL}
