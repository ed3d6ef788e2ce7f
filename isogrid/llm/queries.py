"""The registered queries of the training-data operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, oracles, quality_rules
from .decontaminate import op8_decontaminate
from .language_id import op4_language_id
from .mixing import op6_mixing
from .quality_model import op2_quality_model
from .quality_rules import op3_quality_rules
from .sharding import op10_sharding
from .simhash import op7_simhash
from .suffix_dedup import op1_suffix_dedup
from .token_files import op9_token_files
from .warc import op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_model": op2_quality_model,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_files": op9_token_files,
    "op10_sharding": op10_sharding,
    "quality_ablations": quality_rules.quality_ablations,
}
ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.ORACLE,
    "quality_ablations": quality_rules.ABLATIONS,
    "op5_warc": oracles.WARC,
    "op6_mixing": mixing.ORACLE,
    "op8_decontaminate": oracles.DECONTAMINATE,
}
