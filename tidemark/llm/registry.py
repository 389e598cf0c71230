"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, secret_scan
from .bpe import op9_bpe
from .language_id import op1_language_id
from .line_dedup import op7_line_dedup
from .mixing import op6_mixing
from .multiprobe import op10_multiprobe
from .quality_model import op5_quality_model
from .quality_rules import op2_quality_rules
from .secret_scan import op4_secret_scan
from .simhash import op3_simhash
from .substring_dedup import op8_substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_language_id,
        op2_quality_rules,
        op3_simhash,
        op4_secret_scan,
        op5_quality_model,
        op6_mixing,
        op7_line_dedup,
        op8_substring_dedup,
        op9_bpe,
        op10_multiprobe,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_scan": secret_scan.SQL, "op6_mixing": mixing.SQL}
