"""Queries and SQL of the training-data operators."""

from .decontaminate import op2_decontaminate
from .licenses import OP12_SQL, op12_license
from .media import op5_media
from .mixing import op8_mix
from .neardup import op4_neardup
from .pii import op7_pii
from .quality import op10_quality
from .resample import OP13_SQL, op13_resample
from .runs import op11_runs
from .suffixes import op1_suffix
from .toxicity import op9_toxicity
from .urls import OP3_SQL, op3_url
from .windows import op6_substring

QUERIES = {"op1_suffix": op1_suffix, "op2_decontaminate": op2_decontaminate, "op3_url": op3_url, "op4_neardup": op4_neardup, "op5_media": op5_media, "op6_substring": op6_substring, "op7_pii": op7_pii, "op8_mix": op8_mix, "op9_toxicity": op9_toxicity, "op10_quality": op10_quality, "op11_runs": op11_runs, "op12_license": op12_license, "op13_resample": op13_resample}
SQL = {"op3_url": OP3_SQL, "op12_license": OP12_SQL, "op13_resample": OP13_SQL}
