"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from .archives import op1_archives
from .language import op8_language
from .minhash import op10_minhash
from .mixing import OP6_SQL, op6_mixing
from .neighbours import op5_nn_descent
from .oracles import OP1_SQL, OP3_SQL, OP10_SQL
from .postings import op3_decontamination
from .ppm import op4_ppm
from .pseudonyms import op2_pseudonyms
from .toxicity import op9_toxicity
from .wavelet import op7_wavelet

QUERIES = {
    "op1_archives": op1_archives,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_decontamination": op3_decontamination,
    "op4_ppm": op4_ppm,
    "op5_nn_descent": op5_nn_descent,
    "op6_mixing": op6_mixing,
    "op7_wavelet": op7_wavelet,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_minhash": op10_minhash,
}
SQL = {"op1_archives": OP1_SQL, "op3_decontamination": OP3_SQL, "op6_mixing": OP6_SQL, "op10_minhash": OP10_SQL}
