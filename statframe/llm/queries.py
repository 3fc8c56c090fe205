"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from .op1_url_reputation import OP1_SQL, op1_url_reputation
from .op2_cgk_decontamination import op2_cgk_decontamination
from .op3_html_suffix_array import op3_html_suffix_array
from .op4_line_windows import OP4_SQL, op4_line_windows
from .op5_simhash import op5_simhash
from .op6_repair import op6_repair
from .op7_crf_language import op7_crf_language
from .op8_knn_quality import op8_knn_quality
from .op9_quality_rules import OP9_SQL, op9_quality_rules
from .op10_sum_of_squares import op10_sum_of_squares
from .op11_spelling_variants import op11_spelling_variants
from .op12_piece_table_fim import OP12_SQL, op12_piece_table_fim
from .op13_chunk_recipes import OP13_SQL, op13_chunk_recipes

Q = {f.__name__: f for f in (
    op1_url_reputation, op2_cgk_decontamination, op3_html_suffix_array, op4_line_windows, op5_simhash, op6_repair, op7_crf_language,
    op8_knn_quality, op9_quality_rules, op10_sum_of_squares, op11_spelling_variants, op12_piece_table_fim, op13_chunk_recipes)}
O = {"op1_url_reputation": OP1_SQL, "op4_line_windows": OP4_SQL, "op9_quality_rules": OP9_SQL, "op12_piece_table_fim": OP12_SQL,
     "op13_chunk_recipes": OP13_SQL}
