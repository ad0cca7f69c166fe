"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from sightings.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from sightings.llm.html_text import op12_main_text
from sightings.llm.language_id import op2_language_id
from sightings.llm.license_scan import OP1_SQL, op1_license_scan
from sightings.llm.line_templates import OP6_SQL, op6_line_templates
from sightings.llm.lz_fingerprint import op4_lz_fingerprint
from sightings.llm.packing import op8_best_fit_packing
from sightings.llm.piece_codec import op5_piece_codec
from sightings.llm.simhash import op9_simhash
from sightings.llm.spelling import op13_spelling_variants
from sightings.llm.token_files import op3_token_files
from sightings.llm.toxicity import op7_toxicity
from sightings.llm.whitening import op11_whitening

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_token_files": op3_token_files,
    "op4_lz_fingerprint": op4_lz_fingerprint,
    "op5_piece_codec": op5_piece_codec,
    "op6_line_templates": op6_line_templates,
    "op7_toxicity": op7_toxicity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_whitening": op11_whitening,
    "op12_main_text": op12_main_text,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {
    "op1_license_scan": OP1_SQL,
    "op6_line_templates": OP6_SQL,
    "op10_exact_dedup": OP10_SQL,
}
