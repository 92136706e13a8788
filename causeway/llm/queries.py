"""The queries of this subpackage and their DuckDB equivalents, where SQL can express them."""

from __future__ import annotations

from causeway.llm.bitslices import OP12_SQL, op12_exact_search
from causeway.llm.chat import OP6_SQL, op6_chat_format
from causeway.llm.counts import op9_token_counts
from causeway.llm.decontam import op5_decontamination
from causeway.llm.distances import OP11_SQL, op11_hard_negatives
from causeway.llm.gif import op8_gif_media
from causeway.llm.html import op1_html_extraction
from causeway.llm.idfiles import op2_token_files
from causeway.llm.jaccard import op10_jaccard_join
from causeway.llm.language import op4_language_id
from causeway.llm.merkle import OP13_SQL, op13_merkle_manifest
from causeway.llm.packing import op7_best_fit_packing
from causeway.llm.quality import op3_quality

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_token_files,
        op3_quality,
        op4_language_id,
        op5_decontamination,
        op6_chat_format,
        op7_best_fit_packing,
        op8_gif_media,
        op9_token_counts,
        op10_jaccard_join,
        op11_hard_negatives,
        op12_exact_search,
        op13_merkle_manifest,
    )
}
SQL = {"op6_chat_format": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op12_exact_search": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
