"""The registered queries of the operators, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from plumbline.llm import oracles
from plumbline.llm.centroids import op11_centroid_clustering, op11_sql
from plumbline.llm.chunks import op10_media_chunks
from plumbline.llm.jaccard import op4_jaccard_join
from plumbline.llm.mixing import op6_source_mixing
from plumbline.llm.neighbours import op1_nearest_neighbours
from plumbline.llm.packing import op13_best_fit_packing
from plumbline.llm.pieces import op3_sentencepiece
from plumbline.llm.quality import op8_quality_classifier
from plumbline.llm.recompression import op7_recompression
from plumbline.llm.secrets import op2_secret_scan
from plumbline.llm.squares import op12_periodic_runs, op12_sql
from plumbline.llm.suffixes import op5_induced_sorting
from plumbline.llm.warc import OP9_SQL, op9_warc_revisits

QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_secret_scan, op3_sentencepiece, op4_jaccard_join, op5_induced_sorting, op6_source_mixing, op7_recompression, op8_quality_classifier, op9_warc_revisits, op10_media_chunks, op11_centroid_clustering, op12_periodic_runs, op13_best_fit_packing)}
ORACLE_SQL: dict[str, str] = {**oracles.ORACLE_SQL, "op9_warc_revisits": OP9_SQL, "op11_centroid_clustering": op11_sql(), "op12_periodic_runs": op12_sql()}
