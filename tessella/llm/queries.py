"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import decontamination, embeddings, language_id, license_scan, line_dedup, packing, phrases, sharding, simhash, suffix_dedup, token_files, vector_codes, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_sharding": sharding.op2_sharding,
    "op3_token_files": token_files.op3_token_files,
    "op4_simhash": simhash.op4_simhash,
    "op5_warc": warc.op5_warc,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_phrases": phrases.op13_phrases,
}
ORACLES: dict[str, str] = {
    "op5_warc": warc.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op12_license_scan": license_scan.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
